"""Texts from tables of code elements and results: skeletons by depth, outlines, search results, compact values and signatures of schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

#: Limits of each verbosity: longest description, most items, whether details are shown, longest value.
VERBOSITY = {"minimal": (40, 5, False, 50), "normal": (80, 15, True, 100), "detailed": (200, 50, True, 200)}


def _text(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name) of ``rows`` (key, at, t): texts in order of ``at``, nulls left out."""
    got = rows.where("t is not null").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "t"))).alias("x"))
    return got.select(key, F.array_join(F.transform("x", lambda v: v["t"]), "\n").alias(name))


def skeletons(elements: DataFrame, depth: int = 1) -> DataFrame:
    """(path, skeleton): types, functions, classes with their methods, exported variables.

    Depth 1 has signatures only, 2 the first line of each comment after its signature, 3 whole comments before it. Elements are as parse_code makes them.
    """
    e = elements.where("bucket in ('types', 'interfaces', 'functions', 'classes') or (bucket = 'variables' and exported)")
    method = (F.col("bucket") == "functions") & F.col("parent").isNotNull()
    group = F.when(F.col("bucket").isin("types", "interfaces"), 0).when((F.col("bucket") == "functions") & ~method, 1).when(F.col("bucket") == "variables", 3).otherwise(2)
    # a method stands right after its class
    head = e.where("bucket = 'classes'").select("path", F.col("name").alias("parent"), F.col("start_line").alias("home")).groupBy("path", "parent").agg(F.min("home").alias("home"))
    e = e.join(head, ["path", "parent"], "left")
    at = F.struct(group.alias("g"), F.coalesce("home", "start_line").alias("h"), method.alias("m"), "start_line", "name")
    first = F.substring_index("doc", "\n", 1)
    detail = F.when(F.col("bucket") == "types", F.concat(F.lit("type "), "name")).when(F.col("bucket") == "variables", F.concat(F.lit("export "), "name")).otherwise(F.col("detail"))
    indent = F.when(method, "  ").otherwise("")
    line = F.concat(indent, detail)
    if depth == 2:
        line = F.when(F.col("doc") != "", F.concat(line, F.lit(" // "), first)).otherwise(line)
    elif depth >= 3:
        line = F.when(F.col("doc") != "", F.concat(indent, F.lit("/** "), "doc", F.lit(" */\n"), line)).otherwise(line)
    return _text(e.select("path", at.alias("at"), line.alias("t")), "path", "skeleton")


def outlines(elements: DataFrame) -> DataFrame:
    """(path, outline): one line for each kind of element, with names and lines, as an overview of a file."""
    ref = F.when(F.col("start_line") == F.col("end_line"), F.concat(F.lit(" ("), "start_line", F.lit(")"))).otherwise(F.concat(F.lit(" ("), "start_line", F.lit("-"), "end_line", F.lit(")")))
    kinds = [("IMPORTS", "bucket = 'imports'", ""), ("TYPES", "bucket in ('types', 'interfaces')", ""), ("FUNCTIONS", "bucket = 'functions' and parent is null", ref), ("CLASSES", "bucket = 'classes'", ref), ("EXPORTS", "bucket = 'variables' and exported", "")]
    out = None
    for k, (title, test, tail) in enumerate(kinds):
        names = elements.where(test).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start_line", "name", F.concat("name", tail if isinstance(tail, Column) else F.lit(tail)).alias("t")))).alias("x"))
        names = names.withColumn("x", F.transform("x", lambda v: v["t"]))
        listed = F.concat(F.array_join(F.slice("x", 1, 3), ", "), F.when(F.size("x") > 3, F.concat(F.lit(" +"), F.size("x") - 3)).otherwise("")) if title == "IMPORTS" else F.array_join("x", ", ")
        part = names.select("path", F.lit(k).alias("at"), F.concat(F.lit(title + ": "), listed).alias("t"))
        out = part if out is None else out.unionByName(part)
    return _text(out, "path", "outline")


def found(elements: DataFrame, query: str) -> DataFrame:
    """(path, results): the elements whose name, signature or comment holds ``query``, whatever its case, one a line under their number."""
    q = query.lower()
    hit = F.lower("name").contains(q) | F.lower("detail").contains(q) | F.lower("doc").contains(q)
    line = F.concat("bucket", F.lit(" "), F.coalesce(F.concat("parent", F.lit(".")), F.lit("")), "name", F.when(F.col("exported"), " (exported)").otherwise(""), F.lit(" ("), "start_line", F.lit("-"), "end_line", F.lit(")"))
    rows = elements.where(hit & (F.col("bucket") != "imports")).select("path", F.struct("start_line", "name").alias("at"), line.alias("t"))
    lines = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("at", "t"))).alias("x"))
    return lines.select("path", F.concat(F.lit("Matches: "), F.size("x"), F.lit("\n"), F.array_join(F.transform("x", lambda v: v["t"]), "\n")).alias("results"))


def compact(c: Column, kind: S.DataType, most: int) -> Column:
    """A value in few characters: null as -, booleans as T and F, long texts cut, numbers and dates whole, arrays as [n], structs and maps as {...}."""
    if isinstance(kind, S.BooleanType):
        out = F.when(c, "T").otherwise("F")
    elif isinstance(kind, S.ArrayType):
        out = F.concat(F.lit("["), F.size(c), F.lit("]"))
    elif isinstance(kind, S.StructType | S.MapType):
        out = F.lit("{...}")
    elif isinstance(kind, S.StringType):
        out = F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)
    else:
        out = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(out)


def tabular(df: DataFrame, key: str, order: str, name: str, most: int = 20) -> DataFrame:
    """(key, toon): for each key a header with the number of rows and the first four columns, then at most ``most`` rows, and a note if there are more."""
    from pyspark.sql import Window

    columns = [c for c in df.columns if c != key][:4]
    values = [compact(F.col(c), df.schema[c].dataType, 30) for c in columns]
    quoted = [F.when(v.contains(","), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v) for v in values]
    w = Window.partitionBy(key)
    x = df.withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(order))).where(F.col("_r") <= most)
    rows = x.groupBy(key).agg(F.max("_n").alias("n"), F.array_sort(F.collect_list(F.struct("_r", F.concat(F.lit("  "), F.concat_ws(",", *quoted)).alias("t")))).alias("x"))
    head = F.concat(F.lit(f"{name}["), "n", F.lit("]{" + ",".join(columns) + "}:\n"))
    more = F.when(F.col("n") > most, F.concat(F.lit("\n  ... +"), F.col("n") - most, F.lit(" more"))).otherwise("")
    return rows.select(key, F.concat(head, F.array_join(F.transform("x", lambda v: v["t"]), "\n"), more).alias("toon"))


def json_signature(schema: Column) -> Column:
    """A JSON Schema's properties as ``name:type``, optional ones with a question mark; strings need no type. Null for a text that is no such schema."""
    short = {"string": "str", "boolean": "bool", "number": "num", "integer": "num", "array": "arr", "object": "obj"}
    parsed = F.from_json(schema, "properties map<string, struct<type: string, enum: array<string>, properties: map<string, string>>>, required array<string>")
    table = F.create_map(*[F.lit(x) for kv in short.items() for x in kv])

    def kind(p: Column) -> Column:
        values = F.when(F.size(p["enum"]) <= 4, F.array_join(p["enum"], "|")).otherwise(F.concat(F.array_join(F.slice(p["enum"], 1, 3), "|"), F.lit("|...")))
        keys = F.map_keys(p["properties"])
        nested = F.when(F.size(keys) <= 3, F.concat(F.lit("{"), F.array_join(keys, ","), F.lit("}"))).otherwise(F.concat(F.lit("{"), F.array_join(F.slice(keys, 1, 2), ","), F.lit(",...}")))
        return F.when(p["enum"].isNotNull(), values).when(p["properties"].isNotNull(), nested).otherwise(F.coalesce(F.try_element_at(table, p["type"]), F.lit("any")))

    def one(e: Column) -> Column:
        optional = F.when(F.array_contains(F.coalesce(parsed["required"], F.array().cast("array<string>")), e["key"]), "").otherwise("?")
        k = kind(e["value"])
        return F.concat(e["key"], optional, F.when(k == "str", "").otherwise(F.concat(F.lit(":"), k)))

    return F.when(parsed["properties"].isNotNull(), F.array_join(F.transform(F.map_entries(parsed["properties"]), one), " "))


def schema_signature(schema: S.StructType) -> str:
    """The same notation for a DataFrame's columns; nullable ones are optional."""
    kinds = {S.StringType: "", S.BooleanType: ":bool", S.ArrayType: ":arr", S.MapType: ":obj", S.StructType: ":obj"}

    def one(f: S.StructField) -> str:
        number = isinstance(f.dataType, S.NumericType)
        return f.name + "?" * f.nullable + (":num" if number else kinds.get(type(f.dataType), ":any"))

    return " ".join(map(one, schema.fields))
