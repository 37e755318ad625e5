"""Conversations: summaries, key points, decisions, code references, compression by three strategies, and memories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators.memory import MemoryTable
from . import duck as D
from . import inputs as I
from .registry import query

# Oracles. Each piece reads the CTE ``convo`` (conv_id, turn, role, text).
_ROLL = f"""h AS (SELECT conv_id, turn, role, text, substring(coalesce(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0)[1], ''), 1, 150) AS head FROM convo),
  topics AS (SELECT conv_id, string_agg(head, '; ' ORDER BY turn) AS s FROM (SELECT * FROM h WHERE role = 'user' AND length(head) > 10 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3) GROUP BY 1),
  actions AS (SELECT conv_id, string_agg(head, '; ' ORDER BY turn) AS s FROM (SELECT * FROM h WHERE role = 'assistant' AND {D.any_of('head', R.ACTION_START)} QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3) GROUP BY 1),
  named AS (SELECT conv_id, turn, unnest(fs) AS f, generate_subscripts(fs, 1) AS k FROM (SELECT conv_id, turn, regexp_extract_all(text, {D.q(R.FILE_NAME)})[:5] AS fs FROM convo)),
  files AS (SELECT conv_id, string_agg(f, ', ' ORDER BY place) AS s FROM (SELECT conv_id, f, min((turn, k)) AS place FROM named GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY min((turn, k))) <= 5) GROUP BY 1),
  parts AS (SELECT c.conv_id, concat_ws('. ', 'User discussed: ' || t.s, 'Assistant: ' || a.s, 'Files mentioned: ' || f.s) AS s FROM (SELECT DISTINCT conv_id FROM convo) c LEFT JOIN topics t USING (conv_id) LEFT JOIN actions a USING (conv_id) LEFT JOIN files f USING (conv_id)),
  summary AS (SELECT conv_id, CASE WHEN s = '' THEN 'Previous conversation context.' ELSE s END AS summary FROM parts)"""
_LINES = "cl AS (SELECT conv_id, turn, role, generate_subscripts(string_split(text, chr(10)), 1) AS k, trim(unnest(string_split(text, chr(10)))) AS t FROM convo)"
_POINTS = f"""p AS (SELECT conv_id, turn, k, regexp_replace(regexp_replace(regexp_replace(t, '^\\s*[-*]\\s*', ''), '^\\d+\\.\\s*', ''), '\\*\\*', '', 'g') AS point FROM cl WHERE length(t) BETWEEN 10 AND 300 AND {D.any_of('t', R.KEY_POINT)}),
  points AS (SELECT conv_id, point, row_number() OVER (PARTITION BY conv_id ORDER BY min((turn, k))) AS r FROM p WHERE length(point) > 10 AND length(point) < 200 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY min((turn, k))) <= 15)"""
_DECIDED = " UNION ALL ".join(f"SELECT conv_id, turn, k, {i} AS o, trim(regexp_extract(t, {D.q(p)}, 1)) AS decision FROM cl WHERE role <> 'system' AND length(t) BETWEEN 15 AND 300 AND regexp_matches(t, {D.q(p)})" for i, p in enumerate(R.DECISION))
_DECISIONS = f"d AS ({_DECIDED}), decisions AS (SELECT conv_id, decision, min((turn, k, o)) AS place FROM d GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY min((turn, k, o)) DESC) <= 20)"
_ACTION = "CASE " + " ".join(f"WHEN regexp_matches(around, {D.q('(?i)' + p)}) THEN '{a}'" for a, p in R.FILE_ACTIONS) + " ELSE 'discussed' END"
_REFS = f"""rn AS (SELECT conv_id, turn, text, unnest(list_distinct(regexp_extract_all(text, {D.q(R.FILE_REFERENCE)}))) AS file FROM convo),
  rp AS (SELECT conv_id, turn, file, strpos(text, file) AS spot, lower(substring(text, greatest(strpos(text, file) - 50, 1), strpos(text, file) - greatest(strpos(text, file) - 50, 1) + length(file) + 50)) AS around FROM rn),
  refs AS (SELECT conv_id, file, arg_min({_ACTION}, (turn, spot)) AS action, min(turn) AS turn, min((turn, spot)) AS place FROM rp GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY min((turn, spot))) <= 30)"""


def _first(df, most: int, sep: str, name: str):
    """The first ``most`` texts of each conversation, joined."""
    r = F.row_number().over(Window.partitionBy("conv_id").orderBy("at"))
    few = df.withColumn("r", r).where(F.col("r") <= most).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("r", "s"))).alias("x"))
    return few.select("conv_id", F.array_join(F.transform("x", lambda v: v["s"]), sep).alias(name))


def summaries(convo):
    """(conv_id, summary): first topics of the user, first actions of the assistant, first files named."""
    head = F.substring(F.coalesce(F.try_element_at(F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0), F.lit(1)), F.lit("")), 1, 150)
    h = convo.select("conv_id", F.struct(F.col("turn"), F.lit(0).alias("k")).alias("at"), "role", head.alias("s"))
    topics = _first(h.where((F.col("role") == "user") & (F.length("s") > 10)), 3, "; ", "topics")
    actions = _first(h.where((F.col("role") == "assistant") & T.any_of(F.col("s"), R.ACTION_START)), 3, "; ", "actions")
    named = convo.select("conv_id", "turn", F.posexplode(F.slice(F.regexp_extract_all("text", F.lit(T.java(R.FILE_NAME)), F.lit(0)), 1, 5)).alias("k", "s"))
    files = _first(named.groupBy("conv_id", "s").agg(F.min(F.struct("turn", "k")).alias("at")), 5, ", ", "files")
    x = convo.select("conv_id").distinct().join(topics, "conv_id", "left").join(actions, "conv_id", "left").join(files, "conv_id", "left")
    s = F.concat_ws(". ", F.concat(F.lit("User discussed: "), "topics"), F.concat(F.lit("Assistant: "), "actions"), F.concat(F.lit("Files mentioned: "), "files"))
    return x.select("conv_id", F.when(s == "", "Previous conversation context.").otherwise(s).alias("summary"))


@query("rolling_summary", f"WITH {D.CONVO}, {_ROLL} SELECT * FROM summary")
def rolling_summary(spark, sf_dir):
    return summaries(I.convo(spark, sf_dir))


def lines(convo):
    x = convo.select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("k", "t"))
    return x.withColumn("t", F.trim("t"))


def points(convo):
    """(conv_id, point, r): the first 15 distinct lines that tell something, cleaned of marks, in order."""
    t = F.col("t")
    x = lines(convo).where((F.length(t) >= 10) & (F.length(t) <= 300) & T.any_of(t, R.KEY_POINT))
    point = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"^\s*[-*]\s*", ""), r"^\d+\.\s*", ""), r"\*\*", "")
    x = x.select("conv_id", "turn", "k", point.alias("point")).where("length(point) > 10 and length(point) < 200")
    first = x.groupBy("conv_id", "point").agg(F.min(F.struct("turn", "k")).alias("at"))
    return first.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy("at"))).where("r <= 15").select("conv_id", "point", "r")


@query("key_points", f"WITH {D.CONVO}, {_LINES}, {_POINTS} SELECT conv_id, point FROM points")
def key_points(spark, sf_dir):
    return points(I.convo(spark, sf_dir)).drop("r")


def decided(convo):
    """(conv_id, decision, at): the last 20 distinct decisions told by anyone but the system, each where it is first told."""
    t = F.col("t")
    x = lines(convo).where((F.col("role") != "system") & (F.length(t) >= 15) & (F.length(t) <= 300))
    found = F.array(*[F.struct(F.lit(i).alias("o"), F.when(t.rlike(T.java(p)), F.trim(F.regexp_extract(t, T.java(p), 1))).alias("decision")) for i, p in enumerate(R.DECISION)])
    x = x.select("conv_id", "turn", "k", F.explode(found).alias("f")).where("f.decision is not null").select("conv_id", "turn", "k", "f.o", "f.decision")
    first = x.groupBy("conv_id", "decision").agg(F.min(F.struct("turn", "k", "o")).alias("at"))
    return first.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("at")))).where("r <= 20").drop("r")


@query("decisions", f"WITH {D.CONVO}, {_LINES}, {_DECISIONS} SELECT conv_id, decision FROM decisions")
def decisions(spark, sf_dir):
    return decided(I.convo(spark, sf_dir)).drop("at")


def references(convo):
    """(conv_id, file, action, turn, at): each file where it is first named, and what the 50 characters around say is done to it; the first 30 of a conversation."""
    named = convo.select("conv_id", "turn", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(T.java(R.FILE_REFERENCE)), F.lit(0)))).alias("file"))
    # the first place where the name doesn't go on to the left
    place = F.regexp_instr("text", F.concat(F.lit(r"(?<![a-zA-Z0-9_\-./])\Q"), "file", F.lit(r"\E")))
    named = named.withColumn("place", place)
    begin = F.greatest(F.col("place") - 50, F.lit(1))
    around = F.lower(F.substring("text", begin, F.col("place") - begin + F.length("file") + 50))
    action = F.lit("discussed")
    for name, pattern in reversed(R.FILE_ACTIONS):
        action = F.when(around.rlike("(?i)" + T.java(pattern)), name).otherwise(action)
    first = named.select("conv_id", "file", F.struct("turn", "place", action.alias("action")).alias("at")).groupBy("conv_id", "file").agg(F.min("at").alias("at"))
    r = F.row_number().over(Window.partitionBy("conv_id").orderBy("at.turn", "at.place"))
    return first.withColumn("r", r).where("r <= 30").select("conv_id", "file", "at.action", "at.turn", "at")


@query("code_refs", f"WITH {D.CONVO}, {_REFS} SELECT conv_id, file, action, turn FROM refs")
def code_refs(spark, sf_dir):
    return references(I.convo(spark, sf_dir)).drop("at")


# Compression.

STRATEGIES = ("rolling-summary", "key-extraction", "hybrid")
#: The messages at the end that are kept as they are.
LAST = 2


def context(convo, strategy: str):
    """(conv_id, text): what stands for the messages of ``convo``."""
    told = points(convo).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "point"))), lambda x: F.concat(F.lit("- "), x["point"])).alias("points"))
    x = summaries(convo).join(told, "conv_id", "left") if strategy != "rolling-summary" else summaries(convo).withColumn("points", F.lit(None).cast("array<string>"))
    head = {k: F.lit(v) for k, v in R.CONTEXT_HEADS.items()}
    some = F.size(F.coalesce("points", F.array().cast("array<string>"))) > 0
    text = {
        "rolling-summary": F.concat(head["summary"], "summary"),
        "key-extraction": F.when(some, F.concat(head["points"], F.array_join("points", "\n"))).otherwise(F.concat(head["fallback"], "summary")),
        "hybrid": F.concat(head["hybrid"], "summary", F.when(some, F.concat(head["hybrid_points"], F.array_join(F.slice("points", 1, 7), "\n"))).otherwise("")),
    }
    return x.select("conv_id", text[strategy].alias("text"))


def compressed(convo, strategy: str, last: int = LAST):
    """(conv_id, part, turn, role, text): system messages (part 0), one message that stands for the older others (1, turn -1), and the ``last`` messages (2).

    A conversation without older messages stays whole, as part 2. A system message among the last ones comes in both parts.
    """
    x = convo.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))))
    old = x.where((F.col("back") > last) & (F.col("role") != "system")).select("conv_id", "turn", "role", "text")
    x = x.join(old.select("conv_id", F.lit(True).alias("cut")).distinct(), "conv_id", "left")
    row = lambda df, part: df.select("conv_id", F.lit(part).alias("part"), "turn", "role", "text")
    made = context(old, strategy).select("conv_id", F.lit(-1).cast(convo.schema["turn"].dataType).alias("turn"), F.lit("system").alias("role"), "text")
    return row(x.where("cut and role = 'system'"), 0).unionByName(row(made, 1)).unionByName(row(x.where(F.col("cut").isNull() | (F.col("back") <= last)), 2))


_HEAD = {k: D.q(v).replace("\n", "' || chr(10) || '") for k, v in R.CONTEXT_HEADS.items()}
_CONTEXT = f"""told AS (SELECT conv_id, string_agg('- ' || point, chr(10) ORDER BY r) AS all_points, string_agg('- ' || point, chr(10) ORDER BY r) FILTER (r <= 7) AS few FROM points GROUP BY 1),
  ctx AS (SELECT conv_id, 'rolling-summary' AS strategy, {_HEAD['summary']} || summary AS text FROM summary
    UNION ALL SELECT conv_id, 'key-extraction', CASE WHEN all_points IS NULL THEN {_HEAD['fallback']} || summary ELSE {_HEAD['points']} || all_points END FROM summary LEFT JOIN told USING (conv_id)
    UNION ALL SELECT conv_id, 'hybrid', {_HEAD['hybrid']} || summary || CASE WHEN few IS NULL THEN '' ELSE {_HEAD['hybrid_points']} || few END FROM summary LEFT JOIN told USING (conv_id))"""
_CUT = f"""{D.CONVO.replace('convo AS (', 'said AS (', 1)}, ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM said), convo AS (SELECT conv_id, turn, role, text FROM ranked WHERE back > {LAST} AND role <> 'system'),
  {_ROLL}, {_LINES}, {_POINTS}, {_CONTEXT}, strategies AS (SELECT unnest({list(STRATEGIES)}) AS strategy),
  cut AS (SELECT DISTINCT conv_id FROM convo), whole AS (SELECT r.*, c.conv_id IS NOT NULL AS is_cut FROM ranked r LEFT JOIN cut c USING (conv_id)),
  compressed AS (SELECT conv_id, strategy, 0 AS part, turn, role, text FROM whole, strategies WHERE is_cut AND role = 'system' UNION ALL SELECT conv_id, strategy, 1, -1, 'system', text FROM ctx
    UNION ALL SELECT conv_id, strategy, 2, turn, role, text FROM whole, strategies WHERE NOT is_cut OR back <= {LAST})"""


@query("compress_conversation", f"WITH {_CUT} SELECT * FROM compressed")
def compress_conversation(spark, sf_dir):
    """Each conversation by each of the three strategies."""
    out = None
    for s in STRATEGIES:
        part = compressed(I.convo(spark, sf_dir), s).withColumn("strategy", F.lit(s))
        out = part if out is None else out.unionByName(part)
    return out


@query("conversation_savings", f"WITH {_CUT}, o AS (SELECT conv_id, sum({D.tokens('text')}) AS original FROM said GROUP BY 1), c AS (SELECT conv_id, strategy, sum({D.tokens('text')}) AS compressed FROM compressed GROUP BY 1, 2) SELECT conv_id, strategy, CAST(original AS BIGINT) AS original_tokens, CAST(compressed AS BIGINT) AS compressed_tokens, CAST(greatest(0, floor((1 - compressed / CAST(original AS DOUBLE)) * 100 + 0.5)) AS BIGINT) AS savings FROM o JOIN c USING (conv_id)")
def conversation_savings(spark, sf_dir):
    """Tokens of each conversation before and after compression, and the percentage saved."""
    tokens = lambda df, *keys: df.groupBy("conv_id", *keys).agg(F.sum(T.token_count(F.col("text"))).alias("n"))
    both = tokens(compress_conversation(spark, sf_dir), "strategy").withColumnRenamed("n", "compressed_tokens").join(tokens(I.convo(spark, sf_dir)).withColumnRenamed("n", "original_tokens"), "conv_id")
    saved = F.greatest(T.js_round((1 - F.col("compressed_tokens") / F.col("original_tokens")) * 100), F.lit(0))
    return both.select("conv_id", "strategy", "original_tokens", "compressed_tokens", saved.alias("savings"))


# Memories: a row for each conversation.


def _ordered(df, value, at: str, name: str):
    return df.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(at, value.alias("v")))), lambda x: x["v"]).alias(name))


def memories(convo):
    """(conv_id, summary, decisions, refs, history): what is known of each conversation; refs are (file, action), history (role, text) of the hybrid compression."""
    x = convo.select("conv_id").distinct().join(summaries(convo), "conv_id")
    x = x.join(_ordered(decided(convo), F.col("decision"), "at", "decisions"), "conv_id", "left")
    x = x.join(_ordered(references(convo), F.struct("file", "action"), "at", "refs"), "conv_id", "left")
    return x.join(_ordered(compressed(convo, "hybrid").withColumn("at", F.struct("part", "turn")), F.struct("role", "text"), "at", "history"), "conv_id", "left")


def restored(memory, recent: int = 3, with_summary: bool = True, with_decisions: bool = True, with_refs: bool = True):
    """(conv_id, context): a text that brings each remembered conversation back: summary, last 10 decisions, files by what is done to them, last messages."""
    bullets = F.array_join(F.transform(F.slice("decisions", F.greatest(F.size("decisions") - 9, F.lit(1)), 10), lambda d: F.concat(F.lit("- "), d)), "\n")
    kinds = F.array_distinct(F.transform("refs", lambda r: r["action"]))
    by_kind = F.transform(kinds, lambda a: F.concat(a, F.lit(": "), F.array_join(F.slice(F.transform(F.filter("refs", lambda r: r["action"] == a), lambda r: r["file"]), 1, 10), ", ")))
    said = F.transform(F.slice("history", F.greatest(F.size("history") - (recent - 1), F.lit(1)), max(recent, 1)), lambda m: F.concat(m["role"], F.lit(": "), F.substring(m["text"], 1, 200), F.when(F.length(m["text"]) > 200, "...").otherwise("")))
    has = lambda c: F.size(F.coalesce(c, F.array())) > 0
    parts = []
    if with_summary:
        parts.append(F.concat(F.lit("[Previous Context]\n"), "summary", F.lit("\n")))
    if with_decisions:
        parts.append(F.when(F.size("decisions") > 0, F.concat(F.lit("[Key Decisions]\n"), bullets, F.lit("\n"))))
    if with_refs:
        parts.append(F.when(F.size("refs") > 0, F.concat(F.lit("[Code References]\n"), F.array_join(by_kind, "\n"), F.lit("\n"))))
    if recent > 0:
        parts.append(F.when(F.size("history") > 0, F.concat(F.lit("[Recent Messages]\n"), F.array_join(said, "\n"))))
    return memory.select("conv_id", F.concat_ws("\n", *parts).alias("context"))


_MEMORY = f"""{D.CONVO}, {_ROLL}, {_LINES}, {_DECISIONS}, {_REFS}"""
_RESTORED = f"""{_MEMORY}, dd AS (SELECT conv_id, count(*) AS n, string_agg('- ' || decision, chr(10) ORDER BY place) FILTER (r <= 10) AS s FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY place DESC) AS r FROM decisions) GROUP BY 1),
  ra AS (SELECT conv_id, action, min(place) AS place, string_agg(file, ', ' ORDER BY place) FILTER (r <= 10) AS s FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, action ORDER BY place) AS r FROM refs) GROUP BY 1, 2),
  rr AS (SELECT conv_id, string_agg(action || ': ' || s, chr(10) ORDER BY place) AS s FROM ra GROUP BY 1), rc AS (SELECT conv_id, count(*) AS n FROM refs GROUP BY 1)"""


@query("conversation_memory", f"WITH {_RESTORED} SELECT s.conv_id, summary, coalesce(dd.n, 0) AS n_decisions, coalesce(rc.n, 0) AS n_refs, concat_ws(chr(10), '[Previous Context]' || chr(10) || summary || chr(10), '[Key Decisions]' || chr(10) || dd.s || chr(10), '[Code References]' || chr(10) || rr.s || chr(10)) AS context FROM summary s LEFT JOIN dd USING (conv_id) LEFT JOIN rr USING (conv_id) LEFT JOIN rc USING (conv_id)")
def conversation_memory(spark, sf_dir):
    """Each conversation's memory and the context restored from it, without the last messages."""
    memory = memories(I.convo(spark, sf_dir))
    x = memory.join(restored(memory, recent=0), "conv_id")
    n = lambda c: F.coalesce(F.when(F.size(c) >= 0, F.size(c)), F.lit(0)).cast("long")
    return x.select("conv_id", "summary", n("decisions").alias("n_decisions"), n("refs").alias("n_refs"), "context")


@query("memory_recent", f"WITH {_CUT}, hist AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY part DESC, turn DESC) AS r FROM compressed WHERE strategy = 'hybrid') SELECT conv_id, '[Recent Messages]' || chr(10) || string_agg(role || ': ' || substring(text, 1, 200) || CASE WHEN length(text) > 200 THEN '...' ELSE '' END, chr(10) ORDER BY r DESC) AS context FROM hist WHERE r <= 3 GROUP BY 1")
def memory_recent(spark, sf_dir):
    """The last three messages of each conversation's compressed history."""
    return restored(memories(I.convo(spark, sf_dir)), 3, False, False, False)


@query("memory_actions", f"WITH {D.CONVO}, {_ROLL}, a AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'replaced' ELSE summary END AS summary FROM summary WHERE conv_id % 4 <> 0) SELECT c.conv_id, a.conv_id IS NOT NULL AS known, a.summary FROM (SELECT DISTINCT conv_id FROM convo) c LEFT JOIN a USING (conv_id)")
def memory_actions(spark, sf_dir):
    """Memories set, some set again, some cleared; then which conversations are known, and their summaries."""
    table, convo = MemoryTable(spark, "conv_id"), I.convo(spark, sf_dir)
    held = table.set(summaries(convo))
    table.set(held.where("conv_id % 3 = 0").select("conv_id", F.lit("replaced").alias("summary")))
    left = table.clear(held.where("conv_id % 4 = 0").select("conv_id"))
    return table.has(convo.select("conv_id").distinct()).join(left, "conv_id", "left")
