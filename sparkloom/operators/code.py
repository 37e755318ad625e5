"""Structure of source files: the standard library's parser for Python, a scanner over blanked text for other languages.

The scanner first blanks comments and the insides of strings, keeping every place, so that braces and keywords found in what is left are real. A
declaration is found by its head; its body is the matching pair of braces after it, its parent the nearest declaration around it.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, bucket string, name string, parent string, start_line int, end_line int, exported boolean, detail string, doc string"
#: Longest detail of a type and of a variable, in characters.
TYPE_CHARS, VALUE_CHARS = 200, 100
#: Characters of a piece of a long Python file, and rows of a batch of elements: a whole file's tree takes many times its text.
PIECE_CHARS, BATCH_ROWS = 65_536, 10_000


class Element(NamedTuple):
    """``detail``: the signature of a function or class, the source of an import, the value of a type or variable. ``doc``: the comment before it or docstring."""

    bucket: str
    name: str
    parent: str | None
    start: int
    end: int
    exported: bool
    detail: str = ""
    doc: str = ""


_STRING = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
_C = r"//[^\n]*|/\*.*?\*/"
# What is blanked in each language: comments, and strings in one of the groups.
BLANKED = {
    "typescript": rf"{_C}|{_STRING}|`(?:\\.|[^`\\])*`",
    "go": rf"{_C}|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'|`[^`]*`",
    "rust": rf"{_C}|\"(?:\\.|[^\"\\])*\"|'(?:\\[^\n']+|[^'\\\n])'",
    "php": rf"{_C}|#(?!\[)[^\n]*|{_STRING}",
    "swift": rf"{_C}|\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"",
}
# Heads of declarations: bucket and pattern, tried in this order at the beginning of a line. Group "name" is the name; "mark" the mark of an
# exported element, where the language has one. "member" patterns count only right inside a class or interface, "top" ones only outside of any block.
_TS_MOD = r"(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set)\s+)*"
HEADS = {
    "typescript": [
        ("functions", "", r"(?P<mark>export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]+)"),
        ("functions", "top", r"(?P<mark>export\s+)?const\s+(?P<name>[\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:<[^>\n]*>\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=\n]+)?=>"),
        ("classes", "", r"(?P<mark>export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>[\w$]+)"),
        ("interfaces", "", r"(?P<mark>export\s+)?(?:declare\s+)?interface\s+(?P<name>[\w$]+)"),
        ("types", "", r"(?P<mark>export\s+)?(?:declare\s+)?type\s+(?P<name>[\w$]+)\s*(?:<[^=\n]*>)?\s*="),
        ("enums", "", r"(?P<mark>export\s+)?(?:const\s+)?enum\s+(?P<name>[\w$]+)"),
        ("variables", "top", r"(?P<mark>export\s+)?(?:const|let|var)\s+(?P<name>[\w$]+)"),
        ("functions", "member", rf"{_TS_MOD}(?!(?:if|for|while|switch|catch|return)\b)(?P<name>[\w$#]+)\s*(?:<[^>\n]*>)?\([^)\n]*\)\s*(?::[^{{;\n]+)?\{{"),
        ("imports", "top", r"import\s+(?P<name>[^\"'\n;]*?)\s*(?:from\s*)?(?=[\"'])"),
        ("exports", "top", r"(?P<mark>export)\s+(?P<name>\{[^}]*\}|default\b)"),
    ],
    "go": [
        ("functions", "top", r"func\s+(?:\(\s*\w*\s*\*?(?P<parent>\w+)[^)]*\)\s*)?(?P<name>\w+)\s*[(\[]"),
        ("classes", "top", r"type\s+(?P<name>\w+)\s*(?:\[[^\]\n]*\])?\s*struct\b"),
        ("types", "top", r"type\s+(?P<name>\w+)\s*(?:\[[^\]\n]*\])?\s*interface\s*\{[^}]*[~|][^}]*\}"),
        ("interfaces", "top", r"type\s+(?P<name>\w+)\s*(?:\[[^\]\n]*\])?\s*interface\b"),
        ("types", "top", r"type\s+(?P<name>\w+)\b"),
        ("variables", "top", r"(?:var|const)\s+(?P<name>\w+)"),
        ("imports", "top", r"import\s+(?P<name>[\w.]*)\s*(?=\")"),
    ],
    "rust": [
        ("functions", "", r"(?P<mark>pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern)\s+(?:\"[^\"]*\"\s+)?)*fn\s+(?P<name>\w+)"),
        ("functions", "", r"macro_rules!\s*(?P<name>\w+)"),
        ("classes", "", r"(?P<mark>pub(?:\([^)]*\))?\s+)?(?:struct|enum|mod)\s+(?P<name>\w+)"),
        ("interfaces", "", r"(?P<mark>pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(?P<name>\w+)"),
        ("interfaces", "", r"(?P<name>impl(?:<[^>\n]*>)?\s+[\w:<>, ]+\s+for\s+[\w:<>]+)"),
        ("blocks", "", r"impl(?:<[^>\n]*>)?\s+(?P<name>\w+)"),
        ("types", "", r"(?P<mark>pub(?:\([^)]*\))?\s+)?type\s+(?P<name>\w+)"),
        ("variables", "", r"(?P<mark>pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?(?P<name>\w+)\s*:"),
        ("imports", "", r"(?:pub\s+)?(?:use|extern\s+crate)\s+(?P<name>[^;]+?)\s*;"),
    ],
    "php": [
        ("functions", "", r"(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?(?P<name>\w+)"),
        ("classes", "", r"(?:(?:final|abstract|readonly)\s+)*(?:class|trait)\s+(?P<name>\w+)"),
        ("interfaces", "", r"interface\s+(?P<name>\w+)"),
        ("types", "", r"enum\s+(?P<name>\w+)"),
        ("variables", "", r"(?:(?:public|private|protected|final)\s+)*const\s+(?:\w+\s+)?(?P<name>\w+)\s*="),
        ("variables", "member", r"case\s+(?P<name>\w+)\s*(?:=[^;\n]*)?;"),
        ("variables", "member", r"(?:(?:public|private|protected|static|readonly|var)\s+)+(?:\??[\w\\|]+\s+)?\$(?P<name>\w+)"),
        ("imports", "top", r"use\s+(?P<name>[\w\\]+)"),
    ],
    "swift": [
        ("functions", "", r"(?:@\w+\s+)*(?P<mark>(?:public|open)\s+)?(?:(?:static|class|override|private|internal|fileprivate|mutating|final)\s+)*func\s+(?P<name>[\w+\-*/=<>!]+)"),
        ("functions", "", r"(?P<mark>(?:public|open)\s+)?(?:(?:convenience|required|override|private|internal)\s+)*(?P<name>init|deinit|subscript)\b"),
        ("functions", "", r"(?P<mark>public\s+)?macro\s+(?P<name>\w+)"),
        ("classes", "", r"(?P<mark>(?:public|open)\s+)?(?:(?:final|private|internal)\s+)*(?:class|struct|actor)\s+(?P<name>\w+)"),
        ("interfaces", "", r"(?P<mark>public\s+)?protocol\s+(?P<name>\w+)"),
        ("types", "", r"(?P<mark>public\s+)?(?:indirect\s+)?(?:enum|extension|typealias|associatedtype|precedencegroup)\s+(?P<name>\w+)"),
        ("types", "", r"(?:prefix|infix|postfix)\s+operator\s+(?P<name>\S+)"),
        ("variables", "", r"(?P<mark>public\s+)?(?:(?:private|internal|static|lazy|weak|fileprivate)\s+)*(?:let|var)\s+(?P<name>\w+)"),
        ("imports", "top", r"import[ \t]+(?:\w+[ \t]+)?(?P<name>[\w.]+)"),
    ],
}
for _table in (BLANKED, HEADS):
    _table["javascript"] = _table["typescript"]
#: Buckets whose elements hold others, and those whose body decides where they end.
HOLDERS = ("classes", "interfaces", "blocks", "types", "enums")
BODIED = ("functions", "classes", "interfaces", "enums", "blocks", "types")


def python_elements(content: str) -> Iterator[Element]:
    """Elements of a Python file; nothing for one that doesn't parse. A function inside another counts as a method of the nearest class, if any."""
    try:
        pieces = _pieces(content)
        for _, piece in pieces[1:] and pieces:  # a file has its elements only if all of it parses
            ast.parse(piece)
    except (SyntaxError, ValueError, RecursionError):
        pieces = [(0, content)]  # parted inside of a statement, or wrong
    for before, piece in pieces:
        try:
            tree = ast.parse(piece)
        except (SyntaxError, ValueError, RecursionError):
            return
        for e in _walked(tree):
            yield e._replace(start=e.start + before, end=e.end + before) if before else e


def _pieces(content: str) -> list[tuple[int, str]]:
    """(lines before, text): a long file parted before statements at the left edge, about PIECE_CHARS each. Pieces that all parse hold what the whole file holds."""
    cuts, out, before = [0], [], 0
    if len(content) > 2 * PIECE_CHARS:
        for m in re.finditer(r"(?<=\n)(?:import|from|def|class|async|@\w+)\b", content):
            if m.start() - cuts[-1] >= PIECE_CHARS and content[content.rfind("\n", 0, m.start() - 1) + 1] != "@":  # a decorator stays with what it decorates
                cuts.append(m.start())
    for a, z in zip(cuts, [*cuts[1:], len(content)], strict=True):
        out.append((before, content[a:z]))
        before += len(re.findall(r"\r\n?|\n", content[a:z]))
    return out


def _walked(tree: ast.AST) -> Iterator[Element]:
    """Elements of a parsed file."""

    def signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
        returns = f" -> {ast.unparse(node.returns)}" if node.returns else ""
        return f"{'async ' * isinstance(node, ast.AsyncFunctionDef)}def {node.name}({ast.unparse(node.args)}){returns}"

    def walk(node: ast.AST, parent: str | None, inside: bool) -> Iterator[Element]:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.Import | ast.ImportFrom):
                source = "." * child.level + (child.module or "") if isinstance(child, ast.ImportFrom) else None
                yield from (Element("imports", a.asname or a.name, None, child.lineno, child.end_lineno, False, source or a.name) for a in child.names)
            elif isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                yield Element("functions", child.name, parent, child.lineno, child.end_lineno, not child.name.startswith("_"), signature(child), ast.get_docstring(child) or "")
                yield from walk(child, parent, True)
            elif isinstance(child, ast.ClassDef):
                bases = ", ".join(map(ast.unparse, child.bases))
                yield Element("classes", child.name, parent, child.lineno, child.end_lineno, not child.name.startswith("_"), f"class {child.name}" + (f"({bases})" if bases else ""), ast.get_docstring(child) or "")
                yield from walk(child, child.name, True)
            elif isinstance(child, ast.TypeAlias):
                yield Element("types", child.name.id, None, child.lineno, child.end_lineno, not child.name.id.startswith("_"), ast.unparse(child.value)[:TYPE_CHARS])
            elif isinstance(child, ast.Assign | ast.AnnAssign) and not inside:
                targets = child.targets if isinstance(child, ast.Assign) else [child.target]
                value = ast.unparse(child.value)[:VALUE_CHARS] if child.value else ""
                yield from (Element("variables", t.id, None, child.lineno, child.end_lineno, not t.id.startswith("_"), value) for t in targets if isinstance(t, ast.Name))
            elif not isinstance(child, ast.expr):
                yield from walk(child, parent, inside)

    yield from walk(tree, None, False)


def blank(content: str, language: str) -> str:
    """``content`` with comments, and the insides of strings, as blanks; line feeds stay."""

    def void(m: re.Match) -> str:
        text = m[0]
        if text[0] in "\"'`":
            return text[0] + re.sub(r"[^\n]", " ", text[1:-1]) + text[-1]
        return re.sub(r"[^\n]", " ", text)

    return re.sub(BLANKED[language], void, content, flags=re.S)


def _pairs(text: str) -> tuple[dict[int, int], list[int]]:
    """(place of each opening brace: that of its closing one or the end, depth before each line)."""
    close, open_, depths = {}, [], [0]
    for m in re.finditer(r"[{}\n]", text):
        if m[0] == "{":
            open_.append(m.start())
        elif m[0] == "\n":
            depths.append(len(open_))
        elif open_:
            close[open_.pop()] = m.start()
    return close | dict.fromkeys(open_, len(text) - 1), depths


def _doc(lines: list[str], at: int) -> str:
    """The comment lines right before line ``at`` (from 0), without their marks."""
    k = at
    while k and re.match(r"\s*(//|/\*|\*|#(?!\[))", lines[k - 1]):
        k -= 1
    return "\n".join(x for x in (re.sub(r"^\s*(/{2,}!?|/\*+|\*+/|\*+|#)\s?|\s*\*+/\s*$", "", line).strip() for line in lines[k:at]) if x)


def _imported(language: str, name: str, source: str) -> list[tuple[str, str]]:
    """(name, source) for each name that an import brings in."""
    if language in ("typescript", "javascript"):
        names = re.sub(r"^type\s+|[{}]", " ", name).replace("* as", "").split(",")
        kept = [re.split(r"\s+as\s+", n.strip())[-1].removeprefix("type ").strip() for n in names]
        return [(n, source) for n in kept if n] or [(source, source)]
    if language == "go":
        return [(name or source.rsplit("/", 1)[-1], source)]
    if language == "swift":
        return [(name.rsplit(".", 1)[-1], name)]
    stem, _, group = name.partition("{")  # Rust: a::{b, c as d}
    each = [stem + n.strip() for n in group.rstrip("}").split(",")] if group else [name]
    return [(re.split(r"\\|::|\s+as\s+", n)[-1], n) for n in each]


def scanned_elements(content: str, language: str) -> Iterator[Element]:
    """Elements of a file of one of the languages in HEADS. The first head that fits a line decides."""
    text, lines = blank(content, language), content.split("\n")
    close, depths = _pairs(text)
    heads = [(bucket, where, re.compile(r"[ \t]*" + p)) for bucket, where, p in HEADS[language]]
    feeds = [m.start() for m in re.finditer("\n", text)]
    around: list[tuple[str, str, int, int]] = []  # bucket, name, depth inside, end
    listed: re.Match | None = None
    begin = 0
    for k, size in enumerate(map(len, text.split("\n"))):
        here, begin = begin, begin + size + 1
        around = [a for a in around if a[3] >= here]
        if language == "go":  # import ( ... ) and the like: a line each
            if listed and (m := re.match(r"\s*([\w.]*)\s*\"", text[here:])) and listed[1] == "import":
                source = re.search(r"\"([^\"]*)\"", content[here:])[1]
                yield Element("imports", _imported("go", m[1], source)[0][0], None, k + 1, k + 1, False, source)
            elif listed and listed[1] != "import" and (m := re.match(r"\s*(\w+)\b", text[here:here + size])):
                yield Element("variables", m[1], None, k + 1, k + 1, m[1][:1].isupper(), lines[k].partition("=")[2].strip()[:VALUE_CHARS])
            listed = re.match(r"(import|var|const)\s*\(", text[here:]) or (None if text[here : here + 1] == ")" else listed)
        for bucket, where, rx in heads:
            m = rx.match(text, here)
            if not m or (where == "top" and depths[k]) or (where == "member" and not (around and around[-1][0] in HOLDERS and around[-1][2] == depths[k])):
                continue
            name, head_end = m["name"].strip(), m.end() - (m[0].endswith("{"))
            if bucket in ("imports", "exports"):
                found = re.search(r"[\"']([^\"'\n]*)[\"']", content[head_end:].split("\n", 1)[0]) if bucket == "imports" else None
                source = found[1] if found else name
                last = bisect_right(feeds, m.end() - 1) + 1
                pairs = _imported(language, name, source) if bucket == "imports" else [(n, n) for n in re.sub(r"[{}]", " ", name).replace(",", " ").split()]
                yield from (Element(bucket, n, None, k + 1, last, bucket == "exports", s) for n, s in pairs)
                break
            script = language in ("typescript", "javascript") and (bucket == "types" or "=>" in m[0])  # their values begin on the same line
            stops = r"[{;\n]" if script else r"[{\n]" if language in ("swift", "go") else r"[{;]"
            brace = re.compile(stops).search(text, head_end)
            bodied = bucket in BODIED and brace is not None and brace[0] == "{"
            end = close[brace.start()] if bodied else (brace.start() if brace and bucket != "variables" else feeds[k] if k < len(feeds) else len(text))
            last = bisect_right(feeds, max(here, end) - 1) + 1
            parent = (m.groupdict().get("parent") if language == "go" else None) or (around[-1][1] if around else None)
            if parent and parent.startswith("impl"):
                parent = parent.rsplit(" for ", 1)[-1]
            if language == "go":
                exported = name[:1].isupper()
            elif language == "php":
                exported = not re.search(r"\b(private|protected)\b", m[0])
            elif name and m[0].lstrip().startswith("macro_rules!"):
                exported = k > 0 and "#[macro_export]" in lines[k - 1]
            else:
                exported = bool(m.groupdict().get("mark"))
            stop = brace.start() if brace else len(text)
            detail = " ".join(content[here:stop].split())
            if bucket == "types" and "=" in detail:
                detail = " ".join(content[here:end].partition("=")[2].split())[:TYPE_CHARS]
            elif bucket == "variables":
                detail = " ".join(lines[k].partition("=")[2].strip().rstrip(";").split())[:VALUE_CHARS]
            if bucket != "blocks":
                yield Element(bucket, name, parent, k + 1, last, exported, detail, _doc(lines, k))
            if bodied:
                around.append((bucket, name, depths[k] + 1, end))
            break


def found(content: str, language: str) -> Iterator[Element]:
    """Elements in the order of their first lines; none for a language without a parser."""
    if language == "python":
        return python_elements(content)
    return scanned_elements(content, language) if language in HEADS else iter(())


def elements(content: str, language: str) -> list[Element]:
    """``found`` as a list."""
    return list(found(content, language))


def parse_code(files: DataFrame, language: str | None = None, path: str = "path", content: str = "content", lang: str = "language") -> DataFrame:
    """A row for each element of each file; ``language`` for all files, or a column that tells it. Unsupported languages and null contents have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = ((p, *e) for p, c, g in zip(pdf["path"], pdf["content"], pdf["language"], strict=True) if c is not None for e in found(c, g))
            while batch := list(islice(rows, BATCH_ROWS)):
                yield pd.DataFrame(batch, columns=["path", "bucket", "name", "parent", "start_line", "end_line", "exported", "detail", "doc"])

    return files.select(F.col(path).alias("path"), F.col(content).alias("content"), (F.lit(language) if language else F.col(lang)).alias("language")).mapInPandas(run, SCHEMA)
