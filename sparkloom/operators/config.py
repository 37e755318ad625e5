"""Summaries of JSON and YAML texts: depth, length and list limits."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels of JSON, and columns of YAML indentation, that each detail keeps.
JSON_DEPTH = {"minimal": 1, "normal": 2, "detailed": 3}
YAML_INDENT = {"minimal": 2, "normal": 4, "detailed": 6}


def brief(value: object, depth: int, most: int) -> object:
    """Strings of over 100 characters cut, lists of over 5 shown by their first 2, anything below ``most`` levels by its size."""
    if isinstance(value, str):
        return value[:97] + "..." if len(value) > 100 else value
    if isinstance(value, list) and value:
        if depth >= most:
            return f"[{len(value)} items]"
        if len(value) > 5:
            return [brief(v, depth + 1, most) for v in value[:2]] + [f"... ({len(value) - 2} more items)"]
        return [brief(v, depth + 1, most) for v in value]
    if isinstance(value, dict) and value:
        return f"{{{len(value)} keys}}" if depth >= most else {k: brief(v, depth + 1, most) for k, v in value.items()}
    return value


def brief_json(content: str, detail: str = "normal") -> str:
    """Indented JSON of the brief value; the text itself if it isn't JSON."""
    try:
        return json.dumps(brief(json.loads(content), 0, JSON_DEPTH[detail]), indent=2, ensure_ascii=False)
    except (ValueError, RecursionError):
        return content


def brief_yaml(content: str, detail: str = "normal") -> str:
    """Lines within the indent; deeper ones are counted and told once they end."""
    most, out, indent, floor, skipped = YAML_INDENT[detail], [], 0, 0, 0
    note = lambda: out.append(" " * (floor // 2 * 2) + f"  ... ({skipped} nested items)")
    for line in content.split("\n"):
        here, blank = len(line) - len(line.lstrip()), not line.strip()
        if skipped:
            if blank or here > floor:
                skipped += 1
                continue
            note()
            skipped = 0
        if here > most and not blank:
            floor, skipped = indent, 1
            continue
        out.append(line)
        indent = here
    if skipped:
        note()
    return "\n".join(out)


def brief_config(content: str, detail: str = "normal") -> str:
    return brief_json(content, detail) if content.strip()[:1] in ("{", "[") else brief_yaml(content, detail)


def column(f, c: Column, detail: str = "normal") -> Column:
    """``f`` over a column of texts; null for null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else f(t, detail))

    return run(c)
