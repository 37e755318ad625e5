"""Replay of cache operations: least recently used entries go first, entries expire, and those of changed files count as missing."""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship

COUNTS = ("hits", "not_found", "expired", "file_changed", "evicted", "invalidated", "tokens_saved")
SCHEMA = "cache long, " + ", ".join(f"{c} long" for c in COUNTS) + ", entries long, bytes long, keys string"
#: Entries, bytes and seconds that a cache keeps.
CAPACITY, BYTES, TTL = 100, 50 * 1024 * 1024, 1800.0


def replay(ops: DataFrame, capacity: int = CAPACITY, ttl: float = TTL, most_bytes: int = BYTES) -> DataFrame:
    """One row of statistics for each cache, with its keys at the end, least recently used first, comma-joined.

    ``ops``: (cache, seq, at, op, key, path, hash, size, tokens) with ``at`` in seconds. op is get, set, invalidate (by key), invalidate_path or clear.
    A set stores the entry's path, hash, size and tokens, after entries have been evicted until both bounds hold. A get misses where the key is not
    found, is older than ``ttl``, or came with another hash than the get tells for its file. Columns but the first five may be missing.

    A cache's operations depend on each other, so they are one task's work; its state holds at most ``capacity`` entries.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held: OrderedDict[str, tuple] = OrderedDict()  # at, path, hash, size, tokens
        n = dict.fromkeys(COUNTS, 0)
        size = 0

        def drop(key: str) -> None:
            nonlocal size
            size -= held.pop(key)[3]

        for r in pdf.sort_values("seq").itertuples():
            path, sha = (None if pd.isna(x) else x for x in (r.path, r.hash))
            if r.op == "set":
                new = 0 if pd.isna(r.size) else int(r.size)
                while held and (len(held) >= capacity or size + new > most_bytes):
                    drop(next(iter(held)))
                    n["evicted"] += 1
                if r.key in held:
                    drop(r.key)
                held[r.key] = (r.at, path, sha, new, 0 if pd.isna(r.tokens) else int(r.tokens))
                size += new
            elif r.op == "invalidate" and r.key in held:
                drop(r.key)
                n["invalidated"] += 1
            elif r.op == "invalidate_path":
                gone = [k for k, e in held.items() if e[1] is not None and e[1] == path]
                n["invalidated"] += len(gone)
                for k in gone:
                    drop(k)
            elif r.op == "clear":
                held.clear()
                size = 0
            elif r.op == "get":
                entry = held.get(r.key)
                if entry is None:
                    n["not_found"] += 1
                elif r.at - entry[0] > ttl:
                    n["expired"] += 1
                    drop(r.key)
                elif entry[1] and entry[2] and sha and sha != entry[2]:
                    n["file_changed"] += 1
                    drop(r.key)
                else:
                    n["hits"] += 1
                    n["tokens_saved"] += entry[4]
                    held.move_to_end(r.key)
        return pd.DataFrame([(pdf["cache"].iloc[0], *n.values(), len(held), size, ",".join(held))], columns=["cache", *COUNTS, "entries", "bytes", "keys"])

    kinds = {"cache": "long", "seq": "long", "at": "double", "op": "string", "key": "string", "path": "string", "hash": "string", "size": "long", "tokens": "long"}
    ship(ops.sparkSession)
    return ops.select(*[(F.col(c) if c in ops.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]).groupBy("cache").applyInPandas(run, SCHEMA)
