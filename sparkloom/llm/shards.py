"""Sharding by fixed virtual slots: records hash into slots, bytes are summed by slot, and a versioned map sends slots to shards."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import record_id, shared_dir

#: Slots are fixed for a corpus's lifetime; the map from slots to shards is what changes.
SLOTS = 4096


def slotted(docs: DataFrame, slots: int = SLOTS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, id, size, text_crc32, vslot): size is the text's UTF-8 bytes (null: none) plus 1, the slot a hash of the id."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), record_id(doc_id, text).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")).alias("text_crc32"))
    return rows.withColumn("vslot", F.pmod(F.xxhash64("id"), F.lit(slots)).cast("int"))


def slot_sizes(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """(bytes, rows) of each slot that has any; as many entries as there are slots at most."""
    return {r.vslot: (r.b, r.n) for r in rows.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}


def assign(sizes: dict[int, int], shards: int) -> dict[int, int]:
    """slot -> shard: largest slot first, each to the shard with the fewest bytes so far, the lower number of equal ones."""
    load = [(0, s) for s in range(shards)]
    out = {}
    for slot, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        total, shard = heapq.heappop(load)
        out[slot] = shard
        heapq.heappush(load, (total + size, shard))
    return out


def rebalance(mapping: dict[int, int], sizes: dict[int, int], shards: int) -> dict[int, int]:
    """``mapping`` edited for ``shards`` shards: slots move only out of shards beyond the mean or the count, and only as many as needed.

    Slots that the map lacks are placed too. All others stay where they are.
    """
    out = {k: v for k, v in mapping.items() if v < shards}
    mean = sum(sizes.values()) / max(1, shards)
    load = [0] * shards
    held: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in out.items():
        load[shard] += sizes.get(slot, 0)
        held[shard].append(slot)
    loose = [s for s in sizes if s not in out]
    for shard in range(shards):
        for slot in sorted(held[shard], key=lambda s: (-sizes.get(s, 0), s)):
            if load[shard] - sizes.get(slot, 0) >= mean and sizes.get(slot, 0) > 0:
                load[shard] -= sizes[slot]
                loose.append(slot)
    for slot in sorted(loose, key=lambda s: (-sizes.get(s, 0), s)):
        shard = min(range(shards), key=lambda s: (load[s], s))
        out[slot] = shard
        load[shard] += sizes.get(slot, 0)
    return out


class SlotMap:
    """Versions of a slot-to-shard map, each a small Parquet table beside the others; a version once written is never changed."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        import uuid

        self.spark, self.path = spark, path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"

    def write(self, version: int, mapping: dict[int, int]) -> None:
        self.spark.createDataFrame(sorted(mapping.items()), "vslot int, shard int").coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/version={version}")

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema("vslot int, shard int").parquet(f"{self.path}/version={version}")


def shard(docs: DataFrame, shards: int = 16, slots: int = SLOTS, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, vslot, shard, slot) for each row; ``slot`` is its place in its shard, gapless from 0, by virtual slot and id.

    Shards get near equal bytes, as near as ``slots`` pieces allow. The map is version 1 of a SlotMap at ``path`` (default: in the shared folder).
    Null text has size 1 and the checksum of no bytes; a null id hashes by the text. Rows of one id share a slot; their order in it is by size and checksum.
    Places come from the counts of the slots before and a numbering inside each slot, so no task sees more than a slot. Empty input gives no rows.
    """
    spark = docs.sparkSession
    rows = slotted(docs, slots, doc_id, text)
    sizes = slot_sizes(rows)
    mapping = assign({k: v[0] for k, v in sizes.items()}, shards)
    SlotMap(spark, path).write(1, mapping)
    before: dict[int, int] = {}
    filled = [0] * shards
    for slot in sorted(mapping):
        before[slot] = filled[mapping[slot]]
        filled[mapping[slot]] += sizes[slot][1]
    placed = spark.createDataFrame([(s, mapping[s], before[s]) for s in mapping], "vslot int, shard int, before long")
    inside = F.row_number().over(Window.partitionBy("vslot").orderBy("id", "size", "text_crc32")) - 1
    out = rows.withColumn("inside", inside).join(F.broadcast(placed), "vslot")  # as many rows as slots
    return out.select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("before") + F.col("inside")).cast("long").alias("slot"))
