"""Sharding by fixed virtual slots: records hash into slots, slots hold bytes, a versioned map names their shards.

A record's slot depends on its text, so equal texts share a shard; a group of copies that holds more than a HEAVY-th
of a shard's even share, of bytes or of rows, is spread over slots by its ids instead, and rows of such a group that
even share an id by their place, so no group unbalances a shard or fills a slot. The first map deals
slots to shards by bytes, the largest first to the lightest shard. A later map is an edit of the one before:
slots move only from shards above their even share to shards below it, and the version grows by one.

Everything runs on DataFrame functions. Texts are read once, for their size and hashes; only these few numbers
are shuffled. Rows are numbered within their slot and the part of the table that they were read with, on top of the
rows of that slot in earlier parts, so no task has to sort a whole slot. What reaches the driver or is broadcast has
fixed bounds: slots rows, and four times shards * HEAVY groups.

Defined results: a null text has 0 bytes and belongs with other null texts; repeated rows are placed each; a
null id is hashed like any value; an empty table gives no rows and an empty map still names every slot; only the
named columns are read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstack.llm.common import materialize

SHARDS, SLOTS, HEAVY = 24, 8192, 2
#: Bytes that a record takes besides its text.
OVERHEAD = 8


@dataclass(frozen=True)
class SlotMap:
    """Version, number of shards, and the shard of every slot."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    @staticmethod
    def first(slot_bytes: list[int], shards: int) -> SlotMap:
        owner, heap = [0] * len(slot_bytes), [(0, 0, s) for s in range(shards)]
        for slot in sorted(range(len(slot_bytes)), key=lambda s: (-slot_bytes[s], s)):
            load, n, shard = heapq.heappop(heap)
            owner[slot] = shard
            heapq.heappush(heap, (load + slot_bytes[slot], n + 1, shard))
        return SlotMap(1, shards, tuple(owner))

    def edited(self, slot_bytes: list[int], shards: int | None = None, slack: float = 0.01) -> SlotMap:
        """The next version for these bytes and shards; slots of shards that are gone move, others only from overfull shards."""
        shards = shards or self.shards
        owner, load = list(self.shard_of), [0] * shards
        for slot, shard in enumerate(owner):
            if shard < shards:
                load[shard] += slot_bytes[slot]
        even = sum(slot_bytes) / shards
        moving = [s for s, shard in enumerate(owner) if shard >= shards]
        for shard in (s for s in range(shards) if load[s] > even * (1 + slack)):
            for slot in sorted((s for s, o in enumerate(owner) if o == shard), key=lambda s: (-slot_bytes[s], s)):
                if load[shard] - slot_bytes[slot] >= even and slot_bytes[slot]:
                    load[shard] -= slot_bytes[slot]
                    moving.append(slot)
        heap = [(b, s) for s, b in enumerate(load)]
        heapq.heapify(heap)
        for slot in sorted(moving, key=lambda s: (-slot_bytes[s], s)):
            b, shard = heapq.heappop(heap)
            owner[slot] = shard
            heapq.heappush(heap, (b + slot_bytes[slot], shard))
        return SlotMap(self.version + 1, shards, tuple(owner))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.version, slot, shard) for slot, shard in enumerate(self.shard_of)], "version int, virtual_slot int, shard int")

    def store(self, spark: SparkSession, path: str) -> None:
        self.frame(spark).coalesce(1).write.parquet(f"{path}/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, path: str, version: int) -> SlotMap:
        rows = sorted((r["virtual_slot"], r["shard"]) for r in spark.read.parquet(f"{path}/version={version}").select("virtual_slot", "shard").toLocalIterator())
        return SlotMap(version, max(s for _, s in rows) + 1, tuple(s for _, s in rows))


def slotted(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """id_col, size, text_crc32, virtual_slot of every row, from one scan of the texts, and _part: by which it was read."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD
    content = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(id_col, size.alias("size"), F.crc32(content.cast("binary")).alias("text_crc32"), F.xxhash64(text, F.col(text).isNull()).alias("_text"), F.xxhash64(id_col).alias("_id"), F.monotonically_increasing_id().alias("_place"))
    own = materialize(own, "sizes")
    total = own.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.count("*").alias("n")).first()

    def heavy(rows: DataFrame, *keys: str) -> DataFrame:
        # at most shards * HEAVY groups are this large in bytes, and as many in rows
        large = (F.col("_size") * (shards * HEAVY) > total["size"]) | (F.col("_n") * (shards * HEAVY) > total["n"])
        return F.broadcast(rows.groupBy(*keys).agg(F.sum("size").alias("_size"), F.count("*").alias("_n")).filter(large).select(*keys, F.lit(True).alias(f"_heavy{len(keys)}")))

    texts = heavy(own, "_text")
    known = own.join(texts, "_text", "left").join(heavy(own.join(texts, "_text"), "_text", "_id"), ["_text", "_id"], "left")
    key = F.when(F.col("_heavy2"), F.xxhash64("_text", "_id", "_place")).when(F.col("_heavy1"), F.xxhash64("_text", "_id")).otherwise(F.col("_text"))
    return known.select(id_col, "size", "text_crc32", F.pmod(key, F.lit(slots)).cast("int").alias("virtual_slot"), F.spark_partition_id().alias("_part"))


def slot_sizes(placed: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of every slot."""
    size, rows = [0] * slots, [0] * slots
    for r in placed.groupBy("virtual_slot").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect():  # slots rows at most
        size[r["virtual_slot"]], rows[r["virtual_slot"]] = r["size"], r["n"]
    return size, rows


def assign(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shards: int = SHARDS, slots: int = SLOTS, previous: SlotMap | None = None, store: str | None = None) -> DataFrame:
    """id_col, size, text_crc32, law, shard, slot (the row's place in its shard), grown_shard, virtual_slot, map_version.

    previous: the map to edit; store: a folder for the new version of the map.
    """
    spark = docs.sparkSession
    placed = materialize(slotted(docs, id_col, text, shards, slots), "slots")
    size, rows = slot_sizes(placed, slots)
    chosen = previous.edited(size, shards) if previous else SlotMap.first(size, shards)
    if store:
        chosen.store(spark, store)
    before, base = [0] * shards, []
    for slot, shard in enumerate(chosen.shard_of):
        base.append((slot, shard, before[shard]))
        before[shard] += rows[slot]
    owners = spark.createDataFrame(base, "virtual_slot int, shard int, _base long")
    # the rows of a slot in earlier parts, then the place among those of its own part
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy("virtual_slot").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = placed.groupBy("virtual_slot", "_part").agg(F.count("*").alias("_n")).select("virtual_slot", "_part", earlier.alias("_earlier"))
    nth: Column = F.row_number().over(Window.partitionBy("virtual_slot", "_part").orderBy(id_col, "text_crc32", "size"))
    return placed.withColumn("_nth", nth).join(parts, ["virtual_slot", "_part"]).join(F.broadcast(owners), "virtual_slot").select(
        id_col,
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_base") + F.col("_earlier") + F.col("_nth") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.lit(chosen.version).alias("map_version"),
    )
