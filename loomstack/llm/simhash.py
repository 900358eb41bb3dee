"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by BK-trees of fingerprint shards.

Two fingerprints within `radius` bits agree wholly on at least m - radius of any m bit blocks. Each choice of
m - radius blocks is one dealing of all distinct fingerprints into shards by the bits of these blocks, so every
link lies within some shard. Each shard is a BK-tree: a child hangs on its parent's edge numbered with their
Hamming distance, and a search follows only edges within the radius of its own distance to the node. m grows
with the number of fingerprints, so shards stay small; a shard that is still too full is dealt once more by the
bits that its key leaves free, by the same rule. A task turns the links of its shards into a spanning forest,
so a group of copies costs rows in proportion to its size, and rounds of large and small stars join the forests;
a component's root, however many rows hang on it, is met by a bounded broadcast.

Defined results: a null or wordless text has fingerprint zero, linked like any other; equal fingerprints are
always linked; repeated rows (equal doc_id) each give a row; a null doc_id takes part, but names a component
only if no other member has an id; empty tables give empty results; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from loomstack.llm.common import materialize, steps
from loomstack.operators.graph import met, stars

WIDTH, RADIUS, SEED = 4, 4, 42
#: Rows of a shard above which it is dealt again by its free bits.
FULL = 2048
#: Mean rows of a shard up to which no more blocks are used.
MEAN = 64
#: Pairs of query and tree node that a search holds at once.
FRONTIER = 1 << 20

_BIT = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_BYTE = np.arange(8) * 256
_PLACE = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    """Bit i is set if bit i is set in over half of the XXH64 of all shingles."""
    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return hashed(joined, seed)
    ends = np.fromiter(map(len, words), np.int64, len(words)).cumsum() + np.arange(len(words))
    starts = np.r_[0, ends[:-width] + 1]
    h = np.fromiter([hashed(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64, len(starts))
    counts = np.bincount((h.view(np.uint8).reshape(-1, 8) + _BYTE).ravel(), minlength=2048).reshape(8, 256) @ _BIT
    return int(_PLACE[counts.ravel() * 2 > len(h)].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """id_col and fp, a long with the fingerprint's bits, for every row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, at in steps(batches, text):
            data = raw.tobytes()
            fps = np.array([fingerprint(data[a:b], width) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index(id_col)), pa.array(fps.view(np.int64))], [id_col, "fp"])

    rows = docs.select(id_col, text)
    return rows.mapInArrow(make, f"`{id_col}` {dict(rows.dtypes)[id_col]}, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _masks(free: list[int], blocks: int, radius: int) -> list[int]:
    """Masks of the bits in free, cut into blocks, for every choice of blocks - radius blocks."""
    parts = [sum(1 << b for b in part) for part in np.array_split(np.array(free, object), blocks)]
    return [_signed(sum(chosen)) for chosen in combinations(parts, blocks - radius)]


def _blocks(n: int, radius: int, mean: int) -> int:
    """The fewest blocks with which n evenly spread fingerprints make shards of at most mean rows; 8 bits a block or more."""
    m = radius + 1
    while n > mean << (64 * (m - radius) // m) and m < 8:
        m += 1
    return m


def shards(fps: DataFrame, n: int, radius: int = RADIUS, full: int = FULL, mean: int = MEAN) -> DataFrame:
    """Every fp once for each of its shards: columns deal, key, deal2, key2, fp."""
    masks = _masks(list(range(64)), _blocks(n, radius, mean), radius)
    again = [_masks([b for b in range(64) if not (m >> b) & 1], radius + 1, radius) for m in masks]

    def dealt(deal: Column, choices: Column) -> Column:
        return F.explode(F.transform(choices, lambda m, i: F.struct(i.alias("deal"), F.col("fp").bitwiseAND(m).alias("key"))))

    first = fps.select("fp", dealt(F.lit(0), F.array(*map(F.lit, masks))).alias("s")).select("fp", "s.deal", "s.key")
    crowded = first.groupBy("deal", "key").count().filter(F.col("count") > full).select("deal", "key", F.lit(True).alias("crowded"))
    second = F.when(F.col("crowded"), F.element_at(F.array(*[F.array(*map(F.lit, x)) for x in again]), F.col("deal") + 1)).otherwise(F.array(F.lit(0).cast("long")))
    both = first.join(crowded, ["deal", "key"], "left").withColumn("s", dealt(F.col("deal"), second))
    return both.select("deal", "key", F.col("s.deal").alias("deal2"), F.col("s.key").alias("key2"), "fp")


class Forest:
    """BK-trees, one for each shard, built and searched level by level for all shards at once."""

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        """shard: ascending numbers of the rows' shards; the first row of a shard is its root."""
        self.fp, self.root = fp, np.searchsorted(shard, shard, "left")
        at, codes, kids = self.root.copy(), [], []
        active = np.flatnonzero(self.root != np.arange(len(fp)))
        while len(active):
            code = at[active] * 65 + np.bitwise_count(fp[active] ^ fp[at[active]])
            order = np.argsort(code, kind="stable")
            active, code = active[order], code[order]
            heads = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            codes.append(code[heads])
            kids.append(active[heads])
            at[active] = np.repeat(active[heads], np.diff(np.r_[heads, len(code)]))
            rest = np.ones(len(active), bool)
            rest[heads] = False
            active = active[rest]
        self.codes, self.kids = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (codes, kids))
        order = np.argsort(self.codes)
        self.codes, self.kids = self.codes[order], self.kids[order]

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows of one shard within the radius, in pieces."""
        stack = [(np.arange(a, min(a + FRONTIER // 8, len(self.fp))), self.root[a : a + FRONTIER // 8]) for a in range(0, len(self.fp), FRONTIER // 8)]
        while stack:
            query, node = stack.pop()
            if len(query) > FRONTIER:
                half = len(query) // 2
                stack += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            far = np.bitwise_count(self.fp[query] ^ self.fp[node]).astype(np.int64)
            near = (far <= radius) & (query > node)
            if near.any():
                yield query[near], node[near]
            low = np.searchsorted(self.codes, node * 65 + np.maximum(far - radius, 0))
            high = np.searchsorted(self.codes, node * 65 + np.minimum(far + radius, 64), "right")
            wide = high - low
            if total := int(wide.sum()):
                nth = np.arange(total) - np.repeat(wide.cumsum() - wide, wide)
                stack.append((np.repeat(query, wide), self.kids[np.repeat(low, wide) + nth]))


def joined(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest row that pairs connect to each of n rows."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
    return label


def forest_edges(dealt: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges u > v of a spanning forest of the links in each task's shards."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        cols = [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(5)]
        order = np.lexsort(cols[3::-1])
        cols = [c[order] for c in cols]
        new = np.zeros(len(order), bool)
        for c in cols[:4]:
            new[1:] |= c[1:] != c[:-1]
        own, row = np.unique(cols[4], return_inverse=True)
        pairs = ((row[a], row[b]) for a, b in Forest(np.cumsum(new), cols[4].view(np.uint64)).links(radius))
        label = joined(len(own), pairs)
        linked = np.flatnonzero(label != np.arange(len(own)))
        yield pa.RecordBatch.from_arrays([pa.array(own[linked]), pa.array(own[label[linked]])], ["u", "v"])

    spread = dealt.select(F.col("deal").cast("int"), "key", F.col("deal2").cast("int"), "key2", "fp").repartition("deal", "key", "deal2", "key2")
    return spread.mapInArrow(search, "u long, v long")


def _rooted(prints: DataFrame, id_col: str, radius: int, full: int) -> DataFrame:
    """Every distinct fp with the least id of its rows, how many they are, and its component's root, the component's smallest fp."""
    own = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n")), "fingerprints")
    linked = stars(forest_edges(shards(own.select("fp"), own.count(), radius, full), radius))
    return own.join(linked.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("v", "fp").alias("root"))


def components(prints: DataFrame, id_col: str = "doc_id", radius: int = RADIUS, full: int = FULL) -> DataFrame:
    """prints (id_col, fp) with component_id, the smallest id that links reach."""
    rooted = materialize(_rooted(prints, id_col, radius, full), "rooted")
    total = rooted.agg(F.count("*").alias("fps"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("k"))
    members = met(rooted, named, "root", "component_id", "k", total["fps"]).select("fp", "component_id", "n")
    return met(prints, members, "fp", "component_id", "n", total["rows"]).select(id_col, "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """One row per document: id_col, fingerprint (16 hex digits), component_id."""
    prints = materialize(fingerprints(docs, id_col, text, width), "prints")
    found = components(prints, id_col, radius)
    return found.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """One document of each component: that with the smallest id, and one row of those that share this id.

    A component without any id keeps a row too, and so does each of several components whose smallest id is the same.
    """
    prints = materialize(fingerprints(docs, id_col, text, width), "prints")
    least = F.min(F.struct(F.col("least").isNull(), F.col("least").alias("_id"), F.col("fp").alias("_own"))).alias("s")
    chosen = _rooted(prints, id_col, radius, FULL).groupBy("root").agg(least).select("s._id", "s._own")
    times = prints.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.count("*").alias("_n"))
    # the ids grow with the documents, so they are never broadcast: one plan, and one cost for each row, at every size
    chosen = materialize(chosen.join(times.hint("merge"), "_id", "left"), "kept")
    named = F.col(id_col) == F.col("_id")
    alone = docs.join(chosen.filter("_n = 1").hint("merge"), named, "left_semi")
    several = chosen.filter("_n IS NULL OR _n > 1")
    if several.isEmpty():
        return alone
    columns = docs.columns

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, at in steps(batches, text):
            data = raw.tobytes()
            fps = np.array([fingerprint(data[a:b], width) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(fps.view(np.int64))], [*columns, "_fp"])

    # an id is no key here: rows without one, or of one id, may belong to many components
    again = docs.join(several.hint("merge"), named, "left_semi").unionByName(docs.filter(F.col(id_col).isNull()))
    again = again.mapInArrow(marked, StructType([*docs.schema.fields, StructField("_fp", LongType())])).dropDuplicates([id_col, "_fp"])
    rest = again.join(several.hint("merge"), F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_fp") == F.col("_own")), "left_semi")
    return alone.unionByName(rest.select(columns))
