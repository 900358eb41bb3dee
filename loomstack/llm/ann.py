"""Approximate nearest neighbours: an inverted file with product-quantised residuals, reranked exactly.

Vectors are scaled to length one; the coarse centroid nearest to a vector names its list, and what remains is
quantised piece by piece. A query visits its nearest lists, scores their codes from a table of distances between
its own residual and every codeword, and reranks the best of every list by the cosine of the original vectors.

The index is fitted on a bounded sample (of the SAMPLE least hashes of ids) and holds every row. The lists follow the
square root of the rows: where the sample cannot carry so many centroids, each is split by FINE shared centroids of
the residuals. How many lists a query visits and how many rows are reranked is also fitted there: the least that find
RECALL of the true neighbours of CHECKS sample rows, up to whole blocks. A list is cut into blocks of BLOCK rows, so a
vector that is a third of all rows fills many blocks, not one task; queries meet blocks, never each other, and only
the best rows of the blocks that a task has seen leave it (it holds HELD of them at most). Reranking multiplies matrices and then works out the exact measure of those that come
within rounding of the best.

Defined results: vectors that are null, zero, of another than the most frequent dimension, or hold null or
non-finite components take no part, neither do rows without id; ties go to the smaller id; rows that share an id
are candidates each, but one query (the one with the smallest vector); fewer candidates than k give fewer rows; an
empty table gives none; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstack.llm.common import materialize

K, SAMPLE, CHECKS, RECALL = 5, 16_384, 200, 0.98
PIECES, CODEWORDS, BLOCK, FINE = 16, 64, 4096, 64
#: Queries whose tables are held at once, components that their reranking gathers, and how many rows a block reranks at least; it reranks as many as are needed.
TOGETHER, GATHERED, RERANK = 256, 4_000_000, (16, 32, 64, 128, 256)
#: Found rows that a task holds before it keeps each query's best, or hands them on if those are too many as well.
HELD = 1 << 19


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, which changes no digit, so that the largest component is near 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=-1))


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / norms(x)[:, None]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; equal rows give equal results, wherever they stand, and large components overflow nothing."""
    a, b = scaled(a), scaled(b)
    return (a * b).sum(axis=-1) / (norms(a) * norms(b))


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(x))
    means = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, means)
        order = np.argsort(own, kind="stable")
        heads = np.flatnonzero(np.r_[True, np.diff(own[order]) > 0])
        means[own[order][heads]] = np.add.reduceat(x[order], heads) / np.diff(np.r_[heads, len(x)])[:, None]
    return means


def nearest(x: np.ndarray, means: np.ndarray) -> np.ndarray:
    half = (means * means).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 4096] @ means.T - half).argmax(axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


@dataclass
class Index:
    centroids: np.ndarray
    books: list[np.ndarray]  # of each piece: codewords x its dimensions
    edges: list[int]
    fine: np.ndarray | None = None  # shared centroids of residuals; centroids then holds every sum of a coarse and a fine one
    probes: int = 1
    rerank: int = RERANK[0]

    @staticmethod
    def fit(sample: np.ndarray, rows: int, seed: int = 3) -> Index:
        """sample: unit vectors; rows: how many the index will hold."""
        rng = np.random.default_rng(seed)
        lists = max(1.0, np.sqrt(rows))
        coarse = kmeans(sample, int(np.clip(lists, 1, max(1, len(sample) // 16))), 8, rng)
        rest, fine = sample - coarse[nearest(sample, coarse)], None
        if int(lists) > len(coarse) and len(sample) > 16:
            fine = kmeans(rest, min(FINE, int(np.ceil(lists / len(coarse)))), 8, rng)
            rest = rest - fine[nearest(rest, fine)]
        centroids = coarse if fine is None else (coarse[:, None] + fine[None]).reshape(-1, sample.shape[1])
        edges = np.linspace(0, sample.shape[1], min(PIECES, sample.shape[1]) + 1).astype(int).tolist()
        index = Index(centroids, [kmeans(rest[:, a:b], CODEWORDS, 8, rng) for a, b in zip(edges, edges[1:], strict=False)], edges, fine)
        index.tune(sample, rng, max(1.0, rows / len(sample)))
        return index

    def assigned(self, x: np.ndarray) -> np.ndarray:
        """The list of every vector: the nearest coarse centroid, then the nearest fine one to what remains."""
        if self.fine is None:
            return nearest(x, self.centroids)
        coarse = self.centroids[:: len(self.fine)] - self.fine[0]
        own = nearest(x, coarse)
        return own * len(self.fine) + nearest(x - coarse[own], self.fine)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = self.assigned(x)
        rest = x - self.centroids[own]
        return own, np.stack([nearest(rest[:, a:b], book) for book, a, b in zip(self.books, self.edges, self.edges[1:], strict=False)], axis=1).astype(np.uint8)

    def tables(self, queries: np.ndarray, which: int | np.ndarray) -> np.ndarray:
        """Squared distances of the queries' residuals to list `which` from every codeword: queries x pieces x codewords."""
        rest = queries - self.centroids[which]
        out = np.full((len(queries), len(self.books), CODEWORDS), np.inf)
        for i, (book, a, b) in enumerate(zip(self.books, self.edges, self.edges[1:], strict=False)):
            q = rest[:, a:b]
            out[:, i, : len(book)] = (q * q).sum(axis=1)[:, None] - 2 * q @ book.T + (book * book).sum(axis=1)
        return out

    @staticmethod
    def distances(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances: queries x codes."""
        out = np.zeros((len(tables), len(codes)))
        for i in range(codes.shape[1]):
            out += tables[:, i, codes[:, i]]
        return out

    def visited(self, queries: np.ndarray) -> np.ndarray:
        """The lists that each query visits, nearest first."""
        return np.argsort((self.centroids * self.centroids).sum(axis=1) / 2 - queries @ self.centroids.T, axis=1, kind="stable")[:, : self.probes]

    def tune(self, sample: np.ndarray, rng: np.random.Generator, grown: float = 1.0) -> None:
        """The fewest probes, then the fewest reranked rows, that reach RECALL on the sample; lists will be `grown` times as long."""
        self.probes = len(self.centroids)
        own, codes = self.encode(sample)
        found = []
        for q in rng.choice(len(sample), min(CHECKS, len(sample)), replace=False):
            near = sample @ sample[q]
            near[q] = -np.inf
            order = self.visited(sample[q : q + 1])[0]
            place = np.argsort(order)
            for t in np.argsort(-near, kind="stable")[: min(K, len(sample) - 1)]:
                mates = np.flatnonzero(own == own[t])
                far = self.distances(self.tables(sample[q : q + 1], own[t]), codes[mates])[0]
                at = far[mates == t][0]
                # rows of an equal code may all come first; equal vectors come in the order of their ids
                tied = (far == at) & ((mates < t) | (sample[mates] != sample[t]).any(axis=1))
                found.append((place[own[t]], ((far < at) | tied)[mates != q].sum()))
        if not found:
            return
        list_at, rank = np.array(found).T
        self.probes = int(np.quantile(list_at, (1 + RECALL) / 2, method="higher")) + 1
        # of rows that the sample does not show, as many may come first as lie between two sample rows
        need = int(np.ceil((np.quantile(rank, (1 + RECALL) / 2, method="higher") + 1) * grown))
        self.rerank = next((r for r in RERANK if r >= need), need)


def valid(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id_col and vector of the rows that take part."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vector, lambda v: v != 0)
    rows = vectors.select(id_col, vector).filter(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).filter(fine)
    common = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size(vector) == (common["d"] if common else 0))


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    values = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(batch.num_rows, -1)


class Best:
    """Found rows (query, id, score) of a task, thinned to the k best of each query whenever HELD are there."""

    def __init__(self, k: int):
        self.k, self.found, self.n = k, [], 0

    def add(self, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        self.found.append(found)
        self.n += len(found[0])
        if self.n >= HELD:
            kept = self._thinned()
            if self.n > HELD // 2:
                yield self._batch(kept)
                self.found, self.n = [], 0

    def _thinned(self) -> tuple[np.ndarray, ...]:
        query, ids, score = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        kept = np.arange(len(query)) - np.searchsorted(query, query) < self.k
        self.found = [(query[kept], ids[kept], score[kept])]
        self.n = len(self.found[0][0])
        return self.found[0]

    @staticmethod
    def _batch(found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(f) for f in found], ["query_id", "id", "score"])

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            yield self._batch(self._thinned())


@dataclass
class Block:
    """Rows of one list, in the order of their ids."""

    which: int
    ids: np.ndarray
    x: np.ndarray
    size: np.ndarray
    codes: np.ndarray

    @staticmethod
    def of(batches: list[pa.RecordBatch]) -> Block:
        own = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        ids = own.column(3).to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        x = scaled(_matrix(own, 4))[order]
        codes = np.frombuffer(b"".join(own.column(5).to_pylist()), np.uint8).reshape(len(ids), -1)[order]
        return Block(own.column(0)[0].as_py(), ids[order], x, norms(x), codes)

    def best(self, asking: np.ndarray, q: np.ndarray, index: Index, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query ids, row ids and scores of the k best rows for each query, of those whose codes are nearest."""
        q = scaled(q)
        size = norms(q)
        one, depth, n = q / size[:, None], max(k, index.rerank), len(self.ids)
        own = asking[:, None] == self.ids[None, :]
        if depth < n:
            far = Index.distances(index.tables(one, self.which), self.codes)
            far[own] = np.inf
            top = np.argsort(far, axis=1, kind="stable")[:, :depth]
            near = np.matmul(self.x[top], one[:, :, None])[:, :, 0] / self.size[top]
            near[np.isinf(np.take_along_axis(far, top, 1))] = -np.inf
        else:  # all rows are reranked
            top = np.broadcast_to(np.arange(n), own.shape)
            near = one @ self.x.T / self.size
            near[own] = -np.inf
        least = -np.partition(-near, min(k, near.shape[1]) - 1, axis=1)[:, min(k, near.shape[1]) - 1]
        r, c = np.nonzero((near >= least[:, None] - 1e-9) & np.isfinite(near))
        c = top[r, c]
        part = max(1, GATHERED // q.shape[1])
        exact = [(q[r[i : i + part]] * self.x[c[i : i + part]]).sum(axis=-1) / (size[r[i : i + part]] * self.size[c[i : i + part]]) for i in range(0, len(r), part)]
        exact = np.concatenate(exact) if exact else np.zeros(0)
        order = np.lexsort((self.ids[c], -exact, r))
        r, c, exact = r[order], c[order], exact[order]
        kept = np.arange(len(r)) - np.searchsorted(r, r) < k
        return asking[r[kept]], self.ids[c[kept]], exact[kept]


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = K, index: Index | None = None, sample: int = SAMPLE) -> DataFrame:
    """The k nearest rows to each query row: query_id, rank, id_col, score (cosine)."""
    spark, rows = vectors.sparkSession, valid(vectors, id_col, vector)
    kind = f"query_id {dict(rows.dtypes)[id_col]}, rank int, `{id_col}` {dict(rows.dtypes)[id_col]}, score double"
    n = rows.count()
    if not n:
        return spark.createDataFrame([], kind)
    if index is None:
        place = F.pmod(F.xxhash64(id_col), F.lit(1 << 62))
        draw = rows.filter(place < int((1 << 62) * min(1.0, 2 * sample / n))).groupBy(id_col).agg(F.min(vector).alias(vector)).orderBy(place, id_col).limit(sample)
        drawn = np.array([r[vector] for r in draw.toLocalIterator()], np.float64)
        index = Index.fit(unit(drawn if len(drawn) else np.array([rows.first()[vector]], np.float64)), n)
    sent = spark.sparkContext.broadcast(index)
    item = dict(rows.dtypes)[vector]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, codes = sent.value.encode(unit(_matrix(batch, 1)))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary())], ["list", "id", "v", "code"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists = sent.value.visited(unit(_matrix(batch, 1)))
                take = pa.array(np.repeat(np.arange(batch.num_rows), lists.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(lists.ravel(), pa.int32()), batch.column(0).take(take), batch.column(1).take(take)], ["list", "id", "v"])

    id_type = dict(rows.dtypes)[id_col]
    coded = materialize(rows.mapInArrow(encode, f"list int, id {id_type}, v {item}, code binary"), "coded")
    # a row for each list at most
    blocks = spark.createDataFrame([(r["list"], -(-r["count"] // BLOCK)) for r in coded.groupBy("list").count().collect()], "list int, blocks long")
    held = coded.join(F.broadcast(blocks), "list").select("list", F.pmod(F.xxhash64("id", "v"), F.col("blocks")).alias("block"), F.lit(0).alias("kind"), "id", "v", "code")
    asked = rows.filter(is_query).groupBy(id_col).agg(F.min(vector).alias(vector)).mapInArrow(visit, f"list int, id {id_type}, v {item}")
    asked = asked.join(F.broadcast(blocks), "list").select("list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), "id", "v", F.lit(None).cast("binary").alias("code"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, now, held, block, best = sent.value, None, [], None, Best(k)
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_numpy() for i in (0, 1, 2)), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if keys[a][:2] != now:
                    now, held, block = keys[a][:2], [], None
                if keys[a][2] == 0:
                    held.append(batch.slice(a, b - a))
                elif held:
                    block = block or Block.of(held)
                    step = TOGETHER if index.rerank >= len(block.ids) else max(1, min(TOGETHER, GATHERED // (block.x.shape[1] * max(k, index.rerank))))
                    for i in range(a, b, step):
                        part = batch.slice(i, min(step, b - i))
                        yield from best.add(block.best(part.column(3).to_numpy(zero_copy_only=False), _matrix(part, 4), index, k))
        yield from best.rest()

    both = held.unionByName(asked).repartition("list", "block").sortWithinPartitions("list", "block", "kind")
    found = both.mapInArrow(meet, f"query_id {id_type}, id {id_type}, score double")
    nearest_first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", nearest_first).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
