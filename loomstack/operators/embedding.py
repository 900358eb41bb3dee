"""Embedding of texts by a model behind an interface: in batches, each text once, widths checked."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 50
CACHE = "id string, digest string, values array<float>, seq long"


class Embedder(Protocol):
    """A model: its vectors' width, and a call that gives a vector for each of a list of texts, in order."""

    width: int

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class LetterCounts:
    """How often each of the letters a to z stands in a text: a stand-in where there is no model."""

    width = 26

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [[float(t.count(chr(c))) for c in range(97, 123)] for t in texts]


def embed(rows: DataFrame, embedder: Embedder, id_col: str = "id", text: str = "text", vector: str = "values", batch: int = BATCH) -> DataFrame:
    """id_col, vector of every row; a null text is empty. Fails if the model returns too few vectors or one of another width."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for low in range(0, len(frame), batch):
                part = frame.iloc[low : low + batch]
                found = embedder([t or "" for t in part[text]])
                if len(found) != len(part):
                    raise ValueError(f"{len(found)} vectors for {len(part)} texts")
                if wrong := {len(v) for v in found} - {embedder.width}:
                    raise ValueError(f"a vector is {wrong.pop()} wide, not {embedder.width}")
                yield pd.DataFrame({id_col: part[id_col].to_numpy(), vector: [list(map(float, v)) for v in found]})

    source = rows.select(id_col, text)
    return source.mapInPandas(run, f"`{id_col}` {dict(source.dtypes)[id_col]}, `{vector}` array<float>")


def embed_all(chunks: DataFrame, embedder: Embedder, path: str, batch: int = BATCH) -> DataFrame:
    """id, values of all chunks (id, text); path keeps what was embedded, so only new and changed texts are embedded again.

    The cache is a Parquet folder that grows by one write a run; a run that fails adds nothing, and the next one goes on.
    """
    spark = chunks.sparkSession
    own = chunks.select("id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    spark.createDataFrame([], CACHE).write.mode("append").parquet(path)
    kept = spark.read.schema(CACHE).parquet(path)
    seq = (kept.agg(F.max("seq")).first()[0] or 0) + 1
    todo = own.join(kept.select("id", "digest").distinct(), ["id", "digest"], "left_anti").dropDuplicates(["id", "digest"])
    new = embed(todo.select(F.struct("id", "digest").alias("key"), "text"), embedder, "key", batch=batch)
    new.select("key.id", "key.digest", "values", F.lit(seq).cast("long").alias("seq")).write.mode("append").parquet(path)
    last = spark.read.schema(CACHE).parquet(path).groupBy("id", "digest").agg(F.max_by("values", "seq").alias("values"))
    return own.select("id", "digest").distinct().join(last, ["id", "digest"]).select("id", "values")
