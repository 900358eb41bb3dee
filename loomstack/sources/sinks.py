"""Sinks: upserts, whole replacements and receipts on plain Parquet folders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstack.operators.vector import checked


def upserted(old: DataFrame | None, new: DataFrame, *keys: str, seq: str | None = None) -> DataFrame:
    """old rows with new ones in their place; of new rows with one key the last by the column seq, which is left out.

    Rows have no order of their own: without seq, or where it ties, the one whose JSON is greatest stays.
    """
    columns = [c for c in new.columns if c != seq]
    row = F.struct(*columns)
    fresh = new.groupBy(*keys).agg(F.max_by(row, F.struct(*([seq] if seq else []), F.to_json(row))).alias("_r")).select("_r.*")
    return fresh if old is None else old.join(fresh, list(keys), "left_anti").select(columns).unionByName(fresh)


def replace(df: DataFrame, path: str) -> None:
    """A new version of a table written beside the old one, which then takes its place."""
    part = f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(part)
    _swap(df.sparkSession, part, path)


def _swap(spark: SparkSession, part: str, path: str) -> None:
    """part in the place of path. The old version is put aside first and deleted last, so a crash loses nothing: recover() puts it back."""
    recover(spark, path)
    fs, now, new, aside = _paths(spark, path, part, f"{path}.aside")
    if fs.exists(now) and not fs.rename(now, aside):
        raise OSError(f"{path} could not be put aside")
    if not fs.rename(new, now):
        raise OSError(f"{part} could not become {path}")
    if fs.exists(aside):
        fs.delete(aside, True)


def recover(spark: SparkSession, path: str) -> None:
    """After a crash of replace(): the old version back in its place if there is no new one, else gone."""
    fs, now, aside = _paths(spark, path, f"{path}.aside")
    if fs.exists(aside):
        if fs.exists(now):
            fs.delete(aside, True)
        elif not fs.rename(aside, now):
            raise OSError(f"{path} could not be put back")


def _paths(spark: SparkSession, *paths: str):
    jvm = spark.sparkContext._jvm
    made = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return (made[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), *made)


def upsert(df: DataFrame, path: str, *keys: str, seq: str | None = None) -> None:
    spark = df.sparkSession
    recover(spark, path)
    fs, at = _paths(spark, path)
    replace(upserted(spark.read.parquet(path) if fs.exists(at) else None, df, *keys, seq=seq), path)


def replace_graph(graph, path: str) -> None:
    """Nodes, edges, node_chunks and aliases as tables in one folder, sorted, that replaces the old one whole; an empty description is null."""
    part = f"{path}.{uuid.uuid4().hex}"
    graph.nodes.withColumn("description", F.nullif("description", F.lit(""))).orderBy("id").write.parquet(f"{part}/nodes")
    graph.edges.orderBy("id").write.parquet(f"{part}/edges")
    graph.node_chunks.orderBy("node_id", "chunk_id").write.parquet(f"{part}/node_chunks")
    graph.aliases.orderBy("node_id", "alias").write.parquet(f"{part}/aliases")
    _swap(graph.nodes.sparkSession, part, path)


def vector_records(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """id, values, metadata<document, page_start, page_end> for a vector table."""
    return vectors.join(chunks.select("id", "document", "page_start", "page_end"), "id").select("id", "values", F.struct("document", "page_start", "page_end").alias("metadata"))


def upsert_vectors(vectors: DataFrame, chunks: DataFrame, path: str, width: int) -> None:
    """Vectors (id, values) of chunks into a table of records by id; one of another width fails the whole write."""
    fine = checked(vectors.filter(F.col("values").isNotNull()), "values", width)
    upsert(vector_records(fine, chunks), path, "id")


def sorted_lines(df: DataFrame, path: str, *keys: str) -> None:
    """JSON lines in one order over all files: each file is sorted, and their names follow the keys."""
    df.orderBy(*keys).write.mode("overwrite").json(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def receipt(spark: SparkSession, values: dict, path: str) -> None:
    """One JSON record of a run."""
    spark.createDataFrame([values]).coalesce(1).write.mode("overwrite").json(path)
