"""File-stream ingest of chunks: each micro-batch is upserted by id, so a restart repeats no row.

A micro-batch rewrites the table, so it should hold all that waits (as availableNow makes it); of one chunk in several
files the newest file's counts, and in one file the last line's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomstack.sources.readers import CHUNK
from loomstack.sources.sinks import upsert


def ingest_chunks(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Reads what lies in source as JSON lines of chunks and ends; started again, it takes what is new."""
    rows = spark.readStream.schema(CHUNK).json(source).select("*", F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start").alias("_file"))

    def taken(batch: DataFrame, _: int) -> None:
        upsert(batch.withColumn("_seq", F.struct("_file.*", F.monotonically_increasing_id().alias("place"))).drop("_file"), target, "id", seq="_seq")

    return rows.writeStream.foreachBatch(taken).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
