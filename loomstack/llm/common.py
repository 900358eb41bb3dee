"""What the training-data operators share: tables, written intermediate results, Arrow text buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomstack.shared import written as materialize  # noqa: F401 - the operators' name for it

#: Bytes of text that one vectorised step handles; a longer text is a step of its own.
STEP_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: Bytes of an Arrow batch between the JVM and Python: what tasks hold outside the heap does not grow with the texts' length.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder; the session's Arrow batches are bounded from here on."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the offset of each row in them; a null row is empty."""
    if pa.types.is_string(column.type):
        kind = np.int32
    else:
        column, kind = column.cast(pa.large_string()), np.int64
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def steps(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of at most limit bytes of text, or one row: (rows, bytes, offsets)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, at = text_buffer(batch.column(batch.schema.get_field_index(column)))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
            yield batch.slice(low, high - low), raw[at[low] : at[high]], at[low : high + 1] - at[low]
            low = high


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand: rolling hashes by prefix sums."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 16)
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(self.n - 1, b, np.uint64)]) for b in (self.base, self.inverse))
        return self.up, self.down

    def spans(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of values[starts[i]:ends[i]] for every i, whatever its place."""
        up, down = self.upto(len(values) + 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=sums[1:])
        return (sums[ends] - sums[starts]) * down[starts]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def runs(member: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of member bytes; no run crosses a row's border in at."""
    starts, ends = member.copy(), member.copy()
    edge = at[:-1][at[:-1] < at[1:]]
    inner = edge[edge > 0]
    starts[1:] &= ~member[:-1]
    starts[inner] = member[inner]
    ends[:-1] &= ~member[1:]
    ends[inner - 1] = member[inner - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1
