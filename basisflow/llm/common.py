"""Tables, text blocks for NumPy, hashed words and exchanges of packed arrays.

Python stages get Arrow batches. A text column is handled in blocks of whole rows, about a megabyte
each, as one byte array with row boundaries, so memory is bounded by the longest text and not by the
batch. Stages that send many small numbers per document pack them into one binary value for each
target partition: Spark shuffles the packed rows, NumPy sorts what is inside.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

BLOCK_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(12345)
_BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """Partitions of a packed exchange: the session's shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python stages that run inside get at most ``rows`` rows at a time: the JVM and the worker each hold a whole batch, or two."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns that an operator is about to add; matching ignores case, as Spark's analyzer does."""
    low = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in low])


def text_blocks(column: pa.Array, max_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows: (first row, end row, bytes, row boundaries). Null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, values = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + max_bytes, "right")) - 1)
        end = min(end, n)
        yield row, end, data[bounds[row]:bounds[end]], bounds[row:end + 1] - bounds[row]
        row = end


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK_BYTES), base, np.uint64)
        steps[0] = 1
        have = _powers[name] = np.cumprod(steps)
        if len(have) > 64 * BLOCK_BYTES:  # one huge text: do not keep its table
            del _powers[name]
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Words:
    """Words of a block: byte range, 64-bit hash and row of each; ``bounds[r]:bounds[r+1]`` are row r's words.

    A word is a run of bytes that are not space or 0x09-0x0D; no word spans two rows.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, lower: bool = False):
        if lower:
            data = _LOWER[data]
        self.data = data
        n = len(data)
        inside = ~_SPACE[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edge = starts[:-1][starts[:-1] < n]
        begins[edge] = inside[edge]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        last = starts[1:][(starts[1:] > 0) & (starts[1:] <= n)] - 1
        ends[last] = inside[last]
        self.first = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[data] * _power(_BASE, "up", n), out=total[1:])
        self.hash = mix((total[self.end] - total[self.first]) * _power(_BASE_INVERSE, "down", n)[self.first]) \
            if len(self.first) else np.zeros(0, np.uint64)
        self.bounds = np.searchsorted(self.first, starts)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def packed_rows(part: np.ndarray, n_parts: int, *columns: np.ndarray) -> pa.RecordBatch:
    """One row per target partition: ``part`` and, for each column, the raw bytes of its values there."""
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(n_parts + 1))
    full = np.flatnonzero(np.diff(cuts))
    arrays = [pa.array(full.astype(np.int32))]
    for values in columns:
        values = values[order]
        arrays.append(pa.array([values[cuts[p]:cuts[p + 1]].tobytes() for p in full], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, ["part", *[f"c{i}" for i in range(len(columns))]])


def packed_schema(n_columns: int) -> str:
    return ", ".join(["part int", *[f"c{i} binary" for i in range(n_columns)]])


def to_partitions(df: DataFrame, n: int) -> DataFrame:
    """Send each packed row to the partition it names."""
    return df.repartitionById(n, "part")


def unpack(batches: Iterator[pa.RecordBatch], *types: str) -> list[np.ndarray]:
    """All packed values of this partition, column by column."""
    parts: list[list[np.ndarray]] = [[] for _ in types]
    for batch in batches:
        for i, kind in enumerate(types):
            for value in batch.column(i + 1):
                parts[i].append(np.frombuffer(value.as_buffer(), kind))
    return [np.concatenate(p) if p else np.zeros(0, kind) for p, kind in zip(parts, types, strict=True)]


def squeezed(values: np.ndarray, level: int = 1) -> bytes:
    """Numbers for the wire: bytes of equal weight side by side, then zstd, behind the size."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(planes, asbytes=True)


def unsqueezed(data: pa.Buffer | bytes, kind: str) -> np.ndarray:
    data = memoryview(data)
    size = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)
