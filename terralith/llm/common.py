"""What the operators share: written intermediate tables and hashing of words in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.intermediate import shared_dir, written  # noqa: F401

#: Text handled by numpy at once; a longer document is a block of its own.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(doc_id: str, *others: str) -> F.Column:
    """Tells rows of one id apart by their content, so that repeated ids never mix up texts."""
    return F.xxhash64(F.col(doc_id), *(F.col(c) for c in others))


# Words and their hashes -----------------------------------------------------------------

_U = np.uint64
_BASE, _STEP = _U(0x9E3779B97F4A7C15), _U(0xD1342543DE82EF95)
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        up = np.empty(max(n, 1 << 16), np.uint64)
        down = np.empty(len(up), np.uint64)
        for out, b in ((up, int(base)), (down, pow(int(base), -1, 1 << 64))):
            out[0], done = 1, 1
            while done < len(out):
                step = min(done, len(out) - done)
                out[done : done + step] = out[:step] * _U(pow(b, done, 1 << 64))
                done += step
        have = _POWERS[int(base)] = (up, down)
    return have[0][:n], have[1][:n]


def rolling(values: np.ndarray, k: int, base: np.uint64 = _STEP) -> np.ndarray:
    """Rabin-Karp hash modulo 2**64 of every k consecutive values, from one prefix sum."""
    n = len(values)
    if n < k:
        return np.empty(0, np.uint64)
    up, down = _powers(base, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1])


def words(data: np.ndarray, cuts: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word [^\\x20\\x09-\\x0D]+ in data, and how many words each text has.

    Text i is data[cuts[i]:cuts[i + 1]]. A word never spans two texts.
    """
    if lower:
        data = _LOWER[data]
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~_GAP[data]
    edge = np.diff(solid)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    inner = cuts[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(data))])
    inner = inner[(solid[inner] == 1) & (solid[inner + 1] == 1)]  # texts that touch
    if len(inner):
        starts, ends = np.sort(np.r_[starts, inner]), np.sort(np.r_[ends, inner])
    up, down = _powers(_BASE, len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * up[: len(data)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return starts, ends, hashes, np.diff(np.searchsorted(starts, cuts))


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with about `most` bytes of text: the rows, the bytes, and where each row's text begins (null: empty)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if not pa.types.is_large_binary(column.type):
            column = column.cast(pa.large_binary())
        if not len(column):
            continue
        _, where, data = column.buffers()
        at = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
        if column.null_count:  # a null may cover bytes
            sizes = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.diff(at))
            data = np.concatenate([data[a : a + n] for a, n in zip(at, sizes)] or [data])
            at = np.r_[0, np.cumsum(sizes)]
        first = 0
        while first < len(column):
            last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
            yield batch.slice(first, last - first), data[at[first] : at[last]], at[first : last + 1] - at[first]
            first = last
