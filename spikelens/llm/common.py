"""Shared pieces: table access, shared storage, text batches as byte arrays, vectorised hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from spikelens.functions.dist import pin, settle, shared_dir

__all__ = ["Pieces", "file_count", "pieces", "pin", "powers", "settle", "shuffled", "stored", "table", "mix", "word_hashes",
           "text_key"]

CHUNK = 1 << 21  # bytes handled at once in a task
ROWS_PER_FILE = 4000
_ODD = 0x9E3779B97F4A7C15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, files: int = 0) -> DataFrame:
    """``df`` computed once into a Parquet table in the shared folder, and read back: no lineage left.

    For narrow tables ``files`` is the most tasks that write one, as a file costs an executor more than its rows do: on a
    local file system Hadoop starts a ``chmod`` process for each.
    """
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df = df.coalesce(files) if files else df
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that goes by shuffles, so that neither side is broadcast through the driver.

    For sides whose rows follow the corpus and have no shuffle of their own that Spark could measure: it guesses them by
    the compressed size of stored files, counts an ``explode`` above as nothing, and broadcasts many times its bound.
    """
    return df.hint("merge")


def file_count(rows: int, spark: SparkSession) -> int:
    """Files for a narrow table made of so many documents: one per ``ROWS_PER_FILE``, and one per core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_FILE))


def text_key(column="text"):
    """128-bit key of a text (null counts as empty)."""
    from pyspark.sql import functions as F

    return F.unhex(F.md5(F.coalesce(F.col(column), F.lit("")).cast("binary")))


class Pieces:
    """Some texts laid end to end. ``row[i]`` is the batch row of piece i, ``base[i]`` its first byte within
    its text, ``start[i]:end[i]`` its place in ``data``. Only texts over ``CHUNK`` bytes have several pieces."""

    def __init__(self, data, row, base, start, end):
        self.data, self.row, self.base, self.start, self.end = data, row, base, start, end


def _bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def pieces(column, chunk: int = CHUNK) -> Iterator[Pieces]:
    """Whole texts of an Arrow column in groups of about ``chunk`` bytes; a longer text comes alone and whole."""
    data, at = _bytes_of(column)
    n, lo = len(at) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + chunk, "right")) - 1)
        part = at[lo : hi + 1] - at[lo]
        yield Pieces(data[at[lo] : at[hi]], np.arange(lo, hi), np.zeros(hi - lo, np.int64), part[:-1], part[1:])
        lo = hi


@cache
def _table256() -> np.ndarray:
    return np.random.default_rng(20240611).integers(1, 2**63, 256, np.uint64)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        _POWERS[base] = have = np.multiply.accumulate(out)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit integers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _table256()[data]


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` neighbouring values; one per start that has ``k`` values."""
    n = len(values)
    if n < k:
        return np.zeros(0, np.uint64)
    base = _ODD | 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(base, n), out=total[1:])
    return mix((total[k:] - total[:-k]) * powers(pow(base, -1, 2**64), n - k + 1))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, gap: np.ndarray = SPACE):
    """Byte spans of words (runs of bytes outside ``gap``, never across pieces) and, per piece, its first word;
    the last entry is the number of words."""
    inside = ~gap[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[start] = edge[end] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    return a, b, np.append(np.searchsorted(a, start), len(a))


def word_hashes(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of every byte span, from prefix sums over the whole array."""
    if not len(a):
        return np.zeros(0, np.uint64)
    base, n = 0xD1342543DE82EF95, len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_table256()[data] * powers(base, n), out=total[1:])
    return mix((total[b] - total[a]) * powers(pow(base, -1, 2**64), n)[a] + (b - a).astype(np.uint64))
