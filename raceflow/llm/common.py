"""Helpers the training-data operators share.

Text is read as UTF-8 bytes straight from Arrow buffers, a bounded slice of a
batch at a time, so that one very long text never multiplies a batch's memory.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raceflow import shared
from raceflow.shipping import ship

#: Bytes of text that a Python worker handles at a time (a longer single text is handled alone).
SLICE_BYTES = 2 << 20
#: Bytes of the Arrow batches that Spark exchanges with Python workers.
BATCH_BYTES = 8 << 20
#: Serialized bytes up to which a side may be broadcast after its size has been measured.
BROADCAST_BYTES = 32 << 20
#: The white space of the word rule ``[^\x20\x09-\x0D]+``; also what bytes.split() splits on.
SPACES = b" \t\n\x0b\x0c\r"

U64 = np.uint64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Paths that were written and not yet discarded.
_cuts: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, which cuts() lists until it is discarded."""
    _cuts.append(shared.path(spark, name))
    return _cuts[-1]


def discard(spark: SparkSession, made: Sequence[str]) -> None:
    """Removes these paths of new_path(); only for callers whose results don't read them any more."""
    for path in made:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        _cuts.remove(path)


def cuts() -> tuple[str, ...]:
    """The paths that were written so far and not yet discarded."""
    return tuple(_cuts)


def written(df: DataFrame, name: str = "cut") -> DataFrame:
    """df as Parquet in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


ROW = "__row"


def numbers(df: DataFrame, key: str = "doc_id") -> bool:
    """Whether key is a number of its own for each row: no nulls, no repeats."""
    n, ids = df.agg(F.count(F.lit(1)), F.countDistinct(F.col(f"`{key}`"))).first()
    return n == ids


class Rows:
    """The rows of docs under names that clash with nothing (c0, c1, ...), with a key of their own in ROW.

    The key is doc_id where that is unique and never null. Else the rows are written once with numbers of their own, so
    that rows of one doc_id, or of none, are told apart.
    """

    def __init__(self, docs: DataFrame):
        prepare(docs.sparkSession)
        self.columns = docs.columns
        self.names = [f"c{i}" for i in range(len(self.columns))]
        rows = docs.toDF(*self.names)
        self.unique = numbers(docs)
        if self.unique:
            self.df = rows.withColumn(ROW, F.col(self.name("doc_id")).cast("long"))
        else:
            self.df = written(rows.withColumn(ROW, F.monotonically_increasing_id()), "rows")

    def name(self, column: str) -> str:
        return self.names[self.columns.index(column)]

    def only(self, *columns: str) -> DataFrame:
        """ROW and the named columns under their own names."""
        return self.df.select(ROW, *[F.col(self.name(c)).alias(c) for c in columns])

    def back(self, df: DataFrame, *more: str) -> DataFrame:
        """df's document columns under the names they came with, and after them the columns `more`."""
        return df.select(*[F.col(n).alias(c) for n, c in zip(self.names, self.columns)], *more)


#: A group above both is spread: at least so many rows, and more than this share of all rows (so there are at most 1 / share of them).
POPULAR_ROWS, POPULAR_SHARE = 1_000, 1e-5


def with_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """rows joined to their group (one row for each value of `on`, `size` being its rows).

    The large groups, at most 1 / POPULAR_SHARE of them, are broadcast, so their rows stay where they are; the rest are small
    and are shuffled.
    """
    large = F.col(size) > max(POPULAR_ROWS, int(total * POPULAR_SHARE))
    few = F.broadcast(groups.where(large))
    return rows.join(few, on).unionByName(rows.join(few.select(*on), on, "left_anti").join(groups.where(~large), on))


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows fit the limit, else as it is (a shuffled join)."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def prepare(spark: SparkSession) -> None:
    """Sends the package along, and keeps the Arrow batches of Python workers small."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.match(r"(\d+)b?$", spark.conf.get(key))
    if not now or not 0 < int(now[1]) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def only(docs: DataFrame, *cols: str) -> DataFrame:
    """The named columns alone: other columns, whatever their names, never meet the operator's own."""
    prepare(docs.sparkSession)
    return docs.select(*[F.col(f"`{c}`") for c in cols])


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def trim() -> None:
    """Gives memory that earlier tasks of this worker have freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which its memory goes back to the system: workers idle between stages beside others that need it."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return whole


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts have about `limit` bytes at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(column).cast(pa.large_binary())
        lengths = np.array([0 if x is None else x for x in pa.compute.binary_length(sizes).to_pylist()], dtype=np.int64)
        ends = np.cumsum(lengths)
        start, done = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start, done = stop, int(ends[stop - 1])


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser (a public-domain constant set) over uint64, wrapping."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


class WordHashes(dict):
    """word -> 64-bit hash, remembered for a bounded number of words."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class BulkHashes:
    """Hashes of all words of many texts at once: a word is a run of bytes that are no white space, A-Z counted as a-z.

    A word's hash is a polynomial of its bytes over 64 bits, from running sums, and mixed. Bytes are handled SEGMENT at a
    time, cut at white space.
    """

    SEGMENT = 1 << 21
    _base, _inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.space = np.zeros(256, bool)
        self.space[list(SPACES)] = True

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            one = lambda b: np.cumprod(np.r_[U64(1), np.full(n, b, np.uint64)], dtype=np.uint64)
            self.up, self.down = one(self._base), one(self._inverse)

    def _segment(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First bytes and hashes of the words."""
        a = self.lower[np.frombuffer(data, np.uint8)]
        blank = np.concatenate([[True], self.space[a], [True]])
        edge = np.flatnonzero(blank[1:] != blank[:-1])
        starts, ends = edge[::2], edge[1::2]
        self._powers(len(a) + 1)
        total = np.zeros(len(a) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((a.astype(np.uint64) + U64(1)) * self.up[: len(a)], dtype=np.uint64, out=total[1:])
            return starts, mix64((total[ends] - total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def of(self, texts: list[bytes]) -> list[np.ndarray]:
        """The word hashes of each text."""
        data = b"\n".join(texts)
        parts, at = [], 0
        while at < len(data):
            end = min(at + self.SEGMENT, len(data))
            while end < len(data) and not self.space[data[end]]:
                end += 1
            starts, hashes = self._segment(data[at:end])
            parts.append((starts + at, hashes))
            at = end
        if not parts:
            return [np.zeros(0, np.uint64) for _ in texts]
        starts, hashes = (np.concatenate(x) for x in zip(*parts))
        firsts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        cuts = np.searchsorted(starts, firsts)
        return [hashes[a:b] for a, b in zip(cuts, cuts[1:])]


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every run of n entries (order counts); empty if there are fewer."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
        for k in range(n):
            out = out * U64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - n + 1 + k]
    return mix64(out)


def batch_of(schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in schema], schema=schema)
