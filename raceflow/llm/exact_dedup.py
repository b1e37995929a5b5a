"""Exact dedup by content-defined chunk recipes.

A text is cut where a rolling hash of its last bytes says so, each chunk gets a
digest, and a text's recipe is the ordered list of its chunk digests. Equal texts
have equal recipes, so a text whose recipe nobody shares is settled without its
bytes ever leaving the scan. The chunks of the others are deduplicated (combined
before the shuffle) and every digest is verified to stand for one byte string; the
ordered lists of verified identifiers then decide. Should two chunks ever share a
digest, the recipes are made again with the next, wider digest.

Null text counts as empty; empty texts are equal; a very long text is a long recipe;
rows repeated with one doc_id and one text count in group_size and share one decision;
rows of one doc_id with other texts are told apart; a null doc_id is kept only where
no row of the text has another; an empty table gives an empty result; other columns are
ignored. A text of very many copies isn't one task: the few large groups are broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raceflow.llm import common as C

#: Bytes that the rolling hash sees, and the least, mean (a power of two) and greatest bytes of a chunk.
WINDOW, LEAST, MEAN, MOST = 48, 512, 2048, 16384
#: Digests in order of use: the next one only after a verified collision.
DIGESTS: tuple[Callable[[bytes], bytes], ...] = (
    lambda b: xxhash.xxh3_128_digest(b),
    lambda b: hashlib.sha256(b).digest(),
    lambda b: hashlib.sha512(b).digest(),
)

_P = 0x9E3779B97F4A7C15
_INV = pow(_P, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[C.U64(1), np.full(n - 1, base, dtype=np.uint64)], dtype=np.uint64)


def cuts(data: bytes, powers: dict[str, np.ndarray] | None = None) -> list[int]:
    """Ends of the chunks of data; they depend on nearby bytes only, but for the least and greatest length."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    powers = {} if powers is None else powers
    if len(powers.get("up", ())) < n + 1:
        powers["up"], powers["down"] = _powers(_P, n + 1024), _powers(_INV, n + 1024)
    with np.errstate(over="ignore"):
        total = np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + C.U64(1)) * powers["up"][:n], dtype=np.uint64)
        seen = (total[WINDOW:] - total[:-WINDOW]) * powers["down"][: n - WINDOW]
    marks = np.flatnonzero((C.mix64(seen) & C.U64(MEAN - 1)) == 0) + WINDOW + 1
    out, last = [], 0
    while n - last > LEAST:
        i = int(np.searchsorted(marks, last + LEAST))
        end = min(int(marks[i]) if i < len(marks) else n, last + MOST, n)
        out.append(end)
        last = end
    if last < n:
        out.append(n)
    return out


def chunks(data: bytes, powers: dict[str, np.ndarray] | None = None) -> list[bytes]:
    start, out = 0, []
    for end in cuts(data, powers):
        out.append(data[start:end])
        start = end
    return out


_RECIPES = pa.schema([(C.ROW, pa.int64()), ("doc_id", pa.int64()), ("text_sha256", pa.string()), ("recipe", pa.list_(pa.binary())), ("key", pa.binary())])
_CHUNKS = pa.schema([("digest", pa.binary()), ("chunk", pa.binary())])


def _recipes(digest: Callable[[bytes], bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers: dict[str, np.ndarray] = {}
        for b in C.slices(batches, "text"):
            data = C.texts(b.column("text"))
            made = [[digest(c) for c in chunks(x, powers)] for x in data]
            yield C.batch_of(
                _RECIPES,
                **{C.ROW: b.column(C.ROW)},
                doc_id=b.column("doc_id"),
                text_sha256=[hashlib.sha256(x).hexdigest() for x in data],
                recipe=made,
                key=[hashlib.sha256(b"".join(x)).digest() for x in made],
            )

    return run


def _contents(digest: Callable[[bytes], bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers: dict[str, np.ndarray] = {}
        for b in C.slices(batches, "text"):
            found = {(digest(c), c) for x in C.texts(b.column("text")) for c in chunks(x, powers)}
            yield C.batch_of(_CHUNKS, digest=[d for d, _ in found], chunk=[c for _, c in found])

    return run


def recipes(rows: DataFrame, digests=DIGESTS) -> DataFrame:
    """The key, doc_id, text_sha256, recipe (ordered verified chunk identifiers), key (a digest of the recipe: groups are found by lists and looked up by it, so no list is broadcast) of every row (its key, doc_id, text)."""
    for k, digest in enumerate(digests):
        made = C.written(rows.mapInArrow(C.tidy(_recipes(digest)), f"{C.ROW} long, doc_id long, text_sha256 string, recipe array<binary>, key binary"), "recipes")
        shared = made.groupBy("recipe").agg(F.count(F.lit(1)).alias("n"), F.first("key").alias("key")).where("n > 1 and size(recipe) > 0").select("key", "n")
        total = made.count()
        again = C.written(C.with_groups(made.where("size(recipe) > 0"), shared, ["key"], "n", total).select(C.ROW), "shared")
        bytes_of = rows.join(C.small(again, 16), C.ROW, "left_semi").select("text").mapInArrow(C.tidy(_contents(digest)), "digest binary, chunk binary")
        clash = bytes_of.groupBy("digest").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).where("a <> b")
        if clash.isEmpty():
            return made
    raise RuntimeError(f"every one of {k + 1} digests had a verified collision")


def _grouped(rows: DataFrame, digests=DIGESTS) -> DataFrame:
    """The recipes with keep_id, keep_row (the one row that stays of each text) and group_size."""
    made = recipes(rows, digests)
    best = F.max(F.struct("doc_id", C.ROW))
    heads = made.groupBy("recipe").agg(best["doc_id"].alias("keep_id"), best[C.ROW].alias("keep_row"), F.count(F.lit(1)).alias("group_size"), F.first("key").alias("key")).drop("recipe")
    return C.with_groups(made, C.written(heads, "heads"), ["key"], "group_size", made.count())


def groups(docs: DataFrame, digests=DIGESTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; the largest doc_id of equal texts stays."""
    out = _grouped(C.Rows(C.only(docs, "doc_id", "text")).only("doc_id", "text"), digests)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of docs for each text, with all its columns: of equal texts one with the largest doc_id."""
    keyed = C.Rows(docs)
    gone = _grouped(keyed.only("doc_id", "text")).where(F.col(C.ROW) != F.col("keep_row")).select(C.ROW)
    return keyed.back(keyed.df.join(gone, C.ROW, "left_anti"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(C.read(spark, sf_dir, "documents"))


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256
FROM t JOIN g ON t.body = g.body
"""
