"""Quality rules with cross-document line frequency.

Every line is normalised (ASCII case, white space) and hashed; for each host (source)
the distinct documents that carry a line are counted; lines above the limits are
removed, and a document that the removal depletes is rejected, besides the base rules
on length and repetition. A line is above the limits if more than LEAST_DOCS documents
of its host have it, and more than SHARE of the host's.

Documents are distinct by text: the copies of one text in a host are one document, so
a text that is copied often isn't taken for boilerplate. Near copies are documents of
their own (they are another operator's business).

A null or empty text has no words and fails the base rule; a null source is a host of
its own; lines without a word are never counted; very long texts are handled a slice
at a time; each row is judged by itself, also where doc_id is null or repeats (with
equal or other texts); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raceflow.llm import common as C

LEAST_WORDS, MOST_REPEATED = 20, 30
WINDOW = 8
#: A line is boilerplate above both; a document is depleted below either.
LEAST_DOCS, SHARE = 20, 0.02
KEPT_SHARE = 0.3

_SYMBOLS = b"#*$%&|<>"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def line_key(line: bytes) -> int | None:
    """Signed 64-bit hash of the normalised line; None without a word."""
    words = line.translate(_LOWER).split()
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(b" ".join(words))))) if words else None


def code_points(data: bytes) -> int:
    return len(data) - sum(map(data.count, _CONTINUATION)) if len(data) < 64 else int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


_CONTINUATION = [bytes([x]) for x in range(0x80, 0xC0)]


def repeated_words(words: list[bytes], h: np.ndarray) -> int:
    """Words in windows of WINDOW words (their hashes are h) that are found twice or more in the list."""
    if len(words) <= WINDOW:
        return 0
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    found = np.zeros(len(h), dtype=bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(found)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(depth[:-1]) > 0))


def duplicate_lines(data: bytes) -> int:
    lines = [x for x in data.split(b"\n") if x.strip(C.SPACES)]
    return len(lines) - len(set(lines))


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCHEMA = f"{C.ROW} long, host string, sig binary, {', '.join(f'{c} long' for c in _COUNTS)}, lines array<struct<key:bigint,words:int>>"
_ARROW = pa.schema(
    [(C.ROW, pa.int64()), ("host", pa.string()), ("sig", pa.binary())]
    + [(c, pa.int64()) for c in _COUNTS]
    + [("lines", pa.list_(pa.struct([("key", pa.int64()), ("words", pa.int32())])))]
)


def _lines(data: bytes) -> list[dict]:
    """Distinct line keys with their words in all."""
    out: Counter[int] = Counter()
    for line in data.split(b"\n"):
        key = line_key(line)
        if key is not None:
            out[key] += len(line.split())
    return [{"key": k, "words": min(n, 2**31 - 1)} for k, n in out.items()]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = C.WordHashes()
    for b in C.slices(batches, "text"):
        data = C.texts(b.column("text"))
        words = [x.split() for x in data]
        hashes = [C.windows(seen.of(w), WINDOW) for w in words]
        yield C.batch_of(
            _ARROW,
            **{C.ROW: b.column(C.ROW)},
            host=b.column("source"),
            n_words=[len(w) for w in words],
            word_chars=[code_points(x) - sum(map(x.count, _SPACE_BYTES)) for x in data],
            n_symbols=[len(x) - len(x.translate(None, _SYMBOLS)) for x in data],
            n_dup_lines=[duplicate_lines(x) for x in data],
            n_repeat_words=[repeated_words(w, h) for w, h in zip(words, hashes)],
            sig=[xxhash.xxh3_128_digest(x) for x in data],
            lines=[_lines(x) for x in data],
        )


_SPACE_BYTES = [bytes([x]) for x in C.SPACES]


def measured(rows: C.Rows) -> DataFrame:
    """The key, host, counts, digest of the text and distinct lines of every row."""
    return C.written(rows.only("text", "source").mapInArrow(C.tidy(_measured), _SCHEMA), "measured")


def frequent_lines(found: DataFrame, least_docs: int = LEAST_DOCS, share: float = SHARE) -> DataFrame:
    """host, key, n_docs of the lines above the limits."""
    texts = found.groupBy("host", "sig").agg(F.first("lines").alias("lines"))
    counts = texts.select("host", F.inline("lines")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > least_docs)
    hosts = found.groupBy("host", "sig").agg(F.lit(1)).groupBy(F.col("host").alias("h")).agg(F.count(F.lit(1)).alias("host_docs"))
    above = counts.join(hosts, F.col("host").eqNullSafe(F.col("h"))).where(F.col("n_docs") > share * F.col("host_docs"))
    return C.written(above.select("host", "key", "n_docs"), "frequent")


def judged(found: DataFrame, frequent: DataFrame) -> DataFrame:
    """The measured rows (without lines) with base_failed, kept, n_removed_lines, n_left_words, removed (keys)."""
    side = C.small(frequent.select(F.col("host").alias("h"), F.col("key").alias("k")), 64)
    hit = found.select(F.col(C.ROW).alias("r"), "host", F.inline("lines")).join(side, F.col("host").eqNullSafe(F.col("h")) & (F.col("key") == F.col("k")))
    lost = hit.groupBy("r").agg(F.sum("words").alias("lost"), F.collect_list("key").alias("removed"))
    out = found.drop("lines", "sig").join(lost, F.col(C.ROW) == F.col("r"), "left")
    words, left = F.col("n_words"), F.col("n_words") - F.coalesce("lost", F.lit(0))
    failed = (words < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * words)
    depleted = (left < LEAST_WORDS) | (left < KEPT_SHARE * words)
    more = [failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed_lines"), left.alias("n_left_words")]
    return out.select(C.ROW, *_COUNTS, *more, "removed")


def _assessed(rows: C.Rows, least_docs: int, share: float) -> DataFrame:
    found = measured(rows)
    return judged(found, frequent_lines(found, least_docs, share))


def assessed(docs: DataFrame, least_docs: int = LEAST_DOCS, share: float = SHARE) -> DataFrame:
    """doc_id, the counts, base_failed, kept, n_removed_lines, n_left_words, removed (line keys, or null) of every row."""
    rows = C.Rows(C.only(docs, "doc_id", "text", "source"))
    out = _assessed(rows, least_docs, share)
    if rows.unique:
        return out.withColumnRenamed(C.ROW, "doc_id")
    return rows.only("doc_id").join(out, C.ROW).drop(C.ROW)


def cut_lines(text: bytes, removed: set[int]) -> bytes:
    """The text without the lines whose key is removed."""
    return b"\n".join(x for x in text.split(b"\n") if line_key(x) not in removed)


def cleaned(docs: DataFrame, least_docs: int = LEAST_DOCS, share: float = SHARE) -> DataFrame:
    """The documents that are kept, with their frequent lines removed (and n_chars, if they have it, counted anew).

    Rows are judged one by one, so a null or repeated doc_id loses none; all columns come back; no rows give none.
    """
    keyed = C.Rows(docs)
    plan = _assessed(keyed, least_docs, share).where("kept").select(C.ROW, F.coalesce("removed", F.array().cast("array<bigint>")).alias("__removed"))
    names, text = keyed.names, keyed.name("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    at = names.index(text)
    kinds = [T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields)]
    rows = keyed.df.join(plan, C.ROW).drop(C.ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, text):
            removed = b.column("__removed").to_pylist()
            cols = [b.column(n) for n in names]
            if any(removed):
                cut = [None if x is None else cut_lines(x, {*r}) if r else x for x, r in zip(b.column(text).cast(pa.large_binary()).to_pylist(), removed)]
                cols[at] = pa.array(cut, pa.large_binary()).cast(pa.binary()).cast(pa.string()).cast(cols[at].type)
                if chars is not None:
                    new = [code_points(t) if r else n for t, r, n in zip(cut, removed, cols[chars].to_pylist())]
                    cols[chars] = pa.array(new, cols[chars].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    out = rows.mapInArrow(C.tidy(run), T.StructType(kinds))
    return keyed.back(out)


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessed(C.read(spark, sf_dir, "documents")).drop("removed")


_W = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_KEY = "array_to_string(" + _W.format("translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')") + ", ' ')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS body, {_W.format("text")} AS ws FROM documents),
w AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 6, 1))) AS i FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, md5(array_to_string(list_slice(ws, i, i + 7), ' '))) AS n FROM w),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM (SELECT doc_id, i, unnest(range(0, 8)) AS k FROM g WHERE n > 1) GROUP BY 1),
l AS (SELECT doc_id, source, md5(body) AS body, unnest(str_split(body, chr(10))) AS line FROM d),
k AS (SELECT doc_id, source, body, line, len({_W.format("line")}) AS words, {_KEY} AS key FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM k GROUP BY 1),
hosts AS (SELECT source, count(DISTINCT md5(body)) AS host_docs FROM d GROUP BY 1),
f AS (SELECT k.source, key FROM k JOIN hosts h ON k.source IS NOT DISTINCT FROM h.source
  GROUP BY k.source, key, host_docs HAVING count(DISTINCT body) > {LEAST_DOCS} AND count(DISTINCT body) > {SHARE}::DOUBLE * host_docs),
lost AS (SELECT doc_id, sum(words) AS lost, count(DISTINCT k.key) AS n_removed_lines FROM k JOIN f ON k.key = f.key AND k.source IS NOT DISTINCT FROM f.source GROUP BY 1),
m AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, len(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_removed_lines, 0)::INT AS n_removed_lines, (len(ws) - coalesce(lost, 0))::BIGINT AS n_left_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN lost USING (doc_id)),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_left_words >= {LEAST_WORDS} AND n_left_words >= {KEPT_SHARE}::DOUBLE * n_words AS kept, n_removed_lines, n_left_words FROM b
"""
