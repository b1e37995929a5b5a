"""Language identification by rank-order profiles.

A profile is the list of the most frequent letter n-grams (1 to 3, word ends marked) of
the training texts of a language; a document's own list is compared to each profile by
out-of-place distance: how far each of its n-grams is from its place there, or the
profile's length if it is missing. The least distance wins.

Profiles are learnt from text and non-null lang of documents whose crc32(doc_id) modulo
3 is not 1; beyond SAMPLE such rows, a hashed share of about SAMPLE rows is read (the
bound of the fit). Every document is predicted from its whole text.

Null text, or text without a letter, is `und` with score 0; so is every text if there
was nothing to learn from. Ties between languages go to the first by name. A null doc_id
counts as the empty string. Rows repeat as they come; other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from raceflow.llm import common as C

#: Entries of a profile; training rows read at most (about); n-gram lengths.
PROFILE, SAMPLE = 400, 20_000
_BITS = np.uint64(21)


@cache
def _letters() -> np.ndarray:
    """Lower-case code point of each letter, 0 for what is no letter."""
    out = np.zeros(sys.maxunicode + 1, dtype=np.uint32)
    for i in range(sys.maxunicode + 1):
        ch = chr(i)
        if ch.isalpha():
            low = ch.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def grams(data: bytes) -> np.ndarray:
    """Codes of the letter n-grams of a text; words are set apart by one mark (0), which single grams leave out."""
    text = data.decode("utf-8", "replace")
    points = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)]
    marked = np.r_[np.uint32(0), points, np.uint32(0)]
    keep = np.r_[True, (marked[1:] != 0) | (marked[:-1] != 0)]
    s = marked[keep].astype(np.uint64)
    if len(s) < 3:
        return np.zeros(0, dtype=np.uint64)
    two = (s[:-1] << _BITS) | s[1:]
    three = (two[:-1] << _BITS) | s[2:]
    tag = np.uint64(1) << np.uint64(63)  # keeps "0a" apart from "a"
    return np.concatenate([s[s > 0], two | tag, three[s[1:-1] > 0]])


def ranked(data: bytes, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams of a text in order; equals by code."""
    codes, counts = np.unique(grams(data), return_counts=True)
    return codes[np.lexsort((codes, -counts))[:most]]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in C.slices(batches, "text"):
        langs = b.column("lang").to_pylist()
        parts: dict[str, list[np.ndarray]] = {}
        for lang, data in zip(langs, C.texts(b.column("text"))):
            parts.setdefault(lang, []).append(grams(data))
        for lang, found in parts.items():
            codes, counts = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "code", "n"])


def remainder(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3


def learn(docs: DataFrame, sample: int = SAMPLE, most: int = PROFILE) -> dict[str, np.ndarray]:
    """The profile of each language of the training rows."""
    rows = C.only(docs, "doc_id", "text", "lang").where((remainder() != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = rows.count()
    if n > sample:
        rows = rows.where(F.pmod(F.xxhash64(F.lit("profile"), "doc_id"), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    counts = rows.select("lang", "text").mapInArrow(C.tidy(_counted), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    top = counts.withColumn("place", place).where(F.col("place") <= most).select("lang", "place", "code").collect()
    out: dict[str, list[tuple[int, int]]] = {}
    for lang, at, code in top:
        out.setdefault(lang, []).append((at, code))
    return {lang: np.array([c for _, c in sorted(x)], dtype=np.int64).view(np.uint64) for lang, x in sorted(out.items())}


class Model:
    def __init__(self, profiles: dict[str, np.ndarray], most: int = PROFILE):
        self.names, self.most = list(profiles), most
        self.codes = np.unique(np.concatenate([np.zeros(0, np.uint64), *profiles.values()]))
        self.places = np.full((len(self.names), len(self.codes) + 1), -1, dtype=np.int64)
        for k, codes in enumerate(profiles.values()):
            self.places[k, np.searchsorted(self.codes, codes)] = np.arange(len(codes))

    def predict(self, data: bytes) -> tuple[str, float]:
        own = ranked(data, self.most)
        if not len(own) or not self.names:
            return "und", 0.0
        at = np.searchsorted(self.codes, own)
        known = (at < len(self.codes)) & (self.codes[np.minimum(at, len(self.codes) - 1)] == own)
        places = self.places[:, np.where(known, at, len(self.codes))]
        off = np.where(places >= 0, np.abs(places - np.arange(len(own))), self.most).sum(axis=1)
        best = int(np.argmin(off))
        if len(off) == 1:
            return self.names[0], float(1 - off[0] / (self.most * len(own)))
        rest = int(np.partition(off, 1)[1])
        return self.names[best], float((rest - off[best]) / rest) if rest else 0.0


def identified(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    names, codes = list(profiles), list(profiles.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(dict(zip(names, codes)))
        for b in C.slices(batches, "text"):
            found = [model.predict(x) for x in C.texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    out = C.only(docs, "doc_id", "text").mapInArrow(C.tidy(run), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (remainder() == 1).alias("held_out"), "lang_pred", "score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    return identified(docs, learn(docs))
