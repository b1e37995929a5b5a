"""Periodic runs of words by Crochemore's partition refinement.

The positions of a text's words are classed by equal factors, beginning with equal words;
each step makes the factors one word longer. A class splits by where its next words lie,
and only the smaller parts of a class that has split are looked at again, so a position is
moved about log n times. The members of a class are linked in order; where neighbouring
members lie exactly a factor's length apart, the factor stands twice in a row. Such
squares at adjoining positions are one run of that period.

A run is counted if it is long enough for POWER periods, so every word of it occurs POWER
times in it. Stretches between words that are rarer than that are found first (by hashes,
which can only keep too much) and refined one by one, on the words themselves. Classes
with too few members to be part of a run are left as they are.

Null text counts as empty: no runs, an empty collapsed text. A text of any length is one
sequence and is handled whole. Repeated rows and null or repeated doc_ids come out as they
come in; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from raceflow.llm import common as C

#: The least words of a run, and the least periods.
LEAST, POWER = 6, 4
#: Rounds in which rare words cut a text; what is left after them is refined as it is.
ROUNDS = 8

#: The original word that stands at each place of an edited text: (doc_id, words) -> places.
Edit = Callable[[int, int], np.ndarray]


class Words(C.BulkHashes):
    """Word hashes that tell upper from lower case."""

    def __init__(self):
        super().__init__()
        self.lower = np.arange(256, dtype=np.uint8)


class Partition:
    """Positions classed by equal factors of the present length, each class a linked list in order."""

    def __init__(self, words: list, most: int):
        n = len(words)
        self.most, self.level = most, 1
        self.next, self.prev, self.of = [-1] * n, [-1] * n, [0] * n
        self.head: list[int] = []
        self.tail: list[int] = []
        self.size: list[int] = []
        self.gaps: dict[int, set[int]] = {}
        classes: dict = {}
        for i, word in enumerate(words):
            if (c := classes.get(word)) is None:
                c = classes[word] = self._new()
            self._append(c, i)
        self.splitters = self._smaller(range(len(self.head)))

    def _new(self) -> int:
        self.head.append(-1)
        self.tail.append(-1)
        self.size.append(0)
        return len(self.head) - 1

    def _apart(self, i: int, j: int) -> None:
        """i and j are neighbours in a class from now on."""
        if self.level <= j - i <= self.most:
            self.gaps.setdefault(j - i, set()).add(i)

    def _append(self, c: int, i: int) -> None:
        last = self.tail[c]
        if last < 0:
            self.head[c] = i
        else:
            self.next[last] = i
            self._apart(last, i)
        self.prev[i], self.next[i], self.of[i], self.tail[c] = last, -1, c, i
        self.size[c] += 1

    def _take(self, c: int, i: int) -> None:
        before, after = self.prev[i], self.next[i]
        if before >= 0:
            self.next[before] = after
            if i - before in self.gaps:
                self.gaps[i - before].discard(before)
        else:
            self.head[c] = after
        if after >= 0:
            self.prev[after] = before
            if after - i in self.gaps:
                self.gaps[after - i].discard(i)
            if before >= 0:
                self._apart(before, after)
        else:
            self.tail[c] = before
        self.size[c] -= 1

    def members(self, c: int) -> list[int]:
        out, i = [], self.head[c]
        while i >= 0:
            out.append(i)
            i = self.next[i]
        return out

    def _smaller(self, parts) -> list[list[int]]:
        """The members of all parts of a class but its largest; parts too small for a run end being neighbours."""
        largest = max(parts, key=self.size.__getitem__, default=None)
        out = []
        for c in parts:
            small = self.size[c] < POWER - 1
            if c != largest or small:
                mine = self.members(c)
                if c != largest and mine:
                    out.append(mine)
                if small:
                    for i, j in zip(mine, mine[1:]):
                        if j - i in self.gaps:
                            self.gaps[j - i].discard(i)
        return out

    def longer(self) -> None:
        """Factors one word longer."""
        split: dict[int, list[int]] = {}
        end = len(self.of) - self.level  # the last factor that fits; it can't grow
        c = self.of[end]
        if self.size[c] >= POWER - 1:
            self._take(c, end)
            split[c] = []
            self.of[end] = lone = self._new()
            self.head[lone] = self.tail[lone] = end
            self.next[end] = self.prev[end] = -1
            self.size[lone] = 1
        self.level += 1
        alive, of = POWER - 1, self.of
        sizes = {}
        for part in self.splitters:
            made: dict[int, int] = {}
            for j in part:
                if not j or self.size[c := of[j - 1]] < alive and c not in sizes:
                    continue
                if (new := made.get(c)) is None:
                    new = made[c] = self._new()
                    split.setdefault(c, []).append(new)
                    sizes.setdefault(c, self.size[c])
                self._take(c, j - 1)
                self._append(new, j - 1)
        self.splitters = []
        for c, parts in split.items():
            self.splitters += self._smaller([c, *parts])


def squares(words: list, power: int = POWER) -> Iterator[tuple[int, list[int]]]:
    """Each period up to len(words) / power that has squares with a primitive root, and where they begin, in order."""
    most = len(words) // power
    if not most:
        return
    p = Partition(words, most)
    while True:
        if found := p.gaps.pop(p.level, None):
            yield p.level, sorted(found)
        if p.level == most or not p.gaps:  # a longer period would have more classes than a factor has words, so some gap would be longer than the factor
            return
        p.longer()


def runs(words: list, least: int = LEAST, power: int = POWER) -> list[tuple[int, int, int]]:
    """start, length, period of every maximal run of at least `least` words and `power` periods, by start, then period."""
    out = []
    for period, starts in squares(words, power):
        at = np.array(starts)
        cut = np.flatnonzero(np.diff(at) > 1) + 1
        for first, last in zip(at[np.r_[0, cut]].tolist(), at[np.r_[cut - 1, len(at) - 1]].tolist()):
            if (length := last - first + 2 * period) >= max(least, power * period):
                out.append((first, length, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def stretches(hashes: np.ndarray, least: int = LEAST, power: int = POWER) -> list[tuple[int, int]]:
    """The stretches (first, end) that can hold runs: at least `least` words, each `power` times in its stretch."""
    spans = [(0, len(hashes))] if len(hashes) >= least else []
    for _ in range(ROUNDS):
        out = []
        for a, b in spans:
            _, which, counts = np.unique(hashes[a:b], return_inverse=True, return_counts=True)
            common = np.concatenate([[False], counts[which] >= power, [False]])
            edge = np.flatnonzero(common[1:] != common[:-1]).tolist()
            out += [(a + s, a + e) for s, e in zip(edge[::2], edge[1::2]) if e - s >= least]
        if out == spans:
            break
        spans = out
    return spans


def analysed(data: bytes, hashes: np.ndarray, places: np.ndarray | None = None) -> tuple[list[tuple[int, int, int]], bytes]:
    """The runs of a text (of its words at `places`, if given) and its collapsed text: words, without those of a run after its first period."""
    spans = stretches(hashes if places is None else hashes[places])
    words = data.split()
    if places is not None:
        words = [words[i] for i in places.tolist()]
    found = [(a + start, length, period) for a, b in spans for start, length, period in runs(words[a:b])]
    if found:
        gone = np.zeros(len(words) + 1, dtype=np.int64)
        for start, length, period in found:
            gone[start + period] += 1
            gone[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
    return sorted(found, key=lambda r: (r[0], r[2])), b" ".join(words)


def _over(docs: DataFrame, row: Callable[[list, bytes], tuple], schema: pa.Schema, ddl: str, edit: Edit | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Words()
        for b in C.slices(batches, "text"):
            data, ids, rows = C.texts(b.column("text")), b.column("doc_id").to_pylist(), []
            for i, text, hashes in zip(ids, data, hasher.of(data)):
                places = edit(i, len(hashes)) if edit and i is not None and len(hashes) else None
                rows.append((i, *row(*analysed(text, hashes, places))))
            yield C.batch_of(schema, **dict(zip(schema.names, zip(*rows))))

    return C.only(docs, "doc_id", "text").mapInArrow(C.tidy(run), ddl)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def collapsed(docs: DataFrame, edit: Edit | None = None) -> DataFrame:
    """doc_id, runs, collapsed text of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])
    named = lambda found, text: ([dict(zip(("start", "length", "period"), r)) for r in found], text.decode())
    return _over(docs, named, schema, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string", edit)


def _digest(found: list[tuple[int, int, int]], text: bytes) -> tuple:
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{start},{length},{period}\n" for start, length, period in found)
    return len(found), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest()


def digests(docs: DataFrame, edit: Edit | None = None) -> DataFrame:
    """doc_id, n_runs, the run of the most periods, and digests of all runs and of the collapsed text, made where these are, of every row."""
    longs = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")
    schema = pa.schema([*((x, pa.int64()) for x in longs), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])
    return _over(docs, _digest, schema, ", ".join([*(f"{x} long" for x in longs), "runs_sha256 string", "collapsed_sha256 string"]), edit)


def planted(doc_id: int, n: int) -> np.ndarray | None:
    """The query's own edit: every tenth text by hash repeats a stretch of its words to its end."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(C.read(spark, sf_dir, "documents"), planted)
