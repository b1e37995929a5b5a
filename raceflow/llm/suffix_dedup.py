"""Removal of repeated byte strings by a distributed merge sort of anchored suffixes.

A string of SHORT bytes that occurs twice has, in each of its occurrences, the same
anchor: the place of the least hash among its GRAM-byte substrings (leftmost of
equals). So only suffixes that begin at anchors need to be sorted, about one in 113,
and of these only the ones whose anchor substring occurs again.

An entry is an anchor with its right context, its left context and the range of
window starts (as distances d from the anchor, to the left) that it stands for. Scan
tasks sort their entries and write them as front-coded runs: the length of the prefix
that an entry shares with the one before, and the rest. Entries of different texts that
are equal in all contexts are settled there and travel once. Each merging task combines
the runs of its buckets with a loser tree whose nodes keep the prefix that a candidate
shares with the last winner; candidates are compared beyond that only. The merged order
and its shared prefixes give, for every d, the classes of entries with equal right
context; entries of a class with equal left context are windows that occur again: windows
of LENGTH bytes, which are removed, and windows of SHORT bytes that another text has,
which are reported as passages (about 50 words are 300 bytes, less than LENGTH).

An anchor substring with more than HOT entries isn't sorted in one task. Its entries
(equal ones settled by the scan tasks) are cut into parts of PART window starts; windows
of a part share a core around the anchor, and cores are counted with partial sums, so
unlike surroundings go. The windows of the parts that are left are counted by 128-bit
hashes the same way, and what is frequent is broadcast back. So no task holds the documents
that have one passage.

Null text counts as empty; texts under LENGTH bytes lose nothing; very long texts are
hashed in overlapping segments; repeated strings within one text count and overlap;
rows repeated with one doc_id, or without one, are separate texts; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raceflow.llm import common as C

#: Bytes of the strings that are removed, of those that make a passage, and of an anchor substring.
LENGTH, SHORT, GRAM = 400, 256, 32
#: Entries of an anchor substring beyond which they aren't sorted in one task, and the window starts of a part.
HOT, PART = 20_000, 32
#: Entries of a merging bucket, and context bytes that a scan task sorts at a time.
BUCKET, RUN_BYTES = 20_000, 32 << 20
#: Window starts that are hashed at a time.
SEGMENT = 1 << 21

_P = 0x9E3779B97F4A7C15
_INV = pow(_P, -1, 1 << 64)


class Hasher:
    """64-bit hashes of all GRAM-byte substrings of a text."""

    def __init__(self):
        self.up = self.down = np.ones(0, np.uint64)

    def __call__(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if n < GRAM:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            if len(self.up) < n:
                one = lambda b: np.cumprod(np.r_[C.U64(1), np.full(n + n // 2, b, np.uint64)], dtype=np.uint64)
                self.up, self.down = one(_P), one(_INV)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + C.U64(1)) * self.up[:n], dtype=np.uint64, out=total[1:])
            return C.mix64((total[GRAM:] - total[:-GRAM]) * self.down[: n - GRAM + 1])


def anchors(data: bytes, hasher: Hasher) -> tuple[np.ndarray, ...]:
    """hash, place, first and last window start of every anchor of a text."""
    every = np.frombuffer(data, np.uint8)
    starts = len(data) - SHORT + 1
    found: list[tuple[np.ndarray, ...]] = []
    for s in range(0, max(starts, 0), SEGMENT):
        count = min(SEGMENT, starts - s)
        h = hasher(every[s : s + count - 1 + SHORT])
        low = (h & ~C.U64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
        width, need = 1, SHORT - GRAM + 1
        while width < need:  # least of each window, by doubling
            step = min(width, need - width)
            low = np.minimum(low[: len(low) - step], low[step:])
            width += step
        at = (low & C.U64((1 << 24) - 1)).astype(np.int64)
        edge = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        first, last = edge, np.r_[edge[1:], count] - 1
        found.append((h[at[edge]].view(np.int64), at[edge] + s, first + s, last + s))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found))


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    kind = pa.list_(pa.int64())
    for b in C.slices(batches, "text"):
        data = C.texts(b.column("text"))
        found = [anchors(x, hasher) for x in data]
        cols = [b.column("row"), b.column("doc_id"), pa.array(map(len, data), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in data])]
        cols += [pa.array([f[k] for f in found], kind) for k in range(4)]
        yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "n_bytes", "sha", "h", "at", "first", "last"])


_ANCHORS = "row long, doc_id long, n_bytes long, sha string, h array<long>, at array<long>, first array<long>, last array<long>"


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of a and b, of which `known` bytes are known."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    step = 16
    while a[known : known + step] == b[known : known + step]:
        known += step
        step *= 2
    while step > 1:
        step >>= 1
        if a[known : known + step] == b[known : known + step]:
            known += step
    return known


# An entry: (key and right context, left context nearest byte first, row, place, least d, greatest d, settled, more). Settled:
# a scan task has dropped an equal entry of another row. More: the places of equal entries of the same row.
Entry = tuple[bytes, bytes, int, int, int, int, int, list[int]]


def pack(entries: list[Entry]) -> bytes:
    """A front-coded run of sorted entries."""
    n = len(entries)
    lcps, left = np.zeros((2, n), np.int32), np.zeros((2, n), np.int32)
    rest, left_rest = [], []
    before = (b"", b"")
    for i, e in enumerate(entries):
        p, q = shared(before[0], e[0]), shared(before[1], e[1])
        lcps[:, i], left[:, i] = (p, len(e[0]) - p), (q, len(e[1]) - q)
        rest.append(e[0][p:])
        left_rest.append(e[1][q:])
        before = e
    rows, nums = np.array([e[2] for e in entries], np.int64), np.array([(*e[3:7], len(e[7])) for e in entries], np.int64).astype(np.int32)
    more = np.array([x for e in entries for x in e[7]], np.int32)
    body = b"".join([lcps.tobytes(), left.tobytes(), rows.tobytes(), nums.tobytes(), more.tobytes(), *rest, *left_rest])
    return struct.pack("<I", n) + zstandard.ZstdCompressor(level=3).compress(body)


def unpack(blob: bytes) -> tuple[list[Entry], list[int]]:
    """The entries of a run, and the prefix that each shares with the one before."""
    (n,) = struct.unpack_from("<I", blob)
    body = zstandard.ZstdDecompressor().decompress(blob[4:])
    lcps = np.frombuffer(body, np.int32, 2 * n).reshape(2, n)
    left = np.frombuffer(body, np.int32, 2 * n, 8 * n).reshape(2, n)
    rows = np.frombuffer(body, np.int64, n, 16 * n).tolist()
    nums = np.frombuffer(body, np.int32, 5 * n, 24 * n).reshape(n, 5)
    ends = np.cumsum(nums[:, 4]).tolist()
    more = np.frombuffer(body, np.int32, ends[-1] if n else 0, 44 * n).tolist()
    at = 44 * n + 4 * len(more)
    at2 = at + int(lcps[1].sum())
    out, a, b = [], b"", b""
    for p, k, q, l, row, num, end in zip(*lcps.tolist(), *left.tolist(), rows, nums.tolist(), ends):
        a, b = a[:p] + body[at : at + k], b[:q] + body[at2 : at2 + l]
        at, at2 = at + k, at2 + l
        out.append((a, b, row, *num[:4], more[end - num[4] : end]))
    return out, lcps[0].tolist()


def merged(runs: list[tuple[list[Entry], list[int]]]) -> tuple[list[Entry], list[int]]:
    """All entries in order and the prefix that each shares with the one before, by a loser tree over the runs.

    A waiting entry's known prefix is the one that it shares with the last winner: of two, the
    longer known prefix is the lesser entry; only entries of equal known prefix are compared, from there on.
    """
    if len(runs) == 1:
        return runs[0]
    k = 1
    while k < len(runs):
        k *= 2
    place = [0] * len(runs)
    known = [0] * k
    losers = [-1] * k
    done = [i >= len(runs) or not runs[i][0] for i in range(k)]

    def less(i: int, j: int) -> tuple[int, int]:
        """(winner, loser) of the current entries of runs i and j; the loser's known prefix is then the one with the winner."""
        if done[j]:
            return i, j
        if done[i]:
            return j, i
        p, q = known[i], known[j]
        if p > q:
            return i, j
        if q > p:
            return j, i
        a, b = runs[i][0][place[i]][0], runs[j][0][place[j]][0]
        c = shared(a, b, p)
        if a[c : c + 1] <= b[c : c + 1]:
            known[j] = c
            return i, j
        known[i] = c
        return j, i

    winners = list(range(k))
    level = k
    while level > 1:  # play the first round from the leaves up
        level //= 2
        nxt = []
        for x in range(level):
            w, lost = less(winners[2 * x], winners[2 * x + 1])
            losers[level + x] = lost
            nxt.append(w)
        winners = nxt
    w = winners[0]
    out, lcps = [], []
    while not done[w]:
        entries, own = runs[w]
        out.append(entries[place[w]])
        lcps.append(known[w])
        place[w] += 1
        if place[w] < len(entries):
            known[w] = own[place[w]]  # shared with the entry before it in its run, the last winner
        else:
            done[w] = True
        x = (k + w) // 2
        while x:
            w, losers[x] = less(w, losers[x])
            x //= 2
    return out, lcps


def repeated(entries: list[Entry], lcps: list[int]) -> list[tuple[int, int, int, int]]:
    """(row, first, last window start, kind) of the windows of sorted entries that occur again among them; kind 0: LENGTH bytes, 1: SHORT bytes in another row."""
    n = len(entries)
    lcp = np.array(lcps, np.int64) - 8
    right = np.array([len(e[0]) for e in entries], np.int64) - 8
    row, place, low, high, settled = np.array([e[2:7] for e in entries], np.int64).T
    more = np.array([bool(e[7]) for e in entries])
    most = int(high.max())
    left = np.zeros((most, n), np.uint8)
    lengths = np.array([len(e[1]) for e in entries])
    flat = np.frombuffer(b"".join(e[1] for e in entries), np.uint8)
    if len(flat):
        who = np.repeat(np.arange(n), lengths)
        left[np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths), who] = flat
    again = np.zeros((2, most + 2, n), bool)  # one empty row after the last
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for d in range(most + 1):
            if d:
                h = C.mix64(h * C.U64(_P) + left[d - 1].astype(np.uint64) + C.U64(1))
            here = np.flatnonzero((low <= d) & (d <= high))
            for kind, length in ((0, LENGTH), (1, SHORT)):
                act = here[right[here] >= LENGTH - d] if kind == 0 else here
                if not len(act):
                    continue
                keys = C.mix64(h[act] + np.cumsum(lcp < length - d)[act].astype(np.uint64) * C.U64(_INV))
                order = np.argsort(keys)
                sorted_keys = keys[order]
                same = np.flatnonzero(sorted_keys[1:] == sorted_keys[:-1])
                one, two = act[order[same]], act[order[same + 1]]
                again[kind, d, act[(settled[act] == 1) | (more[act] if kind == 0 else False)]] = True
                if kind == 1 and len(same):
                    differ = row[one] != row[two]
                    if not differ.all():  # a row has some window more than once: whole classes
                        who = act[order]
                        first = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
                        other = (np.minimum.reduceat(row[who], first) != np.maximum.reduceat(row[who], first)) | (np.maximum.reduceat(settled[who], first) > 0)
                        again[kind, d, who[np.repeat(other, np.diff(np.r_[first, len(who)]))]] = True
                    one, two = one[differ], two[differ]
                again[kind, d, one] = True
                again[kind, d, two] = True
    out = []
    for kind in (0, 1):
        edges = np.diff(np.concatenate([np.zeros((1, n), bool), again[kind]]).astype(np.int8), axis=0).T
        who, begin = np.nonzero(edges == 1)
        _, end = np.nonzero(edges == -1)
        out += [(entries[i][2], at - e + 1, at - b, kind) for i, b, e in zip(who.tolist(), begin.tolist(), end.tolist()) for at in (entries[i][3], *entries[i][7])]
    return out


def _entries(row: int, data: bytes, hs, ats, firsts, lasts) -> Iterator[Entry]:
    for h, at, first, last in zip(hs, ats, firsts, lasts):
        yield struct.pack(">q", h) + data[at : at + LENGTH - (at - last)], data[first:at][::-1], row, at, at - last, at - first, 0, []


def _settle(entries: list[Entry], gather: bool = True) -> tuple[list[Entry], list[tuple[int, int, int, int]]]:
    """The entries in order, but equal ones of different rows (and, to gather, of one row) once; and the ranges (row, first, last, kind) that this settles."""
    entries.sort()
    kept, found = [], []
    for e in entries:
        last = kept[-1] if kept else None
        if last is None or last[0] != e[0] or last[1] != e[1] or last[4:6] != e[4:6] or (last[2] == e[2] and not gather):
            kept.append(e)
        elif last[2] == e[2]:
            last[7].append(e[3])
        else:
            kept[-1] = (*last[:6], 1, last[7])
            found += _ranges(e)
    return kept, found


def _ranges(e: Entry) -> list[tuple[int, int, int, int]]:
    """All windows of an entry, by kind."""
    first, last = e[3] - e[5], e[3] - e[4]
    whole = min(last, e[3] + len(e[0]) - 8 - LENGTH)
    return [(e[2], first, last, 1)] + ([(e[2], first, whole, 0)] if whole >= first else [])


_HOT = pa.schema([("row", pa.int64()), ("at", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("left", pa.binary()), ("right", pa.binary()), ("settled", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("kind", pa.int64())])
_HOT_DDL = "row long, at long, low long, high long, left binary, right binary, settled long, first long, last long, kind long"
_RUNS = pa.schema([("bucket", pa.int64()), ("run", pa.binary()), *_HOT])
_RUNS_DDL = f"bucket long, run binary, {_HOT_DDL}"


def _merged_ranges(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The same windows in as few ranges (row, first, last, kind): those of neighbouring anchors of a row become one."""
    out: list[tuple[int, int, int, int]] = []
    for row, first, last, kind in sorted(found, key=lambda x: (x[0], x[3], x[1])):
        if out and out[-1][0] == row and out[-1][3] == kind and first <= out[-1][2] + 1:
            out[-1] = (row, out[-1][1], max(last, out[-1][2]), kind)
        else:
            out.append((row, first, last, kind))
    return out


def _batch(schema: pa.Schema, **cols: list) -> pa.RecordBatch:
    """A batch of these columns, all others null."""
    n = len(next(iter(cols.values())))
    return C.batch_of(schema, **{x: cols.get(x, [None] * n) for x in schema.names})


def sorted_runs(entries: list[Entry], hot: list[Entry], buckets: int) -> Iterator[pa.RecordBatch]:
    """One front-coded run for each bucket, the windows that equal entries settle, and very frequent entries as they are, dealt to all buckets."""
    kept, found = _settle(entries)
    by: dict[int, list[Entry]] = {}
    for e in kept:
        by.setdefault(int.from_bytes(e[0][:8], "big") % buckets, []).append(e)
    yield _batch(_RUNS, bucket=list(by), run=[*map(pack, by.values())])
    kept, more = _settle(hot, gather=False)
    found = _merged_ranges(found + more + [x for e in kept if e[6] for x in _ranges(e)])
    names = ("row", "first", "last", "kind")
    yield _batch(_RUNS, bucket=[x[0] % buckets for x in found], **{c: [x[k] for x in found] for k, c in enumerate(names)})
    plain = {"row": [e[2] for e in kept], "at": [e[3] for e in kept], "low": [e[4] for e in kept], "high": [e[5] for e in kept], "left": [e[1] for e in kept], "right": [e[0][8:] for e in kept], "settled": [e[6] for e in kept]}
    yield _batch(_RUNS, bucket=[(e[2] + e[3]) % buckets for e in kept], **plain)


def _held(limit: int, hot: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[Entry], list[Entry]]]:
    """The entries of rows (row, text packed, h, at, first, last, n), and those of anchor substrings with more than `hot`, up to `limit` bytes of context at a time."""
    unpacked = zstandard.ZstdDecompressor()
    held, size = ([], []), 0
    for b in batches:
        cols = [b.column(c) for c in ("row", "text", "h", "at", "first", "last", "n")]
        for i in range(b.num_rows):
            row, text, *marks, counts = (c[i].as_py() for c in cols)
            for n, e in zip(counts, _entries(row, unpacked.decompress(text), *marks)):
                held[n > hot].append(e)
                size += len(e[0]) + len(e[1])
                if size > limit:
                    yield held
                    held, size = ([], []), 0
    if size:
        yield held


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, text (compressed, as it is shuffled)."""
    pack = zstandard.ZstdCompressor(level=3)
    for b in C.slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([pack.compress(x) for x in C.texts(b.column("text"))], pa.binary())], ["row", "text"])


def packed(rows: DataFrame) -> DataFrame:
    return rows.select("row", "text").mapInArrow(C.tidy(_packed), "row long, text binary")


def _cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, at, low, part, core: the hash of the bytes that every window of a part of an entry has."""
    names = ["row", "at", "low", "part", "core"]
    for b in batches:
        out = []
        for row, at, low, high, left, right in zip(*(b.column(c).to_pylist() for c in _HOT.names[:6])):
            for part in range(low // PART, high // PART + 1):
                core = left[: part * PART][::-1] + right[: SHORT - part * PART - PART + 1]
                out.append((row, at, low, part, xxhash.xxh3_128_digest(struct.pack("<i", part) + core)))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 5, [pa.int64()] * 4 + [pa.binary()])], names)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, first (window start), kind, settled, hash of every window of the entries' parts."""
    names = ["row", "first", "kind", "settled", "hash"]
    for b in (x.slice(k, 200) for x in batches for k in range(0, x.num_rows, 200)):
        out = []
        for row, at, low, high, left, right, settled, parts in zip(*(b.column(c).to_pylist() for c in (*_HOT.names[:7], "parts"))):
            text = left[::-1] + right
            for part in parts:
                for d in range(max(low, part * PART), min(high, part * PART + PART - 1) + 1):
                    start = len(left) - d
                    for kind, length in ((0, LENGTH), (1, SHORT)):
                        if start + length <= len(text):
                            out.append((row, at - d, kind, settled, xxhash.xxh3_128_digest(text[start : start + length])))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 5, [pa.int64()] * 4 + [pa.binary()])], names)


def _hot_repeats(entries: DataFrame) -> DataFrame:
    """row, first, last, kind of the windows of very frequent anchors (row, at, low, high, left, right, settled) that occur again, by partial counts of hashes."""
    cores = C.written(entries.mapInArrow(C.tidy(_cores), "row long, at long, low long, part long, core binary"), "cores")
    again = C.written(cores.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "again")
    live = C.with_groups(cores, again, ["core"], "n", cores.count()).groupBy("row", "at", "low").agg(F.collect_list("part").alias("parts"))
    windows = C.written(entries.join(live, ["row", "at", "low"]).mapInArrow(C.tidy(_windows), "row long, first long, kind long, settled long, hash binary"), "windows")
    counts = windows.groupBy("kind", "hash").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("lo"), F.max("row").alias("hi"), F.max("settled").alias("settled"))
    counts = C.written(counts.where("n > 1 and (kind = 0 or lo < hi or settled = 1)").select("kind", "hash", "n"), "counts")
    return C.with_groups(windows, counts, ["kind", "hash"], "n", windows.count()).select("row", "first", F.col("first").alias("last"), "kind")


def keyed(docs: DataFrame) -> DataFrame:
    """row, doc_id, text: row is doc_id where that is unique, else a number of its own for each row."""
    return C.Rows(C.only(docs, "doc_id", "text")).only("doc_id", "text").withColumnRenamed(C.ROW, "row")


def repeats(rows: DataFrame, found: DataFrame, hot: int = HOT) -> DataFrame:
    """row, first, last, kind: ranges of window starts that occur again."""
    places = found.select("row", F.explode(F.arrays_zip("h", "at", "first", "last")).alias("x")).select("row", "x.*")
    counts = C.written(places.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counts")
    total, most = (x or 0 for x in counts.agg(F.sum("n"), F.max("n")).first())
    hits = C.with_groups(places, counts, ["h"], "n", total).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "h", "first", "last", "n"))).alias("x"))
    hits = C.written(hits.select("row", *[F.col(f"x.{c}").alias(c) for c in ("h", "at", "first", "last", "n")]), "hits")

    buckets = max(64, -(-total // BUCKET))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for entries, frequent in _held(RUN_BYTES, hot, batches):
            yield from sorted_runs(entries, frequent, buckets)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, runs = None, []

        def settle() -> Iterator[pa.RecordBatch]:
            if runs:
                got = repeated(*merged(runs))
                runs.clear()
                if got:
                    yield _batch(_HOT, **{c: [x[k] for x in got] for k, c in enumerate(("row", "first", "last", "kind"))})

        for b in batches:
            direct = b.filter(pa.compute.is_valid(b.column("row")))
            if direct.num_rows:
                yield direct.select(_HOT.names)
            for bucket, run in zip(b.column("bucket").to_pylist(), b.column("run")):
                if bucket != now:
                    yield from settle()
                    now = bucket
                if run.is_valid:
                    runs.append(unpack(run.as_py()))
        yield from settle()

    runs = packed(rows).join(hits, "row").mapInArrow(C.tidy(scan), _RUNS_DDL)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = runs.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(C.tidy(combine), _HOT_DDL)
    if most <= hot:
        return out.select("row", "first", "last", "kind")
    out = C.written(out, "merged")  # read twice: what is found, and the frequent entries
    return out.where("kind is not null").select("row", "first", "last", "kind").unionByName(_hot_repeats(out.where("kind is null").select(*_HOT.names[:7])))


def spans(first: list[int], last: list[int], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs [start, end) of bytes covered by the windows of the ranges."""
    out: list[list[int]] = []
    for a, b in sorted(zip(first, last)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + length)
        else:
            out.append([a, b + length])
    return [(a, b) for a, b in out]


_CUT = pa.schema([("cut_row", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha", pa.string())])


def removed(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary; null where nothing is removed), kept_sha (of what is kept), sha (of the whole text), n_passages, n_passage_bytes of every row.

    Passages are the maximal runs of bytes covered by strings of SHORT bytes that are in another text too.
    """
    rows = keyed(docs)
    found = C.written(rows.mapInArrow(C.tidy(_anchor_rows), _ANCHORS), "anchors")
    ranges = repeats(rows, found, hot).groupBy("row", "kind").agg(F.collect_list(F.struct("first", "last")).alias("x"))
    ranges = C.written(ranges.select("row", "kind", F.col("x.first").alias("first"), F.col("x.last").alias("last")), "ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacked = zstandard.ZstdDecompressor()
        for b in (x.slice(k, 100) for x in batches for k in range(0, x.num_rows, 100)):
            kept, gone, many = [], [], []
            for text, first, last in zip(b.column("text").to_pylist(), b.column("first").to_pylist(), b.column("last").to_pylist()):
                data, away = unpacked.decompress(text), spans(first, last)
                ends = [0, *(x for s in away for x in s), len(data)]
                kept.append(b"".join(data[ends[i] : ends[i + 1]] for i in range(0, len(ends), 2)))
                gone.append(len(data) - len(kept[-1]))
                many.append(len(away))
            yield C.batch_of(_CUT, cut_row=b.column("row"), n_removed=gone, n_spans=many, kept=kept, kept_sha=[hashlib.sha256(x).hexdigest() for x in kept])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [spans(first, last, SHORT) for first, last in zip(b.column("first").to_pylist(), b.column("last").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(map(len, each), pa.int64()), pa.array([sum(y - x for x, y in a) for a in each], pa.int64())], ["passage_row", "n_passages", "n_passage_bytes"])

    done = packed(rows).join(ranges.where("kind = 0"), "row").select("row", "text", "first", "last").mapInArrow(C.tidy(cut), "cut_row long, n_removed long, n_spans long, kept binary, kept_sha string")
    passages = ranges.where("kind = 1").select("row", "first", "last").mapInArrow(C.tidy(count), "passage_row long, n_passages long, n_passage_bytes long")
    out = found.select("row", "doc_id", "n_bytes", "sha").join(done, F.col("row") == F.col("cut_row"), "left").join(passages, F.col("row") == F.col("passage_row"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), "kept", F.coalesce("kept_sha", "sha").alias("kept_sha"), "sha", zero("n_passages"), zero("n_passage_bytes"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = removed(C.read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept_sha").alias("kept_sha256"), "n_passages", "n_passage_bytes")
