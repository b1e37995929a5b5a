"""Byte-level BPE encoding and decoding with a two-tier lookup.

A pre-token that is in the vocabulary is found by a minimal perfect hash: one slot
for each entry, reached through a displacement table, and checked by its bytes. Any
other pre-token is merged with a heap of adjacent pairs over a linked list of its
bytes, least rank and leftmost first, so a pre-token of n bytes costs O(n log n).

Null text encodes as empty (no ids); whole texts are encoded, however long; rows
repeat as they come; an empty table gives an empty result; other columns are kept by
encode() and decode() unless they have the name of a column these add, which they
replace. The vocabulary file is a parameter, read by the driver and broadcast: its
size is fixed by the file.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raceflow.llm import common as C

#: Bytes of the pre-tokens, with their ids, that a worker remembers in each of two generations, and what one takes besides its characters and ids.
REMEMBERED, ENTRY = 64 << 20, 200
_MASK = (1 << 64) - 1


class PerfectHash:
    """Minimal perfect hash from n byte strings to 0..n-1; other strings are told apart by their bytes."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.slots: list[bytes | None] = [None] * n
        self.shifts = [0] * max(n, 1)
        buckets: dict[int, list[tuple[int, bytes]]] = {}
        for k in keys:
            h = xxhash.xxh3_64_intdigest(k)
            buckets.setdefault(h % n, []).append((h, k))
        order = sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0]))
        free = 0
        for bucket, members in order:
            if len(members) > 1:
                d = 1
                while True:
                    at = {self._place(h, d) for h, _ in members}
                    if len(at) == len(members) and all(self.slots[i] is None for i in at):
                        break
                    d += 1
                self.shifts[bucket] = d
                for h, k in members:
                    self.slots[self._place(h, d)] = k
            else:  # a lone key goes to any free slot; the shift is that slot, negated
                while self.slots[free] is not None:
                    free += 1
                self.slots[free] = members[0][1]
                self.shifts[bucket] = -free - 1

    def _place(self, h: int, d: int) -> int:
        return ((((h ^ (d * 0x9E3779B97F4A7C15)) & _MASK) * 0xD6E8FEB86659FD93 & _MASK) >> 32) % self.n

    def find(self, key: bytes) -> int:
        """The slot of key, or -1 if it isn't one of the keys."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shifts[h % self.n]
        at = -d - 1 if d < 0 else self._place(h, d)
        return at if self.slots[at] == key else -1


def paired(ranks: dict[bytes, int]) -> list[int]:
    """The rank of each pair of bytes (first byte * 256 + second), or -1."""
    return [ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]


def merged(piece: bytes, ranks: dict[bytes, int], pairs: list[int] | None = None) -> list[int]:
    """The ids of a piece that isn't in the vocabulary, by merging its least-ranked neighbours until none is left.

    A part is known by its first byte: ends has its end (0 once it is merged into the one before), before the part in
    front. The heap holds rank, first byte and end of what a merge would make, in one integer. pairs is paired(ranks).
    """
    pairs = paired(ranks) if pairs is None else pairs
    n, get = len(piece), ranks.get
    bits = n.bit_length()
    mask, high = (1 << bits) - 1, 2 * bits
    ends, before = [*range(1, n + 1)], [*range(-1, n)]
    heap = []
    for i in range(n - 1):
        r = pairs[piece[i] << 8 | piece[i + 1]]
        if r >= 0:
            heap.append(r << high | i << bits | i + 2)
    heapq.heapify(heap)
    pop, push, swap = heapq.heappop, heapq.heappush, heapq.heapreplace
    while heap:
        x = heap[0]
        i, e = x >> bits & mask, x & mask
        j = ends[i]
        if not j or j >= n or ends[j] != e:
            pop(heap)
            continue  # one of the two has been merged meanwhile
        ends[i], ends[j] = e, 0
        r = None
        if e < n:
            before[e] = i
            k = ends[e]
            r = get(piece[i:k])
        if r is None:
            pop(heap)
        else:
            swap(heap, r << high | i << bits | k)
        if i:
            h = before[i]
            r = get(piece[h:e])
            if r is not None:
                push(heap, r << high | h << bits | e)
    out, i = [], 0
    while i < n:
        e = ends[i]
        out.append(ranks[piece[i:e]])
        i = e
    return out


class Encoder(dict):
    """Pre-token -> its ids as bytes of int32; a dict so that remembered pre-tokens are found without a call.

    Two generations of REMEMBERED bytes are kept: when the young one is full, the old one goes. So long pre-tokens (text
    without spaces) can't fill the memory.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        super().__init__()
        self.ranks, self.find, self.old, self.size = ranks, regex.compile(pattern).findall, {}, 0
        self.pairs = paired(ranks)
        self.table = PerfectHash(list(ranks))
        self.rank_of = [pack("=i", ranks[k]) for k in self.table.slots]

    def __missing__(self, token: str) -> bytes:
        ids = self.old.get(token)
        if ids is None:
            piece = token.encode()
            at = self.table.find(piece)
            if at >= 0:
                ids = self.rank_of[at]
            else:
                found = merged(piece, self.ranks, self.pairs)
                ids = pack(f"={len(found)}i", *found)
        size = ENTRY + 4 * len(token) + len(ids)
        if self.size + size > REMEMBERED:
            self.old, self.size = dict(self), 0
            self.clear()
        if size <= REMEMBERED:
            self[token] = ids
            self.size += size
        return ids

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, self.find(text))), np.int32)


class Decoder:
    """What ids stand for, gathered from one flat array: the vocabulary's bytes, or another piece for each id."""

    def __init__(self, pieces: list[bytes]):
        self.sizes = np.array(list(map(len, pieces)), np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1])
        return self.flat[at].tobytes()


def pieces_of(ranks: dict[bytes, int]) -> list[bytes]:
    """The bytes of each id."""
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, i in ranks.items():
        pieces[i] = piece
    return pieces


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken vocabulary file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}


def _public() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _replaced(df: DataFrame, *names: str) -> list[str]:
    return [c for c in df.columns if c.lower() not in names]


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs and the column ids (array<int>) of their whole texts."""
    public = (path, pattern) if path and pattern else _public()
    path, pattern = path or public[0], pattern or public[1]
    C.prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(path))
    kept = _replaced(docs, "ids")
    field = pa.field("ids", pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)
        for b in C.slices(batches, "text"):
            ids = [encoder.encode(x.decode("utf-8", "replace")) for x in C.texts(b.column("text"))]
            offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            cols = [b.column(c) for c in kept] + [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))]
            yield pa.RecordBatch.from_arrays(cols, schema=pa.schema([b.schema.field(c) for c in kept] + [field]))

    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    return rows.mapInArrow(C.tidy(run), T.StructType([*rows.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of encoded and the column data (binary): the bytes that their ids stand for."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_ranks(path or _public()[0]))
    kept = _replaced(encoded, "data")
    field = pa.field("data", pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Decoder(pieces_of(shared.value))
        for b in batches:
            for s in range(0, b.num_rows, 200):
                part = b.slice(s, 200)
                data = [b"" if x.values is None else table.decode(x.values.to_numpy()) for x in part.column("ids")]
                cols = [part.column(c) for c in kept] + [pa.array(data, type=field.type)]
                yield pa.RecordBatch.from_arrays(cols, schema=pa.schema([part.schema.field(c) for c in kept] + [field]))

    rows = encoded.select(*[F.col(f"`{c}`") for c in kept])
    return rows.mapInArrow(C.tidy(run), T.StructType([*rows.schema.fields, T.StructField("data", T.BinaryType())]))


def _sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def digests(docs: DataFrame, *more: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, the columns `more`, n_tokens, ids_sha256 (of the decimal ids joined by a space), decoded_sha256 of every row.

    The ids and the bytes that they decode to are what encode() and decode() return; they are digested where they are made.
    """
    public = (path, pattern) if path and pattern else _public()
    path, pattern = path or public[0], pattern or public[1]
    rows = C.only(docs, "doc_id", *more, "text")
    shared = rows.sparkSession.sparkContext.broadcast(load_ranks(path))
    kept = ["doc_id", *more]
    fields = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = Encoder(shared.value, pattern), Decoder(pieces_of(shared.value))
        written = Decoder([b" %d" % i for i in range(len(table.sizes))])  # ids as decimal numbers
        for b in C.slices(batches, "text"):
            found = []
            for text in C.texts(b.column("text")):
                ids = encoder.encode(text.decode("utf-8", "replace"))
                found.append((len(ids), _sha256(written.decode(ids)[1:]), _sha256(table.decode(ids))))
            cols = [pa.array(x, f.type) for x, f in zip(zip(*found), fields)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *cols], schema=pa.schema([b.schema.field(c) for c in kept] + fields))

    kinds = [f for f in rows.schema.fields if f.name in kept]
    return rows.mapInArrow(C.tidy(run), T.StructType([*kinds, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(C.read(spark, sf_dir, "documents"))
