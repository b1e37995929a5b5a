"""Exact near-duplicate join on word shingles by signature trees.

Documents whose shingle sets have a Jaccard similarity of at least 3/4 are linked, and
every document gets the least doc_id that its links reach.

1. Documents with equal sets are one node (its least row key, which is doc_id where that is unique). A set's bitmap marks its
   hashed shingles; its width grows with the set.
2. Linked sets share a shingle of their prefixes (the first quarter, plus one, of each
   set in one global order; frequent shingles come last in it). Sets that share one are
   a group; groups with the same members are one group. So every linked pair meets.
3. In each group a signature tree is built over the sets in order of size: a node holds
   the OR of its bitmaps and its range of sizes. A dual traversal of the tree with itself
   (and with the tree of the next wider bitmaps) drops every pair of nodes whose greatest
   possible overlap is too small, down to pairs of sets. A pair counts in its first common
   group (as far as the sets' first groups tell). Of the pairs that are left, only enough are proposed to join each group's
   members (a forest, which thickens each round).
4. Proposals are verified on the whole texts; links give components; the groups that
   still hold several components are searched again for pairs not yet refused. When a
   search proposes nothing, no link between different components is left.

Frequent shingles are those that are in LEAST_HEAVY documents and in HEAVY of all
documents as counted by scan slices over all rows. At most (mean set size / HEAVY)
shingles can be, whatever the corpus, which bounds what is broadcast; they only change
the order of prefixes, never the result. A group of more than BLOCK sets is cut into
blocks and each pair of blocks is searched by itself.

Words are `[^\\x20\\x09-\\x0D]+` of the whole text with A-Z in lower case; a text of fewer
than five words is one shingle. Null, empty and wordless texts have no set and only
themselves as a component. Rows repeated with one doc_id are told apart, and give equal
rows if their texts are equal; rows without a doc_id are linked like any other, and
component_id is null where no row that is reached has a doc_id. An empty table gives an
empty result; other columns are ignored. Shingles are compared by 64-bit hashes, and nodes
by 128 bits of their sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raceflow.llm import common as C

WORDS = 5
HEAVY, LEAST_HEAVY = 0.0002, 16
#: Text that is counted for frequent shingles at a time, and the documents of it that must have one.
COUNTED_BYTES, COUNTED_DOCS = 4 << 20, 3
BLOCK = 8192
LEAF, FAN = 16, 8
#: Groups of a set, the first by name, that tell whether a pair has met before.
FIRST = 8


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.r_[True, h[1:] != h[:-1]]]


def shingles(data: list[bytes], words: C.BulkHashes) -> list[np.ndarray]:
    """The sorted shingle hashes of each text."""
    return [_distinct(C.windows(h, WORDS)) if len(h) >= WORDS else C.windows(h, len(h)) if len(h) else h for h in words.of(data)]


def bitmap(s: np.ndarray) -> bytes:
    """Bits of the hashes in a width (a power of two) of 2 to 4 times the set, at least 64."""
    width = 64
    while width < 2 * len(s):
        width *= 2
    bits = np.zeros(width, np.uint8)
    bits[(s & C.U64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def set_key(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


_SETS = pa.schema(
    [(C.ROW, pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("id", pa.int64()), ("check", pa.int64()), ("bits", pa.binary()), ("frequent", pa.list_(pa.struct([("token", pa.int64()), ("docs", pa.int32())])))]
)
_SETS_DDL = f"{C.ROW} long, doc_id long, n long, id long, check long, bits binary, frequent array<struct<token:bigint,docs:int>>"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = C.BulkHashes()
    for b in C.slices(batches, "text", COUNTED_BYTES):
        sets = shingles(C.texts(b.column("text")), seen)
        keys = [set_key(s) for s in sets]
        distinct = {k: s for k, s in zip(keys, sets) if len(s)}
        frequent: list[list[dict]] = [[] for _ in sets]
        if distinct:
            tokens, counts = np.unique(np.concatenate([*distinct.values()]), return_counts=True)
            often = counts >= COUNTED_DOCS
            frequent[0] = [{"token": t, "docs": c} for t, c in zip(tokens[often].view(np.int64).tolist(), counts[often].tolist())]
        yield C.batch_of(_SETS, **{C.ROW: b.column(C.ROW)}, doc_id=b.column("doc_id"), n=[len(s) for s in sets], id=[k for k, _ in keys], check=[c for _, c in keys], bits=[bitmap(s) for s in sets], frequent=frequent)


def prefix(s: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """The first shingles of a set, of which any set linked to it has one among its own first."""
    if len(heavy):
        known = heavy[np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)] == s
        if known.any():
            s = np.concatenate([s[~known], s[known]])
    return s[: len(s) - -(-3 * len(s) // 4) + 1]


def _prefixes(heavy: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = C.BulkHashes()
        for b in C.slices(batches, "text"):
            distinct = {set_key(s)[0]: s for s in shingles(C.texts(b.column("text")), seen) if len(s)}
            parts = [prefix(s, heavy) for s in distinct.values()]
            if parts:
                ids = np.repeat(np.array([*distinct], np.int64), [len(p) for p in parts])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64)), pa.array(ids)], ["token", "id"])

    return run


#: Members of one shingle that are held to tell equal groups; beyond, the group goes by its shingle.
_HELD = 1 << 20


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by token -> (group, id) of the tokens with two members or more; equal member lists have one group name."""
    rest_t, rest_i = np.zeros(0, np.int64), np.zeros(0, np.int64)
    open_token: int | None = None  # a token whose members already went out by its own name

    def named(t: np.ndarray, i: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(t):
            return
        keep = np.r_[True, (t[1:] != t[:-1]) | (i[1:] != i[:-1])]
        t, i = t[keep], i[keep]
        edge = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        size = np.diff(np.r_[edge, len(t)])
        with np.errstate(over="ignore"):
            name = np.add.reduceat(C.mix64(i.view(np.uint64)), edge) + size.astype(np.uint64)
        many = np.repeat(size > 1, size)
        out = np.repeat(C.mix64(name).view(np.int64), size)[many]
        if len(out):
            yield pa.RecordBatch.from_arrays([pa.array(out), pa.array(i[many])], ["grp", "id"])

    for b in batches:
        t = np.concatenate([rest_t, b.column("token").to_numpy(zero_copy_only=False)])
        i = np.concatenate([rest_i, b.column("id").to_numpy(zero_copy_only=False)])
        if not len(t):
            continue
        last = int(np.searchsorted(t, t[-1]))
        head = int(np.searchsorted(t, open_token, side="right")) if open_token is not None else 0
        if head:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(head, open_token)), pa.array(i[:head])], ["grp", "id"])
            last = max(last, head)
        if head < len(t):
            open_token = None
        yield from named(t[head:last], i[head:last])
        rest_t, rest_i = t[last:], i[last:]
        if len(rest_t) > _HELD:
            open_token = int(rest_t[0])
            yield pa.RecordBatch.from_arrays([pa.array(rest_t), pa.array(rest_i)], ["grp", "id"])
            rest_t, rest_i = rest_t[:0], rest_i[:0]
    yield from named(rest_t, rest_i)


class Tree:
    """A signature tree over sets of one bitmap width in order of size: levels[0] are leaves of LEAF sets."""

    def __init__(self, who: np.ndarray, n: np.ndarray, bits: np.ndarray):
        order = np.lexsort((who, n))
        self.who, self.n, self.bits = who[order], n[order], bits[order]
        self.extra = self.n - np.bitwise_count(self.bits).sum(axis=1).astype(np.int64)
        self.levels = []
        low = high = self.n
        union, extra, width = self.bits, self.extra, LEAF
        while True:
            starts = np.arange(0, len(low), width)
            union, extra = np.bitwise_or.reduceat(union, starts, axis=0), np.maximum.reduceat(extra, starts)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            self.levels.append((union, low, high, extra))
            if len(starts) == 1:
                break
            width = FAN

    def folded(self, words: int) -> Tree:
        """The same sets with their bitmaps folded to fewer words."""
        bits = self.bits
        while bits.shape[1] > words:
            bits = bits[:, : bits.shape[1] // 2] | bits[:, bits.shape[1] // 2 :]
        return Tree(self.who, self.n, bits)


def _possible(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether nodes (or sets) i of a and j of b can hold a linked pair, by sizes and by greatest possible overlap."""
    (ua, la, ha, ea), (ub, lb, hb, eb) = a, b
    fit = (4 * ha[i] >= 3 * lb[j]) & (4 * hb[j] >= 3 * la[i])
    i, j = i[fit], j[fit]
    out = np.zeros(len(fit), bool)
    if len(i):
        most = np.bitwise_count(ua[i] & ub[j]).sum(axis=1).astype(np.int64) + np.minimum(ea[i], eb[j])
        out[np.flatnonzero(fit)[7 * most >= 3 * (la[i] + lb[j])]] = True
    return out


def candidates(a: Tree, b: Tree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets (indices of each tree) that the dual traversal leaves, some at a time; of a tree with itself each pair once."""
    own = a is b
    stack = [(max(len(a.levels), len(b.levels)) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    chunk = max(64, (1 << 21) // (a.bits.shape[1] * LEAF * LEAF))
    sets_a, sets_b = (a.bits, a.n, a.n, a.extra), (b.bits, b.n, b.n, b.extra)
    while stack:
        level, i, j = stack.pop()
        if len(i) > chunk:
            stack += [(level, i[chunk:], j[chunk:]), (level, i[:chunk], j[:chunk])]
            continue
        la, lb = a.levels[min(level, len(a.levels) - 1)], b.levels[min(level, len(b.levels) - 1)]
        ok = _possible(la, lb, i, j)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        down = lambda x, t, k: (x[:, None] * k + np.arange(k)) if level < len(t.levels) else x[:, None]
        if level:
            x, y = down(i, a, FAN), down(j, b, FAN)
            most_a, most_b = len(a.levels[min(level - 1, len(a.levels) - 1)][1]), len(b.levels[min(level - 1, len(b.levels) - 1)][1])
        else:
            x, y = i[:, None] * LEAF + np.arange(LEAF), j[:, None] * LEAF + np.arange(LEAF)
            most_a, most_b = len(a.n), len(b.n)
        x, y = np.repeat(x, y.shape[1], axis=1).ravel(), np.tile(y, (1, x.shape[1])).ravel()
        keep = (x < most_a) & (y < most_b)
        if own:
            keep &= (x < y) if not level else (x <= y)
        x, y = x[keep], y[keep]
        if level:
            stack.append((level - 1, x, y))
        else:
            ok = _possible(sets_a, sets_b, x, y)
            if ok.any():
                yield x[ok], y[ok]


def _few(n: list[int], bits: list[bytes]) -> Iterator[tuple[int, int]]:
    """The pairs that a tree of one leaf leaves, for a group so small that Python's own integers are quicker."""
    whole = [int.from_bytes(b, "little") for b in bits]
    width = [8 * len(b) for b in bits]
    extra = [k - w.bit_count() for k, w in zip(n, whole)]
    for j in range(1, len(n)):
        for i in range(j):
            if 4 * n[i] < 3 * n[j] or 4 * n[j] < 3 * n[i]:
                continue
            x, y, w, v, e, f = whole[i], whole[j], width[i], width[j], extra[i], extra[j]
            if w != v:  # fold the wider one
                if w > v:
                    x, w, y, v, e, f = y, v, x, w, f, e
                while v > w:
                    v //= 2
                    y = (y >> v) | (y & ((1 << v) - 1))
                f = (n[j] if width[j] > width[i] else n[i]) - y.bit_count()
            if 7 * ((x & y).bit_count() + min(e, f)) >= 3 * (n[i] + n[j]):
                yield i, j


def _many(who: np.ndarray, n: np.ndarray, bits: list[bytes], part: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes that the trees of a group leave; if it has two parts, only pairs across."""
    widths = np.array([len(x) for x in bits])
    trees: dict[tuple[int, int], Tree] = {}
    for w in np.unique(widths):
        for p in (0, 1):
            at = np.flatnonzero((widths == w) & (part == p))
            if len(at):
                trees[int(w), p] = Tree(who[at], n[at], np.frombuffer(b"".join(bits[k] for k in at), np.uint64).reshape(len(at), -1))
    across = len(np.unique(part)) > 1
    for (w, p), a in trees.items():
        for w2, q in ((w, p), (w, 1 - p), (2 * w, p), (2 * w, 1 - p)):
            b = trees.get((w2, q))
            if b is None or across == (p == q) or (w2 == w and q < p):
                continue
            b = b if w2 == w else b.folded(a.bits.shape[1])
            for x, y in candidates(a, b):
                x, y = a.who[x], b.who[y]
                x, y = np.minimum(x, y), np.maximum(x, y)
                order = np.lexsort((y, x))
                yield x[order], y[order]


def proposals(grp: int, who: list[int], n: list[int], bits: list[bytes], part: list[int], comp: list[int], groups: list[list[int]], refused: set[tuple[int, int]], thick: int) -> tuple[list[tuple[int, int]], bool]:
    """Pairs of a group to verify: those that join its components, with up to `thick` for each set; and whether any was left out.

    A pair is its first common group's business: groups has the first few of each set, and a pair with a common one
    before this group is left to that. (Pairs whose first common group is beyond both lists can come up again.)
    part: 0 or 1; if both occur, only pairs across are looked at.
    """
    earlier = {w: {g for g in own if g < grp} for w, own in zip(who, groups)}
    parent: dict[int, int] = {c: c for c in comp}
    label, count = dict(zip(who, comp)), dict.fromkeys(who, 0)
    out: list[tuple[int, int]] = []
    left_out = False

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    if len(who) <= 6 and not any(part):
        found = iter([(min(who[i], who[j]), max(who[i], who[j])) for i, j in _few(n, bits)])
    else:
        found = ((u, v) for x, y in _many(np.array(who), np.array(n), bits, np.array(part)) for u, v in zip(x.tolist(), y.tolist()))
    for u, v in found:
        a, b = label[u], label[v]
        if a == b or not earlier[u].isdisjoint(earlier[v]) or (u, v) in refused:
            continue
        s, t = root(a), root(b)
        if s == t and (count[u] >= thick or count[v] >= thick):
            left_out = True
            continue
        parent[max(s, t)] = min(s, t)
        count[u] += 1
        count[v] += 1
        out.append((u, v))
    return out, left_out


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("grp", pa.int64()), ("cell", pa.int64())])


def _search(thick: int):
    """Members sorted by group -> proposed pairs (a, b), and a row (null, null, grp, cell) for each group that must be searched again."""
    names = ("node", "n", "bits", "part", "comp", "groups", "refused")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, [[] for _ in names]
        out: list[tuple] = []

        def settle() -> None:
            who, n, bits, part, comp, own, no = held
            refused = {(min(w, x), max(w, x)) for w, xs in zip(who, no) for x in xs or ()}
            got, left_out = proposals(now[0], who, n, bits, part, comp, own, refused, thick)
            out.extend((a, b, None, None) for a, b in got)
            if left_out:
                out.append((None, None, *now))

        def ready() -> pa.RecordBatch:
            rows = C.batch_of(_FOUND, **dict(zip(_FOUND.names, map(list, zip(*out)))))
            out.clear()
            return rows

        for b in (x.slice(k, 500) for x in batches for k in range(0, x.num_rows, 500)):
            cols = [b.column(c).to_pylist() for c in names]
            keys = list(zip(b.column("grp").to_pylist(), b.column("cell").to_pylist()))
            start = 0
            while start < len(keys):
                stop = start + 1
                while stop < len(keys) and keys[stop] == keys[start]:
                    stop += 1
                if held[0] and keys[start] != now:
                    settle()
                    held = [[] for _ in names]
                now = keys[start]
                for h, c in zip(held, cols):
                    h.extend(c[start:stop])
                start = stop
            if len(out) > 50_000:
                yield ready()
        if held[0]:
            settle()
        if out:
            yield ready()

    return run


def _payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, text (compressed) of the rows whose text has the wanted set."""
    seen = C.BulkHashes()
    pack = zstandard.ZstdCompressor(level=3)
    for b in C.slices(batches, "text"):
        data = C.texts(b.column("text"))
        ok = [i for i, (s, k) in enumerate(zip(shingles(data, seen), b.column("id").to_pylist())) if set_key(s)[0] == k]
        node = b.column(C.ROW).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([node[i] for i in ok], pa.int64()), pa.array([pack.compress(data[i]) for i in ok], pa.binary())], ["node", "text"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = C.BulkHashes()
    out = zstandard.ZstdDecompressor()
    for batch in batches:
        for s in range(0, batch.num_rows, 200):
            b = batch.slice(s, 200)
            one, two = (shingles([out.decompress(x) for x in b.column(c).to_pylist()], seen) for c in ("text_a", "text_b"))
            linked = [7 * len(np.intersect1d(x, y, assume_unique=True)) >= 3 * (len(x) + len(y)) for x, y in zip(one, two)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(linked)], ["a", "b", "linked"])


def components(edges: DataFrame) -> DataFrame:
    """node, comp (least node that it reaches) of the nodes of edges (a, b), by contraction.

    Each round sends every node to its least neighbour (or itself), and on to that one's, and keeps the distinct edges
    between the nodes that are left; the least node of a component is the one that stays.
    """
    both = C.written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = both.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct()
    while not both.isEmpty():
        least = C.written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p")), "least")
        onward = least.select(F.col("a").alias("q"), F.col("p").alias("pp"))
        to = C.written(least.join(onward, F.col("p") == F.col("q")).select(F.col("a").alias("old"), F.col("pp").alias("new")), "to")
        labels = labels.join(to, F.col("comp") == F.col("old"), "left").select("node", F.coalesce("new", "comp").alias("comp"))
        labels = C.written(labels, "labels")
        left = both.join(to, F.col("a") == F.col("old")).select(F.col("new").alias("a"), "b")
        left = left.join(to, F.col("b") == F.col("old")).select("a", F.col("new").alias("b"))
        both = C.written(left.where("a <> b").distinct(), "edges")
    return labels


def groups(docs: DataFrame, sets: DataFrame, leaders: DataFrame) -> DataFrame:
    """grp, cell, part, node: the members of every group in which linked sets meet."""
    total = leaders.count()
    counts = sets.select(F.inline("frequent")).groupBy("token").agg(F.sum("docs").alias("docs"))
    heavy = counts.where(F.col("docs") >= max(LEAST_HEAVY, HEAVY * total)).select("token").toPandas()["token"].to_numpy(np.int64)
    order = np.sort(heavy.view(np.uint64))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tokens = docs.select("text").mapInArrow(C.tidy(_prefixes(order)), "token long, id long")
    rows = tokens.repartition(parts, "token").sortWithinPartitions("token", "id").mapInArrow(C.tidy(_members), "grp long, id long").distinct()
    rows = C.written(rows, "members")
    large = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BLOCK).select(F.col("grp").alias("g"), F.ceil(F.col("m") / BLOCK).alias("blocks"))
    rows = rows.join(C.small(C.written(large, "large"), 32), F.col("grp") == F.col("g"), "left")
    blocks = F.coalesce("blocks", F.lit(1).cast("long"))
    own = F.pmod(F.xxhash64("id", "grp"), blocks)
    cell = lambda x: F.struct((F.least(own, x) * blocks + F.greatest(own, x)).alias("cell"), F.when(own > x, 1).otherwise(0).alias("part"))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), cell)
    rows = rows.select("grp", "id", F.inline(cells))
    out = rows.join(leaders.select(F.col("id").alias("i"), "node"), F.col("id") == F.col("i"))
    return out.select("grp", "cell", "part", "node")


def _joined(docs: DataFrame, unique: bool) -> DataFrame:
    """The key, doc_id, n_shingles, comp (a key; least key of the rows it reaches), component_id of every row (key, doc_id, text)."""
    spark = docs.sparkSession
    sets = C.written(docs.mapInArrow(C.tidy(_sets), _SETS_DDL), "sets")
    # sets of one 64-bit id are told apart by 64 bits more; where groups go by id alone they get some members too many
    found = sets.where("n > 0").groupBy("id", "check")
    leaders = found.agg(F.min(C.ROW).alias("node"), F.min("n").alias("n"), F.first("bits").alias("bits"), F.count(F.lit(1)).alias("copies"))
    leaders = C.written(leaders, "leaders")
    members = C.written(groups(docs, sets, leaders), "groups")
    of_node = members.groupBy(F.col("node").alias("m")).agg(F.slice(F.sort_array(F.collect_set("grp")), 1, FIRST).alias("groups"))
    bitmaps = C.written(leaders.select("node", "n", "bits").join(of_node, F.col("node") == F.col("m")).select("m", "n", "bits", "groups"), "bitmaps")
    edges = refused = spark.createDataFrame([], "a long, b long")
    labels = spark.createDataFrame([], "node long, comp long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    thick = 1
    while True:
        rows = members.join(labels.select(F.col("node").alias("l"), "comp"), F.col("node") == F.col("l"), "left")
        rows = rows.select("grp", "cell", "part", "node", F.coalesce("comp", "node").alias("comp"))
        if thick > 1:  # groups that may still join components
            mixed = rows.groupBy("grp", "cell").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select(F.col("grp").alias("g"), F.col("cell").alias("c"))
            rows = rows.join(mixed, (F.col("grp") == F.col("g")) & (F.col("cell") == F.col("c")), "left_semi")
        no = refused.groupBy(F.col("a").alias("r")).agg(F.collect_list("b").alias("refused"))
        rows = rows.join(no, F.col("node") == F.col("r"), "left").join(bitmaps, F.col("node") == F.col("m"))
        rows = rows.select("grp", "cell", "part", "node", "n", "bits", "comp", "groups", "refused")
        rows = rows.repartition(parts, "grp", "cell").sortWithinPartitions("grp", "cell", "node")
        found = C.written(rows.mapInArrow(C.tidy(_search(thick)), "a long, b long, grp long, cell long"), "found")
        pairs = C.written(found.where("a is not null").select("a", "b").distinct(), "pairs")
        again = found.where("a is null").select(F.col("grp").alias("g"), F.col("cell").alias("c"))
        members = C.written(members.join(again, (F.col("grp") == F.col("g")) & (F.col("cell") == F.col("c")), "left_semi"), "groups")
        if pairs.isEmpty():
            break
        wanted = pairs.select(F.col("a").alias("w")).union(pairs.select("b")).distinct().join(leaders, F.col("w") == F.col("node")).select("node", "id")
        wanted = C.written(wanted, "wanted")
        text = docs.join(C.small(wanted, 32), F.col(C.ROW) == F.col("node")).select(C.ROW, "text", "id").mapInArrow(C.tidy(_payload), "node long, text binary")
        text = C.written(text.dropDuplicates(["node"]), "texts")
        both = pairs.join(text.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(text.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        judged = C.written(both.select("a", "b", "text_a", "text_b").mapInArrow(C.tidy(_verified), "a long, b long, linked boolean"), "judged")
        edges = C.written(edges.union(judged.where("linked").select("a", "b")), "links")
        refused = C.written(refused.union(judged.where("not linked").select("a", "b")), "refused")
        labels = components(edges)
        thick *= 256
    found = leaders.select("id", "check", "copies", "node").join(labels.select(F.col("node").alias("l"), "comp"), F.col("node") == F.col("l"), "left")
    found = C.written(found.select("id", "check", "copies", F.coalesce("comp", "node").alias("comp")), "comps")
    out = sets.select(C.ROW, "doc_id", F.col("n").alias("n_shingles"), "id", "check")
    alone = out.where("n_shingles = 0").select(C.ROW, "doc_id", "n_shingles", F.col(C.ROW).alias("comp"))
    linked = C.with_groups(out.where("n_shingles > 0"), found, ["id", "check"], "copies", sets.count()).select(C.ROW, "doc_id", "n_shingles", "comp")
    out = alone.unionByName(linked)
    if unique:
        return out.withColumn("component_id", F.col("comp"))
    out = C.written(out, "comps")
    ids = out.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    return C.with_groups(out, C.written(ids, "ids"), ["comp"], "rows", out.count()).select(C.ROW, "doc_id", "n_shingles", "comp", "component_id")


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    keyed = C.Rows(C.only(docs, "doc_id", "text"))
    return _joined(keyed.only("doc_id", "text"), keyed.unique).select("doc_id", "n_shingles", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs of which each component keeps one (the one with the least key, which is doc_id where that is unique), with all their columns."""
    keyed = C.Rows(docs)
    gone = _joined(keyed.only("doc_id", "text"), True).where(F.col("comp") != F.col(C.ROW)).select(C.ROW)
    return keyed.back(keyed.df.join(gone, C.ROW, "left_anti"))


def op4_signature_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(C.read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, shingle FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' '))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n n1 ON n1.doc_id = x JOIN n n2 ON n2.doc_id = y WHERE 100 * k >= 75 * (n1.n + n2.n - k)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(node, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.seen),
c AS (SELECT node, min(seen) AS comp FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.comp AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.node = d.doc_id
"""
