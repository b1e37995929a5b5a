"""Periodic runs, fingerprints by consistent weighted sampling and prefix tries against brute force, and edge rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from raceflow.llm import common as C
from raceflow.llm import periodic_runs, prefix_trie, weighted_sampling

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DDL = "doc_id long, text string, lang string, source string, n_chars long, runs string, row string, n string, next string, term string"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in C.read(spark, SF, "documents").collect()}


@pytest.fixture(scope="module")
def edge(spark):
    long = " ".join(f"w{i % 977} x{i}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two"), (6, long), (7, "ab " * 9000), (None, "la " * 8), (None, None), (9, "Ünï cödé 🏁"), (9, "Ünï cödé 🏁"), (9, "more words")]
    return spark.createDataFrame([(*r, *[None] * 8) for r in rows], DDL)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# --- periodic runs ---------------------------------------------------------------------------------


def brute_runs(w, least=6, power=4):
    out = []
    for q in range(1, len(w) // power + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            long = j - i + q
            if j > i and long >= max(least, power * q) and not any(w[i : i + long - d] == w[i + d : i + long] for d in range(1, q)):
                out.append((i, long, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_digest(words):
    found = brute_runs(words)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    top = (*best, best[1] * 1000 // best[2]) if best else (None,) * 4
    return len(found), *top, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for k, x in enumerate(words) if k not in gone))


def edited_words(doc_id, text):
    words = WORD.findall(text)
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(2000):
        n, k = rng.randint(0, 40), rng.choice([1, 2, 2, 3, 4])
        w = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.6:
            p, a = rng.randint(1, 6), rng.randrange(n)
            for i in range(a + p, rng.randint(a, n)):
                w[i] = w[i - p]
        assert periodic_runs.runs(w) == brute_runs(w)
        data = " ".join("abcd"[x] for x in w).encode()
        assert periodic_runs.analysed(data, periodic_runs.Words().of([data])[0])[0] == brute_runs(w)


def test_runs_of_other_limits():
    rng = random.Random(2)
    for _ in range(300):
        w = [rng.randrange(2) for _ in range(rng.randint(0, 60))]
        assert periodic_runs.runs(w, 8) == brute_runs(w, 8)


def test_one_position_moves_a_level():
    """A long period: once its classes are found, each level moves one position, so many levels take little time."""
    w = list(range(3000)) * 5
    assert periodic_runs.runs(w) == [(0, 15000, 3000)]
    assert periodic_runs.runs([0] * 50_000) == [(0, 50_000, 1)]


def test_periodic_runs_query(spark, texts):
    got = {r.doc_id: tuple(r)[1:] for r in periodic_runs.op11_periodic_runs(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        words = edited_words(i, t)
        ids = {w: k for k, w in enumerate(dict.fromkeys(words))}
        if len(words) < 800:
            assert got[i] == brute_digest(words)
        else:
            assert got[i][0] == len(periodic_runs.runs([ids[w] for w in words]))
    assert any(r[0] for r in got.values()) and any(not r[0] for r in got.values())


def test_periodic_edges(edge, empty):
    assert periodic_runs.digests(empty).count() == 0
    got = defaultdict(list)
    for r in periodic_runs.collapsed(edge).collect():
        got[r.doc_id].append(([tuple(x) for x in r.runs], r.collapsed))
    assert sum(map(len, got.values())) == 12 and got[1] == got[2] == got[3] == [([], "")]
    assert got[7] == [([(0, 9000, 1)], "ab")] and sorted(got[None]) == [([], ""), ([(0, 8, 1)], "la")]
    assert got[9].count(([], "Ünï cödé 🏁")) == 2


# --- fingerprints ----------------------------------------------------------------------------------


def jaccard(a, b):
    a, b = Counter(WORD.findall(a)), Counter(WORD.findall(b))
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def test_scores_are_exponential(spark):
    """A term of weight w scores exponentially with rate w, so that terms win in proportion to their weights."""
    rows = spark.range(20_000).select(F.xxhash64("id").alias("term"), F.explode(F.array(*map(F.lit, [1.0, 2.0, 3.0, 7.0, 40.0]))).alias("weight"))
    score = -F.log(weighted_sampling.sample(F.col("term"), F.col("weight"), 5))
    for r in rows.withColumn("score", score).groupBy("weight").agg(F.avg("score").alias("mean"), F.stddev("score").alias("dev")).collect():
        assert r.mean * r.weight == pytest.approx(1, abs=0.03) and r.dev * r.weight == pytest.approx(1, abs=0.05)


def test_lesser_weight_keeps_the_sample(spark):
    """Scores fall as weights grow, in few steps: the same score for many weights is what texts have in common."""
    rows = spark.range(300).select(F.xxhash64("id").alias("term"), F.explode(F.sequence(F.lit(1), F.lit(64))).alias("weight"))
    rows = rows.withColumn("weight", F.col("weight").cast("double"))
    by = defaultdict(list)
    for r in rows.withColumn("u", weighted_sampling.sample(F.col("term"), F.col("weight"), 3)).orderBy("term", "weight").collect():
        by[r.term].append(r.u)
    assert all(x == sorted(x) and 0 < x[0] and x[-1] < 1 for x in by.values())
    assert np.mean([len(set(x)) for x in by.values()]) < 7


def test_collisions_are_the_generalised_jaccard_similarity(spark):
    """Over very many samples: likeness of weighted sets, many weights above 1."""
    rng, pairs = random.Random(4), []
    for i in range(120):
        a = {f"w{rng.randrange(30)}": rng.randint(1, 9) for _ in range(15)}
        b = a | {f"w{rng.randrange(30)}": rng.randint(1, 9) for _ in range(rng.randint(0, 15))}
        pairs.append(tuple(" ".join(f"{i}{w}" for w, n in x.items() for _ in range(n)) for x in (a, b)))
    df = spark.createDataFrame([(2 * i + k, x) for i, p in enumerate(pairs) for k, x in enumerate(p)], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in weighted_sampling.fingerprints(df).collect()}
    near = spark.createDataFrame([(i, got[2 * i], got[2 * i + 1]) for i in range(120)], "i long, a string, b string").select("i", weighted_sampling.likeness(F.col("a"), F.col("b")).alias("x")).collect()
    off = np.array([r.x - jaccard(*pairs[r.i]) for r in near])
    assert abs(off.mean()) < 0.02 and (off**2).mean() ** 0.5 < 0.09


def test_fingerprint_query(spark, texts):
    got = {r.doc_id: r for r in weighted_sampling.op12_weighted_sampling(spark, SF).collect()}
    order, off = sorted(texts, reverse=True), []
    for i, after in zip(order, order[1:] + order[:1]):
        t, n = texts[i], len(texts[i])
        edited = t[: n - n // 2] + texts[after][: n // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (n, sha(edited)) and 0 <= r.near_edited <= 1
        off += [r.near_edited - jaccard(t, edited), r.near_next - jaccard(t, texts[after])]
        assert len(r.fingerprint) == weighted_sampling.SAMPLES * weighted_sampling.DIGITS * bool(WORD.search(t))
    assert len(got) == len(texts) and abs(np.mean(off)) < 0.02 and np.mean(np.square(off)) ** 0.5 < 0.08
    by = defaultdict(set)
    for i, t in texts.items():
        by[t].add(got[i].fingerprint)
    assert all(len(x) == 1 for x in by.values()) and len({got[i].fingerprint for i in got}) > len(by) * 0.9


def test_next_is_whole_over_ranges(spark):
    """Every row's next, over many ranges, some of one row; equal and null ids by their key."""
    rows = [(i * 7 % 50 if i % 9 else None, f"t{i}") for i in range(50)]
    keyed = C.Rows(spark.createDataFrame(rows, "doc_id long, text string"))
    got = weighted_sampling.following(keyed.only("doc_id", "text").select(C.ROW, "doc_id", F.length("text").alias("n"))).collect()
    order = sorted(got, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r[C.ROW]))
    for a, b in zip(order, order[1:] + order[:1]):
        assert a.next == b[C.ROW] and b.prev == a[C.ROW] and b.prev_n == a.n


def test_fingerprint_edges(spark, edge, empty):
    assert weighted_sampling.compared(empty).count() == 0 and weighted_sampling.fingerprints(empty).count() == 0
    rows = weighted_sampling.compared(edge).collect()
    assert len(rows) == 12
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert by[1][0].fingerprint == by[2][0].fingerprint == by[3][0].fingerprint == "" and by[2][0].near_next == by[3][0].near_next == 1.0
    assert by[5][0].fingerprint == by[4][0].fingerprint != "" and by[5][0].near_next == 1.0 and by[4][0].near_next == 0.0
    alone = weighted_sampling.compared(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")).first()
    assert (alone.near_next, alone.edited_sha256) == (1.0, sha("a b a b"[:4] + "a b "[:3]))


# --- prefix trie -----------------------------------------------------------------------------------


def brute_trie(rows, rebuild=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(x)] for c, x in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 if rebuild else 0 for c in own}
    made = {c: tuple(own.get(c - c % 20, [])[: h[c]] + own[c][h[c] :]) for c in own}
    members = defaultdict(list)
    for c, x in sorted(made.items()):
        for d in range(len(x) + 1):
            members[x[:d]].append(c)
    kids = defaultdict(list)
    for x in members:
        if x:
            kids[x[:-1]].append(x)
    out = []

    def rolled(x):
        below = [rolled(k) for k in kids[x]]
        leaves = sum(n for n, _ in below) or 1
        saved = sum(s for _, s in below) + ((len(members[x]) - 1) * len(WORD.findall(x[-1][1])) if x else 0)
        ends = ",".join(str(c) for c in members[x] if len(made[c]) == len(x))
        out.append((members[x][0], len(x), members[x[:-1]][0] if x else None, len(members[x]), len(kids[x]), leaves, saved, sha(ends)))
        return leaves, saved

    if made:
        rolled(())
    return sorted(out, key=lambda r: r[:2])


COLUMNS = [x.split()[0] for x in prefix_trie.SCHEMA.split(", ")]
CONVERSATIONS = "conv_id long, turn long, role string, text string"


def nodes(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=lambda r: r[:2])


def built(spark, rows, tmp_path):
    spark.createDataFrame(rows, CONVERSATIONS).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    return nodes(prefix_trie.op13_prefix_trie(spark, str(tmp_path)))


def test_trie_query(spark):
    rows = [tuple(r) for r in C.read(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert nodes(prefix_trie.op13_prefix_trie(spark, SF)) == brute_trie(rows)


def test_trie_of_random_conversations(spark, tmp_path):
    """Few different turns, so many conversations share long beginnings or are equal; null and repeated turns, missing bases, turnless ones."""
    rng = random.Random(6)
    rows = []
    for c in rng.sample(range(400), 150):
        for k in range(rng.randint(1, 7)):
            rows.append((c, rng.choice([k, k, k, None, 2]), rng.choice(["user", None]), rng.choice(["a b", "a  b", "", None, "c"])))
    rows += [(None, 1, "user", "of none"), rows[0], rows[0]]
    assert built(spark, rows, tmp_path) == brute_trie(rows)


def test_trie_of_equal_long_conversations(spark, monkeypatch):
    """Two long equal conversations and one that parts late; digests in several pieces."""
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    turn = lambda k: ("user", f"t{k} of it")
    rows = [(c, k, *turn(k)) for c in range(1, 30) for k in range(9)] + [(40, k, *turn(k if k < 7 else -k)) for k in range(12)]
    own = prefix_trie.turns(spark.createDataFrame(rows, CONVERSATIONS))
    got = nodes(prefix_trie.trie(*prefix_trie.rebuilt(own, F.col("conv_id"), F.lit(0))))
    assert got == brute_trie(rows, rebuild=False) and got[0][3:6] == (30, 1, 2)


def test_trie_edges(spark, tmp_path):
    assert built(spark, [], tmp_path) == []
    assert built(spark, [(None, None, None, None)], tmp_path) == []
    for rows in ([(5, None, None, None)], [(20, 0, "user", "x"), (20, 1, "user", "y z")], [(7, 0, "u", "a " * 50_000)]):
        assert built(spark, rows, tmp_path) == brute_trie(rows)
    wide = spark.createDataFrame([(1, 0, "u", "a", "x", 3), (1, 1, "u", "b", "x", 3)], "conv_id long, turn long, role string, text string, depth string, node int")
    assert len(nodes(prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turns(wide), F.col("conv_id"), F.lit(0))))) == 3


def test_trie_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS FROM '{SF}/conversations.parquet'")
    want = sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({prefix_trie.ORACLE})").fetchall(), key=lambda r: r[:2])
    assert nodes(prefix_trie.op13_prefix_trie(spark, SF)) == want
