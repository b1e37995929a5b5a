"""Fixed vectors for the operators on observation streams."""

from __future__ import annotations

import itertools
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from raceflow.config import Config, Line, bib_range
from raceflow.functions import decoding
from raceflow.functions import geometry as G
from raceflow.functions import text as T
from raceflow.operators import association as A
from raceflow.operators import crossing as X
from raceflow.operators import dataset as DS
from raceflow.operators import dedup as D
from raceflow.operators import quality as Q
from raceflow.operators import recovery as R
from raceflow.operators import registry as REG
from raceflow.operators import review as RV
from raceflow.operators import tracking as TR
from raceflow.operators import voting as V
from raceflow.streaming.jobs import Detector, side

VERTICAL = Line(0.5, 0.0, 0.5, 1.0)


def test_sides():
    assert (side(0.3, 0.5, VERTICAL), side(0.7, 0.5, VERTICAL)) == (1, -1)
    horizontal, diagonal = Line(0, 0.5, 1, 0.5), Line(0, 0, 1, 1)
    assert side(0.5, 0.3, horizontal) == -side(0.5, 0.7, horizontal) != 0
    assert side(0.5, 0.5, diagonal) == 0 and side(0.2, 0.8, diagonal) == -side(0.8, 0.2, diagonal) != 0


CROSSINGS = [
    (1, 5, "any", {1: 0.3, 2: 0.7, 3: 0.8}, [2]),
    (3, 50, "any", {1: 0.3, 2: 0.7, 3: 0.7, 4: 0.7}, [4]),
    (1, 10, "any", {1: 0.3, 2: 0.7, 5: 0.3, 6: 0.7, 20: 0.3}, [2, 20]),
    (1, 0, "left_to_right", {1: 0.3, 2: 0.7}, [2]),
    (1, 0, "left_to_right", {1: 0.7, 2: 0.3}, []),
    (3, 0, "any", {0: 0.3} | {i: 0.7 if i % 2 else 0.3 for i in range(1, 20)}, []),
    (3, 0, "any", {0: 0.3, 1: 0.7, 2: 0.7, 3: 0.7, 4: 0.7}, [3]),
]


@pytest.mark.parametrize(("hold", "debounce", "direction", "path", "fires"), CROSSINGS)
def test_crossing_vectors(spark, hold, debounce, direction, path, fires):
    obs = spark.createDataFrame([(1, f, x, 0.5) for f, x in path.items()], "track_id long, frame_idx long, x double, y double")
    got = X.crossings(obs, VERTICAL, hold, debounce, direction).orderBy("frame_idx").collect()
    assert [r.frame_idx for r in got] == fires
    d = Detector()
    assert [f for f, x in path.items() if d.check(x, 0.5, f, VERTICAL, hold, debounce, direction)] == fires


def test_windows_equal_fold(spark):
    rng = np.random.default_rng(3)
    rows = [(t, f, float(x), 0.5) for t in range(60) for f, x in enumerate(rng.choice([0.3, 0.5, 0.7], 40, p=[0.45, 0.1, 0.45]))]
    obs = spark.createDataFrame(rows, "track_id long, frame_idx long, x double, y double")
    for hold, debounce, direction in ((1, 0, "any"), (2, 7, "any"), (3, 0, "right_to_left"), (2, 5, "left_to_right")):
        got = {(r.track_id, r.frame_idx) for r in X.crossings(obs, VERTICAL, hold, debounce, direction).collect()}
        want = set()
        for t in range(60):
            d = Detector()
            want |= {(t, f) for tt, f, x, y in rows if tt == t and d.check(x, y, f, VERTICAL, hold, debounce, direction)}
        assert got == want


@pytest.mark.parametrize(
    ("points", "want"),
    [
        ({5: (100, 200), 6: (200, 200), 11: (100, 400), 12: (200, 400)}, (150, 300)),
        ({5: (100, 200), 6: (200, 200)}, (150, 200)),
        ({5: (100, 200), 6: (200, 200), 11: (150, 400)}, (150, 266.67)),
        ({5: (100, 200)}, (200, 300)),
        (None, (200, 300)),
    ],
)
def test_chest(spark, points, want):
    kp = None if points is None else [dict(zip(("x", "y", "conf"), (*map(float, points.get(i, (0, 0))), 0.9 if i in points else 0.0))) for i in range(17)]
    df = spark.createDataFrame([(kp, 100.0, 200.0, 300.0, 400.0)], "kp array<struct<x:double,y:double,conf:double>>, x1 double, y1 double, x2 double, y2 double")
    r = df.select(G.chest(F.col("kp"), *[F.col(c) for c in ("x1", "y1", "x2", "y2")]).alias("c")).first().c
    assert (round(r.x, 2), round(r.y, 2)) == want


def test_tracker():
    t = TR.Tracker(2, 100.0)
    assert set(t.update([(10, 10, 50, 50), (200, 200, 250, 250)])) == {0, 1}
    assert set(t.update([(15, 10, 55, 50), (200, 200, 250, 250)])) == {0, 1}
    one = TR.Tracker(2, 100.0)
    one.update([(10, 10, 50, 50)])
    assert [len(one.update([])) for _ in range(3)] == [1, 1, 0]
    far = TR.Tracker(2, 50.0)
    far.update([(10, 10, 50, 50)])
    assert len(far.update([(500, 500, 550, 550)])) == 2
    given = TR.Tracker(2, 50.0)
    given.update([(0, 0, 10, 10)], [(300.0, 300.0)])
    assert given.update([(200, 200, 400, 400)], [(310.0, 300.0)])[0][0] == (310.0, 300.0)


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n, m = map(int, rng.integers(1, 6, 2))
        c = rng.random((n, m))
        best = min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n)) if n <= m else min(sum(c[p[j], j] for j in range(m)) for p in itertools.permutations(range(n), m))
        assert abs(sum(c[i, j] for i, j in TR.assign(c)) - best) < 1e-9


def emit(rows, debounce=10, radius=200.0):
    s = D.State()
    return [D.emits(s, b, f, c, t, *(p or (None, None)), debounce, radius) for b, f, c, t, p in rows]


def test_dedup_vectors():
    assert emit([("65", 0, 0.5, None, None), ("65", 100, 0.6, None, None), ("65", 200, 0.75, None, None)]) == [True, False, True]
    assert emit([("65", 0, 0.95, None, None), ("65", 100, 0.85, None, None), ("65", 200, 0.85, None, None), ("65", 300, 0.95, None, None)]) == [True, True, False, True]
    assert emit([("1234", 0, 0.95, None, (100, 100)), ("1234", 100, 0.95, None, (150, 150)), ("1234", 200, 0.75, None, (500, 500))]) == [True, False, True]
    assert emit([("1234", 0, 0.95, None, (100, 100)), ("1234", 100, 0.6, None, (600, 100)), ("1234", 200, 0.75, None, (600, 100))]) == [True, False, True]
    assert emit([("1234", 100, 1.0, None, None), ("1234", 200, 1.0, None, None)], 300) == [True, False]
    assert emit([("UNKNOWN", f, 0.0, 5, None) for f in (0, 10, 5000)], 100) == [True, False, False]
    assert emit([("UNKNOWN", f, 0.0, None, None) for f in (0, 10)]) == [True, True]


def test_dedup_operator(spark):
    rows = [("65", 0, 0.5, 1, None, None), ("65", 100, 0.6, 2, None, None), ("65", 200, 0.75, 3, None, None), ("UNKNOWN", 5, 0.0, 9, None, None), ("UNKNOWN", 6, 0.0, 9, None, None), ("UNKNOWN", 6, 0.0, 8, None, None)]
    df = spark.createDataFrame(rows, "bib string, frame_idx long, conf double, track_id long, x double, y double")
    got = {(r.bib, r.frame_idx, r.track_id): r.emitted for r in D.deduplicated(df, 10).collect()}
    assert got == {("65", 0, 1): True, ("65", 100, 2): False, ("65", 200, 3): True, ("UNKNOWN", 5, 9): True, ("UNKNOWN", 6, 9): False, ("UNKNOWN", 6, 8): True}


PERSON, BIB = ((250.0, 300.0), (200, 100, 300, 500)), ((250.0, 250.0), (230, 230, 270, 270))


@pytest.mark.parametrize(
    ("readings", "min_votes", "fraction", "typical", "want"),
    [
        ([("1234", "high")] * 5, 3, 0.4, None, "1234"),
        ([("1234", "high")] * 2 + [("5678", "medium")] * 4, 3, 0.4, None, "5678"),
        ([("1111", "low")] * 5 + [("1234", "high")] * 2, 3, 0.4, None, "1234"),
        ([("1234", "reject")], 1, 0.4, None, None),
        ([("1234", "reject")] * 2, 1, 0.4, None, "1234"),
        ([("9999", "reject")] * 4 + [("1234", "high")], 3, 0.4, None, "1234"),
        ([("1234", "high")], 5, 0.4, None, None),
        ([("1234", "high")] * 2, 5, 0.4, None, "1234"),
        ([("65", "high")] * 2 + [("1265", "high")] * 2, 3, 0.4, 4, "1265"),
        ([("1234", "high"), ("5678", "high")], 3, 0.6, None, None),
    ],
)
def test_ledger(readings, min_votes, fraction, typical, want):
    led = A.Ledger(150.0, 120, typical, min_votes, fraction)
    for f, r in enumerate(readings):
        led.update({1: PERSON}, {10: BIB}, {10: r}, f)
    assert led.number(1)[0] == want


def test_ledger_inherits_and_forgets():
    led = A.Ledger(100.0, 10, None, 3, 0.4)
    led.update({1: PERSON}, {10: BIB}, {10: ("1234", "high")}, 0)
    led.update({2: ((260.0, 310.0), (210, 110, 310, 510))}, {}, {}, 1)
    assert led.number(2)[0] == "1234" and led.number(1)[0] is None
    far = A.Ledger(100.0, 10, None, 3, 0.4)
    far.update({1: PERSON}, {10: BIB}, {10: ("1234", "high")}, 0)
    far.update({2: ((500.0, 500.0), (450, 400, 550, 600))}, {}, {}, 1)
    assert far.number(2)[0] is None
    far.cleanup(20)
    assert far.number(1)[0] is None


def test_claims_equal_closed_form(spark):
    rng = np.random.default_rng(5)
    persons = [(f, i, *map(float, rng.uniform(0, 400, 2))) for f in range(40) for i in range(3)]
    bibs = [(f, 100 + i, *map(float, rng.uniform(0, 400, 2))) for f in range(40) for i in range(5)]
    frame = lambda rows, half: spark.createDataFrame([(f, i, x, y, x - half, y - half, x + half, y + half) for f, i, x, y in rows], "frame_idx long, id long, cx double, cy double, x1 double, y1 double, x2 double, y2 double")
    got = {(r.frame_idx, r.person): r.bib for r in A.best_bib(A.pairs(frame(persons, 40.0), frame(bibs, 15.0)), 120.0).collect()}
    for f, i, x, y in persons:
        own = {b: ((bx, by), (bx - 15, by - 15, bx + 15, by + 15)) for g, b, bx, by in bibs if g == f}
        want = A.claim((x, y), (x - 40, y - 40, x + 40, y + 40), own, 120.0)
        assert got.get((f, i)) == (want[1] if want else None)


def preds(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "pred string")


def bibs_of(spark, *values):
    return spark.createDataFrame([(str(v),) for v in values], "bib string")


def test_validation(spark):
    reg = bibs_of(spark, 1000, 1001, 1002, 1234, 2345, 3456, 4567)
    got = {r.pred: r for r in REG.validated(preds(spark, "1234", "9999", "1235", ""), reg).collect()}
    assert got["1234"].is_valid and got["1234"].boost == 0.1
    assert not got["9999"].is_valid and not got["9999"].is_corrected and got["9999"].validated == "9999"
    assert got["1235"].is_corrected and got["1235"].validated == "1234"
    assert got[""].validated == "" and not got[""].is_valid
    wide = REG.from_range(spark, 1000, 3999)
    r = REG.validated(preds(spark, "235"), wide).first()
    assert r.is_corrected and r.validated in ("1235", "2235", "3235") and len(r.alternatives) <= 3
    assert {r.bib for r in REG.from_range(spark, 100, 200).collect()} == {str(i) for i in range(100, 201)}


def votes(spark, *pairs):
    return spark.createDataFrame([(1, i, n, c) for i, (n, c) in enumerate(pairs)], "track_id long, frame_idx long, number string, conf double")


def last(df):
    return df.orderBy(F.desc("frame_idx")).first()


def test_ratio_equals_the_standard_matcher():
    rng = np.random.default_rng(2)
    text = lambda: "".join(rng.choice(list("0123ä🏁"[: rng.integers(1, 7)]), rng.integers(0, 9)))
    pairs = [(text(), text()) for _ in range(3000)] + [("", ""), ("1", ""), ("a" * 250, "ab" * 130), ("ab" * 130, "a" * 150)]
    got = REG.ratio.func(pd.Series([a for a, _ in pairs]), pd.Series([b for _, b in pairs]))
    assert got.tolist() == [SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_voting(spark):
    opts = {"window": 10, "min_votes": 3, "stable": 5}
    assert last(V.consensus(votes(spark, ("1234", 0.9), ("1234", 0.9)), **opts)).winner is None
    r = last(V.consensus(votes(spark, *[("1234", 0.9)] * 5), **opts))
    assert (r.winner, r.votes, r.agreement, r.is_stable) == ("1234", 5, 1.0, True)
    r = last(V.consensus(votes(spark, ("1234", 0.9), ("1234", 0.9), ("1235", 0.8), ("1234", 0.9), ("1234", 0.9)), **opts))
    assert (r.winner, r.votes, r.agreement) == ("1234", 4, 0.8)
    r = last(V.consensus(votes(spark, *[("1234", 0.9)] * 4, ("1235", 0.9)), **opts))
    assert not r.is_stable
    assert last(V.consensus(votes(spark, *[("1234", 0.9)] * 10), window=5, min_votes=3)).total == 5
    assert V.early(V.consensus(votes(spark, *[("1234", 0.95)] * 4), **opts)).count() == 2


def test_equal_means_with_bonus_go_to_the_least_number(spark):
    reads = votes(spark, ("1000", 0.6), *[("1001", 0.44)] * 5, ("1002", 0.5))  # 0.6 * 1.1 = 0.44 * 1.5
    assert [tuple(r) for r in V.vote_mean_bonus(reads).collect()] == [(1, "1000", 0.6)]


def test_equal_sums_go_to_the_least_number(spark):
    reads = votes(spark, ("1000", 0.6), ("1001", 0.1), ("1001", 0.2), ("1001", 0.3)).coalesce(1)  # 0.1 + 0.2 + 0.3 > 0.6 as doubles
    assert [tuple(r) for r in V.vote_sum(reads).collect()] == [(1, "1000", 0.6)]


def test_confidence(spark):
    one = spark.createDataFrame([(0.95,), (0.75,), (0.55,), (0.30,)], "c double")
    assert [r.l for r in one.select(T.level(F.col("c")).alias("l")).collect()] == ["high", "medium", "low", "reject"]
    adj = lambda c, b, v, s, a: spark.range(1).select(T.adjusted(F.lit(c), F.lit(b), F.lit(v), F.lit(s), F.lit(a)).alias("x")).first().x
    assert adj(0.80, 0.1, True, False, 0.0) == 1.0
    assert adj(0.75, -0.2, False, False, 0.0) < 0.75
    assert adj(0.9, -0.05, False, True, 1.0) <= 0.96


def test_cleanup(spark):
    rows = {"O123": "123", "S0B": "508", "000": "0", "123456": "12345"}
    df = spark.createDataFrame([(k,) for k in rows], "raw string")
    assert {r.raw: r.t for r in df.select("raw", T.clean(F.col("raw"))["text"].alias("t")).collect()} == rows
    r = spark.range(1).select(T.clean(F.lit("9999"), 5, 1700).alias("x")).first().x
    assert (r.text, r.modified) == ("", True)
    assert spark.range(1).select(T.digit_penalty(F.lit("12"), F.lit(0.5), F.array(F.lit(3), F.lit(4))).alias("x")).first().x == 0.35
    texts = spark.createDataFrame([("a12b1234c99999",), ("none",)], "t string")
    assert [r.x for r in texts.select(T.longest_run(F.col("t")).alias("x")).collect()] == ["1234", None]


def test_review(spark):
    items = spark.createDataFrame([(str(i), i) for i in range(10)], "bib string, frame_number long")
    q = RV.queue(items, 5)
    assert sorted(r.id for r in q.collect()) == ["review_10", "review_6", "review_7", "review_8", "review_9"]
    assert RV.resolved(q, q).count() == 0
    c = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "sequence long, bib string")
    k = spark.createDataFrame([(1, "reject", None), (2, "correct", "x")], "sequence long, action string, corrected_bib string")
    assert sorted((r.sequence, r.bib) for r in RV.corrected(c, k).collect()) == [(2, "x"), (3, "c")]


def test_greedy_recovery(spark):
    cand = spark.createDataFrame([("r", 1, "10", 5.0), ("r", 1, "11", 1.0), ("r", 2, "11", 0.5), ("r", 2, "12", 9.0), ("r", 3, "77", 1.0)], "run_id string, sequence long, number string, score double")
    reg = bibs_of(spark, 10, 11, 12)
    assert sorted((r.sequence, r.number) for r in R.resolved_later(cand, reg).collect()) == [(1, "11"), (2, "12")]


def test_quality_and_pixels(spark):
    flat = np.zeros((20, 40))
    assert Q.pixel_stats(flat) == (0.0, 0.0) and Q.completeness(flat) == (0.2, 0.0)
    noisy = np.random.default_rng(0).integers(0, 255, (20, 40))
    blur, contrast = Q.pixel_stats(noisy)
    assert blur > 50 and contrast > 20
    digits = np.full((60, 160), 200, np.uint8)
    for k in range(4):
        digits[10:50, 20 + 32 * k : 26 + 32 * k] = 20
        digits[10:50, 34 + 32 * k : 40 + 32 * k] = 20
    whole, extent = Q.completeness(digits)
    half, _ = Q.completeness(np.hstack([digits[:, 90:], np.full((60, 90), 200, np.uint8)]))
    assert whole > 0.9 > half and extent > 0.6
    got = spark.createDataFrame([(digits.tobytes(), 160), (None, 5)], "p binary, w int").select(Q.crop_stats("p", "w").alias("s")).select("s.*").collect()
    assert abs(got[0].completeness - whole) < 1e-9 and got[1].completeness == 0.0
    why = spark.range(1).select(Q.reason(*[F.lit(v) for v in (100, 40, 90.0, 30.0, 0.4, 0.9)]).alias("x")).first().x
    assert why == "partial_content"


def test_decoding():
    logits = np.full((5, 11), -9.0)
    for t, c in enumerate((2, 2, 0, 2, 4)):
        logits[t, c] = 9.0
    text, conf = decoding.ctc(logits)
    assert text == "113" and conf > 0.99
    assert decoding.ctc(np.eye(11)[[0, 0]] * 20) == ("", 0.0)


def test_config():
    assert Config.from_dict({"fps": 10.0, "nonsense": 1}).debounce == 20
    assert Line.parse("0,1,2") is None and Line.parse("0,0,1,1") == Line(0, 0, 1, 1)
    assert bib_range("5-9") == (5, 9) and bib_range("x") is None


def test_splits(spark):
    rows = spark.createDataFrame([(i, "a", 3) for i in range(100)] + [(100 + i, "b", 3) for i in range(5)], "id long, event string, digit_count int")
    n = {(r.event, r.split): r["count"] for r in DS.stratified_split(rows, "id").groupBy("event", "split").count().collect()}
    assert n == {("a", "test"): 10, ("a", "val"): 10, ("a", "train"): 80, ("b", "train"): 5}
    assert DS.readiness(10, 5, 0, 0) == ("READY", ["few images", "less than one annotation an image"])


# --- buffers, clearing, places ---------------------------------------------------------------------


def test_buffers(spark):
    from raceflow.streaming import buffers

    rng = np.random.default_rng(3)
    puts = rng.random(400) < 0.6
    df = spark.createDataFrame([("r", i, bool(p)) for i, p in enumerate(puts)], "run_id string, seq long, put boolean")
    for policy, size in (("drop_new", 7), ("drop_old", 2), ("newest", 5)):
        held, want = [], {}
        for i, p in enumerate(puts):
            if not p:
                if held:
                    want[held.pop(0)] = "taken"
            elif len(held) < (1 if policy == "newest" else size):
                held.append(i)
            elif policy == "drop_new":
                want[i] = "lost"
            else:
                want[held.pop(0)] = "lost"
                held.append(i)
        want |= dict.fromkeys(held, "left")
        assert {r.seq: r.outcome for r in buffers.outcomes(df, size, policy).collect()} == want
    with pytest.raises(ValueError):
        buffers.Buffer(1, "other")


def test_places_over_ranges(spark):
    from raceflow.operators import ordering

    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")).repartition(7)
    rows = ordering.placed(df, "place", "k").orderBy("k").collect()
    assert [r.place for r in rows] == list(range(1000))


def test_failed_callback_fails_the_batch(spark):
    from raceflow.sources import sinks

    seen = []

    def bad(batch, epoch):
        raise ValueError("no")

    with pytest.raises(ExceptionGroup):
        sinks.fan_out(bad, lambda b, e: seen.append(b.count()))(spark.range(3), 0)
    assert seen == [3]


def test_frames_in_memory(spark):
    from raceflow.sources import readers

    rows = readers.memory(spark, (np.full((2, 3), i, np.uint8) for i in range(4))).collect()
    assert [(r.frame_idx, r.width, r.height, bytes(r.payload)) for r in rows] == [(i + 1, 3, 2, bytes([i] * 6)) for i in range(4)]
    with pytest.raises(ValueError):
        readers.memory(spark, [np.zeros((2, 3), np.uint8), np.zeros((3, 3), np.uint8)])


def test_length_band_against_all_pairs(spark):
    from difflib import SequenceMatcher

    rng = np.random.default_rng(6)
    word = lambda n: "".join(rng.choice(list("0123"), n))
    texts = sorted({word(int(n)) for n in rng.integers(1, 9, 300)} | {word(int(n)) for n in rng.integers(11, 24, 40)})
    near = [t[:k] + t[k + 1 :] for t in texts for k in (len(t) // 2,)] + [t + "1" for t in texts]
    preds, bibs = sorted({*texts[::2], *near[::3], ""}), texts
    for threshold in (0.75, 0.6):
        want = {(a, b) for a in preds for b in bibs if a and abs(len(a) - len(b)) <= 1 and SequenceMatcher(None, a, b).ratio() >= threshold}
        got = REG.length_band(spark.createDataFrame([(x,) for x in preds], "pred string"), spark.createDataFrame([(x,) for x in bibs], "bib string"), threshold)
        assert {(r.pred, r.bib) for r in got.collect()} == want and len(want) > 100


def test_same_prefix_against_all_pairs(spark):
    """Pairs meet by what is left of them, not by their first characters alone, and none is lost."""
    from difflib import SequenceMatcher

    rng = np.random.default_rng(7)
    word = lambda n: "".join(rng.choice(list("012"), n))
    texts = sorted({word(int(n)) for n in rng.integers(1, 9, 300)} | {word(int(n)) for n in rng.integers(11, 24, 40)})
    near = [t[:k] + t[k + 1 :] for t in texts for k in (len(t) // 2,)] + [t + "101" for t in texts]
    preds, bibs = [(x,) for x in sorted({*texts[::2], *near[::3], ""})], [(x,) for x in texts]
    for threshold in (0.75, 0.5, 0.2):
        want = {(a, b) for (a,) in preds for (b,) in bibs if len(a) > 1 and a[:2] == b[:2] and SequenceMatcher(None, a, b).ratio() >= threshold}
        got = REG.same_prefix(spark.createDataFrame(preds, "pred string"), spark.createDataFrame(bibs, "bib string"), threshold).collect()
        assert {(r.pred, r.bib) for r in got} == want and len(want) == len(got) > 100
    keys = lambda rows, c: {tuple(r)[1:] for r in REG._prefix_keys(spark.createDataFrame(rows, f"{c} string"), c, 0.75).collect()}
    assert {k for k, n, m, left in keys([("123456",)], "p")} == {"12"} and not {(k, m, n, x) for k, n, m, x in keys([("129874",)], "b")} & keys([("123456",)], "p")


def test_consensus_keeps_rows_as_they_are(spark):
    """No read is multiplied by the window, and numbers or confidences that are null count as they do in sums."""
    rows = [(1, 0, "a", 0.5), (1, 1, None, 0.9), (1, 2, "b", None), (1, 3, "b", 0.3), (1, 4, "a", 0.2), (2, 0, "c", None)]
    out = V.consensus(spark.createDataFrame(rows, "track_id long, frame_idx long, number string, conf double"), window=3, stable=1)
    got = {(r.track_id, r.frame_idx): (r.winner, r.votes, r.total) for r in out.collect()}
    assert got == {(1, 0): ("a", 1, 1), (1, 1): (None, 1, 2), (1, 2): (None, 1, 3), (1, 3): (None, 1, 3), (1, 4): ("b", 2, 3), (2, 0): ("c", 1, 1)}
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_long_lifetimes_are_few_spans(spark):
    """A lifetime's spans hold each of its slots once, and are few."""
    for a, b in ((3, 3), (-5, 9), (7, 100_003)):
        got = spark.range(1).select(R._spans(F.lit(a), F.lit(b)).alias("s")).first().s
        assert sorted(x for r in got for x in range(r.slot << r.level, (r.slot + 1) << r.level)) == list(range(a, b + 1)) and len(got) <= 2 * R.LEVELS


@pytest.mark.parametrize("seed", range(4))
def test_claims_and_lost_places_equal_all_looked_at(seed):
    """Searched claims and nearest lost places are those of looking at everybody, ties included, and few bibs are looked at."""
    rng = np.random.default_rng(seed)
    place = lambda: tuple(float(v) for v in rng.integers(0, 30, 2) * 20)
    box = lambda at, by: (at[0] - by, at[1] - by, at[0] + by, at[1] + by)
    bibs = {int(i): (at, box(at, 15.0 + int(i) % 3)) for i in rng.permutation(400) for at in [place()]}
    found = A.Boxes(bibs)
    for at in [place() for _ in range(150)] + [(-5000.0, 0.0), (640.0, 640.0)]:
        assert found.claim(at, box(at, 20.0), 45.0) == A.claim(at, box(at, 20.0), bibs, 45.0)
    assert A.Boxes({}).claim((0.0, 0.0), (0.0, 0.0, 1.0, 1.0), 9.0) is None
    lost = [place() for _ in range(200)]
    free, places = dict(enumerate(lost)), A.Places(lost)
    for at in [place() for _ in range(260)]:
        near = min(((A._dist(at, v), k) for k, v in free.items()), default=None)
        want = near[1] if near and near[0] < 50.0 else None
        assert places.taken(at, 50.0) == want
        free.pop(want, None)


@pytest.mark.parametrize("few", [0, 100, 1 << 40])
def test_crowded_lifetimes_equal_all_looked_at(spark, monkeypatch, few):
    """Lifetimes in cells of time and space give what all pairs give, ties included, whether cells are joined or counted in arrays in several parts."""
    monkeypatch.setattr(R, "FEW", few)
    monkeypatch.setattr(R, "GROUP", 64)
    rng = np.random.default_rng(3)

    def lives(n, numbers):
        first = rng.integers(-2000, 2000, n)
        last = first + np.where(rng.random(n) < 0.2, 0, rng.integers(0, 3000, n))
        at = rng.integers(0, 12, (n, 4)) * 1.5
        run, conf = rng.choice(["a", "b"], n), rng.integers(0, 4, n) / 4
        rows = [(run[k], k, int(first[k]), int(last[k]), *map(float, at[k]), str(k % numbers), None if k % 17 == 0 else float(conf[k])) for k in range(n)]
        return [r if r[1] % 23 else (*r[:4], None, *r[5:]) for r in rows]

    schema = "run_id string, event long, first_frame long, last_frame long, first_x double, first_y double, last_x double, last_y double, number string, conf double"
    for numbers in (3, 150):
        events, tracks = lives(200, 1), lives(150, numbers)
        want = {}
        for e in events:
            per = {}
            for t in tracks:
                if e[0] == t[0] and t[2] <= e[3] + 150 and t[3] >= e[2] - 150:
                    gaps = [((e[i] - t[j]) ** 2 + (e[i + 1] - t[j + 1]) ** 2) ** 0.5 for i in (4, 6) for j in (4, 6) if e[i] is not None and t[j] is not None]
                    if min(gaps) < 3.5:
                        here = min(gaps), -np.inf if t[9] is None else -t[9]
                        per[t[8]] = min(per.get(t[8], here), here)
            if per:
                want[e[1]] = min((c, d, n) for n, (d, c) in per.items())[2]
        df = [spark.createDataFrame(rows, schema) for rows in (events, tracks)]
        got = R.in_lifetime(df[0].drop("number", "conf"), df[1].drop("event"), 150, 3.5, 300, ("run_id",)).collect()
        assert {r.event: r.bib for r in got} == want and len(got) == len(want) > 100


def test_large_registries_stay_out_of_the_driver(spark):
    """A registry of hundreds of thousands of numbers is joined by shuffles, as its table would be made in the driver for each join; a small one is broadcast."""
    hinted = lambda n: "broadcast" in REG.sized(REG.from_range(spark, 1, n))._jdf.queryExecution().analyzed().toString().lower()
    assert hinted(1000) and not hinted(300_000)
    reads = spark.createDataFrame([("299999",), ("300001",)], "number string")
    assert {r.number: r.is_valid for r in REG.flagged(reads, REG.from_range(spark, 1, 300_000)).collect()} == {"299999": True, "300001": False}


def test_the_python_ratio_runs_once_on_distinct_pairs(spark):
    """It isn't pushed below the distinct pairs, where it would see a pair for each key; and keys are made only for lengths that occur."""
    preds, bibs = (spark.createDataFrame([(x,) for x in rows], f"{c} string") for c, rows in (("pred", ["123456", "125456", "98765"]), ("bib", ["123456", "12456"])))
    for out in (REG.same_prefix(preds, bibs), REG.length_band(preds, bibs)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("Aggregate")
        assert {(r.pred, r.bib) for r in out.collect()} == {("123456", "123456"), ("123456", "12456"), ("125456", "123456"), ("125456", "12456")}
    assert REG._lengths(bibs, "bib") == [5, 6]
    assert {r.m for r in REG._prefix_keys(preds, "pred", 0.75, others=[5, 6]).collect()} == {5, 6}
