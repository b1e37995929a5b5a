"""The box tracker, exclusive matching in rounds, links over gaps, grid joins, the phantom filter, and streams with state of their own."""

from __future__ import annotations

import itertools
import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from raceflow.config import Config
from raceflow.operators import association as A
from raceflow.operators import crossing as X
from raceflow.operators import dataset as DS
from raceflow.operators import dedup as D
from raceflow.operators import folds as FO
from raceflow.operators import kalman as K
from raceflow.operators import ordering as O
from raceflow.operators import recovery as R
from raceflow.operators import spacing as SP
from raceflow.operators import tracking as TR
from raceflow.operators import voting as V
from raceflow.plans import pipeline
from raceflow.plans import pipeline as PL
from raceflow.streaming import state as ST

BOX = "x1 double, y1 double, x2 double, y2 double"


# --- predicted boxes -------------------------------------------------------------------------------


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    total = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / total if total > 0 else 0.0


class PlainTrack:
    """One track with textbook matrices."""

    def __init__(self, box, now):
        self.id, self.last, self.began = None, now, now
        z = self.z(box)
        h = z[3]
        self.m = np.r_[z, np.zeros(4)]
        self.p = np.diag(np.square([h / 10, h / 10, 1e-2, h / 10, h / 16, h / 16, 1e-5, h / 16]))

    @staticmethod
    def z(b):
        return np.array([(b[0] + b[2]) / 2, (b[1] + b[3]) / 2, (b[2] - b[0]) / (b[3] - b[1]), b[3] - b[1]])

    def predict(self, now):
        if self.last != now - 1:
            self.m[7] = 0
        f = np.eye(8)
        for i in range(4):
            f[i, i + 4] = 1
        h = self.m[3]
        q = np.diag(np.square([h / 20, h / 20, 1e-2, h / 20, h / 160, h / 160, 1e-5, h / 160]))
        self.m, self.p = f @ self.m, f @ self.p @ f.T + q

    def correct(self, box, now):
        o = np.eye(4, 8)
        h = self.m[3]
        s = o @ self.p @ o.T + np.diag(np.square([h / 20, h / 20, 1e-1, h / 20]))
        g = self.p @ o.T @ np.linalg.inv(s)
        self.m = self.m + g @ (self.z(box) - o @ self.m)
        self.p = self.p - g @ s @ g.T
        self.last = now

    def box(self):
        x, y, a, h = self.m[:4]
        return x - a * h / 2, y - h / 2, x + a * h / 2, y + h / 2


def best_pairs(tracks, found, score, least):
    """Of all ways to pair some tracks with some detections the one that has most over the least."""
    ok = [(t, d, score(t, d) - least) for t in tracks for d in found if score(t, d) >= least]
    best, most = [], -1.0

    def go(k, used_t, used_d, total, chosen):
        nonlocal best, most
        if total > most:
            best, most = list(chosen), total
        for i in range(k, len(ok)):
            t, d, v = ok[i]
            if t not in used_t and d not in used_d:
                go(i + 1, used_t | {t}, used_d | {d}, total + v, [*chosen, (t, d)])

    go(0, frozenset(), frozenset(), 0.0, [])
    return best


class PlainTracker:
    def __init__(self, gone=30, sure=0.25, unsure=0.1):
        self.gone, self.sure, self.unsure, self.tracks, self.now, self.next = gone, sure, unsure, [], 0, 0

    def update(self, boxes, conf):
        self.now += 1
        now = self.now
        for t in self.tracks:
            t.predict(now)
        overlap = lambda t, d: iou(t.box(), boxes[d])
        high = [d for d in range(len(boxes)) if conf[d] >= self.sure]
        low = [d for d in range(len(boxes)) if self.unsure < conf[d] < self.sure]
        once, known = [t for t in self.tracks if t.id is None], [t for t in self.tracks if t.id is not None]
        seen = best_pairs(known, high, lambda t, d: overlap(t, d) * conf[d], 0.2)
        rest = [t for t in known if t.last == now - 1 and t not in [x for x, _ in seen]]
        seen += best_pairs(rest, low, overlap, 0.5)
        high = [d for d in high if d not in [x for _, x in seen]]
        again = best_pairs(once, high, lambda t, d: overlap(t, d) * conf[d], 0.3)
        seen += again
        high = [d for d in high if d not in [x for _, x in again]]
        out = {}
        for t, d in sorted(seen, key=lambda x: self.tracks.index(x[0])):
            t.correct(boxes[d], now)
            if t.id is None:
                t.id, self.next = self.next, self.next + 1
            out[t.id] = d
        for d in high:
            if conf[d] >= self.sure + 0.1:
                self.tracks.append(t := PlainTrack(boxes[d], now))
                if now == 1:
                    t.id, self.next = self.next, self.next + 1
                    out[t.id] = d
        self.tracks = [t for t in self.tracks if (t.last == now if t.id is None else now - t.last <= self.gone)]
        live, lost = [t for t in self.tracks if t.id is not None and t.last == now], [t for t in self.tracks if t.id is not None and t.last < now]
        gone = {id(b if a.last - a.began > now - b.began else a) for a in lost for b in live if iou(a.box(), b.box()) > 0.85}
        self.tracks = [t for t in self.tracks if id(t) not in gone]
        return out


@pytest.mark.parametrize("seed", range(6))
def test_box_tracker_equals_plain_one(seed):
    rng = np.random.default_rng(seed)
    at, speed = rng.random((5, 2)) * [900, 500], rng.normal(0, 9, (5, 2))
    fast, plain = K.BoxTracker(gone=8), PlainTracker(gone=8)
    for _ in range(70):
        at = at + speed + rng.normal(0, 1, at.shape)
        boxes = [(x, y, x + 60 + 5 * k, y + 150) for k, (x, y) in enumerate(at.tolist()) if rng.random() < 0.85]
        conf = [float(x) for x in rng.choice([0.9, 0.6, 0.3, 0.2, 0.05], len(boxes), p=[0.5, 0.2, 0.1, 0.15, 0.05])]
        assert fast.update(boxes, conf) == plain.update(boxes, conf)
    assert fast.next >= 5


def runners(frames=80):
    """Two runners who pass each other; the second is hidden for 21 frames and half hidden (unsure) around them."""
    for f in range(1, frames):
        a, b = (100.0 + 8 * f, 300.0, 160.0 + 8 * f, 460.0), (740.0 - 8 * f, 390.0, 800.0 - 8 * f, 550.0)
        yield f, [("a", a, 0.9)] + ([] if 30 <= f <= 50 else [("b", b, 0.2 if 28 <= f <= 52 else 0.9)])


def test_ids_through_gaps(spark):
    """The box tracker keeps both, where the nearest place loses one."""
    rows = [("r", f, *b, c, who) for f, seen in runners() for who, b, c in seen]
    df = spark.createDataFrame(rows, f"run_id string, frame_idx long, {BOX}, confidence double, who string")
    got = K.tracked(df).join(df, ["run_id", "frame_idx", "x1", "y1", "x2", "y2"]).groupBy("who").agg(F.collect_set("track_id").alias("ids")).collect()
    assert {r.who: r.ids for r in got} == {"a": [0], "b": [1]}
    near = TR.tracked(df, 30, 100.0).where("matched").join(df, ["run_id", "frame_idx", "x1", "y1", "x2", "y2"]).groupBy("who").agg(F.collect_set("track_id").alias("ids")).collect()
    assert any(len(r.ids) > 1 for r in near)


def test_boxes_edge_rows(spark):
    rows = [("r", 1, None, None, None, None), ("r", 2, 0.0, 0.0, 10.0, 10.0), ("r", 2, 0.0, 0.0, 10.0, 10.0), ("r", 3, 5.0, 5.0, 5.0, 5.0), ("s", 1, 0.0, 0.0, 10.0, 20.0), ("s", 2, 1.0, 0.0, 11.0, 20.0)]
    df = spark.createDataFrame(rows, f"run_id string, frame_idx long, {BOX}")
    assert sorted((r.run_id, r.frame_idx, r.track_id) for r in K.tracked(df).collect()) == [("s", 1, 0), ("s", 2, 0)]
    assert K.tracked(df.limit(0)).count() == 0


def test_nearest_first_equals_assignment():
    """Where nobody is in another's way the short cut gives the least cost too."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        c = rng.integers(0, 9, (int(rng.integers(1, 5)), int(rng.integers(1, 6)))).astype(float)
        got = TR.assign(c)
        small = min(c.shape)
        least = min(sum(c[r, k] for r, k in zip(rows, cols)) for rows in itertools.combinations(range(c.shape[0]), small) for cols in itertools.permutations(range(c.shape[1]), small))
        assert len(got) == small and sum(c[r, k] for r, k in got) == least


# --- exclusive matching, spacing, order ------------------------------------------------------------


def greedy(rows, valid):
    used, out = set(), []
    for event in sorted({(r, s) for r, s, _, _ in rows}):
        own = sorted((score, n) for r, s, n, score in rows if (r, s) == event and (r, n) not in used)
        if own and own[0][1] in valid:
            used.add((event[0], own[0][1]))
            out.append((*event, own[0][1]))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_rounds_equal_greedy(spark, seed):
    rng = random.Random(seed)
    rows = {(f"r{rng.randrange(2)}", rng.randrange(40), str(rng.randrange(25))): float(rng.randrange(12)) for _ in range(260)}
    rows = [(*k, v) for k, v in rows.items()]
    valid = {str(n) for n in range(25) if n % 5}
    cand = spark.createDataFrame(rows, "run_id string, sequence long, number string, score double")
    reg = spark.createDataFrame([(n,) for n in sorted(valid)], "bib string")
    assert sorted(map(tuple, R.resolved_later(cand, reg).collect())) == greedy(rows, valid)
    assert sorted(map(tuple, R.resolved_later(cand).collect())) == greedy(rows, {n for _, _, n, _ in rows})


def walk(frames, gap):
    out = []
    for f in sorted(set(frames)):
        if not out or f - out[-1] >= gap:
            out.append(f)
    return out


@pytest.mark.parametrize("gap", [1, 3, 10, 1000])
def test_links_equal_walk(spark, gap):
    rng = random.Random(gap)
    rows = [(k, rng.randrange(k * 60 + 5) * (1 if rng.random() < 0.9 else 40)) for k in range(5) for _ in range(40)]
    df = spark.createDataFrame(rows + [(7, None), (8, 3)], "number long, frame_idx long")
    got = sorted(map(tuple, V.thinned(df, "number", gap).collect()))
    assert got == sorted((k, f) for k in {*range(5), 8} for f in walk([b for a, b in [*rows, (8, 3)] if a == k], gap))
    assert sorted(r.frame_idx for r in DS.spaced(df, gap).collect()) == walk([f for _, f in rows] + [3], gap)


def test_spacing_edges(spark):
    assert SP.kept(spark.createDataFrame([], "frame_idx long"), 5).count() == 0
    with pytest.raises(ValueError):
        SP.kept(spark.range(3).toDF("frame_idx"), 0)


def test_led_over_ranges(spark):
    rows = [(k if k else None, i * 3) for k in range(4) for i in range(25 * k + 1)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(9)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else few rows are one range
    try:
        got = sorted(map(tuple, O.led(df, {"then": "v"}, ("k",), "v").collect()), key=str)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == sorted(((k, v, v + 3 if (k, v + 3) in rows else None) for k, v in rows), key=str)


def test_even_steps(spark):
    for n, most in ((10, 3), (997, 40), (50, 49), (7, 7), (5, 9)):
        got = sorted(r.v for r in DS.evenly(spark.range(n).select((F.col("id") * 2).alias("v")), "v", most).collect())
        assert got == ([2 * (i * n // most) for i in range(most)] if n > most else [2 * i for i in range(n)])


def test_order_accuracy(spark):
    rng = random.Random(5)
    out = []
    for event in ("a", "b"):
        places = list(range(60))
        rng.shuffle(places)
        out += [(event, i, None if rng.random() < 0.1 else places[i]) for i in range(60)]
    out += [("c", None, None), ("d", 1, None)]
    df = spark.createDataFrame(out, "event string, true_place long, out_place long")
    got = {r.event: r.lcs for r in DS.order_accuracy(df).collect()}
    for event in ("a", "b"):
        seq = [p for e, _, p in out if e == event and p is not None]
        best = []
        for i, p in enumerate(seq):
            best.append(1 + max((best[j] for j in range(i) if seq[j] < p), default=0))
        assert got[event] == pytest.approx(max(best) / 60)
    assert got["c"] == got["d"] == 0.0


# --- grids -----------------------------------------------------------------------------------------


def placed_boxes(spark, n, side, size, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(3), i, x, y, x - size * rng.random(), y - size, x + size * 3 * rng.random(), y + size) for i in range(n) for x, y in [(rng.uniform(-side, side), rng.uniform(0, side))]]
    return spark.createDataFrame([*rows, (1, n, None, None, None, None, None, None)], f"frame_idx long, id long, cx double, cy double, {BOX}")


@pytest.mark.parametrize("far", [0.0, 40.0, 150.0])
def test_grid_pairs(spark, far):
    p, b = placed_boxes(spark, 150, 900, 30.0, 1), placed_boxes(spark, 150, 900, 10.0, 2)
    want = A.pairs(p, b).where(F.col("inside") | (F.col("dist") < far))
    assert sorted(map(tuple, A.near_pairs(p, b, far).collect())) == sorted(map(tuple, want.collect()))


def test_grid_work_grows_with_rows(spark):
    """At fixed density, four times the rows make about four times the pairs that are looked at."""
    met = [A.met(placed_boxes(spark, n, side, 20.0, 1), placed_boxes(spark, n, side, 20.0, 2), 50.0).count() for n, side in ((300, 2000), (1200, 4000))]
    assert met[1] < 5 * met[0]
    e = [spark.createDataFrame([("1", i, random.Random(i).uniform(0, s), random.Random(i + 10_000).uniform(0, s)) for i in range(n)], "bib string, frame_idx long, x double, y double") for n, s in ((300, 500), (1200, 1000))]
    looked = [D.candidates(x, 20.0).count() for x in e]
    assert looked[1] < 5 * looked[0]


def test_proximity_against_all_pairs(spark):
    rng = random.Random(9)
    rows = [(str(rng.randrange(3)), i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(200)] + [("1", 500, None, 0.0)]
    want = {(b, f): sum(b == c and g < f and ((x - u) ** 2 + (y - v) ** 2) ** 0.5 < 15 for c, g, u, v in rows[:-1]) for b, f, x, y in rows[:-1]}
    got = {(r.bib, r.frame_idx): r.earlier for r in D.near_earlier(spark.createDataFrame(rows, "bib string, frame_idx long, x double, y double"), 15.0).collect()}
    assert got == {k: n for k, n in want.items() if n}


@pytest.mark.parametrize(("few", "group"), [(0, 1 << 17), (0, 40), (30, 40), (1 << 40, 1 << 17)])
def test_crowded_proximity_against_all_pairs(spark, monkeypatch, few, group):
    """Joined or counted in arrays, whole or in parts, with equal rows, equal places and pairs just at the radius: the same counts."""
    monkeypatch.setattr(D, "FEW", few)
    monkeypatch.setattr(D, "GROUP", group)
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.randrange(150), rng.choice([-7.0, 0.0, 8.0, 15.0, rng.uniform(-40, 40)]), rng.choice([0.0, 9.0, 12.0, rng.uniform(-20, 20)])) for _ in range(300)] * 2
    odd = [("a", 200, None, 0.0), ("a", 201, math.nan, 0.0), ("a", 202, math.inf, 0.0), ("a", 203, 1e300, 0.0), (None, 204, 0.0, 0.0), ("a", None, 0.0, 0.0)]
    want = {}
    for (b, f, x, y), (c, g, u, v) in itertools.product(rows, rows):
        if b == c and g < f and math.sqrt((x - u) * (x - u) + (y - v) * (y - v)) < 15:
            want[b, f] = want.get((b, f), 0) + 1
    got = D.near_earlier(spark.createDataFrame(rows + odd, "bib string, frame_idx long, x double, y double"), 15.0).collect()
    assert {(r.bib, r.frame_idx): r.earlier for r in got} == want and len(got) == len(want)


def test_counts_within_equal_all_pairs():
    """Also where a cell is much smaller than the radius, and for distances an ulp from it."""
    rng = np.random.default_rng(3)
    for radius, size in ((15.0, 64), (0.3, 4), (1 / 3, 2)):
        f, n = rng.integers(0, 300, 900), rng.integers(1, 4, 900)
        x, y = (rng.choice(np.concatenate([rng.uniform(-2, 2, 50), [0.0, 1.0, math.nextafter(1.0, 0), 0.6, 0.8]]), 900) * radius for _ in "xy")
        near = np.sqrt((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2) < radius
        got = D.within((f, x, y), (f, x, y, n), D._square(radius), size)
        assert got.tolist() == ((near & (f < f[:, None])) * n).sum(axis=1).tolist()


def test_proximity_makes_no_row_for_each_crowded_pair(spark, monkeypatch):
    made, plain = [], D.candidates

    def watched(*a):
        made.append(plain(*a))
        return made[-1]

    monkeypatch.setattr(D, "candidates", watched)
    df = spark.range(3000).select(F.lit("1").alias("bib"), F.col("id").alias("frame_idx"), (F.col("id") % 7).cast("double").alias("x"), F.lit(0.0).alias("y"))
    assert sorted(r.earlier for r in D.near_earlier(df, 15.0).collect()) == list(range(1, 3000))
    assert sum(m.count() for m in made) <= 256 * 3000


# --- phantoms --------------------------------------------------------------------------------------


def crossing_scene(spark, run, tracks, text, decoys):
    """A person with a number who crosses, and `decoys` short plate tracks elsewhere that read the same."""
    dets, reads, people = [], [], []
    for f in range(1, 41):
        x, y = 700.0 + 12 * f, 150.0
        people.append((run, f, x - 40, y - 80, x + 100, y + 120, x + 30, y + 20))
        plates = [(x, y)] * tracks + [(200.0 * k + 120, 700.0) for k in range(decoys)]
        for px, py in plates:
            dets.append((run, f, px, py, px + 60, py + 40, 0.9))
            reads.append((run, f, px, py, px + 60, py + 40, text, 0.9))
    return dets, reads, people


def run_all(spark, scenes):
    dets, reads, people = (list(itertools.chain(*x)) for x in zip(*scenes))
    frame = f"run_id string, frame_idx long, {BOX}"
    tables = spark.createDataFrame(dets, f"{frame}, confidence double"), spark.createDataFrame(reads, f"{frame}, raw string, conf double"), spark.createDataFrame(people, f"{frame}, cx double, cy double")
    return pipeline.run(*tables, spark.createDataFrame([("1234",)], "bib string"), Config(debounce_time=0.1)).crossings.collect()


def test_phantom_of_one_run(spark):
    """A number on eight tracks of a run names nobody in it, also by recovery and afterwards."""
    got = run_all(spark, [crossing_scene(spark, "r", 1, "1234", 7)])
    assert [(r.bib, r.source) for r in got] == [("UNKNOWN", "pose")]


def test_phantoms_are_counted_by_run(spark):
    """A number on one track in each of seven runs is no phantom; where another run has it on eight, that run alone loses it."""
    got = run_all(spark, [crossing_scene(spark, f"r{k}", 1, "1234", 0) for k in range(7)] + [crossing_scene(spark, "s", 1, "1234", 7)])
    assert {(r.run_id, r.bib) for r in got} == {(f"r{k}", "1234") for k in range(7)} | {("s", "UNKNOWN")}


# --- streams ---------------------------------------------------------------------------------------

LATE = "100000 seconds"


def detections(spark):
    rng = random.Random(1)
    rows = []
    for run, f, k in itertools.product("ab", range(60), range(2)):
        x = 100.0 * k + 3 * f + rng.random()
        rows.append((run, f, x, 50.0 * k, x + 40, 50.0 * k + 80) if rng.random() < 0.8 else (run, f, None, None, None, None))
    df = spark.createDataFrame(rows, f"run_id string, frame_idx long, {BOX}")
    return df, spark.createDataFrame([(r, 500_000, None, None, None, None) for r in "ab"], df.schema)


def test_stream_of_tracks(spark):
    """Rows in any order over several batches give the batch tracker's rows."""
    df, end = detections(spark)
    got, check = ST.replayed([*df.randomSplit([1.0] * 3, 7), end], lambda s: ST.tracked(ST.timed(s, LATE, 1.0), 5, 60.0, 1.0), TR.TRACKED)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, TR.tracked(df, 5, 60.0).collect())) and ST.late_rows(spark, check) == 0


def test_late_rows_are_counted(spark):
    df, end = detections(spark)
    late = F.col("frame_idx").between(20, 39)
    got, check = ST.replayed([df.where("frame_idx < 20"), df.where("frame_idx >= 40"), df.where(late), end], lambda s: ST.tracked(ST.timed(s, "5 seconds", 1.0), 5, 60.0, 1.0), TR.TRACKED)
    assert ST.late_rows(spark, check) == df.where(late).count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, TR.tracked(df.where(~late), 5, 60.0).collect()))


def test_stream_of_zones(spark):
    """Timers emit lost tracks as the batch form does; what the watermark hasn't passed stays."""
    rng = random.Random(2)
    rows = [(t, s + k, rng.choice([None, None, None, "7"]), float(k), 1.0) for t in range(20) for s in [rng.randrange(100)] for k in range(rng.randint(1, 30))]
    z = spark.createDataFrame(rows, "track_id long, frame_idx long, bib string, x double, y double")
    out = "track_id bigint, frame_idx bigint, bib string, x double, y double"
    end = spark.createDataFrame([(999, 500_000, None, 0.0, 0.0)], z.schema)
    got, _ = ST.replayed([*z.randomSplit([1.0] * 3, 7), end], lambda s: ST.zone(ST.timed(s, LATE, 1.0), 5, 20, 1.0), out)
    want = X.zone(z.unionByName(end).withColumn("last_frame", F.lit(500_000)), 5, 20)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    got, _ = ST.replayed([z], lambda s: ST.zone(ST.timed(s, "0 seconds", 1.0), 5, 20, 1.0), out)
    last = z.agg(F.max("frame_idx").alias("last_frame"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, X.zone(z.join(last), 5, 20).collect()))


def test_stream_of_associations(spark):
    """Votes move from a lost person to a new one near by, and the forgotten are evicted, as in the batch fold."""
    rng, rows = random.Random(3), []
    for f in range(60):
        for p in range(3):
            person, x = p if f < 30 or p != 1 else 10 + p, 100.0 * p + f
            if rng.random() < 0.85:
                rows.append(("r", f, "person", person, x, 50.0, x - 30, 0.0, x + 30, 100.0, None, None))
            if rng.random() < 0.7:
                rows.append(("r", f, "bib", 100 + p, x, 60.0, x - 10, 50.0, x + 10, 70.0, rng.choice([None, f"{p}23", f"{p}24"]), rng.choice(["high", "low", "reject"])))
        if f == 20:
            rows.append(("r", f, "person", 50, 2000.0, 50.0, 1990.0, 0.0, 2010.0, 100.0, None, None))
    schema = f"run_id string, frame_idx long, kind string, id long, cx double, cy double, {BOX}, number string, level string"
    d = spark.createDataFrame(rows, schema)
    item = ["id", "cx", "cy", "x1", "y1", "x2", "y2"]
    listed = lambda kind, name, *more: d.where(F.col("kind") == kind).groupBy("run_id", "frame_idx").agg(F.array_sort(F.collect_list(F.struct(*item, *more))).alias(name))
    bibs = listed("bib", "bibs", "number", "level")
    frames = listed("person", "persons").join(bibs, ["run_id", "frame_idx"], "left").withColumn("bibs", F.coalesce("bibs", F.array().cast(bibs.schema["bibs"].dataType)))
    want = sorted(map(tuple, A.associated(frames, 80.0, 15).collect()))
    end = spark.createDataFrame([("r", 500_000, "person", 1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, None, None)], schema)
    got, _ = ST.replayed([*d.randomSplit([1.0] * 3, 5), end], lambda s: ST.associated(ST.timed(s, LATE, 1.0), 80.0, 15, fps=1.0), "run_id string, frame_idx bigint, person bigint, number string, confidence double")
    assert sorted(map(tuple, got.collect())) == want and len({r[3] for r in want}) > 3


def test_stream_remembers_for_a_while(spark):
    """The state forgets silent tracks, the log keeps all; both as the batch form has it."""
    rng = random.Random(4)
    rows = list({(t, f): ("r", t, f, str(rng.randrange(3))) for t in range(30) for f in [rng.randrange(t * 10, t * 10 + 40) for _ in range(6)]}.values())
    df = spark.createDataFrame(rows, "run_id string, track_id long, frame_idx long, number string")
    got, check = ST.replayed(ST.slices(df, 4), lambda s: ST.remembered(ST.timed(s, "0 seconds", 1.0), 50, 1.0), "run_id string, track_id bigint, number string, last_frame bigint, live boolean")
    want = sorted(map(tuple, V.remembered(df, 50).collect()))
    assert sorted(map(tuple, ST.all_time(got).collect())) == want
    kept = spark.read.format("statestore").option("stateVarName", "machine").load(check).count()
    assert kept == sum(r[4] for r in want) < 10


# --- folds in chunks -------------------------------------------------------------------------------


def _moving(seed, frames=120):
    """Rows of boxes that come, go and cross, in two runs, with frames left out."""
    rng, rows = random.Random(seed), []
    for run in "ab":
        for f in range(frames):
            if rng.random() < 0.1:
                continue
            seen = [(run, 3 * f, x, y, x + 40.0, y + 60.0, rng.random()) for x, y in ((100.0 + 7 * (f % 45), 200.0), (600.0 - 7 * (f % 50), 220.0), (rng.randrange(800), rng.randrange(500))) if rng.random() < 0.8]
            rows += seen or [(run, 3 * f, None, None, None, None, None)]
    return [tuple(v if v is None or isinstance(v, (str, int)) and k < 2 else float(v) for k, v in enumerate(r)) for r in rows]


@pytest.mark.parametrize(("chunk", "before"), [(16, 8), (16, 0), (7, 2), (4096, 512)])
def test_chunks_equal_one_walk(spark, monkeypatch, chunk, before):
    """Right and wrong guesses, mended in rounds or in order, give the tracks of one walk, numbers included."""
    monkeypatch.setattr(FO, "CHUNK", chunk)
    monkeypatch.setattr(FO, "BEFORE", before)
    rows = _moving(chunk)
    got = TR.tracked(spark.createDataFrame(rows, f"run_id string, frame_idx long, {BOX}, confidence double"), 5, 60.0)
    want = set()
    for run in "ab":
        plain = TR.Tracker(5, 60.0)
        for f, own in itertools.groupby((r for r in rows if r[0] == run), key=lambda r: r[1]):
            found = plain.update(sorted(r[2:6] for r in own if r[2] is not None))
            want |= {(run, f, i, *p, *b, m) for i, (p, b, m) in found.items()}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_one_run_goes_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(FO, "CHUNK", 16)
    rows = [r for r in _moving(1) if r[0] == "a"]
    got = TR.tracked(spark.createDataFrame(rows, f"run_id string, frame_idx long, {BOX}, confidence double"), 5, 60.0)
    assert got.select(F.spark_partition_id()).distinct().count() > 1


def _sorted_sides(df):
    """The aggregations of a plan that sort what they are given."""
    return df._jdf.queryExecution().executedPlan().toString().count("SortAggregate")


def test_pairs_are_hashed_not_sorted(spark):
    """Of equally near numbers the least, and no sort of all pairs of a frame."""
    pairs = [(1, 1, 7, True, 5.0), (1, 1, 6, True, 5.0), (1, 1, 9, True, 4.0), (1, 1, 8, True, 4.0), (1, 2, 5, False, 3.0), (1, 2, 9, True, 2.0), (1, 2, 8, True, 2.0), (2, 1, 4, False, 3.0), (2, 1, 3, False, 200.0)]
    got = A.best_bib(spark.createDataFrame(pairs, "frame_idx long, person long, bib long, inside boolean, dist double"), 150.0)
    assert {tuple(r) for r in got.collect()} == {(1, 1, 8, 4.0), (1, 2, 8, 2.0), (2, 1, 4, 3.0)}
    assert _sorted_sides(got) == 0


def test_numbers_in_a_box_are_hashed_not_sorted(spark):
    """The surest number, of equals the least; the pairs of a frame are hashed, only the winners' texts are sorted."""
    events = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (2, 1, 20.0, 0.0, 30.0, 10.0), (3, 2, 0.0, 0.0, 10.0, 10.0)], f"event long, frame_idx long, {BOX}")
    seen = [(1, 5.0, 5.0, "12", 0.9, "high"), (1, 6.0, 5.0, "11", 0.9, "high"), (1, 6.0, 5.0, "10", 0.8, "high"), (1, 25.0, 5.0, "13", 0.7, "medium"), (2, 50.0, 5.0, "14", 0.9, "high"), (2, 5.0, 5.0, "15", 0.9, "low")]
    got = R.contained(events, spark.createDataFrame(seen, "frame_idx long, bx double, by double, number string, conf double, level string"))
    assert {tuple(r) for r in got.collect()} == {(1, "11"), (2, "13")}
    per = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Aggregate" in line]
    assert any("HashAggregate" in line and "min(place" in line for line in per)


def test_stream_calls_for_groups_of_keys(spark):
    """Many tracks are dealt to few keys of the state store, and keys of any kind come back as they were."""
    rows = [(None if t == 7 else f"r{t % 3}", 9_007_199_254_740_993 + t, 10 * t + k, "5" if k == 4 and t % 2 else None, float(t), 1.0) for t in range(300) for k in range(6)]
    z = spark.createDataFrame(rows, "run_id string, track_id long, frame_idx long, bib string, x double, y double")
    out = "run_id string, track_id bigint, frame_idx bigint, bib string, x double, y double"
    got, check = ST.replayed(ST.slices(z, 2), lambda s: ST.zone(ST.timed(s, "5 seconds", 1.0), 5, 20, 1.0, ("run_id", "track_id")), out)
    assert ST.late_rows(spark, check) == 0
    first = {t: next(f for _, u, f, *_ in rows if u == t) for _, t, *_ in rows}
    end = max(f for _, _, f, *_ in rows) - 5  # as far as the watermark comes
    want = [(r, t, f, "5", x, y) for r, t, f, b, x, y in rows if b and f <= end]
    want += [(r, t, f + 21, "UNKNOWN", x, y) for r, t, f, b, x, y in rows if f == first[t] + 5 and (t - 9_007_199_254_740_993) % 2 == 0 and f + 21 <= end]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    held = spark.read.format("statestore").option("stateVarName", "held").load(check)
    assert held.schema["key"].dataType.names == ["key_group"]  # not a key for each track


def test_stream_gives_rows_in_portions(spark, monkeypatch):
    """What comes in and goes out in several portions is what came in one."""
    df, end = detections(spark)
    monkeypatch.setattr(ST, "PORTION", 7)
    got, _ = ST.replayed([df, end], lambda s: ST.tracked(ST.timed(s, LATE, 1.0), 5, 60.0, 1.0), TR.TRACKED)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, TR.tracked(df, 5, 60.0).collect()))


def test_held_rows_are_not_gathered():
    """Rows that come in no order meet each block's held rows on their own, however many blocks there are."""
    new, here, state = {}, [], {}

    class Blocks:
        def getValue(self, block):
            here.append(sum(len(rows) for own in new.values() for rows in own.values()))
            return state.get(block)

        def updateValue(self, block, value):
            state[block] = value

    machine = ST._Tracks([], [], 1.0)
    machine.held = Blocks()
    for first in (0, 1):
        new.update({b: {str(64 * b + k): [[first]] for k in range(1 if first else 64)} for b in range(50)})
        machine.hold(new)
    assert max(here[50:]) <= 50 and not new
    assert all(json.loads(state[b,][0]) == {str(64 * b + k): [[0], [1]] if k == 0 else [[0]] for k in range(64)} for b in range(50))


@pytest.mark.parametrize(("chunk", "before"), [(16, 8), (16, 0), (4096, 512)])
def test_box_chunks_equal_one_walk(spark, monkeypatch, chunk, before):
    """The box tracker's chunks give the tracks of the plain one, numbers included, and one run goes to many tasks."""
    monkeypatch.setattr(FO, "CHUNK", chunk)
    monkeypatch.setattr(FO, "BEFORE", before)
    rows = _moving(chunk + before)
    got = K.tracked(spark.createDataFrame(rows, f"run_id string, frame_idx long, {BOX}, confidence double"), 5)
    want = set()
    for run in "ab":
        plain = PlainTracker(gone=5)
        for f, own in itertools.groupby((r for r in rows if r[0] == run), key=lambda r: r[1]):
            found = sorted(r[2:] for r in own if r[2] is not None)
            want |= {(run, f, i, *found[k]) for i, k in plain.update([b[:4] for b in found], [b[4] for b in found]).items()}
    have = got.select("run_id", "frame_idx", "track_id", "x1", "y1", "x2", "y2", "confidence")
    assert {tuple(r) for r in have.collect()} == want and have.count() == len(want)
    assert chunk > 100 or got.where("run_id = 'a'").select(F.spark_partition_id()).distinct().count() > 1


def test_box_overlaps_as_arrays_equal_single_ones():
    rng = np.random.default_rng(2)
    a, b = ([(x, y, x + w, y + h) for x, y, w, h in (rng.random((n, 4)) * [90, 90, 40, 40]).tolist()] for n in (9, 11))
    assert K.overlaps(np.array(a), np.array(b)).tolist() == [[K.overlap(x, y) for y in b] for x in a]
    near = K.overlaps(np.array(a), np.array(b))
    assert sorted(K.matched(near, 0.1)) == sorted(K.matched(near.tolist(), 0.1)) != []


def test_run_does_not_broadcast_what_it_wrote(spark):
    """Files of many equal rows are small; what is joined with them must not become a table in the driver."""
    a = PL._cut(spark.range(1000).select((F.col("id") % 7).alias("k"), F.lit(1).alias("v")), "a")
    b = PL._cut(spark.range(1000).select((F.col("id") % 7).alias("k"), F.lit(2).alias("w")), "b").where("w > 1").groupBy("k").agg(F.max("w").alias("w"))
    for how in ("inner", "left", "left_semi"):
        plan = a.select("k", "v").join(b, "k", how)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_wrong_guesses_are_walked_in_stretches(spark, monkeypatch):
    """What guesses get wrong round after round is walked in stretches that grow, not as one task for the rest of a run, with the rows of one walk."""

    class _Sum(FO.Machine):
        """Its state is a sum of all rows, so no guess is ever right."""

        def __init__(self):
            self.sum = 0

        def step(self, row):
            self.sum += int(row.n)
            return [(row.run_id, row.frame_idx, self.sum)]

        def dump(self):
            return str(self.sum).encode()

        def load(self, state):
            self.sum = int(state)

    for name, value in (("CHUNK", 4), ("BEFORE", 2), ("ROUNDS", 1), ("STRETCH", 2)):
        monkeypatch.setattr(FO, name, value)
    rows = [(run, k, (k * 7 + 3) % 5 + (run == "b")) for run, many in (("a", 70), ("b", 9), ("c", 1)) for k in range(many)]
    df = spark.createDataFrame(rows, "run_id string, frame_idx long, n long")
    table = lambda found: pd.DataFrame(found, columns=["run_id", "frame_idx", "total"])
    got = FO.spliced(df, ["run_id"], ["frame_idx"], _Sum, table, "run_id string, frame_idx bigint, total bigint").collect()
    want, total = [], {}
    for run, k, n in rows:
        total[run] = total.get(run, 0) + n
        want.append((run, k, total[run]))
    assert sorted(map(tuple, got)) == want
