"""Image functions over stacks against plain loops, made crops, and running sums over ranges."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from raceflow.functions import text as T
from raceflow.operators import images as I
from raceflow.operators import ordering as O
from raceflow.operators import quality as Q
from raceflow.operators import recovery as R
from raceflow.operators import registry as REG
from raceflow.operators import review as RV


def plain_resize(g, height, width):
    h, w = g.shape
    out = np.zeros((height, width))
    for y in range(height):
        for x in range(width):
            v, u = min(max((y + 0.5) * h / height - 0.5, 0), h - 1), min(max((x + 0.5) * w / width - 0.5, 0), w - 1)
            a, b = math.floor(v), math.floor(u)
            c, d, fy, fx = min(a + 1, h - 1), min(b + 1, w - 1), v - math.floor(v), u - math.floor(u)
            top, low = (1 - fy) * float(g[a, b]) + fy * float(g[c, b]), (1 - fy) * float(g[a, d]) + fy * float(g[c, d])
            out[y, x] = (1 - fx) * top + fx * low
    return out


def plain_equalise(g, tiles, clip):
    h, w = g.shape
    wide = np.pad(g, [(0, -h % tiles), (0, -w % tiles)], mode="symmetric")
    th, tw = wide.shape[0] // tiles, wide.shape[1] // tiles
    lut = {}
    for i in range(tiles):
        for j in range(tiles):
            counts = [0] * 256
            for v in wide[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel():
                counts[v] += 1
            most, over = max(1, int(clip * th * tw / 256)), 0
            for v in range(256):
                if counts[v] > most:
                    over += counts[v] - most
                    counts[v] = most
            counts = [c + over // 256 for c in counts]
            rest = over % 256
            if rest:
                step, k = max(256 // rest, 1), 0
                while k < 256 and rest:
                    counts[k] += 1
                    k, rest = k + step, rest - 1
            total = 0
            for v in range(256):
                total += counts[v]
                lut[i, j, v] = min(255, round(total * (255.0 / (th * tw))))
    out = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            v, u = (y + 0.5) / th - 0.5, (x + 0.5) / tw - 0.5
            a, b = math.floor(v), math.floor(u)
            fy, fx = v - a, u - b
            at = lambda i, j: lut[min(max(i, 0), tiles - 1), min(max(j, 0), tiles - 1), g[y, x]]  # noqa: B023, E731
            out[y, x] = (1 - fy) * ((1 - fx) * at(a, b) + fx * at(a, b + 1)) + fy * ((1 - fx) * at(a + 1, b) + fx * at(a + 1, b + 1))
    return out


@pytest.mark.parametrize("shape", [(1, 1), (5, 9), (32, 48), (33, 50)])
def test_equalise_and_resize_against_loops(shape):
    rng = np.random.default_rng(shape[0])
    stack = np.stack([rng.integers(0, 256, shape), np.full(shape, 77), rng.normal(120, 12, shape).clip(0, 255)]).astype(np.uint8)
    for tiles, clip in ((4, 2.0), (2, 40.0)):
        got = I.equalised(stack, tiles, clip)
        assert all(np.abs(a - plain_equalise(g, tiles, clip)).max() <= 0.5 + 1e-6 for a, g in zip(got, stack))
    for size in ((7, 5), (64, 64), shape):
        got = I.resized(stack, *size)
        assert all(np.abs(a - plain_resize(g, *size)).max() <= 0.5 + 1e-6 for a, g in zip(got, stack))
    assert I.upscaled(stack, 16).shape == (3, max(16, shape[0]), shape[1] if shape[0] >= 16 else round(shape[1] * 16 / shape[0])) and I.upscaled(stack, 1) is stack


def test_equalise_raises_local_contrast():
    y, x = np.mgrid[0:64, 0:64]
    dull = (100 + 60 * (x > 32) + 4 * ((x // 4 + y // 4) % 2)).astype(np.uint8)[None]
    assert I.equalised(dull, 4, 4.0)[0, :, :24].std() >= 2 * dull[0, :, :24].std()


def test_columns_of_crops(spark):
    """Crops of several sizes in one column; null, empty and rowless ones give null; a last row that isn't whole goes."""
    rng = np.random.default_rng(1)
    crops = [(rng.integers(0, 256, (h, w)).astype(np.uint8).tobytes(), w) for h, w in [(8, 8), (9, 5), (8, 8), (20, 30)]]
    rows = [*crops, (None, 5), (b"", 5), (b"abc", 5), (b"abc", None), (b"abc", 0), (crops[0][0] + b"x", 8)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p binary, w int").repartition(3)
    got = {r.i: r.c for r in df.select("i", I.mapped("p", "w", lambda s: I.resized(s, 4, 6)).alias("c")).collect()}
    for i, (p, w) in enumerate(rows):
        if i in (4, 5, 6, 7, 8):
            assert got[i].pixels is None and got[i].width is None
        else:
            g = np.frombuffer(p, np.uint8, len(p) // w * w).reshape(-1, w)
            assert got[i].width == 6 and bytes(got[i].pixels) == I.resized(g[None], 4, 6)[0].tobytes()
    stats = {r.i: r.s for r in df.select("i", Q.crop_stats("p", "w").alias("s")).collect()}
    assert stats[0] == stats[9] and set(stats[4]) == set(stats[6]) == {0.0}


def test_made_crops(spark):
    """The same bytes however rows are dealt out; legible, different for other keys, and harder when asked for."""
    df = spark.createDataFrame([(k, str(100 + k)) for k in range(40)] + [(99, None), (98, ""), (97, "1a2")], "k long, number string")
    one = {r.k: r.c for r in df.select("k", I.synthetic("number", "k").alias("c")).collect()}
    two = {r.k: r.c for r in df.repartition(7, "number").select("k", I.synthetic("number", "k").alias("c")).collect()}
    assert one == two and one[99].pixels is None and len({bytes(x.pixels) for x in one.values() if x.pixels}) == 42
    assert one != {r.k: r.c for r in df.select("k", I.synthetic("number", "k", seed=1).alias("c")).collect()}
    stats = df.where("k < 40").select(I.synthetic("number", "k").alias("c")).select(Q.crop_stats("c.pixels", "c.width").alias("s")).select("s.*").collect()
    assert np.mean([r.contrast > 20 for r in stats]) > 0.9 and np.mean([r.extent > 0.5 for r in stats]) > 0.9
    clean, hard = (np.mean([Q.pixel_stats(I.rendered("1234", k, hard=h))[0] for k in range(40)]) for h in (False, True))
    assert clean != hard and I.rendered("8", 3).shape == (32, 128)


def test_glyphs_differ():
    assert len({I.drawn(str(d)).tobytes() for d in range(10)}) == 10 and I.drawn("12").shape == (11, 15) and I.drawn("").shape == (11, 5)


def test_running_sums(spark):
    """Sums of keys with very many rows, repeated rows and null keys, over many ranges."""
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(30)]), rng.randrange(5)) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, v long, n long").repartition(8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else few rows are one range
    try:
        got = O.running(df, "sum", F.col("n"), ("k",), ("v",)).collect()
        whole = O.running(df, "place", F.lit(1), (), ("v", "k")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    at = lambda v: -1 if v is None else v
    assert len(got) == 400 and sorted(r.place for r in whole) == list(range(1, 401))
    assert [at(r.v) for r in sorted(whole, key=lambda r: r.place)] == sorted(at(v) for _, v, _ in rows)
    for key in ("a", "b", None):
        own = sorted((r for r in got if r.k == key), key=lambda r: (at(r.v), r.sum))
        total = 0
        for r in own:
            assert r.sum >= total
            total = r.sum
        assert total == sum(n for k, _, n in rows if k == key)
        for r in own:
            before = sum(n for k, v, n in rows if k == key and at(v) < at(r.v))
            assert before <= r.sum <= before + sum(n for k, v, n in rows if k == key and v == r.v)


def test_groups_over_ranges(spark):
    rng = random.Random(4)
    rows = [(run, f, t) for run in ("x", "y") for t, f in enumerate(sorted(rng.randrange(300) for _ in range(60)))]
    got = R.place_in_group(spark.createDataFrame(rows, "run_id string, frame_idx long, track_id long"), 4).collect()
    for run in ("x", "y"):
        group, before, first, seen = 0, None, None, []
        own = sorted((r.frame_idx, r.track_id, r.group, r.position) for r in got if r.run_id == run)
        for f, _, g, p in own:
            if before is None or f - before > 4:
                group, seen = group + 1, []
            seen.append(f)
            before = f
            assert (g, p) == (group, 1 + sum(x < f for x in seen))


def test_queue_reasons_and_parsing(spark):
    schema = "bib string, conf double, frame_number long, level string, is_valid boolean, is_corrected boolean, original string, is_stable boolean, alternatives array<string>, reason string"
    rows = [("12", 0.4, 1, "reject", False, True, "1Z", False, ["13"], None), ("13", 0.9, 2, "high", True, False, "13", True, None, ""), ("14", 0.9, 3, "high", True, False, "14", True, [], "asked for")]
    got = {r.bib: (r.id, r.reason, r.alternatives) for r in RV.added(spark.createDataFrame(rows, schema), 2).collect()}
    assert got == {"13": ("review_2", "Needs verification", []), "14": ("review_3", "asked for", [])}
    one = RV.added(spark.createDataFrame(rows[:1], schema)).first()
    assert (one.reason, one.alternatives) == ("Very low confidence; Not in bib set; Auto-corrected 1Z->12; Unstable across frames", ["13"])
    texts = ["0,0.5,1,-1", "1,2,3", "1,2,3,x", "", None, "5-9", "9-", "-3", "a-b", "7"]
    got = {r.t: (r.line and tuple(r.line), r.range and tuple(r.range)) for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.line_of(F.col("t")).alias("line"), T.range_of(F.col("t")).alias("range")).collect()}
    assert {t: v for t, v in got.items() if v != (None, None)} == {"0,0.5,1,-1": ((0.0, 0.5, 1.0, -1.0), None), "5-9": (None, (5, 9))}


def test_ranges_of_texts(spark):
    df = spark.createDataFrame([("3-5",), ("5-6",), ("9-8",), ("x",), (None,)], "t string")
    assert sorted(r.bib for r in REG.of_ranges(F.col("t"), df).collect()) == ["3", "4", "5", "6"]


def test_cascade_totals(spark):
    rows = spark.createDataFrame([("a", 1, "fast"), ("a", 5, "slow"), ("a", 7, "fast"), ("b", 1, "slow"), ("c", 3, "fast")], "run_id string, frame_idx long, model string")
    resets = spark.createDataFrame([("a", 1), ("a", 5), ("c", 9)], "run_id string, frame_idx long")
    got = {r.run_id: tuple(r)[1:] for r in Q.cascade_totals(rows, resets).collect()}
    assert got == {"a": (1, 1, 0, 100.0, 0.0), "b": (1, 0, 1, 0.0, 100.0), "c": (0, 0, 0, 0.0, 0.0)}


def test_small_crops_that_become_large_are_made_in_pieces():
    """What a change makes is bounded by the size it makes, not by the size it gets."""
    sizes = []

    def change(stack):
        out = I.upscaled(stack)
        sizes.append(out.size)
        return out

    pixels = pd.Series([bytes([k % 250] * 40) for k in range(300)] + [None, b"x" * 4000])
    got = I.changed(pixels, pd.Series([40] * 302), change)
    assert max(sizes) <= I.PIECE and got["pixels"].map(lambda p: 0 if p is None else len(p)).tolist() == [64 * 2560] * 300 + [0, 4000]
    one = np.arange(40, dtype=np.uint8)[None, None]
    assert got["pixels"][0] == bytes(64 * 2560) and (I.resized(np.repeat(one, 9, 0), 64, 2560) == I.resized(one, 64, 2560)).all()


def test_made_crops_of_a_small_file_go_to_many_tasks(spark, tmp_path):
    from raceflow.plans import queries as PQ

    spark.range(40).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    assert PQ.ds_synth(spark, str(tmp_path)).select(F.spark_partition_id()).distinct().count() > 1
