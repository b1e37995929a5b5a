"""Readers and writers on files, the frame source, streams, and a run from end to end."""

from __future__ import annotations

import itertools
import json

import pytest
from pyspark.sql import functions as F

from raceflow.config import Config, Line
from raceflow.operators import crossing as X
from raceflow.operators import dedup as D
from raceflow.operators import voting as V
from raceflow.plans import pipeline
from raceflow.sources import readers, sinks
from raceflow.streaming import jobs


def test_registry_and_photos(spark, tmp_path):
    (tmp_path / "bibs.txt").write_text(" 12 \n\n34\n12\n")
    assert sorted(r.bib for r in readers.registry(spark, str(tmp_path / "bibs.txt")).collect()) == ["12", "34"]
    (tmp_path / "p.csv").write_text('camera_tag,image_url,event_image_id,associated_bibs\nc1,u1,7,"12\n 34 \n"\nc2,u2,8,\n')
    got = {r.image_id: r.bibs for r in readers.provider_photos(spark, str(tmp_path / "p.csv")).collect()}
    assert got == {"7": ["12", "34"], "8": []}


def test_labels_coco_yolo(spark, tmp_path):
    (tmp_path / "l.tsv").write_text("a.jpg\t123\nb.jpg\t12345\nc.jpg\tx\n")
    assert [(r.filename, r.digit_count) for r in readers.labels_tsv(spark, str(tmp_path / "l.tsv"), "e").collect()] == [("a.jpg", 3)]
    (tmp_path / "c.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "a"}], "annotations": [{"id": 2, "image_id": 1, "bbox": [0, 0, 1, 1]}], "categories": [{"id": 0, "name": "bib"}]}))
    images, annotations, categories = readers.coco(spark, str(tmp_path / "c.json"))
    assert (images.count(), annotations.first().image_id, categories.first().name) == (1, 1, "bib")
    (tmp_path / "bad.json").write_text('{"images": []}')
    with pytest.raises(ValueError):
        readers.coco(spark, str(tmp_path / "bad.json"))
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "a.txt").write_text("0 0.5 0.5 0.1 0.2\n1 0.5 0.5 0.1 0.2\n0 0.5 x 0.1 0.2\n0 0.5\n")
    assert readers.yolo_labels(spark, str(tmp_path / "y")).count() == 1


def test_runs_and_manifest(spark, tmp_path):
    for run, names in {"r1": ["crossings.csv"], "r2": ["review_queue.json", "out.mp4"]}.items():
        (tmp_path / run).mkdir()
        for n in names:
            (tmp_path / run / n).write_text("x")
    got = readers.runs(spark, str(tmp_path)).collect()
    assert [(r.run, r.has_crossings, r.has_review, r.has_video) for r in got] == [("r2", False, True, True), ("r1", True, False, False)]
    content = spark.createDataFrame([("a", b"1"), ("b", b"2")], "name string, content binary")
    sha = {r.name: r.h for r in content.select("name", F.sha2("content", 256).alias("h")).collect()}
    m = spark.createDataFrame([("a", sha["a"], 1), ("b", "0", 1), ("c", "0", 1)], "name string, sha256 string, size long")
    assert {r.name: r.state for r in readers.manifest_state(m, content).collect()} == {"a": "ok", "b": "sha_mismatch", "c": "missing"}


def test_logs(spark, tmp_path):
    row = {c: None for c in "x1 y1 x2 y2 det_conf ocr_raw ocr_conf validated is_valid consensus consensus_conf is_stable final_level".split()} | {"frame": 3, "time_sec": 0.2, "track_id": 1, "x1": 10, "y1": 10, "x2": 30, "y2": 30, "ocr_conf": 0.9}
    df = spark.createDataFrame([row], readers.DETECTIONS.replace(" bigint", " long"))
    sinks.write_csv(sinks.detections_rows(df), str(tmp_path / "d"))
    back = readers.detections_log(spark, str(tmp_path / "d")).first()
    assert (back.frame, back.time_sec, back.x2, back.ocr_conf) == (3, 0.2, 30, 0.9)
    event = spark.createDataFrame([(1, 100, 3.3333, 5, "1234", 0.95, 1, 100, 200, 300, 500, 200.0, 350.0, "pose")], "sequence int, frame long, time_sec double, person_track_id long, bib_number string, confidence double, estimated_count int, person_x1 int, person_y1 int, person_x2 int, person_y2 int, chest_x double, chest_y double, source string")
    r = sinks.crossings_rows(event).first()
    assert (r.time_sec, r.confidence, r.chest_x) == ("3.333", "0.950", "200.0") and len(r) == 14
    lines = {f: sinks.timing_lines(spark.createDataFrame([(1, "1234", 50535.31)], "sequence int, bib string, time_sec double"), time_format=f, day="2026-02-01").first().line for f in ("normal", "iso", "msecs", "unix")}
    assert lines["normal"] == "CT01_33~1~finish~1234~14:02:15.31~0~RACEFLOW~0\r\n"
    assert "2026-02-01T14:02:15.31" in lines["iso"] and "~50535310~" in lines["msecs"] and lines["unix"].split("~")[4].endswith(".31")
    q = json.loads(sinks.json_array(spark.createDataFrame([("b", 2), ("a", 1)], "id string, n int"), "n").first().json)
    assert q == [{"id": "a", "n": 1}, {"id": "b", "n": 2}]


def test_frames_source(spark):
    spark.dataSource.register(readers.FrameSource)
    df = spark.read.format("frames").option("frames", 10).option("width", 4).option("height", 2).load()
    assert df.count() == 10 and df.agg(F.max("frame_idx"), F.max(F.length("payload"))).first()[:] == (10, 8)
    assert [r.frame_idx for r in readers.strided(df, 3, 4).orderBy("frame_idx").collect()] == [6, 9]


def stream(spark, df, tmp_path, name):
    path = str(tmp_path / name)
    df.repartition(3).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 3).parquet(path)


def collected(spark, rows, name):
    q = rows.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_streams_equal_batches(spark, tmp_path):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    line = Line(0.3459, 0, 0.3459, 1)
    obs = ev.select(F.col("user_id").alias("track_id"), F.col("event_id").alias("frame_idx"), (F.col("value") / 100).alias("x"), (F.col("k") / 100).alias("y"))
    got = {(r.track_id, r.frame_idx) for r in collected(spark, jobs.crossings(stream(spark, obs, tmp_path, "o"), line, 2, 50), "crossings")}
    assert got == {(r.track_id, r.frame_idx) for r in X.crossings(obs, line, 2, 50).collect()}
    reads = ev.select(F.col("user_id").alias("track_id"), F.col("event_id").alias("frame_idx"), (1000 + F.col("k") % 5).cast("string").alias("number"), (F.lit(0.3) + F.col("k") / 200).alias("conf"))
    got = {(r.track_id, r.frame_idx): (r.winner, round(r.confidence, 9), r.is_stable) for r in collected(spark, jobs.votes(stream(spark, reads, tmp_path, "r"), stable=2), "votes")}
    assert got == {(r.track_id, r.frame_idx): (r.winner, round(r.confidence, 9), r.is_stable) for r in V.consensus(reads, stable=2).collect()}
    em = reads.select(F.col("number").alias("bib"), "frame_idx", "conf", "track_id", F.col("frame_idx").cast("double").alias("x"), F.lit(0.0).alias("y"))
    got = {(r.bib, r.frame_idx) for r in collected(spark, jobs.deduplicated(stream(spark, em, tmp_path, "e"), 20, 5.0), "dedup")}
    assert got == {(r.bib, r.frame_idx) for r in D.deduplicated(em, 20, 5.0).where("emitted").collect()}


def test_equal_votes_of_a_stream_go_to_the_first(spark, tmp_path):
    reads = spark.createDataFrame([(1, 0, "a", 0.011), (1, 1, "b", 0.0099), (2, 0, "a", 0.022), (2, 1, "b", 0.0198)], "track_id long, frame_idx long, number string, conf double")  # 0.9 * 0.011 < 0.0099 as doubles
    got = {(r.track_id, r.frame_idx): r.winner for r in collected(spark, jobs.votes(stream(spark, reads, tmp_path, "t")), "ties")}
    assert got == {(r.track_id, r.frame_idx): r.winner for r in V.consensus(reads).collect()} == dict.fromkeys(itertools.product((1, 2), (0, 1)), "a")


def test_manager(spark, tmp_path):
    df = spark.range(5).withColumn("sequence", F.col("id"))
    m, seen = jobs.Manager(), []
    with pytest.raises(RuntimeError):
        m.start()
    m.add(lambda b, e: seen.append(b.count()))
    m.add(jobs.upsert(str(tmp_path / "log")))
    m.remove(print)
    m.configure(stream(spark, df, tmp_path, "s"), str(tmp_path / "cp"), {"availableNow": True})
    m.start()
    with pytest.raises(RuntimeError):
        m.start()
    m.query.awaitTermination()
    assert m.status()["state"] == "running" and sum(seen) == 5
    m.stop()
    assert m.state == "idle" and spark.read.parquet(str(tmp_path / "log")).count() == 5


def test_run_end_to_end(spark):
    frames = range(1, 41)
    box = "x1 double, y1 double, x2 double, y2 double"
    at = lambda f: 700.0 + 12 * f
    dets = spark.createDataFrame([("r", f, at(f), 400.0, at(f) + 60, 440.0, 0.9) for f in frames], f"run_id string, frame_idx long, {box}, confidence double")
    reads = spark.createDataFrame([("r", f, at(f), 400.0, at(f) + 60, 440.0, "1234", 0.9) for f in frames], f"run_id string, frame_idx long, {box}, raw string, conf double")
    people = spark.createDataFrame([("r", f, at(f) - 40, 250.0, at(f) + 100, 650.0, at(f) + 30, 420.0) for f in frames], f"run_id string, frame_idx long, {box}, cx double, cy double")
    reg = spark.createDataFrame([("1234",), ("5678",)], "bib string")
    for mode in ("line", "zone"):
        out = pipeline.run(dets, reads, people, reg, Config(mode=mode, debounce_time=0.1))
        got = out.crossings.collect()
        assert [(r.sequence, r.bib) for r in got] == [(1, "1234")]
        if mode == "line":
            assert got[0].frame_idx == next(f for f in frames if at(f) + 30 > 960) + 2 and abs(got[0].time_sec - (got[0].frame_idx - 1) / 30) < 1e-9
    assert out.consensus.first().number == "1234" and out.detections.count() <= 40


def _scene(spark, runs):
    """Tables of runs; a run is a list of (row, text, plate seen from frame, until) of persons who cross the line one below the other."""
    box = "x1 double, y1 double, x2 double, y2 double"
    dets, reads, people = [], [], []
    for run, persons in runs.items():
        for row, text, first, until in persons:
            for f in range(1, 41):
                x, y = 700.0 + 12 * f, 150.0 + 260 * row
                people.append((run, f, x - 40, y - 80, x + 100, y + 120, x + 30, y + 20))
                if text and first <= f <= until:
                    dets.append((run, f, x, y, x + 60, y + 40, 0.9))
                    reads.append((run, f, x, y, x + 60, y + 40, text, 0.9))
    return (
        spark.createDataFrame(dets, f"run_id string, frame_idx long, {box}, confidence double"),
        spark.createDataFrame(reads, f"run_id string, frame_idx long, {box}, raw string, conf double"),
        spark.createDataFrame(people, f"run_id string, frame_idx long, {box}, cx double, cy double"),
    )


def test_runs_dont_mix(spark):
    """A run alone and beside others gives the same crossings; numbers of one run never reach another's persons."""
    runs = {"a": [(0, "1234", 1, 40), (2, "5678", 1, 40)], "b": [(0, None, 0, 0), (2, "1234", 1, 40)], "c": [(0, "5678", 1, 40)]}
    reg = spark.createDataFrame([("1234",), ("5678",)], "bib string")
    both = pipeline.run(*_scene(spark, runs), reg, Config(debounce_time=0.1)).crossings.collect()
    got = {run: sorted((r.sequence, r.frame_idx, r.bib, r.source) for r in both if r.run_id == run) for run in runs}
    assert {b for _, _, b, _ in got["a"]} == {"1234", "5678"} and [b for _, _, b, _ in got["c"]] == ["5678"]
    assert "5678" not in {b for _, _, b, _ in got["b"]}
    alone = pipeline.run(*_scene(spark, {"b": runs["b"]}), reg, Config(debounce_time=0.1)).crossings.collect()
    assert sorted((r.sequence, r.frame_idx, r.bib, r.source) for r in alone) == got["b"]


def test_later_levels_and_postproc(spark):
    """A plate seen early only is found again; gates and digit swaps act before voting; the surest reading counts."""
    reg = spark.createDataFrame([("1234",), ("5678",)], "bib string")
    dets, reads, people = _scene(spark, {"r": [(0, "1234", 1, 8)]})
    assert [r.bib for r in pipeline.run(dets, reads, people, reg, Config(debounce_time=0.1)).crossings.collect()] == ["1234"]
    blocked = reads.withColumn("gate", F.lit("blurry"))
    assert [(r.bib, r.confidence) for r in pipeline.run(dets, blocked, people, reg, Config(debounce_time=0.1)).crossings.collect()] == [("UNKNOWN", 0.0)]
    digit = lambda d, p, r: F.struct(F.lit(d).alias("digit"), F.lit(p).alias("prob"), F.lit(r).alias("ru_digit"), F.lit(0.3).alias("ru_prob"))
    swap = reads.withColumn("raw", F.lit("1934")).withColumn("digits", F.array(digit("1", 0.9, "7"), digit("9", 0.5, "2"), digit("3", 0.9, "8"), digit("4", 0.9, "1")))
    out = pipeline.run(dets, swap, people, reg, Config(debounce_time=0.1))
    assert [r.bib for r in out.crossings.collect()] == ["1234"] and out.detections.select("is_valid").distinct().collect()[0][0]


def test_resolved_afterwards(spark):
    events = spark.createDataFrame([("r", 1, 100, "UNKNOWN", 0.0, 0.0, "pose"), ("r", 2, 110, "7", 5.0, 5.0, "pose"), ("s", 1, 100, "UNKNOWN", 0.0, 0.0, "pose")], "run_id string, sequence long, frame_idx long, bib string, x double, y double, source string")
    sure = spark.createDataFrame([("r", 104, "8", 3.0, 4.0), ("r", 101, "7", 0.0, 0.0), ("s", 2000, "9", 0.0, 0.0)], "run_id string, frame_idx long, number string, bx double, by double")
    got = {(r.run_id, r.sequence): (r.bib, r.source) for r in pipeline.resolved(events, sure, None, Config()).collect()}
    assert got == {("r", 1): ("8", "postproc"), ("r", 2): ("7", "pose"), ("s", 1): ("UNKNOWN", "pose")}
