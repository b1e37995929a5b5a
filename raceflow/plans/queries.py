"""One query for each operator over the views, with the same result as SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from raceflow import shared
from raceflow.config import Config
from raceflow.functions import decoding
from raceflow.functions import geometry as G
from raceflow.functions import text as T
from raceflow.operators import association as A
from raceflow.operators import crossing as X
from raceflow.operators import dataset as DS
from raceflow.operators import dedup as D
from raceflow.operators import images as IM
from raceflow.operators import kalman as K
from raceflow.operators import quality as Q
from raceflow.operators import recovery as R
from raceflow.operators import registry as REG
from raceflow.operators import review as RV
from raceflow.operators import tracking as TR
from raceflow.operators import voting as V
from raceflow.plans import pipeline
from raceflow.plans import views as W
from raceflow.sources import readers, sinks
from raceflow.streaming import buffers, jobs
from raceflow.streaming import state as ST

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


#: SQL of the registered numbers that are a prediction with a digit more, the three best.
_ALTERNATIVES = """SELECT pred, list_slice(list(bib ORDER BY score DESC, bib), 1, 3) AS a FROM (SELECT pred, bib, max(score) AS score FROM (SELECT pred, d || pred AS bib, 2 AS score FROM preds JOIN (SELECT CAST(range AS VARCHAR) AS d FROM range(1, 10)) ON true UNION ALL SELECT pred, pred || d, 1 FROM preds JOIN (SELECT CAST(range AS VARCHAR) AS d FROM range(0, 10)) ON true) WHERE bib IN (SELECT bib FROM registry) GROUP BY 1, 2) GROUP BY 1"""


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name; sql reads the views of WITH."""

    def put(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = (W.WITH.rstrip() + ",\n" + sql.strip()[5:]) if sql.strip().startswith("WITH ") else W.WITH + sql
        return f

    return put


def _put(write: Callable[[str], None], s: SparkSession, name: str) -> str:
    """Writes to a new path of the shared folder, which it returns."""
    path = shared.path(s, name)
    write(path)
    return path


# --- sources --------------------------------------------------------------------------------------


@query("SELECT run_id, frame_idx, track_id FROM reads WHERE frame_idx % 3 = 0")
def src_stride(s, d):
    return readers.strided(W.reads(s, d), 3).select("run_id", "frame_idx", "track_id")


@query("SELECT run_id, frame_idx, track_id FROM reads WHERE frame_idx >= 2000")
def src_seek(s, d):
    return readers.strided(W.reads(s, d), 1, 2000).select("run_id", "frame_idx", "track_id")


@query("SELECT DISTINCT CAST(unnest(range(s_suppkey * 40, s_suppkey * 40 + s_nationkey)) AS VARCHAR) AS bib FROM supplier")
def src_bibrange(s, d):
    """The numbers of ranges given as texts, one for each supplier; some are empty."""
    k = F.col("s_suppkey") * 40
    return REG.of_ranges(F.concat(k.cast("string"), F.lit("-"), (k + F.col("s_nationkey") - 1).cast("string")), W.table(s, d, "supplier"))


@query("SELECT DISTINCT trim(p_brand) AS bib FROM part WHERE trim(p_brand) <> ''")
def src_bibset(s, d):
    lines = W.table(s, d, "part").select(F.explode(F.array(F.concat(F.lit("  "), "p_brand", F.lit("\t")), F.lit(" "))).alias("value"))
    return readers.registry(s, _put(lines.write.text, s, "bibs"))


@query(
    """SELECT image_id, id, CASE WHEN w > 0 AND h > 0 THEN 0.0::DOUBLE END AS cls, x AS xc FROM ann
    WHERE w > 0"""
)
def src_yolo(s, d):
    a = W.annotations(s, d)
    line = F.concat_ws(" ", F.lit("0"), "x", "y", "w", "h")
    line = F.when(F.col("w") > 0, line).otherwise(F.concat(line, F.lit(" extra")))
    return a.select("image_id", "id", readers.yolo_line(line).alias("b")).where("b is not null").select("image_id", "id", F.col("b.cls").alias("cls"), F.col("b.xc").alias("xc"))


@query("SELECT l_orderkey AS frame, l_partkey AS track_id, CAST(l_quantity AS INT) AS x1, l_discount::DOUBLE AS det_conf, l_returnflag = 'A' AS is_valid FROM lineitem WHERE l_linenumber <> 3")
def src_detections_csv(s, d):
    """A log of which every third line of an order has an unreadable box."""
    li = W.table(s, d, "lineitem")
    x1 = F.when(F.col("l_linenumber") == 3, "x").otherwise(F.col("l_quantity").cast("int").cast("string"))
    own = {"frame": F.col("l_orderkey"), "track_id": F.col("l_partkey"), "x1": x1, "det_conf": F.col("l_discount"), "is_valid": F.col("l_returnflag") == "A"}
    names = [x.split()[0] for x in readers.DETECTIONS.split(", ")]
    rows = li.select(*[own.get(c, F.lit("7") if c[0] in "xy" else F.lit("")).cast("string").alias(c) for c in names])
    path = shared.path(s, "log")
    sinks.write_csv(rows, path)
    return readers.detections_log(s, path).select("frame", "track_id", "x1", "det_conf", "is_valid")


@query("SELECT gt, event, length(gt)::INT AS digit_count FROM truth WHERE regexp_matches(gt, '^[0-9]{1,4}$') AND length(gt) <> 3")
def src_labels_tsv(s, d):
    rows = W.truth(s, d).select(F.when(F.length("gt") == 3, F.concat("gt", F.lit("x"))).otherwise(F.col("gt")).alias("gt"), "event")
    return readers.valid_labels(rows, "gt").select("gt", "event", F.length("gt").alias("digit_count"))


def _coco(s, d):
    """The views of images and annotations as COCO documents of 1000 image ids each, written and read."""
    block = F.floor(F.col("image_id") / 1000).alias("block")
    i = W.images(s, d).groupBy(block).agg(F.collect_list(F.struct(F.col("image_id").alias("id"), "file_name", "width", "height")).alias("images"))
    box = F.array("x", "y", "w", "h").alias("bbox")
    a = W.annotations(s, d).select(block, F.struct("id", "image_id", box, F.lit(1).alias("category_id")).alias("a")).groupBy("block").agg(F.collect_list("a").alias("annotations"))
    doc = i.join(a, "block", "left").select("images", F.coalesce("annotations", F.array()).alias("annotations"), F.array(F.struct(F.lit(1).alias("id"), F.lit("bib").alias("name"))).alias("categories"))
    return readers.coco(s, _put(doc.write.json, s, "coco"), lines=True)


@query("SELECT image_id, file_name, count(*) AS n FROM images JOIN (SELECT image_id AS i FROM ann) a ON a.i = images.image_id GROUP BY ALL")
def src_coco(s, d):
    images, annotations, _ = _coco(s, d)
    rows = images.select(F.col("id").alias("image_id"), "file_name").join(annotations.select("image_id"), "image_id")
    return rows.groupBy("image_id", "file_name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source AS run, true AS has_crossings, bool_or(quality IS NOT NULL AND quality = 1) AS has_review, false AS has_video, count(*) + count(*) FILTER (quality = 1) AS files FROM (SELECT d.source, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY 1 ORDER BY 1 DESC")
def src_runs(s, d):
    """Folders of runs: a crossings file for each document, a review file where its quality is labelled 1."""
    lab = W.table(s, d, "labels").select(F.col("doc_id").alias("i"), "quality")
    rows = W.table(s, d, "documents").select("doc_id", "source").join(lab, F.col("doc_id") == F.col("i"), "left")
    names = F.array(F.format_string("crossings_%d.csv", "doc_id"), F.when(F.col("quality") == 1, F.format_string("review_%d.json", "doc_id")))
    inventory = rows.select("source", F.explode(F.filter(names, lambda x: x.isNotNull())).alias("name"))
    return readers.runs_of(inventory.select(F.concat_ws("/", F.lit("runs"), "source", "name").alias("path")))


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS name, CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'sha_mismatch' WHEN doc_id % 11 = 0 THEN 'size_mismatch' ELSE 'ok' END AS state
    FROM documents""",
    name="join_manifest",
)
def join_manifest(s, d):
    docs = W.table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    name = F.col("doc_id").cast("string").alias("name")
    sha, size = F.sha2("content", 256), F.length("content")
    manifest = docs.select(name, F.when(F.col("doc_id") % 7 == 0, "0").otherwise(sha).alias("sha256"), F.when(F.col("doc_id") % 11 == 0, size + 1).otherwise(size).alias("size"))
    return readers.manifest_state(manifest, docs.where("doc_id % 5 <> 0").select(name, "content"))


# --- sinks ----------------------------------------------------------------------------------------


@query("SELECT CAST(frame_idx AS VARCHAR) AS frame, format('{:.3f}', frame_idx / 32.0) AS time_sec, CAST(track_id AS VARCHAR) AS track_id, number AS ocr_raw, format('{:.3f}', conf) AS ocr_conf, '' AS validated FROM reads")
def snk_detections(s, d):
    r = W.reads(s, d).select(F.col("frame_idx").alias("frame"), (F.col("frame_idx") / 32.0).alias("time_sec"), "track_id", F.col("number").alias("ocr_raw"), F.col("conf").alias("ocr_conf"))
    none = ("x1 y1 x2 y2 det_conf validated is_valid consensus consensus_conf is_stable final_level").split()
    return sinks.detections_rows(r.withColumns({c: F.lit(None).cast("string") for c in none})).select("frame", "time_sec", "track_id", "ocr_raw", "ocr_conf", "validated")


@query("SELECT CAST(frame_idx AS VARCHAR) AS sequence, format('{:.3f}', conf) AS confidence, bib AS bib_number, CASE WHEN track_id % 2 = 0 THEN format('{:.1f}', y) ELSE '' END AS chest_y, 'pose' AS source FROM emissions")
def snk_crossings(s, d):
    e = W.emissions(s, d)
    even = lambda c: F.when(F.col("track_id") % 2 == 0, F.col(c))
    rows = e.select(F.col("frame_idx").alias("sequence"), F.col("frame_idx").alias("frame"), (F.col("frame_idx") / 30.0).alias("time_sec"), F.col("track_id").alias("person_track_id"), F.col("bib").alias("bib_number"), F.col("conf").alias("confidence"), F.lit(1).alias("estimated_count"), *[F.lit(0).alias(c) for c in ("person_x1", "person_y1", "person_x2", "person_y2")], even("x").alias("chest_x"), even("y").alias("chest_y"), F.lit("pose").alias("source"))
    return sinks.crossings_rows(rows).select("sequence", "confidence", "bib_number", "chest_y", "source")


@query("SELECT frame_idx AS sequence, 'CT01_33~' || frame_idx || '~finish~' || bib || '~' || format('{:02d}:{:02d}:{:02d}.00', CAST(frame_idx // 3600 AS INT), CAST(frame_idx // 60 % 60 AS INT), CAST(frame_idx % 60 AS INT)) || '~0~RACEFLOW~0' || chr(13) || chr(10) AS line FROM emissions")
def snk_ctp01(s, d):
    e = W.emissions(s, d).select(F.col("frame_idx").alias("sequence"), "bib", F.col("frame_idx").cast("double").alias("time_sec"))
    return sinks.timing_lines(e)


@query("SELECT sequence, bib FROM items WHERE action IS NULL AND sequence >= 100 ORDER BY sequence")
def snk_queue(s, d):
    q = W.review_items(s, d).select("sequence", "bib", F.col("action").isNotNull().alias("sent"))
    return sinks.unsent(q, 100).select("sequence", "bib")


@query("SELECT bib, frame_idx, conf FROM emissions WHERE conf < 0.7 OR bib = 'UNKNOWN'")
def snk_evidence(s, d):
    return sinks.evidence(W.emissions(s, d).withColumnRenamed("conf", "confidence")).select("bib", "frame_idx", F.col("confidence").alias("conf"))


@query("SELECT frame_idx AS sequence, bib FROM emissions ORDER BY frame_idx DESC LIMIT 50")
def snk_tui(s, d):
    return sinks.feed(W.emissions(s, d).select(F.col("frame_idx").alias("sequence"), "bib"))


@query("SELECT track_id, max_by(number, frame_idx) AS number, max(frame_idx) AS frame_idx FROM reads GROUP BY track_id")
def snk_mjpeg(s, d):
    return sinks.newest(W.reads(s, d).select("track_id", "number", "frame_idx"), "track_id", "frame_idx")


@query("SELECT image_id AS image, string_agg(l, chr(10) ORDER BY l) AS content FROM (SELECT image_id, format('0 {:.6f} {:.6f} {:.6f} {:.6f}', x, y, w, h) AS l FROM ann) GROUP BY 1")
def snk_yolo(s, d):
    a = W.annotations(s, d)
    return sinks.yolo_lines(a.select(F.col("image_id").alias("image"), F.lit(0).alias("cls"), F.col("x").alias("xc"), F.col("y").alias("yc"), "w", "h"))


@query("SELECT doc_id, format('image-{:09d}', n) AS image_key, format('label-{:09d}', n) AS label_key FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents)")
def snk_common(s, d):
    rows = W.table(s, d, "documents").select("doc_id", F.col("lang").alias("split"))
    return sinks.sample_keys(rows, "doc_id").select("doc_id", "image_key", "label_key")


# --- projections and filters ----------------------------------------------------------------------


@query("SELECT run_id, frame_idx, det_id, confidence FROM det WHERE confidence >= 0.25")
def flt_det_conf(s, d):
    return W.detections(s, d).where("confidence >= 0.25").select("run_id", "frame_idx", "det_id", "confidence")


@query(
    """SELECT coalesce(CASE WHEN x1 <= 96 THEN 'partial_left' WHEN x1 + w >= 1824 THEN 'partial_right' WHEN y1 <= 54 THEN 'partial_top' WHEN y1 + h >= 1026 THEN 'partial_bottom' END, 'visible') AS reason,
    count(*) AS n FROM det GROUP BY 1"""
)
def flt_edge(s, d):
    box = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    why = G.edge_reason(*box, F.lit(1920), F.lit(1080), 0.05)
    return W.detections(s, d).groupBy(F.coalesce(why, F.lit("visible")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT reason, count(*) AS n FROM (SELECT coalesce(CASE WHEN w <= 0 OR h <= 0 THEN 'empty' WHEN w < 40 THEN 'too_narrow' WHEN h < 15 THEN 'too_short' WHEN CAST(w AS DOUBLE) / h < 1.0 THEN 'aspect_low'
    WHEN CAST(w AS DOUBLE) / h > 6.0 THEN 'aspect_high' WHEN det_id % 200 < 50 THEN 'blurry' WHEN det_id % 90 < 20 THEN 'low_contrast' WHEN det_id % 10 < 5 THEN 'partial_content' WHEN det_id % 9 < 3 THEN 'partial_digits' END, 'ok') AS reason FROM det) GROUP BY 1"""
)
def flt_quality(s, d):
    n = F.col("det_id")
    as_double = lambda c: c.cast("double")
    why = Q.reason(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), as_double(n % 200), as_double(n % 90), as_double(n % 10) / 10, as_double(n % 9) / 10)
    return W.detections(s, d).groupBy(F.coalesce(why, F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN det_id % 3 = 0 THEN 'accepted' WHEN det_id % 3 = 1 THEN 'partial' ELSE 'quality' END AS bucket, count(*) AS n FROM det GROUP BY 1")
def flt_reject_class(s, d):
    why = F.when(F.col("det_id") % 3 == 1, "Partial digits").when(F.col("det_id") % 3 == 2, "blurry")
    return W.detections(s, d).groupBy(Q.bucket(why).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT det_id, frame_idx, x1, greatest(0, x1 - w * 15 // 100) AS px1, greatest(0, y1 - h // 10) AS py1, least(1920, x1 + w + w * 15 // 100) AS px2, least(1080, y1 + h + h // 10) AS py2 FROM det
    WHERE least(1920, x1 + w + w * 15 // 100) > greatest(0, x1 - w * 15 // 100) AND least(1080, y1 + h + h // 10) > greatest(0, y1 - h // 10)"""
)
def prj_pad(s, d):
    box = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    out = W.detections(s, d).withColumn("p", Q.padded(*box, F.lit(1920), F.lit(1080))).where("p is not null")
    return out.select("det_id", "frame_idx", "x1", *[F.col(f"p.{c}").alias(f"p{c}") for c in ("x1", "y1", "x2", "y2")])


@query(
    """SELECT id, image_id, w, h, CASE WHEN NOT visible THEN 0.0::DOUBLE WHEN coalesce(w / greatest(pw, 1) < 0.7 OR h / greatest(ph, 1) < 0.7, false) THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS fit
    FROM (SELECT *, x > 5 AS visible, lag(w) OVER o AS pw, lag(h) OVER o AS ph FROM (SELECT image_id, id, min(x) AS x, max(w) AS w, max(h + y) AS h FROM ann GROUP BY 1, 2) WINDOW o AS (PARTITION BY id ORDER BY image_id))"""
)
def flt_shrink(s, d):
    a = W.annotations(s, d).groupBy("image_id", "id").agg(F.min("x").alias("x"), F.max("w").alias("w"), F.max(F.col("h") + F.col("y")).alias("h"))
    rows = a.select(F.col("id").alias("track_id"), F.col("image_id").alias("frame_idx"), "w", "h", (F.col("x") > 5).alias("visible"))
    return Q.shrink(rows).select(F.col("track_id").alias("id"), F.col("frame_idx").alias("image_id"), "w", "h", "fit")


_CONS = """cons AS (SELECT track_id, frame_idx, number, conf, list({n: number, c: conf}) OVER (PARTITION BY track_id ORDER BY frame_idx ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS v FROM reads),
votes0 AS (SELECT track_id, frame_idx, unnest(v).n AS n, unnest(v).c AS c, generate_subscripts(v, 1) AS i, len(v) AS total FROM cons),
tally AS (SELECT track_id, frame_idx, n, total, sum(pow(0.9, total - i) * c) AS score, min(i) AS first, count(*) AS votes, sum(c) AS cs FROM votes0 GROUP BY ALL),
best AS (SELECT * FROM tally QUALIFY row_number() OVER (PARTITION BY track_id, frame_idx ORDER BY round(score, 9) DESC, first) = 1),
isl AS (SELECT *, sum(ch) OVER (PARTITION BY track_id ORDER BY frame_idx) AS island FROM (SELECT *, CASE WHEN number = lag(number) OVER (PARTITION BY track_id ORDER BY frame_idx) THEN 0 ELSE 1 END AS ch FROM reads)),
streak AS (SELECT track_id, frame_idx, number, conf, row_number() OVER (PARTITION BY track_id, island ORDER BY frame_idx) AS streak FROM isl),
consensus AS (SELECT s.track_id, s.frame_idx, s.number, s.conf, s.streak, b.n AS winner, b.votes, b.total, b.votes::DOUBLE / b.total AS agreement, 0.5::DOUBLE * (b.votes::DOUBLE / b.total) + 0.5::DOUBLE * (b.cs / b.votes) AS confidence,
  s.number = b.n AND s.streak >= 2 AS is_stable FROM streak s JOIN best b USING (track_id, frame_idx))"""


def _consensus(s, d, **options):
    return V.consensus(W.reads(s, d), **({"stable": 2} | options))


@query(f"WITH {_CONS} SELECT track_id, frame_idx, winner, votes, total, round(confidence, 6) AS confidence FROM consensus")
def agg_vote(s, d):
    return _consensus(s, d).select("track_id", "frame_idx", "winner", F.col("votes").cast("long").alias("votes"), F.col("total").cast("long").alias("total"), F.round("confidence", 6).alias("confidence"))


@query(f"WITH {_CONS} SELECT track_id, frame_idx, round(agreement, 6) AS agreement, is_stable, confidence < 0.5 AS needs_review FROM consensus")
def agg_consensus(s, d):
    return _consensus(s, d).select("track_id", "frame_idx", F.round("agreement", 6).alias("agreement"), "is_stable", "needs_review")


@query(f"WITH {_CONS} SELECT track_id, frame_idx, winner FROM consensus WHERE agreement >= 0.4 AND confidence >= 0.5")
def agg_early(s, d):
    return V.early(_consensus(s, d), 0.4, 0.5).select("track_id", "frame_idx", "winner")


@query(f"WITH {_CONS} SELECT track_id, frame_idx, number FROM (SELECT *, min(CASE WHEN is_stable AND confidence >= 0.55 THEN frame_idx END) OVER (PARTITION BY track_id) AS f FROM consensus) WHERE f IS NULL OR frame_idx <= f")
def flt_ocr_skip(s, d):
    return V.skip_cut(_consensus(s, d), 0.55).select("track_id", "frame_idx", "number")


@query(f"WITH {_CONS} SELECT track_id, frame_idx, streak FROM streak")
def win_streak(s, d):
    return V.streaks(W.reads(s, d)).select("track_id", "frame_idx", F.col("streak").cast("long").alias("streak"))


@query("SELECT track_id, frame_idx, count(*) OVER w AS n, round(avg(conf) OVER w, 6) AS mean FROM reads WINDOW w AS (PARTITION BY track_id ORDER BY frame_idx ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)")
def win_last15(s, d):
    w = Window.partitionBy("track_id").orderBy("frame_idx").rowsBetween(-14, 0)
    return W.reads(s, d).select("track_id", "frame_idx", F.count(F.lit(1)).over(w).alias("n"), F.round(F.avg("conf").over(w), 6).alias("mean"))


@query("SELECT track_id, frame_idx, round(pow(0.9, row_number() OVER (PARTITION BY track_id ORDER BY frame_idx DESC) - 1), 9) AS weight FROM reads")
def win_recency(s, d):
    age = F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("frame_idx"))) - 1
    return W.reads(s, d).select("track_id", "frame_idx", F.round(F.pow(F.lit(0.9), age), 9).alias("weight"))


@query("SELECT track_id, frame_idx, first_value(number) OVER w AS first_number, last_value(number) OVER w AS last_number FROM reads WINDOW w AS (PARTITION BY track_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def win_first_last(s, d):
    w = Window.partitionBy("track_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return W.reads(s, d).select("track_id", "frame_idx", F.first("number").over(w).alias("first_number"), F.last("number").over(w).alias("last_number"))


@query("SELECT number, frame_idx, track_id, sum(new) OVER (PARTITION BY number ORDER BY frame_idx)::BIGINT AS so_far FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY number, track_id ORDER BY frame_idx) = 1 THEN 1 ELSE 0 END AS new FROM reads)")
def win_cumdistinct(s, d):
    return V.cumulative_distinct(W.reads(s, d)).select("number", "frame_idx", "track_id", "so_far")


@query(
    """WITH t(number, f) AS (SELECT number, min(frame_idx) FROM reads GROUP BY 1 UNION ALL SELECT t.number, (SELECT min(r.frame_idx) FROM reads r WHERE r.number = t.number AND r.frame_idx >= t.f + 10) FROM t WHERE t.f IS NOT NULL)
    SELECT number, count(f) AS kept, sum(f)::BIGINT AS total FROM t GROUP BY 1"""
)
def win_minGap10(s, d):
    return V.thinned(W.reads(s, d), "number", 10).groupBy("number").agg(F.count(F.lit(1)).alias("kept"), F.sum("frame_idx").alias("total"))


@query("SELECT run_id, frame_idx, track_id, row_number() OVER (PARTITION BY run_id ORDER BY frame_idx, track_id) AS sequence FROM reads")
def win_seq(s, d):
    return X.numbered(W.reads(s, d), ("run_id",)).select("run_id", "frame_idx", "track_id", F.col("sequence").cast("long").alias("sequence"))


@query("SELECT number, count(DISTINCT track_id) AS tracks FROM reads GROUP BY 1 HAVING count(DISTINCT track_id) > 5")
def flt_phantom(s, d):
    return V.phantoms(W.reads(s, d), 5)


@query("SELECT number, count(DISTINCT track_id) AS tracks FROM reads GROUP BY 1")
def agg_track_freq(s, d):
    return W.reads(s, d).groupBy("number").agg(F.countDistinct("track_id").alias("tracks"))


@query("SELECT pred FROM preds WHERE NOT (length(pred) >= 3 AND replace(pred, substr(pred, 1, 1), '') = '')")
def flt_repdigit(s, d):
    return W.predictions(s, d).where(~T.repdigit(F.col("pred")))


@query("SELECT pred, conf FROM (SELECT pred, CAST(CAST(pred AS INT) % 100 AS DOUBLE) / 100.0::DOUBLE AS conf FROM preds) WHERE CASE WHEN length(pred) = 1 THEN conf >= 0.95 WHEN length(pred) = 2 THEN conf >= 0.90 ELSE true END")
def flt_short(s, d):
    rows = W.predictions(s, d).withColumn("conf", (F.col("pred").cast("int") % 100).cast("double") / 100.0)
    return rows.where(T.short_ok(F.col("pred"), F.col("conf")))


@query(
    """SELECT pred, conf, CASE WHEN conf < 0.35 THEN 'very_low_confidence' WHEN length(pred) <= 2 AND conf < 0.85 THEN 'short_low_confidence' WHEN length(pred) NOT IN (3, 4) AND conf < 0.95 THEN 'unexpected_length' WHEN conf < 0.7 THEN 'low_confidence' END AS reason,
    coalesce(CASE WHEN conf < 0.35 THEN true WHEN length(pred) <= 2 AND conf < 0.85 THEN false WHEN length(pred) NOT IN (3, 4) AND conf < 0.95 THEN conf < 0.7 END, false) AS reject
    FROM (SELECT pred, CAST(CAST(pred AS INT) % 100 AS DOUBLE) / 100.0::DOUBLE AS conf FROM preds)"""
)
def flt_suspicious(s, d):
    rows = W.predictions(s, d).withColumn("conf", (F.col("pred").cast("int") % 100).cast("double") / 100.0)
    out = rows.withColumn("v", T.suspicious(F.col("pred"), F.col("conf"), F.array(F.lit(3), F.lit(4))))
    return out.select("pred", "conf", "v.reason", "v.reject")


@query("SELECT number, conf FROM reads WHERE number <> '' AND conf >= 0.5")
def flt_empty(s, d):
    return W.reads(s, d).where("number <> '' AND conf >= 0.5").select("number", "conf")


@query("SELECT bib, number FROM readings WHERE level IN ('high', 'medium') AND conf >= 0.6")
def flt_level(s, d):
    return W.readings(s, d).where(F.col("level").isin("high", "medium") & (F.col("conf") >= 0.6)).select("bib", "number")


@query("SELECT det_id, frame_idx, w, h FROM det WHERE w >= 20 AND h >= 20")
def flt_tiny(s, d):
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return W.detections(s, d).select("det_id", "frame_idx", w.alias("w"), h.alias("h")).where("w >= 20 AND h >= 20")


@query(
    """SELECT det_id, frame_idx, a AS x1, b AS y1, c AS x2, e AS y2 FROM (SELECT det_id, frame_idx, greatest(0.0::DOUBLE, least(x1 - 50.0::DOUBLE, 1599.0)) AS a, greatest(0.0::DOUBLE, least(y1 - 50.0::DOUBLE, 899.0)) AS b, greatest(0.0::DOUBLE, least(x1 + w - 50.0::DOUBLE, 1599.0)) AS c,
    greatest(0.0::DOUBLE, least(y1 + h - 50.0::DOUBLE, 899.0)) AS e FROM det) WHERE c - a > 1 AND e - b > 1"""
)
def prj_clampbox(s, d):
    box = [F.col(c) - 50.0 for c in ("x1", "y1", "x2", "y2")]
    out = W.detections(s, d).withColumn("c", G.clamped(*box, F.lit(1600.0), F.lit(900.0))).where("c is not null")
    return out.select("det_id", "frame_idx", "c.x1", "c.y1", "c.x2", "c.y2")


@query("SELECT image_id, id, CASE WHEN id = 2 THEN 'missing' WHEN id = 4 THEN 'arity' ELSE 'non_positive' END AS issue FROM ann WHERE id IN (2, 4) OR w <= 0")
def flt_badbox(s, d):
    a = W.annotations(s, d)
    box = F.when(F.col("id") == 2, F.lit(None)).when(F.col("id") == 4, F.array("x", "y", "w")).otherwise(F.array("x", "y", "w", "h"))
    out = DS.bad_boxes(a.select(F.struct("image_id", "id").alias("id"), box.alias("bbox")))
    return out.select("id.image_id", "id.id", "issue")


@query("SELECT CASE WHEN pred = gt THEN 'correct' WHEN length(pred) < length(gt) THEN 'truncation' WHEN length(pred) > length(gt) THEN 'extra' ELSE 'confusion' END AS class, count(*) AS n FROM truth GROUP BY 1")
def prj_truncation(s, d):
    return W.truth(s, d).groupBy(DS.error_class(F.col("gt"), F.col("pred")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT sequence, bib FROM items WHERE coalesce(status, 'pending') = 'pending'")
def flt_pending(s, d):
    return RV.pending(W.review_items(s, d)).select("sequence", "bib")


# --- scalar functions -----------------------------------------------------------------------------


@query(
    """SELECT p_partkey, raw, CASE WHEN CAST(t AS BIGINT) > 1700 THEN '' ELSE t END AS text FROM (SELECT p_partkey, raw, substr(regexp_replace(regexp_replace(translate(raw, 'OoQDIilL|ZzESsGbTBgq', '00001111122355667899'), '[^0-9]', '', 'g'), '^0+([0-9])', '\\1'), 1, 4) AS t
    FROM (SELECT p_partkey, 'SQ' || p_brand || '-' || p_partkey AS raw FROM part))"""
)
def fn_cleanup(s, d):
    rows = W.table(s, d, "part").select("p_partkey", F.concat(F.lit("SQ"), "p_brand", F.lit("-"), F.col("p_partkey").cast("string")).alias("raw"))
    return rows.select("p_partkey", "raw", T.clean(F.col("raw"), 4, 1700)["text"].alias("text"))


@query("SELECT pred, CASE WHEN length(pred) IN (3, 4) THEN 0.5::DOUBLE ELSE greatest(0.0::DOUBLE, 0.5::DOUBLE - 0.15::DOUBLE) END AS conf FROM preds")
def fn_digit_count(s, d):
    return W.predictions(s, d).select("pred", T.digit_penalty(F.col("pred"), F.lit(0.5), F.array(F.lit(3), F.lit(4))).alias("conf"))


@query("SELECT frame_idx, track_id, CASE WHEN conf >= 0.85 THEN 'high' WHEN conf >= 0.70 THEN 'medium' WHEN conf >= 0.50 THEN 'low' ELSE 'reject' END AS level FROM reads")
def fn_level(s, d):
    return W.reads(s, d).select("frame_idx", "track_id", T.level(F.col("conf")).alias("level"))


@query(
    """SELECT frame_idx, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, conf + 0.1::DOUBLE + CASE WHEN number IN (SELECT bib FROM registry) THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN frame_idx % 3 = 0 THEN 0.10::DOUBLE WHEN conf >= 0.8 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END)), 6) AS adjusted FROM reads"""
)
def fn_confidence(s, d):
    rows = REG.flagged(W.reads(s, d), W.registry(s, d))
    adj = T.adjusted(F.col("conf"), F.lit(0.1), F.col("is_valid"), F.col("frame_idx") % 3 == 0, F.col("conf"))
    return rows.select("frame_idx", F.round(adj, 6).alias("adjusted"))


@query(
    """SELECT frame_idx, CASE WHEN r = '' THEN 'Needs verification' ELSE r END AS reason FROM (SELECT frame_idx, concat_ws('; ', CASE WHEN conf < 0.5 THEN 'Very low confidence' WHEN conf < 0.7 THEN 'Low confidence' END, CASE WHEN NOT number IN (SELECT bib FROM registry) THEN 'Not in bib set' END,
    CASE WHEN frame_idx % 5 = 0 THEN 'Auto-corrected ' || number || '->1' END, CASE WHEN frame_idx % 2 = 1 THEN 'Unstable across frames' END) AS r FROM reads)"""
)
def fn_reason(s, d):
    rows = REG.flagged(W.reads(s, d), W.registry(s, d))
    why = T.review_reason(T.level(F.col("conf")), F.col("is_valid"), F.col("frame_idx") % 5 == 0, F.col("number"), F.lit("1"), F.col("frame_idx") % 2 == 0)
    return rows.select("frame_idx", why.alias("reason"))


@query("SELECT frame_idx, track_id, CAST(sign((0.3459::DOUBLE - 0.3459::DOUBLE) * (y - 0.0) - (1.0::DOUBLE - 0.0::DOUBLE) * (x - 0.3459::DOUBLE)) AS INT) AS side FROM obs")
def fn_side(s, d):
    return W.observations(s, d).select("frame_idx", "track_id", G.side_of_line(F.col("x"), F.col("y"), W.LINE).cast("int").alias("side"))


@query("SELECT image_id, id, round(least(1.0, (x + w / 2.0) / 100.0), 6) AS xc, round(least(1.0, (y + h / 2.0) / 50.0), 6) AS yc, round(least(1.0, w / 100.0), 6) AS w, round(least(1.0, h / 50.0), 6) AS h FROM ann WHERE w > 0 AND h > 0")
def fn_yolo(s, d):
    a = W.annotations(s, d)
    out = a.withColumn("b", G.yolo(*[F.col(c) for c in "xywh"], F.lit(100.0), F.lit(50.0))).where("b is not null")
    return out.select("image_id", "id", *[F.round(f"b.{c}", 6).alias(c) for c in ("xc", "yc", "w", "h")])


@query("SELECT gt, pred, levenshtein(gt, pred) AS edits FROM truth")
def fn_edit_distance(s, d):
    return W.truth(s, d).select("gt", "pred", F.levenshtein("gt", "pred").cast("long").alias("edits"))


@query("SELECT pred, list_transform(str_split(pred, ''), lambda c: CAST(c AS INT) + 1)::VARCHAR AS labels FROM preds")
def fn_ctc_labels(s, d):
    return W.predictions(s, d).select("pred", F.concat(F.lit("["), F.array_join(decoding.ctc_labels(F.col("pred")).cast("array<string>"), ", "), F.lit("]")).alias("labels"))


@query()
def fn_ctc_decode(s, d):
    steps = F.array(*[F.slice("embedding", 11 * i + 1, 11) for i in range(4)])
    out = decoding.ctc_decoded(W.table(s, d, "embeddings").select("vec_id", steps.alias("steps")), "vec_id", "steps")
    return out.select("vec_id", "text", F.round("confidence", 6).alias("confidence"))


@query("SELECT event_id, format('{:02d}:{:02d}:{:02d}', CAST(event_id // 3600 AS INT), CAST(event_id // 60 % 60 AS INT), CAST(event_id % 60 AS INT)) AS clock, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM ev")
def fn_time(s, d):
    return W.events(s, d).select("event_id", T.clock(F.col("event_id").cast("double")).alias("clock"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents")
def fn_hash(s, d):
    return W.table(s, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))


@query(
    """SELECT d.doc_id, first(r ORDER BY length(r) DESC, i) AS digits FROM documents d LEFT JOIN (SELECT doc_id, unnest(runs) AS r, generate_subscripts(runs, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS runs FROM documents)) x
    ON x.doc_id = d.doc_id AND length(r) <= 4 GROUP BY 1"""
)
def sel_longest(s, d):
    docs = W.table(s, d, "documents")
    return docs.select("doc_id", T.longest_run(F.coalesce("text", F.lit(""))).alias("digits"))


# --- joins ----------------------------------------------------------------------------------------


@query("SELECT pred, pred IN (SELECT bib FROM registry) AS is_valid FROM preds")
def join_registry(s, d):
    return REG.flagged(W.predictions(s, d), W.registry(s, d), "pred")


@query("SELECT pred, bib, length(pred)::DOUBLE / (length(pred) + 1) + 0.15::DOUBLE AS score FROM preds JOIN (SELECT CAST(range AS VARCHAR) AS d FROM range(1, 10)) ON true JOIN registry ON bib = d || pred")
def join_leading(s, d):
    return REG.leading(W.predictions(s, d), W.registry(s, d))


@query("SELECT pred, bib, length(pred)::DOUBLE / (length(pred) + 1) + 0.10::DOUBLE AS score FROM preds JOIN (SELECT CAST(range AS VARCHAR) AS d FROM range(0, 10)) ON true JOIN registry ON bib = pred || d")
def join_trailing(s, d):
    return REG.trailing(W.predictions(s, d), W.registry(s, d))


@query()
def join_prefix(s, d):
    return REG.same_prefix(W.predictions(s, d), W.registry(s, d))


@query()
def join_lenband(s, d):
    return REG.length_band(W.predictions(s, d), W.registry(s, d))


@query()
def join_fuzzy(s, d):
    return REG.validated(W.predictions(s, d), W.registry(s, d))


@query(
    """SELECT k AS read_id, CASE WHEN n IN (SELECT bib FROM registry) THEN n ELSE coalesce(CASE WHEN length(n) >= 3 AND '9' || substr(n, 2) IN (SELECT bib FROM registry) THEN '9' || substr(n, 2) END, CASE WHEN length(n) >= 3 AND substr(n, 1, 1) || '8' || substr(n, 3) IN (SELECT bib FROM registry) THEN substr(n, 1, 1) || '8' || substr(n, 3) END, n) END AS corrected
    FROM (SELECT o_custkey AS k, CAST(o_custkey AS VARCHAR) AS n FROM (SELECT DISTINCT o_custkey FROM orders))"""
)
def fn_digit_swap(s, d):
    n = F.col("pred")
    digit = lambda x, i: F.struct(x.alias("digit"), F.lit(0.5).alias("prob"), F.when(i == 0, "9").when(i == 1, "8").otherwise("0").alias("ru_digit"), F.when(i < 2, 0.2).otherwise(0.0).alias("ru_prob"))
    rows = W.predictions(s, d).select(n.cast("long").alias("read_id"), n.alias("number"), F.transform(F.filter(F.split(n, ""), lambda c: c != ""), digit).alias("digits"))
    return REG.digit_swap(rows, W.registry(s, d)).select("read_id", "corrected")


_PAIRS = """pr AS (SELECT p.frame_idx, p.id AS person, b.id AS bib, (b.cx BETWEEN p.x1 AND p.x2 AND b.cy BETWEEN p.y1 AND p.y2) OR NOT (b.x2 < p.x1 OR b.x1 > p.x2 OR b.y2 < p.y1 OR b.y1 > p.y2) AS inside,
  sqrt((p.cx - b.cx) * (p.cx - b.cx) + (p.cy - b.cy) * (p.cy - b.cy)) AS dist FROM persons p JOIN bibs b ON p.frame_idx = b.frame_idx),
el AS (SELECT * FROM pr WHERE inside OR dist < 150),
fi AS (SELECT frame_idx, person, min_by(bib, bib) AS fb, min_by(inside, bib) AS fin, min_by(dist, bib) AS fd FROM el GROUP BY 1, 2),
ne AS (SELECT * FROM el WHERE inside QUALIFY row_number() OVER (PARTITION BY frame_idx, person ORDER BY dist, bib) = 1),
claims AS (SELECT fi.frame_idx, fi.person, CASE WHEN fin OR coalesce(ne.dist < fd, false) THEN ne.bib ELSE fb END AS bib, CASE WHEN fin OR coalesce(ne.dist < fd, false) THEN ne.dist ELSE fd END AS dist FROM fi LEFT JOIN ne ON fi.frame_idx = ne.frame_idx AND fi.person = ne.person),
winners AS (SELECT * FROM claims QUALIFY row_number() OVER (PARTITION BY frame_idx, bib ORDER BY dist, person) = 1),
ledger AS (SELECT person, number, sum(CASE level WHEN 'high' THEN 3.0::DOUBLE WHEN 'medium' THEN 2.0 WHEN 'low' THEN 1.0 ELSE 0.5 END) AS weight FROM winners JOIN readings USING (bib) GROUP BY 1, 2)"""


def _claims(s, d):
    return A.best_bib(A.pairs(W.persons(s, d), W.bibs(s, d)), 150.0)


@query(f"WITH {_PAIRS} SELECT frame_idx, person, bib, round(dist, 6) AS dist FROM claims")
def join_person_bib(s, d):
    return _claims(s, d).select("frame_idx", "person", "bib", F.round("dist", 6).alias("dist"))


@query(f"WITH {_PAIRS} SELECT frame_idx, person, bib FROM winners")
def join_exclusive(s, d):
    return A.exclusive(_claims(s, d)).select("frame_idx", "person", "bib")


@query(f"WITH {_PAIRS} SELECT person, number, weight FROM ledger")
def agg_assoc_votes(s, d):
    return A.ledger(A.exclusive(_claims(s, d)), W.readings(s, d))


@query(f"WITH {_PAIRS} SELECT person, CASE WHEN max(weight) >= 2 AND max(weight) >= 0.4 * sum(weight) THEN arg_min(number, (-weight, number)) END AS number, max(weight) / sum(weight) AS confidence FROM ledger GROUP BY 1".replace("arg_min(number, (-weight, number))", "first(number ORDER BY weight DESC, number)"))
def agg_assoc_pick(s, d):
    return A.pick(A.ledger(A.exclusive(_claims(s, d)), W.readings(s, d)), 2.0, 0.4)


@query(f"WITH {_PAIRS} SELECT bib, count(DISTINCT person) AS persons FROM pr WHERE inside GROUP BY 1")
def join_overlap(s, d):
    return A.overlaps(A.pairs(W.persons(s, d), W.bibs(s, d))).select("bib", F.size("persons").cast("long").alias("persons"))


def _located(s, d):
    r = W.readings(s, d).withColumnRenamed("bib", "b")
    return W.bibs(s, d).join(r, F.col("id") == F.col("b")).select("frame_idx", F.col("cx").alias("bx"), F.col("cy").alias("by"), "number", "conf", "level")


def _crossed(s, d):
    return W.persons(s, d).withColumnRenamed("id", "event").select("event", "frame_idx", "x1", "y1", "x2", "y2")


_LOC = "loc AS (SELECT b.frame_idx, b.cx, b.cy, r.number, r.conf, r.level FROM bibs b JOIN readings r ON b.id = r.bib)"


@query(f"WITH {_LOC} SELECT p.id AS event, first(number ORDER BY conf DESC, number) AS bib FROM persons p JOIN loc l ON p.frame_idx = l.frame_idx AND l.cx BETWEEN p.x1 AND p.x2 AND l.cy BETWEEN p.y1 AND p.y2 WHERE level IN ('high', 'medium') GROUP BY 1")
def join_recover1(s, d):
    return R.contained(_crossed(s, d), _located(s, d))


@query(f"WITH {_LOC} SELECT p.id AS event, first(number ORDER BY conf DESC, number) AS bib FROM persons p JOIN loc l ON p.frame_idx = l.frame_idx AND l.cx BETWEEN p.x1 - 50 AND p.x2 + 50 AND l.cy BETWEEN p.y1 AND p.y2 WHERE level = 'high' GROUP BY 1")
def join_recover2(s, d):
    return R.contained(_crossed(s, d), _located(s, d), ("high",), R.side_margin(F.col("x1"), F.col("x2")))


@query(f"WITH {_PAIRS}, ov AS (SELECT bib, count(DISTINCT person) AS n FROM pr WHERE inside GROUP BY 1 HAVING count(DISTINCT person) <= 3) SELECT person AS event, first(number ORDER BY conf DESC, number) AS bib FROM (SELECT DISTINCT person, bib FROM pr WHERE inside) JOIN ov USING (bib) JOIN readings USING (bib) GROUP BY 1")
def join_recover3(s, d):
    persons = W.persons(s, d).select(F.col("id").alias("event"), F.col("id").alias("person"))
    return R.co_occurring(persons, A.overlaps(A.pairs(W.persons(s, d), W.bibs(s, d))), W.readings(s, d))


def _life(s, d):
    return W.lifetimes(s, d).withColumn("number", (F.col("track_id") % 20 + 100).cast("string")).withColumn("conf", (F.col("n") % 10).cast("double") / 10.0)


@query(
    """SELECT event, first(number ORDER BY conf DESC, dist, number) AS bib FROM (SELECT event, number, dist, conf FROM (
    SELECT e.track_id AS event, CAST(t.track_id % 20 + 100 AS VARCHAR) AS number, CAST(t.n % 10 AS DOUBLE) / 10.0::DOUBLE AS conf, least(
      sqrt(pow(e.first_x - t.first_x, 2) + pow(e.first_y - t.first_y, 2)), sqrt(pow(e.first_x - t.last_x, 2) + pow(e.first_y - t.last_y, 2)), sqrt(pow(e.last_x - t.first_x, 2) + pow(e.last_y - t.first_y, 2)), sqrt(pow(e.last_x - t.last_x, 2) + pow(e.last_y - t.last_y, 2))) AS dist
    FROM lifetimes e JOIN lifetimes t ON t.first_frame <= e.last_frame + 150 AND t.last_frame >= e.first_frame - 150 WHERE e.kind = 'purchase' AND t.kind = 'click')
    WHERE dist < 6 QUALIFY row_number() OVER (PARTITION BY event, number ORDER BY dist, conf DESC) = 1) GROUP BY 1"""
)
def join_recover4(s, d):
    life = _life(s, d)
    e = life.where("kind = 'purchase'").drop("number", "conf").withColumnRenamed("track_id", "event")
    return R.in_lifetime(e, life.where("kind = 'click'"), 150, 6.0)


@query(f"WITH {_LOC}, r1 AS (SELECT p.id AS event, first(number ORDER BY conf DESC, number) AS bib FROM persons p JOIN loc l ON p.frame_idx = l.frame_idx AND l.cx BETWEEN p.x1 AND p.x2 AND l.cy BETWEEN p.y1 AND p.y2 WHERE level IN ('high', 'medium') GROUP BY 1) SELECT p.id AS event, coalesce(r1.bib, 'UNKNOWN') AS bib FROM persons p LEFT JOIN r1 ON r1.event = p.id")
def join_recovery_chain(s, d):
    e = _crossed(s, d)
    return R.first_of(e.select("event"), R.contained(e, _located(s, d)))


_CROSS = """e AS (SELECT track_id, frame_idx, last_value(CASE WHEN x = 0.3459 THEN NULL WHEN x < 0.3459 THEN 1 ELSE -1 END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY frame_idx) AS side FROM obs),
e1 AS (SELECT *, CASE WHEN side = lag(side) OVER (PARTITION BY track_id ORDER BY frame_idx) THEN 0 ELSE 1 END AS ch FROM e WHERE side IS NOT NULL),
e2 AS (SELECT *, sum(ch) OVER (PARTITION BY track_id ORDER BY frame_idx) AS island FROM e1),
e3 AS (SELECT *, row_number() OVER (PARTITION BY track_id, island ORDER BY frame_idx) AS held FROM e2),
m AS (SELECT *, lag(side) OVER (PARTITION BY track_id ORDER BY frame_idx) AS side_from FROM e3 WHERE (island = 1 AND held = 1) OR (island > 1 AND held = 3)),
tr AS (SELECT track_id, frame_idx, side_from, side AS side_to FROM m WHERE side_from <> side)"""
_FIRE = "fire(track_id, f) AS (SELECT track_id, min(frame_idx) FROM tr GROUP BY 1 UNION ALL SELECT t.track_id, (SELECT min(r.frame_idx) FROM tr r WHERE r.track_id = t.track_id AND r.frame_idx >= t.f + 1500) FROM fire t WHERE t.f IS NOT NULL)"
_NEAR = f"""WITH {_CROSS}, {_FIRE},
u AS (SELECT o.* FROM obs o JOIN fire ON o.track_id = fire.track_id AND o.frame_idx = fire.f LEFT JOIN reads r ON r.track_id = o.track_id AND r.frame_idx = o.frame_idx WHERE NOT coalesce(r.conf >= 0.5, false)),
seen AS (SELECT o.run_id, r.number, o.frame_idx, o.x, o.y FROM obs o JOIN reads r ON r.track_id = o.track_id AND r.frame_idx = o.frame_idx WHERE r.conf >= 0.5)
SELECT u.run_id, u.frame_idx AS sequence, number, round(min(abs(u.frame_idx - s.frame_idx) + sqrt(pow(u.x - s.x, 2) + pow(u.y - s.y, 2))), 6) AS score FROM u JOIN seen s
ON u.run_id = s.run_id AND abs(u.frame_idx - s.frame_idx) <= 60 AND sqrt(pow(u.x - s.x, 2) + pow(u.y - s.y, 2)) <= 1.0 GROUP BY 1, 2, 3"""


def _crossings(s, d):
    """Crossings of the line with their runs, places, numbers, and whether the reading there was sure."""
    o, r = W.observations(s, d), W.reads(s, d).select(F.col("frame_idx").alias("f"), F.col("track_id").alias("t"), "number", (F.col("conf") >= 0.5).alias("sure"))
    at = X.crossings(o, W.LINE, 3, 1500).select(F.col("track_id").alias("i"), F.col("frame_idx").alias("c"))
    rows = o.join(at, (F.col("track_id") == F.col("i")) & (F.col("frame_idx") == F.col("c"))).join(r, (F.col("track_id") == F.col("t")) & (F.col("frame_idx") == F.col("f")), "left")
    return rows.select("run_id", F.col("frame_idx").alias("sequence"), "frame_idx", "x", "y", "number", F.coalesce("sure", F.lit(False)).alias("sure"))


def _near(s, d):
    """The sure readings near every crossing without one."""
    o, sure = W.observations(s, d), W.reads(s, d).where("conf >= 0.5").select(F.col("frame_idx").alias("f"), F.col("track_id").alias("t"), "number")
    seen = o.join(sure, (F.col("frame_idx") == F.col("f")) & (F.col("track_id") == F.col("t"))).select("run_id", "number", "frame_idx", "x", "y")
    return R.near_in_time_and_space(_crossings(s, d).where("not sure").select("run_id", "sequence", "frame_idx", "x", "y"), seen, 60, 1.0)


@query(_NEAR)
def join_postproc_candidates(s, d):
    return _near(s, d).select("run_id", "sequence", "number", F.round("score", 6).alias("score"))


def _greedy(near: str) -> str:
    """SQL of events (run_id, sequence) that take, one after the other, their best number (score, number) that is free; near: SQL of the candidates with valid."""
    return f"""{near},
listed AS (SELECT run_id, sequence, row_number() OVER (PARTITION BY run_id ORDER BY sequence) AS n, list({{'number': number, 'valid': valid}} ORDER BY score, number) AS c FROM near GROUP BY run_id, sequence),
gone(run_id, n, sequence, used, number) AS (SELECT DISTINCT run_id, 0::BIGINT, NULL::BIGINT, []::VARCHAR[], NULL::VARCHAR FROM listed
  UNION ALL SELECT run_id, n, sequence, CASE WHEN pick.valid THEN list_append(used, pick.number) ELSE used END, CASE WHEN pick.valid THEN pick.number END
  FROM (SELECT a.run_id, a.n, a.sequence, g.used, list_filter(a.c, lambda x: NOT list_contains(g.used, x.number))[1] AS pick FROM gone g JOIN listed a ON a.run_id = g.run_id AND a.n = g.n + 1))
SELECT run_id, sequence, number FROM gone WHERE number IS NOT NULL"""


@query(
    _greedy(
        _NEAR.rpartition("\nSELECT u.run_id")[0]
        + """, sure AS (SELECT DISTINCT o.run_id, r.number FROM obs o JOIN fire ON o.track_id = fire.track_id AND o.frame_idx = fire.f JOIN reads r ON r.track_id = o.track_id AND r.frame_idx = o.frame_idx WHERE r.conf >= 0.5),
near AS (SELECT *, number IN (SELECT bib FROM registry) AS valid FROM (SELECT u.run_id, u.frame_idx AS sequence, number, min(abs(u.frame_idx - s.frame_idx) + sqrt(pow(u.x - s.x, 2) + pow(u.y - s.y, 2))) AS score FROM u JOIN seen s
ON u.run_id = s.run_id AND abs(u.frame_idx - s.frame_idx) <= 60 AND sqrt(pow(u.x - s.x, 2) + pow(u.y - s.y, 2)) <= 1.0 GROUP BY 1, 2, 3) WHERE (run_id, number) NOT IN (SELECT (run_id, number) FROM sure))"""
    )
)
def join_postproc(s, d):
    return R.resolved_later(_near(s, d), W.registry(s, d), _crossings(s, d).where("sure").select("run_id", "number"))


@query(
    _greedy(
        """WITH u AS (SELECT run_id, frame_idx, x, y FROM sight WHERE conf < 0.4), seen AS (SELECT run_id, number, frame_idx, x, y FROM sight WHERE conf >= 0.8),
near AS (SELECT *, number IN (SELECT bib FROM registry) AS valid FROM (SELECT u.run_id, u.frame_idx AS sequence, number, min(abs(u.frame_idx - s.frame_idx) + sqrt(pow(u.x - s.x, 2) + pow(u.y - s.y, 2))) AS score FROM u JOIN seen s
ON u.run_id = s.run_id AND abs(u.frame_idx - s.frame_idx) <= 90 AND sqrt(pow(u.x - s.x, 2) + pow(u.y - s.y, 2)) <= 120.0 GROUP BY 1, 2, 3))"""
    )
)
def join_postproc_sightings(s, d):
    """Every unsure read takes the nearest sure and registered number of its run that no earlier one has taken."""
    r = W.sightings(s, d)
    unsure = r.where("conf < 0.4").select("run_id", F.col("frame_idx").alias("sequence"), "frame_idx", "x", "y")
    return R.resolved_later(R.near_in_time_and_space(unsure, r.where("conf >= 0.8"), 90, 120.0), W.registry(s, d))


@query("SELECT a.bib, a.frame_idx, count(*) AS earlier FROM emissions a JOIN emissions b ON a.bib = b.bib AND b.frame_idx < a.frame_idx AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 20 GROUP BY 1, 2")
def join_proximity(s, d):
    return D.near_earlier(W.emissions(s, d), 20.0)


@query("SELECT d.doc_id AS image_id, CAST(d.doc_id % 4 AS VARCHAR) AS ocr, d.doc_id % 4 IN (1, 2) AND d.doc_id % 5 <> 0 AS verified FROM documents d")
def join_tags(s, d):
    docs = W.table(s, d, "documents")
    results = docs.select(F.col("doc_id").alias("image_id"), (F.col("doc_id") % 4).cast("string").alias("ocr"))
    photos = docs.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("image_id"), F.array(F.lit("1"), F.lit("2")).alias("bibs"))
    return RV.tagged(results, photos).select("image_id", "ocr", "verified")


@query("SELECT o_orderkey, m.k FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS k FROM lineitem GROUP BY 1) m ON o_orderkey = l_orderkey")
def join_review_merge(s, d):
    li = W.table(s, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    last = RV.latest_review(li, "l_orderkey", "l_linenumber").select(F.col("l_orderkey").alias("i"), F.col("l_linenumber").alias("k"))
    return W.table(s, d, "orders").select("o_orderkey").join(last, F.col("o_orderkey") == F.col("i"), "left").select("o_orderkey", "k")


@query("SELECT sequence, CASE WHEN action = 'correct' THEN coalesce(corrected_bib, bib) ELSE bib END AS bib FROM items WHERE coalesce(action, '') <> 'reject'")
def J_review(s, d):
    items = W.review_items(s, d)
    done = items.where("action is not null").select("sequence", "action", "corrected_bib")
    return RV.corrected(items.select("sequence", "bib"), done)


@query("SELECT i.image_id, count(a.id) AS n FROM images i LEFT JOIN ann a ON i.image_id = a.image_id AND a.w > 0 GROUP BY 1")
def join_coco(s, d):
    images, annotations, _ = _coco(s, d)
    good = annotations.where(F.get("bbox", F.lit(2)) > 0).select(F.col("image_id").alias("i"), F.col("id").alias("annotation"))
    return images.select(F.col("id").alias("image_id")).join(good, F.col("image_id") == F.col("i"), "left").groupBy("image_id").agg(F.count("annotation").alias("n"))


@query("SELECT image_id, regexp_extract(file_name, '^(.*)[.]', 1) AS stem FROM images JOIN (SELECT DISTINCT image_id AS i FROM ann) ON 'img_' || i = regexp_extract(file_name, '^(.*)[.]', 1)")
def join_stem(s, d):
    a = W.annotations(s, d).select(F.concat(F.lit("img_"), F.col("image_id").cast("string")).alias("label")).distinct()
    i = W.images(s, d).select("image_id", F.regexp_extract("file_name", r"^(.*)[.]", 1).alias("stem"))
    return i.join(a, F.col("stem") == F.col("label")).select("image_id", "stem")


@query("SELECT event, count(*) AS n, count(*) FILTER (gt = pred AND gt = alt) AS both_right, count(*) FILTER (pred <> alt) AS differ FROM (SELECT *, substr(pred, 1, 3) AS alt FROM truth) GROUP BY 1")
def join_model_parity(s, d):
    o = W.table(s, d, "orders")
    pred = F.col("o_custkey").cast("string")
    one = o.select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("event"), (F.col("o_orderkey") % 1500).cast("string").alias("gt"), pred.alias("pred"))
    return DS.parity(one, o.select(F.col("o_orderkey").alias("key"), F.substring(pred, 1, 3).alias("alt")))


@query(
    """SELECT t.run_id, t.frame_idx, t.det_id, coalesce(b.conf, 0.0::DOUBLE) AS conf FROM (SELECT run_id, frame_idx, det_id, x1 + CASE WHEN det_id % 5 = 0 THEN 1 ELSE 0 END AS x1, y1, x1 + w AS x2, y1 + h AS y2 FROM det) t
    LEFT JOIN (SELECT run_id, frame_idx, x1, y1, x1 + w AS x2, y1 + h AS y2, first(confidence ORDER BY det_id, confidence)::DOUBLE AS conf FROM det GROUP BY ALL) b
    ON t.run_id = b.run_id AND t.frame_idx = b.frame_idx AND t.x1 = b.x1 AND t.y1 = b.y1 AND t.x2 = b.x2 AND t.y2 = b.y2"""
)
def join_detconf(s, d):
    """Tracks with the box of their detection; those of every fifth id coast, their boxes are stale by a pixel."""
    det = W.detections(s, d)
    tracks = det.select("run_id", "frame_idx", "det_id", (F.col("x1") + F.when(F.col("det_id") % 5 == 0, 1).otherwise(0)).alias("x1"), "y1", "x2", "y2")
    return A.with_confidence(tracks, det).select("run_id", "frame_idx", "det_id", "conf")


@query("SELECT p.frame_idx, p.id AS person, b.id AS bib FROM persons p JOIN bibs b ON p.frame_idx = b.frame_idx WHERE (b.cx BETWEEN p.x1 AND p.x2 AND b.cy BETWEEN p.y1 AND p.y2) OR NOT (b.x2 < p.x1 OR b.x1 > p.x2 OR b.y2 < p.y1 OR b.y1 > p.y2) OR sqrt((p.cx - b.cx) * (p.cx - b.cx) + (p.cy - b.cy) * (p.cy - b.cy)) < 60.0")
def join_person_near(s, d):
    """Persons and numbers of a frame that touch or are near, found by grid cells."""
    return A.near_pairs(W.persons(s, d), W.bibs(s, d), 60.0).select("frame_idx", "person", "bib")


@query()
def join_bytetrack(s, d):
    """Tracks by predicted boxes and two rounds of matching: all detections, each in a box as large as the one who carries it."""
    det = W.detections(s, d)
    wide = {c: F.col(c) + by for c, by in (("x1", -200), ("y1", -250), ("x2", 200), ("y2", 350))}
    return K.tracked(det.withColumns(wide), 30).select("run_id", "frame_idx", "track_id", "x1", "y1", "x2", "y2")


@query()
def join_assign(s, d):
    """Tracks over a moving window of detections in every run."""
    det = W.detections(s, d).select("run_id", "frame_idx", "x1", "y1", "x2", "y2")
    return TR.tracked(det, 30, 100.0).select("run_id", "frame_idx", "track_id", "cx", "cy", "matched")


@query()
def join_seed(s, d):
    """The association fold with inheritance from lost tracks, frame by frame."""
    r = W.readings(s, d)
    p = W.persons(s, d).groupBy("frame_idx").agg(F.array_sort(F.collect_list(F.struct("id", "cx", "cy", "x1", "y1", "x2", "y2"))).alias("persons"))
    b = W.bibs(s, d).join(r.withColumnRenamed("bib", "b"), F.col("id") == F.col("b")).groupBy(F.col("frame_idx").alias("f")).agg(F.array_sort(F.collect_list(F.struct("id", "cx", "cy", "x1", "y1", "x2", "y2", "number", "level"))).alias("bibs"))
    frames = p.join(b, F.col("frame_idx") == F.col("f")).select(F.lit("run0").alias("run_id"), "frame_idx", "persons", "bibs")
    return A.associated(frames, 150.0).select("frame_idx", "person", "number", F.round("confidence", 6).alias("confidence"))


# --- crossings and dedup --------------------------------------------------------------------------

@query(f"WITH {_CROSS} SELECT track_id, frame_idx, CAST(side_from AS INT) AS side_from, CAST(side_to AS INT) AS side_to FROM tr")
def cross_hysteresis(s, d):
    return X.transitions(W.observations(s, d), W.LINE, 3)


@query(
    f"""WITH {_CROSS}, fire(track_id, f) AS (SELECT track_id, min(frame_idx) FROM tr GROUP BY 1 UNION ALL SELECT t.track_id, (SELECT min(r.frame_idx) FROM tr r WHERE r.track_id = t.track_id AND r.frame_idx >= t.f + 1500) FROM fire t WHERE t.f IS NOT NULL)
    SELECT track_id, f AS frame_idx FROM fire WHERE f IS NOT NULL"""
)
def win_debounce(s, d):
    return X.crossings(W.observations(s, d), W.LINE, 3, 1500).select("track_id", "frame_idx")


@query(f"WITH {_CROSS} SELECT track_id, frame_idx FROM tr WHERE side_from = 1")
def win_direction(s, d):
    return X.crossings(W.observations(s, d), W.LINE, 3, 0, "left_to_right").select("track_id", "frame_idx")


@query(f"WITH {_CROSS} SELECT track_id, min(frame_idx) AS frame_idx FROM tr GROUP BY 1")
def st_once(s, d):
    return X.once(X.transitions(W.observations(s, d), W.LINE, 3))


@query(
    """WITH z AS (SELECT track_id, frame_idx, CASE WHEN frame_idx % 3 = 0 THEN number END AS bib, row_number() OVER (PARTITION BY track_id ORDER BY frame_idx) AS n FROM reads),
    k AS (SELECT track_id, min(CASE WHEN n >= 5 AND bib IS NOT NULL THEN frame_idx END) AS known, max(frame_idx) AS last, count(*) AS n FROM z GROUP BY 1)
    SELECT k.track_id, coalesce(k.known, k.last + 21) AS frame_idx, coalesce(z.bib, 'UNKNOWN') AS bib FROM k LEFT JOIN z ON z.track_id = k.track_id AND z.frame_idx = k.known WHERE k.known IS NOT NULL OR (k.n >= 5 AND k.last + 20 < (SELECT max(frame_idx) FROM reads))"""
)
def st_zone(s, d):
    r = W.reads(s, d)
    end = r.agg(F.max("frame_idx").alias("last_frame"))
    rows = r.join(F.broadcast(end)).select("track_id", "frame_idx", F.when(F.col("frame_idx") % 3 == 0, F.col("number")).alias("bib"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), "last_frame")
    return X.zone(rows).select("track_id", "frame_idx", "bib")


@query(
    """WITH e AS (SELECT *, row_number() OVER (PARTITION BY bib ORDER BY frame_idx, track_id) AS n FROM emissions),
    f(bib, n, frame_idx, conf, track_id, emitted, fired, times, tracks, places) AS (
      SELECT DISTINCT bib, 0::BIGINT, NULL::BIGINT, NULL::DOUBLE, NULL::BIGINT, false, NULL::BIGINT, 0, []::BIGINT[], []::DOUBLE[][] FROM emissions
      UNION ALL SELECT bib, n, frame_idx, conf, track_id, ok, CASE WHEN ok THEN frame_idx ELSE fired END, times + ok::INT, CASE WHEN ok THEN list_append(tracks, track_id) ELSE tracks END, CASE WHEN ok THEN list_append(places, [x, y]) ELSE places END
      FROM (SELECT e.bib, e.n, e.frame_idx, e.conf, e.track_id, e.x, e.y, f.fired, f.times, f.tracks, f.places,
        NOT list_contains(f.tracks, e.track_id) AND len(list_filter(f.places, lambda p: sqrt((e.x - p[1]) * (e.x - p[1]) + (e.y - p[2]) * (e.y - p[2])) < 5.0)) = 0 AND (f.fired IS NULL OR e.frame_idx - f.fired >= 300)
        AND f.times < 5 AND e.conf >= CASE f.times WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 0.7::DOUBLE ELSE 0.9::DOUBLE END AS ok FROM f JOIN e ON e.bib = f.bib AND e.n = f.n + 1))
    SELECT bib, frame_idx, conf, track_id, emitted FROM f WHERE n > 0"""
)
def st_dedup(s, d):
    return D.deduplicated(W.emissions(s, d), 300, 5.0).select("bib", "frame_idx", "conf", "track_id", "emitted")


@query("SELECT run_id, sequence, max_by(bib, version) AS bib FROM (SELECT event_type AS run_id, user_id AS sequence, event_id AS version, CAST(k AS VARCHAR) AS bib FROM ev) GROUP BY 1, 2")
def st_upsert(s, d):
    rows = W.events(s, d).select(F.col("event_type").alias("run_id"), F.col("user_id").alias("sequence"), F.col("event_id").alias("version"), F.col("k").cast("string").alias("bib"))
    return R.latest(rows, ("run_id",)).select("run_id", "sequence", "bib")


@query("SELECT run_id, CAST(ceil(frame_idx / 300.0) * 300 AS BIGINT) AS frame_idx, count(*) AS rows, count(DISTINCT track_id) AS tracks FROM reads WHERE frame_idx % 3 = 0 GROUP BY 1, 2")
def st_progress(s, d):
    """Reports every 100 frames where every third is processed: at multiples of 300."""
    return X.progress(W.reads(s, d), 100, 3)


@query("SELECT track_id, run_id, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY run_id, track_id ORDER BY frame_idx) AS session FROM (SELECT *, CASE WHEN frame_idx - lag(frame_idx) OVER (PARTITION BY run_id, track_id ORDER BY frame_idx) <= 300 THEN 0 ELSE 1 END AS new FROM reads)) GROUP BY track_id, run_id, session")
def st_track_session(s, d):
    return TR.sessions(W.reads(s, d), 300)


@query("SELECT frame_idx AS sequence, bib, conf, 'pose' AS source FROM emissions UNION ALL SELECT -1::BIGINT, bib, 1.0::DOUBLE, 'manual' FROM registry")
def st_manual(s, d):
    feed = W.emissions(s, d).select(F.col("frame_idx").alias("sequence"), "bib", "conf", F.lit("pose").alias("source"))
    return X.with_manual(feed, W.registry(s, d))


@query("SELECT run_id, frame_idx, track_id, grp, rank() OVER (PARTITION BY run_id, grp ORDER BY frame_idx) AS position FROM (SELECT *, sum(new) OVER (PARTITION BY run_id ORDER BY frame_idx)::BIGINT AS grp FROM (SELECT *, CASE WHEN frame_idx - lag(frame_idx) OVER (PARTITION BY run_id ORDER BY frame_idx) <= 3 THEN 0 ELSE 1 END AS new FROM reads))")
def win_group_pos(s, d):
    out = R.place_in_group(W.reads(s, d), 3)
    return out.select("run_id", "frame_idx", "track_id", F.col("group").alias("grp"), F.col("position").cast("long").alias("position"))


# --- aggregations ---------------------------------------------------------------------------------


@query("SELECT track_id, kind, first_frame, last_frame, first_x, last_x, n FROM lifetimes")
def agg_track_diag(s, d):
    return W.lifetimes(s, d).select("track_id", "kind", "first_frame", "last_frame", "first_x", "last_x", "n")


@query("SELECT CASE WHEN c >= 0.85 THEN 'high' WHEN c >= 0.70 THEN 'medium' WHEN c >= 0.50 THEN 'low' ELSE 'reject' END AS level, count(*) AS tracks FROM (SELECT max_by(conf, frame_idx) AS c FROM reads GROUP BY track_id) GROUP BY 1")
def agg_levels(s, d):
    last = W.reads(s, d).groupBy("track_id").agg(F.max_by(T.level(F.col("conf")), "frame_idx").alias("level"))
    return last.groupBy("level").agg(F.count(F.lit(1)).alias("tracks"))


@query("SELECT number, count(DISTINCT track_id) AS tracks FROM reads WHERE conf >= 0.7 GROUP BY 1 ORDER BY tracks DESC, number LIMIT 20")
def agg_bib_tracks(s, d):
    return W.reads(s, d).where("conf >= 0.7").groupBy("number").agg(F.countDistinct("track_id").alias("tracks")).orderBy(F.desc("tracks"), "number").limit(20)


@query("SELECT number, max(conf) AS conf FROM reads GROUP BY 1")
def agg_bibconf(s, d):
    return W.reads(s, d).groupBy("number").agg(F.max("conf").alias("conf"))


@query("SELECT count(*) AS detections, count(*) FILTER (confidence < 0.25) AS below, count(*) FILTER (x1 <= 96) AS at_edge, count(DISTINCT frame_idx) AS frames FROM det")
def agg_counters(s, d):
    return W.detections(s, d).agg(F.count(F.lit(1)).alias("detections"), F.count_if(F.col("confidence") < 0.25).alias("below"), F.count_if(F.col("x1") <= 96).alias("at_edge"), F.countDistinct("frame_idx").alias("frames"))


@query("SELECT event, sum(ms) / greatest(count(*), 1) AS mean_ms FROM truth GROUP BY 1")
def agg_timing(s, d):
    return W.truth(s, d).groupBy("event").agg((F.sum("ms") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("mean_ms"))


@query("SELECT model, count(*) AS n FROM (SELECT CASE WHEN CAST(CAST(pred AS INT) % 100 AS DOUBLE) / 100.0 < 0.85 OR length(pred) BETWEEN 1 AND 2 THEN 'slow' ELSE 'fast' END AS model FROM preds) GROUP BY 1")
def agg_cascade(s, d):
    rows = W.predictions(s, d).select(F.col("pred").alias("read_id"), F.col("pred").alias("text"), ((F.col("pred").cast("int") % 100).cast("double") / 100.0).alias("conf"))
    out = Q.cascade(rows, rows.select("read_id", F.concat(F.lit("s"), "text").alias("text"), F.lit(0.99).alias("conf")))
    return out.groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT length(bib) AS digits, count(*) AS n, max(CAST(bib AS BIGINT)) AS most FROM registry GROUP BY 1")
def agg_digitset(s, d):
    return W.registry(s, d).groupBy(F.length("bib").cast("long").alias("digits")).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("bib").try_cast("long")).alias("most"))


@query("SELECT track_id, number, round(mean, 6) AS confidence FROM (SELECT track_id, number, avg(conf) AS mean, count(*) AS n FROM reads GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY round(mean * (1 + 0.1 * n), 9) DESC, number) = 1")
def agg_voteA(s, d):
    return V.vote_mean_bonus(W.reads(s, d)).select("track_id", "number", F.round("confidence", 6).alias("confidence"))


@query("SELECT track_id, number, round(mean, 6) AS confidence FROM (SELECT track_id, number, avg(conf) AS mean, sum(conf) AS t FROM reads GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY round(t, 9) DESC, number) = 1")
def agg_voteB(s, d):
    return V.vote_sum(W.reads(s, d)).select("track_id", "number", F.round("confidence", 6).alias("confidence"))


@query(
    """SELECT CASE WHEN grouping(digits) = 1 AND grouping(event) = 1 THEN 'all' WHEN grouping(digits) = 0 THEN 'digits' ELSE 'event' END AS slice, coalesce(CASE WHEN grouping(digits) = 0 THEN digits END, CASE WHEN grouping(event) = 0 THEN event END, '') AS value,
    count(*) AS n, round(avg(CASE WHEN gt = pred THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS exact, round(avg(1.0::DOUBLE - levenshtein(gt, pred)::DOUBLE / greatest(length(gt), length(pred))), 6) AS char_accuracy
    FROM (SELECT *, CAST(length(gt) AS VARCHAR) AS digits FROM truth) GROUP BY GROUPING SETS ((), (digits), (event))"""
)
def agg_metrics(s, d):
    out = DS.metrics(W.truth(s, d))
    return out.select("slice", "value", "n", F.round("exact", 6).alias("exact"), F.round("char_accuracy", 6).alias("char_accuracy"))


@query("SELECT event, round(avg(ms), 6) AS mean, median(ms) AS median, round(quantile_cont(ms, 0.95), 6) AS p95, round(quantile_cont(ms, 0.99), 6) AS p99 FROM truth GROUP BY 1")
def agg_latency(s, d):
    out = DS.latency(W.truth(s, d), "ms", "event")
    return out.select("event", F.round("mean", 6).alias("mean"), "median", F.round("p95", 6).alias("p95"), F.round("p99", 6).alias("p99"))


@query("SELECT event, count(*) FILTER (digit_count = 1) AS d1, count(*) FILTER (digit_count = 2) AS d2, count(*) FILTER (digit_count = 3) AS d3 FROM samples GROUP BY 1")
def agg_dataset(s, d):
    return W.samples(s, d).groupBy("event").pivot("digit_count", [1, 2, 3]).agg(F.count(F.lit(1))).select("event", *[F.coalesce(F.col(str(k)), F.lit(0).cast("long")).alias(f"d{k}") for k in (1, 2, 3)])


@query("SELECT min(n) AS least, max(n) AS most, sum(n)::BIGINT AS boxes, count(*) FILTER (area < 100) AS tiny FROM (SELECT image_id, count(*) AS n, max(w * h) AS area FROM ann GROUP BY 1)")
def agg_annot(s, d):
    per = W.annotations(s, d).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("w") * F.col("h")).alias("area"))
    return per.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("boxes"), F.count_if(F.col("area") < 100).alias("tiny"))


@query("SELECT count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status IS NULL) AS pending, count(*) AS total, count(*) FILTER (status = 'verified')::DOUBLE / greatest(count(*), 1) AS rate FROM items")
def agg_review(s, d):
    return RV.summary(W.review_items(s, d))


@query("SELECT run_id, count(*) FILTER (conf >= 0.5) AS known, count(DISTINCT CASE WHEN conf >= 0.5 THEN number END) AS bibs FROM reads GROUP BY 1")
def agg_live(s, d):
    return W.reads(s, d).groupBy("run_id").agg(F.count_if(F.col("conf") >= 0.5).alias("known"), F.countDistinct(F.when(F.col("conf") >= 0.5, F.col("number"))).alias("bibs"))


@query(
    """WITH k AS (SELECT bib, count(*) AS n FROM emissions GROUP BY 1), t AS (SELECT DISTINCT CAST(1000 + c_custkey % 3 AS VARCHAR) AS bib FROM customer)
    SELECT (SELECT count(*) FROM k JOIN t USING (bib)) AS tp, (SELECT count(*) FROM k WHERE bib NOT IN (SELECT bib FROM t)) AS fp, (SELECT sum(n - 1)::BIGINT FROM k) AS duplicates, (SELECT count(*) FROM emissions) AS crossings, 0::BIGINT AS unknown, (SELECT count(*) FROM t) AS truth"""
)
def agg_scorecard(s, d):
    t = W.table(s, d, "customer").select((F.lit(1000) + F.col("c_custkey") % 3).cast("string").alias("bib"))
    return DS.scorecard(W.emissions(s, d).select("bib"), t, W.reads(s, d).select(F.col("number").alias("bib"))).select("tp", "fp", "duplicates", "crossings", "unknown", "truth")


@query(
    """WITH t AS (SELECT event, CAST(gt AS DOUBLE) AS a, CAST(pred AS DOUBLE) AS b FROM truth), o AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY a, b) AS n FROM t WHERE a IS NOT NULL AND b IS NOT NULL),
    p(event, n, piles) AS (SELECT DISTINCT event, 0::BIGINT, []::DOUBLE[] FROM t
      UNION ALL SELECT event, n, list_concat(list_append(piles[1:i], b), piles[i + 2:]) FROM (SELECT o.event, o.n, o.b, p.piles, len(list_filter(p.piles, lambda x: x < o.b)) AS i FROM p JOIN o ON o.event = p.event AND o.n = p.n + 1)),
    l AS (SELECT event, max(len(piles)) AS k FROM p GROUP BY 1)
    SELECT t.event, round(any_value(k)::DOUBLE / greatest(count(a), count(b), 1), 6) AS lcs FROM t JOIN l ON l.event = t.event GROUP BY 1"""
)
def agg_order(s, d):
    t = W.truth(s, d).select("event", F.col("gt").alias("bib"), F.col("gt").cast("long").alias("true_place"), F.col("pred").cast("long").alias("out_place"))
    return DS.order_accuracy(t).select("event", F.round("lcs", 6).alias("lcs"))


@query(
    """WITH t AS (SELECT DISTINCT bib FROM registry), r AS (SELECT CAST(track_id * 3 AS VARCHAR) AS bib, max(conf) >= 0.99 AS sure FROM reads GROUP BY 1), c AS (SELECT DISTINCT CAST(track_id * 6 AS VARCHAR) AS bib FROM emissions)
    SELECT count(*) AS truth, count(r.bib) AS seen, count(*) FILTER (r.sure) AS sure, count(c.bib) AS crossed FROM t LEFT JOIN r USING (bib) LEFT JOIN c USING (bib)"""
)
def agg_funnel(s, d):
    r = W.reads(s, d).select((F.col("track_id") * 3).cast("string").alias("bib"), F.when(F.col("conf") >= 0.99, "high").otherwise("low").alias("level"))
    c = W.emissions(s, d).select((F.col("track_id") * 6).cast("string").alias("bib"))
    return DS.funnel(W.registry(s, d), r, c)


# --- sorts, limits, sets, samples -----------------------------------------------------------------


@query("SELECT frame_idx, count(*) AS n FROM det GROUP BY 1 ORDER BY n DESC, frame_idx LIMIT 25")
def top_frames(s, d):
    return DS.densest(W.detections(s, d), 25)


@query("SELECT gt AS label, count(*) AS n FROM truth GROUP BY 1 ORDER BY n DESC, label LIMIT 20")
def top_labels(s, d):
    return W.truth(s, d).groupBy(F.col("gt").alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(20)


@query("SELECT pred, list_slice(list(bib ORDER BY score DESC, bib), 2, 4)::VARCHAR AS alternatives FROM (SELECT pred, bib, max(score) AS score FROM (SELECT pred, d || pred AS bib, 2 AS score FROM preds JOIN (SELECT CAST(range AS VARCHAR) AS d FROM range(1, 10)) ON true UNION ALL SELECT pred, pred || d, 1 FROM preds JOIN (SELECT CAST(range AS VARCHAR) AS d FROM range(0, 10)) ON true) WHERE bib IN (SELECT bib FROM registry) GROUP BY 1, 2) GROUP BY 1")
def top_alternatives(s, d):
    p, r = W.predictions(s, d), W.registry(s, d)
    best = REG.leading(p, r).unionByName(REG.trailing(p, r)).groupBy("pred", "bib").agg(F.max("score").alias("score"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "bib")))
    return best.groupBy("pred").agg(F.slice(ranked, 2, 3)["bib"].alias("a")).select("pred", F.concat(F.lit("["), F.array_join("a", ", "), F.lit("]")).alias("alternatives"))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n, count(*) OVER () AS total FROM orders) WHERE n IN (SELECT CAST(floor(range * (SELECT count(*) FROM orders)::DOUBLE / 40) AS BIGINT) FROM range(40))")
def lim_even(s, d):
    return DS.evenly(W.table(s, d, "orders").select("o_orderkey"), "o_orderkey", 40)


@query("SELECT 'review_' || (row_number() OVER (ORDER BY frame_idx, bib) + greatest((SELECT count(*) FROM emissions) - 100, 0)) AS id, bib, frame_idx AS frame_number FROM (SELECT * FROM emissions ORDER BY frame_idx DESC, bib DESC LIMIT 100)")
def lim_tail(s, d):
    e = W.emissions(s, d).select("bib", F.col("frame_idx").alias("frame_number"))
    return RV.queue(e).select("id", "bib", "frame_number")


@query("SELECT sequence FROM items ORDER BY sequence LIMIT 15")
def lim_head(s, d):
    return W.review_items(s, d).select("sequence").orderBy("sequence").limit(15)


@query("SELECT sequence, bib FROM items WHERE coalesce(status, 'pending') = 'pending' ORDER BY CASE WHEN sequence > 50 THEN 0 ELSE 1 END, sequence LIMIT 1")
def sel_next(s, d):
    return RV.next_pending(W.review_items(s, d).withColumn("idx", F.col("sequence")), 50).select("sequence", "bib")


@query("SELECT track_id, first(number ORDER BY conf DESC, length(number) DESC, number) AS text, round(max(conf) + 0.1, 6) AS score FROM reads GROUP BY 1")
def sel_ocr_best(s, d):
    rows = W.reads(s, d).select("track_id", F.col("number").alias("raw"), "conf")
    return Q.ocr_best(rows, "track_id").select("track_id", "text", F.round("score", 6).alias("score"))


@query("SELECT 'orders' AS event, CAST(o_orderkey AS VARCHAR) AS label FROM orders UNION ALL SELECT 'customer' AS event, CAST(c_custkey AS VARCHAR) FROM customer")
def set_union_sources(s, d):
    o = W.table(s, d, "orders").select(F.lit("orders").alias("event"), F.col("o_orderkey").cast("string").alias("label"))
    return o.unionByName(W.table(s, d, "customer").select(F.lit("customer").alias("event"), F.col("c_custkey").cast("string").alias("label")))


@query("SELECT coalesce(a.k, f.k) AS name, CASE WHEN f.k IS NULL THEN 'missing_file' WHEN a.k IS NULL THEN 'unannotated' ELSE 'both' END AS state FROM (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS k FROM lineitem WHERE l_orderkey % 3 > 0) a FULL JOIN (SELECT CAST(o_orderkey AS VARCHAR) AS k FROM orders WHERE o_orderkey % 2 = 0) f ON a.k = f.k")
def set_files(s, d):
    a = W.table(s, d, "lineitem").where("l_orderkey % 3 > 0").select(F.col("l_orderkey").cast("string").alias("name"))
    return DS.reconciled(a, W.table(s, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("string").alias("name")))


@query("WITH k(f) AS (SELECT min(frame_idx) FROM det UNION ALL SELECT (SELECT min(e.frame_idx) FROM det e WHERE e.frame_idx >= k.f + 500) FROM k WHERE k.f IS NOT NULL) SELECT coalesce(u.f, t.f) AS frame_idx, CASE WHEN t.f IS NULL THEN 'uniform' WHEN u.f IS NULL THEN 'topk' ELSE 'both' END AS how FROM (SELECT f FROM k WHERE f IS NOT NULL) u FULL JOIN (SELECT frame_idx AS f FROM det GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 25) t ON u.f = t.f")
def set_selection(s, d):
    det = W.detections(s, d)
    return DS.selection(DS.spaced(det, 500), DS.densest(det, 25))


@query("SELECT DISTINCT track_id FROM reads WHERE track_id NOT IN (SELECT track_id FROM emissions)")
def set_stale(s, d):
    return W.reads(s, d).select("track_id").distinct().join(W.emissions(s, d).select("track_id").distinct(), "track_id", "left_anti")


@query("SELECT doc_id, event, CASE WHEN row_number() OVER (PARTITION BY event ORDER BY md5('42#' || doc_id), doc_id) <= floor(count(*) OVER (PARTITION BY event) * 0.85) THEN 'train' ELSE 'val' END AS split FROM samples")
def smp_split(s, d):
    return DS.split_by_event(W.samples(s, d), "doc_id").select("doc_id", "event", "split")


@query(
    """SELECT doc_id, event, CASE WHEN total < 10 THEN 'train' WHEN p <= n THEN 'test' WHEN p <= 2 * n THEN 'val' ELSE 'train' END AS split FROM (SELECT doc_id, event, count(*) OVER (PARTITION BY event) AS total,
    greatest(floor(count(*) OVER (PARTITION BY event, digit_count) * 0.1), 1) AS n, row_number() OVER (PARTITION BY event, digit_count ORDER BY md5('42#' || doc_id), doc_id) AS p FROM samples)"""
)
def smp_stratified(s, d):
    return DS.stratified_split(W.samples(s, d), "doc_id").select("doc_id", "event", "split")


@query("SELECT doc_id, unnest(range(CASE digit_count WHEN 1 THEN 11 WHEN 2 THEN 6 WHEN 3 THEN 3 ELSE 1 END))::INT AS copy FROM samples")
def smp_oversample(s, d):
    return DS.oversampled(W.samples(s, d)).select("doc_id", "copy")


@query("SELECT id, CAST(id % 4 + 1 AS INT) AS digits, CAST(CAST(pow(10, id % 4) AS BIGINT) + CAST('0x' || substr(md5('7#' || id), 1, 12) AS BIGINT) % (9 * CAST(pow(10, id % 4) AS BIGINT)) AS VARCHAR) AS label FROM (SELECT o_orderkey AS id FROM orders)")
def gen_numbers(s, d):
    """A synthetic label of one to four digits for every order, evenly by length, from a seed."""
    return DS.numbers_for(W.table(s, d, "orders").select(F.col("o_orderkey").alias("id")), 7)


@query("SELECT id, status FROM (SELECT 'review_' || sequence AS id, status FROM items) WHERE id NOT IN (SELECT 'review_' || sequence FROM items WHERE status IS NOT NULL)")
def rq_ops(s, d):
    items = W.review_items(s, d).select(F.concat(F.lit("review_"), F.col("sequence").cast("string")).alias("id"), "status")
    return RV.resolved(items, items.where("status is not null"))


@query(
    """SELECT images, annotations, missing, issues, CASE WHEN missing = 0 THEN 'READY' ELSE 'NOT READY' END AS status,
    concat_ws('; ', CASE WHEN images < 500 THEN 'few images' END, CASE WHEN annotations < images THEN 'less than one annotation an image' END, CASE WHEN issues > 0 THEN 'box issues' END) AS warnings
    FROM (SELECT (SELECT count(*) FROM images) AS images, (SELECT count(*) FROM ann) AS annotations, (SELECT count(*) FROM images WHERE image_id NOT IN (SELECT l_orderkey FROM lineitem)) AS missing, (SELECT count(*) FROM ann WHERE w <= 0 OR h <= 0) AS issues)"""
)
def ds_status(s, d):
    """Whether the images have their files (orders that have line items) and sound boxes."""
    name = lambda c: F.col(c).cast("string").alias("name")
    boxes = W.annotations(s, d).select("id", F.array("x", "y", "w", "h").alias("bbox"))
    return DS.counted_readiness(W.images(s, d).select(name("image_id")), boxes, W.table(s, d, "lineitem").select(name("l_orderkey")))


@query("SELECT lang, count(*) AS n, count(*) FILTER (length(coalesce(text, '')) >= 1000) AS accepted, count(*) FILTER (length(coalesce(text, '')) < 1000) AS rejected, count(*) FILTER (length(coalesce(text, '')) >= 1000)::DOUBLE / count(*) AS share FROM documents GROUP BY 1")
def ds_compare(s, d):
    return DS.gate_comparison(W.table(s, d, "documents"), "lang", F.length(F.coalesce("text", F.lit(""))) >= 1000)


# --- the rest of the inventory --------------------------------------------------------------------


@query("SELECT 'run0' AS run_id, range AS frame_idx FROM range(1, (SELECT count(*) + 1 FROM orders))")
def src_iter(s, d):
    """As many frames of the frame source as there are orders."""
    s.dataSource.register(readers.FrameSource)
    frames = s.read.format("frames").options(frames=W.table(s, d, "orders").count(), width=8, height=8)
    return frames.load().select("run_id", "frame_idx")


@query("SELECT 'run0' AS run_id, row_number() OVER (ORDER BY r_regionkey) AS frame_idx, 5::INT AS width, 2::INT AS height, upper(hex(substr(r_name || '          ', 1, 10))) AS pixels FROM region")
def src_memory(s, d):
    """Frames of 5 x 2 pixels from the five names of regions."""
    names = [r.r_name for r in W.table(s, d, "region").orderBy("r_regionkey").collect()]
    frames = readers.memory(s, (np.frombuffer(x.encode().ljust(10)[:10], np.uint8).reshape(2, 5) for x in names))
    return frames.select("run_id", "frame_idx", "width", "height", F.hex("payload").alias("pixels"))


@query("SELECT n_nationkey::BIGINT AS id, n_name AS token FROM nation")
def src_tokenizer(s, d):
    """A vocabulary file of the 25 nations."""
    one = W.table(s, d, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey")))).alias("value"))
    return readers.vocabulary(s, _put(one.coalesce(1).write.text, s, "vocabulary")).select("id", "token")


@query("SELECT gt, pred FROM truth WHERE regexp_matches(gt, '^[0-9]{1,4}$')")
def flt_label(s, d):
    return readers.valid_labels(W.truth(s, d), "gt").select("gt", "pred")


@query()
def flt_completeness(s, d):
    """Completeness of crops: the bytes of each whole document as grey pixels, 40 wide, the last row filled up with spaces."""
    return _crops(s, d).select("doc_id", Q.crop_stats("pixels", F.lit(40)).alias("s")).select("doc_id", *[F.round(f"s.{c}", 6).alias(c) for c in Q.STATS])


@query("SELECT 'review_' || (row_number() OVER (ORDER BY frame_idx, bib) + greatest((SELECT count(*) FROM emissions) - 100, 0)) AS id, bib, frame_idx AS frame_number FROM (SELECT * FROM emissions ORDER BY frame_idx DESC, bib DESC LIMIT 100)")
def snk_review_json(s, d):
    """The review queue (100 items) as one JSON array, written and read."""
    queue = RV.queue(W.emissions(s, d).select("bib", F.col("frame_idx").alias("frame_number")))
    one = sinks.json_array(queue.select("id", "bib", "frame_number"), "frame_number").select("json")
    return readers.results_json(s, _put(one.coalesce(1).write.text, s, "review")).select("id", "bib", "frame_number")


@query("SELECT CAST(track_id AS VARCHAR) AS track_id, CAST(min(frame_idx) AS VARCHAR) AS first_frame, CAST(count(*) AS VARCHAR) AS frames_seen, format('{:.1f}', min_by(y, frame_idx) * 100) AS first_chest_y FROM obs GROUP BY obs.track_id")
def snk_person_tracks(s, d):
    o = W.observations(s, d)
    first, last = (lambda c: F.min_by(c, "frame_idx") * 100), (lambda c: F.max_by(c, "frame_idx") * 100)
    per = o.groupBy("track_id").agg(F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"), F.count(F.lit(1)).alias("frames_seen"), first("x").alias("first_chest_x"), first("y").alias("first_chest_y"), last("x").alias("last_chest_x"), last("y").alias("last_chest_y"))
    rows = sinks.track_rows(per.withColumn("crossed", F.lit(False)).withColumn("bib", F.lit(None).cast("string")))
    return rows.select("track_id", "first_frame", "frames_seen", "first_chest_y")


@query("SELECT sequence, CASE WHEN action = 'correct' THEN coalesce(corrected_bib, bib) ELSE bib END AS bib FROM items WHERE coalesce(action, '') <> 'reject'")
def snk_export(s, d):
    """The corrected crossings as CSV, written and read."""
    path = shared.path(s, "export")
    sinks.write_csv(J_review(s, d), path)
    return s.read.csv(path, header=True, schema="sequence bigint, bib string")


@query("SELECT sequence, bib, coalesce(status, 'pending') AS status FROM items")
def snk_review_csv(s, d):
    path = shared.path(s, "review")
    sinks.write_csv(sinks.review_rows(W.review_items(s, d)), path)
    return s.read.csv(path, header=True, schema="sequence bigint, bib string, status string")


@query("SELECT sequence, bib AS label FROM items WHERE status = 'verified' AND regexp_matches(bib, '^[0-9]{1,4}$')")
def snk_ocr_labels(s, d):
    return readers.valid_labels(W.review_items(s, d).where("status = 'verified'"), "bib").select("sequence", F.col("bib").alias("label"))


@query("SELECT event, gt, pred, CASE WHEN length(pred) < length(gt) THEN 'truncation' WHEN length(pred) > length(gt) THEN 'extra' ELSE 'confusion' END AS kind FROM truth WHERE pred <> gt")
def snk_eval(s, d):
    """The wrong predictions as CSV, written and read."""
    path = shared.path(s, "errors")
    sinks.write_csv(sinks.error_rows(W.truth(s, d)), path)
    return s.read.csv(path, header=True, schema="event string, gt string, pred string, kind string")


@query("SELECT run_id, format('{}: {} reads, {} tracks, {} unsure', run_id, count(*), count(DISTINCT track_id), count(*) FILTER (conf < 0.5)) AS line FROM reads GROUP BY 1")
def snk_summary(s, d):
    return sinks.summary_lines(W.reads(s, d))


@query("SELECT run_id, count(*) AS total, count(*) FILTER (number = '1000') AS cleaned, count(*) FILTER (conf < 0.35) AS rejected, count(*) FILTER (number = '1000')::DOUBLE / greatest(count(*), 1) AS cleaned_share FROM reads GROUP BY 1")
def agg_ocr_stats(s, d):
    cleaned = F.count_if(F.col("number") == "1000")
    return W.reads(s, d).groupBy("run_id").agg(F.count(F.lit(1)).alias("total"), cleaned.alias("cleaned"), F.count_if(F.col("conf") < 0.35).alias("rejected"), (cleaned / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("cleaned_share"))


@query("SELECT run_id, first(track_id ORDER BY conf DESC, track_id DESC) AS track_id FROM reads GROUP BY 1")
def agg_wifi(s, d):
    return V.strongest(W.reads(s, d), "run_id", "track_id", "conf")


@query(f"WITH {_CROSS} SELECT track_id, frame_idx FROM tr")
def st_line(s, d):
    return X.transitions(W.observations(s, d), W.LINE, 3).select("track_id", "frame_idx")


@query(
    f"""WITH {_CROSS}, fire(track_id, f) AS (SELECT track_id, min(frame_idx) FROM tr GROUP BY 1 UNION ALL SELECT t.track_id, (SELECT min(r.frame_idx) FROM tr r WHERE r.track_id = t.track_id AND r.frame_idx >= t.f + 1500) FROM fire t WHERE t.f IS NOT NULL)
    SELECT track_id, f AS frame_idx, NULL::DOUBLE AS chest_x, NULL::DOUBLE AS chest_y, 'bib_line' AS source FROM fire WHERE f IS NOT NULL"""
)
def st_bibline(s, d):
    return X.bib_line(W.observations(s, d), W.LINE, 3, 1500).select("track_id", "frame_idx", "chest_x", "chest_y", "source")


@query("SELECT run_id, track_id, max_by(number, frame_idx) AS number, max(frame_idx) AS last_frame, max(frame_idx) >= any_value(run_end) - 300 AS live FROM (SELECT *, max(frame_idx) OVER (PARTITION BY run_id) AS run_end FROM reads) GROUP BY 1, 2")
def st_consensus_ttl(s, d):
    """The last number of every track, and whether it is still remembered at the end of its run."""
    return V.remembered(W.reads(s, d), 300)


@query("SELECT p.frame_idx, p.id, round((p.x1 + p.x2) / 2, 6) AS x FROM persons p")
def fn_center(s, d):
    return W.persons(s, d).select("frame_idx", "id", F.round(G.center(F.col("x1"), F.col("x2")), 6).alias("x"))


@query("SELECT image_id, 'src_' || regexp_replace(file_name, '[.]jpg$', '') || '.jpg' AS name FROM images")
def ds_copy(s, d):
    return DS.copies(W.images(s, d), "src").select("image_id", "name")


@query("WITH k(f) AS (SELECT min(frame_idx) FROM det UNION ALL SELECT (SELECT min(e.frame_idx) FROM det e WHERE e.frame_idx >= k.f + 300) FROM k WHERE k.f IS NOT NULL) SELECT k.f, count(*) AS n FROM k JOIN det ON det.frame_idx = k.f GROUP BY 1")
def win_uniform(s, d):
    """Frames at least 300 after the one kept before, with their detections."""
    det = W.detections(s, d)
    return det.join(DS.spaced(det, 300), "frame_idx", "left_semi").groupBy(F.col("frame_idx").alias("f")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS p, count(*) OVER () AS n FROM orders) WHERE p IN (SELECT CAST(floor(i * m.n / ceil(m.n / 500.0)) AS BIGINT) FROM (SELECT count(*) AS n FROM orders) m, (SELECT unnest(range(100000)) AS i) WHERE i < ceil(m.n / 500.0))")
def ds_samples(s, d):
    """One order of 500, at even steps by place."""
    o = W.table(s, d, "orders").select("o_orderkey", "o_custkey")
    return DS.evenly(o, "o_orderkey", -(-o.count() // 500))


@query("SELECT CAST(doc_id AS VARCHAR) AS image_id, '1,2,' || doc_id AS bibs FROM documents")
def src_provider_csv(s, d):
    """Photos with their numbers in one quoted cell of several lines, written and read."""
    i = F.col("doc_id").cast("string")
    rows = W.table(s, d, "documents").select(F.col("source").alias("camera_tag"), F.concat(F.lit("http://host/"), i).alias("image_url"), i.alias("event_image_id"), F.concat(F.lit("1\n 2 \n\n"), i).alias("associated_bibs"))
    path = _put(lambda p: rows.write.csv(p, header=True, escape='"'), s, "photos")
    return readers.provider_photos(s, path).select("image_id", F.array_join("bibs", ",").alias("bibs"))


@query("SELECT CAST(user_id AS VARCHAR) AS image_id, event_id AS frame, value AS score FROM events")
def src_results_json(s, d):
    """Results of runs as JSON lines, written and read."""
    rows = W.events(s, d).select(F.col("user_id").cast("string").alias("image_id"), F.col("event_id").alias("frame"), F.col("value").alias("score"))
    return readers.results_json(s, _put(rows.write.json, s, "results"), lines=True).select("image_id", "frame", "score")


@query("SELECT 'region=' || n_regionkey AS folder, CAST(sum(length(n_name) + 1) AS BIGINT) AS bytes FROM nation GROUP BY 1")
def src_image_dir(s, d):
    """The sizes of all files below a folder, by the folder they are in."""
    rows = W.table(s, d, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("value"))
    found = readers.files(s, _put(rows.write.partitionBy("region").text, s, "files"), "*.txt")
    return found.groupBy(F.element_at(F.split("path", "/"), -2).alias("folder")).agg(F.sum("length").alias("bytes"))


@query("SELECT event_type AS video, CAST(event_id AS VARCHAR) AS frame, format('{:.3f}', event_id / 32.0) AS time_sec, format('{}_{:06d}.jpg', event_type, event_id) AS file FROM events")
def snk_manifest(s, d):
    """The manifest of extracted frames as CSV, written and read."""
    frames = W.events(s, d).select(F.col("event_type").alias("video"), F.col("event_id").alias("frame_idx"))
    path = shared.path(s, "manifest")
    sinks.write_csv(sinks.manifest_rows(frames, 32.0), path)
    return s.read.csv(path, header=True, schema="video string, frame string, time_sec string, file string")


@query(
    """SELECT run_id, seq, CASE WHEN next IS NULL THEN 'left' WHEN next THEN 'lost' ELSE 'taken' END AS outcome
    FROM (SELECT run_id, frame_idx AS seq, put, lead(put) OVER (PARTITION BY run_id ORDER BY frame_idx) AS next FROM (SELECT run_id, frame_idx, number <> '1000' AS put FROM reads)) WHERE put"""
)
def st_backpressure(s, d):
    """A slot that the newest frame overwrites: taken if the consumer comes before the next frame."""
    rows = W.reads(s, d).select("run_id", F.col("frame_idx").alias("seq"), (F.col("number") != "1000").alias("put"))
    return buffers.outcomes(rows, policy="newest")


@query(
    """WITH t AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY frame_idx) AS place, frame_idx AS seq, number <> '1000' AS put FROM reads),
    f(run_id, place, held) AS (SELECT DISTINCT run_id, 0::BIGINT, 0::BIGINT FROM reads UNION ALL SELECT t.run_id, t.place, CASE WHEN t.put THEN least(f.held + 1, 8) ELSE greatest(f.held - 1, 0) END FROM f JOIN t ON t.run_id = f.run_id AND t.place = f.place + 1)
    SELECT t.run_id, t.seq FROM t JOIN f ON f.run_id = t.run_id AND f.place = t.place - 1 WHERE t.put AND f.held = 8"""
)
def snk_ws(s, d):
    """What a full push queue of eight turns away."""
    rows = W.reads(s, d).select("run_id", F.col("frame_idx").alias("seq"), (F.col("number") != "1000").alias("put"))
    return buffers.outcomes(rows, 8, "drop_new").where("outcome = 'lost'").select("run_id", "seq")


@query("SELECT track_id, count(n) AS votes, count(n) = 0 AS needs_review FROM (SELECT t.track_id, r.frame_idx AS n FROM (SELECT DISTINCT track_id FROM reads) t LEFT JOIN (SELECT track_id, frame_idx FROM reads WHERE frame_idx > coalesce((SELECT max(e.frame_idx) FROM emissions e WHERE e.track_id = reads.track_id), -1)) r ON r.track_id = t.track_id) GROUP BY 1")
def st_clear(s, d):
    """Votes of every track since it was cleared by its last emission; none is the empty result."""
    r = W.reads(s, d)
    left = V.after_clear(r, W.emissions(s, d)).groupBy("track_id").agg(F.max("number").alias("number"), F.count(F.lit(1)).alias("votes"), F.avg("conf").alias("confidence"), F.lit(False).alias("needs_review"))
    return V.or_empty(r, left).select("track_id", "votes", "needs_review")


# --- review queue, gates and parsing ---------------------------------------------------------------


@query(
    """WITH alt AS (ALT),
    i AS (SELECT p.pred AS bib, CAST(p.pred AS BIGINT) AS n, CAST(30 + CAST(p.pred AS BIGINT) % 70 AS DOUBLE) / 100.0::DOUBLE AS conf, p.pred IN (SELECT bib FROM registry) AS valid, alt.a FROM preds p LEFT JOIN alt ON alt.pred = p.pred),
    r AS (SELECT *, concat_ws('; ', CASE WHEN conf < 0.5 THEN 'Very low confidence' WHEN conf < 0.7 THEN 'Low confidence' END, CASE WHEN NOT valid THEN 'Not in bib set' END, CASE WHEN n % 5 = 0 THEN 'Auto-corrected x' || bib || '->' || bib END, CASE WHEN n % 2 = 0 THEN 'Unstable across frames' END) AS why FROM i),
    k AS (SELECT * FROM r ORDER BY n DESC, bib DESC LIMIT 100)
    SELECT 'review_' || (row_number() OVER (ORDER BY n, bib) + greatest((SELECT count(*) FROM r) - 100, 0)) AS id, bib, conf, n AS frame_number, coalesce(list_aggregate(a, 'string_agg', ','), '') AS alternatives,
    CASE WHEN n % 4 = 0 THEN 'asked for' WHEN why = '' THEN 'Needs verification' ELSE why END AS reason FROM k""".replace("ALT", _ALTERNATIVES)
)
def rq_add(s, d):
    """The newest hundred predictions in the queue, with the registered numbers that are one digit longer and a reason."""
    p, r = W.predictions(s, d), W.registry(s, d)
    best = REG.leading(p, r).unionByName(REG.trailing(p, r)).groupBy("pred", "bib").agg(F.max("score").alias("score"))
    others = best.groupBy(F.col("pred").alias("p")).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "bib")))["bib"], 1, 3).alias("alternatives"))
    rows = REG.flagged(p, r, "pred").join(others, F.col("pred") == F.col("p"), "left")
    n, conf = F.col("pred").cast("long"), (F.lit(30) + F.col("pred").cast("long") % 70).cast("double") / 100.0
    items = rows.select(F.col("pred").alias("bib"), conf.alias("conf"), n.alias("frame_number"), T.level(conf).alias("level"), "is_valid", (n % 5 == 0).alias("is_corrected"), F.concat(F.lit("x"), "pred").alias("original"), (n % 2 == 1).alias("is_stable"), "alternatives", F.when(n % 4 == 0, "asked for").alias("reason"))
    return RV.added(items).withColumn("alternatives", F.array_join("alternatives", ","))


@query("SELECT det_id % 2 = 0 AS big, (x1 + w - x1) >= 40 AND h >= 15 AND w / h BETWEEN 1 AND 6 AND det_id % 200 >= 50 AND det_id % 90 >= 20 AND (det_id % 10) / 10.0 >= 0.5 AND (det_id % 9) / 10.0 >= 0.3 AS ok, count(*) AS n FROM det GROUP BY 1, 2")
def quality_bool(s, d):
    """How many crops pass all gates."""
    n, as_double = F.col("det_id"), lambda c: c.cast("double")
    why = Q.reason(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), as_double(n % 200), as_double(n % 90), as_double(n % 10) / 10, as_double(n % 9) / 10)
    return W.detections(s, d).groupBy((n % 2 == 0).alias("big"), Q.accepts(why).alias("ok")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH r AS (SELECT run_id, frame_idx, conf, frame_idx > coalesce(max(CASE WHEN frame_idx % 1000 = 0 THEN frame_idx END) OVER (PARTITION BY run_id), -1) AS since FROM reads)
    SELECT run_id, count(*) FILTER (since) AS total, count(*) FILTER (since AND conf >= 0.85) AS fast_only, count(*) FILTER (since AND conf < 0.85) AS used_slow,
    round(100.0::DOUBLE * count(*) FILTER (since AND conf >= 0.85) / greatest(count(*) FILTER (since), 1), 6) AS fast_only_pct, round(100.0::DOUBLE * count(*) FILTER (since AND conf < 0.85) / greatest(count(*) FILTER (since), 1), 6) AS used_slow_pct FROM r GROUP BY 1"""
)
def stats_reset(s, d):
    """The cascade's counts of each run since its last reset, at a frame that is a multiple of 1000."""
    r = W.reads(s, d)
    out = Q.cascade_totals(r.withColumn("model", F.when(F.col("conf") < 0.85, "slow").otherwise("fast")), r.where("frame_idx % 1000 = 0"))
    return out.withColumns({c: F.round(c, 6) for c in ("fast_only_pct", "used_slow_pct")})


@query(
    """WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey || ',x,1,2' WHEN o_orderkey % 7 = 0 THEN '1,2,3' ELSE o_custkey || ',0.5,' || o_orderkey || ',-1' END AS a, CASE o_orderkey % 3 WHEN 0 THEN o_custkey || '-' || o_orderkey WHEN 1 THEN CAST(o_custkey AS VARCHAR) ELSE o_custkey || '-x' END AS b FROM orders)
    SELECT o_orderkey, TRY_CAST(split_part(a, ',', 1) AS DOUBLE) AS x1, TRY_CAST(split_part(a, ',', 3) AS DOUBLE) AS x2, CASE WHEN o_orderkey % 3 = 0 THEN TRY_CAST(split_part(b, '-', 1) AS BIGINT) END AS first, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS last FROM t WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0
    UNION ALL SELECT o_orderkey, NULL, NULL, CASE WHEN o_orderkey % 3 = 0 THEN TRY_CAST(split_part(b, '-', 1) AS BIGINT) END, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END FROM t WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0"""
)
def fn_parse(s, d):
    """Lines and ranges of numbers from texts, null where the text isn't one."""
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    a = F.when(F.col("o_orderkey") % 5 == 0, F.concat(k, F.lit(",x,1,2"))).when(F.col("o_orderkey") % 7 == 0, "1,2,3").otherwise(F.concat(c, F.lit(",0.5,"), k, F.lit(",-1")))
    b = F.when(F.col("o_orderkey") % 3 == 0, F.concat(c, F.lit("-"), k)).when(F.col("o_orderkey") % 3 == 1, c).otherwise(F.concat(c, F.lit("-x")))
    rows = W.table(s, d, "orders").select("o_orderkey", T.line_of(a).alias("line"), T.range_of(b).alias("range"))
    return rows.select("o_orderkey", "line.x1", "line.x2", "range.first", "range.last")


# --- crops ----------------------------------------------------------------------------------------


def _crops(s, d):
    """doc_id, pixels: the bytes of each whole document as a grey crop, 40 wide, the last row filled up with spaces."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    pixels = F.rpad(text, (F.ceil(F.length(text) / 40) * 40).cast("int"), F.lit(" ").cast("binary"))
    return W.table(s, d, "documents").select("doc_id", pixels.alias("pixels"))


@query()
def fn_equalise(s, d):
    """Local contrast of every document as a crop, by its digest and statistics."""
    out = _crops(s, d).select("doc_id", IM.mapped("pixels", F.lit(40), IM.equalised).alias("c"))
    return out.select("doc_id", F.sha2("c.pixels", 256).alias("sha256"), Q.crop_stats("c.pixels", "c.width").alias("s")).select("doc_id", "sha256", F.round("s.contrast", 6).alias("contrast"))


@query()
def fn_upscale(s, d):
    """Crops of small documents made 64 pixels high, larger ones as they are."""
    out = _crops(s, d).select("doc_id", IM.mapped("pixels", F.lit(40), IM.upscaled).alias("c"))
    return out.select("doc_id", "c.width", (F.length("c.pixels") / F.col("c.width")).cast("long").alias("height"), F.sha2("c.pixels", 256).alias("sha256"))


@query()
def ds_synth(s, d):
    """A made crop of every customer's number, with its digest and the statistics that the quality gates read."""
    # a small file is one task's, but its crops are much work
    rows = W.table(s, d, "customer").select("c_custkey").repartition(int(s.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    made = rows.select("c_custkey", IM.synthetic(F.col("c_custkey").cast("string"), "c_custkey").alias("c"))
    out = made.select("c_custkey", F.sha2("c.pixels", 256).alias("sha256"), Q.crop_stats("c.pixels", "c.width").alias("s"))
    return out.select("c_custkey", "sha256", *[F.round(f"s.{c}", 6).alias(c) for c in Q.STATS])


# --- the whole run --------------------------------------------------------------------------------


@query("SELECT c_mktsegment AS run_id, p + 1 AS sequence, 20 * p + 33 AS frame_idx, CAST(c_custkey + 1000 AS VARCHAR) AS bib, 600 + 12.0::DOUBLE * 33 AS x, 'pose' AS source FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS p FROM customer)")
def run_line(s, d):
    """Crossings of whole races, from detections, reads and persons to numbered events: all customers, in order, with their numbers."""
    out = pipeline.run(*W.race(s, d), Config())
    return out.crossings.select("run_id", "sequence", "frame_idx", "bib", "x", "source")


@query("SELECT c_mktsegment AS run_id, p + 1 AS sequence, CAST(c_custkey + 1000 AS VARCHAR) AS bib FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS p FROM customer)")
def run_zone(s, d):
    """The same races in zone mode."""
    return pipeline.run(*W.race(s, d), Config(mode="zone")).crossings.select("run_id", "sequence", "bib")


# --- streams with state of their own --------------------------------------------------------------


@query()
def st_tracker(s, d):
    """The centroid tracker as a stream of all events as detections, slice by slice of time."""
    o = W.events(s, d)
    x, y = F.col("value"), F.col("k").cast("double")
    det = o.select(F.col("event_type").alias("run_id"), F.col("event_id").alias("frame_idx"), (x - 20).alias("x1"), (y - 10).alias("y1"), (x + 20).alias("x2"), (y + 10).alias("y2"))
    return ST.replayed(ST.slices(det, 3), lambda r: ST.tracked(ST.timed(r, "0 seconds", 1.0), 30, 60.0, 1.0), TR.TRACKED)[0].select("run_id", "frame_idx", "track_id", "matched")


_LIFE = """WITH g AS (SELECT track_id, frame_idx, CASE WHEN frame_idx % 3 = 0 THEN number END AS bib, CASE WHEN frame_idx - lag(frame_idx) OVER (PARTITION BY track_id ORDER BY frame_idx) <= 300 THEN 0 ELSE 1 END AS fresh FROM reads),
l AS (SELECT *, sum(fresh) OVER (PARTITION BY track_id ORDER BY frame_idx) AS life FROM g), z AS (SELECT *, row_number() OVER (PARTITION BY track_id, life ORDER BY frame_idx) AS n FROM l),
k AS (SELECT track_id, life, min(CASE WHEN n >= 5 AND bib IS NOT NULL THEN frame_idx END) AS known, max(frame_idx) AS last, count(*) AS n FROM z GROUP BY 1, 2)
SELECT k.track_id, coalesce(k.known, k.last + 301) AS frame_idx, coalesce(z.bib, 'UNKNOWN') AS bib FROM k LEFT JOIN z ON z.track_id = k.track_id AND z.frame_idx = k.known
WHERE k.known IS NOT NULL OR (k.n >= 5 AND k.last + 300 < (SELECT max(frame_idx) FROM reads))"""


@query(_LIFE)
def st_zone_stream(s, d):
    """Zone mode as a stream: timers emit and forget a track 300 frames after its last read; each life of a track is a track."""
    w = Window.partitionBy("track_id").orderBy("frame_idx")
    fresh = F.when(F.col("frame_idx") - F.lag("frame_idx").over(w) <= 300, 0).otherwise(1)
    r = W.reads(s, d).withColumn("fresh", fresh).withColumn("life", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = r.select("track_id", "life", "frame_idx", F.when(F.col("frame_idx") % 3 == 0, F.col("number")).alias("bib"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    out, _ = ST.replayed(ST.slices(rows, 3), lambda b: ST.zone(ST.timed(b, "0 seconds", 1.0), 5, 300, 1.0, ("track_id", "life")), "track_id bigint, life bigint, frame_idx bigint, bib string, x double, y double")
    return out.select("track_id", "frame_idx", "bib")


@query()
def st_assoc(s, d):
    """The association as a stream of persons and read numbers."""
    p = W.persons(s, d).withColumns({"kind": F.lit("person"), "number": F.lit(None).cast("string"), "level": F.lit(None).cast("string")})
    b = W.bibs(s, d).join(W.readings(s, d).select(F.col("bib").alias("b"), "number", "level"), F.col("id") == F.col("b")).drop("b").withColumn("kind", F.lit("bib"))
    rows = p.unionByName(b).withColumn("run_id", F.lit("run0"))
    out, _ = ST.replayed(ST.slices(rows, 3), lambda r: ST.associated(ST.timed(r, "0 seconds", 1.0), 150.0, fps=1.0), "run_id string, frame_idx bigint, person bigint, number string, confidence double")
    return out.select("frame_idx", "person", "number", F.round("confidence", 6).alias("confidence"))


@query("SELECT run_id, track_id, max_by(number, frame_idx) AS number, max(frame_idx) AS last_frame, max(frame_idx) >= (SELECT max(frame_idx) FROM reads) - 300 AS live FROM reads GROUP BY 1, 2")
def st_consensus_ttl_stream(s, d):
    """What a stream of all reads leaves in its log of every track, with those still in its state after the last read."""
    rows = W.reads(s, d).select("run_id", "track_id", "frame_idx", "number")
    out, _ = ST.replayed(ST.slices(rows, 3), lambda r: ST.remembered(ST.timed(r, "0 seconds", 1.0), 300, 1.0), "run_id string, track_id bigint, number string, last_frame bigint, live boolean")
    return ST.all_time(out)


@query()
def st_crossing_stream(s, d):
    """Crossings of a stream of all observations, with each track's side and last firing as state."""
    o = W.observations(s, d).select("track_id", "frame_idx", "x", "y")
    return ST.replayed(ST.slices(o, 3), lambda r: jobs.crossings(r, W.LINE, 3, 1500), "track_id bigint, frame_idx bigint")[0]


SQL["st_crossing_stream"] = SQL["win_debounce"]


@query(f"WITH {_CONS} SELECT track_id, frame_idx, winner, round(confidence, 6) AS confidence, is_stable FROM consensus")
def st_vote_stream(s, d):
    """The consensus after each read of a stream, with a track's last fifteen votes as state."""
    r = W.reads(s, d).select("track_id", "frame_idx", "number", "conf")
    out, _ = ST.replayed(ST.slices(r, 3), lambda b: jobs.votes(b, stable=2), "track_id bigint, frame_idx bigint, winner string, confidence double, is_stable boolean")
    return out.withColumn("confidence", F.round("confidence", 6))


@query()
def st_dedup_stream(s, d):
    """The emissions of a stream that are new, with each number's emissions so far as state."""
    return ST.replayed(ST.slices(W.emissions(s, d), 3), lambda r: jobs.deduplicated(r, 300, 5.0), "bib string, frame_idx bigint, conf double, track_id bigint")[0]


SQL["st_dedup_stream"] = f"SELECT bib, frame_idx, conf, track_id FROM ({SQL['st_dedup']}) WHERE emitted"
