"""The observation tables that the library's queries read, made from the star-schema tables; WITH holds the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from raceflow.config import Line
from raceflow.shipping import ship

#: The timing line of the observation view.
LINE = Line(0.3459, 0.0, 0.3459, 1.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, track_id, frame_idx, number, conf."""
    return events(spark, sf_dir).select(
        F.col("event_type").alias("run_id"), F.col("user_id").alias("track_id"), F.col("event_id").alias("frame_idx"),
        (F.lit(1000) + F.col("k") % 5).cast("string").alias("number"), ((F.lit(30) + F.col("event_id") % 70).cast("double") / 100.0).alias("conf"),
    )


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, track_id, frame_idx, number, conf, x, y: reads of many numbers, with their places."""
    number = (F.lit(1) + (F.col("k") * 37 + F.col("user_id")) % 140).cast("string")
    return events(spark, sf_dir).select(
        F.col("event_type").alias("run_id"), F.col("user_id").alias("track_id"), F.col("event_id").alias("frame_idx"), number.alias("number"),
        ((F.lit(30) + F.col("event_id") % 70).cast("double") / 100.0).alias("conf"), F.col("value").alias("x"), F.col("k").cast("double").alias("y"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, track_id, frame_idx, x, y."""
    return events(spark, sf_dir).select(F.col("event_type").alias("run_id"), F.col("user_id").alias("track_id"), F.col("event_id").alias("frame_idx"), (F.col("value") / 100.0).alias("x"), (F.col("k").cast("double") / 100.0).alias("y"))


def race(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """detections, reads, people and registry of races in which every customer of a market segment runs across the line, 20 frames after the one before, in one of three lanes, with a readable number."""
    place = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("c_custkey")) - 1
    runners = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("run_id"), place.alias("place"), (F.col("c_custkey") + 1000).cast("string").alias("raw"))
    t = F.col("t").cast("double")
    rows = runners.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(59)))).select("run_id", (F.col("place") * 20 + F.col("t")).cast("long").alias("frame_idx"), "raw", (t * 12 + 600).alias("x"), (F.col("place") % 3 * 250 + 250).cast("double").alias("y"))
    box = lambda left, top, right, bottom: [(F.col("x") - left).alias("x1"), (F.col("y") - top).alias("y1"), (F.col("x") + right).alias("x2"), (F.col("y") + bottom).alias("y2")]
    plates = rows.select("run_id", "frame_idx", *box(30, 20, 30, 20), "raw", F.lit(0.9).alias("conf"))
    people = rows.select("run_id", "frame_idx", *box(60, 100, 60, 140), F.col("x").alias("cx"), F.col("y").alias("cy"))
    return plates.drop("raw").withColumnRenamed("conf", "confidence"), plates, people, runners.select(F.col("raw").alias("bib"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("bib"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("pred")).distinct()


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select((F.col("o_orderkey") % 1500).cast("string").alias("gt"), F.col("o_custkey").cast("string").alias("pred"), F.col("o_orderpriority").alias("event"), (F.col("o_orderkey") % 97 + F.col("o_custkey") % 13).cast("double").alias("ms"))


def emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_type = 'purchase'").select(
        (F.lit(1000) + F.col("k") % 5).cast("string").alias("bib"), F.col("event_id").alias("frame_idx"), ((F.lit(30) + F.col("event_id") % 70).cast("double") / 100.0).alias("conf"),
        F.col("user_id").alias("track_id"), F.col("value").alias("x"), F.col("k").cast("double").alias("y"),
    )


def _boxes(spark: SparkSession, sf_dir: str, parity: int, half: float) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 2 == parity)
    cx, cy = F.get("embedding", F.lit(0)).cast("double") * 1000.0, F.get("embedding", F.lit(1)).cast("double") * 1000.0
    return e.select(F.col("label").cast("long").alias("frame_idx"), F.col("vec_id").alias("id"), cx.alias("cx"), cy.alias("cy"), (cx - half).alias("x1"), (cy - half).alias("y1"), (cx + half).alias("x2"), (cy + half).alias("y2"))


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir, 0, 40.0)


def bibs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir, 1, 15.0)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bib, number, conf, level of each bib track."""
    n = F.col("vec_id")
    level = F.when(n % 7 < 3, "high").when(n % 7 < 5, "medium").when(n % 7 < 6, "low").otherwise("reject")
    return table(spark, sf_dir, "embeddings").where("vec_id % 2 = 1").select(n.alias("bib"), (n % 40 + 100).cast("string").alias("number"), ((n % 50 + 50).cast("double") / 100.0).alias("conf"), level.alias("level"))


def lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_id, kind, first_frame, last_frame, first_x, first_y, last_x, last_y, n."""
    e = events(spark, sf_dir)
    at = lambda c, f: f(c, "event_id")
    return e.groupBy(F.col("user_id").alias("track_id"), F.col("event_type").alias("kind")).agg(
        F.min("event_id").alias("first_frame"), F.max("event_id").alias("last_frame"), at("value", F.min_by).alias("first_x"), at("k", F.min_by).cast("double").alias("first_y"),
        at("value", F.max_by).alias("last_x"), at("k", F.max_by).cast("double").alias("last_y"), F.count(F.lit(1)).alias("n"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, frame_idx, det_id, x1, y1, x2, y2, confidence, raw: line items as plate detections in a 1920 x 1080 frame."""
    li = table(spark, sf_dir, "lineitem")
    x1, y1 = (F.col("l_quantity") * 36).cast("int"), (F.col("l_partkey") % 1000).cast("int")
    w, h = (F.col("l_suppkey") % 90 + 10).cast("int"), (F.col("l_linenumber") * 8 + 5).cast("int")
    return li.select(
        F.col("l_returnflag").alias("run_id"), F.col("l_orderkey").alias("frame_idx"), F.col("l_partkey").alias("det_id"), x1.alias("x1"), y1.alias("y1"), (x1 + w).alias("x2"), (y1 + h).alias("y2"),
        (F.col("l_discount") * 10).alias("confidence"), F.concat(F.lit("O"), F.col("l_partkey").cast("string"), F.lit("b")).alias("raw"),
    )


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("id"), F.col("l_quantity").cast("double").alias("x"), (F.col("l_discount") * 100).cast("double").alias("y"), (F.col("l_tax") * 100).cast("double").alias("w"), F.col("l_linenumber").cast("double").alias("h"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("image_id"), F.concat(F.lit("img_"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("file_name"), F.lit(100.0).alias("width"), F.lit(50.0).alias("height"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("event"), F.length(F.col("doc_id").cast("string")).alias("digit_count"))


def review_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sequence, bib, status, action, corrected_bib: documents as queued items, labels as what reviewers did."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sequence"), (F.col("n_chars") % 1000).cast("string").alias("bib"))
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("d"), "quality", "toxic")
    out = d.join(lab, F.col("sequence") == F.col("d"), "left")
    return out.select("sequence", "bib", F.when(F.col("quality") == 1, "verified").when(F.col("quality") == 0, "rejected").alias("status"), F.when(F.col("quality") == 0, "reject").when(F.col("toxic") == 1, "correct").when(F.col("d").isNotNull(), "confirm").alias("action"), F.when(F.col("toxic") == 1, F.concat(F.lit("9"), "bib")).alias("corrected_bib"))


WITH = """WITH RECURSIVE ev AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
reads AS (SELECT event_type AS run_id, user_id AS track_id, event_id AS frame_idx, CAST(1000 + k % 5 AS VARCHAR) AS number, CAST(30 + event_id % 70 AS DOUBLE) / 100.0::DOUBLE AS conf FROM ev),
sight AS (SELECT event_type AS run_id, user_id AS track_id, event_id AS frame_idx, CAST(1 + (k * 37 + user_id) % 140 AS VARCHAR) AS number, CAST(30 + event_id % 70 AS DOUBLE) / 100.0::DOUBLE AS conf, value AS x, CAST(k AS DOUBLE) AS y FROM ev),
obs AS (SELECT event_type AS run_id, user_id AS track_id, event_id AS frame_idx, value / 100.0::DOUBLE AS x, CAST(k AS DOUBLE) / 100.0::DOUBLE AS y FROM ev),
registry AS (SELECT CAST(c_custkey AS VARCHAR) AS bib FROM customer WHERE c_custkey % 3 = 0),
preds AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS pred FROM orders),
truth AS (SELECT CAST(o_orderkey % 1500 AS VARCHAR) AS gt, CAST(o_custkey AS VARCHAR) AS pred, o_orderpriority AS event, CAST(o_orderkey % 97 + o_custkey % 13 AS DOUBLE) AS ms FROM orders),
emissions AS (SELECT CAST(1000 + k % 5 AS VARCHAR) AS bib, event_id AS frame_idx, CAST(30 + event_id % 70 AS DOUBLE) / 100.0::DOUBLE AS conf, user_id AS track_id, value AS x, CAST(k AS DOUBLE) AS y FROM ev WHERE event_type = 'purchase'),
box AS (SELECT CAST(label AS BIGINT) AS frame_idx, vec_id AS id, CAST(embedding[1] AS DOUBLE) * 1000.0::DOUBLE AS cx, CAST(embedding[2] AS DOUBLE) * 1000.0::DOUBLE AS cy FROM embeddings),
persons AS (SELECT *, cx - 40.0::DOUBLE AS x1, cy - 40.0::DOUBLE AS y1, cx + 40.0::DOUBLE AS x2, cy + 40.0::DOUBLE AS y2 FROM box WHERE id % 2 = 0),
bibs AS (SELECT *, cx - 15.0::DOUBLE AS x1, cy - 15.0::DOUBLE AS y1, cx + 15.0::DOUBLE AS x2, cy + 15.0::DOUBLE AS y2 FROM box WHERE id % 2 = 1),
readings AS (SELECT vec_id AS bib, CAST(vec_id % 40 + 100 AS VARCHAR) AS number, CAST(vec_id % 50 + 50 AS DOUBLE) / 100.0::DOUBLE AS conf,
  CASE WHEN vec_id % 7 < 3 THEN 'high' WHEN vec_id % 7 < 5 THEN 'medium' WHEN vec_id % 7 < 6 THEN 'low' ELSE 'reject' END AS level FROM embeddings WHERE vec_id % 2 = 1),
lifetimes AS (SELECT user_id AS track_id, event_type AS kind, min(event_id) AS first_frame, max(event_id) AS last_frame, min_by(value, event_id) AS first_x, CAST(min_by(k, event_id) AS DOUBLE) AS first_y,
  max_by(value, event_id) AS last_x, CAST(max_by(k, event_id) AS DOUBLE) AS last_y, count(*) AS n FROM ev GROUP BY 1, 2),
det AS (SELECT l_returnflag AS run_id, l_orderkey AS frame_idx, l_partkey AS det_id, CAST(l_quantity * 36 AS INT) AS x1, CAST(l_partkey % 1000 AS INT) AS y1, CAST(l_suppkey % 90 + 10 AS INT) AS w, CAST(l_linenumber * 8 + 5 AS INT) AS h,
  l_discount * 10 AS confidence, 'O' || CAST(l_partkey AS VARCHAR) || 'b' AS raw FROM lineitem),
ann AS (SELECT l_orderkey AS image_id, l_linenumber AS id, CAST(l_quantity AS DOUBLE) AS x, CAST(l_discount * 100 AS DOUBLE) AS y, CAST(l_tax * 100 AS DOUBLE) AS w, CAST(l_linenumber AS DOUBLE) AS h FROM lineitem),
images AS (SELECT o_orderkey AS image_id, 'img_' || CAST(o_orderkey AS VARCHAR) || '.jpg' AS file_name, 100.0::DOUBLE AS width, 50.0::DOUBLE AS height FROM orders WHERE o_orderkey % 2 = 0),
samples AS (SELECT doc_id, source AS event, length(CAST(doc_id AS VARCHAR)) AS digit_count FROM documents),
items AS (SELECT d.doc_id AS sequence, CAST(d.n_chars % 1000 AS VARCHAR) AS bib, CASE WHEN l.quality = 1 THEN 'verified' WHEN l.quality = 0 THEN 'rejected' END AS status,
  CASE WHEN l.quality = 0 THEN 'reject' WHEN l.toxic = 1 THEN 'correct' WHEN l.doc_id IS NOT NULL THEN 'confirm' END AS action,
  CASE WHEN l.toxic = 1 THEN '9' || CAST(d.n_chars % 1000 AS VARCHAR) END AS corrected_bib FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""
