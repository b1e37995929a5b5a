"""Mixing sources to target weights along a time-varying curriculum.

Each source gets a target of words (weights, a cap at a multiple of the source, the
excess reshared until no target is above its cap) and a schedule: its weight as a
piecewise linear function of training time 0..1. The schedule's integral, scaled to
the target, is the source's cumulative demand; a document's place in its source's
running word count is sent through the inverse of that function, which gives its
training position. Documents are then sorted by position over ranges.

The running count of a source is summed in two levels: over hashed buckets of the
source, then inside each bucket, so that a source with a third of all rows is never
one task. The order in a source is by md5 of doc_id, so that reruns agree.

A document is taken once for each pass (at most `most` passes) in which its middle
word lies within the target. Null text has size 0 and is never taken; a null source
is a source of its own, last in order; rows repeated with one doc_id are counted and
placed one after the other (each row is taken by its own place), and so are rows
without a doc_id; no words at all give targets 0; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from raceflow.llm import common as C

WEIGHTS = (3, 1, 2)
#: Weight over training time as (time, weight) knots; repeats along the sources as WEIGHTS does.
SCHEDULES = (
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (1.0, 1.5)),
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
)
SHARE, MOST = 1.5, 2
#: Hashed buckets of each source: the rows of one task are a source's rows over this.
BUCKETS = 4096


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in C.slices(batches, "text"):
        size = pa.array([len(x.split()) for x in C.texts(b.column("text"))], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(C.ROW), b.column("doc_id"), b.column("source"), size], [C.ROW, "doc_id", "source", "size"])


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with a long column of 0-based places in the given order (nulls last), by range-sorted partitions and their counts."""
    keys = [F.col(c).asc_nulls_last() for c in order]
    parts = C.written(df.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()), "ranges")
    counts, offsets, below = dict(parts.groupBy("__part").count().collect()), [], 0
    for part in sorted(counts):
        offsets.append((part, below))
        below += counts[part]
    offset = F.broadcast(df.sparkSession.createDataFrame(offsets, "__part int, __offset long"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*keys)) - 1
    return parts.join(offset, "__part").withColumn(name, F.col("__offset") + place).drop("__part", "__offset")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds place, weight and target to one row for each source (source, source_size)."""
    rows = numbered(sources, "place", "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    rows = C.written(rows.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most), "sources")
    want = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    level, filled = None, F.lit(False)
    while True:
        caps, free = rows.agg(F.sum(F.when(filled, F.col("cap"))), F.sum(F.when(~filled, F.col("weight")))).first()
        new = (want - (caps or 0)) / free if free else float("inf")
        if new == level or not free:
            break
        level, filled = new, F.col("weight") * F.lit(new) > F.col("cap")
    over = F.lit(level if level is not None else 0.0)
    return rows.withColumn("target", F.when(filled, F.col("cap").cast("double")).otherwise(F.col("weight") * over))


def inverse(knots: Sequence[tuple[float, float]], u: Column) -> Column:
    """The time by which the share u of the area under the piecewise linear weight has passed."""
    pieces, area = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        pieces.append((area, t0, t1, w0, w1))
        area += (w0 + w1) / 2 * (t1 - t0)
    out = None
    for start, t0, t1, w0, w1 in reversed(pieces):
        rest, slope = u * area - start, (w1 - w0) / (t1 - t0)
        if slope:
            here = t0 + (F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0))) - w0) / slope
        else:
            here = t0 + rest / w0
        out = here if out is None else F.when(u * area < start + (w0 + w1) / 2 * (t1 - t0), here).otherwise(out)
    return F.least(F.greatest(out, F.lit(knots[0][0])), F.lit(knots[-1][0]))


def _mixed(rows: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, share: float = SHARE, most: int = MOST, buckets: int = BUCKETS) -> DataFrame:
    """The key, doc_id, size, source_size, target, taken, positions of every row (key, doc_id, text, source)."""
    rows = rows.mapInArrow(C.tidy(_sizes), f"{C.ROW} long, doc_id long, source string, size long")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = rows.withColumn("key", key).withColumn("bucket", (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / 4294967296).cast("long"))
    rows = C.written(rows, "sizes")
    by_bucket = C.written(rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "buckets")
    sources = by_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    plan = targets(sources, weights, share, most).select(F.col("source").alias("s"), "place", "source_size", "target")
    up_to = Window.partitionBy("source").orderBy("bucket")
    starts = by_bucket.withColumn("bucket_start", F.sum("bucket_size").over(up_to) - F.col("bucket_size"))
    starts = starts.join(plan, F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "bucket_start", "place", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", C.ROW).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("within", F.sum("size").over(inside) - F.col("size"))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    before, places = F.col("bucket_start") + F.col("within"), []
    for k in range(most):
        middle = before + k * F.col("source_size") + F.col("size") / 2
        u, at = middle / F.when(F.col("target") > 0, F.col("target")), None
        for i, knots in enumerate(schedules):
            at = F.when(F.col("place") % len(schedules) == i, inverse(knots, u)) if at is None else at.when(F.col("place") % len(schedules) == i, inverse(knots, u))
        places.append(F.when((F.col("size") > 0) & (middle <= F.col("target")), at))
    rows = rows.withColumn("positions", F.filter(F.array(*places), lambda x: x.isNotNull()))
    return rows.select(C.ROW, "doc_id", "size", "source_size", "target", (F.col("size") * F.size("positions")).alias("taken"), "positions")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, positions (one for each time the document is taken) of every row."""
    return _mixed(C.Rows(C.only(docs, "doc_id", "text", "source")).only("doc_id", "text", "source"), **options).drop(C.ROW)


#: The column that training_order adds.
POSITION = "position"


def training_order(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as training reads them: repeated for each time they are taken, sorted by position over ranges.

    The training position (0..1) follows the columns of docs as POSITION, so the order outlives a shuffle; a column of
    docs that has this name already gives way to it.
    """
    keyed = C.Rows(docs)
    plan = _mixed(keyed.only("doc_id", "text", "source"), **options).where("taken > 0").select(C.ROW, "positions")
    out = keyed.df.join(plan, C.ROW).withColumn("__position", F.explode("positions")).orderBy("__position", C.ROW)
    return keyed.back(out, "__position").select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != POSITION], F.col("__position").alias(POSITION))


def op2_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(C.read(spark, sf_dir, "documents")).withColumn("first_position", F.get("positions", F.lit(0)))
    return out.drop("positions").orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS place FROM s0),
s2 AS (SELECT *, (CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::BIGINT AS weight, 2 * source_size AS cap FROM s1),
s3 AS (SELECT *, sum(cap) OVER o - cap AS caps, sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free,
  1.5::DOUBLE * sum(source_size) OVER () AS want FROM s2 WINDOW o AS (ORDER BY cap / weight, place)),
l AS (SELECT max((want - caps::DOUBLE) / free::DOUBLE) AS level FROM s3 WHERE weight * ((want - caps::DOUBLE) / free::DOUBLE) <= cap),
p AS (SELECT s2.*, CASE WHEN weight * level > cap THEN cap::DOUBLE ELSE weight * level END AS target FROM s2, l),
e AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.place,
  (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
f AS (SELECT *, before + size / 2 AS middle FROM e),
g AS (SELECT *, middle / CASE WHEN target > 0 THEN target END AS u, CASE WHEN size > 0 THEN (middle <= target)::INT + (middle + source_size <= target)::INT ELSE 0 END AS times FROM f)
SELECT doc_id, size, source_size, target, (size * times)::BIGINT AS taken,
  CASE WHEN times > 0 THEN least(greatest(CASE place % 3 WHEN 0 THEN u WHEN 1 THEN (sqrt(0.25::DOUBLE + 2.0::DOUBLE * u) - 0.5::DOUBLE) / 1.0::DOUBLE
    ELSE CASE WHEN u * 1.0::DOUBLE < 0.625::DOUBLE THEN 0.0::DOUBLE + (sqrt(2.25::DOUBLE + -2.0::DOUBLE * u) - 1.5::DOUBLE) / -1.0::DOUBLE
      ELSE 0.5::DOUBLE + (sqrt(1.0::DOUBLE + -2.0::DOUBLE * (u - 0.625::DOUBLE)) - 1.0::DOUBLE) / -1.0::DOUBLE END END, 0.0::DOUBLE), 1.0::DOUBLE) END AS first_position
FROM g
"""
