"""The review queue, corrections and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raceflow.functions import text as T


def queue(items: DataFrame, keep: int = 100) -> DataFrame:
    """The newest `keep` items (bib, confidence, frame_number, ...), with ids review_1, review_2, ... by frame."""
    last = items.orderBy(F.desc("frame_number"), F.desc("bib")).limit(keep)
    total = items.agg(F.count(F.lit(1)).alias("total"))
    place = F.row_number().over(Window.orderBy("frame_number", "bib")) + F.greatest(F.col("total") - keep, F.lit(0))
    return last.join(F.broadcast(total)).withColumn("id", F.concat(F.lit("review_"), place)).drop("total")


def added(items: DataFrame, keep: int = 100) -> DataFrame:
    """The queue of items (bib, conf, frame_number, level, is_valid, is_corrected, original, is_stable, alternatives, reason): id, bib, conf, frame_number, alternatives, reason.

    An item without a reason of its own gets the one that its reading gives; without alternatives it has none (an empty list).
    """
    why = T.review_reason(F.col("level"), F.col("is_valid"), F.col("is_corrected"), F.col("original"), F.col("bib"), F.col("is_stable"))
    rows = items.withColumn("reason", F.when(F.coalesce("reason", F.lit("")) != "", F.col("reason")).otherwise(why))
    rows = rows.withColumn("alternatives", F.coalesce("alternatives", F.array().cast("array<string>")))
    return queue(rows.select("bib", "conf", "frame_number", "alternatives", "reason"), keep)


def resolved(items: DataFrame, done: DataFrame) -> DataFrame:
    """The items without those whose id is resolved."""
    return items.join(done.select("id").distinct(), "id", "left_anti")


def pending(items: DataFrame, status: str = "status") -> DataFrame:
    return items.where(F.coalesce(F.col(status), F.lit("pending")) == "pending")


def next_pending(items: DataFrame, after: int) -> DataFrame:
    """The next pending item behind an index, from the start again at the end."""
    return pending(items).orderBy(F.when(F.col("idx") > after, 0).otherwise(1), "idx").limit(1)


def latest_review(reviews: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return reviews.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def corrected(crossings: DataFrame, corrections: DataFrame, key: str = "sequence") -> DataFrame:
    """crossings with corrections (key, action, corrected_bib) applied: a rejected row goes, a corrected one gets its number."""
    c = corrections.select(F.col(key).cast("string").alias("__key"), "action", "corrected_bib").dropDuplicates(["__key"])
    out = crossings.join(c, F.col(key).cast("string") == F.col("__key"), "left").where(F.coalesce(F.col("action"), F.lit("")) != "reject")
    return out.withColumn("bib", F.when(F.col("action") == "correct", F.coalesce("corrected_bib", "bib")).otherwise(F.col("bib"))).drop("__key", "action", "corrected_bib")


def summary(items: DataFrame, status: str = "status") -> DataFrame:
    """verified, rejected, pending, total, rate."""
    one = lambda s: F.count_if(F.coalesce(F.col(status), F.lit("pending")) == s)
    return items.agg(one("verified").alias("verified"), one("rejected").alias("rejected"), one("pending").alias("pending"), F.count(F.lit(1)).alias("total")).withColumn("rate", F.col("verified") / F.greatest(F.col("total"), F.lit(1)))


def tagged(results: DataFrame, photos: DataFrame) -> DataFrame:
    """results (image_id, ocr) and verified: whether the number is one of the photo's tags (bibs)."""
    p = photos.select(F.col("image_id").alias("__i"), "bibs")
    out = results.join(p, F.col("image_id") == F.col("__i"), "left").drop("__i")
    return out.withColumn("verified", F.coalesce(F.array_contains("bibs", F.col("ocr")), F.lit(False)))
