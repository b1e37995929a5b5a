"""Rows at least so far apart, without one task that walks all of them.

Each row knows the first row that lies at least the gap after it; which rows are kept is what is reached from the first one
by these links. Links are found in buckets as wide as the gap, and followed twice as far in each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raceflow import shared
from raceflow.operators.ordering import led


def links(frames: DataFrame, gap: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, frame_idx, to: the first frame at least `gap` after each of the distinct frames (keys, frame_idx), where there is one.

    It lies in the next bucket, or is the first frame of the bucket after that one, empty buckets left out.
    """
    rows = frames.withColumn("slot", F.floor(F.col("frame_idx") / gap))
    slots = rows.groupBy(*keys, "slot").agg(F.min("frame_idx").alias("first"))
    slots = shared.written(led(led(slots, {"after": "first", "after_slot": "slot"}, keys, "slot"), {"second": "after"}, keys, "slot"), "slots")
    asked = rows.select(*keys, (F.col("slot") + 1).alias("slot"), (F.col("frame_idx") + gap).alias("at"), "frame_idx")
    there = rows.select(*keys, "slot", F.col("frame_idx").alias("at"), F.lit(None).cast("long").alias("frame_idx"))
    later = Window.partitionBy(*keys, "slot").orderBy(F.col("at").desc()).rangeBetween(Window.unboundedPreceding, 0)
    near = asked.unionByName(there).withColumn("near", F.min(F.when(F.col("frame_idx").isNull(), F.col("at"))).over(later)).where("frame_idx is not null")
    beyond = slots.select(*keys, (F.col("slot") + 1).alias("slot"), F.when(F.col("after_slot") == F.col("slot") + 1, F.col("second")).otherwise(F.col("after")).alias("beyond"))
    out = near.join(beyond, [*keys, "slot"], "left").select(*keys, "frame_idx", F.coalesce("near", "beyond").alias("to"))
    return out.where("to is not null")


def kept(rows: DataFrame, gap: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, frame_idx of the frames kept when each must be at least `gap` after the one kept before, from the first on; null frames count for nothing."""
    if gap < 1:
        raise ValueError("frames are kept at least 1 apart")
    frames = shared.written(rows.where("frame_idx is not null").select(*keys, F.col("frame_idx").cast("long").alias("frame_idx")).distinct(), "frames")
    found = frames.groupBy(*keys).agg(F.min("frame_idx").alias("frame_idx")).where("frame_idx is not null")
    jump = shared.written(links(frames, gap, keys), "links")
    on = [*keys, "frame_idx"]
    while not jump.isEmpty():
        found = shared.written(found.unionByName(found.join(jump, on).drop("frame_idx").withColumnRenamed("to", "frame_idx")), "kept")
        then = jump.select(*keys, F.col("frame_idx").alias("to"), F.col("to").alias("then"))
        jump = shared.written(jump.join(then, [*keys, "to"]).select(*keys, "frame_idx", F.col("then").alias("to")), "links")
    return found
