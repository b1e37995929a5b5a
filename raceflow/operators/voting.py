"""Multi-frame consensus over reads (run_id?, track_id, frame_idx, number, conf) by windows; one shuffle on the track serves all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raceflow.operators.spacing import kept

TRACK = ("track_id",)
#: Decimals in which scores are compared, so that sums taken in another order don't part equal ones.
SCORE = 9


def _by(keys: tuple[str, ...]):
    return Window.partitionBy(*keys).orderBy("frame_idx")


def streaks(reads: DataFrame, keys: tuple[str, ...] = TRACK) -> DataFrame:
    """reads and streak: how many reads in a row, up to this one, have its number."""
    w = _by(keys)
    change = F.when(F.col("number") == F.lag("number").over(w), 0).otherwise(1)
    island = reads.withColumn("__change", change).withColumn("__island", F.sum("__change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy(*keys, "__island").orderBy("frame_idx"))
    return island.withColumn("streak", place).drop("__change", "__island")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value made once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _winner(votes: str, decay: float) -> Column:
    """score, first, number, n, conf_sum of the best number of an array of votes (n, c), the oldest first."""
    aged = F.transform(votes, lambda v, k: F.struct(v["n"].alias("n"), v["c"].alias("c"), k.alias("k"), (F.pow(F.lit(decay), F.size(votes) - 1 - k) * v["c"]).alias("s")))
    total = lambda own, field: F.aggregate(own, F.lit(None).cast("double"), lambda a, v: F.coalesce(a + v[field], a, v[field]))
    row = lambda own: F.struct(F.round(total(own, "s"), SCORE).alias("score"), (-own[0]["k"]).alias("first"), own[0]["n"].alias("number"), F.size(own).cast("long").alias("n"), total(own, "c").alias("conf_sum"))
    of = lambda a: lambda number: _let(F.filter(a, lambda v: v["n"].eqNullSafe(number)), row)
    return _let(aged, lambda a: F.array_max(F.transform(F.array_distinct(F.transform(a, lambda v: v["n"])), of(a))))


def consensus(reads: DataFrame, window: int = 15, decay: float = 0.9, min_votes: int = 1, stable: int = 5, review_below: float = 0.5, keys: tuple[str, ...] = TRACK) -> DataFrame:
    """reads with winner, votes, total, agreement, confidence, is_stable, needs_review after each read.

    The winner has the greatest sum of decay^age * conf over the last `window` reads; of equals, the number that is first
    in the window. The streak that makes it stable is not bound to the window. Under min_votes there is no winner.
    """
    last = _by(keys).rowsBetween(1 - window, 0)
    vote = F.struct(F.col("number").alias("n"), F.col("conf").cast("double").alias("c"))
    rows = streaks(reads, keys).withColumn("__votes", F.collect_list(vote).over(last))  # at most `window` of them; no row is ever multiplied
    names = [F.col(k) for k in keys], [F.col(c) for c in reads.columns if c not in keys]
    rows = rows.select(*names[0], *names[1], "streak", F.size("__votes").alias("__total"), _winner("__votes", decay).alias("__best"))
    total, best = F.col("__total"), F.col("__best")
    enough = total >= min_votes
    agreement = best["n"] / total
    confidence = 0.5 * agreement + 0.5 * best["conf_sum"] / best["n"]
    rows = rows.withColumn("winner", F.when(enough, best["number"]))
    rows = rows.withColumn("votes", F.when(enough, best["n"].cast("int")).otherwise(0)).withColumn("total", F.when(enough, total).otherwise(0))
    rows = rows.withColumn("agreement", F.when(enough, agreement).otherwise(0.0)).withColumn("confidence", F.when(enough, confidence).otherwise(0.0))
    rows = rows.withColumn("is_stable", enough & (F.col("number") == F.col("winner")) & (F.col("streak") >= stable))
    return rows.withColumn("needs_review", ~enough | (F.col("confidence") < review_below)).drop("__best", "__total")


def early(consensus_rows: DataFrame, agreement: float = 0.9, confidence: float = 0.85) -> DataFrame:
    return consensus_rows.where(F.col("winner").isNotNull() & (F.col("agreement") >= agreement) & (F.col("confidence") >= confidence))


def final(consensus_rows: DataFrame, keys: tuple[str, ...] = TRACK) -> DataFrame:
    """The last row of each track."""
    cols = [c for c in consensus_rows.columns if c not in keys]
    return consensus_rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), "frame_idx").alias("x")).select(*keys, *[F.col(f"x.{c}").alias(c) for c in cols])


def skip_cut(consensus_rows: DataFrame, conf: float = 0.85, valid: str | None = None, keys: tuple[str, ...] = TRACK) -> DataFrame:
    """The rows up to the first that is stable and sure (and, with `valid`, registered): later reads are never made."""
    done = F.col("is_stable") & (F.col("confidence") >= conf)
    done = done & F.col(valid) if valid else done
    first = F.min(F.when(done, F.col("frame_idx"))).over(Window.partitionBy(*keys))
    return consensus_rows.withColumn("__first", first).where(F.col("__first").isNull() | (F.col("frame_idx") <= F.col("__first"))).drop("__first")


def vote_mean_bonus(reads: DataFrame, keys: tuple[str, ...] = TRACK) -> DataFrame:
    """keys, number, confidence: the number of greatest mean conf * (1 + .1 n); of equals the least number."""
    per = reads.groupBy(*keys, "number").agg(F.avg("conf").alias("mean"), F.count(F.lit(1)).alias("n"))
    score = F.struct(F.round(F.col("mean") * (1 + 0.1 * F.col("n")), SCORE).alias("s"), (-F.col("number").cast("long")).alias("t"))
    return per.groupBy(*keys).agg(F.max_by(F.struct("number", "mean"), score).alias("x")).select(*keys, "x.number", F.col("x.mean").alias("confidence"))


def vote_sum(reads: DataFrame, keys: tuple[str, ...] = TRACK) -> DataFrame:
    """keys, number, confidence (mean): the number of greatest conf sum; of equals the least number."""
    per = reads.groupBy(*keys, "number").agg(F.avg("conf").alias("mean"), F.sum("conf").alias("total"))
    score = F.struct(F.round("total", SCORE).alias("s"), (-F.col("number").cast("long")).alias("t"))
    return per.groupBy(*keys).agg(F.max_by(F.struct("number", "mean"), score).alias("x")).select(*keys, "x.number", F.col("x.mean").alias("confidence"))


def cumulative_distinct(reads: DataFrame, key: str = "number", of: str = "track_id") -> DataFrame:
    """reads and so_far: distinct `of` values seen for the key up to this frame."""
    new = F.when(F.row_number().over(Window.partitionBy(key, of).orderBy("frame_idx")) == 1, 1).otherwise(0)
    up = Window.partitionBy(key).orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    return reads.withColumn("__new", new).withColumn("so_far", F.sum("__new").over(up)).drop("__new")


def phantoms(reads: DataFrame, most: int = 5, run: tuple[str, ...] = ()) -> DataFrame:
    """run.., number, tracks of the numbers seen on more than `most` tracks (with run columns, of one run)."""
    return reads.where("number is not null").groupBy(*run, "number").agg(F.countDistinct("track_id").alias("tracks")).where(F.col("tracks") > most)


def strongest(rows: DataFrame, key: str, of: str, signal: str) -> DataFrame:
    """key, of: the one with the strongest signal (the largest of equals)."""
    return rows.groupBy(key).agg(F.max(F.struct(signal, of))[of].alias(of))


def remembered(reads: DataFrame, memory: int, run: str = "run_id") -> DataFrame:
    """run, track_id, number (the last), last_frame, live: of all time, and whether it is within `memory` frames of the run's end."""
    last = reads.groupBy(run, "track_id").agg(F.max_by("number", "frame_idx").alias("number"), F.max("frame_idx").alias("last_frame"))
    end = reads.groupBy(F.col(run).alias("__run")).agg(F.max("frame_idx").alias("__end"))
    return last.join(end, F.col(run).eqNullSafe(F.col("__run"))).withColumn("live", F.col("last_frame") >= F.col("__end") - memory).drop("__run", "__end")


def after_clear(reads: DataFrame, clears: DataFrame) -> DataFrame:
    """The reads of each track after its last clearing; clears: track_id, frame_idx."""
    last = clears.groupBy(F.col("track_id").alias("__t")).agg(F.max("frame_idx").alias("__f"))
    out = reads.join(last, F.col("track_id") == F.col("__t"), "left")
    return out.where(F.col("__f").isNull() | (F.col("frame_idx") > F.col("__f"))).drop("__t", "__f")


def or_empty(tracks: DataFrame, results: DataFrame) -> DataFrame:
    """A result for every track (track_id); a track without votes has no number, 0 votes, confidence 0 and needs review."""
    r = results.select(F.col("track_id").alias("__t"), "number", "votes", "confidence", "needs_review")
    fill = {"votes": F.coalesce("votes", F.lit(0).cast("long")), "confidence": F.coalesce("confidence", F.lit(0.0)), "needs_review": F.coalesce("needs_review", F.lit(True))}
    return tracks.select("track_id").distinct().join(r, F.col("track_id") == F.col("__t"), "left").drop("__t").withColumns(fill)


def thinned(rows: DataFrame, key: str, gap: int = 10) -> DataFrame:
    """key, frame_idx: the frames kept when each must be at least `gap` after the one of its key kept before."""
    return kept(rows, gap, (key,))
