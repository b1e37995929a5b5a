"""Training-set preparation and evaluation: splits, oversampling, checks, metrics and scorecards."""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from raceflow.operators.folds import folded
from raceflow.operators.ordering import placed
from raceflow.operators.spacing import kept


def _shuffled(key: str, seed: int) -> Column:
    """A fixed pseudo-random order of a key."""
    return F.md5(F.concat_ws("#", F.lit(str(seed)), F.col(key).cast("string")))


def split_by_event(samples: DataFrame, key: str, share: float = 0.85, seed: int = 42) -> DataFrame:
    """samples and split: floor(n * share) of each event train, the rest val."""
    w = Window.partitionBy("event")
    place = F.row_number().over(w.orderBy(_shuffled(key, seed), key))
    return samples.withColumn("split", F.when(place <= F.floor(F.count(F.lit(1)).over(w) * F.lit(share)), "train").otherwise("val"))


def stratified_split(samples: DataFrame, key: str, share: float = 0.1, least: int = 10, seed: int = 42) -> DataFrame:
    """samples and split: of each digit count of an event of `least` samples, a share (one at least) is test, then val, the rest train."""
    event, own = Window.partitionBy("event"), Window.partitionBy("event", "digit_count")
    place = F.row_number().over(own.orderBy(_shuffled(key, seed), key))
    n = F.greatest(F.floor(F.count(F.lit(1)).over(own) * F.lit(share)), F.lit(1))
    small = F.count(F.lit(1)).over(event) < least
    return samples.withColumn("split", F.when(small, "train").when(place <= n, "test").when(place <= 2 * n, "val").otherwise("train"))


def oversampled(samples: DataFrame, copies: dict[int, int] | None = None) -> DataFrame:
    """samples and copy: 0 for the row itself and 1.. for its copies, by digit count."""
    copies = copies or {1: 10, 2: 5, 3: 2, 4: 0}
    n = F.lit(0)
    for digits, k in copies.items():
        n = F.when(F.col("digit_count") == digits, k).otherwise(n)
    return samples.withColumn("copy", F.explode(F.sequence(F.lit(0), n)))


def numbers(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """id, digits, label: n synthetic labels of one to four digits, evenly by length; the same on any cluster."""
    return numbers_for(spark.range(n), seed)


def numbers_for(rows: DataFrame, seed: int = 42) -> DataFrame:
    """id, digits, label: a synthetic label for each row (id), its digits by the id."""
    rows = rows.withColumn("digits", (F.col("id") % 4 + 1).cast("int"))
    least = F.element_at(F.array(*[F.lit(10**k) for k in range(4)]), F.col("digits")).cast("long")
    draw = F.conv(F.substring(_shuffled("id", seed), 1, 12), 16, 10).cast("long")
    return rows.select("id", "digits", (least + draw % (9 * least)).cast("string").alias("label"))


def char_accuracy(gt: Column, pred: Column) -> Column:
    longest = F.greatest(F.length(gt), F.length(pred))
    return F.when(longest > 0, 1.0 - F.levenshtein(gt, pred) / longest).otherwise(1.0)


def metrics(truth: DataFrame) -> DataFrame:
    """slice, value, n, exact, char_accuracy: in all, by digit count and by event, in one pass over grouping sets.

    truth: gt, pred, event.
    """
    rows = truth.select("gt", "pred", "event", F.length("gt").cast("string").alias("digits"))
    sets = rows.groupingSets([[], ["digits"], ["event"]], "digits", "event")
    out = sets.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gt") == F.col("pred")).alias("right"), F.sum(char_accuracy(F.col("gt"), F.col("pred"))).alias("chars"), F.grouping("digits").alias("gd"), F.grouping("event").alias("ge"))
    kind = F.when((F.col("gd") == 1) & (F.col("ge") == 1), "all").when(F.col("gd") == 0, "digits").otherwise("event")
    return out.select(kind.alias("slice"), F.coalesce(F.when(F.col("gd") == 0, F.col("digits")), F.when(F.col("ge") == 0, F.col("event")), F.lit("")).alias("value"), "n", (F.col("right") / F.col("n")).alias("exact"), (F.col("chars") / F.col("n")).alias("char_accuracy"))


def latency(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """mean, median, p95, p99 (linear interpolation)."""
    p = lambda q: F.percentile(value, F.lit(q))
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), p(0.5).alias("median"), p(0.95).alias("p95"), p(0.99).alias("p99"))


def error_class(gt: Column, pred: Column) -> Column:
    return F.when(pred == gt, "correct").when(F.length(pred) < F.length(gt), "truncation").when(F.length(pred) > F.length(gt), "extra").otherwise("confusion")


def bad_boxes(annotations: DataFrame) -> DataFrame:
    """id, issue of annotations whose bbox is missing, of wrong size or without area."""
    b = F.col("bbox")
    issue = F.when(b.isNull(), "missing").when(F.size(b) != 4, "arity").when((F.get(b, F.lit(2)) <= 0) | (F.get(b, F.lit(3)) <= 0), "non_positive")
    return annotations.select("id", issue.alias("issue")).where(F.col("issue").isNotNull())


def reconciled(annotated: DataFrame, files: DataFrame) -> DataFrame:
    """name, state: both, missing_file, or unannotated."""
    a, f = annotated.select("name").distinct(), files.select(F.col("name").alias("file")).distinct()
    out = a.join(f, F.col("name") == F.col("file"), "full")
    return out.select(F.coalesce("name", "file").alias("name"), F.when(F.col("file").isNull(), "missing_file").when(F.col("name").isNull(), "unannotated").otherwise("both").alias("state"))


def counted_readiness(images: DataFrame, annotations: DataFrame, files: DataFrame) -> DataFrame:
    """One row: images, annotations, missing, issues, status, warnings. images: name; annotations: id, bbox; files: name."""
    n = images.count()
    boxes, issues = annotations.count(), bad_boxes(annotations).count()
    missing = reconciled(images, files).where("state = 'missing_file'").count()
    status, warnings = readiness(n, boxes, missing, issues)
    return images.sparkSession.createDataFrame([(n, boxes, missing, issues, status, "; ".join(warnings))], "images long, annotations long, missing long, issues long, status string, warnings string")


def gate_comparison(rows: DataFrame, key: str, accepted: Column) -> DataFrame:
    """key, n, accepted, rejected, share: the rows with and without a gate, in one pass."""
    ok = F.coalesce(accepted, F.lit(False))
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"))
    return out.withColumn("share", F.col("accepted") / F.col("n"))


def copies(files: DataFrame, prefix: str) -> DataFrame:
    """files (file_name) and name: that of the copy, with the prefix of its dataset and .jpg for any spelling of it."""
    stem = F.regexp_replace("file_name", r"(?i)[.]jpe?g$", "")
    return files.withColumn("name", F.concat(F.lit(f"{prefix}_"), stem, F.lit(".jpg")))


def parity(one: DataFrame, other: DataFrame) -> DataFrame:
    """event, n, both_right, differ of two models on the same samples. one: key, event, gt, pred; other: key, alt."""
    rows = one.join(other.select(F.col("key").alias("__k"), "alt"), F.col("key") == F.col("__k"))
    both = (F.col("gt") == F.col("pred")) & (F.col("gt") == F.col("alt"))
    return rows.groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.count_if(both).alias("both_right"), F.count_if(F.col("pred") != F.col("alt")).alias("differ"))


def readiness(images: int, annotations: int, missing: int, issues: int) -> tuple[str, list[str]]:
    warnings = [w for w, bad in (("few images", images < 500), ("less than one annotation an image", annotations < images), ("box issues", issues > 0)) if bad]
    return ("READY" if not missing else "NOT READY"), warnings


def evenly(rows: DataFrame, order: str, most: int) -> DataFrame:
    """At most `most` rows at even steps: those at int(i * n / most), known by their place alone."""
    n = rows.count()
    if n <= most:
        return rows
    at = F.col("__n")
    step = F.ceil(at * most / n)  # the least i with int(i * n / most) >= place
    return placed(rows, "__n", order).where((step < most) & (F.floor(step * n / most) == at)).drop("__n")


def spaced(frames: DataFrame, gap: int) -> DataFrame:
    """frame_idx of the frames kept when each must be at least `gap` after the one kept before, from the first on."""
    return kept(frames.select("frame_idx"), gap)


def densest(frames: DataFrame, k: int) -> DataFrame:
    """frame_idx, n of the k frames with most rows; of equals the first."""
    return frames.groupBy("frame_idx").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "frame_idx").limit(k)


def selection(uniform: DataFrame, top: DataFrame) -> DataFrame:
    """frame_idx, how: uniform, topk or both."""
    u, t = uniform.select("frame_idx").distinct(), top.select(F.col("frame_idx").alias("t")).distinct()
    out = u.join(t, F.col("frame_idx") == F.col("t"), "full")
    return out.select(F.coalesce("frame_idx", "t").alias("frame_idx"), F.when(F.col("t").isNull(), "uniform").when(F.col("frame_idx").isNull(), "topk").otherwise("both").alias("how"))


def scorecard(emitted: DataFrame, truth: DataFrame, seen: DataFrame) -> DataFrame:
    """One row: bib recall, precision, false bibs, unknown rate, repeated bibs.

    emitted: bib of every crossing; truth: bib; seen: bib of every reading.
    """
    known = emitted.where(F.col("bib") != "UNKNOWN").groupBy("bib").agg(F.count(F.lit(1)).alias("n"))
    t = truth.select(F.col("bib").alias("t")).distinct()
    hit = known.join(t, F.col("bib") == F.col("t"), "left").agg(F.count_if(F.col("t").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    total = emitted.agg(F.count(F.lit(1)).alias("crossings"), F.count_if(F.col("bib") == "UNKNOWN").alias("unknown"))
    all_ = t.agg(F.count(F.lit(1)).alias("truth"))
    visible = t.join(seen.select(F.col("bib").alias("s")).distinct(), F.col("t") == F.col("s"), "left_semi").agg(F.count(F.lit(1)).alias("visible"))
    one = hit.join(F.broadcast(total)).join(F.broadcast(all_)).join(F.broadcast(visible))
    safe = lambda a, b: F.col(a) / F.when(b > 0, b)
    return one.select("*", safe("tp", F.col("tp") + F.col("fp")).alias("precision"), safe("tp", F.col("visible")).alias("visible_recall"), safe("unknown", F.col("crossings")).alias("unknown_rate"))


def funnel(truth: DataFrame, reads: DataFrame, crossed: DataFrame) -> DataFrame:
    """One row: truth, seen, sure (high or medium), crossed. reads: bib, level; crossed: bib."""
    r = reads.groupBy(F.col("bib").alias("r")).agg(F.bool_or(F.col("level").isin("high", "medium")).alias("sure"))
    c = crossed.select(F.col("bib").alias("c")).distinct()
    out = truth.select("bib").distinct().join(r, F.col("bib") == F.col("r"), "left").join(c, F.col("bib") == F.col("c"), "left")
    return out.agg(F.count(F.lit(1)).alias("truth"), F.count("r").alias("seen"), F.count_if(F.col("sure")).alias("sure"), F.count("c").alias("crossed"))


def order_accuracy(orders: DataFrame) -> DataFrame:
    """event, lcs: longest common subsequence of true and emitted order over the longer one.

    orders: event, bib, true_place, out_place (null if missing). Bibs are unique in an event, so it is a longest increasing
    run, of which a fold over the true order holds only the piles; rows of one true place go by their place in the output.
    """

    def step(state: list, row) -> list[tuple]:
        if not state:
            state.extend((row.event, []))
        piles = state[1]
        i = bisect.bisect_left(piles, row.out_place)
        piles[i : i + 1] = [row.out_place]
        return []

    rows = orders.select("event", F.col("true_place").cast("double").alias("true_place"), F.col("out_place").cast("double").alias("out_place"))
    both = rows.where("true_place is not null and out_place is not null")
    runs = folded(both, ["event"], ["true_place", "out_place"], list, step, "event string, long bigint", lambda s: [(s[0], len(s[1]))])
    whole = rows.groupBy("event").agg(F.greatest(F.count("true_place"), F.count("out_place"), F.lit(1)).alias("whole"))
    out = whole.join(runs.withColumnRenamed("event", "__e"), F.col("event").eqNullSafe(F.col("__e")), "left")
    return out.select("event", (F.coalesce("long", F.lit(0)) / F.col("whole")).alias("lcs"))
