"""Matching noisy numbers to a registry of valid ones: exact, structural and fuzzy."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from raceflow import shared
from raceflow.functions import text as T

#: Rows up to which a registry is broadcast after counting: its table is made in the driver, for each join anew.
BROADCAST_ROWS = 100_000


def from_range(spark: SparkSession, start: int, end: int) -> DataFrame:
    """Both ends count."""
    return spark.range(start, end + 1).select(F.col("id").cast("string").alias("bib"))


def of_ranges(texts: Column, rows: DataFrame) -> DataFrame:
    """The distinct bibs of all ranges `a-b` (both ends count) among the rows' texts; other texts and empty ranges give none."""
    ranges = rows.select(T.range_of(texts).alias("r")).where("r.first <= r.last")
    return ranges.select(F.explode(F.sequence("r.first", "r.last")).alias("n")).select(F.col("n").cast("string").alias("bib")).distinct()


def sized(registry: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The registry with a broadcast hint if it has few rows."""
    return F.broadcast(registry) if registry.limit(limit + 1).count() <= limit else registry


def lengths(registry: DataFrame) -> DataFrame:
    """One row: lengths (sorted array) and max_value of the numeric bibs."""
    return registry.agg(F.sort_array(F.collect_set(F.length("bib"))).alias("lengths"), F.max(F.col("bib").try_cast("long")).alias("max_value"))


def flagged(reads: DataFrame, registry: DataFrame, number: str = "number") -> DataFrame:
    """reads and is_valid: whether the number is in the registry."""
    known = sized(registry.select(F.col("bib").alias("__bib")).distinct())
    return reads.join(known, F.col(number) == F.col("__bib"), "left").withColumn("is_valid", F.col("__bib").isNotNull()).drop("__bib")


def _expanded(preds: DataFrame, known: DataFrame, front: bool) -> DataFrame:
    digits = [str(d) for d in range(1 if front else 0, 10)]
    p = F.col("pred")
    made = preds.select("pred", F.explode(F.array(*[F.concat(F.lit(d), p) if front else F.concat(p, F.lit(d)) for d in digits])).alias("bib"))
    n = F.length("pred")
    return made.join(known, "bib").select("pred", "bib", (n / (n + 1) + F.lit(0.15 if front else 0.10)).alias("score"))


def leading(preds: DataFrame, registry: DataFrame) -> DataFrame:
    """pred, bib, score: registry numbers that are a prediction with a digit 1-9 in front."""
    return _expanded(preds, sized(registry), True)


def trailing(preds: DataFrame, registry: DataFrame) -> DataFrame:
    """pred, bib, score: registry numbers that are a prediction with a digit behind."""
    return _expanded(preds, sized(registry), False)


#: Cells (characters by characters) that are compared at a time, and the length from which the standard matcher leaves out frequent characters.
CELLS, POPULAR = 1 << 18, 200


def matches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Characters in matching blocks of each pair of texts (rows of code points of a and of b): the longest block, first of equals, and so on left and right of it."""
    (k, n), m = a.shape, b.shape[1]
    runs = np.zeros((k, n + 1, m + 1), np.int16)  # of equal characters, from each place on
    for i in range(n - 1, -1, -1):
        runs[:, i, :m] = np.where(a[:, i, None] == b, runs[:, i + 1, 1:] + 1, 0)
    runs = runs[:, :n, :m]
    total, at_a, at_b = np.zeros(k, np.int64), np.arange(n)[None, :, None], np.arange(m)[None, None, :]
    who = np.arange(k)
    box = np.tile([0, n, 0, m], (k, 1))  # the part of a and of b in question
    while len(who):
        i0, i1, j0, j1 = (x[:, None, None] for x in box.T)
        here = np.where((at_a >= i0) & (at_b >= j0), np.minimum(runs[who], np.minimum(i1 - at_a, j1 - at_b)), 0).reshape(len(who), -1)
        best = here.argmax(axis=1)
        long = here[np.arange(len(who)), best]
        found = long > 0
        who, box, best, long = who[found], box[found], best[found], long[found].astype(np.int64)
        np.add.at(total, who, long)
        i, j = best // m, best % m
        box = np.concatenate([np.stack([box[:, 0], i, box[:, 2], j], axis=1), np.stack([i + long, box[:, 1], j + long, box[:, 3]], axis=1)])
        open_ = (box[:, 0] < box[:, 1]) & (box[:, 2] < box[:, 3])
        who, box = np.concatenate([who, who])[open_], box[open_]
    return total


@F.pandas_udf(DoubleType())
def ratio(pred: pd.Series, bib: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, pairs of equal lengths at a time; the order of the arguments matters."""
    n, m = pred.str.len().to_numpy(), bib.str.len().to_numpy()
    out = np.ones(len(pred))  # two empty texts are equal
    for (p, q), places in pd.DataFrame({"n": n, "m": m}).groupby(["n", "m"]).indices.items():
        if q >= POPULAR:
            matcher = SequenceMatcher(None)
            for k in places:
                matcher.set_seqs(pred.iat[k], bib.iat[k])
                out[k] = matcher.ratio()
        elif not p or not q:
            out[places] = 0.0 if p or q else 1.0
        else:
            step = max(1, CELLS // (p * q))
            for some in (places[k : k + step] for k in range(0, len(places), step)):
                codes = lambda texts, size: np.frombuffer("".join(texts.iloc[some]).encode("utf-32-le"), np.uint32).reshape(-1, size)  # noqa: B023, E731
                out[some] = 2.0 * matches(codes(pred, p), codes(bib, q)) / (p + q)
    return pd.Series(out)


#: As a filter, it would be pushed below the distinct pairs and run there too, in the few tasks of their join; so it counts as one that may not be moved.
ratio = ratio.asNondeterministic()


def _counts(text: Column) -> Column:
    """How often each digit is in the text, and how many other characters are."""
    digit = [F.length(text) - F.length(F.replace(text, F.lit(str(k)), F.lit(""))) for k in range(10)]
    return F.array(*digit, F.length(F.regexp_replace(text, "[0-9]", "")))


def _could_reach(threshold: float) -> Column:
    """Whether the characters that pred and bib have in common, in any order, allow the similarity (columns pc and bc: counts)."""
    common = F.lit(0)
    for k in range(11):
        common = common + F.least(F.get("pc", F.lit(k)), F.get("bc", F.lit(k)))
    return 2.0 * common >= F.lit(threshold) * (F.length("pred") + F.length("bib"))


def _scored(both: DataFrame, threshold: float) -> DataFrame:
    """pred, bib, score of the distinct pairs that are similar enough; the Python ratio sees only pairs that could be.

    Pairs are few bytes and much work, so they are dealt to all partitions, however small these are.
    """
    parts = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.select("pred", "bib").repartition(parts, "pred", "bib").distinct()
    both = both.withColumn("pc", _counts(F.col("pred"))).withColumn("bc", _counts(F.col("bib")))
    return both.where(_could_reach(threshold)).select("pred", "bib", ratio("pred", "bib").alias("score")).where(F.col("score") >= threshold)


#: Characters that a text may lose to make its keys; texts that must lose more meet by length.
MOST_LOST = 3


def _shorter(texts: Column) -> Column:
    """The distinct texts that the given ones become by losing one character."""
    one = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    return F.array_distinct(F.flatten(F.transform(F.filter(texts, lambda s: s != ""), one)))


def _keys(text: str, own: str, other: str, threshold: float) -> DataFrame | Column:
    """Keys (own and other length, left to right, and what is left) that a text has for partners that are `d` characters longer, for d of -1, 0, 1.

    The ratio is 2 * matches / (both lengths), and the matches are a subsequence of both texts. So similar texts become one
    text when each loses all but the least number of matches.
    """
    x = F.col(text)
    lost = [F.array(x)]
    for _ in range(MOST_LOST):
        lost.append(_shorter(lost[-1]))
    sets = []
    for d in (-1, 0, 1):
        n, m = F.length(x), F.length(x) + d
        least = F.ceil(F.lit(threshold) * (n + m) / 2 - 1e-9).cast("int")
        some = F.array().cast("array<string>")
        for k, texts in enumerate(lost):
            some = F.when(n - least == k, texts).otherwise(some)
        many = F.when(n - least > MOST_LOST, F.array(F.lit("#"))).otherwise(some)
        keys = F.transform(F.when((m < 1) | (least > F.least(n, m)), F.array().cast("array<string>")).otherwise(many), lambda s: F.struct(n.alias(own), m.alias(other), s.alias("left")))  # noqa: B023
        sets.append(keys)
    return F.flatten(F.array(*sets))


def _least(n: Column, m: Column, threshold: float) -> Column:
    """The least number of matches that makes texts of these lengths similar enough."""
    return F.ceil(F.lit(threshold) * (n + m) / 2 - 1e-9).cast("int")


#: Least threshold by which same_prefix() has keys; under it, texts of very different lengths are similar.
KEYED = 0.25


def _prefix_keys(rows: DataFrame, text: str, threshold: float, first: int = 2, others: list[int] | None = None) -> DataFrame:
    """rows (a text), once for each key by which it meets similar texts with its first characters: these, its length n, the other one's m, and what is left.

    Texts that begin alike have these characters among their matches, so only what follows them loses characters. Keys are
    made for each length that a similar text can have, and of these for the lengths that the other side has, if given.
    """
    n, behind = F.length(text), F.substring(F.col(text), F.lit(first + 1), F.length(text))
    lost = [F.array(behind)]
    for _ in range(MOST_LOST):
        lost.append(_shorter(lost[-1]))

    def of_length(m: Column) -> Column:
        least = F.greatest(_least(n, m, threshold), F.lit(first))
        some = F.array().cast("array<string>")
        for k, texts in enumerate(lost):
            some = F.when(n - least == k, texts).otherwise(some)
        some = F.when(F.greatest(n, m) - least > MOST_LOST, F.array(F.lit("#"))).otherwise(some)
        return F.transform(some, lambda s: F.struct(n.alias("n"), m.alias("m"), s.alias("left")))

    part = (2 - threshold) / threshold
    sizes = F.sequence(F.greatest(F.lit(first), F.ceil(n / part - 1e-9).cast("int")), F.floor(n * part + 1e-9).cast("int"))
    if others is not None:
        sizes = F.array_intersect(sizes, F.array(*[F.lit(n) for n in others]).cast("array<int>"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much work for each
    keyed = rows.where(n >= first).repartition(parts, F.xxhash64(text)).select(text, F.substring(text, 1, first).alias("key"), F.explode(F.flatten(F.transform(sizes, of_length))).alias("k"))
    return keyed.select(text, "key", "k.n", "k.m", "k.left")


#: Lengths up to which a side's are looked up, so that what the plan holds of them is bounded.
MOST_LENGTHS = 256


def _lengths(rows: DataFrame, text: str) -> list[int] | None:
    """The lengths of the texts, unless there are too many of them."""
    found = [r.n for r in rows.select(F.length(text).alias("n")).where("n is not null").distinct().limit(MOST_LENGTHS + 1).collect()]
    return sorted(found) if len(found) <= MOST_LENGTHS else None


def same_prefix(preds: DataFrame, registry: DataFrame, threshold: float = 0.75) -> DataFrame:
    """pred, bib, score: registry numbers with the prediction's first two characters that are similar enough.

    An equi-join on these characters, both lengths, and what both texts have left when they lose the characters that may differ.
    """
    if threshold < KEYED:
        cut = lambda rows, c: rows.where(F.length(c) >= 2).select(c, F.substring(c, 1, 2).alias("key"))
        both = cut(preds, "pred").join(cut(registry, "bib"), "key").select("pred", "bib")
    else:
        p = _prefix_keys(preds, "pred", threshold, others=_lengths(registry, "bib"))
        r = _prefix_keys(registry, "bib", threshold, others=_lengths(preds, "pred")).select("bib", "key", F.col("m").alias("n"), F.col("n").alias("m"), "left")
        both = p.join(r, ["key", "n", "m", "left"])
    return _scored(both, threshold)


def length_band(preds: DataFrame, registry: DataFrame, threshold: float = 0.75) -> DataFrame:
    """pred, bib, score: registry numbers at most one character longer or shorter that are similar enough.

    An equi-join on what both texts have left when they lose the characters that may differ.
    """
    parts = int(preds.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much work for each
    p = preds.where(F.length("pred") > 0).repartition(parts, F.xxhash64("pred")).select("pred", F.explode(_keys("pred", "a", "b", threshold)).alias("k")).select("pred", "k.*")
    r = registry.where(F.length("bib") > 0).repartition(parts, F.xxhash64("bib")).select("bib", F.explode(_keys("bib", "b", "a", threshold)).alias("k")).select("bib", "k.*")
    # a pair of lengths of which one side has too many characters to lose meets by these lengths alone
    long = lambda n, m: F.greatest(F.col(n), F.col(m)) - F.ceil(F.lit(threshold) * (F.col(n) + F.col(m)) / 2 - 1e-9) > MOST_LOST
    p, r = (t.withColumn("left", F.when(long("a", "b"), "#").otherwise(F.col("left"))).distinct() for t in (p, r))
    return _scored(p.join(r, ["a", "b", "left"]), threshold)


def candidates(preds: DataFrame, registry: DataFrame, threshold: float = 0.75) -> DataFrame:
    """pred, bib, score: the best score of each candidate; the length band is searched only for predictions without any other."""
    first = leading(preds, registry).unionByName(trailing(preds, registry)).unionByName(same_prefix(preds, registry, threshold))
    first = shared.written(first, "candidates")
    rest = preds.join(first.select("pred").distinct(), "pred", "left_anti")
    return first.unionByName(length_band(rest, registry, threshold)).groupBy("pred", "bib").agg(F.max("score").alias("score"))


def validated(preds: DataFrame, registry: DataFrame, threshold: float = 0.75) -> DataFrame:
    """pred, validated, is_valid, is_corrected, boost, alternatives of every distinct prediction; equal scores go by number."""
    preds = preds.select(F.coalesce("pred", F.lit("")).alias("pred")).distinct()
    exact = flagged(preds, registry, "pred")
    open_ = exact.where(~F.col("is_valid") & (F.col("pred") != "")).select("pred")
    order = Window.partitionBy("pred").orderBy(F.desc("score"), "bib")
    ranked = candidates(open_, registry, threshold).withColumn("place", F.row_number().over(order)).where("place <= 4")
    best = ranked.groupBy(F.col("pred").alias("p")).agg(
        F.max(F.when(F.col("place") == 1, F.col("bib"))).alias("best"), F.max("score").alias("score"), F.sort_array(F.collect_list(F.when(F.col("place") > 1, F.struct("place", "bib")))).alias("others")
    )
    out = exact.join(best, F.col("pred") == F.col("p"), "left")
    fixed = ~F.col("is_valid") & F.coalesce(F.col("score") >= threshold, F.lit(False))
    return out.select(
        "pred",
        F.when(fixed, F.col("best")).otherwise(F.col("pred")).alias("validated"),
        "is_valid",
        fixed.alias("is_corrected"),
        F.when(F.col("pred") == "", 0.0).when(F.col("is_valid"), 0.1).when(fixed, -0.1).otherwise(-0.05).alias("boost"),
        F.when(fixed, F.col("others.bib")).otherwise(F.array().cast("array<string>")).alias("alternatives"),
    )


def digit_swap(reads: DataFrame, registry: DataFrame) -> DataFrame:
    """reads (read_id, number, digits array<struct<digit,prob,ru_digit,ru_prob>>) and corrected: the first unsure digit's swap that is registered, else the number."""
    unsure = F.posexplode("digits").alias("at", "d")
    made = reads.where((F.length("number") >= 3) & (F.size("digits") == F.length("number"))).select("read_id", "number", unsure).where("d.prob < 0.6 and d.ru_prob > 0.1")
    swap = F.concat(F.substring(F.col("number"), F.lit(1), F.col("at")), F.col("d.ru_digit"), F.substring(F.col("number"), F.col("at") + 2, F.length("number")))
    hits = made.select("read_id", "at", swap.alias("bib")).join(sized(registry), "bib").groupBy(F.col("read_id").alias("r")).agg(F.min_by("bib", "at").alias("swap"))
    out = flagged(reads, registry).join(hits, F.col("read_id") == F.col("r"), "left")
    return out.withColumn("corrected", F.when(~F.col("is_valid"), F.coalesce("swap", "number")).otherwise(F.col("number"))).drop("r", "swap")
