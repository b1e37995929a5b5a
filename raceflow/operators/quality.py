"""Gates on detections and crops, cheapest first; only the pixel statistics are Python."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from raceflow.operators import images

#: Padding (left, right, top, bottom) as shares of the box for each placement of the camera.
PADDING = {"center": (0.15, 0.15, 0.10, 0.10), "left": (0.10, 0.25, 0.10, 0.10), "right": (0.25, 0.10, 0.10, 0.10)}


def padded(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, placement: str = "center") -> Column:
    """The box with padding, inside its frame (struct), or null if empty; an unknown placement is center."""
    left, right, top, bottom = PADDING.get(placement, PADDING["center"])
    w, h = x2 - x1, y2 - y1
    a, b = F.greatest(F.lit(0), x1 - F.floor(w * F.lit(left))), F.greatest(F.lit(0), y1 - F.floor(h * F.lit(top)))
    c, d = F.least(width, x2 + F.floor(w * F.lit(right))), F.least(height, y2 + F.floor(h * F.lit(bottom)))
    return F.when((c > a) & (d > b), F.struct(*[v.cast("int").alias(n) for v, n in ((a, "x1"), (b, "y1"), (c, "x2"), (d, "y2"))]))


def reason(w: Column, h: Column, blur: Column, contrast: Column, extent: Column, completeness: Column, min_w: int = 40, min_h: int = 15, aspect: tuple[float, float] = (1.0, 6.0), min_blur: float = 50.0, min_contrast: float = 20.0, min_extent: float = 0.5, min_complete: float = 0.3) -> Column:
    """The first gate that a crop fails, or null."""
    ratio = w / F.when(h > 0, h)
    return (
        F.when((w <= 0) | (h <= 0), "empty")
        .when(w < min_w, "too_narrow")
        .when(h < min_h, "too_short")
        .when(ratio < aspect[0], "aspect_low")
        .when(ratio > aspect[1], "aspect_high")
        .when(blur < min_blur, "blurry")
        .when(contrast < min_contrast, "low_contrast")
        .when(extent < min_extent, "partial_content")
        .when(completeness < min_complete, "partial_digits")
    )


def accepts(why: Column) -> Column:
    """Whether a crop passes: no gate fails (why is null)."""
    return why.isNull()


def cascade_totals(results: DataFrame, resets: DataFrame, run: str = "run_id") -> DataFrame:
    """run, total, fast_only, used_slow, fast_only_pct, used_slow_pct of the cascade's results (run, frame_idx, model) since the run's last reset (run, frame_idx); a run that was reset and then idle has zeros."""
    last = resets.groupBy(F.col(run).alias("__run")).agg(F.max("frame_idx").alias("__last"))
    since = F.col("__last").isNull() | (F.col("frame_idx") > F.col("__last"))
    rows = results.join(last, F.col(run).eqNullSafe(F.col("__run")), "left")
    out = rows.groupBy(run).agg(F.count_if(since).alias("total"), F.count_if(since & (F.col("model") == "fast")).alias("fast_only"), F.count_if(since & (F.col("model") == "slow")).alias("used_slow"))
    share = lambda c: (100 * F.col(c) / F.greatest(F.col("total"), F.lit(1))).alias(f"{c}_pct")
    return out.select("*", share("fast_only"), share("used_slow"))


def bucket(why: Column) -> Column:
    return F.when(why.isNull(), "accepted").when(F.contains(F.lower(why), F.lit("partial")), "partial").otherwise("quality")


def shrink(boxes: DataFrame, least: float = 0.7) -> DataFrame:
    """boxes (track_id, frame_idx, w, h, visible) and fit: 0 if not visible, .5 if the box has shrunk below `least` of the one before, else 1."""
    w = Window.partitionBy("track_id").orderBy("frame_idx")
    smaller = (F.col("w") / F.greatest(F.lag("w").over(w), F.lit(1)) < least) | (F.col("h") / F.greatest(F.lag("h").over(w), F.lit(1)) < least)
    return boxes.withColumn("fit", F.when(~F.col("visible"), 0.0).when(F.coalesce(smaller, F.lit(False)), 0.5).otherwise(1.0))


def pixel_stats(gray: np.ndarray) -> tuple[float, float]:
    """Variance of the Laplacian (0 for less than 3 x 3) and standard deviation."""
    g = np.asarray(gray, dtype=float)
    if not g.size:
        return 0.0, 0.0
    blur, contrast = stack_stats(g[None])
    return float(blur[0]), float(contrast[0])


def stack_stats(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """pixel_stats() of each crop of a stack."""
    g = np.asarray(stack, dtype=float)
    contrast = g.std(axis=(1, 2))
    if min(g.shape[1:]) < 3:
        return np.zeros(len(g)), contrast
    wide = np.pad(g, [(0, 0), (1, 1), (1, 1)], mode="reflect")
    lap = wide[:, :-2, 1:-1] + wide[:, 2:, 1:-1] + wide[:, 1:-1, :-2] + wide[:, 1:-1, 2:] - 4 * g
    return lap.var(axis=(1, 2)), contrast


#: Window and offset of the local threshold; shares of height and width that make a column or row content;
#: weights of the five sub-scores (extent, margins, density, spread, height).
LOCAL, OFFSET = 21, 10
COLUMN_SHARE, ROW_SHARE = 0.15, 0.1
SUBSCORES = (0.35, 0.2, 0.15, 0.2, 0.1)


def dark_marks(stack: np.ndarray) -> np.ndarray:
    """Pixels that are darker than the Gaussian mean of their surroundings by more than OFFSET, for a stack of crops."""
    half = LOCAL // 2
    sigma = 0.3 * ((LOCAL - 1) * 0.5 - 1) + 0.8
    kernel = np.exp(-((np.arange(LOCAL) - half) ** 2) / (2 * sigma * sigma))
    kernel /= kernel.sum()
    mean = np.asarray(stack, dtype=float)
    for axis in (1, 2):
        n = mean.shape[axis]
        wide = np.pad(mean, [(half, half) if k == axis else (0, 0) for k in range(3)], mode="edge")
        mean = sum(kernel[k] * wide.take(np.arange(k, k + n), axis) for k in range(LOCAL))
    return stack <= np.rint(mean) - OFFSET


def _ends(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last marked place of each line."""
    return marked.argmax(axis=1), marked.shape[1] - 1 - marked[:, ::-1].argmax(axis=1)


def completeness_of(stack: np.ndarray, least_extent: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """For each crop of a stack how complete its digits look (0 to 1), and the share of its width that they span; (.2, 0) where there is hardly anything."""
    marks = dark_marks(stack)
    n, h, w = marks.shape
    column, line = marks.sum(axis=1) > COLUMN_SHARE * h, marks.sum(axis=2) > ROW_SHARE * w
    (first, last), (top, bottom) = _ends(column), _ends(line)
    span = last - first + 1
    extent = span / w
    sides = np.stack([first, w - 1 - last]) / w
    near, far = sides.min(axis=0), sides.max(axis=0)
    even = np.where(near > 0.02, near / np.maximum(far, 1e-9), np.where(near < 0.02, 0.3, 0.5))
    filled = column.sum(axis=1) / span
    dense = np.select([filled < 0.3, filled > 0.85], [filled / 0.3, 0.8], 1.0)
    quarter = w // 4
    spread = column[:, : 4 * quarter].reshape(n, 4, quarter).any(axis=2).mean(axis=1) if quarter else np.zeros(n)
    tall = np.minimum(1.0, 2 * (bottom - top + 1) / h)
    parts = np.stack([np.minimum(1.0, extent / least_extent), even, dense, spread, tall], axis=1)
    weights = np.array(SUBSCORES) * np.where(line.any(axis=1)[:, None], 1.0, [1.0, 1.0, 1.0, 1.0, 0.0])  # without a line the other weights count alone
    score = (parts * weights).sum(axis=1) / weights.sum(axis=1)
    little = column.sum(axis=1) < 3
    return np.where(little, 0.2, score), np.where(little, 0.0, extent)


def completeness(gray: np.ndarray, least_extent: float = 0.5) -> tuple[float, float]:
    """completeness_of() of one crop."""
    score, extent = completeness_of(np.asarray(gray)[None], least_extent)
    return float(score[0]), float(extent[0])


STATS = ("blur", "contrast", "extent", "completeness")


@F.pandas_udf(StructType([StructField(c, DoubleType()) for c in STATS]))
def crop_stats(pixels: pd.Series, width: pd.Series) -> pd.DataFrame:
    """blur, contrast, extent and completeness of grey crops given as bytes, crops of one size at a time; 0 for crops without a row."""
    out = np.zeros((len(pixels), len(STATS)))
    for places, stack in images.stacks(pixels, width):
        score, extent = completeness_of(stack)
        out[places] = np.stack([*stack_stats(stack), extent, score], axis=1)
    return pd.DataFrame(out, columns=STATS)


def ocr_best(reads: DataFrame, key: str, bonus: float = 0.1) -> DataFrame:
    """key, text, score: the best 1-4 digit reading by confidence (plus a bonus if it is digits only), then length, then text."""
    digits = F.regexp_replace("raw", "[^0-9]", "")
    rows = reads.withColumn("text", digits).where(F.col("text").rlike("^[0-9]{1,4}$"))
    rows = rows.withColumn("score", F.col("conf") + F.when(F.col("text") == F.col("raw"), bonus).otherwise(0.0))
    best = F.min(F.struct((-F.col("score")).alias("s"), (-F.length("text")).alias("n"), "text"))
    return rows.groupBy(key).agg(best.alias("b")).select(key, F.col("b.text").alias("text"), (-F.col("b.s")).alias("score"))


def cascade(reads: DataFrame, slow: DataFrame, sure: float = 0.85) -> DataFrame:
    """read_id, text, conf, model: the fast reading, or the slow one where the fast is unsure or has one or two characters."""
    unsure = (F.col("conf") < sure) | F.length("text").between(1, 2)
    s = slow.select(F.col("read_id").alias("r"), F.col("text").alias("t"), F.col("conf").alias("c"))
    out = reads.withColumn("slow", unsure).join(s, (F.col("read_id") == F.col("r")) & F.col("slow"), "left")
    use = F.col("slow") & F.col("r").isNotNull()
    return out.select("read_id", F.when(use, F.col("t")).otherwise(F.col("text")).alias("text"), F.when(use, F.col("c")).otherwise(F.col("conf")).alias("conf"), F.when(use, "slow").otherwise("fast").alias("model"))
