"""Plane geometry as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from raceflow.config import Line

#: Torso keypoints of the 17-point body model, and the least confidence of a visible one.
TORSO, VISIBLE = (5, 6, 11, 12), 0.3


def side_of_line(x: Column, y: Column, line: Line) -> Column:
    """+1, -1, or 0 on the line (double)."""
    cross = F.lit(line.x2 - line.x1) * (y - line.y1) - F.lit(line.y2 - line.y1) * (x - line.x1)
    return F.signum(cross)


def dist(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x1 - x2, y1 - y2
    return F.sqrt(dx * dx + dy * dy)


def center(lo: Column, hi: Column) -> Column:
    return (lo + hi) / 2.0


def inside(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether a point lies in a box; edges count."""
    return (x1 <= px) & (px <= x2) & (y1 <= py) & (py <= y2)


def overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether two boxes (x1, y1, x2, y2) share a point; edges count."""
    return ~((b[2] < a[0]) | (b[0] > a[2]) | (b[3] < a[1]) | (b[1] > a[3]))


def chest(keypoints: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Mean of the visible torso keypoints if there are two, else the box's middle (struct x, y)."""
    torso = F.filter(F.array(*[F.get(keypoints, F.lit(i)) for i in TORSO]), lambda k: k["conf"] >= VISIBLE)
    mean = lambda c: F.aggregate(torso, F.lit(0.0), lambda a, k: a + k[c].cast("double")) / F.size(torso)
    seen = F.coalesce(F.size(torso) >= 2, F.lit(False))
    return F.struct(F.when(seen, mean("x")).otherwise(center(x1, x2)).alias("x"), F.when(seen, mean("y")).otherwise(center(y1, y2)).alias("y"))


def edge_reason(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, ratio: float) -> Column:
    """The first frame edge that a box touches, or null."""
    mx, my = F.floor(width * F.lit(ratio)), F.floor(height * F.lit(ratio))
    return F.when(x1 <= mx, "partial_left").when(x2 >= width - mx, "partial_right").when(y1 <= my, "partial_top").when(y2 >= height - my, "partial_bottom")


def yolo(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A COCO box (corner and size) clamped to its frame as normalised centre and size (struct); null if nothing is left."""
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    out = F.struct(unit((x + w / 2.0) / width).alias("xc"), unit((y + h / 2.0) / height).alias("yc"), unit(w / width).alias("w"), unit(h / height).alias("h"))
    return F.when((w > 0) & (h > 0) & (width > 0) & (height > 0), out)


def clamped(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """The box inside 0..dim-1 (struct), or null if it is no more than a pixel wide or high."""
    cut = lambda v, most: F.greatest(F.lit(0.0), F.least(v, most - 1.0))
    a, b, c, d = cut(x1, width), cut(y1, height), cut(x2, width), cut(y2, height)
    return F.when((c - a > 1) & (d - b > 1), F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2")))
