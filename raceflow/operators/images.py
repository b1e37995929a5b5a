"""Functions on grey crops. Crops of one size are handled as one stack (crops, height, width); columns hold them as bytes with their width."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

#: Pixels of a stack at most, but for a single crop.
STACK = 1 << 20
#: Pixels that are changed at a time, counted before or after the change, but for a single crop.
PIECE = 1 << 18
#: Bytes of crops that a Python worker gets at a time.
BATCH = 2 << 20


def _small_batches() -> None:
    """A Python worker gets crops by their bytes, not by their number."""
    spark, key = SparkSession.getActiveSession(), "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.match(r"(\d+)b?$", spark.conf.get(key)) if spark else None
    if spark and (not now or not 0 < int(now[1]) <= BATCH):
        spark.conf.set(key, str(BATCH))


def stacks(pixels: pd.Series, width: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, stack) of the crops of each size that have at least a row; a last row that isn't whole is left out."""
    sizes = [(len(p) // int(w), int(w)) if p is not None and w is not None and w > 0 else (0, 0) for p, w in zip(pixels, width)]
    by: dict[tuple[int, int], list[int]] = {}
    for i, (h, w) in enumerate(sizes):
        if h:
            by.setdefault((h, w), []).append(i)
    for (h, w), places in by.items():
        step = max(1, STACK // (h * w))
        for k in range(0, len(places), step):
            some = places[k : k + step]
            yield np.array(some), np.stack([np.frombuffer(pixels.iloc[i], np.uint8, h * w).reshape(h, w) for i in some])


def resized(stack: np.ndarray, height: int, width: int) -> np.ndarray:
    """The stack at another size, linear between the middles of pixels."""

    def along(x: np.ndarray, axis: int, size: int) -> np.ndarray:
        n = x.shape[axis]
        at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        part = (at - low).reshape([-1 if k == axis else 1 for k in range(3)])
        return x.take(low, axis) * (1 - part) + x.take(np.minimum(low + 1, n - 1), axis) * part

    out = np.empty((len(stack), height, width), np.uint8)
    step = max(1, PIECE // (max(stack.shape[1], height) * max(stack.shape[2], width)))  # numbers of 8 bytes, at the larger size
    for k in range(0, len(stack), step):
        out[k : k + step] = np.rint(along(along(stack[k : k + step].astype(float), 1, height), 2, width))
    return out


def upscaled(stack: np.ndarray, least: int = 64) -> np.ndarray:
    """The stack in its shape, at least so many pixels high; larger crops stay."""
    h, w = stack.shape[1:]
    return stack if h >= least else resized(stack, least, max(1, round(w * least / h)))


def tables(stack: np.ndarray, tiles: int, clip: float) -> np.ndarray:
    """The grey value that each grey value becomes in each tile (crops, tiles, tiles, 256); the sides are whole numbers of tiles.

    A tile's histogram is cut at `clip` times its mean and what is cut off is dealt out evenly, what is left of that at
    even steps; its running sum is stretched to 0..255.
    """
    n, h, w = stack.shape
    th, tw = h // tiles, w // tiles
    parts = stack.reshape(n, tiles, th, tiles, tw).transpose(0, 1, 3, 2, 4).reshape(n * tiles * tiles, th * tw)
    area = th * tw
    counts = np.bincount((np.arange(len(parts))[:, None] * 256 + parts).ravel(), minlength=len(parts) * 256).reshape(-1, 256)
    most = max(1, int(clip * area / 256))
    over = np.maximum(counts - most, 0).sum(axis=1)
    counts = np.minimum(counts, most) + (over // 256)[:, None]
    rest = over % 256
    step = np.maximum(256 // np.maximum(rest, 1), 1)
    place = np.arange(256)
    counts += ((place % step[:, None] == 0) & (place // step[:, None] < rest[:, None])).astype(counts.dtype)
    return np.clip(np.rint(np.cumsum(counts, axis=1) * (255.0 / area)), 0, 255).reshape(n, tiles, tiles, 256)


def equalised(stack: np.ndarray, tiles: int = 8, clip: float = 2.0) -> np.ndarray:
    """Local contrast with a limit: every pixel takes its value from the tables of the four tiles around it, linear between their middles.

    Sides that aren't whole numbers of tiles are continued by reflection for the tables.
    """
    n, h, w = stack.shape
    wide = np.pad(stack, [(0, 0), (0, -h % tiles), (0, -w % tiles)], mode="symmetric")
    lut = tables(wide, tiles, clip)

    def around(size: int, tile: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (np.arange(size) + 0.5) / tile - 0.5
        low = np.floor(at).astype(int)
        return np.clip(low, 0, tiles - 1), np.clip(low + 1, 0, tiles - 1), at - low

    (y0, y1, fy), (x0, x1, fx) = around(h, wide.shape[1] / tiles), around(w, wide.shape[2] / tiles)
    fy, fx = fy[None, :, None], fx[None, None, :]
    which = np.arange(n)[:, None, None]
    value = lambda y, x: lut[which, y[None, :, None], x[None, None, :], stack]
    top = value(y0, x0) * (1 - fx) + value(y0, x1) * fx
    low = value(y1, x0) * (1 - fx) + value(y1, x1) * fx
    return np.clip(np.rint(top * (1 - fy) + low * fy), 0, 255).astype(np.uint8)


_CROP = StructType([StructField("pixels", BinaryType()), StructField("width", IntegerType())])


def changed(pixels: pd.Series, width: pd.Series, change: Callable[[np.ndarray], np.ndarray]) -> pd.DataFrame:
    """pixels and width of the crops after change, made in pieces that are small before and after it."""
    out: list[tuple] = [(None, None)] * len(pixels)
    for places, stack in stacks(pixels, width):
        at, step = 0, 1  # the first crop shows how large they become
        while at < len(stack):
            done = change(stack[at : at + step])
            for i, crop in zip(places[at : at + step].tolist(), done):
                out[i] = (crop.tobytes(), done.shape[2])
            at, step = at + step, max(1, PIECE // max(done[0].size, stack[0].size))
    return pd.DataFrame({"pixels": pd.Series([x for x, _ in out], dtype=object), "width": pd.Series([x for _, x in out], dtype="Int32")})


def mapped(pixels: Column | str, width: Column | str, change: Callable[[np.ndarray], np.ndarray]) -> Column:
    """struct<pixels, width> of the crops after change (a function of stacks); null for crops without a row."""

    _small_batches()

    @F.pandas_udf(_CROP)
    def run(p: pd.Series, w: pd.Series) -> pd.DataFrame:
        return changed(p, w, change)

    return run(pixels, width)


# --- made crops -----------------------------------------------------------------------------------

#: The digits as 7 rows of 5 dots each, top to bottom, a row as a number of five bits.
GLYPHS = {
    "0": (14, 17, 19, 21, 25, 17, 14),
    "1": (4, 12, 4, 4, 4, 4, 14),
    "2": (14, 17, 1, 2, 4, 8, 31),
    "3": (31, 2, 4, 2, 1, 17, 14),
    "4": (2, 6, 10, 18, 31, 2, 2),
    "5": (31, 16, 30, 1, 1, 17, 14),
    "6": (6, 8, 16, 30, 17, 17, 14),
    "7": (31, 1, 2, 4, 8, 8, 8),
    "8": (14, 17, 17, 14, 17, 17, 14),
    "9": (14, 17, 17, 15, 1, 2, 12),
}


def drawn(number: str) -> np.ndarray:
    """The digits of number as dots (1.0) with a dot between them and a margin of two; other characters are blanks."""
    cells = [np.array([[row >> (4 - k) & 1 for k in range(5)] for row in GLYPHS.get(d, (0,) * 7)], float) for d in number]
    line = np.concatenate([np.pad(c, ((0, 0), (0, 1))) for c in cells], axis=1)[:, :-1] if cells else np.zeros((7, 1))
    return np.pad(line, 2)


def rendered(number: str, seed: int, height: int = 32, width: int = 128, hard: bool = False) -> np.ndarray:
    """A grey crop of a number: ink on cloth, seen in perspective, blurred and noisy; the seed alone decides how."""
    rng = np.random.Generator(np.random.Philox(seed))
    much = 2.0 if hard else 1.0
    dots = drawn(number)
    cloth, ink = rng.uniform(170, 250), rng.uniform(5, 80)
    # the corners of the crop in the drawing, each moved a little: a projective map by its eight numbers
    square = np.array([(0, 0), (1, 0), (1, 1), (0, 1)], float)
    corner = square + rng.uniform(-0.06, 0.06, (4, 2)) * much
    rows, want = [], []
    for (x, y), (u, v) in zip(square, corner):
        rows += [(x, y, 1, 0, 0, 0, -u * x, -u * y), (0, 0, 0, x, y, 1, -v * x, -v * y)]
        want += [u, v]
    a = np.append(np.linalg.solve(np.array(rows), np.array(want)), 1.0).reshape(3, 3)
    y, x = np.meshgrid((np.arange(height) + 0.5) / height, (np.arange(width) + 0.5) / width, indexing="ij")
    u, v, z = np.tensordot(a, np.stack([x, y, np.ones_like(x)]), axes=1)
    px, py = np.floor(u / z * dots.shape[1]).astype(int), np.floor(v / z * dots.shape[0]).astype(int)
    inside = (px >= 0) & (px < dots.shape[1]) & (py >= 0) & (py < dots.shape[0])
    grey = np.where(inside & (dots[np.clip(py, 0, dots.shape[0] - 1), np.clip(px, 0, dots.shape[1] - 1)] > 0), ink, cloth)
    half = int(rng.integers(0, 2 + hard))
    for axis in (0, 1):  # a box blur
        padded = np.pad(grey, [(half, half) if k == axis else (0, 0) for k in (0, 1)], mode="edge")
        grey = sum(padded.take(range(k, k + grey.shape[axis]), axis) for k in range(2 * half + 1)) / (2 * half + 1)
    grey = grey * rng.uniform(0.8, 1.1) + rng.normal(0, rng.uniform(2, 10) * much, grey.shape)
    return np.clip(np.rint(grey), 0, 255).astype(np.uint8)


def synthetic(number: Column | str, key: Column | str, seed: int = 42, height: int = 32, width: int = 128, hard: bool = False) -> Column:
    """struct<pixels, width>: a made crop of each number, the same for a key and seed wherever the row is; null for a null number."""

    @F.pandas_udf(_CROP)
    def run(numbers: pd.Series, keys: pd.Series) -> pd.DataFrame:
        made = [None if n is None else rendered(n, int(k) % (1 << 63), height, width, hard).tobytes() for n, k in zip(numbers, keys)]
        return pd.DataFrame({"pixels": pd.Series(made, dtype=object), "width": pd.Series([None if m is None else width for m in made], dtype="Int32")})

    return run(number, F.xxhash64(F.lit(seed), key))
