"""Disparities of rectified image pairs by semi-global matching (after Hirschmueller): census costs, paths with two penalties, checks from both sides.

Each pair of images is one task (memory: pixels times disparities, whatever the number of pairs); within it all pixels of a line move at once in numpy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .images import KEY

CENSUS_HEIGHT, CENSUS_WIDTH = 7, 9
INVALID = -1


def census(image: np.ndarray) -> np.ndarray:
    """A bit for each pair of places of the window that lie opposite each other: whether the first is brighter. Borders are repeated."""
    h, w = CENSUS_HEIGHT // 2, CENSUS_WIDTH // 2
    wide = np.pad(image, ((h, h), (w, w)), mode="edge")
    at = lambda i, j: wide[h + i : h + i + image.shape[0], w + j : w + j + image.shape[1]]
    out = np.zeros(image.shape, np.int64)
    for i in range(-h, 1):
        for j in range(-w, w + 1):
            if i < 0 or j < 0:
                out = out << 1 | (at(i, j) > at(-i, -j))
    return out


def costs(left: np.ndarray, right: np.ndarray, disparities: int, least: int = 0) -> np.ndarray:
    """(height, width, disparity): differing census bits of a left pixel and the right one so far to the left; the largest cost where there is none."""
    a, b = census(left), census(right)
    bits = CENSUS_HEIGHT * CENSUS_WIDTH // 2
    out = np.full((*a.shape, disparities), bits, np.int32)
    for d in range(disparities):
        s = d + least
        if s < 0:
            out[:, :s, d] = np.bitwise_count(a[:, :s] ^ b[:, -s:])
        elif s < a.shape[1]:
            out[:, s:, d] = np.bitwise_count(a[:, s:] ^ b[:, : a.shape[1] - s])
    return out


def _along(cost: np.ndarray, dv: int, du: int, p1: int, p2: int) -> np.ndarray:
    """Least costs of paths in one direction: a step of one disparity costs p1, a larger one p2."""
    if dv == 0:
        return _along(cost.transpose(1, 0, 2), du, 0, p1, p2).transpose(1, 0, 2)
    out = np.empty_like(cost)
    rows = range(len(cost)) if dv > 0 else range(len(cost) - 1, -1, -1)
    last = None
    for v in rows:
        now = cost[v]
        if last is not None:
            before = last
            if du:
                before = np.roll(last, du, axis=0)
                before[0 if du > 0 else -1] = 0
            low = before.min(axis=1, keepdims=True)
            step = np.full_like(before, np.iinfo(np.int32).max - p1)
            step[:, 1:] = before[:, :-1]
            other = np.full_like(before, np.iinfo(np.int32).max - p1)
            other[:, :-1] = before[:, 1:]
            best = np.minimum(np.minimum(before, np.minimum(step, other) + p1), low + p2)
            now = now + best - low
        out[v] = last = now
    return out


def median3(image: np.ndarray) -> np.ndarray:
    wide = np.pad(image, 1, mode="edge")
    return np.median(np.stack([wide[i : i + image.shape[0], j : j + image.shape[1]] for i in range(3) for j in range(3)]), axis=0).astype(image.dtype)


def disparities_of(left: np.ndarray, right: np.ndarray, disparities: int = 64, p1: int = 10, p2: int = 120, uniqueness: float = 0.95, paths: int = 8, least: int = 0, difference: int = 1) -> np.ndarray:
    """Whole disparities; INVALID where the best is not clearly so (another one more than a step away costs less than the best / uniqueness) or the right image disagrees."""
    cost = costs(left, right, disparities, least)
    ways = [(0, 1), (0, -1), (1, 0), (-1, 0), (1, 1), (1, -1), (-1, 1), (-1, -1)][:paths]
    total = sum(_along(cost, dv, du, p1, p2) for dv, du in ways)
    best = total.argmin(axis=2)
    low = np.take_along_axis(total, best[:, :, None], axis=2)
    far = np.abs(np.arange(disparities) - best[:, :, None]) > 1
    unclear = (far & (total * uniqueness < low)).any(axis=2)
    # the right image's costs are the same ones along diagonals
    h, w = best.shape
    other = np.full((h, w, disparities), np.iinfo(np.int32).max, np.int32)
    for d in range(disparities):
        s = d + least
        if 0 <= s < w:
            other[:, : w - s, d] = total[:, s:, d]
        elif s < 0:
            other[:, -s:, d] = total[:, :s, d]
    mirrored = median3(other.argmin(axis=2))
    best = median3(best)
    there = np.arange(w) - (best + least)
    ok = (there >= 0) & (there < w)
    seen = np.take_along_axis(mirrored, np.clip(there, 0, w - 1), axis=1)
    out = best + least
    out[unclear | ~ok | (np.abs(seen - best) > difference)] = INVALID if least >= 0 else least - 1
    return out


def match(left: DataFrame, right: DataFrame, width: int, height: int, **options) -> DataFrame:
    """(img, v, u, disparity) of each pixel of each left image (img, v, u, c0) with the right one of the same img; absent pixels count as 0."""
    both = left.select(*KEY, F.col("c0").alias("l"), F.lit(0.0).alias("r")).unionByName(right.select(*KEY, F.lit(0.0).alias("l"), F.col("c0").alias("r")))
    merged = both.groupBy(*KEY).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        pair = np.zeros((2, height, width))
        pair[:, p["v"].to_numpy(int), p["u"].to_numpy(int)] = p[["l", "r"]].to_numpy().T
        found = disparities_of(*pair, **options)
        v, u = (x.reshape(-1) for x in np.indices(found.shape))
        return pd.DataFrame({"img": p["img"].iloc[0], "v": v, "u": u, "disparity": found.reshape(-1)})

    return merged.groupBy("img").applyInPandas(run, "img long, v int, u int, disparity int")
