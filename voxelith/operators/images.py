"""Images as pixel frames: img, v (row), u (column) and c0 [, c1, c2]; width and height are plain numbers."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["img", "v", "u"]

#: Filter taps.
GAUSSIAN3 = (0.25, 0.5, 0.25)
GAUSSIAN5 = (0.0625, 0.25, 0.375, 0.25, 0.0625)
GAUSSIAN7 = (0.03125, 0.109375, 0.21875, 0.28125, 0.21875, 0.109375, 0.03125)
SOBEL_SMOOTH, SOBEL_SLOPE = (1.0, 2.0, 1.0), (-1.0, 0.0, 1.0)
GRAY = (0.299, 0.587, 0.114)


def clip_intensity(df: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    return df.withColumn("c0", F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), F.col("c0"))))


def linear_transform(df: DataFrame, scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    return df.withColumn("c0", F.col("c0") * float(scale) + float(offset))


def depth_to_float(df: DataFrame, scale: float = 1000.0, trunc: float = 3.0) -> DataFrame:
    """Depth in metres, 0 beyond the truncation; both parameters are taken as whole numbers."""
    d = F.col("c0") / float(int(scale))
    return df.withColumn("c0", F.when(d >= int(trunc), F.lit(0.0)).otherwise(d))


def gray(df: DataFrame, weighted: bool = True) -> DataFrame:
    w = GRAY if weighted else (1 / 3,) * 3
    return df.select(*KEY, (F.col("c0") * w[0] + F.col("c1") * w[1] + F.col("c2") * w[2]).alias("c0"))


def to_float(df: DataFrame, scale: float = 1 / 255) -> DataFrame:
    return df.withColumns({c: F.col(c) * scale for c in ("c0", "c1", "c2") if c in df.columns})


def from_float(df: DataFrame, scale: float = 255.0, kind: str = "int") -> DataFrame:
    return df.withColumns({c: (F.col(c) * scale).cast(kind) for c in ("c0", "c1", "c2") if c in df.columns})


def transpose(df: DataFrame) -> DataFrame:
    return df.select("img", F.col("u").alias("v"), F.col("v").alias("u"), *[c for c in df.columns if c not in KEY])


def flip_vertical(df: DataFrame, height: int) -> DataFrame:
    return df.withColumn("v", F.lit(height - 1) - F.col("v"))


def flip_horizontal(df: DataFrame, width: int) -> DataFrame:
    return df.withColumn("u", F.lit(width - 1) - F.col("u"))


def inside(u: Column, v: Column, width: int, height: int, margin: float = 0.0) -> Column:
    return (u >= margin) & (u < width - margin) & (v >= margin) & (v < height - margin)


def value_at(points: DataFrame, df: DataFrame, width: int, height: int) -> DataFrame:
    """(id, value) by bilinear interpolation at points (id, img, pu, pv); null outside."""
    u, v = F.floor("pu").cast("int"), F.floor("pv").cast("int")
    ok = (F.col("pu") >= 0) & (F.col("pu") <= width - 1) & (F.col("pv") >= 0) & (F.col("pv") <= height - 1)
    base = points.where(ok).withColumns({"u0": F.greatest(F.least(u, F.lit(width - 2)), F.lit(0)), "v0": F.greatest(F.least(v, F.lit(height - 2)), F.lit(0))})
    p, q = F.col("pu") - F.col("u0"), F.col("pv") - F.col("v0")
    taps = [F.struct((F.col("u0") + i).alias("u"), (F.col("v0") + j).alias("v"), ((p if i else 1 - p) * (q if j else 1 - q)).alias("w")) for i in (0, 1) for j in (0, 1)]
    each = base.select("id", "img", F.explode(F.array(*taps)).alias("t")).select("id", "img", "t.u", "t.v", "t.w")
    found = each.join(df, KEY).groupBy("id").agg(F.sum(F.col("w") * F.col("c0")).alias("value"))
    return points.select("id").join(found, "id", "left")


def downsample(df: DataFrame, width: int, height: int) -> DataFrame:
    """Means of two by two pixels; a last odd row or column is left out."""
    small = df.where((F.col("u") < width // 2 * 2) & (F.col("v") < height // 2 * 2))
    return small.groupBy("img", F.expr("v div 2").cast("int").alias("v"), F.expr("u div 2").cast("int").alias("u")).agg(*[F.avg(c).alias(c) for c in df.columns if c not in KEY])


def _spread(df: DataFrame, axis: str, taps: Sequence[float], size: int) -> DataFrame:
    """Correlation along one axis, the border pixel repeated: each pixel goes to all that have it under a tap, and these sum up."""
    r = len(taps) // 2
    # the first and last pixels stand for those beyond the border too
    pos = F.col(axis)
    target = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("w")) for i, w in enumerate(taps)])).alias("t")
    inner = df.select("*", target).withColumn("to__", pos - (F.col("t.i") - r)).where((F.col("to__") >= 0) & (F.col("to__") < size))
    parts = inner.select(*[F.col("to__").alias(k) if k == axis else F.col(k) for k in KEY], (F.col("c0") * F.col("t.w")).alias("c0"))
    for edge, side in ((0, -1), (size - 1, 1)):
        # targets near the border read the edge pixel once for each tap that falls outside
        outside = [(edge - side * d, sum(float(taps[i]) for i in range(len(taps)) if (edge - side * d + i - r) * side > edge * side)) for d in range(r) if 0 <= edge - side * d < size]
        outside = [(t, w) for t, w in outside if w]
        if outside:
            more = df.where(pos == edge).select("*", F.explode(F.array(*[F.struct(F.lit(t).alias("to"), F.lit(w).alias("w")) for t, w in outside])).alias("t"))
            parts = parts.unionByName(more.select(*[F.col("t.to").alias(k) if k == axis else F.col(k) for k in KEY], (F.col("c0") * F.col("t.w")).alias("c0")))
    return parts.groupBy(*KEY).agg(F.sum("c0").alias("c0"))


def filter_horizontal(df: DataFrame, kernel: Sequence[float], width: int) -> DataFrame:
    if len(kernel) % 2 == 0:
        raise ValueError("the kernel needs an odd number of taps")
    return _spread(df, "u", kernel, width)


def filter_separable(df: DataFrame, dx: Sequence[float], dy: Sequence[float], width: int, height: int) -> DataFrame:
    return _spread(_spread(df, "u", dx, width), "v", dy, height)


def gaussian(df: DataFrame, width: int, height: int, taps: Sequence[float] = GAUSSIAN3) -> DataFrame:
    return filter_separable(df, taps, taps, width, height)


def sobel(df: DataFrame, width: int, height: int, axis: str = "x") -> DataFrame:
    dx, dy = (SOBEL_SLOPE, SOBEL_SMOOTH) if axis == "x" else (SOBEL_SMOOTH, SOBEL_SLOPE)
    return filter_separable(df, dx, dy, width, height)


def pyramid(df: DataFrame, width: int, height: int, levels: int, smooth: bool = True) -> list[tuple[DataFrame, int, int]]:
    out = [(df, width, height)]
    for _ in range(levels - 1):
        d, w, h = out[-1]
        out.append((downsample(gaussian(d, w, h) if smooth else d, w, h), w // 2, h // 2))
    return out


#: Rows of an image that are smoothed together.
BAND = 64


def bilateral(df: DataFrame, width: int, height: int, diameter: int, sigma_color: float, sigma_space: float) -> DataFrame:
    """Means weighted by nearness in place and value over a square of 2 * diameter + 1 pixels; pixels beyond the border don't count."""
    import pyarrow as pa

    def smooth(key: tuple, rows: pa.Table) -> pa.Table:
        v, u, gone = rows["v"].to_numpy().astype(np.int64), rows["u"].to_numpy().astype(np.int64), rows["c0"].is_null().to_numpy()
        c0 = rows["c0"].to_numpy().astype(float)
        line = int(np.ptp(u)) + 2 * diameter + 1
        place = (v - v.min()) * line + u - u.min()
        order = np.argsort(place, kind="stable")
        place, c0, gone = place[order], c0[order], gone[order]
        top, total = np.zeros(len(c0)), np.zeros(len(c0))
        for i in range(-diameter, diameter + 1):
            for j in range(-diameter, diameter + 1):
                at, end = (np.searchsorted(place, place + i * line + j, side) for side in ("left", "right"))
                while len(own := np.flatnonzero(at < end)):  # once, unless a pixel is there more than once
                    x = c0[at[own]]
                    w = np.where(gone[at[own]], 0.0, math.exp(-(i * i + j * j) / (2 * sigma_space**2)) * np.exp(-(x - c0[own]) * (x - c0[own]) / (2 * sigma_color**2)))
                    top[own] += np.where(gone[at[own]], 0.0, w * x)
                    total[own] += w
                    at = at + 1
        # a pixel that is there more than once gets the mean over all of them
        first = np.flatnonzero(np.diff(place, prepend=-1))
        top, total = (np.add.reduceat(np.where(gone, 0.0, x), first) for x in (top, total))
        gone = np.logical_and.reduceat(gone, first)
        inner = v[order][first] // BAND == key[1].as_py()
        first = first[inner]
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = (top / total)[inner]
        gone = gone[inner]
        rows = rows.take(pa.array(order[first]))
        return pa.table({"img": rows["img"], "v": rows["v"], "u": rows["u"], "c0": pa.array(mean, mask=gone)})

    # bands of rows, each with the rows next to it
    bands = F.array_distinct(F.array(*[F.floor((F.col("v") + d) / BAND).cast("long") for d in (-diameter, 0, diameter)])) if diameter <= BAND else F.sequence(F.floor((F.col("v") - diameter) / BAND).cast("long"), F.floor((F.col("v") + diameter) / BAND).cast("long"))
    spread = df.where("img is not null and v is not null and u is not null").select(*KEY, "c0", F.explode(bands).alias("band__"))
    kinds = dict(df.dtypes)
    return spread.groupBy("img", "band__").applyInArrow(smooth, ", ".join([*[f"{k} {kinds[k]}" for k in KEY], "c0 double"]))


# Depth cameras


def back_project(df: DataFrame, k: np.ndarray, extrinsic: np.ndarray | None = None, depth_scale: float = 1000.0, depth_trunc: float = 1000.0, stride: int = 1) -> DataFrame:
    """Points (id, x, y, z and the other columns) of the pixels that have a depth c0 within the truncation."""
    m = np.linalg.inv(np.eye(4) if extrinsic is None else extrinsic)
    d = F.col("c0") / float(depth_scale)
    seen = df.where((F.col("u") % stride == 0) & (F.col("v") % stride == 0)).withColumn("d__", d).where((F.col("d__") > 0) & (F.col("d__") <= depth_trunc))
    x, y = (F.col("u") - float(k[0, 2])) * F.col("d__") / float(k[0, 0]), (F.col("v") - float(k[1, 2])) * F.col("d__") / float(k[1, 1])
    own = [x, y, F.col("d__")]
    place = [sum((float(m[i, j]) * own[j] for j in range(3)), F.lit(float(m[i, 3]))) for i in range(3)]
    return seen.select("img", "v", "u", *[p.alias(c) for p, c in zip(place, "xyz")], *[c for c in df.columns if c not in (*KEY, "c0")])


def rgbd(color: DataFrame, depth: DataFrame, scale: float = 1000.0, trunc: float = 3.0, intensity: bool = True) -> DataFrame:
    """Pixels with depth in metres and colour or intensity 0 to 1."""
    d = depth_to_float(depth, scale, trunc).select(*KEY, F.col("c0").alias("depth"))
    c = to_float(color)
    c = gray(c).withColumnRenamed("c0", "intensity") if intensity else c.select(*KEY, F.col("c0").alias("r"), F.col("c1").alias("g"), F.col("c2").alias("b"))
    return c.join(d, KEY)


def sun_depth(raw: Column) -> Column:
    """16 bits rotated right by three."""
    return F.shiftright(raw, 3).bitwiseOR(F.shiftleft(raw, 13)).bitwiseAND(F.lit(0xFFFF))


def nyu_depth(raw: Column) -> Column:
    """Bytes swapped, then the sensor's curve; 0 where it has none."""
    swapped = F.shiftright(raw, 8).bitwiseAND(F.lit(0xFF)).bitwiseOR(F.shiftleft(raw.bitwiseAND(F.lit(0xFF)), 8))
    d = F.lit(351.3) / (F.lit(1092.5) - swapped)
    return F.when((d <= 0) | (d > 10), F.lit(0.0)).otherwise(d)


def from_disparity(df: DataFrame, left: np.ndarray, right: np.ndarray, baseline: float) -> DataFrame:
    """Points of the pixels with a disparity c0."""
    f, cx, cy, other = float(left[0, 0]), float(left[0, 2]), float(left[1, 2]), float(right[0, 2])
    z = f * baseline / (F.col("c0") - (cx - other))
    return df.where((F.col("c0") - (cx - other)) > 0).select(*KEY, ((F.col("u") - cx) * z / f).alias("x"), ((F.col("v") - cy) * z / f).alias("y"), z.alias("z"))


def distance_multiplier(spark, k: np.ndarray, width: int, height: int) -> DataFrame:
    """Per pixel the length of its viewing ray at depth one."""
    p = spark.range(width * height).select((F.col("id") / width).cast("int").alias("v"), (F.col("id") % width).cast("int").alias("u"))
    x, y = (F.col("u") - float(k[0, 2])) / float(k[0, 0]), (F.col("v") - float(k[1, 2])) / float(k[1, 1])
    return p.select("v", "u", F.sqrt(x * x + y * y + 1).alias("m"))
