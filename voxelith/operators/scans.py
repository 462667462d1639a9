"""Laser scans: frames with scan, step, range [, intensity], and one row of origin (16 numbers) for each scan."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def range_filter(df: DataFrame, low: float, high: float) -> DataFrame:
    """Ranges outside of the limits become null; the shape stays."""
    return df.withColumn("range", F.when(F.col("range").between(low, high), F.col("range")))


def scale(df: DataFrame, s: float) -> DataFrame:
    return df.withColumn("range", F.col("range") * float(s))


def move_origins(origins: DataFrame, m: np.ndarray) -> DataFrame:
    """Each scan's origin times a 4 x 4 matrix."""
    out = [sum((F.col("origin")[4 * i + k] * float(m[k, j]) for k in range(4)), F.lit(0.0)) for i in range(4) for j in range(4)]
    return origins.withColumn("origin", F.array(*out))


def to_points(df: DataFrame, angle_min: float, angle_increment: float, low: float = 0.0, high: float = float("inf"), origins: DataFrame | None = None) -> DataFrame:
    """Points (scan, step, x, y, z and intensity as gray) of the ranges within the limits."""
    a = F.lit(angle_min) + F.col("step") * angle_increment
    keep = df.where(F.col("range").isNotNull() & ~F.isnan("range") & (F.col("range") >= low) & (F.col("range") <= high))
    out = keep.withColumns({"x": F.col("range") * F.cos(a), "y": F.col("range") * F.sin(a), "z": F.lit(0.0)})
    if origins is not None:
        out = out.join(origins, "scan")
        new = {c: sum((F.col("origin")[4 * i + j] * F.col(n) for j, n in enumerate("xyz")), F.col("origin")[4 * i + 3]) for i, c in enumerate("xyz")}
        out = out.withColumns(new).drop("origin")
    return out.withColumns({c: F.col("intensity") for c in "rgb"}) if "intensity" in df.columns else out


def from_points(df: DataFrame, angle_increment: float, min_height: float, max_height: float, layers: int = 1, min_range: float = 0.0, max_range: float = float("inf"), angle_min: float = -math.pi, angle_max: float = math.pi, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, scan, step, range): for each cloud that the keys tell apart, per layer of height and step of angle the least distance from the z axis."""
    steps = math.ceil((angle_max - angle_min) / angle_increment)
    dz = (max_height - min_height) / layers
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    step = F.floor((F.atan2("y", "x") - angle_min) / angle_increment).cast("int")
    layer = F.floor((F.col("z") - min_height) / dz).cast("int")
    keep = df.select(*keys, layer.alias("scan"), step.alias("step"), r.alias("r"), "z").where((F.col("z") >= min_height) & (F.col("z") < max_height) & F.col("r").between(min_range, max_range) & F.col("step").between(0, steps - 1))
    return keep.groupBy(*keys, "scan", "step").agg(F.min("r").alias("range"))


def shadows_filter(df: DataFrame, steps: int, angle_increment: float, min_angle: float, max_angle: float, window: int = 1, neighbors: int = 0, remove_start: bool = False) -> DataFrame:
    """Ranges that look along a surface (the angle to a neighbour within the window is below or above the limits), and `neighbors` steps beside them, become null."""
    w = Window.partitionBy("scan").orderBy("step")
    shadow = F.lit(False)
    for d in [x for x in range(-window, window + 1) if x]:
        other = F.lead("range", d).over(w) if d > 0 else F.lag("range", -d).over(w)
        gap = abs(d) * angle_increment
        y, x = other * math.sin(gap), F.col("range") - other * math.cos(gap)
        t = F.atan2(F.abs(y), x)
        is_shadow = (t < min_angle) | (t > max_angle)
        shadow = shadow | F.coalesce(is_shadow & (F.col("range") > other if not remove_start else F.lit(True)), F.lit(False))
    marked = df.withColumn("s__", shadow)
    near = F.max(F.col("s__").cast("int")).over(w.rowsBetween(-neighbors, neighbors))
    return marked.withColumn("range", F.when(near == 1, F.lit(None)).otherwise(F.col("range"))).drop("s__")


def merge(a: DataFrame, b: DataFrame, capacity: int | None = None) -> DataFrame:
    """a's scans, then b's with their numbers moved up."""
    n = (a.agg(F.max("scan")).first()[0] if a is not None else None)
    shift = 0 if n is None else n + 1
    out = a.unionByName(b.withColumn("scan", F.col("scan") + shift))
    if capacity is not None and out.select("scan").distinct().count() > capacity:
        raise ValueError("more scans than there is room for")
    return out


def latest(df: DataFrame, capacity: int) -> DataFrame:
    """What a ring of that many scans holds: those with the highest numbers."""
    top = df.select("scan").distinct().orderBy(F.desc("scan")).limit(capacity)
    return df.join(top, "scan", "left_semi")


def pop_one(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The oldest scan, and the rest."""
    first = df.agg(F.min("scan")).first()[0]
    return df.where(F.col("scan") == first), df.where(F.col("scan") != first)
