"""Voxel and occupancy grids: frames keyed by ix, iy, iz, with size and origin as plain numbers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.spatial import XYZ
from .points import COLOR, has, linear, voxel_keys

KEYS = ["ix", "iy", "iz"]
HIT, MISS, LOW, HIGH, THRESHOLD = 0.85, -0.4, -2.0, 3.5, 0.0


def _least(df: DataFrame) -> list[float]:
    r = df.agg(*[F.min(c).alias(c) for c in XYZ]).first()
    return [r[c] or 0.0 for c in XYZ]


def from_points(df: DataFrame, size: float, low: Sequence[float] | None = None) -> DataFrame:
    """One voxel for each cell that has points, with their mean colour; cells start at `low` (half a voxel below the least corner).

    There is no upper bound, and keys may be negative if low is given.
    """
    low = [v - size / 2 for v in _least(df)] if low is None else low
    return df.groupBy(*voxel_keys(df, size, low)).agg(*([F.avg(c).alias(c) for c in COLOR] if has(df, COLOR) else [F.lit(0.0).alias(c) for c in COLOR]))


def dense(spark, size: float, extent: Sequence[float]) -> DataFrame:
    """All cells of a box."""
    w, h, d = (round(v / size) for v in extent)
    i = spark.range(w * h * d)
    return i.select((F.col("id") / (h * d)).cast("int").alias("ix"), ((F.col("id") / d).cast("long") % h).cast("int").alias("iy"), (F.col("id") % d).cast("int").alias("iz"))


def centers(df: DataFrame, size: float, origin: Sequence[float]) -> DataFrame:
    return df.withColumns({c: (F.col(k) + 0.5) * size + float(origin[i]) for i, (c, k) in enumerate(zip(XYZ, KEYS))})


def bounding_points(df: DataFrame, size: float, origin: Sequence[float]) -> DataFrame:
    """The eight corners of each voxel."""
    corner = F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"d{j}") for j, v in enumerate((c >> 2 & 1, c >> 1 & 1, c & 1))], F.lit(c).alias("corner")) for c in range(8)]))
    out = df.select(*KEYS, corner.alias("c"))
    return out.select(*KEYS, F.col("c.corner").alias("corner"), *[((F.col(k) + F.col(f"c.d{j}")) * size + float(origin[j])).alias(c) for j, (c, k) in enumerate(zip(XYZ, KEYS))])


def grid_bounds(df: DataFrame, size: float, origin: Sequence[float]) -> DataFrame:
    return df.agg(*[(F.min(k) * size + float(origin[i])).alias(f"min_{c}") for i, (c, k) in enumerate(zip(XYZ, KEYS))], *[((F.max(k) + 1) * size + float(origin[i])).alias(f"max_{c}") for i, (c, k) in enumerate(zip(XYZ, KEYS))])


def grid_center(df: DataFrame, size: float, origin: Sequence[float]) -> DataFrame:
    return df.agg(*[(F.avg(F.col(k) + 0.5) * size + float(origin[i])).alias(c) for i, (c, k) in enumerate(zip(XYZ, KEYS))])


def included(queries: DataFrame, voxels: DataFrame, size: float, origin: Sequence[float]) -> DataFrame:
    """(id, included) of each query point."""
    keyed = queries.select("id", *voxel_keys(queries, size, origin))
    return keyed.join(voxels.select(*KEYS).distinct().withColumn("hit", F.lit(True)), KEYS, "left").select("id", F.coalesce("hit", F.lit(False)).alias("included"))


def add(voxels: DataFrame, more: DataFrame) -> DataFrame:
    """Voxels with those added that are new; what is there stays."""
    names = [c for c in voxels.columns if c not in KEYS]
    both = voxels.withColumn("p__", F.lit(0)).unionByName(more.select(*voxels.columns).withColumn("p__", F.lit(1)))
    return both.groupBy(*KEYS).agg(F.min(F.struct("p__", *names)).alias("v")).select(*KEYS, *[f"v.{c}" for c in names])


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Voxels of both grids (of one size and origin); where both have one, the mean colour."""
    return a.unionByName(b).groupBy(*KEYS).agg(*[F.avg(c).alias(c) for c in COLOR])


def select(voxels: DataFrame, index: DataFrame, invert: bool = False) -> DataFrame:
    return voxels.join(index.select(*KEYS).distinct(), KEYS, "left_anti" if invert else "left_semi")


def project(df: DataFrame, k: np.ndarray, extrinsic: np.ndarray) -> DataFrame:
    """df with camera depth d and pixel u, v (null behind the camera)."""
    cx, cy, cz = linear(extrinsic[:3, :3], XYZ, extrinsic[:3, 3])
    out = df.withColumns({"cx__": cx, "cy__": cy, "d": cz})
    front = F.col("d") > 0
    return out.withColumns({"u": F.when(front, F.floor(F.col("cx__") * float(k[0, 0]) / F.col("d") + float(k[0, 2])).cast("int")), "v": F.when(front, F.floor(F.col("cy__") * float(k[1, 1]) / F.col("d") + float(k[1, 2])).cast("int"))}).drop("cx__", "cy__")


def carve(voxels: DataFrame, pixels: DataFrame, k: np.ndarray, extrinsic: np.ndarray, size: float, origin: Sequence[float], keep_outside: bool = False) -> DataFrame:
    """Voxels of which some corner lies at or behind the depth of its pixel (v, u, c0), or outside of the image if that is to be kept.

    With several images (img) of one camera a voxel has to stay in all of them.
    """
    corners = project(bounding_points(voxels, size, origin), k, extrinsic)
    several = "img" in pixels.columns
    if several:
        images = pixels.select("img").distinct()
        corners = corners.crossJoin(F.broadcast(images)) if keep_outside else corners  # one row an image
    on = ["img", "v", "u"] if several and keep_outside else ["v", "u"]
    seen = corners.join(pixels.select(*(["img"] if several else []), "v", "u", "c0"), on, "left")
    stays = F.when(F.col("c0").isNull(), F.lit(keep_outside)).otherwise((F.col("c0") > 0) & (F.col("d") >= F.col("c0")))
    if several:
        n = images.count()
        each = seen.where("img is not null").groupBy(*KEYS, "img").agg(F.bool_or(stays).alias("keep")).where("keep")
        keep = each.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == n).select(*KEYS)
    else:
        keep = seen.groupBy(*KEYS).agg(F.bool_or(stays).alias("keep")).where("keep").select(*KEYS)
    return voxels.join(keep, KEYS, "left_semi")


# Occupancy: absent means unknown


def updated(grid: DataFrame | None, events: DataFrame, key: Sequence[str] = KEYS) -> DataFrame:
    """Log-odds after hits and misses: events have ix, iy, iz and occupied; all misses count before all hits, each clamped."""
    counts = events.groupBy(*key).agg(F.sum((~F.col("occupied")).cast("int")).alias("misses"), F.sum(F.col("occupied").cast("int")).alias("hits"))
    before = counts.withColumn("prob_log", F.lit(None).cast("double")) if grid is None else grid.select(*key, "prob_log").join(counts, list(key), "full")
    p = F.coalesce("prob_log", F.lit(0.0))
    # steps of one sign clamp as their sum does
    p = F.greatest(F.lit(LOW), p + MISS * F.coalesce("misses", F.lit(0)))
    p = F.least(F.lit(HIGH), p + HIT * F.coalesce("hits", F.lit(0)))
    touched = F.col("misses").isNotNull()
    return before.select(*key, F.when(touched, p).otherwise(F.col("prob_log")).alias("prob_log"))


def known(grid: DataFrame) -> DataFrame:
    return grid.where(F.col("prob_log").isNotNull())


def occupied(grid: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return grid.where(F.col("prob_log") > threshold)


def free(grid: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return grid.where(F.col("prob_log") <= threshold)


def state_of(queries: DataFrame, grid: DataFrame, size: float, origin: Sequence[float], threshold: float = THRESHOLD) -> DataFrame:
    """(id, occupied, unknown) of each query point."""
    keyed = queries.select("id", *voxel_keys(queries, size, origin))
    return keyed.join(grid.select(*KEYS, "prob_log"), KEYS, "left").select("id", F.coalesce(F.col("prob_log") > threshold, F.lit(False)).alias("occupied"), F.col("prob_log").isNull().alias("unknown"))


def traverse(start: np.ndarray, end: np.ndarray, size: float) -> np.ndarray:
    """Cells from start's up to, but without, end's; each step crosses the nearest face, which is reckoned half a cell from the cell's corner in the direction of travel."""
    now, last = np.floor(start / size).astype(int), np.floor(end / size).astype(int)
    ray = end - start
    step = np.sign(ray).astype(int)
    with np.errstate(divide="ignore", invalid="ignore"):
        ahead = np.where(step != 0, ((now + 0.5 * step) * size - start) / ray, np.inf)
        stride = np.where(step != 0, size / np.abs(ray), np.inf)
    out = []
    for _ in range(int(np.abs(last - now).sum()) + 3):
        if (now == last).all():
            break
        out.append(now.copy())
        i = int(np.argmin(ahead))
        now[i] += step[i]
        ahead[i] += stride[i]
    return np.array(out).reshape(-1, 3)


def insert(grid: DataFrame | None, points: DataFrame, viewpoint: Sequence[float], size: float, max_range: float = -1.0) -> DataFrame:
    """The grid after a scan: cells that rays cross are missed once, cells that points lie in are hit once; a hit cell isn't missed.

    Points farther than max_range (if positive) are drawn in to it and hit nothing.
    """
    view = np.asarray(viewpoint, float)
    d = F.sqrt(sum(((F.col(c) - float(v)) * (F.col(c) - float(v)) for c, v in zip(XYZ, view)), F.lit(0.0)))
    share = F.when((F.lit(max_range) > 0) & (d > max_range), F.lit(max_range) / d).otherwise(F.lit(1.0))
    ends = points.select(d.alias("d"), share.alias("s"), *XYZ).select(*[((F.col(c) - float(v)) * F.col("s") + float(v)).alias(c) for c, v in zip(XYZ, view)], (F.col("s") == 1.0).alias("hit"))

    def rays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            cells = [traverse(view, e, size) for e in p[list(XYZ)].to_numpy()]
            cells = np.unique(np.concatenate(cells), axis=0) if cells else np.zeros((0, 3), int)
            yield pd.DataFrame(cells.astype(np.int32), columns=KEYS)

    hit = ends.where("hit").select(*voxel_keys(ends, size, [0.0] * 3)).distinct()
    missed = ends.mapInPandas(rays, "ix int, iy int, iz int").distinct().join(hit, KEYS, "left_anti")
    return updated(grid, missed.withColumn("occupied", F.lit(False)).unionByName(hit.withColumn("occupied", F.lit(True))))


def set_free_area(grid: DataFrame | None, spark, low: Sequence[float], high: Sequence[float], size: float) -> DataFrame:
    """Adds a miss, not clamped, to each cell of a box."""
    cells = spark.range(1)
    for c, k, a, b in zip(XYZ, KEYS, low, high):
        cells = cells.withColumn(k, F.explode(F.sequence(F.lit(int(np.floor(a / size))), F.lit(int(np.floor(b / size))))))
    cells = cells.select(*KEYS, F.lit(True).alias("inside"))
    if grid is None:
        return cells.select(*KEYS, F.lit(MISS).alias("prob_log"))
    both = grid.select(*KEYS, "prob_log").join(cells, KEYS, "full")
    return both.select(*KEYS, F.when(F.col("inside"), F.coalesce("prob_log", F.lit(0.0)) + MISS).otherwise(F.col("prob_log")).alias("prob_log"))


def points_of(grid: DataFrame, size: float, origin: Sequence[float] = (0.0, 0.0, 0.0), threshold: float = THRESHOLD) -> DataFrame:
    """Centres of the occupied cells."""
    return centers(occupied(grid, threshold), size, origin)


def voxels_of(grid: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Occupied cells as voxels; colours are kept where there are any."""
    kept = occupied(grid, threshold)
    return kept.select(*KEYS, *[F.col(c) if c in grid.columns else F.lit(0.0).alias(c) for c in COLOR])


def occupancy_of(voxels: DataFrame) -> DataFrame:
    """An occupancy grid in which each voxel was hit once."""
    return voxels.select(*KEYS, F.lit(HIT).alias("prob_log"))


def tracked_bounds(grid: DataFrame, size: float, origin: Sequence[float] = (0.0, 0.0, 0.0)) -> DataFrame:
    return grid_bounds(known(grid), size, origin)


def paint(voxels: DataFrame, index: DataFrame, color: Sequence[float]) -> DataFrame:
    """Listed voxels get a colour."""
    marked = voxels.join(index.select(*KEYS).distinct().withColumn("m__", F.lit(True)), KEYS, "left")
    return marked.withColumns({c: F.when(F.col("m__"), F.lit(float(v))).otherwise(F.col(c)) for c, v in zip(COLOR, color)}).drop("m__")


def collide_occupied(grid: DataFrame, other: DataFrame, size: float, other_size: float, origin: Sequence[float], other_origin: Sequence[float], margin: float = 0.0, threshold: float = THRESHOLD) -> DataFrame:
    """Voxels of `other` that touch an occupied cell, with the least such cell."""
    return collide_voxels(occupied(grid, threshold), other, size, other_size, origin, other_origin, margin)


def collide_capsules(voxels: DataFrame, capsules: DataFrame, size: float, origin: Sequence[float]) -> DataFrame:
    """(pid, ix, iy, iz) of the least voxel that each capsule (pid, x0 .. z0, x1 .. z1, radius) touches."""
    # the part of the segment (from from__ to till__ of its length) near each layer of cells tells which cells of the next axis count; a little wider than
    # the capsule, as these bounds are rounded
    far = F.greatest(*[F.abs(f"{c}{n}") for c in XYZ for n in (0, 1)])
    q = capsules.withColumns({"wide__": F.col("radius") + 1e-6 * size + 1e-9 * far, "from__": F.lit(0.0), "till__": F.lit(1.0)})
    for i, (c, k) in enumerate(zip(XYZ, KEYS)):
        d = F.col(f"{c}1") - F.col(f"{c}0")
        ends = [F.col(f"{c}0") + F.col(t) * d for t in ("from__", "till__")]
        low = F.floor((F.least(*ends) - F.col("wide__") - float(origin[i])) / size).cast("int")
        high = F.floor((F.greatest(*ends) + F.col("wide__") - float(origin[i])) / size).cast("int")
        q = q.withColumn(k, F.explode(F.sequence(low, high)))
        at = [(F.col(k) * size + float(origin[i]) - F.col("wide__") - F.col(f"{c}0")) / F.nullif(d, F.lit(0.0)), ((F.col(k) + 1) * size + float(origin[i]) + F.col("wide__") - F.col(f"{c}0")) / F.nullif(d, F.lit(0.0))]
        q = q.withColumns({"from__": F.when(d == 0, F.col("from__")).otherwise(F.greatest(F.col("from__"), F.least(*at))), "till__": F.when(d == 0, F.col("till__")).otherwise(F.least(F.col("till__"), F.greatest(*at)))}).where("from__ <= till__")
    near = q.select("pid", *[f"{c}{n}" for n in (0, 1) for c in XYZ], "radius", *KEYS).join(voxels.select(*KEYS), KEYS)

    def touched(batches):

        for b in batches:
            p, end, r, low = b[[f"{c}0" for c in XYZ]].to_numpy(float), b[[f"{c}1" for c in XYZ]].to_numpy(float), b["radius"].to_numpy(float), b[list(KEYS)].to_numpy() * size + np.asarray(origin, float)
            hit = b.loc[capsules_boxes(r, p, end - p, low, low + size), ["pid", *KEYS]].sort_values(list(KEYS))
            yield pd.DataFrame(hit.drop_duplicates("pid"))

    kind = near.schema["pid"].dataType.simpleString()
    hit = near.mapInPandas(touched, f"pid {kind}, ix int, iy int, iz int")
    return hit.groupBy("pid").agg(F.min(F.struct(*KEYS)).alias("v")).select("pid", "v.ix", "v.iy", "v.iz")


def capsules_boxes(radius: np.ndarray, p: np.ndarray, d: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int = 48) -> np.ndarray:
    """predicates.capsule_aabb for rows of arrays, with the same steps and roundings."""

    def gaps(t: np.ndarray) -> list[np.ndarray]:
        out = []
        for i in range(3):
            x = p[:, i] + t * d[:, i]
            out.append(np.where(x > high[:, i], x - high[:, i], np.where(x < low[:, i], x - low[:, i], 0.0)))
        return out

    start, stop = np.zeros(len(p)), np.ones(len(p))
    for _ in range(steps):
        m = (start + stop) / 2
        g = gaps(m)
        up = g[0] * d[:, 0] + g[1] * d[:, 1] + g[2] * d[:, 2] > 0
        start, stop = np.where(up, start, m), np.where(up, m, stop)
    g = gaps((start + stop) / 2)
    return g[0] * g[0] + g[1] * g[1] + g[2] * g[2] <= radius * radius + 1e-12


def linear_index(ix: Column, iy: Column, iz: Column, resolution: int) -> Column:
    """Row-major place in a cube of cells whose centre is the origin; -1 outside."""
    h = resolution // 2
    inside = F.lit(True)
    for i in (ix, iy, iz):
        inside = inside & (i + h >= 0) & (i + h < resolution)
    return F.when(inside, ((ix + h) * resolution + (iy + h)) * resolution + (iz + h)).otherwise(F.lit(-1))


# Collisions: for each query the least partner


def collide_voxels(a: DataFrame, b: DataFrame, size_a: float, size_b: float, origin_a: Sequence[float], origin_b: Sequence[float], margin: float = 0.0) -> DataFrame:
    """(bx, by, bz, ax, ay, az) for each voxel of b that touches one of a, grown by the margin."""
    reach = []
    for i, k in enumerate(KEYS):
        low = (F.col(k) * size_b + float(origin_b[i]) - margin - float(origin_a[i])) / size_a
        high = ((F.col(k) + 1) * size_b + float(origin_b[i]) + margin - float(origin_a[i])) / size_a
        # closed boxes: a voxel that only touches counts
        reach.append((F.ceil(low - 1).cast("int"), F.floor(high).cast("int")))
    q = b.select(*[F.col(k).alias(n) for k, n in zip(KEYS, ("bx", "by", "bz"))], *[F.sequence(x, y).alias(f"s{i}") for i, (x, y) in enumerate(reach)])
    for i, k in enumerate(KEYS):
        q = q.withColumn(k, F.explode(f"s{i}"))
    found = q.select("bx", "by", "bz", *KEYS).join(a.select(*KEYS), KEYS)
    return found.groupBy("bx", "by", "bz").agg(F.min(F.struct(*KEYS)).alias("a")).select("bx", "by", "bz", F.col("a.ix").alias("ax"), F.col("a.iy").alias("ay"), F.col("a.iz").alias("az"))


def collide_spheres(voxels: DataFrame, spheres: DataFrame, size: float, origin: Sequence[float]) -> DataFrame:
    """(pid, ix, iy, iz) of the least voxel that each sphere (pid, x, y, z, radius) touches."""
    q = spheres
    for i, (c, k) in enumerate(zip(XYZ, KEYS)):
        low = F.floor((F.col(c) - F.col("radius") - float(origin[i])) / size).cast("int")
        high = F.floor((F.col(c) + F.col("radius") - float(origin[i])) / size).cast("int")
        q = q.withColumn(k, F.explode(F.sequence(low, high)))
    near = q.join(voxels.select(*KEYS), KEYS)
    d2 = F.lit(0.0)
    for i, (c, k) in enumerate(zip(XYZ, KEYS)):
        a, b = F.col(k) * size + float(origin[i]), (F.col(k) + 1) * size + float(origin[i])
        g = F.greatest(a - F.col(c), F.lit(0.0), F.col(c) - b)
        d2 = d2 + g * g
    return near.where(d2 <= F.col("radius") * F.col("radius")).groupBy("pid").agg(F.min(F.struct(*KEYS)).alias("v")).select("pid", "v.ix", "v.iy", "v.iz")


def segment_hits_box(a: Sequence[Column], b: Sequence[Column], low: Sequence[Column], high: Sequence[Column]) -> Column:
    """Whether the segment from a to b meets a box: the interval of parameters inside all three slabs is not empty."""
    enter, leave, ok = F.lit(0.0), F.lit(1.0), F.lit(True)
    for p, q, lo, hi in zip(a, b, low, high):
        d = q - p
        t0, t1 = (lo - p) / F.nullif(d, F.lit(0.0)), (hi - p) / F.nullif(d, F.lit(0.0))
        enter = F.greatest(enter, F.least(t0, t1))  # nulls (parallel to the slab) are skipped
        leave = F.least(leave, F.greatest(t0, t1))
        ok = ok & ((d != 0) | ((p >= lo) & (p <= hi)))
    return ok & (enter <= leave)


def collide_lines(voxels: DataFrame, lines: DataFrame, size: float, origin: Sequence[float]) -> DataFrame:
    """(lid, ix, iy, iz) of the least voxel that each segment (lid, x0 .. z0, x1 .. z1) meets."""
    q = lines
    for i, (c, k) in enumerate(zip(XYZ, KEYS)):
        low = F.floor((F.least(f"{c}0", f"{c}1") - float(origin[i])) / size).cast("int")
        high = F.floor((F.greatest(f"{c}0", f"{c}1") - float(origin[i])) / size).cast("int")
        q = q.withColumn(k, F.explode(F.sequence(low, high)))
    near = q.join(voxels.select(*KEYS), KEYS)
    low = [F.col(k) * size + float(origin[i]) for i, k in enumerate(KEYS)]
    high = [(F.col(k) + 1) * size + float(origin[i]) for i, k in enumerate(KEYS)]
    hit = segment_hits_box([F.col(f"{c}0") for c in XYZ], [F.col(f"{c}1") for c in XYZ], low, high)
    return near.where(hit).groupBy("lid").agg(F.min(F.struct(*KEYS)).alias("v")).select("lid", "v.ix", "v.iy", "v.iz")
