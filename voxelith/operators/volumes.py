"""Truncated signed distance volumes: sparse frames ix, iy, iz, tsdf, weight [, r, g, b]; distance transforms of cell grids."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.spatial import XYZ
from .points import COLOR, has
from .voxels import KEYS, centers, project


def open_cells(points: DataFrame, size: float, trunc: float, origin: Sequence[float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """The cells that a box of half width trunc around some point touches."""
    out = points.select(*XYZ)
    for i, (c, k) in enumerate(zip(XYZ, KEYS)):
        low, high = (F.floor((F.col(c) + s * trunc - float(origin[i])) / size).cast("int") for s in (-1, 1))
        out = out.withColumn(k, F.explode(F.sequence(low, high)))
    return out.select(*KEYS).distinct()


def integrate(volume: DataFrame | None, cells: DataFrame, pixels: DataFrame, k: np.ndarray, extrinsic: np.ndarray, size: float, trunc: float, origin: Sequence[float] = (0.0, 0.0, 0.0), multiplier: DataFrame | None = None) -> DataFrame:
    """The volume after a depth image (v, u, depth [, r, g, b]), or after many of one camera (img too): running means over all images that saw a cell.

    A cell counts if its pixel has a depth and it lies no farther behind that than trunc. multiplier (v, u, m) turns depths into distances.
    """
    colors = [c for c in COLOR if c in pixels.columns]
    seen = project(centers(cells.select(*KEYS), size, origin), k, extrinsic).join(pixels.where("depth > 0").select("v", "u", "depth", *colors), ["v", "u"])
    sdf = F.col("depth") - F.col("d")
    if multiplier is not None:
        seen, sdf = seen.join(multiplier, ["v", "u"]), sdf * F.col("m")
    names = ["tsdf", *colors]
    one = seen.where(sdf > -trunc).select(*KEYS, F.least(F.lit(1.0), sdf / trunc).alias("tsdf"), *colors)
    # sums and counts, so that images may come in any order and number
    new = one.groupBy(*KEYS).agg(F.count(F.lit(1)).cast("double").alias("n__"), *[F.sum(c).alias(f"{c}__") for c in names])
    if volume is None:
        return new.select(*KEYS, (F.col("tsdf__") / F.col("n__")).alias("tsdf"), F.col("n__").alias("weight"), *[(F.col(f"{c}__") / F.col("n__")).alias(c) for c in colors])
    both = volume.join(new, KEYS, "full")
    w = F.coalesce("weight", F.lit(0.0))
    mean = lambda c: F.when(F.col("n__").isNull(), F.col(c)).otherwise((F.coalesce(c, F.lit(0.0)) * w + F.col(f"{c}__")) / (w + F.col("n__"))).alias(c)
    return both.select(*KEYS, mean("tsdf"), (w + F.coalesce("n__", F.lit(0.0))).alias("weight"), *[mean(c) for c in colors])


def voxel_points(volume: DataFrame, size: float, origin: Sequence[float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Centres of the cells that were seen and are near a surface, with the distance as gray."""
    keep = volume.where("weight <> 0 and tsdf < 0.98 and tsdf >= -0.98")
    return centers(keep, size, origin).select(*KEYS, *XYZ, *[((F.col("tsdf") + 1) / 2).alias(c) for c in COLOR])


def surface_points(volume: DataFrame, size: float, origin: Sequence[float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """(ix, iy, iz, axis, x, y, z [, r, g, b]): where the distance changes sign between neighbouring cells, by interpolation."""
    near = volume.where("weight <> 0 and tsdf < 0.98 and tsdf >= -0.98")
    colors = list(COLOR) if has(volume, COLOR) else []
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), *[F.lit(int(i == a)).alias(f"d{i}") for i in range(3)]) for a in range(3)])).alias("s")
    from_ = near.select(*[F.col(k).alias(f"{k}0") for k in KEYS], F.col("tsdf").alias("t0"), *[F.col(c).alias(f"{c}0") for c in colors], step)
    from_ = from_.withColumns({k: F.col(f"{k}0") + F.col(f"s.d{i}") for i, k in enumerate(KEYS)})
    both = from_.join(near.select(*KEYS, "tsdf", *colors), KEYS).where(F.col("t0") * F.col("tsdf") < 0)
    r0, r1 = F.abs("t0"), F.abs("tsdf")
    share = r0 / (r0 + r1)
    places = [((F.col(f"{k}0") + 0.5) * size + float(origin[i]) + F.when(F.col("s.axis") == i, share * size).otherwise(0.0)).alias(c) for i, (c, k) in enumerate(zip(XYZ, KEYS))]
    return both.select(*[F.col(f"{k}0").alias(k) for k in KEYS], F.col("s.axis").alias("axis"), *places, *[(F.col(f"{c}0") * (1 - share) + F.col(c) * share).alias(c) for c in colors])


#: The six tetrahedra of a cube around its diagonal: paths from corner 0 to corner 7 over three edges.
TETRAHEDRA = [tuple(np.cumsum([0, *(1 << i for i in order)]).tolist()) for order in itertools.permutations(range(3))]


def _triangles_of(values: np.ndarray, corners: np.ndarray) -> list[np.ndarray]:
    """Triangles of the zero surface in one cube: values of its eight corners and their places."""
    out = []
    for tet in TETRAHEDRA:
        v, p = values[list(tet)], corners[list(tet)]
        inside = v < 0
        n = int(inside.sum())
        cut = lambda i, j: p[i] + (p[j] - p[i]) * (v[i] / (v[i] - v[j]))
        a, b = np.flatnonzero(inside), np.flatnonzero(~inside)
        if n == 1:
            found = [[cut(a[0], j) for j in b]]
        elif n == 3:
            found = [[cut(b[0], i) for i in a]]
        elif n == 2:
            q = [cut(a[0], b[0]), cut(a[0], b[1]), cut(a[1], b[1]), cut(a[1], b[0])]
            found = [[q[0], q[1], q[2]], [q[0], q[2], q[3]]]
        else:
            continue
        outward = p[b].mean(axis=0) - p[a].mean(axis=0)
        for t in np.array(found):
            out.append(t if np.cross(t[1] - t[0], t[2] - t[0]) @ outward >= 0 else t[::-1])
    return out


def surface_mesh(volume: DataFrame, size: float, origin: Sequence[float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Corner places (x0 .. z2) of the triangles of the zero surface, turned outwards; each cube of eight seen cells is cut into six tetrahedra."""
    corner = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), *[F.lit(c >> i & 1).alias(f"d{i}") for i in range(3)]) for c in range(8)])).alias("s")
    each = volume.where("weight <> 0").select(*KEYS, "tsdf", corner)
    each = each.select(*[(F.col(k) - F.col(f"s.d{i}")).alias(k) for i, k in enumerate(KEYS)], F.struct(F.col("s.c").alias("c"), "tsdf").alias("v"))
    cubes = each.groupBy(*KEYS).agg(F.array_sort(F.collect_list("v")).alias("v")).where((F.size("v") == 8) & (F.array_min(F.transform("v", lambda x: x["tsdf"])) < 0) & (F.array_max(F.transform("v", lambda x: x["tsdf"])) >= 0))
    places = np.array([[c >> i & 1 for i in range(3)] for c in range(8)], float)
    low = np.asarray(origin, float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for x, y, z, v in zip(b["ix"], b["iy"], b["iz"], b["t"]):
                at = (np.array([x, y, z]) + 0.5 + places) * size + low
                rows += [t.reshape(-1) for t in _triangles_of(np.asarray(v, float), at)]
            yield pd.DataFrame(np.array(rows).reshape(-1, 9), columns=[f"{c}{i}" for i in range(3) for c in XYZ])

    return cubes.select(*KEYS, F.transform("v", lambda x: x["tsdf"]).alias("t")).mapInPandas(run, ", ".join(f"{c}{i} double" for i in range(3) for c in XYZ))


def _nearest_on_line(seeds: np.ndarray, cost: np.ndarray, n: int) -> np.ndarray:
    """For each place 0 .. n - 1 the index of the seed with the least (place - seed)**2 + cost, by the lower envelope of parabolas."""
    held, starts = [], []
    for i in range(len(seeds)):
        while held:
            j = held[-1]
            if seeds[i] == seeds[j]:
                cross = -np.inf if cost[i] < cost[j] else np.inf
            else:
                cross = (seeds[i] ** 2 + cost[i] - seeds[j] ** 2 - cost[j]) / (2 * (seeds[i] - seeds[j]))
            if cross <= starts[-1]:
                held.pop()
                starts.pop()
                continue
            break
        else:
            cross = -np.inf
        if cross < np.inf:
            held.append(i)
            starts.append(cross)
    return np.array(held)[np.searchsorted(np.array(starts), np.arange(n), "left").clip(1) - 1]


def distance_transform(cells: DataFrame, resolution: int) -> DataFrame:
    """(ix, iy, iz, nx, ny, nz, distance): the nearest given cell of every cell of a cube 0 .. resolution - 1; exact, one axis after another.

    Each pass keeps for each place of a line the nearest seed, so a line's task holds no more than `resolution` rows.
    """
    state = cells.select(*KEYS, *[F.col(k).alias(n) for k, n in zip(KEYS, ("nx", "ny", "nz"))]).distinct()
    names = ["ix", "iy", "iz", "nx", "ny", "nz"]
    schema = ", ".join(f"{n} int" for n in names)
    def along(axis: str):
        others = [k for k in KEYS if k != axis]

        def line(p: pd.DataFrame) -> pd.DataFrame:
            p = p.sort_values([axis, "nx", "ny", "nz"])
            cost = sum((p[k].to_numpy(float) - p["n" + k[1]].to_numpy(float)) ** 2 for k in others)
            # on this axis a seed stands at its own place, not at the line's
            best = _nearest_on_line(p["n" + axis[1]].to_numpy(float), np.asarray(cost), resolution)
            out = {k: np.full(resolution, p[k].iloc[0]) for k in others} | {axis: np.arange(resolution)} | {n: p[n].to_numpy()[best] for n in ("nx", "ny", "nz")}
            return pd.DataFrame(out)[names].astype(np.int32)

        return others, line

    for axis in ("iz", "iy", "ix"):
        others, line = along(axis)
        state = state.groupBy(*others).applyInPandas(line, schema)
    d = sum(((F.col(k) - F.col(n)) * (F.col(k) - F.col(n)) for k, n in zip(KEYS, ("nx", "ny", "nz"))), F.lit(0))
    return state.withColumn("distance", F.sqrt(d.cast("double")))
