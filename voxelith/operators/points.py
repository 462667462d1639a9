"""Point clouds: frames with id, x, y, z and, where present, nx, ny, nz and r, g, b."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..plans.ranking import with_row_number
from ..plans.leaves import PAIRS, neighbourhoods, places, squares
from ..plans.spatial import MANY, XYZ, knn_join, radius_join

NORMAL, COLOR = ("nx", "ny", "nz"), ("r", "g", "b")


def has(df: DataFrame, names: Sequence[str]) -> bool:
    return set(names) <= set(df.columns)


def linear(m: np.ndarray, names: Sequence[str], shift: Sequence[float] | None = None) -> list[Column]:
    """m times the vector of columns, plus a shift."""
    out = []
    for i in range(3):
        e = F.lit(0.0) if shift is None else F.lit(float(shift[i]))
        for j, c in enumerate(names):
            e = e + float(m[i][j]) * F.col(c)
        out.append(e)
    return out


def _replaced(df: DataFrame, names: Sequence[str], values: Sequence[Column]) -> DataFrame:
    return df.withColumns(dict(zip(names, values)))


# Projections


def transform(df: DataFrame, m: np.ndarray) -> DataFrame:
    """Points by a 4 x 4 matrix, normals and covariances (cov, nine numbers) by its linear part."""
    new = dict(zip(XYZ, linear(m[:3, :3], XYZ, m[:3, 3])))
    if has(df, NORMAL):
        new |= dict(zip(NORMAL, linear(m[:3, :3], NORMAL)))
    if "cov" in df.columns:
        new["cov"] = _rotated_covariance(m[:3, :3])
    return df.withColumns(new)


def _rotated_covariance(r: np.ndarray) -> Column:
    out = []
    for i in range(3):
        for j in range(3):
            e = F.lit(0.0)
            for a in range(3):
                for b in range(3):
                    e = e + float(r[i][a] * r[j][b]) * F.col("cov")[3 * a + b]
            out.append(e)
    return F.array(*out)


def _center(df: DataFrame) -> list[float]:
    r = df.agg(*[F.avg(c).alias(c) for c in XYZ]).first()
    return [r[c] or 0.0 for c in XYZ]


def translate(df: DataFrame, t: Sequence[float], relative: bool = True) -> DataFrame:
    c = [0.0] * 3 if relative else _center(df)
    return _replaced(df, XYZ, [F.col(n) + float(t[i] - c[i]) for i, n in enumerate(XYZ)])


def scale(df: DataFrame, s: float, center: bool = True) -> DataFrame:
    c = _center(df) if center else [0.0] * 3
    return _replaced(df, XYZ, [(F.col(n) - c[i]) * float(s) + c[i] for i, n in enumerate(XYZ)])


def rotate(df: DataFrame, r: np.ndarray, center: bool = True) -> DataFrame:
    c = np.array(_center(df)) if center else np.zeros(3)
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = r, c - np.asarray(r) @ c
    return transform(df, m)


def norm(names: Sequence[str]) -> Column:
    total = None
    for c in names:
        total = F.col(c) * F.col(c) if total is None else total + F.col(c) * F.col(c)
    return F.sqrt(total)


def normalize_normals(df: DataFrame, empty: Sequence[float] | None = None) -> DataFrame:
    """Unit normals; a zero one stays zero, or becomes `empty`."""
    n = norm(NORMAL)
    return _replaced(df, NORMAL, [F.when(n > 0, F.col(c) / n).otherwise(F.col(c) if empty is None else F.lit(float(empty[i]))) for i, c in enumerate(NORMAL)])


def paint_uniform_color(df: DataFrame, color: Sequence[float]) -> DataFrame:
    """One colour, each part clamped to 0 to 1."""
    return df.withColumns({c: F.lit(float(min(1.0, max(0.0, v)))) for c, v in zip(COLOR, color)})


def orient_normals_to_align_with_direction(df: DataFrame, ref: Sequence[float] = (0.0, 0.0, 1.0)) -> DataFrame:
    dot = sum((float(v) * F.col(c) for c, v in zip(NORMAL, ref)), F.lit(0.0))
    return _replaced(df, NORMAL, [F.when(norm(NORMAL) == 0, F.lit(float(v))).when(dot < 0, -F.col(c)).otherwise(F.col(c)) for c, v in zip(NORMAL, ref)])


# Filters


def remove_none_finite_points(df: DataFrame, nan: bool = True, inf: bool = True) -> DataFrame:
    bad = F.lit(False)
    for c in XYZ:
        if nan:
            bad = bad | F.isnan(c) | F.col(c).isNull()
        if inf:
            bad = bad | (F.abs(c) == float("inf"))
    return df.where(~bad)


def pass_through_filter(df: DataFrame, axis: int, low: float, high: float) -> DataFrame:
    return df.where(F.col(XYZ[axis]).between(low, high))


def crop(df: DataFrame, low: Sequence[float], high: Sequence[float]) -> DataFrame:
    """Points in a box, its sides included; an error if the box has no volume."""
    if not np.prod(np.subtract(high, low)) > 0:
        raise ValueError("the box has no volume")
    keep = F.lit(True)
    for c, a, b in zip(XYZ, low, high):
        keep = keep & F.col(c).between(float(a), float(b))
    return df.where(keep)


def crop_oriented(df: DataFrame, center: Sequence[float], rotation: np.ndarray, extent: Sequence[float]) -> DataFrame:
    """Points in a box whose axes are the rotation's columns; extent holds the full side lengths."""
    keep = F.lit(True)
    for i in range(3):
        along = sum((float(rotation[j][i]) * (F.col(c) - float(center[j])) for j, c in enumerate(XYZ)), F.lit(0.0))
        keep = keep & (F.abs(along) <= float(extent[i]) / 2)
    return df.where(keep)


def select_by_index(df: DataFrame, index: DataFrame, invert: bool = False, id_col: str = "id") -> DataFrame:
    """The rows whose ids are listed, as often as they are; invert: those that are not."""
    return df.join(index.select(id_col), id_col, "left_anti" if invert else "inner")


def select_by_mask(df: DataFrame, mask: DataFrame, invert: bool = False, mask_col: str = "mask") -> DataFrame:
    keep = F.col(mask_col) != F.lit(invert)
    return df.join(mask.where(keep).select("id"), "id", "left_semi")


def uniform_down_sample(df: DataFrame, k: int) -> DataFrame:
    """Every k-th point by id, from the first on; floor(n / k) points."""
    if k < 1:
        raise ValueError("k has to be positive")
    n = df.count()
    return with_row_number(df, "id", "rn__").where((F.col("rn__") % k == 0) & (F.col("rn__") < n // k * k)).drop("rn__")


def remove_radius_outlier(df: DataFrame, neighbours: int, radius: float) -> DataFrame:
    """Points with more than so many points around, themselves included."""
    enough = radius_join(df, df, radius, max_nn=neighbours + 1).groupBy("q").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > neighbours).select(F.col("q").alias("id"))
    return df.join(enough, "id", "left_semi")


def remove_statistical_outlier(df: DataFrame, neighbours: int, ratio: float) -> DataFrame:
    """Points whose mean squared distance to their nearest points (themselves included) is positive and below mean + ratio * deviation of all."""
    mean = cut(knn_join(df, df, neighbours).groupBy("q").agg(F.avg("d2").alias("m")))
    r = mean.where("m > 0").agg(F.avg("m").alias("a"), F.stddev_samp("m").alias("s")).first()
    limit = (r["a"] or 0.0) + ratio * (r["s"] or 0.0)
    keep = mean.where((F.col("m") > 0) & (F.col("m") < limit)).select(F.col("q").alias("id"))
    return df.join(keep, "id", "left_semi")


# Aggregates


def bounds(df: DataFrame) -> DataFrame:
    """One row: min_x ... max_z; zeros if there are no points."""
    return df.agg(*[F.coalesce(f(c), F.lit(0.0)).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in XYZ])


def center(df: DataFrame) -> DataFrame:
    return df.agg(*[F.avg(c).alias(c) for c in XYZ])


def oriented_bounding_box(df: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, rotation (principal axes as columns, the longest first) and extent of the box along the principal axes."""
    pairs = [(a, b) for i, a in enumerate(XYZ) for b in XYZ[i:]]
    r = df.agg(*[F.avg(c).alias(c) for c in XYZ], *[F.covar_pop(a, b).alias(a + b) for a, b in pairs]).first()
    cov = np.array([[r[min(a, b) + max(a, b)] for b in XYZ] for a in XYZ])
    values, vectors = np.linalg.eigh(cov)
    axes = vectors[:, ::-1]
    axes[:, 2] = np.cross(axes[:, 0], axes[:, 1])
    along = df.select(*[sum((float(axes[j, i]) * (F.col(c) - r[c]) for j, c in enumerate(XYZ)), F.lit(0.0)).alias(f"a{i}") for i in range(3)])
    b = along.agg(*[f(f"a{i}").alias(f"{n}{i}") for i in range(3) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    low, high = np.array([b[f"lo{i}"] for i in range(3)]), np.array([b[f"hi{i}"] for i in range(3)])
    return np.array([r[c] for c in XYZ]) + axes @ ((low + high) / 2), axes, high - low


def voxel_keys(df: DataFrame, size: float, origin: Sequence[float | Column]) -> list[Column]:
    return [F.floor((F.col(c) - origin[i]) / size).cast("int").alias(k) for i, (c, k) in enumerate(zip(XYZ, ("ix", "iy", "iz")))]


def voxel_down_sample(df: DataFrame, size: float) -> DataFrame:
    """The mean point of each cell (and the mean colour, and the mean normal made a unit one); cells start half a cell below the least corner."""
    if size <= 0:
        raise ValueError("the voxel size has to be positive")
    low = df.agg(*[F.min(c).alias(c) for c in XYZ]).first()
    if low["x"] is None:
        return df.limit(0).drop("id")
    names = [*XYZ, *(NORMAL if has(df, NORMAL) else ()), *(COLOR if has(df, COLOR) else ())]
    out = df.groupBy(*voxel_keys(df, size, [low[c] - size / 2 for c in XYZ])).agg(*[F.avg(c).alias(c) for c in names])
    return normalize_normals(out) if has(df, NORMAL) else out


def moments(pairs: DataFrame) -> DataFrame:
    """Per q: count, sums and sums of products of the partners' places (t_x, t_y, t_z)."""
    t = [f"t_{c}" for c in XYZ]
    return pairs.groupBy("q").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c[2:]) for c in t], *[F.avg(F.col(a) * F.col(b)).alias(a[2:] + b[2:]) for i, a in enumerate(t) for b in t[i:]])


def _covariances(p: pd.DataFrame) -> np.ndarray:
    c = np.empty((len(p), 3, 3))
    for i, a in enumerate(XYZ):
        for j, b in enumerate(XYZ):
            c[:, i, j] = p[min(a, b) + max(a, b)] - p[a] * p[b]
    return c


def _normals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        _, vectors = np.linalg.eigh(_covariances(p))
        n = vectors[:, :, 0]
        # the sign is free: the largest part is made positive
        big = np.take_along_axis(n, np.abs(n).argmax(axis=1)[:, None], axis=1)
        n = n * np.where(big < 0, -1.0, 1.0)
        n[(p["n"] < 3).to_numpy()] = (0.0, 0.0, 1.0)
        yield pd.DataFrame({"id": p["q"], "nx": n[:, 0], "ny": n[:, 1], "nz": n[:, 2]})


def estimate_normals(df: DataFrame, k: int = 30, radius: float | None = None) -> DataFrame:
    """df with the direction of least spread of each point's neighbourhood (its k nearest, or k at most within the radius); (0, 0, 1) for fewer than three."""
    pairs = knn_join(df, df, k, keep_target=XYZ) if radius is None else radius_join(df, df, radius, max_nn=k, keep_target=XYZ)
    found = moments(pairs).mapInPandas(_normals, "id long, nx double, ny double, nz double")
    return df.drop(*NORMAL).join(found, "id", "left").na.fill({"nx": 0.0, "ny": 0.0, "nz": 1.0})


def gaussian_filter(df: DataFrame, radius: float, sigma2: float, max_nn: int = 50) -> DataFrame:
    """Each point (and normal and colour) becomes the weighted mean of those around it."""
    names = [*XYZ, *(NORMAL if has(df, NORMAL) else ()), *(COLOR if has(df, COLOR) else ())]
    if max_nn > MANY and df.count() <= max_nn:
        return _smoothed(df, radius, sigma2, names)
    pairs = radius_join(df, df, radius, max_nn=max_nn, keep_target=names).withColumn("w", F.exp(-F.col("d2") / (2 * sigma2)))
    return pairs.groupBy(F.col("q").alias("id")).agg(*[(F.sum(F.col(f"t_{c}") * F.col("w")) / F.sum("w")).alias(c) for c in names])


def _smoothed(df: DataFrame, radius: float, sigma2: float, names: Sequence[str]) -> DataFrame:
    """gaussian_filter over all partners within the radius, summed where they are: no row is made for a pair."""
    import pyarrow as pa

    def mean(a: pa.Table, b: pa.Table) -> pa.Table:
        q, t = places(a, [f"q_{c}" for c in XYZ]), places(b, [f"t_{c}" for c in XYZ])
        there = np.stack([~b[f"t_{c}"].is_null().to_numpy() for c in names], axis=1)
        values = np.where(there, places(b, [f"t_{c}" for c in names]).astype(float), 0.0)
        sums, weight, some, step = np.zeros((len(q), len(names))), np.zeros(len(q)), np.zeros((len(q), len(names)), bool), max(1, PAIRS // max(1, len(t)))
        for s in range(0, len(q) if len(t) else 0, step):
            w = squares(q[s : s + step], t)
            far = ~(w < radius * radius)
            w *= -1 / (2 * sigma2)
            np.exp(w, out=w)
            w[far] = 0.0
            sums[s : s + step], weight[s : s + step] = w @ values, w.sum(1)
            some[s : s + step] = True if there.all() else (~far).astype(float) @ there > 0
        held = np.flatnonzero(weight > 0)
        return pa.table({"id": a["q"].take(pa.array(held)), **{c: pa.array(sums[held, i] / weight[held], mask=~some[held, i]) for i, c in enumerate(names)}})

    return neighbourhoods(df, df, radius, mean, f"id {df.schema['id'].dataType.simpleString()}, " + ", ".join(f"{c} double" for c in names), XYZ, keep_target=names)


def model_resolution(df: DataFrame) -> DataFrame:
    """One row: root of the mean squared distance to the nearest other point."""
    second = knn_join(df, df, 2).groupBy("q").agg(F.max("d2").alias("d2"))
    return second.agg(F.sqrt(F.avg("d2")).alias("resolution"))


def _third_eigenvalues(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        values = np.linalg.eigvalsh(_covariances(p))
        yield pd.DataFrame({"id": p["q"], "n": p["n"], "e1": values[:, 2], "e2": values[:, 1], "e3": values[:, 0]})


def iss_keypoints(df: DataFrame, salient_radius: float, non_max_radius: float, gamma_21: float = 0.975, gamma_32: float = 0.975, min_neighbours: int = 5, max_neighbours: int = 100) -> DataFrame:
    """Points whose least spread is the largest around, where the spreads differ enough between directions."""
    m = moments(radius_join(df, df, salient_radius, max_nn=max_neighbours, keep_target=XYZ))
    values = m.mapInPandas(_third_eigenvalues, "id long, n long, e1 double, e2 double, e3 double")
    ok = (F.col("n") >= min_neighbours) & (F.col("e2") < gamma_21 * F.col("e1")) & (F.col("e3") < gamma_32 * F.col("e2")) & (F.col("e3") > 0)
    salient = cut(df.select("id", *XYZ).join(values.select("id", F.when(ok, F.col("e3")).otherwise(F.lit(-1.0)).alias("saliency")), "id"))
    around = radius_join(salient, salient, non_max_radius, max_nn=max_neighbours, keep_query=("saliency",), keep_target=("saliency",))
    best = around.groupBy("q").agg(F.max("t_saliency").alias("top"), F.first("q_saliency").alias("own"), F.count(F.lit(1)).alias("n"))
    keep = best.where((F.col("own") > 0) & (F.col("own") >= F.col("top")) & (F.col("n") >= min_neighbours)).select(F.col("q").alias("id"))
    return df.join(keep, "id", "left_semi")


# Ranks


def farthest_point_down_sample(df: DataFrame, n: int) -> DataFrame:
    """n points, each as far as can be from those before; the least id is the first, ties go to the lower id."""
    if n >= df.count():
        return df
    first = df.orderBy("id").limit(1).first()
    chosen, now = [], first
    state = df.select("id", *XYZ, F.lit(float("inf")).alias("d")).persist()
    for i in range(n):
        chosen.append(now["id"])
        if i + 1 == n:
            break
        d2 = sum(((F.col(c) - now[c]) * (F.col(c) - now[c]) for c in XYZ), F.lit(0.0))
        state = state.withColumn("d", F.least("d", d2))
        if i % 8 == 7:
            state = cut(state)
        now = state.agg(F.max_by(F.struct("id", *XYZ), F.struct("d", (-F.col("id")).alias("low"))).alias("p")).first()["p"]
    return df.where(F.col("id").isin(chosen))


def plane_through(p: np.ndarray) -> np.ndarray | None:
    n = np.cross(p[1] - p[0], p[2] - p[0])
    size = np.linalg.norm(n)
    return None if size == 0 else np.append(n / size, -(n / size) @ p[0])


def plane_distance(plane: Sequence[float]) -> Column:
    return F.abs(sum((float(v) * F.col(c) for c, v in zip(XYZ, plane)), F.lit(float(plane[3]))))


def score_planes(df: DataFrame, planes: list[np.ndarray], threshold: float) -> DataFrame:
    """(model, inliers, error) of each plane that has inliers, all in one aggregate of conditional sums: a pass makes one row."""
    near = [F.when(plane_distance(p) < threshold, plane_distance(p)) for p in planes]
    sums = F.array(*[F.struct(F.lit(i).alias("model"), F.count(d).alias("inliers"), F.sum(d).alias("error")) for i, d in enumerate(near)])
    return df.agg(sums.alias("s")).select(F.explode("s").alias("s")).select("s.*").where("inliers > 0")


def plane_of(df: DataFrame) -> np.ndarray:
    """The plane through the centre of the points, across the direction in which the other two spread most (by the largest of the three 2 x 2 determinants of second moments)."""
    pairs = [(a, b) for i, a in enumerate(XYZ) for b in XYZ[i:]]
    r = df.agg(*[F.avg(c).alias(c) for c in XYZ], *[F.covar_pop(a, b).alias(a + b) for a, b in pairs]).first()
    xx, xy, xz, yy, yz, zz = (r[a + b] for a, b in pairs)
    det = [yy * zz - yz * yz, xx * zz - xz * xz, xx * yy - xy * xy]
    normals = [(det[0], xz * yz - xy * zz, xy * yz - xz * yy), (xz * yz - xy * zz, det[1], xy * xz - yz * xx), (xy * yz - xz * yy, xy * xz - yz * xx, det[2])]
    n = np.array(normals[int(np.argmax(det))])
    size = np.linalg.norm(n)
    if size == 0:
        return np.zeros(4)
    n = n / size
    return np.append(n, -n @ np.array([r[c] for c in XYZ]))


def segment_plane(df: DataFrame, threshold: float = 0.01, iterations: int = 100, seed: int = 0, sample: int = 1000) -> tuple[np.ndarray, DataFrame]:
    """The plane with the most points within the threshold among those through random triples, refitted to them; and these points.

    Triples come from the `sample` rows of least hash; all rows score all planes in one pass.
    """
    rows = df.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select(*XYZ).collect()
    if len(rows) < 3:
        return np.zeros(4), df.limit(0)
    rng, p = np.random.default_rng(seed), np.array([tuple(r) for r in rows])
    planes = [q for _ in range(iterations) if (q := plane_through(p[rng.choice(len(p), 3, replace=False)])) is not None]
    if not planes:
        return np.zeros(4), df.limit(0)
    best = score_planes(df, planes, threshold).orderBy(F.desc("inliers"), F.col("error") / F.sqrt("inliers"), "model").first()
    if best is None:
        return np.zeros(4), df.limit(0)
    inliers = df.where(plane_distance(planes[best["model"]]) < threshold)
    return plane_of(inliers), inliers


# Sets


def concat(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, then b with its ids moved up; what only one of them has is left out."""
    shift = (a.agg(F.max("id")).first()[0] or -1) + 1
    names = [c for c in a.columns if c in b.columns]
    return a.select(*names).unionByName(b.select(*names).withColumn("id", F.col("id") + shift))

