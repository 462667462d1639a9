"""More ways of registration: by colours, by local covariances, by features, by depth images."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import matrix_to_twist, rigid, solve_psd, twist_to_matrix
from ..plans.leaves import Leaves
from ..plans.lineage import cut
from ..plans.spatial import XYZ, nearest, radius_join
from . import images
from .points import COLOR, NORMAL, estimate_normals, linear, transform
from .registration import PointToPoint, Result, _cols, _cross, icp, jtj, match_features

INTENSITY = (0.299, 0.587, 0.114)


def intensity(prefix: str = ""):
    return (F.col(f"{prefix}r") + F.col(f"{prefix}g") + F.col(f"{prefix}b")) / 3


# Colours


def color_gradients(df: DataFrame, radius: float, max_nn: int = 30) -> DataFrame:
    """df (with normals and colours) with i0 and gx, gy, gz: the intensity and its gradient in the tangent plane, by least squares over the neighbours; zero for fewer than four."""
    pairs = radius_join(df, df, radius, max_nn=max_nn, keep_query=[*XYZ, *NORMAL, *COLOR], keep_target=[*XYZ, *COLOR])
    n = [F.col(f"q_{c}") for c in NORMAL]
    d = [F.col(f"t_{c}") - F.col(f"q_{c}") for c in XYZ]
    pairs = pairs.withColumns({f"d{i}": x for i, x in enumerate(d)}).withColumn("h", sum((F.col(f"d{i}") * n[i] for i in range(3)), F.lit(0.0)))
    pairs = pairs.withColumns({f"p{i}": F.col(f"d{i}") - F.col("h") * n[i] for i in range(3)}).withColumn("di", intensity("t_") - intensity("q_"))
    aggs = [F.count(F.lit(1)).alias("n")] + [F.sum(F.col(f"p{i}") * F.col(f"p{j}")).alias(f"a{i}{j}") for i in range(3) for j in range(i, 3)] + [F.sum(F.col(f"p{i}") * F.col("di")).alias(f"b{i}") for i in range(3)]
    sums = pairs.groupBy(F.col("q").alias("id")).agg(*aggs).join(df.select("id", *NORMAL), "id")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            a = np.array([[p[f"a{min(i, j)}{max(i, j)}"] for j in range(3)] for i in range(3)]).transpose(2, 0, 1)
            normal, k = p[list(NORMAL)].to_numpy(), p["n"].to_numpy(float)
            # the gradient has no part along the normal
            a = a + ((k - 1) ** 2)[:, None, None] * normal[:, :, None] * normal[:, None, :]
            b = p[["b0", "b1", "b2"]].to_numpy()
            ok = (k >= 4) & (np.abs(np.linalg.det(a)) > 1e-12)
            g = np.zeros_like(b)
            if ok.any():
                g[ok] = np.linalg.solve(a[ok], b[ok][:, :, None])[:, :, 0]
            yield pd.DataFrame({"id": p["id"], "gx": g[:, 0], "gy": g[:, 1], "gz": g[:, 2]})

    return df.join(sums.mapInPandas(solve, "id long, gx double, gy double, gz double"), "id").withColumn("i0", intensity())


def colored_rows(weight: float) -> list[tuple[list, object]]:
    """The point's distance to the tangent plane, and its colour's difference to what the gradient foretells there."""
    p, q, n, g = _cols("q"), _cols("t"), _cols("t", NORMAL), _cols("t", ("gx", "gy", "gz"))
    d = [a - b for a, b in zip(p, q)]
    h = d[0] * n[0] + d[1] * n[1] + d[2] * n[2]
    geometric = ([F.lit(weight**0.5) * x for x in [*_cross(p, n), *n]], F.lit(weight**0.5) * h)
    gn = g[0] * n[0] + g[1] * n[1] + g[2] * n[2]
    m = [-(a - gn * b) for a, b in zip(g, n)]  # of the difference, by the point
    there = sum((a * (x - h * b) for a, x, b in zip(g, d, n)), F.col("t_i0"))
    s = F.lit((1 - weight) ** 0.5)
    return [geometric, ([s * x for x in [*_cross(p, m), *m]], s * (F.col("q_i0") - there))]


def colored_icp(source: DataFrame, target: DataFrame, distance: float, init: np.ndarray | None = None, weight: float = 0.968, iterations: int = 30, least_fitness: float = 1e-6, least_rmse: float = 1e-6) -> Result:
    """Both clouds have colours; the target has normals."""
    m = np.eye(4) if init is None else np.array(init, float)
    target = Leaves(cut(color_gradients(target, 2 * distance)), XYZ, keep=[*XYZ, *NORMAL, "i0", "gx", "gy", "gz"])
    source = source.select("id", *XYZ, *COLOR).withColumn("i0", intensity()).persist()
    total, last = source.count(), None
    for i in range(iterations + 1):
        pairs = nearest(transform(source, m), target, distance, keep_query=[*XYZ, "i0"], keep_target=[*XYZ, *NORMAL, "i0", "gx", "gy", "gz"]).persist()
        r = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum("d2").alias("s")).first()
        now = (r["n"] / total if total else 0.0, float(np.sqrt(r["s"] / r["n"])) if r["n"] else 0.0)
        if i == iterations or not r["n"] or last and abs(now[0] - last[0]) < least_fitness and abs(now[1] - last[1]) < least_rmse:
            return Result(m, *now, pairs.select("q", "t", "d2"))
        a, b, _ = jtj(pairs, colored_rows(weight))
        x = solve_psd(a, -b)
        if x is not None:
            m = twist_to_matrix(x) @ m
        pairs.unpersist()
        last = now
    raise AssertionError


# Covariances


def plane_covariances(df: DataFrame, epsilon: float = 1e-3, k: int = 20) -> DataFrame:
    """df with cov (nine numbers): flat along the normal, round in the tangent plane."""
    df = df if set(NORMAL) <= set(df.columns) else estimate_normals(df, k)
    return df.withColumn("cov", F.array(*[(F.lit(1.0 if i == j else 0.0) - (1 - epsilon) * F.col(NORMAL[i]) * F.col(NORMAL[j])) for i in range(3) for j in range(3)]))


class Generalized:
    """Differences weighted by the inverse of both points' covariances."""

    needs: dict = {}

    def step(self, pairs: DataFrame) -> np.ndarray:
        names = [f"s{i}" for i in range(43)]

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                if not len(p):
                    continue
                a, b = p[["q_x", "q_y", "q_z"]].to_numpy(), p[["t_x", "t_y", "t_z"]].to_numpy()
                w = np.linalg.inv(np.stack(p["q_cov"].to_numpy()).reshape(-1, 3, 3) + np.stack(p["t_cov"].to_numpy()).reshape(-1, 3, 3))
                j = np.zeros((len(p), 3, 6))
                j[:, 0, 1], j[:, 0, 2], j[:, 1, 0], j[:, 1, 2], j[:, 2, 0], j[:, 2, 1] = a[:, 2], -a[:, 1], -a[:, 2], a[:, 0], a[:, 1], -a[:, 0]
                j[:, [0, 1, 2], [3, 4, 5]] = 1
                r = (a - b)[:, :, None]
                jw = j.transpose(0, 2, 1) @ w
                row = np.concatenate([(jw @ j).sum(0).reshape(-1), (jw @ r).sum(0).reshape(-1), (r.transpose(0, 2, 1) @ w @ r).sum(0).reshape(-1)])
                yield pd.DataFrame([row], columns=names)

        # each batch is summed where it is
        r = pairs.select(*[f"{s}_{c}" for s in "qt" for c in (*XYZ, "cov")]).mapInPandas(sums, ", ".join(f"{n} double" for n in names)).agg(*[F.sum(n).alias(n) for n in names]).first()
        x = solve_psd(np.array([r[n] or 0.0 for n in names[:36]]).reshape(6, 6), -np.array([r[n] or 0.0 for n in names[36:42]]))
        return np.eye(4) if x is None else twist_to_matrix(x)


def generalized_icp(source: DataFrame, target: DataFrame, distance: float, init: np.ndarray | None = None, epsilon: float = 1e-3, iterations: int = 30, least_fitness: float = 1e-6, least_rmse: float = 1e-6) -> Result:
    m = np.eye(4) if init is None else np.array(init, float)
    source = plane_covariances(source, epsilon).select("id", *XYZ, "cov").persist()
    target = Leaves(cut(plane_covariances(target, epsilon)), XYZ, keep=[*XYZ, "cov"])
    total, last, how = source.count(), None, Generalized()
    for i in range(iterations + 1):
        pairs = nearest(transform(source, m), target, distance, keep_query=[*XYZ, "cov"], keep_target=[*XYZ, "cov"]).persist()
        r = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum("d2").alias("s")).first()
        now = (r["n"] / total if total else 0.0, float(np.sqrt(r["s"] / r["n"])) if r["n"] else 0.0)
        if i == iterations or not r["n"] or last and abs(now[0] - last[0]) < least_fitness and abs(now[1] - last[1]) < least_rmse:
            return Result(m, *now, pairs.select("q", "t", "d2"))
        m = how.step(pairs) @ m
        pairs.unpersist()
        last = now
    raise AssertionError


# Features


def fast_global(source: DataFrame, target: DataFrame, source_features: DataFrame, target_features: DataFrame, dims: int, iterations: int = 64, shrink: float = 1.4, least: float = 0.025, refine: float | None = None) -> Result:
    """Pairs of mutually nearest features, fitted with a penalty that grows stricter every four rounds; fewer than ten pairs give the identity.

    Both clouds are centred and scaled to unit size first.
    """

    def normal(df: DataFrame) -> tuple[np.ndarray, float]:
        c = df.agg(*[F.avg(x).alias(x) for x in XYZ]).first()
        c = np.array([c[x] or 0.0 for x in XYZ])
        far = df.agg(F.max(F.sqrt(sum(((F.col(x) - float(v)) * (F.col(x) - float(v)) for x, v in zip(XYZ, c)), F.lit(0.0))))).first()[0]
        return c, far or 1.0

    (cs, rs), (ct, rt) = normal(source), normal(target)
    scale = max(rs, rt)
    pairs = match_features(source_features, target_features, dims)
    for side, df, key, c in (("q", source, "i", cs), ("t", target, "j", ct)):
        pairs = pairs.join(df.select(F.col("id").alias(key), *[((F.col(x) - float(v)) / scale).alias(f"{side}_{x}") for x, v in zip(XYZ, c)]), key)
    pairs = pairs.persist()
    m = np.eye(4)
    if pairs.count() >= 10:
        mu = 1.0
        for i in range(iterations):
            if i % 4 == 0 and mu > least**2:
                mu /= shrink
            # the source as moved so far
            moved = pairs.withColumns({f"q_{x}": v for x, v in zip(XYZ, linear(m[:3, :3], [f"q_{x}" for x in XYZ], m[:3, 3]))})
            d2 = sum(((a - b) * (a - b) for a, b in zip(_cols("q"), _cols("t"))), F.lit(0.0))
            w = mu / (d2 + mu)
            x, y, z = _cols("q")
            zero, one = F.lit(0.0), F.lit(1.0)
            rows = [([zero, z, -y, one, zero, zero], 0), ([-z, zero, x, zero, one, zero], 1), ([y, -x, zero, zero, zero, one], 2)]
            a, b, _ = jtj(moved.withColumn("w", w), [([F.col("w") * v for v in j], F.col("w") * (_cols("q")[k] - _cols("t")[k])) for j, k in rows])
            step = solve_psd(a, -b)
            if step is not None:
                m = twist_to_matrix(step) @ m
    out = rigid(m[:3, :3], m[:3, 3] * scale + ct - m[:3, :3] @ cs)
    return icp(source, target, refine, out, PointToPoint(), iterations=0) if refine else Result(out, 0.0, 0.0)


# Depth images


def preprocess_depth(df: DataFrame, low: float = 0.0, high: float = 4.0) -> DataFrame:
    """Depths out of the limits become null."""
    return df.withColumn("depth", F.when((F.col("depth") > low) & (F.col("depth") <= high), F.col("depth")))


def pixel_pairs(source: DataFrame, target: DataFrame, k: np.ndarray, m: np.ndarray, width: int, height: int, max_difference: float = 0.07) -> DataFrame:
    """Source pixels with the target pixel that they fall on once moved by m: (u, v, tu, tv, x, y, z, si, sd, ti, td).

    Depths that differ too much don't pair; of source pixels on one target pixel the nearest counts. Images of many pairs are told apart by img.
    """
    key = ["img"] if "img" in source.columns else []
    s = source.where("depth > 0").withColumns({"px": (F.col("u") - float(k[0, 2])) * F.col("depth") / float(k[0, 0]), "py": (F.col("v") - float(k[1, 2])) * F.col("depth") / float(k[1, 1])})
    x, y, z = linear(m[:3, :3], ["px", "py", "depth"], m[:3, 3])
    s = s.withColumns({"x": x, "y": y, "z": z}).where("z > 0")
    s = s.withColumns({"tu": F.floor(F.col("x") * float(k[0, 0]) / F.col("z") + float(k[0, 2]) + 0.5).cast("int"), "tv": F.floor(F.col("y") * float(k[1, 1]) / F.col("z") + float(k[1, 2]) + 0.5).cast("int")})
    s = s.where(F.col("tu").between(0, width - 1) & F.col("tv").between(0, height - 1))
    t = target.where("depth > 0").select(*key, F.col("u").alias("tu"), F.col("v").alias("tv"), F.col("intensity").alias("ti"), F.col("depth").alias("td"))
    both = s.join(t, [*key, "tu", "tv"]).where(F.abs(F.col("td") - F.col("z")) <= max_difference)
    best = both.groupBy(*key, "tu", "tv").agg(F.min(F.struct("z", "u", "v", "x", "y", F.col("intensity").alias("si"), F.col("depth").alias("sd"), "ti", "td")).alias("b"))
    return best.select(*key, "tu", "tv", "b.*")


def _slopes(df: DataFrame, column: str, width: int, height: int) -> DataFrame:
    one = df.select(F.lit(0).alias("img"), "v", "u", F.coalesce(column, F.lit(0.0)).alias("c0"))
    dx = images.sobel(one, width, height, "x").select("v", "u", (F.col("c0") / 8).alias(f"{column}_dx"))
    return dx.join(images.sobel(one, width, height, "y").select("v", "u", (F.col("c0") / 8).alias(f"{column}_dy")), ["v", "u"])


def normalize_intensity(source: DataFrame, target: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both images with intensities scaled so that their means over the paired pixels (si, ti) are one half."""
    r = pairs.agg(F.avg("si").alias("s"), F.avg("ti").alias("t")).first()
    scaled = lambda df, mean: df.withColumn("intensity", F.col("intensity") * (0.5 / mean)) if mean else df
    return scaled(source, r["s"]), scaled(target, r["t"])


def weighted_jtj(pairs: DataFrame, rows: list[tuple[list, object]], sigma2: float, nu: float = 5.0) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Normal equations with weights of a t-distribution of nu degrees, in two aggregates: the scale from all residuals, then the weighted sums; with the weighted
    residuals' sum and the scale."""
    r2 = sum((r * r for _, r in rows[1:]), rows[0][1] * rows[0][1])
    scale = pairs.agg(F.sum(r2 * (nu + 1) / (nu + r2 / sigma2))).first()[0] or 0.0
    if not scale:
        return np.zeros((6, 6)), np.zeros(6), 0.0, 0.0
    w = F.sqrt((nu + 1) / (nu + r2 / scale))
    return *jtj(pairs, [([w * x for x in j], w * r) for j, r in rows]), scale


def _halved(d: DataFrame, w: int, h: int) -> DataFrame:
    own = d.where((F.col("u") < w // 2 * 2) & (F.col("v") < h // 2 * 2))
    return own.groupBy(F.expr("v div 2").cast("int").alias("v"), F.expr("u div 2").cast("int").alias("u")).agg(F.avg("intensity").alias("intensity"), F.avg(F.when(F.col("depth") > 0, F.col("depth"))).alias("depth"))


def odometry_levels(source: DataFrame, target: DataFrame, k: np.ndarray, width: int, height: int, levels: int) -> list[tuple]:
    """(source, target, matrix, width, height) of each level, the finest first."""
    out = [(source, target, np.asarray(k, float), width, height)]
    for _ in range(levels - 1):
        s, t, kk, w, h = out[-1]
        small = kk / 2
        small[2, 2] = 1
        small[:2, 2] = (kk[:2, 2] + 0.5) / 2 - 0.5
        out.append((_halved(s, w, h), _halved(t, w, h), small, w // 2, h // 2))
    return out


def odometry_rows(k: np.ndarray, hybrid: bool, weight: float) -> list[tuple[list, object]]:
    """Jacobians and residuals of a pixel pair by intensity and, if hybrid, by depth."""
    f, g = float(k[0, 0]), float(k[1, 1])
    x, y, z = F.col("x"), F.col("y"), F.col("z")

    def row(name: str, residual, extra: float, share: float):
        a, b = F.col(f"{name}_dx") * f / z, F.col(f"{name}_dy") * g / z
        c = -(a * x + b * y) / z
        j = [-z * b + y * c - extra * y, z * a - x * c + extra * x, x * b - y * a, a, b, c - extra]
        return [F.lit(share) * v for v in j], F.lit(share) * residual

    rows = [row("intensity", F.col("ti") - F.col("si"), 0.0, float(np.sqrt(1 - weight)) if hybrid else 1.0)]
    if hybrid:
        rows.append(row("depth", F.col("td") - z, 1.0, float(np.sqrt(weight))))
    return rows


def _with_slopes(t: DataFrame, w: int, h: int) -> DataFrame:
    slopes = t.join(_slopes(t, "intensity", w, h), ["v", "u"]).join(_slopes(t, "depth", w, h), ["v", "u"])
    return slopes.select(F.col("u").alias("tu"), F.col("v").alias("tv"), "intensity_dx", "intensity_dy", "depth_dx", "depth_dy")


def odometry_information(source: DataFrame, target: DataFrame, k: np.ndarray, m: np.ndarray, width: int, height: int, max_difference: float) -> np.ndarray:
    pairs = pixel_pairs(source, target, np.asarray(k, float), m, width, height, max_difference)
    x, y, z = (F.col(c) for c in XYZ)
    zero, one = F.lit(0.0), F.lit(1.0)
    rows = [([zero, z, -y, one, zero, zero], zero), ([-z, zero, x, zero, one, zero], zero), ([y, -x, zero, zero, zero, one], zero)]
    return np.eye(6) + jtj(pairs, rows)[0]


def rgbd_odometry(source: DataFrame, target: DataFrame, k: np.ndarray, width: int, height: int, init: np.ndarray | None = None, iterations: Sequence[int] = (20, 10, 5), hybrid: bool = True, max_difference: float = 0.07, weight: float = 0.968) -> tuple[bool, np.ndarray, np.ndarray]:
    """(success, motion, information) from one image (v, u, intensity, depth) to another; coarse to fine, one job for each step.

    hybrid weighs depth against intensity; otherwise intensity alone counts.
    """
    ok, m, _ = _odometry(source, target, k, width, height, init, iterations, hybrid, max_difference, weight, lambda pairs, rows, _: jtj(pairs, rows)[:2])
    return (True, m, odometry_information(source, target, k, m, width, height, max_difference)) if ok else (False, np.eye(4), np.eye(6))


def weighted_rgbd_odometry(source: DataFrame, target: DataFrame, k: np.ndarray, width: int, height: int, init: np.ndarray | None = None, previous: Sequence[float] = (0.0,) * 6, iterations: Sequence[int] = (20, 10, 5), max_difference: float = 0.03, weight: float = 0.968, nu: float = 5.0, sigma2: float = 1.0, inverse_sigma: Sequence[float] = (0.0,) * 6) -> tuple[bool, np.ndarray, np.ndarray, np.ndarray]:
    """(success, motion, twist, information): as rgbd_odometry with depth and intensity, with weights of a t-distribution whose scale goes from step to step, and with
    a motion expected from the previous twist, as strongly as inverse_sigma says (rotation first)."""
    scale, hold, before = [sigma2], np.asarray(inverse_sigma, float), np.asarray(previous, float)

    def solve(pairs: DataFrame, rows: list, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, _, scale[0] = weighted_jtj(pairs, rows, scale[0] or sigma2, nu)
        return a + np.diag(hold), b - hold * (before - matrix_to_twist(moved))

    ok, m, moved = _odometry(source, target, k, width, height, init, iterations, True, max_difference, weight, solve)
    if not ok:
        return False, np.eye(4), np.zeros(6), np.eye(6)
    return True, m, matrix_to_twist(moved), odometry_information(source, target, k, m, width, height, max_difference)


def _odometry(source: DataFrame, target: DataFrame, k: np.ndarray, width: int, height: int, init, iterations, hybrid: bool, max_difference: float, weight: float, solve) -> tuple[bool, np.ndarray, np.ndarray]:
    """(success, motion, what was added to init); solve(pairs, rows, added so far) gives the normal equations of a step."""
    m, moved = np.eye(4) if init is None else np.array(init, float), np.eye(4)
    for (s, t, kk, w, h), steps in zip(odometry_levels(source, target, k, width, height, len(iterations))[::-1], iterations):
        s, t = s.persist(), t.persist()
        slopes = _with_slopes(t, w, h).persist()
        try:
            for _ in range(steps):
                pairs = pixel_pairs(s, t, kk, m, w, h, max_difference).join(slopes, ["tu", "tv"])
                a, b = solve(pairs, odometry_rows(kk, hybrid, weight), moved)
                step = solve_psd(a, -b)
                if step is None:
                    return False, np.eye(4), np.eye(4)
                step = twist_to_matrix(step)
                m, moved = step @ m, step @ moved
        finally:
            for x in (s, t, slopes):
                x.unpersist()
    return True, m, moved
