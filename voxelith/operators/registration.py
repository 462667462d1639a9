"""Rigid registration: correspondences by range join, sums in one aggregate, small solves on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import kabsch, solve_psd, twist_to_matrix
from ..plans.leaves import Leaves
from ..plans.spatial import XYZ, nearest
from .points import COLOR, NORMAL, estimate_normals, transform


#: Distances between features that a worker holds at once.
DISTANCES = 1 << 20


@dataclass
class Result:
    transformation: np.ndarray
    fitness: float
    inlier_rmse: float
    correspondences: DataFrame | None = None


def correspondences(source: DataFrame, target: DataFrame | Leaves, distance: float, normals: bool = False, source_normals: bool = False, colors: bool = False) -> DataFrame:
    """(q, t, d2, q_x ..., t_x ...): the nearest target of each source point within the distance. Leaves of the target have to keep the named columns."""
    more = [*XYZ, *(NORMAL if normals else ()), *(COLOR if colors else ())]
    own = [*XYZ, *(NORMAL if source_normals else ()), *(COLOR if colors else ())]
    return nearest(source, target, distance, keep_query=own, keep_target=more)


def evaluate(source: DataFrame, target: DataFrame, distance: float, m: np.ndarray | None = None) -> Result:
    m = np.eye(4) if m is None else m
    pairs = correspondences(transform(source.select("id", *XYZ), m), target, distance)
    r = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum("d2").alias("s")).first()
    total = source.count()
    return Result(m, r["n"] / total if total else 0.0, float(np.sqrt(r["s"] / r["n"])) if r["n"] else 0.0, pairs.select("q", "t", "d2"))


def sums_for_kabsch(pairs: DataFrame, weight: str | None = None) -> DataFrame:
    """One row: n, means of both sides and of their products; weighted if a column is named."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    total = F.sum(w)
    aggs = [F.count(F.lit(1)).alias("n"), total.alias("w")]
    aggs += [(F.sum(w * F.col(f"{s}_{c}")) / total).alias(f"{s}{c}") for s in "qt" for c in XYZ]
    aggs += [(F.sum(w * F.col(f"q_{a}") * F.col(f"t_{b}")) / total).alias(f"{a}{b}") for a in XYZ for b in XYZ]
    return pairs.agg(*aggs)


def kabsch_of(pairs: DataFrame, weight: str | None = None) -> np.ndarray:
    """The motion that takes the q side nearest to the t side."""
    r = sums_for_kabsch(pairs, weight).first()
    if not r["n"]:
        return np.eye(4)
    return kabsch(r["n"], np.array([r[f"q{c}"] for c in XYZ]), np.array([r[f"t{c}"] for c in XYZ]), np.array([[r[a + b] for b in XYZ] for a in XYZ]))


def jtj(pairs: DataFrame, rows: list[tuple[list, object]]) -> tuple[np.ndarray, np.ndarray, float]:
    """Normal equations of residual rows (Jacobian of six columns, residual), summed over all pairs in one aggregate."""
    n = len(rows[0][0])
    aggs = []
    for i in range(n):
        aggs += [F.sum(sum((j[i] * j[k] for j, _ in rows[1:]), rows[0][0][i] * rows[0][0][k])).alias(f"a{i}_{k}") for k in range(i, n)]
        aggs.append(F.sum(sum((j[i] * r for j, r in rows[1:]), rows[0][0][i] * rows[0][1])).alias(f"b{i}"))
    aggs.append(F.sum(sum((r * r for _, r in rows[1:]), rows[0][1] * rows[0][1])).alias("r2"))
    found = pairs.agg(*aggs).first()
    a = np.array([[found[f"a{min(i, k)}_{max(i, k)}"] or 0.0 for k in range(n)] for i in range(n)])
    return a, np.array([found[f"b{i}"] or 0.0 for i in range(n)]), found["r2"] or 0.0


def _cross(p: list, n: list) -> list:
    return [p[1] * n[2] - p[2] * n[1], p[2] * n[0] - p[0] * n[2], p[0] * n[1] - p[1] * n[0]]


def _cols(prefix: str, names=XYZ) -> list:
    return [F.col(f"{prefix}_{c}") for c in names]


def plane_rows(symmetric: bool = False) -> list[tuple[list, object]]:
    """Distance of the source point to the target's tangent plane (symmetric: along the sum of both normals)."""
    p, q, n = _cols("q"), _cols("t"), _cols("t", NORMAL)
    if symmetric:
        n = [a + b for a, b in zip(n, _cols("q", NORMAL))]
    r = sum(((a - b) * c for a, b, c in zip(p, q, n)), F.lit(0.0))
    arm = [a + b for a, b in zip(p, q)] if symmetric else p
    return [([*_cross(arm, n), *n], r)]


class PointToPoint:
    needs = {}

    def step(self, pairs: DataFrame) -> np.ndarray:
        return kabsch_of(pairs)

    def rmse(self, pairs: DataFrame) -> float:
        r = pairs.agg(F.avg(sum(((a - b) * (a - b) for a, b in zip(_cols("q"), _cols("t"))), F.lit(0.0)))).first()[0]
        return float(np.sqrt(r or 0.0))


class PointToPlane:
    needs = {"normals": True}
    symmetric = False

    def step(self, pairs: DataFrame) -> np.ndarray:
        a, b, _ = jtj(pairs, plane_rows(self.symmetric))
        x = solve_psd(a, -b)
        return np.eye(4) if x is None else twist_to_matrix(x)

    def rmse(self, pairs: DataFrame) -> float:
        r = plane_rows(self.symmetric)[0][1]
        return float(np.sqrt(pairs.agg(F.avg(r * r)).first()[0] or 0.0))


class Symmetric(PointToPlane):
    """Both sides turn by half: the solved rotation is applied twice, the translation is turned with it."""

    needs = {"normals": True, "source_normals": True}
    symmetric = True

    def step(self, pairs: DataFrame) -> np.ndarray:
        a, b, _ = jtj(pairs, plane_rows(True))
        x = solve_psd(a, -b)
        if x is None:
            return np.eye(4)
        half = twist_to_matrix(np.concatenate([x[:3], np.zeros(3)]))[:3, :3]
        m = np.eye(4)
        m[:3, :3], m[:3, 3] = half @ half, half @ x[3:]
        return m


def icp(source: DataFrame, target: DataFrame, distance: float, init: np.ndarray | None = None, estimation=None, iterations: int = 30, least_fitness: float = 1e-6, least_rmse: float = 1e-6) -> Result:
    """Iterated closest points; one job for each iteration, with the motion so far as literals over the source.

    Stops when neither fitness nor rmse changes any more.
    """
    estimation = estimation or PointToPoint()
    m = np.eye(4) if init is None else np.array(init, float)
    names = ["id", *XYZ, *(NORMAL if estimation.needs.get("source_normals") else ())]
    needs = [n for what, more in (("normals", NORMAL), ("colors", COLOR)) if estimation.needs.get(what) for n in more]
    source, target = source.select(*names).persist(), Leaves(target, XYZ, keep=[*XYZ, *needs])  # the target is dealt once for all iterations
    total = source.count()
    last = None
    for i in range(iterations + 1):
        pairs = correspondences(transform(source, m), target, distance, **estimation.needs).persist()
        r = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum("d2").alias("s")).first()
        now = (r["n"] / total if total else 0.0, float(np.sqrt(r["s"] / r["n"])) if r["n"] else 0.0)
        if i == iterations or not r["n"] or last and abs(now[0] - last[0]) < least_fitness and abs(now[1] - last[1]) < least_rmse:
            return Result(m, *now, pairs.select("q", "t", "d2"))
        m = estimation.step(pairs) @ m
        pairs.unpersist()
        last = now
    raise AssertionError


def information_matrix(pairs: DataFrame) -> np.ndarray:
    """Sum of G^T G over the pairs, G being the motion's derivative at the target point (rotation first)."""
    x, y, z = _cols("t")
    zero, one = F.lit(0.0), F.lit(1.0)
    rows = [([zero, z, -y, one, zero, zero], zero), ([-z, zero, x, zero, one, zero], zero), ([y, -x, zero, zero, zero, one], zero)]
    return jtj(pairs, rows)[0]


def with_normals(df: DataFrame, k: int = 20) -> DataFrame:
    return df if "nx" in df.columns else estimate_normals(df, k)


def match_features(a: DataFrame, b: DataFrame, dims: int) -> DataFrame:
    """(i, j): pairs of rows of two feature tables (id, feat) that are each other's nearest, by blocked matrix products; ties go to the lower id."""
    both = _nearest_features(a, b, dims).select(F.col("q").alias("i"), F.col("t").alias("j"))
    back = _nearest_features(b, a, dims).select(F.col("t").alias("i"), F.col("q").alias("j"))
    return both.intersect(back)


def _nearest_features(query: DataFrame, target: DataFrame, dims: int, block: int = 20_000) -> DataFrame:
    """(q, t, d2): targets go to the workers in blocks of bounded size, each query keeps its best of every block, ties by the lower id. No more than DISTANCES are held at once."""
    import pandas as pd

    spark, out = query.sparkSession, None

    def finder(shared):
        def run(batches):
            ids, feats, squares = shared.value
            step = max(1, DISTANCES // len(ids))
            for p in (b.iloc[s : s + step] for b in batches for s in range(0, len(b), step)):
                f = np.stack(p["feat"].to_numpy())
                own = (f * f).sum(1)
                d = f @ feats.T
                d *= -2
                d += squares
                # products are rounded: all that may be the nearest are looked at exactly
                i, j = np.nonzero(d <= d.min(axis=1, keepdims=True) + 1e-12 * (own[:, None] + squares.max()))
                exact = ((f[i] - feats[j]) ** 2).sum(1)
                i, j, exact = (x[np.lexsort((j, exact, i))] for x in (i, j, exact))
                first = np.searchsorted(i, np.arange(len(f)))
                yield pd.DataFrame({"q": p["id"].to_numpy(), "t": ids[j[first]], "d2": exact[first]})

        return run

    rows = []

    def flush():
        nonlocal out, rows
        if rows:
            rows.sort()
            feats = np.array([r[1] for r in rows])
            shared = spark.sparkContext.broadcast((np.array([r[0] for r in rows]), feats, (feats * feats).sum(1)))
            part = query.select("id", "feat").mapInPandas(finder(shared), "q long, t long, d2 double")
            out = part if out is None else out.unionByName(part)
            rows = []

    for r in target.select("id", "feat").toLocalIterator():
        rows.append((r["id"], list(r["feat"])))
        if len(rows) >= block:
            flush()
    flush()
    if out is None:
        return spark.createDataFrame([], "q long, t long, d2 double")
    return out.groupBy("q").agg(F.min(F.struct("d2", "t")).alias("b")).select("q", "b.t", "b.d2")
