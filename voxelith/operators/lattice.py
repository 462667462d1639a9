"""Gaussian filtering on the permutohedral lattice, and registration by it (filter-based, after Gao and Tedrake, on the lattice of Adams, Baek and Davis)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..plans.spatial import XYZ
from .points import transform
from .registration import kabsch_of

OUTLIER = 0.2


def simplices(features: np.ndarray, blur: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Lattice points around each feature (n, d): keys (n, d + 1, d) and barycentric weights (n, d + 1).

    Features are lifted onto the plane of zero sums, the nearest point of remainder zero is found by rounding, and the order of the differences to it
    names the simplex: a matrix product, a rounding and a sort for all rows at once.
    """
    n, d = features.shape
    i = np.arange(1, d + 1)
    scaled = features * ((d + 1) * np.sqrt((2 / 3 if blur else 1 / 6) / (i * (i + 1))))
    lift = np.triu(np.ones((d + 1, d)))
    lift[i, i - 1] = -i
    lifted = scaled @ lift.T
    below, above = np.floor(lifted / (d + 1)) * (d + 1), np.ceil(lifted / (d + 1)) * (d + 1)
    zero = np.where(above - lifted < lifted - below, above, below).astype(np.int64)
    excess = zero.sum(axis=1, keepdims=True) // (d + 1)
    order = np.argsort(-(lifted - zero), axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(d + 1), order.shape), axis=1)
    # a sum off zero is made good where the differences are extreme
    rank = rank + excess
    turn = (rank < 0).astype(np.int64) - (rank > d)
    rank, zero = rank + turn * (d + 1), zero + turn * (d + 1)
    delta = np.empty((n, d + 1))
    np.put_along_axis(delta, rank, (lifted - zero) / (d + 1), axis=1)
    weights = np.empty((n, d + 1))
    weights[:, 0] = 1 + delta[:, d] - delta[:, 0]
    weights[:, 1:] = delta[:, d - 1 :: -1] - delta[:, :0:-1]
    color = np.arange(d + 1)
    keys = zero[:, None, :d] + color[:, None] - (d + 1) * (rank[:, None, :d] > d - color[:, None])
    return keys, weights


def splatted(df: DataFrame, sigma: float, id_col: str = "id") -> DataFrame:
    """(id, k0, k1, k2, w, x, y, z): a row for each of the four lattice points around each point's place over sigma."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            at = p[list(XYZ)].to_numpy()
            keys, w = simplices(at / sigma)
            corners = w.shape[1]
            flat = keys.reshape(-1, 3)
            yield pd.DataFrame({"id": np.repeat(p["id"].to_numpy(), corners), **{f"k{j}": flat[:, j] for j in range(3)}, "w": w.reshape(-1), **{c: np.repeat(at[:, j], corners) for j, c in enumerate(XYZ)}})

    return df.select(F.col(id_col).alias("id"), *XYZ).mapInPandas(run, f"id {kind}, k0 long, k1 long, k2 long, w double, x double, y double, z double")


LATTICE = ["k0", "k1", "k2"]


def lattice_of(target: DataFrame, sigma: float) -> DataFrame:
    """(k0, k1, k2, w, wx, wy, wz, wv): weights, weighted places and weighted squared norms, summed for each lattice point."""
    square = sum((F.col(c) * F.col(c) for c in XYZ), F.lit(0.0))
    return splatted(target, sigma).groupBy(*LATTICE).agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col(c)).alias(f"w{c}") for c in XYZ], F.sum(F.col("w") * square).alias("wv"))


def sliced(model: DataFrame, lattice: DataFrame, sigma: float, outlier: float = OUTLIER) -> DataFrame:
    """(id, x, y, z, tx, ty, tz, weight, m2) of each model point: the filtered target around it; zeros where less than 0.01 of weight is."""
    share = splatted(model, sigma).select("id", *LATTICE, F.col("w").alias("s"))
    sums = share.join(lattice, LATTICE).groupBy("id").agg(*[F.sum(F.col("s") * F.col(c)).alias(f"{c}_") for c in ("w", "wx", "wy", "wz", "wv")])
    out = model.select("id", *XYZ).join(sums, "id", "left")
    held = F.coalesce(F.col("w_") >= 1e-2, F.lit(False))
    mean = lambda c: F.when(held, F.col(c) / F.col("w_")).otherwise(F.lit(0.0))
    return out.select("id", *XYZ, *[mean(f"w{c}_").alias(f"t{c}") for c in XYZ], F.when(held, F.col("w_") / (F.col("w_") + outlier)).otherwise(0.0).alias("weight"), mean("wv_").alias("m2"))


def spread_of(found: DataFrame) -> float:
    """The standard deviation of the target around the model, on one axis."""
    square = sum((F.col(c) * F.col(c) for c in XYZ), F.lit(0.0))
    cross = sum((F.col(c) * F.col(f"t{c}") for c in XYZ), F.lit(0.0))
    r = found.agg(F.sum(F.col("weight") * (square - 2 * cross + F.col("m2"))).alias("a"), F.sum("weight").alias("b")).first()
    return float(np.sqrt((r["a"] or 0.0) / (max(r["b"] or 0.0, 1e-6) * 3)))


def likelihood(found: DataFrame) -> float:
    """The sum of the squares of weighted differences between model and target."""
    d2 = sum(((F.col(c) - F.col(f"t{c}")) * (F.col(c) - F.col(f"t{c}")) for c in XYZ), F.lit(0.0))
    return float(found.agg(F.sum(F.col("weight") * F.col("weight") * d2)).first()[0] or 0.0)


@dataclass
class FilterResult:
    transformation: np.ndarray
    likelihood: float


def filter_registration(source: DataFrame, target: DataFrame, init: np.ndarray | None = None, sigma: float = 0.1, least_change: float = 1e-6, least_sigma: float = 1e-4, iterations: int = 30) -> FilterResult:
    """Motions by expectation and maximisation: the target filtered around each source point, then a weighted fit; sigma shrinks with the fit's spread.

    One lattice of sums and one job of sums a round; the lattice is made anew when sigma changes.
    """
    m = np.eye(4) if init is None else np.array(init, float)
    source = source.select("id", *XYZ)
    lattice, last = cut(lattice_of(target, sigma)), 0.0
    for _ in range(iterations):
        found = cut(sliced(transform(source, m), lattice, sigma))
        pairs = found.select(*[F.col(c).alias(f"q_{c}") for c in XYZ], *[F.col(f"t{c}").alias(f"t_{c}") for c in XYZ], "weight")
        step = kabsch_of(pairs, "weight") if found.agg(F.sum("weight")).first()[0] else np.eye(4)
        m = step @ m
        moved = transform(found, step)
        now = spread_of(moved)
        if now > least_sigma:
            sigma = now
            lattice = cut(lattice_of(target, sigma))
        score = likelihood(moved)
        if abs(score - last) < least_change:
            last = score
            break
        last = score
    return FilterResult(m, last)
