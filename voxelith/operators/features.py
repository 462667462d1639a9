"""Local features: histograms of the angles between normals around a point."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import cross, dot, sub
from ..plans.lineage import cut
from ..plans.leaves import PAIRS, neighbourhoods, placed, places, squares
from ..plans.spatial import MANY, XYZ, knn_join, radius_join
from .points import NORMAL

BINS = 11


def with_pair_features(pairs: DataFrame) -> DataFrame:
    """pairs (q_x .. q_nz, t_x .. t_nz) with three angles f1 to f3 and the distance f4; zeros where they are undefined.

    The point whose normal is nearer to the line between both is the origin of the frame. Each step is a projection of its own, so that no
    expression is repeated inside another.
    """
    cols = lambda s, names=XYZ: [F.col(f"{s}{c}") for c in names]
    named = lambda s, values: dict(zip([f"{s}{c}" for c in XYZ], values))
    out = pairs.withColumns(named("d_", sub(cols("t_"), cols("q_"))))
    out = out.withColumn("f4", F.sqrt(dot(cols("d_"), cols("d_"))))
    out = out.withColumns({"a1": dot(cols("q_", NORMAL), cols("d_")) / F.col("f4"), "a2": dot(cols("t_", NORMAL), cols("d_")) / F.col("f4")})
    out = out.withColumn("swap", F.abs("a1") < F.abs("a2"))
    u = [F.when(F.col("swap"), y).otherwise(x) for x, y in zip(cols("q_", NORMAL), cols("t_", NORMAL))]
    other = [F.when(F.col("swap"), x).otherwise(y) for x, y in zip(cols("q_", NORMAL), cols("t_", NORMAL))]
    out = out.withColumns(named("u_", u) | named("o_", other) | named("d_", [F.when(F.col("swap"), -x).otherwise(x) for x in cols("d_")]))
    out = out.withColumns(named("v_", cross(cols("d_"), cols("u_"))))
    out = out.withColumn("l", F.sqrt(dot(cols("v_"), cols("v_"))))
    out = out.withColumns(named("v_", [x / F.nullif("l", F.lit(0.0)) for x in cols("v_")]))
    out = out.withColumns(named("w_", cross(cols("u_"), cols("v_"))))
    zero = F.lit(0.0)
    ok = (F.col("f4") > 0) & (F.col("l") > 0)
    out = out.withColumns(
        {
            "f1": F.when(ok, F.atan2(dot(cols("w_"), cols("o_")), dot(cols("u_"), cols("o_")))).otherwise(zero),
            "f2": F.when(ok, dot(cols("v_"), cols("o_"))).otherwise(zero),
            "f3": F.when(ok, F.when(F.col("swap"), -F.col("a2")).otherwise(F.col("a1"))).otherwise(zero),
        }
    )
    return out.select(*pairs.columns, "f1", "f2", "f3", "f4")


def _pairs(df: DataFrame, k: int, radius: float | None) -> DataFrame:
    keep = [*XYZ, *NORMAL]
    if radius is None:
        return knn_join(df, df, k, keep_query=keep, keep_target=keep)
    return radius_join(df, df, radius, max_nn=k, keep_query=keep, keep_target=keep)


def spfh(pairs: DataFrame) -> DataFrame:
    """(id, feat): three histograms of BINS bins each, each summing to 100."""
    a, b, c = F.col("f1"), F.col("f2"), F.col("f3")
    turn = lambda x, low, span: F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor(BINS * (x - low) / span).cast("int")))
    bins = [turn(a, -math.pi, 2 * math.pi), turn(b, -1.0, 2.0) + BINS, turn(c, -1.0, 2.0) + 2 * BINS]
    each = with_pair_features(pairs.where("q <> t")).select("q", F.explode(F.array(*bins)).alias("bin"))
    counts = each.groupBy("q", "bin").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n") / 3
    return counts.groupBy(F.col("q").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"), total.alias("all")).select("id", F.transform(F.sequence(F.lit(0), F.lit(3 * BINS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)) * 100.0 / F.col("all")).alias("feat"))


def fpfh(df: DataFrame, k: int = 100, radius: float | None = None) -> DataFrame:
    """(id, feat): own histograms plus those of the neighbours, weighted by the inverse of the squared distance and made to sum to 100 each."""
    pairs = cut(_pairs(df, k, radius))
    own = cut(spfh(pairs))
    near = pairs.where("q <> t and d2 > 0").select("q", "t", "d2").join(own.select(F.col("id").alias("t"), "feat"), "t")
    parts = near.select("q", F.posexplode("feat").alias("bin", "v"), "d2").groupBy("q", "bin").agg(F.sum(F.col("v") / F.col("d2")).alias("v"))
    sums = parts.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("bin", "v"))).alias("s")).select(F.col("q").alias("id"), F.transform("s", lambda x: x["v"]).alias("s"))
    both = own.join(sums, "id", "left")
    block = lambda i: F.slice("s", F.floor(i / BINS).cast("int") * BINS + 1, BINS)
    share = lambda i: F.when(F.col("s").isNull(), F.lit(0.0)).otherwise(F.coalesce(F.get("s", i) * 100.0 / F.nullif(F.aggregate(block(i), F.lit(0.0), lambda a, x: a + x), F.lit(0.0)), F.lit(0.0)))
    return both.select("id", F.transform("feat", lambda v, i: v + share(i)).alias("feat"))


SHOT_BINS, SHOT_SECTORS = 10, 32


def local_frame(q: np.ndarray, distance: np.ndarray, radius: float) -> np.ndarray:
    """Rows x, y, z: the axes of the most and the least spread of the neighbours (n, 3), nearer ones counting more, each turned to where more of them lie."""
    w = radius - distance
    spread = np.linalg.eigh((q * w[:, None]).T @ q / w.sum())[1]
    axes = [spread[:, 2], spread[:, 0]]
    x, z = (-a if 2 * np.count_nonzero(q @ a >= 0) < len(q) else a for a in axes)
    return np.stack([x, np.cross(z, x), z])


def shot_of(q: np.ndarray, distance: np.ndarray, normal: np.ndarray, radius: float) -> np.ndarray:
    """The histogram of one point: q are its neighbours less itself. Eight sectors around, two heights and two shells, of SHOT_BINS + 1 bins of the cosine between
    the frame's z axis and the point's own normal; each neighbour also counts in part in the next bin, shell, height and sector."""
    out = np.zeros(SHOT_SECTORS * (SHOT_BINS + 1))
    if len(q) < 5:
        return out
    frame = local_frame(q, distance, radius)
    cosine = (1 + np.clip(frame[2] @ normal, -1, 1)) * SHOT_BINS / 2
    bin_ = int(np.floor(cosine + 0.5))
    past = cosine - bin_
    q, distance = q[distance > 0], distance[distance > 0]
    x, y, z = frame @ q.T
    # the sector's number: half plane, quadrant and octant of the direction around z
    back = (y > 0) | (y == 0) & (x < 0)
    side = np.where((x > 0) | (x == 0) & (y > 0), ~back, back)
    steep = np.where((x * y > 0) | (x == 0), np.abs(x) < np.abs(y), np.abs(x) > np.abs(y))
    sector = 4 * back + 2 * side + steep
    outer, upper = distance > radius / 2, z > 0
    volume = 4 * sector + 2 * outer + upper
    own = np.full(len(q), 1 - abs(past))

    def add(to: np.ndarray, part: np.ndarray, column: int, where=True) -> None:
        where = np.broadcast_to(where, part.shape)
        np.add.at(out, to[where] * (SHOT_BINS + 1) + column, part[where])

    add(volume, np.full(len(q), abs(past)), (bin_ + (1 if past > 0 else -1)) % SHOT_BINS)
    # shells: from the middle of the own one towards the other one
    off = (distance - np.where(outer, 0.75, 0.25) * radius) / (radius / 2)
    shared = np.where(outer, off <= 0, off >= 0)
    own += 1 - np.abs(off)
    add(volume + np.where(outer, -2, 2), np.abs(off), bin_, shared)
    # heights
    tilt = np.arccos(np.clip(z / distance, -1, 1))
    down = (tilt > math.pi / 2) | (np.abs(tilt - math.pi / 2) < 1e-30) & (z <= 0)
    off = (tilt - np.where(down, 0.75, 0.25) * math.pi) / (math.pi / 2)
    shared = np.where(down, off <= 0, off >= 0)
    own += 1 - np.abs(off)
    add(volume + np.where(down, 1, -1), np.abs(off), bin_, shared)
    # sectors
    flat = (x != 0) | (y != 0)
    off = np.clip((np.arctan2(y, x) - (-math.pi * 7 / 8 + math.pi / 4 * sector)) / (math.pi / 4), -0.5, 0.5)
    own += np.where(flat, 1 - np.abs(off), 0)
    add((volume + np.where(off > 0, 4, -4)) % SHOT_SECTORS, np.abs(off), bin_, flat)
    add(volume, own, bin_)
    norm = np.linalg.norm(out)
    return out / norm if norm else out


def shot(df: DataFrame, radius: float, max_nn: int = 100) -> DataFrame:
    """(id, feat): 352 numbers of norm 1, or zeros for points with fewer than five neighbours (max_nn at most, the nearest)."""
    if max_nn > MANY and df.count() <= max_nn:
        return _shot_of_all(df, radius)
    pairs = radius_join(df, df, radius, max_nn=max_nn, keep_query=[*XYZ, *NORMAL], keep_target=XYZ).where("q <> t")
    near = F.collect_list(F.struct("d2", "t", *[(F.col(f"t_{c}") - F.col(f"q_{c}")).alias(c) for c in XYZ]))
    each = pairs.groupBy("q").agg(F.array_sort(near).alias("near")).select(F.col("q").alias("id"), F.col("near.d2").alias("d2"), *[F.col(f"near.{c}").alias(f"d{c}") for c in XYZ])
    each = df.select("id", *NORMAL).join(each, "id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            feats = []
            for normal, d2, *d in zip(p[list(NORMAL)].to_numpy(), p["d2"], *(p[f"d{c}"] for c in XYZ)):
                feats.append(np.zeros(SHOT_SECTORS * (SHOT_BINS + 1)) if d2 is None else shot_of(np.stack(d, axis=1), np.sqrt(d2), normal, radius))
            yield pd.DataFrame({"id": p["id"], "feat": [f.tolist() for f in feats]})

    return each.mapInPandas(run, f"id {df.schema['id'].dataType.simpleString()}, feat array<double>")


def _shot_of_all(df: DataFrame, radius: float) -> DataFrame:
    """shot over all partners within the radius, taken where they are: no row is made for a pair."""
    import pyarrow as pa

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("t") if b.num_rows else b
        q, t, normals, own, other = places(a, [f"q_{c}" for c in XYZ]), places(b, [f"t_{c}" for c in XYZ]), places(a, [f"q_{c}" for c in NORMAL]), a["q"].to_numpy(), b["t"].to_numpy()
        feats, step = np.zeros((len(q), SHOT_SECTORS * (SHOT_BINS + 1))), max(1, PAIRS // max(1, len(t)))
        for s in range(0, len(q) if len(t) else 0, step):
            d2 = squares(q[s : s + step], t)
            for i, (row, at) in enumerate(zip(d2, range(s, s + len(d2)))):
                j = np.flatnonzero((row < radius * radius) & (other != own[at]))
                if len(j) >= 5:
                    j = j[np.argsort(row[j], kind="stable")]
                    feats[at] = shot_of(t[j] - q[at], np.sqrt(row[j]), normals[at], radius)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * feats.shape[1], pa.int32()), pa.array(feats.reshape(-1)))
        return pa.table({"id": a["q"], "feat": lists})

    found = neighbourhoods(df, df, radius, run, f"id {df.schema['id'].dataType.simpleString()}, feat array<double>", XYZ, keep_query=NORMAL)
    nothing = F.array_repeat(F.lit(0.0), SHOT_SECTORS * (SHOT_BINS + 1))
    return found.unionByName(df.where(~placed(XYZ)).select("id", nothing.alias("feat")))
