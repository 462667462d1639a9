"""Work that is done where the rows are, against plain forms of it."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelith import queries
from voxelith.functions import predicates
from voxelith.operators import features, images, points, registration, voxels
from voxelith.plans import leaves, spatial


def frame(spark, p, first=0):
    return spark.createDataFrame([(first + i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double, z double")


def test_nearest_features_hold_few_distances(spark, monkeypatch):
    rng = np.random.default_rng(2)
    p, t = rng.integers(0, 3, (300, 4)).astype(float), rng.integers(0, 3, (500, 4)).astype(float)
    made = [(spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(a)], "id long, feat array<double>")) for a in (p, t)]
    monkeypatch.setattr(registration, "DISTANCES", 5000)
    d = ((p[:, None] - t[None]) ** 2).sum(-1)
    got = {r["q"]: (r["t"], r["d2"]) for r in registration._nearest_features(*made, 4, block=200).collect()}
    assert got == {i: (int(d[i].argmin()), d[i].min()) for i in range(len(p))}
    assert registration._nearest_features(made[0], made[1].limit(0), 4).count() == 0


def test_smoothed_without_a_row_for_each_pair(spark, monkeypatch):
    monkeypatch.setattr(leaves, "LEAF", 30)
    p = np.random.default_rng(3).normal(0, 1, (400, 3))
    df = frame(spark, p).withColumns({c: F.when(F.col("id") % 3 > 0, F.col("x")) for c in points.COLOR})
    out = points.gaussian_filter(df, 0.8, 0.25, max_nn=10**6)
    assert "Window" not in (plan := out._jdf.queryExecution().toString()) and "CoGroup" in plan
    want = points.gaussian_filter(df, 0.8, 0.25, max_nn=1000)
    a, b = (sorted(x.collect()) for x in (out, want))
    assert len(a) == len(p)
    for r, s in zip(a, b):
        assert all((v is None) == (w is None) and (v is None or math.isclose(v, w, abs_tol=1e-9)) for v, w in zip(r, s))


def test_shot_without_a_row_for_each_pair(spark, monkeypatch):
    monkeypatch.setattr(leaves, "LEAF", 30)
    p = np.random.default_rng(4).normal(0, 1, (300, 3))
    df = frame(spark, p).withColumn("x", F.when(F.col("id") > 0, F.col("x"))).withColumns(dict(zip(points.NORMAL, (F.lit(0.6), F.lit(0.0), F.lit(0.8)))))
    out = features.shot(df, 1.0, 10**6)
    assert "Window" not in (plan := out._jdf.queryExecution().toString()) and "CoGroup" in plan
    a, b = ({r["id"]: np.array(r["feat"]) for r in x.collect()} for x in (out, features.shot(df, 1.0, 1000)))
    assert a.keys() == b.keys() and len(a) == 300 and all(np.allclose(a[i], b[i]) for i in a) and not a[0].any()


def test_bilateral_in_bands(spark):
    rng = np.random.default_rng(5)
    px = [(img, v, u, float(rng.uniform(0, 30))) for img in (0, 1) for v in range(-3, 140) for u in range(5, 25) if rng.random() < 0.7]
    px += [(0, 64, 10, None), (0, 64, 11, 3.0), (0, 64, 11, 4.0), (2, 0, 0, None)]
    df = spark.createDataFrame(px, "img long, v long, u long, c0 double").dropDuplicates(["img", "v", "u", "c0"])
    px = [tuple(r) for r in df.collect()]
    out = images.bilateral(df, 100, 200, 2, 10.0, 2.0)
    assert "Join" not in out._jdf.queryExecution().toString()
    at = {}
    for x in px:
        at.setdefault(x[:3], []).append(x[3])
    want = {}
    for k, own in at.items():
        near = [(c, o, i, j) for o in own for i in range(-2, 3) for j in range(-2, 3) for c in at.get((k[0], k[1] + i, k[2] + j), []) if c is not None and o is not None]
        w = [math.exp(-(i * i + j * j) / 8) * math.exp(-(c - o) ** 2 / 200) for c, o, i, j in near]
        want[k] = sum(a * n[0] for a, n in zip(w, near)) / sum(w) if near else None
    got = {tuple(r)[:3]: r["c0"] for r in out.collect()}
    assert got.keys() == want.keys() and all(got[k] == want[k] or math.isclose(got[k], want[k], rel_tol=1e-9) for k in got)


def test_capsules_look_at_cells_along_them_only(spark):
    rng = np.random.default_rng(6)
    rows = [(i, *map(float, rng.uniform(-3, 3, 6)), float(r)) for i, r in enumerate(rng.uniform(0.05, 0.6, 60))]
    rows += [(60, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.5), (61, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.5), (62, 0.0, 0.0, 0.0, 0.0, 2.5, 1e-13, 0.25)]
    capsules = spark.createDataFrame(rows, "pid long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double, radius double")
    cells = spark.createDataFrame([tuple(map(int, c)) for c in np.unique(rng.integers(-8, 9, (1500, 3)), axis=0)], "ix int, iy int, iz int")
    low = [F.col(k) * 0.5 for k in ("ix", "iy", "iz")]
    hit = predicates.capsule_aabb(F.col("radius"), [F.col(f"{k}0") for k in spatial.XYZ], [F.col(f"{k}1") - F.col(f"{k}0") for k in spatial.XYZ], low, [v + 0.5 for v in low])
    want = {}
    for i, *v in capsules.crossJoin(cells).where(hit).select("pid", "ix", "iy", "iz").collect():
        want[i] = min(want.get(i, tuple(v)), tuple(v))
    out = voxels.collide_capsules(cells, capsules, 0.5, (0, 0, 0))
    assert {r[0]: tuple(r[1:]) for r in out.collect()} == want and len(want) > 50
    assert "ArrowEvalPython" in (plan := out._jdf.queryExecution().toString()) or "MapInPandas" in plan  # the test of a box is no expression of its steps any more


@pytest.mark.parametrize("few", [40, 4096])
def test_triangles_meet_once_over_leaves(spark, monkeypatch, few):
    from voxelith.operators import meshes
    from voxelith.operators.boxes import triangles_triangles

    monkeypatch.setattr(meshes, "FACES", few)
    rng = np.random.default_rng(8)
    p = np.concatenate([rng.normal(0, 1, (90, 3)), rng.integers(-2, 3, (60, 3)).astype(float)])
    t = [(100 - i, *map(int, rng.choice(150, 3, replace=False))) for i in range(100)]
    mesh = frame(spark, p), spark.createDataFrame(t, "tid long, v0 long, v1 long, v2 long")
    out = meshes.self_intersecting_triangles(mesh, 1.0)
    assert "dropDuplicates" not in (plan := out._jdf.queryExecution().toString()) and "Deduplicate" not in plan and "CoGroup" in plan
    places, shared = {i: p[list(v)] for i, *v in t}, {i: set(v) for i, *v in t}
    pairs = [(i, j) for i in places for j in places if i < j and not shared[i] & shared[j] and (places[i].min(0) <= places[j].max(0)).all() and (places[j].min(0) <= places[i].max(0)).all()]
    hit = triangles_triangles(np.array([places[i] for i, _ in pairs]), np.array([places[j] for _, j in pairs]))
    assert sorted(tuple(r) for r in out.collect()) == sorted(x for x, h in zip(pairs, hit) if h) and hit.sum() > 50


def test_clusters_without_a_row_for_each_pair(spark, monkeypatch):
    from voxelith.operators import graphs

    limits, join = [], graphs.radius_join
    monkeypatch.setattr(graphs, "radius_join", lambda *a, max_nn=None, **more: limits.append(max_nn) or join(*a, max_nn=max_nn, **more))

    rng = np.random.default_rng(9)
    # two dense heaps whose nearest points are a little less than eps apart, a third too far away, copies, and loose points
    heaps = [rng.uniform(0, 0.3, (150, 3)), rng.uniform(0, 0.3, (150, 3)) + [0.85, 0, 0], rng.uniform(0, 0.3, (80, 3)) + [0, 3, 0], np.full((20, 3), -2.0), rng.uniform(-4, 4, (80, 3))]
    heaps[0][0], heaps[1][0] = (0.3, 0.15, 0.15), (0.85, 0.15, 0.15)
    p = np.concatenate(heaps)[rng.permutation(480)]
    df, eps, least = frame(spark, p, 5), 0.56, 4
    d = ((p[:, None] - p[None]) ** 2).sum(-1) < eps * eps
    np.fill_diagonal(d, False)
    core = d.sum(1) >= least
    part = np.where(core, np.arange(len(p)), len(p))
    while True:
        next_ = np.where(core, np.minimum(part, np.where(d & core[None, :], part[None, :], len(p)).min(1)), part)
        if (next_ == part).all():
            break
        part = next_
    for i in np.flatnonzero(~core):
        near = np.flatnonzero(d[i] & core)
        part[i] = part[near[0]] if len(near) else -1
    sizes = {c: (part == c).sum() for c in set(part) - {-1}}
    number = {c: i for i, c in enumerate(sorted(c for c, n in sizes.items() if n >= least))}
    assert {r["id"] - 5: r["cluster"] for r in graphs.cluster_dbscan(df, eps, least).collect()} == {i: number.get(c, -1) for i, c in enumerate(part)}
    assert limits == [least + 1]  # before, all pairs within eps
