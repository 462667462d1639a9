"""Nearest partners over leaves: against brute force, with points that coincide, strays, ties and missing places, in one leaf and in many."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelith.operators import points, registration
from voxelith.plans import leaves, spatial


def frame(spark, p):
    return spark.createDataFrame([(i, *map(float, x), [float(i)]) for i, x in enumerate(p)], "id long, x double, y double, z double, w array<double>")


@pytest.fixture(scope="module")
def clouds():
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.normal(0, 1, (300, 3)), np.zeros((100, 3)), rng.integers(-2, 3, (100, 3)).astype(float), [[50.0, 0, 0]]])
    t = np.concatenate([rng.normal(0, 1, (300, 3)), np.ones((80, 3)), rng.integers(-2, 3, (150, 3)).astype(float)])
    return p, t


def brute(p, t, k, radius=np.inf):
    d = sum(((p[:, None, i] - t[None, :, i]) ** 2 for i in (1, 2)), (p[:, None, 0] - t[None, :, 0]) ** 2)
    return {(i, int(j)): d[i, j] for i in range(len(p)) for j in np.lexsort((np.arange(len(t)), d[i]))[:k] if d[i, j] < radius * radius}


@pytest.mark.parametrize("size", [4096, 60])
def test_nearest_within_a_radius_and_anywhere(spark, clouds, monkeypatch, size):
    monkeypatch.setattr(leaves, "LEAF", size)
    p, t = clouds
    a, b = frame(spark, p), frame(spark, t)
    for k, radius in ((1, 0.5), (3, 1.0), (300, 0.8)):
        got = spatial.radius_join(a, b, radius, max_nn=k, keep_query=["x", "w"], keep_target=["y", "w"]).collect()
        assert {(r["q"], r["t"]): r["d2"] for r in got} == brute(p, t, k, radius)
        assert all((r["q_x"], r["q_w"], r["t_y"], r["t_w"]) == (p[r["q"], 0], [r["q"]], t[r["t"], 1], [r["t"]]) for r in got)
    assert {(r["q"], r["t"]): r["d2"] for r in spatial.knn_join(a, b, 4).collect()} == brute(p, t, 4)


def test_few_rows_where_all_are_within_the_radius(spark, monkeypatch):
    monkeypatch.setattr(leaves, "LEAF", 64)
    p = np.random.default_rng(5).uniform(0, 1, (1500, 3))
    df = frame(spark, p)
    # candidates before the best are chosen: before, each point's 1500 partners were sorted
    assert leaves.k_nearest(df, df, 3, 10.0, spatial.XYZ).count() < 12 * len(p)
    assert {(r["q"], r["t"]): r["d2"] for r in spatial.radius_join(df, df, 10.0, max_nn=3).collect()} == brute(p, p, 3)


def test_points_without_a_place(spark, monkeypatch):
    monkeypatch.setattr(leaves, "LEAF", 20)
    df = frame(spark, np.random.default_rng(6).uniform(0, 1, (100, 3)))
    gaps = df.withColumn("x", F.when(F.col("id") % 2 == 0, F.col("x")).when(F.col("id") % 3 == 0, F.lit(float("nan"))))
    got = {(r["q"], r["t"]) for r in spatial.nearest(gaps, gaps, 0.5).collect()}
    assert got == {(i, i) for i in range(0, 100, 2)}
    assert spatial.nearest(df.limit(0), df, 0.5).count() == spatial.nearest(df, df.limit(0), 0.5).count() == 0


def test_closest_points_over_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(leaves, "LEAF", 50)
    df = frame(spark, np.random.default_rng(7).uniform(0, 10, (400, 3)))
    m = np.eye(4)
    m[:3, 3] = (0.05, -0.04, 0.03)
    found = registration.icp(points.transform(df.select("id", *spatial.XYZ), m), df, 1.0)
    assert np.allclose(found.transformation @ m, np.eye(4), atol=1e-6) and found.fitness == 1
