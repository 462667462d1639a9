"""Fusion, lattices, stereo, odometry, features, pictures and lineage: against plain numpy or what was put in."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelith.functions import linalg
from voxelith.operators import alignment, features, fusion, images, lattice, meshes, points, stereo, volumes
from voxelith.plans import lineage
from voxelith.plans.spatial import XYZ
from voxelith.sources import files

K = np.array([[40.0, 0, 19.5], [0, 40.0, 14.5], [0, 0, 1]])


def frame(spark, img, depth):
    """An image of 40 by 30 depths."""
    v, u = np.indices((30, 40))
    d = depth(u, v)
    return spark.createDataFrame([(img, int(a), int(b), float(x)) for a, b, x in zip(v.ravel(), u.ravel(), d.ravel())], "img long, v int, u int, c0 double")


def test_values_and_normals_of_a_plane(spark):
    cells = [(x, y, z, (z + 0.5) * 0.1 - 0.4, 1.0) for x in range(10) for y in range(10) for z in range(10)]
    volume = spark.createDataFrame(cells, "ix int, iy int, iz int, tsdf double, weight double")
    spots = spark.createDataFrame([(1, 0.43, 0.51, 0.47), (2, 0.3, 0.7, 0.22), (3, 9.0, 9.0, 9.0)], "id long, x double, y double, z double")
    got = {r["id"]: r["value"] for r in fusion.values_at(spots, volume, 0.1).collect()}
    assert abs(got[1] - 0.07) < 1e-9 and abs(got[2] + 0.18) < 1e-9 and got[3] == 0
    normals = {r["id"]: (r["nx"], r["ny"], r["nz"]) for r in fusion.normals_at(spots, volume, 0.1).collect()}
    assert np.allclose(normals[1], (0, 0, 1)) and normals[3] == (None, None, None)


def test_raycast_finds_the_plane_from_before_only(spark):
    cells = [(x, y, z, 1.0 - (z + 0.5) * 0.1, 1.0) for x in range(-12, 12) for y in range(-12, 12) for z in range(5, 15)]
    volume = spark.createDataFrame(cells, "ix int, iy int, iz int, tsdf double, weight double")
    got = fusion.raycast(volume, K, np.eye(4), 40, 30, 0.1, 0.2).collect()
    assert len(got) > 1000
    assert all(abs(r["z"] - 1.0) < 0.08 and abs(r["nz"]) > 0.99 for r in got if 5 < r["u"] < 35 and 5 < r["v"] < 25)
    assert all(abs(r["x"] - (r["u"] - 19.5) / 40 * r["z"]) < 1e-9 for r in got)
    behind = linalg.rigid(linalg.rotation_y(np.pi), (0, 0, 2.0))
    assert fusion.raycast(volume, K, behind, 40, 30, 0.1, 0.2).count() == 0
    assert fusion.raycast(volume.limit(0), K, np.eye(4), 40, 30, 0.1, 0.2).count() == 0


def test_fused_frames_follow_the_camera(spark):
    """The same waves, seen from one and a half centimetres nearer in the second frame."""
    wave = lambda u, v: 1.0 + 0.1 * np.sin(u / 6.0) + 0.08 * np.cos(v / 5.0)
    state = fusion.Fusion(K, 40, 30, 0.04, 0.12, levels=1, iterations=(4,), sigma_depth=0.5, sigma_space=0.3, distance=0.1)
    first = state.process(frame(spark, 0, wave))
    assert np.allclose(first, np.eye(4)) and state.frames == 1
    cells = state.volume.count()
    second = state.process(frame(spark, 1, lambda u, v: wave(u, v) - 0.015))
    assert abs(second[2, 3] - 0.015) < 0.008 and np.abs(second[:2, 3]).max() < 0.02
    assert state.volume.count() >= cells and state.volume.agg(F.max("weight")).first()[0] == 2
    assert volumes.surface_points(state.volume, 0.04).count() > 100
    state.reset()
    assert state.volume is None and state.frames == 0 and not state.models


def test_frames_are_integrated_in_any_order_and_number(spark):
    flat = [frame(spark, i, lambda u, v, i=i: np.full(u.shape, 1.0 + 0.01 * i)) for i in range(3)]
    pixels = [f.select("img", "v", "u", F.col("c0").alias("depth")) for f in flat]
    cells = volumes.open_cells(images.back_project(flat[0], K, None, 1.0, 3.0), 0.1, 0.2)
    whole = volumes.integrate(None, cells, pixels[0].unionByName(pixels[1]).unionByName(pixels[2]), K, np.eye(4), 0.1, 0.2)
    step = None
    for p in (pixels[2], pixels[0], pixels[1]):
        step = volumes.integrate(step, cells, p, K, np.eye(4), 0.1, 0.2)
    a, b = ({(r["ix"], r["iy"], r["iz"]): (round(r["tsdf"], 9), r["weight"]) for r in d.collect()} for d in (whole, step))
    assert a == b and {w for _, w in a.values()} <= {1.0, 2.0, 3.0}


def test_simplices_hold_their_features():
    rng = np.random.default_rng(1)
    for d in (2, 3, 5):
        f = rng.normal(size=(400, d)) * 3
        keys, w = lattice.simplices(f)
        assert (w >= -1e-9).all() and np.allclose(w.sum(axis=1), 1)
        i = np.arange(1, d + 1)
        scaled = f * ((d + 1) * np.sqrt(1 / 6 / (i * (i + 1))))
        lift = np.triu(np.ones((d + 1, d)))
        lift[i, i - 1] = -i
        assert np.allclose(np.einsum("nc,ncd->nd", w, keys), (scaled @ lift.T)[:, :d])
        # all coordinates of a lattice point leave the same remainder
        last = -keys.sum(axis=2, keepdims=True)
        assert (np.ptp(np.concatenate([keys, last], axis=2) % (d + 1), axis=2) == 0).all()


def test_filter_registration_comes_nearer(spark):
    rng = np.random.default_rng(2)
    p = rng.uniform(-1, 1, (300, 3)) * [1, 0.7, 0.2]
    target = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double, z double")
    motion = linalg.rigid(linalg.rotation_z(0.1), (0.08, -0.05, 0.03))
    found = lattice.filter_registration(points.transform(target, motion), target, sigma=0.3, iterations=8)
    assert np.abs(found.transformation @ motion - np.eye(4)).max() < 0.05
    assert lattice.filter_registration(target, target.limit(0), iterations=2).transformation.tolist() == np.eye(4).tolist()


def test_stereo_finds_a_step():
    rng = np.random.default_rng(3)
    wide = rng.integers(0, 255, (40, 100)).astype(float)
    left, right = wide[:, 10:90], wide[:, 14:94].copy()
    right[20:] = wide[20:, 17:97]
    found = stereo.disparities_of(left, right, 16)
    assert (found[5:15, 20:70] == 4).mean() > 0.95 and (found[26:36, 20:70] == 7).mean() > 0.95
    # with another right image fewer pixels get a disparity
    other = stereo.disparities_of(left, rng.integers(0, 255, (40, 80)).astype(float), 16)
    assert (other == stereo.INVALID).mean() > (found[:, 20:70] == stereo.INVALID).mean() + 0.1


def test_stereo_costs_are_counted_bits():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 9, (2, 12, 20)).astype(float)
    ca, cb = stereo.census(a), stereo.census(b)
    cost = stereo.costs(a, b, 5)
    for d in range(5):
        for u in range(d, 20):
            assert cost[3, u, d] == bin(int(ca[3, u]) ^ int(cb[3, u - d])).count("1")


def test_shot_is_turned_with_its_points(spark):
    """Histograms do not change when the cloud is moved; a point with few neighbours has none."""
    rng = np.random.default_rng(5)
    p = rng.uniform(-1, 1, (120, 3))
    n = rng.normal(size=(120, 3))
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, *map(float, x), *map(float, y)) for i, (x, y) in enumerate(zip(p, n))] + [(500, 90.0, 0.0, 0.0, 0.0, 0.0, 1.0)], "id long, x double, y double, z double, nx double, ny double, nz double")
    m = linalg.rigid(linalg.rotation_from_euler("xyz", (0.4, -0.7, 1.1)), (1, 2, 3))
    a, b = ({r["id"]: np.array(r["feat"]) for r in features.shot(d, 0.8).collect()} for d in (df, points.transform(df, m)))
    assert len(a) == 121 and all(len(f) == 352 for f in a.values()) and not a[500].any()
    assert np.mean([np.abs(a[i] - b[i]).max() < 1e-6 for i in range(120)]) > 0.95
    assert all(abs(np.linalg.norm(a[i]) - 1) < 1e-9 for i in range(120) if a[i].any())


def test_weighted_odometry_and_its_prior(spark):
    v, u = np.indices((30, 40))
    wave = lambda s: 0.5 + 0.3 * np.sin((u + s) / 5.0) * np.cos(v / 4.0)
    rows = lambda s: spark.createDataFrame([(int(a), int(b), float(i), 1.0 + 0.002 * float(b) + 0.003 * float(a)) for a, b, i in zip(v.ravel(), u.ravel(), wave(s).ravel())], "v int, u int, intensity double, depth double")
    ok, m, twist, information = alignment.weighted_rgbd_odometry(rows(0), rows(0.4), K, 40, 30, iterations=(3,), max_difference=0.1)
    assert ok and m[0, 3] < -0.002 and information.shape == (6, 6) and np.allclose(linalg.twist_to_matrix(twist), m)
    # a strong belief in no motion holds it
    held = alignment.weighted_rgbd_odometry(rows(0), rows(0.4), K, 40, 30, iterations=(3,), max_difference=0.1, inverse_sigma=(1e9,) * 6)
    assert held[0] and np.abs(held[1] - np.eye(4)).max() < 1e-4
    none = spark.createDataFrame([], "v int, u int, intensity double, depth double")
    assert not alignment.weighted_rgbd_odometry(none, none, K, 40, 30, iterations=(1,))[0]


def test_normalized_intensities(spark):
    df = spark.createDataFrame([(0, i, 0.1 * i, 1.0) for i in range(5)], "v int, u int, intensity double, depth double")
    pairs = spark.createDataFrame([(0.1, 0.4), (0.3, 0.4)], "si double, ti double")
    a, b = alignment.normalize_intensity(df, df, pairs)
    assert [round(r["intensity"], 6) for r in a.orderBy("u").collect()] == [0.0, 0.25, 0.5, 0.75, 1.0]
    assert round(b.agg(F.max("intensity")).first()[0], 6) == 0.5


def test_pictures_with_three_channels(spark, tmp_path):
    v, u = np.indices((16, 24))
    df = spark.createDataFrame([(0, int(a), int(b), 40 + 8 * int(b // 8), 90, 200 - 8 * int(a // 8)) for a, b in zip(v.ravel(), u.ravel())], "img long, v int, u int, c0 int, c1 int, c2 int")
    files.write_jpeg(df, f"{tmp_path}/a.jpg", 24, 16, 95)
    got = files.read_jpeg(spark, f"file://{tmp_path}/a.jpg").join(df.select("v", "u", *[F.col(f"c{i}").alias(f"d{i}") for i in range(3)]), ["v", "u"]).collect()
    assert len(got) == 16 * 24 and all(abs(r[f"c{i}"] - r[f"d{i}"]) <= 12 for r in got for i in range(3))
    with pytest.raises(ValueError):
        files.write_images(df, str(tmp_path), 24, 16, "gif")


def test_solids_are_closed_and_turned_outwards():
    for shape in (meshes.box, meshes.tetrahedron, meshes.octahedron, meshes.icosahedron, meshes.sphere, meshes.cylinder, meshes.cone, meshes.torus, meshes.arrow):
        p, t = shape()
        sides = [(a, b) for x in t.tolist() for a, b in zip(x, x[1:] + x[:1])]
        assert len(set(sides)) == len(sides) and {(b, a) for a, b in sides} == set(sides)
        assert sum(p[a] @ np.cross(p[b], p[c]) for a, b, c in t) > 0


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        lineage.folder(Elsewhere)
    assert list(XYZ) == ["x", "y", "z"]
