import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelith.functions import linalg, predicates
from voxelith.operators import graphs, images, meshes, points, registration, scans, voxels
from voxelith.plans import ranking, spatial


def frame(spark, p, first=0):
    return spark.createDataFrame([(first + i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double, z double")


@pytest.fixture(scope="module")
def cloud():
    return np.random.default_rng(0).uniform(0, 10, (300, 3))


def test_rotations():
    a, b, c = 0.3, -0.8, 1.1
    assert np.allclose(linalg.rotation_from_euler("xyz", (a, b, c)), linalg.rotation_x(a) @ linalg.rotation_y(b) @ linalg.rotation_z(c))
    v = np.array([0.2, -0.5, 0.9])
    m = linalg.twist_to_matrix([*v, 1, 2, 3])
    assert np.allclose(linalg.matrix_to_twist(m), [*v, 1, 2, 3]) and np.allclose(m[:3, :3] @ m[:3, :3].T, np.eye(3))
    n = np.linalg.norm(v)
    assert np.allclose(linalg.rotation_from_quaternion([np.cos(n / 2), *(np.sin(n / 2) * v / n)]), linalg.rotation_from_axis_angle(v))
    assert np.allclose(linalg.rotation_between_x_axis_and(v)[:, 0], v / n)
    assert np.allclose(linalg.matrix_to_twist(linalg.twist_to_matrix([np.pi, 0, 0, 0, 0, 0]))[:3], [np.pi, 0, 0])
    k = linalg.intrinsic_pyramid(np.array([[100, 0, 49.5], [0, 100, 39.5], [0, 0, 1]]), 3)
    assert np.allclose(k[1], [[50, 0, 24.5], [0, 50, 19.5], [0, 0, 1]]) and len(k) == 3
    assert linalg.solve_psd(np.zeros((2, 2)), np.ones(2)) is None
    s = np.array([[4.0, 1, 0], [1, 3, 0], [0, 0, 2]])
    assert np.allclose(linalg.sqrt_symmetric(s) @ linalg.sqrt_symmetric(s), s)


def test_neighbours_of_clusters_and_strays(spark):
    rng = np.random.default_rng(4)
    p = np.concatenate([rng.normal(0, 0.01, (80, 3)), rng.normal(50, 5, (20, 3)), [[1000.0, 0, 0]]])
    df = frame(spark, p)
    got = {(r["q"], r["t"]) for r in spatial.knn_join(df, df, 4).collect()}
    d = ((p[:, None] - p[None]) ** 2).sum(-1)
    assert got == {(i, int(j)) for i in range(len(p)) for j in np.lexsort((np.arange(len(p)), d[i]))[:4]}
    assert spatial.knn_join(df, df.limit(2), 5).count() == 2 * len(p)


def test_statistics_of_the_cross(spark):
    p = [(0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1), (2, 0, 0)]
    got = points.remove_radius_outlier(frame(spark, p), 6, 1.1)
    assert [r["id"] for r in got.collect()] == [0]


def test_box_along_the_principal_axes(spark, cloud):
    r = linalg.rotation_from_axis_angle([0.3, 0.2, -0.5])
    p = (cloud * [4, 2, 1]) @ r.T
    center, axes, extent = points.oriented_bounding_box(frame(spark, p))
    local = (p - center) @ axes
    assert np.allclose(np.abs(local).max(axis=0), extent / 2) and np.allclose(axes.T @ axes, np.eye(3)) and extent[0] > extent[1] > extent[2]


def test_normals_of_a_plane(spark):
    rng = np.random.default_rng(2)
    p = rng.uniform(-1, 1, (100, 3))
    p[:, 2] = 0.5 * p[:, 0]
    got = points.estimate_normals(frame(spark, p), 8).select(*points.NORMAL).toPandas().to_numpy()
    n = np.array([-0.5, 0, 1]) / np.sqrt(1.25)
    assert np.allclose(np.abs(got @ n), 1)


def test_plane_segmentation(spark):
    rng = np.random.default_rng(5)
    p = rng.uniform(-1, 1, (200, 3))
    p[:150, 2] = 0.3 * p[:150, 0] - 0.2 * p[:150, 1] + 0.1
    plane, inliers = points.segment_plane(frame(spark, p), 0.01, 100, seed=1)
    assert {r["id"] for r in inliers.collect()} >= set(range(150)) and np.allclose(plane / -plane[2], [0.3, -0.2, -1, 0.1], atol=0.01)
    on = [(1, 1, -1), (2, 2, -5), (-1, -1, 1), (-2, -2, 3), (10, 10, -21)]
    assert points.segment_plane(frame(spark, on), 0.1, 50)[1].count() == 5


def test_covariances_turn(spark):
    c = np.diag([1.0, 2, 3])
    df = spark.createDataFrame([(0, 1.0, 0.0, 0.0, c.reshape(-1).tolist())], "id long, x double, y double, z double, cov array<double>")
    m = linalg.rigid(linalg.rotation_from_axis_angle([0.1, 0.5, 0.2]))
    got = points.transform(df, m).first()
    assert np.allclose(np.array(got["cov"]).reshape(3, 3), m[:3, :3] @ c @ m[:3, :3].T)


def test_farthest_points(spark, cloud):
    got = {r["id"] for r in points.farthest_point_down_sample(frame(spark, cloud), 12).collect()}
    d, now, want = np.full(len(cloud), np.inf), 0, []
    for _ in range(12):
        want.append(now)
        d = np.minimum(d, ((cloud - cloud[now]) ** 2).sum(1))
        now = int(d.argmax())
    assert got == set(want)


def test_row_numbers_and_running_sums(spark):
    rng = np.random.default_rng(8)
    v = rng.permutation(1000)
    df = spark.createDataFrame([(int(x), float(x) / 2) for x in v], "k long, w double").repartition(6)
    assert all(r["n"] == r["k"] for r in ranking.with_row_number(df, "k", "n").collect())
    assert all(abs(r["s"] - r["k"] * (r["k"] + 1) / 4) < 1e-6 for r in ranking.with_running_sum(df, "k", "w", "s").collect())


def test_occupancy_values(spark):
    events = lambda *x: spark.createDataFrame([(0, 0, 0, o) for o in x], "ix int, iy int, iz int, occupied boolean")
    grid, seen = None, []
    for hit in (True, True, False):
        grid = voxels.updated(grid, events(hit))
        seen.append(round(grid.first()["prob_log"], 6))
    assert seen == [0.85, 1.7, 1.3]
    assert voxels.updated(grid, events(*[True] * 20)).first()["prob_log"] == 3.5
    assert voxels.updated(grid, events(*[False] * 20)).first()["prob_log"] == -2.0
    ray = voxels.insert(None, frame(spark, [(0.2, 0.2, 3.5)]), (0.2, 0.2, 0.5), 1.0)
    assert sorted((r["iz"], r["prob_log"]) for r in ray.collect()) == [(0, -0.4), (1, -0.4), (2, -0.4), (3, 0.85)]
    assert voxels.set_free_area(None, spark, (0, 0, 0), (0.1, 0.1, 0.1), 0.05).count() == 27


def test_shortest_paths_on_the_small_graph(spark):
    e = [(0, 1, 1.0), (0, 2, 2.0), (1, 3, 1.0), (2, 3, 1.0), (3, 4, 1.0)]
    edges = graphs.both_ways(spark.createDataFrame(e, "src long, dst long, weight double"))
    assert {r["id"]: r["dist"] for r in graphs.shortest_paths(edges, 0).collect()} == {0: 0, 1: 1, 2: 2, 3: 2, 4: 3}
    assert graphs.shortest_path(edges, 0, 4) == ([0, 1, 3, 4], 3.0) and graphs.shortest_path(edges, 0, 9) == ([], float("inf"))
    nodes = spark.range(5)
    assert [r["offset"] for r in graphs.csr_offsets(edges, nodes).orderBy("id").collect()] == [0, 2, 4, 6, 9]


def test_clusters(spark):
    p = [(x, 0, 0) for x in (0, 0.1, 0.2, 0.3)] + [(x, 0, 0) for x in (5, 5.1, 5.2)] + [(9, 0, 0)]
    got = [r["cluster"] for r in graphs.cluster_dbscan(frame(spark, p), 0.15, 1).orderBy("id").collect()]
    assert got == [0] * 4 + [1] * 3 + [-1]


def test_registration(spark, cloud):
    m = linalg.rigid(linalg.rotation_z(np.pi / 6), (1, 2, 3))
    a = frame(spark, cloud)
    pairs = a.select("id", *[F.col(c).alias(f"q_{c}") for c in "xyz"]).join(points.transform(a, m).select("id", *[F.col(c).alias(f"t_{c}") for c in "xyz"]), "id")
    assert np.allclose(registration.kabsch_of(pairs), m, atol=1e-9)
    small = linalg.rigid(linalg.rotation_from_axis_angle([0.01, -0.02, 0.015]), (0.05, -0.03, 0.02))
    target = points.estimate_normals(points.transform(a, small), 10)
    for how in (registration.PointToPoint(), registration.PointToPlane()):
        found = registration.icp(a, target, 1.0, estimation=how)
        assert np.allclose(found.transformation, small, atol=1e-3) and found.fitness > 0.99 and found.inlier_rmse < 1e-2
    both = registration.icp(points.estimate_normals(a, 10), target, 1.0, estimation=registration.Symmetric())
    assert np.allclose(both.transformation, small, atol=1e-2)
    info = registration.information_matrix(registration.correspondences(a, a, 0.1))
    assert np.allclose(info[3:, 3:], np.eye(3) * len(cloud))


def test_meshes(spark):
    for shape, area in ((meshes.box(1, 2, 3), 22.0), (meshes.tetrahedron(1.0), 8 / np.sqrt(3)), (meshes.octahedron(1.0), 4 * np.sqrt(3)), (meshes.cylinder(1, 2, 400, 2), 6 * np.pi), (meshes.sphere(1.0, 60), 4 * np.pi), (meshes.torus(1.0, 0.5, 150, 100), 2 * np.pi**2)):
        points_, triangles = shape
        c = points_[triangles]
        n = np.cross(c[:, 1] - c[:, 0], c[:, 2] - c[:, 0])
        assert abs(np.linalg.norm(n, axis=1).sum() / 2 / area - 1) < 0.01
        # closed, and every side is run through once in each direction
        sides = [(int(t[i]), int(t[(i + 1) % 3])) for t in triangles for i in range(3)]
        assert len(set(sides)) == len(sides) and {(b, a) for a, b in sides} == set(sides)
    mesh = meshes.frames(spark, *meshes.box(1, 2, 3))
    assert abs(meshes.surface_area(mesh).first()[0] - 22) < 1e-9
    got = meshes.sample_points_uniformly(mesh, 500)
    p = got.select("x", "y", "z").toPandas().to_numpy()
    assert len(p) == 500 and np.isclose(np.abs(np.minimum(np.abs(p), np.abs(p - [1, 2, 3]))).min(axis=1), 0, atol=1e-9).all()


def test_scan_filter_and_ring(spark):
    df = spark.createDataFrame([(0, i, float(i + 1)) for i in range(5)], "scan long, step long, range double")
    assert [r["range"] for r in scans.range_filter(df, 1.5, 3.5).orderBy("step").collect()] == [None, 2, 3, None, None]
    many = spark.createDataFrame([(s, 0, 1.0) for s in range(14)], "scan long, step long, range double")
    held = scans.latest(many, 10)
    assert held.count() == 10 and scans.pop_one(held)[0].first()["scan"] == 4
    with pytest.raises(ValueError):
        scans.merge(many, many, 20)


def test_predicates(spark):
    rng = np.random.default_rng(7)
    rows = [tuple(map(float, x)) for x in rng.uniform(-2, 2, (300, 12))]
    df = spark.createDataFrame(rows, ", ".join(f"v{i} double" for i in range(12)))
    p = [[F.col(f"v{3 * k + i}") for i in range(3)] for k in range(4)]
    low, high = [F.lit(v) for v in (-1.0, -0.5, -0.3)], [F.lit(v) for v in (0.5, 1.0, 0.3)]
    got = df.select(
        predicates.segment_segment_squared(*p).alias("ss"),
        predicates.capsule_aabb(F.lit(0.4), p[0], predicates.sub(p[1], p[0]), low, high).alias("cap"),
        voxels.segment_hits_box(p[0], p[1], low, high).alias("seg"),
        predicates.point_plane(*p).alias("plane"),
    ).collect()
    s = np.linspace(0, 1, 201)
    lo, hi = np.array([-1, -0.5, -0.3]), np.array([0.5, 1.0, 0.3])
    for row, r in zip(np.array(rows).reshape(-1, 4, 3), got):
        a, b = row[0] + s[:, None] * (row[1] - row[0]), row[2] + s[:, None] * (row[3] - row[2])
        assert abs(np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1).min()) - np.sqrt(r["ss"])) < 0.03
        gap = np.sqrt((np.maximum(0, np.maximum(lo - a, a - hi)) ** 2).sum(1).min())
        assert abs(gap - 0.4) < 0.02 or r["cap"] == (gap <= 0.4)
        assert abs(gap) < 0.02 and gap > 0 or r["seg"] == (gap == 0) or gap == 0
        n = np.cross(row[2] - row[1], row[3] - row[1])
        assert abs(r["plane"] - n @ (row[0] - row[1]) / np.linalg.norm(n)) < 1e-9


def test_images_keep_their_size(spark):
    df = spark.createDataFrame([(0, v, u, float(v * u)) for v, u in itertools.product(range(6), range(8))], "img int, v int, u int, c0 double")
    flat = df.withColumn("c0", F.lit(2.0))
    assert {round(r["c0"], 9) for r in images.gaussian(flat, 8, 6, images.GAUSSIAN7).collect()} == {2.0}
    assert [(w, h) for _, w, h in images.pyramid(df, 8, 6, 3)] == [(8, 6), (4, 3), (2, 1)]


def test_distance_transform_and_surfaces(spark):
    from voxelith.operators import volumes

    seeds = [(5, 5, 5), (0, 9, 2), (9, 0, 0)]
    df = spark.createDataFrame(seeds, "ix int, iy int, iz int")
    got = volumes.distance_transform(df, 10).collect()
    assert len(got) == 1000
    for r in got:
        p = np.array([r["ix"], r["iy"], r["iz"]])
        assert (r["nx"], r["ny"], r["nz"]) in seeds
        assert abs(r["distance"] - min(np.linalg.norm(p - s) for s in seeds)) < 1e-9 and abs(np.linalg.norm(p - [r["nx"], r["ny"], r["nz"]]) - r["distance"]) < 1e-9
    cells = [(i, j, k, float(np.clip((np.linalg.norm([(i + 0.5) * 0.1, (j + 0.5) * 0.1, (k + 0.5) * 0.1]) - 0.6) / 0.5, -1, 1)), 1.0) for i, j, k in itertools.product(range(-9, 9), repeat=3)]
    ball = spark.createDataFrame(cells, "ix int, iy int, iz int, tsdf double, weight double")
    t = volumes.surface_mesh(ball, 0.1).toPandas().to_numpy().reshape(-1, 3, 3)
    n = np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0])
    assert abs(np.linalg.norm(n, axis=1).sum() / 2 / (4 * np.pi * 0.36) - 1) < 0.03
    assert (np.einsum("ij,ij->i", n, t.mean(axis=1)) >= -1e-12).all()
    p = volumes.surface_points(ball, 0.1).select("x", "y", "z").toPandas().to_numpy()
    assert np.allclose(np.linalg.norm(p, axis=1), 0.6, atol=0.02)


def test_boxes(spark):
    from voxelith.operators.boxes import Box, OrientedBox, box_box, triangle_box, triangle_triangle

    b = Box((0, 0, 0), (1, 2, 3))
    assert b.volume == 6 and (b + Box((0, 0, 0), (0, 0, 0))) == b and (b + Box((2, 2, 2), (3, 3, 3))).high == (3, 3, 3)
    assert b.scale(2).volume == 48 and np.allclose(b.translate((0, 0, 0), relative=False).center, 0) and b.percentage((0.5, 1, 3)).tolist() == [0.5, 0.5, 1]
    with pytest.raises(TypeError):
        b.rotate(np.eye(3))
    o = OrientedBox.of(b).rotate(linalg.rotation_z(np.pi / 4))
    assert abs(o.volume - 6) < 1e-9 and np.allclose(o.bounds().extent[:2], 3 / np.sqrt(2))
    assert box_box(o, OrientedBox.of(b)) and not box_box(o, OrientedBox.of(b).translate((5, 0, 0)))
    assert triangle_box([(0.5, 1, 1), (5, 5, 5), (9, 0, 0)], b) and not triangle_box([(2, 0, 0), (0, 4, 0), (2, 4, 9)], Box((0, 0, 0), (0.5, 0.5, 0.5)))
    t = np.array([(0, 0, 0), (1, 0, 0), (0, 1, 0)], float)
    assert triangle_triangle(t, t + [0.2, 0.2, 0]) and triangle_triangle(t, [(0.2, 0.2, -1), (0.2, 0.2, 1), (5, 5, 0)]) and not triangle_triangle(t, t + [0, 0, 0.1]) and not triangle_triangle(t, t + [2, 0, 0])


def test_paths_go_around_obstacles(spark):
    from voxelith.operators import planning

    nodes, edges = planning.lattice(spark, (0, 0, 0), (4, 4, 4), 4)
    assert nodes.count() == 64
    free, d = planning.find_path(nodes, edges, (0, 0, 0), (3, 0, 0), 0.1)
    assert abs(d - 3) < 1e-9 and free[0] == (0, 0, 0) and free[-1] == (3, 0, 0)
    wall = spark.createDataFrame([(3, 0, 0)], "ix int, iy int, iz int")
    around, longer = planning.find_path(nodes, edges, (0, 0, 0), (3, 0, 0), 0.1, [(wall, 0.5, (-0.1, -0.1, -0.1))])
    assert longer > 3 and around[-1] == (3, 0, 0)
    assert planning.find_path(nodes, edges.limit(0), (0, 0, 0), (3, 0, 0), 0.1) == ([], float("inf"))
    box = planning.primitive_voxels(spark, "box", (1.0, 1.0, 1.0), np.eye(4), 0.25)
    assert box.count() == 64
    assert planning.swept_voxels(spark, "sphere", (0.5,), np.eye(4), linalg.rigid(None, (2, 0, 0)), 0.25, 12).count() > planning.primitive_voxels(spark, "sphere", (0.5,), np.eye(4), 0.25).count()


def test_histograms_of_features(spark, cloud):
    from voxelith.operators import features

    df = points.estimate_normals(frame(spark, cloud), 10)
    own = features.spfh(features._pairs(df, 12, None)).collect()
    assert len(own) == len(cloud) and all(abs(sum(r["feat"][i : i + 11]) - 100) < 1e-6 for r in own for i in (0, 11, 22))
    full = features.fpfh(df, 12).collect()
    assert all(abs(sum(r["feat"][i : i + 11]) - 200) < 1e-6 for r in full for i in (0, 11, 22))


def test_other_ways_of_registration(spark, cloud):
    from voxelith.operators import alignment

    small = linalg.rigid(linalg.rotation_from_axis_angle([0.01, -0.01, 0.02]), (0.05, -0.03, 0.02))
    rgb = lambda df: df.withColumns({c: (F.sin("x") + F.cos("y")) / 4 + 0.5 for c in "rgb"})
    a = rgb(frame(spark, cloud))
    target = points.estimate_normals(points.transform(a, small), 10)
    assert np.allclose(alignment.generalized_icp(points.estimate_normals(a, 10), target, 1.0).transformation, small, atol=1e-3)
    assert np.allclose(alignment.colored_icp(a, target, 1.0).transformation, small, atol=5e-3)
    far = linalg.rigid(linalg.rotation_z(2.0), (3, 1, -2))
    feats = frame(spark, cloud).select("id", F.array(F.col("x") * 3, F.col("y") * 2, "z").alias("feat"))
    found = alignment.fast_global(frame(spark, cloud), points.transform(frame(spark, cloud), far), feats, feats, 3, refine=0.5)
    assert np.allclose(found.transformation, far, atol=1e-3) and found.fitness > 0.99


def test_odometry(spark):
    from voxelith.operators import alignment

    k = np.array([[40.0, 0, 19.5], [0, 40.0, 14.5], [0, 0, 1]])
    move = linalg.rigid(None, (0.1, -0.05, 0.0))  # two pixels and one, as pixels are paired whole

    def view(shift):
        rows = []
        for v in range(30):
            for u in range(40):
                # a wavy wall, looked at from a camera that was moved
                z = 2.0
                for _ in range(20):
                    x, y = (u - 19.5) * z / 40 - shift[0], (v - 14.5) * z / 40 - shift[1]
                    z = 2.0 + 0.02 * np.sin(3 * x) * np.cos(2 * y) + shift[2]
                rows.append((v, u, float(0.5 + 0.3 * np.sin(5 * x) + 0.2 * np.cos(4 * y)), float(z)))
        return spark.createDataFrame(rows, "v int, u int, intensity double, depth double")

    ok, m, info = alignment.rgbd_odometry(view((0, 0, 0)), view((0.1, -0.05, 0.0)), k, 40, 30, iterations=(6, 6))
    assert ok and np.allclose(m, move, atol=1e-2) and info[3, 3] > 100


def test_meetings_of_triangles(spark):
    v = frame(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0.2, 0.2, -1), (0.2, 0.2, 1), (3, 3, 0), (9, 9, 9), (9, 8, 9), (8, 9, 9)])
    t = spark.createDataFrame([(0, 0, 1, 2), (1, 3, 4, 5), (2, 6, 7, 8)], "tid long, v0 long, v1 long, v2 long")
    assert [tuple(r) for r in meshes.self_intersecting_triangles((v, t), 0.7).collect()] == [(0, 1)]
    cells = {tuple(r) for r in meshes.voxelized((v, t.where("tid = 0")), 0.5, (0, 0, 0)).collect()}
    assert (0, 0, 0) in cells and (2, 0, 0) in cells and all(z == 0 for _, _, z in cells) and (2, 2, 0) not in cells
