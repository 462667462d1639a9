import struct

import numpy as np
import pytest

from voxelith.sources import files, formats


@pytest.fixture
def cloud(spark):
    rng = np.random.default_rng(3)
    rows = [(i, *map(float, rng.normal(size=6).astype(np.float32)), *(float(v) / 255 for v in rng.integers(0, 256, 3))) for i in range(50)]
    return spark.createDataFrame(rows, "id long, x double, y double, z double, nx double, ny double, nz double, r double, g double, b double")


@pytest.mark.parametrize("name, options", [("a.ply", {}), ("b.ply", {"ascii": True}), ("c.pcd", {}), ("d.pcd", {"ascii": True}), ("e.pcd", {"compressed": True})])
def test_clouds_come_back(spark, cloud, tmp_path, name, options):
    path = f"{tmp_path}/{name}"
    files.write_point_cloud(cloud, path, **options)
    got = files.read_point_cloud(spark, path).drop("path").orderBy("id").toPandas().to_numpy(float)
    assert np.allclose(got, cloud.toPandas().to_numpy(float), atol=1e-6)


def test_points_that_are_not_finite_go(spark, tmp_path):
    data = formats.write_ply({"vertex": {"x": np.array([0, np.nan, np.inf, 3.0]), "y": np.zeros(4), "z": np.zeros(4)}})
    files.put(spark, f"{tmp_path}/n.ply", data)
    assert [r["id"] for r in files.read_point_cloud(spark, f"{tmp_path}/n.ply").collect()] == [0, 3]
    assert files.read_point_cloud(spark, f"{tmp_path}/n.ply", remove_infinite=False).count() == 3


def test_big_endian_and_lists():
    head = b"ply\nformat binary_big_endian 1.0\nelement vertex 1\nproperty float x\nproperty uchar k\nelement face 2\nproperty list uchar int vertex_indices\nend_header\n"
    body = struct.pack(">fB", 1.5, 7) + struct.pack(">Biii", 3, 0, 1, 2) + struct.pack(">Biiii", 4, 0, 1, 2, 3)
    got = formats.read_ply(head + body)
    assert got["vertex"]["x"].tolist() == [1.5] and [x.tolist() for x in got["face"]["vertex_indices"]] == [[0, 1, 2], [0, 1, 2, 3]]


@pytest.mark.parametrize("name", ["m.ply", "m.obj", "m.stl"])
def test_meshes_come_back(spark, tmp_path, name):
    from voxelith.operators import meshes

    v, t = meshes.frames(spark, *meshes.box())
    files.write_triangle_mesh(v, t, f"{tmp_path}/{name}")
    a, b = files.read_triangle_mesh(spark, f"{tmp_path}/{name}")
    p, i = a.orderBy("id").select("x", "y", "z").toPandas().to_numpy(), b.orderBy("tid").select("v0", "v1", "v2").toPandas().to_numpy()
    points, triangles = meshes.box()
    assert np.allclose(p[i], points[triangles])


def test_polygons_become_triangles():
    # an arrow head that is not convex
    p = np.array([[0, 0, 0], [2, 0, 0], [0.5, 0.5, 0], [0, 2, 0]], float)
    t = formats.ear_clip(p)
    area = sum(np.linalg.norm(np.cross(p[b] - p[a], p[c] - p[a])) / 2 for a, b, c in t)
    assert len(t) == 2 and abs(area - 1.0) < 1e-12
    _, faces = formats.read_obj("v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1/1 2/2 3/3 -1\n")
    assert len(faces) == 2


def test_lzf():
    rng = np.random.default_rng(1)
    for data in (b"", b"a", b"abc" * 5000, rng.integers(0, 256, 3000, np.uint8).tobytes(), rng.integers(0, 3, 9000, np.uint8).tobytes()):
        assert formats.lzf_decompress(formats.lzf_compress(data), len(data)) == data


def test_png(spark, tmp_path):
    rng = np.random.default_rng(2)
    for image in (rng.integers(0, 256, (5, 7, 1), np.uint8), rng.integers(0, 256, (4, 3, 3), np.uint8), rng.integers(0, 65536, (3, 4, 1)).astype(np.uint16)):
        assert (formats.read_png(formats.write_png(image)) == image).all()
    rows = [(v, u, float(v * 10 + u)) for v in range(4) for u in range(6)]
    df = spark.createDataFrame(rows, "v int, u int, c0 double")
    files.write_image(df, f"{tmp_path}/i.png", 6, 4)
    assert sorted((r["v"], r["u"], r["c0"]) for r in files.read_image(spark, f"{tmp_path}/i.png").collect()) == rows


def test_voxel_grids(spark, tmp_path):
    df = spark.createDataFrame([(1, -2, 3, 1.0, 0.0, 0.2), (0, 0, 0, 0.4, 0.6, 0.8)], "ix int, iy int, iz int, r double, g double, b double")
    files.write_voxel_grid(df, f"{tmp_path}/v.ply", 0.25, (1, 2, 3))
    got, size, origin = files.read_voxel_grid(spark, f"{tmp_path}/v.ply")
    assert (size, origin) == (0.25, (1.0, 2.0, 3.0))
    assert sorted(tuple(round(x, 6) for x in r) for r in got.collect()) == sorted(tuple(r) for r in df.collect())


def test_messages():
    cols = {"x": np.array([1.0, np.nan]), "y": np.array([2.0, 0]), "z": np.array([3.0, 0]), "r": np.array([1.0, 0]), "g": np.array([0.2, 0]), "b": np.array([0, 0.4])}
    data = formats.write_point_message(cols)
    fields = {"x": 0, "y": 4, "z": 8, "rgb": 16}
    got = formats.read_point_message(data, fields, 32)
    assert [got[c].tolist() for c in "xyz"] == [[1.0], [2.0], [3.0]] and np.allclose([got["r"][0], got["g"][0], got["b"][0]], [1, 0.2, 0])
    assert np.isinf(formats.read_point_message(data, fields, 32, dense=False)["x"][1])


def test_descriptions(spark, tmp_path):
    files.put(spark, f"{tmp_path}/t.log", b"0 0 1\n1 0 0 0\n0 1 0 0\n0 0 1 0\n0 0 0 1\n1 1 2\n1 0 0 5e-1\n0 1 0 0\n0 0 1 0\n0 0 0 1\n")
    got = files.read_trajectory(spark, f"{tmp_path}/t.log").orderBy("i").collect()
    assert [(r["i"], r["j"], r["k"]) for r in got] == [(0, 0, 1), (1, 1, 2)] and got[1]["pose"][3] == 0.5
    files.put(spark, f"{tmp_path}/c.json", b'{"width": 640, "height": 480,\n "intrinsic_matrix": [525, 0, 0, 0, 525, 0, 319.5, 239.5, 1]}')
    cam = files.read_camera(spark, f"{tmp_path}/c.json").first()
    assert files.matrix_of(cam["intrinsic_matrix"])[0].tolist() == [525, 0, 319.5]
    urdf = b'<robot><link name="a"/><link name="b"/><link name="c"/><joint name="j" type="revolute"><parent link="a"/><child link="b"/><origin xyz="1 0 0" rpy="0 0 0"/><axis xyz="0 0 1"/></joint><joint name="k" type="prismatic"><parent link="b"/><child link="c"/><axis xyz="1 0 0"/></joint></robot>'
    files.put(spark, f"{tmp_path}/r.urdf", urdf)
    from voxelith.operators import kinematics

    links, joints = files.read_urdf(spark, f"{tmp_path}/r.urdf")
    poses = kinematics.forward(joints, "a", {"j": np.pi / 2, "k": 2.0})
    assert links.count() == 3 and np.allclose(poses["c"][:3, 3], [1, 2, 0])
