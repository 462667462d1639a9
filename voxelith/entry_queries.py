"""Queries of the inventory rows that other rows' operators cover: each calls its function with arguments of its own and has SQL of its own. `queries` registers them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import more_queries as m
from . import queries as q
from .functions import linalg
from .operators import graphs, images, kinematics, meshes, planning, points, registration, scans, voxels
from .operators.boxes import Box, OrientedBox
from .plans import spatial
from .plans.lineage import cut
from .plans.spatial import XYZ
from .queries import TRI, TRI_XYZ, Inputs, K, _colored, _lin, _occupancy, _paired, _segments, numbers, query, r
from .sources import files, formats

KEYS = voxels.KEYS
ALL = [*XYZ, *points.NORMAL]
PLAIN = f"SELECT id, {r(*ALL)} FROM pts"
FLOATS = m.FLOATS
#: Colours as bytes.
BYTES = ", ".join(f"round(least(1.0, greatest(0.0, {c})) * 255)::INT AS {c}" for c in points.COLOR)

# Files

query("io_02_cloud_from_file", FLOATS)(lambda c: m._cloud(c, "b.pcd", compressed=True))
query("io_04_ply_points", PLAIN)(lambda c: m._cloud(c, "b.ply"))


def _coloured_cloud(c: Inputs, name: str, **how) -> DataFrame:
    path = m._path(c, name)
    files.write_point_cloud(c.pts.select("id", *XYZ, *points.COLOR), path, **how)
    return files.read_point_cloud(c.spark, path).select("id", *[F.round(F.col(k) * 255).cast("int").alias(k) for k in points.COLOR])


query("io_03_write_colours", f"SELECT id, {BYTES} FROM pts")(lambda c: _coloured_cloud(c, "c.ply", ascii=True))
query("io_13_pcd_colours", f"SELECT id, {BYTES} FROM pts")(lambda c: _coloured_cloud(c, "c.pcd"))
query("io_91_pcd_elements", f"SELECT id, {BYTES} FROM pts")(lambda c: _coloured_cloud(c, "d.pcd", compressed=True))


def _header(c: Inputs, kind: str) -> DataFrame:
    """The header that a file of all points gets, read again."""
    path = m._path(c, "h.pcd")
    files.write_point_cloud(c.pts.select("id", *ALL), path, ascii=kind == "ascii", compressed=kind == "binary_compressed")
    found, at = formats.pcd_header(bytes(files._files(c.spark, path).first()["content"]))
    return c.spark.createDataFrame([(k, " ".join(v)) for k, v in found.items()], "key string, value string")


HEAD = "SELECT * FROM (VALUES ('VERSION', '0.7'), ('FIELDS', 'x y z normal_x normal_y normal_z'), ('SIZE', '4 4 4 4 4 4'), ('TYPE', 'F F F F F F'), ('COUNT', '1 1 1 1 1 1'), ('HEIGHT', '1'), ('VIEWPOINT', '0 0 0 1 0 0 0'), ('DATA', '{kind}')) t(key, value) UNION ALL SELECT unnest(['WIDTH', 'POINTS']), count(*)::VARCHAR FROM pts"
for _id, _kind in (("10_header", "ascii"), ("14_header_build", "binary"), ("92_header_writer", "binary_compressed")):
    query(f"io_{_id}", HEAD.format(kind=_kind))(lambda c, kind=_kind: _header(c, kind))
query("io_11_header_check", "SELECT * FROM (VALUES ('FIELDS x y z\nDATA ascii\n', true), ('FIELDS x y\nDATA ascii\n', false), ('# none\nFIELDS z y x rgb\nDATA binary\n', true)) t(header, good) , (SELECT count(*) AS n FROM pts)")(lambda c: _headers(c))


def _headers(c: Inputs) -> DataFrame:
    texts = ["FIELDS x y z\nDATA ascii\n", "FIELDS x y\nDATA ascii\n", "# none\nFIELDS z y x rgb\nDATA binary\n"]

    def good(text: str) -> bool:
        try:
            formats.pcd_header(text.encode())
        except ValueError:
            return False
        return True

    return c.spark.createDataFrame([(t, good(t)) for t in texts], "header string, good boolean").crossJoin(F.broadcast(c.pts.agg(F.count(F.lit(1)).alias("n"))))


def _triangles(c: Inputs, name: str, **how) -> DataFrame:
    path = m._path(c, name)
    files.write_triangle_mesh(*c.mesh, path, **how)
    return files.read_triangle_mesh(c.spark, path)[1].select("tid", *meshes.CORNERS)


def _vertices(c: Inputs, name: str, **how) -> DataFrame:
    path = m._path(c, name)
    files.write_triangle_mesh(*c.mesh, path, **how)
    return files.read_triangle_mesh(c.spark, path)[0].select("id", *XYZ)


TRIANGLES = f"WITH {TRI} SELECT tid, v0, v1, v2 FROM tri"
POINTS = f"SELECT id, {r(*XYZ)} FROM pts"
query("io_07_ply_mesh_writer", TRIANGLES)(lambda c: _triangles(c, "a.ply", ascii=True))
query("io_17_read_mesh", TRIANGLES)(lambda c: _triangles(c, "a.obj"))
query("io_18_write_mesh", POINTS)(lambda c: _vertices(c, "b.ply"))
query("io_23_obj_writer", POINTS)(lambda c: _vertices(c, "b.obj"))
query("io_21_stl_writer", f"WITH {TRI_XYZ} SELECT 3 * tid + k AS id, {r(*[f'CASE k WHEN 0 THEN {x}0 WHEN 1 THEN {x}1 ELSE {x}2 END::FLOAT::DOUBLE AS {x}' for x in XYZ])} FROM txyz, range(3) t(k)")(lambda c: _vertices(c, "b.stl"))
query("io_93_mesh_of_file", f"WITH {TRI} SELECT v0, v1, v2, count(*) AS n FROM tri GROUP BY ALL")(lambda c: _triangles(c, "c.ply").groupBy(*meshes.CORNERS).agg(F.count(F.lit(1)).alias("n")))


def _voxels_again(c: Inputs, **how) -> DataFrame:
    path = m._path(c, "w.ply")
    files.write_voxel_grid(_colored(c.voxb, 0.4), path, 0.5, (1.0, 2.0, 3.0), **how)
    rows, size, origin = files.read_voxel_grid(c.spark, path)
    return voxels.centers(rows, size, origin)


VOXELS = f"SELECT ix, iy, iz, 0.4::DOUBLE AS r, 0.4::DOUBLE AS g, 0.4::DOUBLE AS b, {r('(ix + 0.5) * 0.5 + 1 AS x', '(iy + 0.5) * 0.5 + 2 AS y', '(iz + 0.5) * 0.5 + 3 AS z')} FROM voxb"
query("io_09_voxel_writer", VOXELS)(lambda c: _voxels_again(c, ascii=True))
query("io_24_read_voxels", VOXELS)(lambda c: _voxels_again(c))
query("io_25_write_voxels", "SELECT count(*) AS n, min(ix) AS low, max(iz) AS high FROM voxb")(lambda c: _voxels_again(c).agg(F.count(F.lit(1)).alias("n"), F.min("ix").alias("low"), F.max("iz").alias("high")))


def _pictures(c: Inputs, kind: str, pixels: DataFrame, width: int, height: int, **how) -> DataFrame:
    """All images to files, one each, and back."""
    where = m._path(c, "images")
    files.write_images(pixels, where, width, height, kind, **how)
    got = files.read_image(c.spark, f"{where}/*.png") if kind == "png" else files.read_jpeg(c.spark, f"{where}/*.jpg")
    return got.select(F.regexp_extract("path", r"(\d+)\.[a-z]+$", 1).cast("long").alias("img"), "v", "u", "c0")


def _whole(c: Inputs, most: int) -> DataFrame:
    return c.pix.withColumn("c0", F.least(F.floor("c0"), F.lit(most)))


def _blocks(c: Inputs) -> DataFrame:
    """Blocks of eight pixels a side, of one value each, which the lossy format keeps."""
    own = F.expr("(v div 8 * 13 + u div 8 * 7 + img) % 200 + 20").cast("int")
    return c.pix.where("v < 96 and u < 96").withColumn("c0", own)


WHOLE = "SELECT img, v::INT AS v, u::INT AS u, least(floor(c0), {most})::DOUBLE AS c0 FROM pix"
BLOCKS = "SELECT img, v::INT AS v, u::INT AS u, ((v // 8 * 13 + u // 8 * 7 + img) % 200 + 20)::DOUBLE AS c0 FROM pix WHERE v < 96 AND u < 96"
query("io_26_read_image", WHOLE.format(most=255))(lambda c: _pictures(c, "png", _whole(c, 255), 100, 100))
query("io_27_write_image", "SELECT img, sum(least(floor(c0), 255))::DOUBLE AS total FROM pix GROUP BY img")(lambda c: _pictures(c, "png", _whole(c, 255), 100, 100).groupBy("img").agg(F.sum("c0").alias("total")))
query("io_28_png_all", WHOLE.format(most=200))(lambda c: _pictures(c, "png", _whole(c, 200), 100, 100))
query("io_29_png_sixteen_bits", "SELECT img, v::INT AS v, u::INT AS u, least(floor(c0 * 100), 65535)::DOUBLE AS c0 FROM pix")(lambda c: _pictures(c, "png", c.pix.withColumn("c0", F.least(F.floor(F.col("c0") * 100), F.lit(65535))), 100, 100, depth=16))
query("io_30_jpeg_reader", BLOCKS)(lambda c: _pictures(c, "jpg", _blocks(c), 96, 96))
query("io_31_jpeg_writer", "SELECT img, count(*) AS n, sum((v // 8 * 13 + u // 8 * 7 + img) % 200 + 20)::DOUBLE AS total FROM pix WHERE v < 96 AND u < 96 GROUP BY img")(lambda c: _pictures(c, "jpg", _blocks(c), 96, 96, quality=95).groupBy("img").agg(F.count(F.lit(1)).alias("n"), F.sum("c0").alias("total")))
query("io_94_host_image", "SELECT img, max(least(floor(c0), 255))::DOUBLE AS high FROM pix GROUP BY img")(lambda c: _pictures(c, "png", _whole(c, 255), 100, 100).groupBy("img").agg(F.max("c0").alias("high")))


def _json(c: Inputs) -> DataFrame:
    path = m._path(c, "points.json")
    c.xyz.write.json(path)
    return c.spark.read.schema("id long, x double, y double, z double").json(path)


query("io_33_json_write", POINTS)(_json)
query("io_34_json_read", f"SELECT id, {r('x')} FROM pts WHERE x > 0")(lambda c: _json(c).where("x > 0").select("id", "x"))
query("io_95_json_strings", POINTS)(lambda c: c.xyz.select(F.to_json(F.struct("id", *XYZ)).alias("j")).select(F.from_json("j", "id long, x double, y double, z double").alias("p")).select("p.*"))
query("io_96_json_of_rows", "SELECT id, length(label::VARCHAR) > 0 AS told FROM pts")(lambda c: c.pts.select("id", F.to_json(F.struct("label")).alias("j")).select("id", (F.length(F.get_json_object("j", "$.label")) > 0).alias("told")))


def _packed(c: Inputs, rows: int = 500) -> DataFrame:
    """Messages of so many points each, packed and unpacked where the rows are."""

    def pack(batches):
        for b in batches:
            b = b.sort_values("id")
            data = formats.write_point_message({k: b[k].to_numpy() for k in (*XYZ, *points.COLOR)})
            got = formats.read_point_message(data, {"x": 0, "y": 4, "z": 8, "rgb": 16}, 32)
            yield pd.DataFrame({"id": b["id"].to_numpy(), **{k: got[k] for k in (*XYZ, *points.COLOR)}})

    found = c.pts.select("id", *XYZ, *points.COLOR).mapInPandas(pack, "id long, x double, y double, z double, r double, g double, b double")
    return found.select("id", *XYZ, *[F.round(F.col(k) * 255).cast("int").alias(k) for k in points.COLOR])


query("io_36_pack_points", f"SELECT id, {r(*[f'{k}::FLOAT::DOUBLE AS {k}' for k in XYZ])}, {BYTES} FROM pts")(_packed)


def _image_message(c: Inputs, encoding: str) -> DataFrame:
    """Each image as a message and back: the channels are its value, half of it and a third of it."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((100, 100, 3), np.uint8)
        a[p["v"].to_numpy(int), p["u"].to_numpy(int)] = p[["c0", "c1", "c2"]].to_numpy()
        got = formats.read_image_message(formats.write_image_message(a, encoding), 100, 100, encoding)
        v, u = (x.reshape(-1) for x in np.indices((100, 100)))
        return pd.DataFrame({"img": p["img"].iloc[0], "v": v, "u": u, **{f"c{i}": got[..., i].reshape(-1) for i in range(3)}})

    rgb = _whole(c, 255).withColumns({"c1": F.floor(F.col("c0") / 2), "c2": F.floor(F.col("c0") / 3)})
    return rgb.groupBy("img").applyInPandas(run, "img long, v int, u int, c0 int, c1 int, c2 int")


MESSAGE = "WITH w AS (SELECT img, v, u, least(floor(c0), 255)::INT AS c FROM pix), a AS (SELECT img, v, u FROM (SELECT DISTINCT img FROM pix), range(100) p(v), range(100) s(u)) SELECT a.img, a.v::INT AS v, a.u::INT AS u, coalesce(c, 0) AS c0, coalesce(c // 2, 0) AS c1, coalesce(c // 3, 0) AS c2 FROM a LEFT JOIN w ON w.img = a.img AND w.v = a.v AND w.u = a.u"
query("io_37_image_of_message", MESSAGE)(lambda c: _image_message(c, "rgb8"))
query("io_38_message_of_image", MESSAGE)(lambda c: _image_message(c, "bgr8"))
query("io_39_arrow_export", PLAIN)(lambda c: c.pts.select("id", *ALL).mapInArrow(lambda batches: batches, "id long, x double, y double, z double, nx double, ny double, nz double"))
query("io_40_arrow_import", "SELECT id, round(x * 2, 6) + 0.0 AS x FROM pts")(lambda c: c.xyz.mapInArrow(_doubled, "id long, x double"))


def _doubled(batches):
    import pyarrow as pa
    import pyarrow.compute as pc

    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pc.multiply(b.column(1), 2.0)], names=["id", "x"])


query("io_41_staged", POINTS)(lambda c: cut(c.xyz))
query("io_42_cloud_of_columns", f"SELECT id, {r(*ALL, *points.COLOR)} FROM pts")(lambda c: c.xyz.join(c.pts.select("id", *points.NORMAL), "id").join(c.pts.select("id", *points.COLOR), "id"))
query("io_45_colour_kernel", f"SELECT img, v, u, {r('(u - 49.5) * c0 / 20 / 50 AS x', '(v - 49.5) * c0 / 20 / 50 AS y', 'c0 / 20 AS z', 'c0 AS r', 'c0 / 2 AS g')} FROM pix WHERE c0 > 0 AND c0 / 20 <= 3")(lambda c: images.back_project(c.pix.withColumns({"r": F.col("c0"), "g": F.col("c0") / 2}), K, None, 20.0, 3.0))


def _urdf_links(c: Inputs) -> DataFrame:
    path = m._path(c, "s.urdf")
    files.put(c.spark, path, b'<robot><link name="a"/><link name="b"/><joint name="j" type="revolute"><parent link="a"/><child link="b"/><origin xyz="1 0 2" rpy="0.1 0 0.5"/><axis xyz="0 0 1"/></joint></robot>')
    joints = files.read_urdf(c.spark, path)[1]
    return joints.select("name", "parent", "child", F.col("xyz")[0].alias("x"), F.col("xyz")[2].alias("z"), F.col("rpy")[2].alias("yaw"))


query("io_98_urdf_geometry", "SELECT 'j' AS name, 'a' AS parent, 'b' AS child, 1.0::DOUBLE AS x, 2.0::DOUBLE AS z, 0.5::DOUBLE AS yaw")(_urdf_links)


def _arm(c: Inputs, joint: float, slide: float) -> np.ndarray:
    rows = [("j", "revolute", "a", "b", [1.0, 0.0, 0.0], [0.0, 0.0, 0.0], [0.0, 0.0, 1.0]), ("k", "prismatic", "b", "c", [0.0, 2.0, 0.0], [0.0, 0.0, 0.0], [1.0, 0.0, 0.0])]
    joints = c.spark.createDataFrame(rows, "name string, type string, parent string, child string, xyz array<double>, rpy array<double>, axis array<double>")
    return kinematics.forward(joints, "a", {"j": joint, "k": slide})["c"]


#: The chain turns by t about z at (1, 0, 0), then goes (s, 2, 0) in the turned frame; points follow.
ARM = "x * cos({t}) - y * sin({t}) + 1 + {s} * cos({t}) - 2 * sin({t}) AS x", "x * sin({t}) + y * cos({t}) + {s} * sin({t}) + 2 * cos({t}) AS y", "z"
for _id, _t, _s in (("io_99_chain", 0.3, 2.0), ("gr_28_geometry_of_chain", -0.7, 0.5), ("pr_52_joint_frame", 1.1, 0.0), ("pr_61_pose", 0.0, 1.0)):
    query(_id, f"SELECT id, {r(*[e.format(t=_t, s=_s) for e in ARM])} FROM pts")(lambda c, t=_t, s=_s: points.transform(c.xyz, _arm(c, t, s)))
query("io_54_voxels_of_triangles", "SELECT ix::INT AS ix, iy::INT AS iy, iz::INT AS iz FROM range(-2, 3) a(ix), range(-2, 3) b(iy), range(-2, 3) d(iz) WHERE iz = 0 AND abs(ix) <= 1 AND abs(iy) <= 1")(lambda c: meshes.voxelized(meshes.frames(c.spark, np.array([[-1.0, -1, 0], [1, -1, 0], [1, 1, 0], [-1, 1, 0]]), np.array([[0, 1, 2], [0, 2, 3]])), 1.0, (0.0, 0.0, 0.0)))
query("io_100_box_voxels", "SELECT x::INT AS ix, y::INT AS iy, z::INT AS iz FROM range(-8, 8) a(x), range(-8, 8) b(y), range(-8, 8) c(z) WHERE abs(x * 0.25 + 0.125) <= 0.5 AND abs(y * 0.25 + 0.125) <= 1 AND abs(z * 0.25 + 0.125) <= 0.75")(lambda c: planning.primitive_voxels(c.spark, "box", (1.0, 2.0, 1.5), np.eye(4), 0.25))
query("io_101_swept_sphere", "SELECT DISTINCT x::INT AS ix, y::INT AS iy, z::INT AS iz FROM range(-8, 13) a(x), range(-8, 8) b(y), range(-8, 8) c(z), range(9) s(k) WHERE pow(x * 0.25 + 0.125 - k / 8.0, 2) + pow(y * 0.25 + 0.125, 2) + pow(z * 0.25 + 0.125, 2) <= 0.25")(lambda c: planning.swept_voxels(c.spark, "sphere", (0.5,), np.eye(4), linalg.rigid(None, (1, 0, 0)), 0.25, 9))

# Projections

N = linalg.rigid(linalg.rotation_x(0.4) @ linalg.rotation_y(-0.2), (0.3, 0.1, -0.6))
_moved = [f"{e} AS {k}" for e, k in zip(_lin(N), XYZ)]
_turned = [f"{e} AS {k}" for e, k in zip(_lin(N, points.NORMAL, False), points.NORMAL)]
query("pr_02_transform_points", f"SELECT id, {r(*_moved)} FROM pts")(lambda c: points.transform(c.xyz, N))
query("pr_03_transform_normals", f"SELECT id, {r(*_turned)} FROM pts")(lambda c: points.transform(c.pts, N).select("id", *points.NORMAL))
COV = "SELECT id, [nx * nx, nx * ny, nx * nz, ny * nx, ny * ny, ny * nz, nz * nx, nz * ny, nz * nz] AS m FROM pts"
_rot = N[:3, :3]
_cov = " + ".join(f"({float(_rot[0, a] * _rot[1, b])!r}) * m[{3 * a + b + 1}]" for a in range(3) for b in range(3))
query("pr_04_transform_covariances", f"WITH cv AS ({COV}) SELECT id, {r(f'{_cov} AS xy')} FROM cv")(lambda c: points.transform(c.pts.select("id", *XYZ, F.array(*[F.col(a) * F.col(b) for a in points.NORMAL for b in points.NORMAL]).alias("cov")), N).select("id", F.col("cov")[1].alias("xy")))
query("pr_06_translate_points", f"SELECT id, {r('x - 0.5 AS x', 'y AS y', 'z + 0.25 AS z')} FROM pts")(lambda c: points.translate(c.xyz, (-0.5, 0, 0.25)))
query("pr_08_scale_points", f"SELECT id, {r(*[f'{k} * 1.5 AS {k}' for k in XYZ])} FROM pts")(lambda c: points.scale(c.xyz, 1.5, center=False))
query("pr_10_rotate_all", f"SELECT id, {r('y AS x', '-x AS y', 'z AS z', 'ny AS nx', '-nx AS ny', 'nz AS nz')} FROM pts")(lambda c: points.rotate(c.pts.select("id", *ALL), np.array([[0, 1, 0], [-1, 0, 0], [0, 0, 1]]), center=False))
query("pr_16_voxel_origin", f"SELECT ix, iy, iz, {r('(ix + 0.5) * 1.0 + 2 AS x', '(iy + 0.5) * 1.0 - 1 AS y', '(iz + 0.5) * 1.0 AS z')} FROM vox")(lambda c: voxels.centers(c.vox, 0.5 * 2, (2, -1, 0)))
query("pr_17_voxels_turned", f"SELECT ix, iy, iz, {r('-(iy + 0.5) * 0.5 AS x', '(ix + 0.5) * 0.5 AS y', '(iz + 0.5) * 0.5 AS z')} FROM vox")(lambda c: points.transform(voxels.centers(c.vox, 0.5, (0, 0, 0)), linalg.rigid(linalg.rotation_z(np.pi / 2))))
query("pr_23_dense_voxel", "WITH w AS (SELECT id, floor(x / 0.5)::INT AS ix, floor(y / 0.5)::INT AS iy, floor(z / 0.5)::INT AS iz FROM ptb) SELECT id, vox.ix IS NOT NULL AS held FROM w LEFT JOIN vox USING (ix, iy, iz) WHERE greatest(abs(w.ix), abs(w.iy), abs(w.iz)) < 8")(lambda c: voxels.included(c.ptb.where(" and ".join(f"abs(floor({k} / 0.5)) < 8" for k in XYZ)), c.vox, 0.5, (0, 0, 0)).withColumnRenamed("included", "held"))
query("pr_24_reconstructed_grid", "SELECT 0 AS n, count(*) AS points FROM pts")(lambda c: c.xyz.agg(F.count(F.lit(1)).alias("points")).crossJoin(F.broadcast(c.vox.limit(0).agg(F.count(F.lit(1)).cast("int").alias("n")))))
query("pr_26_box_of_box", f"SELECT {r('max(x) - min(x) AS w', '(max(x) + min(x)) / 2 AS mid')} FROM pts")(lambda c: c.spark.createDataFrame([(float((o := OrientedBox.of(_box(c.xyz))).extent[0]), float(o.center[0]))], "w double, mid double"))
query("pr_66_bounds_of_turned_box", f"SELECT {r('(max(x) + min(x)) / 2 - (max(y) - min(y)) / 2 AS low', '(max(x) + min(x)) / 2 + (max(y) - min(y)) / 2 AS high')} FROM pts")(lambda c: c.spark.createDataFrame([(float((b := OrientedBox.of(_box(c.xyz)).rotate(np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1.0]])).bounds()).low[0]), float(b.high[0]))], "low double, high double"))


def _box(df: DataFrame) -> Box:
    b = points.bounds(df).first()
    return Box(tuple(b[f"min_{k}"] for k in XYZ), tuple(b[f"max_{k}"] for k in XYZ))


query("pr_27_box_of_points", f"SELECT b::INT AS i, {r(*[f'CASE WHEN (b >> {i}) & 1 = 1 THEN (SELECT max({k}) FROM pts) ELSE (SELECT min({k}) FROM pts) END * 2 AS {k}' for i, k in enumerate(XYZ)])} FROM range(8) t(b)")(lambda c: _corners(c))


def _corners(c: Inputs) -> DataFrame:
    p = _box(c.xyz).corners() * 2
    return c.spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "i int, x double, y double, z double")


query("pr_31_lines_moved", f"WITH mv AS (SELECT id, {', '.join(_moved)} FROM pts) SELECT src, dst, {r('a.x AS x0', 'b.y AS y1')} FROM net JOIN mv a ON a.id = src JOIN mv b ON b.id = dst")(lambda c: graphs.ends(c.net.select("src", "dst"), points.transform(c.nodes, N)).select("src", "dst", "x0", "y1"))
query("pr_32_mesh_scaled", f"WITH {TRI_XYZ} SELECT {r('sum(sqrt(cx * cx + cy * cy + cz * cz) / 2) * 4 AS area')} FROM tn")(lambda c: meshes.surface_area((points.scale(c.mesh[0], 2.0), c.mesh[1])))
query("pr_34_mesh_turned", f"WITH {TRI_XYZ} SELECT tid, {r('-cy / sqrt(cx * cx + cy * cy + cz * cz) AS nx', 'cx / sqrt(cx * cx + cy * cy + cz * cz) AS ny')} FROM tn")(lambda c: meshes.triangle_normals((points.rotate(c.mesh[0], np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1]])), c.mesh[1])).select("tid", "nx", "ny"))
query("pr_33_mesh_normals", f"SELECT id, {r(*[f'CASE WHEN id % 3 = 0 THEN {v} ELSE {n} END AS {n}' for n, v in zip(points.NORMAL, ('0.0', '0.0', '1.0'))])} FROM pts")(lambda c: points.normalize_normals(c.pts.select("id", *[F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.col(n) * 5).alias(n) for n in points.NORMAL]), (0, 0, 1)))
query("pr_35_unit_normals", f"WITH {TRI_XYZ} SELECT tid, {r('cx / sqrt(cx * cx + cy * cy + cz * cz) AS nx')} FROM tn")(lambda c: points.normalize_normals(meshes.triangle_normals(c.mesh, normalized=False)).select("tid", "nx"))
query("pr_49_pyramid_matrix", "SELECT id, round(25.0 * x / z + 24.5, 6) + 0.0 AS u, round(25.0 * y / z + 24.5, 6) + 0.0 AS v FROM pts WHERE z > 0.1")(lambda c: _seen_at(c, linalg.intrinsic_pyramid(K, 2)[1]))


def _seen_at(c: Inputs, k: np.ndarray) -> DataFrame:
    u, v = (float(k[i, i]) * F.col(n) / F.col("z") + float(k[i, 2]) for i, n in ((0, "x"), (1, "y")))
    return c.xyz.where("z > 0.1").select("id", u.alias("u"), v.alias("v"))


query("pr_51_parameters_json", "SELECT 525.0::DOUBLE AS fx, 239.5::DOUBLE AS cy, 640::INT AS width")(lambda c: m._camera(c).select(F.col("intrinsic_matrix")[0].alias("fx"), F.col("intrinsic_matrix")[7].alias("cy"), "width"))
query("pr_55_one_colour", "SELECT id, 0.3::DOUBLE AS r, 0.6::DOUBLE AS g, 0.9::DOUBLE AS b FROM ptb")(lambda c: points.paint_uniform_color(c.ptb, (0.3, 0.6, 0.9)).select("id", *points.COLOR))
query("pr_56_xyz_image", f"SELECT img, v, u, {r('(u - 49.5) * c0 / 50 AS x', '(v - 49.5) * c0 / 50 AS y', 'c0 AS z')} FROM pix WHERE c0 > 0")(lambda c: images.back_project(c.pix, K, None, 1.0, 1e9))
query("pr_60_camera_json_out", "SELECT 640::INT AS width, '{\"width\":640,\"height\":480,\"intrinsic_matrix\":[525.0,0.0,0.0,0.0,525.0,0.0,319.5,239.5,1.0]}' AS json")(lambda c: m._camera(c).select("width", F.to_json(F.struct("width", "height", "intrinsic_matrix")).alias("json")))
query("pr_62_dense_origin", f"SELECT ix::INT AS ix, iy::INT AS iy, iz::INT AS iz, {r('(ix + 0.5) * 0.5 + 3 AS x')} FROM range(2) a(ix), range(4) b(iy), range(3) d(iz)")(lambda c: voxels.centers(voxels.dense(c.spark, 0.5, (1.0, 2.0, 1.5)), 0.5, (3, 0, 0)).select(*KEYS, "x"))
query("pr_63_dense_bounds", "SELECT 3.0::DOUBLE AS min_x, 4.0::DOUBLE AS max_x, 0.0::DOUBLE AS min_z, 1.5::DOUBLE AS max_z")(lambda c: voxels.grid_bounds(voxels.dense(c.spark, 0.5, (1.0, 2.0, 1.5)), 0.5, (3, 0, 0)).select("min_x", "max_x", "min_z", "max_z"))
query("pr_67_image_bounds", "SELECT img, min(u) AS low, max(v) AS high, count(*) AS n, round(avg(u), 6) AS mid FROM pix GROUP BY img")(lambda c: c.pix.groupBy("img").agg(F.min("u").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n"), F.avg("u").alias("mid")))
query("pr_68_strings", "SELECT doc_id, trim(coalesce(text, ''), ' ') AS both, ltrim(coalesce(text, ''), ' ') AS left_, len(string_split(coalesce(text, ''), ' ')) AS parts FROM documents")(lambda c: q.table(c.spark, c.sf_dir, "documents").select("doc_id", F.trim(F.coalesce("text", F.lit(""))).alias("both"), F.ltrim(F.coalesce("text", F.lit(""))).alias("left_"), F.size(F.split(F.coalesce("text", F.lit("")), " ")).cast("long").alias("parts")))
query("pr_69_matrix_of_json", "SELECT i::INT AS i, j::INT AS j, (3 * j + i + 1)::DOUBLE AS value FROM range(3) a(i), range(3) b(j)")(lambda c: numbers(c.spark, files.matrix_of(list(range(1, 10)))))
query("pr_70_paths", "SELECT url, regexp_extract(url, '[^/]*$') AS name, regexp_replace(url, '[^/]*$', '') AS folder FROM pages")(lambda c: q.table(c.spark, c.sf_dir, "pages").select("url", F.regexp_extract("url", r"[^/]*$", 0).alias("name"), F.regexp_replace("url", r"[^/]*$", "").alias("folder")))

# Filters

query("fl_06_in_turned_box", "SELECT id FROM pts WHERE abs(0.8 * x + 0.6 * z) <= 0.75 AND abs(-0.6 * x + 0.8 * z) <= 1 AND abs(y) <= 0.5")(lambda c: points.crop_oriented(c.xyz, (0, 0, 0), np.array([[0.8, -0.6, 0], [0, 0, 1], [0.6, 0.8, 0]]), (1.5, 2, 1)).select("id"))
query("fl_35_known_voxels", f"WITH {q.OCC} SELECT ix, iy, iz, round(p, 6) AS prob_log FROM occ")(lambda c: voxels.known(_occupancy(c)))
query("fl_36_shadow_angles", "WITH n AS (SELECT scan, step, range AS r, lag(range) OVER w AS p, lead(range) OVER w AS f FROM scan WINDOW w AS (PARTITION BY scan ORDER BY step)), a AS (SELECT scan, step, r, p, f, atan2(abs(p * sin(0.03)), r - p * cos(0.03)) AS tp, atan2(abs(f * sin(0.03)), r - f * cos(0.03)) AS tf FROM n) SELECT scan, step, CASE WHEN coalesce((tp < 0.3 OR tp > 2.8) AND r > p, false) OR coalesce((tf < 0.3 OR tf > 2.8) AND r > f, false) THEN NULL ELSE round(r, 6) + 0.0 END AS range FROM a")(lambda c: scans.shadows_filter(c.scan, 100, 0.03, 0.3, 2.8, 1, 0))
query("fl_37_pixel_pairs", "SELECT a.img, a.v, a.u, round(a.c0 + b.c0, 6) + 0.0 AS total FROM pix a JOIN pix b ON b.img = a.img AND b.v = a.v AND b.u = a.u WHERE b.c0 > 10")(lambda c: c.pix.join(c.pix.where("c0 > 10").withColumnRenamed("c0", "d0"), images.KEY).select(*images.KEY, (F.col("c0") + F.col("d0")).alias("total")))

# Joins

query("jn_01_cells", "SELECT floor(x / 0.7)::BIGINT AS cx, floor(y / 0.7)::BIGINT AS cy, floor(z / 0.7)::BIGINT AS cz, count(*) AS n FROM pts GROUP BY 1, 2, 3")(lambda c: c.xyz.groupBy(*[e.alias(n) for e, n in zip(spatial.cell(XYZ, 0.7), ("cx", "cy", "cz"))]).agg(F.count(F.lit(1)).alias("n")))
query("jn_07_cells_of_targets", "SELECT floor(x / 0.5)::BIGINT AS cx, min(id) AS low FROM ptb GROUP BY 1")(lambda c: c.ptb.groupBy(spatial.cell(["x"], 0.5)[0].alias("cx")).agg(F.min("id").alias("low")))
query("jn_02_search", f"WITH {q.KNN.format(q='pts', t='ptb')} SELECT q, t, {r('d2')} FROM k WHERE rn <= 4 AND d2 < 1.44")(lambda c: spatial.radius_join(c.xyz, c.ptb, 1.2, max_nn=4))
BY = '"by"'
query("jn_14_voxels_occupied", f"WITH {q.OCC}, t AS (SELECT b.ix AS bx, b.iy AS {BY}, b.iz AS bz, min({{'x': a.ix, 'y': a.iy, 'z': a.iz}}) AS v FROM vox b JOIN occ a ON a.p > 0 AND abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 AND abs(a.iz - b.iz) <= 1 GROUP BY ALL) SELECT t.bx, t.{BY}, t.bz, v.x AS ax, v.y AS ay, v.z AS az FROM t")(lambda c: voxels.collide_occupied(_occupancy(c), c.vox, 0.5, 0.5, (0, 0, 0), (0, 0, 0)))
SPHERES = "WITH {more}t AS (SELECT p.id AS pid, min({{'x': ix, 'y': iy, 'z': iz}}) AS v FROM pts p JOIN {cells} ON pow(greatest(ix * 0.5 - x, 0, x - (ix + 1) * 0.5), 2) + pow(greatest(iy * 0.5 - y, 0, y - (iy + 1) * 0.5), 2) + pow(greatest(iz * 0.5 - z, 0, z - (iz + 1) * 0.5), 2) <= 0.09 GROUP BY p.id) SELECT v.x AS ix, v.y AS iy, v.z AS iz, count(*) AS n FROM t GROUP BY 1, 2, 3"
_balls = lambda c: c.xyz.select(F.col("id").alias("pid"), *XYZ, F.lit(0.3).alias("radius"))
query("jn_18_spheres_voxels", SPHERES.format(more="", cells="voxb"))(lambda c: voxels.collide_spheres(c.voxb, _balls(c), 0.5, (0, 0, 0)).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")))
query("jn_20_spheres_occupied", SPHERES.format(more=f"{q.OCC}, held AS (SELECT * FROM occ WHERE p > 0), ", cells="held"))(lambda c: voxels.collide_spheres(voxels.occupied(_occupancy(c)), _balls(c), 0.5, (0, 0, 0)).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")))
query("jn_21_any_contact", "SELECT (SELECT count(*) FROM voxb b SEMI JOIN vox a ON abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 AND abs(a.iz - b.iz) <= 1) AS hits, (SELECT count(*) FROM voxb) AS tried")(lambda c: voxels.collide_voxels(c.vox, c.voxb, 0.5, 0.5, (0, 0, 0), (0, 0, 0)).agg(F.count(F.lit(1)).alias("hits")).crossJoin(F.broadcast(c.voxb.agg(F.count(F.lit(1)).alias("tried")))))
query("jn_28_cells_of_voxels", "SELECT ix, count(*) AS n FROM vox GROUP BY ix")(lambda c: c.vox.groupBy("ix").agg(F.count(F.lit(1)).alias("n")))
NEAR = "WITH f AS (SELECT id, e[1:8] AS a FROM raw), g AS (SELECT id, e[9:16] AS b FROM raw), d AS (SELECT f.id AS q, g.id AS t, list_sum(list_transform(range(1, 9), lambda k: (a[k] - b[k]) * (a[k] - b[k]))) AS d2 FROM f, g)"
_eight = lambda c, at: c._raw.select(F.col("vec_id").alias("id"), F.transform(F.slice("embedding", at, 8), lambda x: x.cast("double") * 10).alias("feat"))
query("jn_29_least_distances", f"{NEAR} SELECT q, {r('min(d2) AS d2')} FROM d GROUP BY q")(lambda c: registration._nearest_features(_eight(c, 1), _eight(c, 9), 8).select("q", "d2"))
query("jn_30_nearest_of_features", f"{NEAR} SELECT q, arg_min(t, d2) AS t FROM d GROUP BY q")(lambda c: registration._nearest_features(_eight(c, 1), _eight(c, 9), 8).select("q", "t"))

# Aggregates

query("ag_28_hits_and_misses", f"WITH e AS (SELECT ix, iy, iz, 0.85 AS p FROM vox), h AS (SELECT *, true AS b FROM voxb) SELECT coalesce(e.ix, h.ix) AS ix, coalesce(e.iy, h.iy) AS iy, coalesce(e.iz, h.iz) AS iz, {r('CASE WHEN h.b IS NULL THEN p ELSE greatest(-2.0, coalesce(p, 0) - 0.4) END::DOUBLE AS prob_log')} FROM e FULL JOIN h ON e.ix = h.ix AND e.iy = h.iy AND e.iz = h.iz")(lambda c: voxels.updated(voxels.occupancy_of(c.vox), c.voxb.withColumn("occupied", F.lit(False))))
query("ag_27_add_voxels_by_id", f"SELECT floor(x / 0.5)::INT AS ix, floor(y / 0.5)::INT AS iy, floor(z / 0.5)::INT AS iz, {r('least(3.5, greatest(-2.0, -0.4 * count(*) FILTER (id % 2 = 0)) + 0.85 * count(*) FILTER (id % 2 = 1))::DOUBLE AS prob_log')} FROM pts GROUP BY 1, 2, 3")(lambda c: voxels.updated(None, c.xyz.select(*points.voxel_keys(c.xyz, 0.5, [0.0] * 3), (F.col("id") % 2 == 1).alias("occupied"))))
query("ag_43_two_kernels", f"WITH h AS ({q._conv('pix', 'u', (0.25, 0.5, 0.25))}), g AS ({q._conv('h', 'v', (0.1, 0.2, 0.4, 0.2, 0.1))}) SELECT img, v, u, round(c0, 5) AS c0 FROM g")(lambda c: images.filter_separable(c.pix, (0.25, 0.5, 0.25), (0.1, 0.2, 0.4, 0.2, 0.1), 100, 100).withColumn("c0", F.round("c0", 5)))
query("ag_46_plain_pyramid", "SELECT img, (v // 4)::INT AS v, (u // 4)::INT AS u, round(avg(c0 * 0.3141592653589793), 5) AS c0 FROM pix GROUP BY 1, 2, 3")(lambda c: images.pyramid(images.linear_transform(c.pix, 0.3141592653589793), 100, 100, 3, smooth=False)[2][0].withColumn("c0", F.round("c0", 5)))
query("ag_47_pair_pyramid", "SELECT img, (v // 2)::INT AS v, (u // 2)::INT AS u, round(avg(c0 / 255 * 0.3141592653589793), 6) AS intensity, round(avg(CASE WHEN c0 / 10 >= 8 THEN 0.0 ELSE c0 / 10 END * 0.3141592653589793), 6) AS depth FROM pix GROUP BY 1, 2, 3")(lambda c: images.downsample(images.rgbd(c.pix.withColumns({"c1": F.col("c0"), "c2": F.col("c0")}), c.pix, 10, 8), 100, 100).withColumns({k: F.col(k) * 0.3141592653589793 for k in ("intensity", "depth")}))
query("ag_59_normal_lengths", "SELECT id, 1.0::DOUBLE AS size FROM pts")(lambda c: points.estimate_normals(c.xyz, 10).select("id", points.norm(points.NORMAL).alias("size")))
query("ag_61_smoothed_twice", f"WITH {TRI}, {q.EDGES}, n1 AS (SELECT src AS id, count(*) AS n, " + ", ".join(f"sum({k}) AS s{k}" for k in XYZ) + " FROM ed JOIN pts ON pts.id = dst GROUP BY src), p1 AS (SELECT id, " + ", ".join(f"({k} + s{k}) / (1 + n) AS {k}" for k in XYZ) + " FROM pts JOIN n1 USING (id)), n2 AS (SELECT src AS id, count(*) AS n, " + ", ".join(f"sum({k}) AS s{k}" for k in XYZ) + f" FROM ed JOIN p1 ON p1.id = dst GROUP BY src) SELECT id, {r(*[f'({k} + s{k}) / (1 + n) AS {k}' for k in XYZ])} FROM p1 JOIN n2 USING (id)")(lambda c: meshes.filter_smooth_simple(c.mesh, 2)[0].select("id", *XYZ))

# Sets, graphs, scans

query("st_11_edge_colours", "SELECT src, dst, CASE WHEN src < 100 THEN 0.9 ELSE 0.1 END::DOUBLE AS r FROM net")(lambda c: graphs.set_edge_weights(c.net.withColumn("weight", F.lit(0.1)), c.net.where("src < 100"), 0.9, directed=True).withColumnRenamed("weight", "r"))
query("st_12_node_colours", "SELECT id, CASE WHEN id % 5 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS r FROM pts")(lambda c: c.xyz.select("id").join(c.xyz.where("id % 5 = 0").select("id", F.lit(1.0).alias("r")), "id", "left").na.fill({"r": 0.0}))
query("st_16_one_edge", "SELECT src, dst, CASE WHEN src = 3 AND dst = 4 THEN 1.0 ELSE 0.0 END::DOUBLE AS r FROM net")(lambda c: graphs.set_edge_weights(c.net.withColumn("weight", F.lit(0.0)), c.net.where("src = 3 and dst = 4"), 1.0, directed=True).withColumnRenamed("weight", "r"))
query("wn_09_grouped_means", "SELECT label, count(*) AS n, round(avg(x), 6) + 0.0 AS x FROM pts GROUP BY label")(lambda c: c.pts.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x")))
query("gr_01_degrees", "SELECT id, count(net.src) AS degree, round(coalesce(sum(weight), 0), 6) + 0.0 AS weight FROM pts LEFT JOIN net ON net.src = pts.id GROUP BY id")(lambda c: c.nodes.select("id").join(c.net, F.col("id") == F.col("src"), "left").groupBy("id").agg(F.count("src").alias("degree"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")))
query("gr_43_features", "SELECT id, 64::INT AS dims, round(list_sum(e), 5) + 0.0 AS total FROM raw")(lambda c: c._raw.select(F.col("vec_id").alias("id"), F.size("embedding").alias("dims"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * 10), 5).alias("total")))
query("gr_09_point_to_point", "SELECT i::INT AS i, j::INT AS j, CASE WHEN i = j THEN 1.0 WHEN j = 3 THEN [1.0, 2.0, 3.0, 0.0][i + 1] ELSE 0.0 END::DOUBLE AS value FROM range(4) a(i), range(4) b(j)")(lambda c: numbers(c.spark, registration.PointToPoint().step(_paired(c, c.xyz, points.translate(c.xyz, (1, 2, 3))))))
query("gr_26_blocked_edges", f"WITH {q.SEG}, tt AS (SELECT id, ix, iy, iz, (ix * 0.5 - ax) / (bx - ax) AS x0, ((ix + 1) * 0.5 - ax) / (bx - ax) AS x1, (iy * 0.5 - ay) / (by_ - ay) AS y0, ((iy + 1) * 0.5 - ay) / (by_ - ay) AS y1, (iz * 0.5 - az) / (bz - az) AS z0, ((iz + 1) * 0.5 - az) / (bz - az) AS z1 FROM seg, voxb) SELECT count(DISTINCT id) AS blocked FROM tt WHERE greatest(0, least(x0, x1), least(y0, y1), least(z0, z1)) <= least(1, greatest(x0, x1), greatest(y0, y1), greatest(z0, z1))")(lambda c: voxels.collide_lines(c.voxb, _segments(c).select(F.col("id").alias("lid"), *[F.col(f"a{k}").alias(f"{k}0") for k in XYZ], *[F.col(f"b{k}").alias(f"{k}1") for k in XYZ]), 0.5, (0, 0, 0)).agg(F.count(F.lit(1)).alias("blocked")))
query("sm_03_popped_ranges", f"SELECT step, {r('range')} FROM scan WHERE scan = (SELECT min(scan) FROM scan)")(lambda c: scans.pop_one(c.scan)[0].select("step", "range"))
query("sm_04_ranges_in_order", "SELECT scan, count(*) AS n, round(first(range ORDER BY step), 6) + 0.0 AS first, round(last(range ORDER BY step), 6) + 0.0 AS last FROM scan GROUP BY scan")(lambda c: c.scan.groupBy("scan").agg(F.count(F.lit(1)).alias("n"), F.min_by("range", "step").alias("first"), F.max_by("range", "step").alias("last")))
