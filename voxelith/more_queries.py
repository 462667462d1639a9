"""Queries over files, boxes, predicates, images, occupancy and solvers; `queries` registers them with the rest."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import queries as q
from .functions import linalg, predicates
from .operators import alignment, features, graphs, images, kinematics, meshes, planning, points, registration, scans, volumes, voxels
from .operators.boxes import Box, OrientedBox, box_box, triangle_box, triangle_triangle
from .plans import spatial
from .plans.lineage import folder
from .plans.spatial import XYZ
from .queries import CAM, K, TRI, TRI_XYZ, TSDF, Inputs, _abc, _colored, _occupancy, _paired, _segments, _volume, numbers, query, r
from .sources import files, formats


def _path(c: Inputs, name: str) -> str:
    return f"{folder(c.spark)}/files-{uuid.uuid4().hex}/{name}"


# Files: written and read again

FLOATS = f"SELECT id, {r(*[f'{k}::FLOAT::DOUBLE AS {k}' for k in (*XYZ, *points.NORMAL)])} FROM pts"


def _cloud(c: Inputs, name: str, **options) -> DataFrame:
    path = _path(c, name)
    files.write_point_cloud(c.pts.select("id", *XYZ, *points.NORMAL), path, **options)
    return files.read_point_cloud(c.spark, path).select("id", *XYZ, *points.NORMAL)


query("io_01_read_point_cloud", f"SELECT id, {r(*XYZ, *points.NORMAL)} FROM pts")(lambda c: _cloud(c, "a.ply"))
query("io_05_ply_ascii", f"SELECT id, {r(*XYZ, *points.NORMAL)} FROM pts")(lambda c: _cloud(c, "a.ply", ascii=True))
query("io_12_pcd_binary", FLOATS)(lambda c: _cloud(c, "a.pcd"))
query("io_15_pcd_ascii", FLOATS)(lambda c: _cloud(c, "a.pcd", ascii=True))
query("io_16_pcd_compressed", FLOATS)(lambda c: _cloud(c, "a.pcd", compressed=True))


def _mesh_file(c: Inputs, name: str) -> DataFrame:
    path = _path(c, name)
    files.write_triangle_mesh(*c.mesh, path)
    return meshes.surface_area(files.read_triangle_mesh(c.spark, path))


query("io_06_ply_mesh", f"WITH {TRI_XYZ} SELECT {r('sum(sqrt(cx * cx + cy * cy + cz * cz) / 2) AS area')} FROM tn")(lambda c: _mesh_file(c, "m.ply"))
query("io_22_obj_mesh", f"WITH {TRI_XYZ} SELECT {r('sum(sqrt(cx * cx + cy * cy + cz * cz) / 2) AS area')} FROM tn")(lambda c: _mesh_file(c, "m.obj"))
query("io_20_stl_mesh", f"WITH {TRI_XYZ} SELECT round(sum(sqrt(cx * cx + cy * cy + cz * cz) / 2), 2) AS area FROM tn")(lambda c: _mesh_file(c, "m.stl").select(F.round("area", 2).alias("area")))


def _voxel_file(c: Inputs) -> DataFrame:
    path = _path(c, "v.ply")
    files.write_voxel_grid(_colored(c.vox, 0.2), path, 0.5)
    return files.read_voxel_grid(c.spark, path)[0]


query("io_08_ply_voxels", "SELECT ix, iy, iz, 0.2::DOUBLE AS r, 0.2::DOUBLE AS g, 0.2::DOUBLE AS b FROM vox")(_voxel_file)


def _png(c: Inputs) -> DataFrame:
    """Every image to a file of its own and back."""
    where = _path(c, "images")
    files.write_images(c.pix.withColumn("c0", F.least(F.floor("c0"), F.lit(255))), where, 100, 100)
    return files.read_image(c.spark, f"{where}/*.png").select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("img"), "v", "u", "c0")


query("io_28_png", "SELECT img, v::INT AS v, u::INT AS u, least(floor(c0), 255)::DOUBLE AS c0 FROM pix")(_png)


def _message(c: Inputs) -> DataFrame:
    rows = c.xyz.orderBy("id").toPandas()
    data = formats.write_point_message({k: rows[k].to_numpy() for k in XYZ})
    got = formats.read_point_message(data, {"x": 0, "y": 4, "z": 8}, 32)
    return c.spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(zip(*(got[k] for k in XYZ)))], "id long, x double, y double, z double")


query("io_35_point_message", f"SELECT id, {r(*[f'{k}::FLOAT::DOUBLE AS {k}' for k in XYZ])} FROM pts")(_message)


def _urdf(c: Inputs) -> dict:
    path = _path(c, "r.urdf")
    files.put(c.spark, path, b'<robot><link name="a"/><link name="b"/><link name="c"/><joint name="j" type="revolute"><parent link="a"/><child link="b"/><origin xyz="1 0 0" rpy="0 0 0.5"/><axis xyz="0 0 1"/></joint><joint name="k" type="prismatic"><parent link="b"/><child link="c"/><origin xyz="0 2 0"/><axis xyz="1 0 0"/></joint></robot>')
    return kinematics.forward(files.read_urdf(c.spark, path)[1], "a", {"j": 0.3, "k": 2.0})


query("io_86_urdf")(lambda c: numbers(c.spark, _urdf(c)["b"]))
query("gr_27_forward_kinematics")(lambda c: numbers(c.spark, _urdf(c)["c"]))


def _camera(c: Inputs) -> DataFrame:
    path = _path(c, "c.json")
    files.put(c.spark, path, b'{"width": 640, "height": 480, "intrinsic_matrix": [525, 0, 0, 0, 525, 0, 319.5, 239.5, 1]}')
    return files.read_camera(c.spark, path)


query("io_32_camera_json", "SELECT 640::INT AS width, 480::INT AS height, [525.0, 0, 0, 0, 525, 0, 319.5, 239.5, 1]::DOUBLE[] AS intrinsic_matrix")(_camera)
query("pr_50_camera_json", "SELECT 640::INT AS width, 319.5::DOUBLE AS cx")(lambda c: _camera(c).select("width", F.col("intrinsic_matrix")[6].alias("cx")))

# Factories

query("io_44_from_rgbd", f"SELECT img, v, u, {r('(u - 49.5) * c0 / 10 / 50 AS x', '(v - 49.5) * c0 / 10 / 50 AS y', 'c0 / 10 AS z', 'c0 / 500 AS r')} FROM pix WHERE c0 > 0 AND c0 / 10 <= 4")(lambda c: images.back_project(c.pix.withColumn("r", F.col("c0") / 500), K, None, 10.0, 4.0))
query("io_97_depth_stride", f"SELECT img, v, u, {r('(u - 49.5) * c0 / 10 / 50 AS x', '(v - 49.5) * c0 / 10 / 50 AS y', 'c0 / 10 AS z')} FROM pix WHERE c0 > 0 AND c0 / 10 <= 4 AND u % 4 = 0 AND v % 4 = 0")(lambda c: images.back_project(c.pix, K, None, 10.0, 4.0, stride=4))
query("io_50_scan_from_depth", f"WITH p AS (SELECT img, (u - 49.5) * c0 / 10 / 50 AS x, c0 / 10 AS y, -(v - 49.5) * c0 / 10 / 50 AS z FROM pix WHERE c0 > 0 AND c0 / 10 <= 4), s AS (SELECT img, floor((z + 1) / 0.5)::INT AS scan, floor((atan2(y, x) + pi()) / 0.05)::INT AS step, sqrt(x * x + y * y) AS d FROM p WHERE z >= -1 AND z < 1) SELECT img, scan, step, {r('min(d) AS range')} FROM s WHERE step BETWEEN 0 AND 125 GROUP BY 1, 2, 3")(lambda c: scans.from_points(images.back_project(c.pix, K, None, 10.0, 4.0).select("img", F.col("x"), F.col("z").alias("y"), (-F.col("y")).alias("z")), 0.05, -1.0, 1.0, 4, keys=["img"]))
query("io_52_voxels_of_points", f"WITH m AS (SELECT min(x) - 0.25 AS a, min(y) - 0.25 AS b_, min(z) - 0.25 AS c FROM pts) SELECT floor((x - a) / 0.5)::INT AS ix, floor((y - b_) / 0.5)::INT AS iy, floor((z - c) / 0.5)::INT AS iz, {r('avg(r) AS r', 'avg(g) AS g', 'avg(b) AS b')} FROM pts, m GROUP BY 1, 2, 3")(lambda c: voxels.from_points(c.pts, 0.5))
query("io_58_distances_of_occupancy", f"WITH {q.OCC}, held AS (SELECT ix, iy, iz FROM occ WHERE p > 0), {q.FIELD.format(cells='held')} SELECT ix, iy, iz, {r('sqrt(d2) AS distance')} FROM field")(lambda c: q._field(voxels.occupied(_occupancy(c)).select(*voxels.KEYS)).select(*voxels.KEYS, "distance"))
query("io_65_graph_of_mesh", f"WITH {TRI}, {q.EDGES} SELECT src, dst FROM ed")(lambda c: graphs.both_ways(meshes.line_set(c.mesh)[1]))
DEPTH = "SELECT img, v, u, round(c0 / 255 * 0.299 + c0 / 255 * 0.587 + c0 / 255 * 0.114, 6) + 0.0 AS intensity, round(CASE WHEN c0 / {s} >= {t} THEN 0.0 ELSE c0 / {s} END, 6) + 0.0 AS depth FROM pix"
for _name, _scale, _trunc in (("81_rgbd_image", 1000, 3), ("82_redwood", 1000, 4), ("83_tum", 5000, 4)):
    query(f"io_{_name}", DEPTH.format(s=_scale, t=_trunc))(lambda c, s=_scale, t=_trunc: images.rgbd(c.pix.withColumns({"c1": F.col("c0"), "c2": F.col("c0")}), c.pix, s, t).select(*images.KEY, "intensity", "depth"))
query("io_88_swept_voxels")(lambda c: planning.swept_voxels(c.spark, "sphere", (0.5,), np.eye(4), linalg.rigid(None, (1, 0, 0)), 0.25, 8))


def _ears(c: Inputs) -> DataFrame:
    """Areas of the triangles that polygons are cut into: five points in a row each, in the plane, by their angle around their mean."""
    import pandas as pd

    def cut(p: pd.DataFrame) -> pd.DataFrame:
        at = p[["x", "y"]].to_numpy()
        at = at[np.argsort(np.arctan2(*(at - at.mean(axis=0)).T[::-1]))]
        corners = np.concatenate([at, np.zeros((len(at), 1))], axis=1)
        area = sum(np.linalg.norm(np.cross(corners[b] - corners[a], corners[d] - corners[a])) / 2 for a, b, d in formats.ear_clip(corners))
        return pd.DataFrame({"polygon": [p["polygon"].iloc[0]], "area": [float(area)]})

    return c.xyz.select(F.expr("id div 5").alias("polygon"), "x", "y").groupBy("polygon").applyInPandas(cut, "polygon long, area double")


query("io_19_ear_clipping", f"WITH g AS (SELECT id // 5 AS polygon, x, y, avg(x) OVER (PARTITION BY id // 5) AS mx, avg(y) OVER (PARTITION BY id // 5) AS my FROM pts), o AS (SELECT polygon, x, y, row_number() OVER w AS k, count(*) OVER (PARTITION BY polygon) AS n FROM g WINDOW w AS (PARTITION BY polygon ORDER BY atan2(y - my, x - mx))) SELECT a.polygon, {r('abs(sum(a.x * b.y - b.x * a.y)) / 2 AS area')} FROM o a JOIN o b ON b.polygon = a.polygon AND b.k = a.k % a.n + 1 GROUP BY a.polygon")(_ears)

# Projections

query("pr_15_rotation_z", "SELECT i::INT AS i, j::INT AS j, round(CASE WHEN i = 2 OR j = 2 THEN (i = j)::INT WHEN i = j THEN cos(0.3) WHEN i = 0 THEN -sin(0.3) ELSE sin(0.3) END, 6) + 0.0 AS value FROM range(3) a(i), range(3) b(j)")(lambda c: numbers(c.spark, linalg.rotation_z(0.3)))
query("pr_27_box_corners", "SELECT b::INT AS i, j::INT AS j, (((b >> j) & 1) * (j + 1))::DOUBLE AS value FROM range(8) t(b), range(3) s(j)")(lambda c: numbers(c.spark, Box((0, 0, 0), (1, 2, 3)).corners()))
query("pr_28_box_union", f"SELECT {r(*[f'least(min(p.{k}), min(t.{k})) AS low_{k}' for k in XYZ])} FROM ptb p JOIN pts t USING (id)")(lambda c: _union(c))
query("pr_30_paint_edges", "SELECT src, dst, CASE WHEN src % 10 = 0 AND dst = src + 1 OR dst % 10 = 0 AND src = dst + 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS r FROM net")(lambda c: graphs.set_edge_weights(c.net.withColumn("weight", F.lit(0.5)), c.net.where("src % 10 = 0 and dst = src + 1"), 1.0).withColumnRenamed("weight", "r"))
query("pr_33_normals_without_length", "SELECT id, 0.0::DOUBLE AS nx, 0.0::DOUBLE AS ny, 1.0::DOUBLE AS nz FROM pts")(lambda c: points.normalize_normals(c.xyz.select("id", *[F.lit(0.0).alias(n) for n in points.NORMAL]), (0, 0, 1)))
query("pr_37_scan_origins", "SELECT scan, 2.0::DOUBLE AS x, 3.0::DOUBLE AS y FROM scan GROUP BY scan")(lambda c: scans.move_origins(c.scan.select("scan").distinct().withColumn("origin", F.array(*[F.lit(float(v)) for v in linalg.rigid(None, (1, 1, 0)).reshape(-1)])), linalg.rigid(None, (1, 2, 0))).select("scan", F.col("origin")[3].alias("x"), F.col("origin")[7].alias("y")))
query("pr_48_image_boundary", "SELECT count(*) AS n FROM pix WHERE u >= 5 AND u < 95 AND v >= 5 AND v < 95")(lambda c: c.pix.where(images.inside(F.col("u"), F.col("v"), 100, 100, 5)).agg(F.count(F.lit(1)).alias("n")))
query("pr_57_camera_pyramid", "SELECT i::INT AS i, j::INT AS j, CASE WHEN i = 2 AND j = 2 THEN 1 WHEN i = j THEN 12.5 WHEN j = 2 AND i < 2 THEN 12.0 ELSE 0 END::DOUBLE AS value FROM range(3) a(i), range(3) b(j)")(lambda c: numbers(c.spark, linalg.intrinsic_pyramid(K, 3)[2]))
query("pr_64_occupancy_voxel", f"WITH {q.OCC}, w AS (SELECT id, floor(x / 0.5)::INT AS ix, floor(y / 0.5)::INT AS iy, floor(z / 0.5)::INT AS iz FROM ptb) SELECT id, coalesce(p > 0, false) AS occupied, p IS NULL AS unknown FROM w LEFT JOIN occ USING (ix, iy, iz)")(lambda c: voxels.state_of(c.ptb, _occupancy(c), 0.5, (0, 0, 0)))
query("pr_54_distance_lookup", f"WITH {q.FIELD.format(cells='vox')}, w AS (SELECT id, floor(x / 0.5)::INT AS ix, floor(y / 0.5)::INT AS iy, floor(z / 0.5)::INT AS iz FROM ptb) SELECT id, {r('sqrt(d2) AS distance')} FROM w JOIN field USING (ix, iy, iz)")(lambda c: c.ptb.select("id", *points.voxel_keys(c.ptb, 0.5, [0.0] * 3)).join(q._field(c.vox), voxels.KEYS).select("id", "distance"))


def _union(c: Inputs) -> DataFrame:
    box = lambda df: (lambda b: Box(tuple(b[f"min_{k}"] for k in XYZ), tuple(b[f"max_{k}"] for k in XYZ)))(points.bounds(df).first())
    both = box(c.xyz) + box(c.ptb)
    return c.spark.createDataFrame([tuple(map(float, both.low))], "low_x double, low_y double, low_z double")


# Filters and predicates

query("fl_15_carve_silhouette", """WITH corner AS (SELECT ix, iy, iz, (ix + a) * 0.5 AS x, (iy + b) * 0.5 AS y, (iz + c) * 0.5 + 4.0 AS d FROM vox, range(2) p(a), range(2) q(b), range(2) s(c)),
    uv AS (SELECT *, floor(x * 50 / d + 49.5)::INT AS u, floor(y * 50 / d + 49.5)::INT AS v FROM corner WHERE d > 0)
    SELECT ix, iy, iz FROM uv JOIN pix USING (v, u) WHERE c0 > 20 AND d >= 1 GROUP BY ALL HAVING count(DISTINCT img) = (SELECT count(DISTINCT img) FROM pix)""")(lambda c: voxels.carve(c.vox, c.pix.withColumn("c0", (F.col("c0") > 20).cast("double")), K, CAM, 0.5, (0, 0, 0)))
query("fl_17_free_voxels", f"WITH {q.OCC} SELECT ix, iy, iz FROM occ WHERE p <= 0")(lambda c: voxels.free(_occupancy(c)).select(*voxels.KEYS))
query("fl_18_occupied_voxels", f"WITH {q.OCC} SELECT ix, iy, iz FROM occ WHERE p > 0")(lambda c: voxels.occupied(_occupancy(c)).select(*voxels.KEYS))
query("fl_22_scan_shadows")(lambda c: scans.shadows_filter(c.scan, 100, 0.03, 0.2, 2.9, 2, 1))
BOXED = f"WITH {q.SEG}, t AS (SELECT id, (-1 - ax) / (bx - ax) AS x0, (0.5 - ax) / (bx - ax) AS x1, (-0.5 - ay) / (by_ - ay) AS y0, (1 - ay) / (by_ - ay) AS y1, (-0.3 - az) / (bz - az) AS z0, (0.3 - az) / (bz - az) AS z1 FROM seg), e AS (SELECT id, greatest(0, least(x0, x1), least(y0, y1), least(z0, z1)) AS a, least(greatest(x0, x1), greatest(y0, y1), greatest(z0, z1)) AS b FROM t)"


def _limits() -> tuple[list, list]:
    return [F.lit(v) for v in (-1.0, -0.5, -0.3)], [F.lit(v) for v in (0.5, 1.0, 0.3)]


query("fl_26_segment_box", f"{BOXED} SELECT id FROM e WHERE a <= least(b, 1)")(lambda c: _segments(c).where(voxels.segment_hits_box(_abc("a"), _abc("b"), *_limits())).select("id"))
query("fl_27_ray_box", f"{BOXED} SELECT id, {r('a AS t')} FROM e WHERE a <= b")(lambda c: _segments(c).select("id", predicates.ray_aabb(_abc("a"), predicates.sub(_abc("b"), _abc("a")), *_limits()).alias("t")).where("t is not null"))
query("fl_30_capsule_box")(lambda c: _segments(c).where(predicates.capsule_aabb(F.lit(0.2), _abc("a"), predicates.sub(_abc("b"), _abc("a")), *_limits())).select("id"))
query("fl_32_point_plane", f"SELECT id, {r('(x - 1) / sqrt(3) + y / sqrt(3) + z / sqrt(3) AS d')} FROM pts")(lambda c: c.xyz.select("id", predicates.point_plane([F.col(k) for k in XYZ], *[[F.lit(1.0 if i == j else 0.0) for j in range(3)] for i in range(3)]).alias("d")))
query("fl_34_segment_segment")(lambda c: _segments(c).select("id", predicates.segment_segment_squared(_abc("a"), _abc("b"), [F.lit(v) for v in (0.0, 0.0, 0.0)], [F.lit(v) for v in (1.0, 1.0, 1.0)]).alias("d2")))


def _tested(c: Inputs, test) -> DataFrame:
    """test(t, u) for each three points in a row and the three after them; the last three are followed by the first."""
    import pandas as pd

    of = c.xyz.groupBy(F.expr("id div 3").alias("i")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("id", *XYZ))), lambda p: F.array(*[p[k] for k in XYZ]))).alias("t")).where("size(t) = 9")
    n = of.count()
    both = of.join(of.select(((F.col("i") + (n - 1)) % n).alias("i"), F.col("t").alias("u")), "i")

    def tested(batches):
        for x in batches:
            yield pd.DataFrame({"id": x["i"], "hit": [bool(test(np.reshape(t, (3, 3)), np.reshape(u, (3, 3)))) for t, u in zip(x["t"], x["u"])]})

    return both.mapInPandas(tested, "id long, hit boolean")


query("fl_23_triangle_triangle")(lambda c: _tested(c, triangle_triangle))
query("fl_24_triangle_box")(lambda c: _tested(c, lambda t, _: triangle_box(t, Box((-1, -1, -1), (1, 1, 1)))))
query("fl_29_box_box")(lambda c: _tested(c, lambda t, u: box_box(OrientedBox(t[0], linalg.rotation_from_axis_angle(t[1]), np.abs(t[2])), OrientedBox(u[0], linalg.rotation_from_axis_angle(u[1]), np.abs(u[2])))))

# Joins

query("jn_05_single_query", f"WITH d AS (SELECT id AS t, (x - 0.1) * (x - 0.1) + (y - 0.2) * (y - 0.2) + (z - 0.3) * (z - 0.3) AS d2 FROM pts) SELECT t, {r('d2')} FROM d ORDER BY d.d2, t LIMIT 7")(lambda c: spatial.knn_join(c.spark.createDataFrame([(0, 0.1, 0.2, 0.3)], "id long, x double, y double, z double"), c.xyz, 7).select("t", "d2"))
PIXEL_PAIRS = """s AS (SELECT img, v, u, c0 / 10 AS d, c0 / 50 AS i FROM pix WHERE c0 > 0 AND c0 < 40), p AS (SELECT img, u, v, i, d, (u - 49.5) * d / 50 + 0.05 AS x, (v - 49.5) * d / 50 AS y, d AS z FROM s), w AS (SELECT *, floor(x * 50 / z + 49.5 + 0.5)::INT AS tu, floor(y * 50 / z + 49.5 + 0.5)::INT AS tv FROM p),
    j AS (SELECT w.img, w.tu, w.tv, w.u, w.v, w.z, w.i, t.i AS ti FROM w JOIN s t ON t.img = w.img AND t.u = w.tu AND t.v = w.tv AND abs(t.d - w.z) <= 0.5), best AS (SELECT img, tu, tv, min({'z': z, 'u': u, 'v': v, 'i': i, 'ti': ti}) AS b FROM j GROUP BY img, tu, tv)"""
query("jn_11_pixel_pairs", f"WITH {PIXEL_PAIRS} SELECT img, tu, tv, b.u AS u, b.v AS v, round(b.z, 6) + 0.0 AS z FROM best")(lambda c: _pixels(c).select("img", "tu", "tv", "u", "v", "z"))


def _frames(c: Inputs) -> DataFrame:
    """All images as depths and intensities."""
    return c.pix.where("c0 > 0 and c0 < 40").select("img", F.col("v").cast("int").alias("v"), F.col("u").cast("int").alias("u"), (F.col("c0") / 50).alias("intensity"), (F.col("c0") / 10).alias("depth"))


def _frame(c: Inputs) -> DataFrame:
    """The first image: odometry takes one pair of images by nature."""
    return _frames(c).where("img = 0").drop("img")


def _pixels(c: Inputs) -> DataFrame:
    return alignment.pixel_pairs(_frames(c), _frames(c), K, linalg.rigid(None, (0.05, 0, 0)), 100, 100, 0.5)


OCC_LINES = f"WITH {q.OCC}, {q.SEG}, tt AS (SELECT id, ix, iy, iz, (ix * 0.5 - ax) / (bx - ax) AS x0, ((ix + 1) * 0.5 - ax) / (bx - ax) AS x1, (iy * 0.5 - ay) / (by_ - ay) AS y0, ((iy + 1) * 0.5 - ay) / (by_ - ay) AS y1, (iz * 0.5 - az) / (bz - az) AS z0, ((iz + 1) * 0.5 - az) / (bz - az) AS z1 FROM seg, occ WHERE p > 0), h AS (SELECT id, min({{'x': ix, 'y': iy, 'z': iz}}) AS v FROM tt WHERE greatest(0, least(x0, x1), least(y0, y1), least(z0, z1)) <= least(1, greatest(x0, x1), greatest(y0, y1), greatest(z0, z1)) GROUP BY id) SELECT id AS lid, v.x AS ix, v.y AS iy, v.z AS iz FROM h"
query("jn_16_occupancy_lines", OCC_LINES)(lambda c: voxels.collide_lines(voxels.occupied(_occupancy(c)), _segments(c).select(F.col("id").alias("lid"), *[F.col(f"a{k}").alias(f"{k}0") for k in XYZ], *[F.col(f"b{k}").alias(f"{k}1") for k in XYZ]), 0.5, (0, 0, 0)))
query("jn_19_occupancy_spheres", f"WITH {q.OCC}, t AS (SELECT p.id AS pid, min({{'x': ix, 'y': iy, 'z': iz}}) AS v FROM ptb p JOIN occ ON occ.p > 0 AND pow(greatest(ix * 0.5 - x, 0, x - (ix + 1) * 0.5), 2) + pow(greatest(iy * 0.5 - y, 0, y - (iy + 1) * 0.5), 2) + pow(greatest(iz * 0.5 - z, 0, z - (iz + 1) * 0.5), 2) <= 0.16 GROUP BY p.id) SELECT pid, v.x AS ix, v.y AS iy, v.z AS iz FROM t")(lambda c: voxels.collide_spheres(voxels.occupied(_occupancy(c)), c.ptb.select(F.col("id").alias("pid"), *XYZ, F.lit(0.4).alias("radius")), 0.5, (0, 0, 0)))
query("jn_22_colliding_voxels", "SELECT b.ix, b.iy, b.iz FROM voxb b SEMI JOIN vox a ON abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 AND abs(a.iz - b.iz) <= 1")(lambda c: voxels.collide_voxels(c.vox, c.voxb, 0.5, 0.5, (0, 0, 0), (0, 0, 0)).select(F.col("bx").alias("ix"), F.col("by").alias("iy"), F.col("bz").alias("iz")))

# Aggregates

query("ag_03_aabb_volume", f"SELECT {r('(max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z)) AS volume')} FROM pts")(lambda c: points.bounds(c.xyz).select(((F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y")) * (F.col("max_z") - F.col("min_z"))).alias("volume")))
query("ag_11_spfh")(lambda c: features.spfh(features._pairs(c.pts, 12, None)).select("id", F.transform("feat", lambda x: F.round(x, 6)).alias("feat")))
query("ag_15_weighted_kabsch_sums", f"SELECT count(*) AS n, {r('sum(1.0 + id % 3) AS w', *[f'sum((1.0 + id % 3) * p.{k}) / sum(1.0 + id % 3) AS q{k}' for k in XYZ])} FROM ptb p JOIN pts t USING (id)")(lambda c: registration.sums_for_kabsch(_paired(c).withColumn("wt", 1.0 + F.col("id") % 3), "wt").select("n", "w", *[f"q{k}" for k in XYZ]))
query("ag_20_symmetric_rmse", f"SELECT {r('sqrt(avg(pow((p.x - t.x) * 2 * t.nx + (p.y - t.y) * 2 * t.ny + (p.z - t.z) * 2 * t.nz, 2))) AS rmse')} FROM ptb p JOIN pts t USING (id)")(lambda c: c.spark.createDataFrame([(registration.Symmetric().rmse(_paired(c, target=c.pts).withColumns({f"q_{n}": F.col(f"t_{n}") for n in points.NORMAL})),)], "rmse double"))
query("ag_27_add_voxel", f"SELECT ix, iy, iz, {r('1.7::DOUBLE AS prob_log')} FROM vox")(lambda c: voxels.updated(voxels.occupancy_of(c.vox), c.vox.withColumn("occupied", F.lit(True))))
def _traversed(c: Inputs) -> DataFrame:
    """How many cells a ray from each point crosses on its way along one axis."""
    import pandas as pd

    def run(batches):
        for b in batches:
            n = []
            for i, *p in b[["id", *XYZ]].itertuples(index=False):
                end = np.array(p)
                end[int(i) % 3] += 2.6 if i % 2 else -1.7
                n.append(len(voxels.traverse(np.array(p), end, 0.5)))
            yield pd.DataFrame({"id": b["id"], "cells": n})

    return c.xyz.mapInPandas(run, "id long, cells long")


query("ag_30_traversal", "WITH a AS (SELECT id, [x, y, z][id % 3 + 1] AS p, CASE WHEN id % 2 = 1 THEN 2.6 ELSE -1.7 END AS d FROM pts) SELECT id, abs(floor((p + d) / 0.5) - floor(p / 0.5))::BIGINT AS cells FROM a")(_traversed)
query("ag_41_pyramid", f"WITH h AS ({q._conv('pix', 'u', images.GAUSSIAN3)}), g AS ({q._conv('h', 'v', images.GAUSSIAN3)}) SELECT img, (v // 2)::INT AS v, (u // 2)::INT AS u, round(avg(c0 * 0.3141592653589793), 5) AS c0 FROM g GROUP BY 1, 2, 3")(lambda c: images.pyramid(c.pix, 100, 100, 2)[1][0].select(*images.KEY, F.round(F.col("c0") * 0.3141592653589793, 5).alias("c0")))
query("ag_51_integrate_distances", f"WITH {TSDF.replace('least(1.0, (depth - d) / 0.6)', 'least(1.0, (depth - d) * 2 / 0.6)').replace('depth - d > -0.6', '(depth - d) * 2 > -0.6')} SELECT ix, iy, iz, {r('tsdf')} FROM vol")(lambda c: volumes.integrate(None, volumes.open_cells(c.xyz, 0.5, 0.6), c.pix.select("img", "v", "u", (F.col("c0") / 10).alias("depth")), K, CAM, 0.5, 0.6, multiplier=images.distance_multiplier(c.spark, K, 100, 100).withColumn("m", F.lit(2.0))).select(*voxels.KEYS, "tsdf"))
query("ag_53_surface_mesh")(lambda c: volumes.surface_mesh(_ball(c), 0.2))
query("ag_55_tsdf_voxels", f"WITH {TSDF} SELECT ix, iy, iz FROM vol WHERE tsdf < 0.98 AND tsdf >= -0.98")(lambda c: volumes.voxel_points(_volume(c), 0.5).select(*voxels.KEYS))
query("ag_62_triangle_areas", f"WITH {TRI_XYZ} SELECT tid, v0, v1, v2, {r('sqrt(cx * cx + cy * cy + cz * cz) / 2 AS area')} FROM tn")(lambda c: meshes.triangle_areas(c.mesh))
query("ag_65_kabsch_by_id")(lambda c: numbers(c.spark, registration.kabsch_of(_paired(c))))
query("ag_66_occupied_cells", "SELECT DISTINCT floor(x / 0.5)::INT AS ix, floor(y / 0.5)::INT AS iy, floor(z / 0.5)::INT AS iz FROM pts")(lambda c: c.vox)


def _ball(c: Inputs) -> DataFrame:
    cells = voxels.dense(c.spark, 0.2, (2.0, 2.0, 2.0))
    d = F.sqrt(sum(((F.col(k) + 0.5) * 0.2 - 1.0) * ((F.col(k) + 0.5) * 0.2 - 1.0) for k in voxels.KEYS))
    return cells.withColumns({"tsdf": F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (d - 0.6) / 0.5)), "weight": F.lit(1.0)})


# Ranks, sets, graphs, solvers

query("wn_01_rank_cap", f"WITH {q.KNN.format(q='ptb', t='pts')} SELECT q, t, {r('d2')} FROM k WHERE rn <= 2 AND d2 < 2.25")(lambda c: spatial.radius_join(c.ptb, c.xyz, 1.5, max_nn=2))
query("wn_05_plane_of_three", f"WITH {TRI_XYZ}, u AS (SELECT *, sqrt(cx * cx + cy * cy + cz * cz) AS s FROM tn) SELECT tid, {r('abs(cx) / s AS a', 'abs(cz) / s AS c', 'abs((cx * x0 + cy * y0 + cz * z0) / s) AS d')} FROM u")(lambda c: _planes(c))


def _planes(c: Inputs) -> DataFrame:
    """The plane of each triangle, without signs."""
    import pandas as pd

    def run(batches):
        for b in batches:
            found = np.abs([points.plane_through(np.reshape(p, (3, 3))) for p in b["p"]]).reshape(-1, 4)
            yield pd.DataFrame({"tid": b["tid"], "a": found[:, 0], "c": found[:, 2], "d": found[:, 3]})

    places = F.array(*[F.col(f"{k}{n}") for n in range(3) for k in XYZ])
    return meshes.corners(c.mesh).select("tid", places.alias("p")).mapInPandas(run, "tid long, a double, c double, d double")



query("st_05_append_vertices", f"SELECT id, {r(*XYZ)} FROM pts UNION ALL SELECT id + (SELECT max(id) + 1 FROM pts), {r(*XYZ)} FROM pts")(lambda c: meshes.concat(c.mesh, c.mesh)[0])
query("st_07_free_minus_occupied", "SELECT vox.* FROM vox ANTI JOIN voxb USING (ix, iy, iz)")(lambda c: voxels.select(c.vox, c.voxb, invert=True))
query("st_08_index_complement", "SELECT id FROM pts WHERE id % 4 <> 0")(lambda c: points.select_by_index(c.xyz, c.xyz.where("id % 4 = 0"), invert=True).select("id"))
query("st_09_remove_directed_edges", f"SELECT src, dst, {r('weight')} FROM net WHERE NOT (src % 10 = 0 AND dst = src + 1)")(lambda c: graphs.remove_edges(c.net, c.net.where("src % 10 = 0 and dst = src + 1"), directed=True))
query("gr_03_add_weighted_edges", f"SELECT src, dst, {r('weight')} FROM net UNION ALL SELECT id, id + 100000, id * 0.5 FROM pts WHERE id < 10")(lambda c: graphs.add_edges(c.net, c.xyz.where("id < 10").select(F.col("id").alias("src"), (F.col("id") + 100000).alias("dst"), (F.col("id") * 0.5).alias("weight")), directed=True))
query("gr_08_evaluate", f"WITH {q.KNN.format(q='ptb', t='pts')}, n AS (SELECT * FROM k WHERE rn = 1 AND d2 < 0.64) SELECT {r('count(*) / (SELECT count(*) FROM ptb) AS fitness', 'sqrt(avg(d2)) AS rmse')} FROM n")(lambda c: (lambda f: c.spark.createDataFrame([(f.fitness, f.inlier_rmse)], "fitness double, rmse double"))(registration.evaluate(c.ptb, c.xyz, 0.8)))
query("gr_11_symmetric_icp")(lambda c: numbers(c.spark, registration.icp(points.transform(c.pts.select("id", *XYZ, *points.NORMAL), linalg.rigid(None, (0.02, 0.01, 0))), c.pts, 0.5, estimation=registration.Symmetric(), iterations=5).transformation))
query("gr_13_color_gradients")(lambda c: alignment.color_gradients(c.pts, 1.0).select("id", "gx", "gy", "gz"))
query("gr_15_plane_covariances", f"SELECT id, {r('1 - 0.999 * nx * nx AS xx', '-0.999 * nx * ny AS xy', '1 - 0.999 * nz * nz AS zz')} FROM pts")(lambda c: alignment.plane_covariances(c.pts).select("id", F.col("cov")[0].alias("xx"), F.col("cov")[1].alias("xy"), F.col("cov")[8].alias("zz")))
query("gr_20_solve", f"WITH s AS (SELECT sum(x * x) AS a, sum(x * y) AS b, sum(y * y) AS c, sum(x * z) AS p, sum(y * z) AS q FROM pts) SELECT {r('(p * c - q * b) / (a * c - b * b) AS x', '(a * q - b * p) / (a * c - b * b) AS y')} FROM s")(lambda c: _solved(c))


def _solved(c: Inputs) -> DataFrame:
    """z by x and y, by least squares."""
    s = c.xyz.agg(*[F.sum(F.expr(e)).alias(n) for n, e in (("a", "x * x"), ("b", "x * y"), ("c", "y * y"), ("p", "x * z"), ("q", "y * z"))]).first()
    found = linalg.solve_psd(np.array([[s["a"], s["b"]], [s["b"], s["c"]]]), np.array([s["p"], s["q"]]))
    return c.spark.createDataFrame([tuple(map(float, found))], "x double, y double")



query("gr_24_voronoi", f"WITH {q.FIELD.format(cells='vox')} SELECT ix, iy, iz, d2::INT AS d2, true AS held FROM field")(lambda c: _voronoi(c))


def _voronoi(c: Inputs) -> DataFrame:
    """Of each cell how far the voxel that it was given is (which of equally near ones it is, isn't told), and whether that is a voxel."""
    d2 = sum(((F.col(k) - F.col("n" + k[1])) * (F.col(k) - F.col("n" + k[1])) for k in voxels.KEYS), F.lit(0))
    seeds = c.vox.select(*[F.col(k).alias("n" + k[1]) for k in voxels.KEYS], F.lit(True).alias("held"))
    return q._field(c.vox).withColumn("d2", d2.cast("int")).join(seeds, ["nx", "ny", "nz"], "left").select(*voxels.KEYS, "d2", F.coalesce("held", F.lit(False)).alias("held"))


query("gr_29_rgbd_odometry")(lambda c: numbers(c.spark, alignment.rgbd_odometry(_frame(c), _frame(c), K, 100, 100, iterations=(2,))[1]))
query("gr_33_preprocess_depth", "SELECT img, v::INT AS v, u::INT AS u, CASE WHEN c0 / 10 <= 2 THEN round(c0 / 10, 6) END AS depth FROM pix WHERE c0 > 0 AND c0 < 40")(lambda c: alignment.preprocess_depth(_frames(c), 0.0, 2.0).select("img", "v", "u", "depth"))
query("sm_02_pop_one_scan", f"SELECT scan, step, {r('range')} FROM scan WHERE scan = (SELECT min(scan) FROM scan)")(lambda c: scans.pop_one(c.scan)[0])
query("sm_01_scan_ring", f"SELECT scan, step, {r('range')} FROM scan WHERE scan > (SELECT max(scan) FROM scan) - 10")(lambda c: scans.latest(c.scan, 10))
