"""Queries of the engine by inventory id, each with its SQL counterpart where SQL can express it.

Fractions are rounded to six places (and negative zeros made plain ones), as sums of fractions depend on their order.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import linalg, predicates
from .operators import alignment, features, graphs, images, meshes, planning, points, registration, scans, volumes, voxels
from .plans import ranking, spatial
from .plans.spatial import XYZ

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The views that the SQL may use.
VIEWS = """
raw AS (SELECT vec_id AS id, [e::DOUBLE * 10 FOR e IN embedding] AS e, label FROM embeddings),
pts0 AS (SELECT id, label, e[1] AS x, e[2] AS y, e[3] AS z, sqrt(e[4] * e[4] + e[5] * e[5] + e[6] * e[6]) AS s, e FROM raw),
pts AS (SELECT id, label, x, y, z, e[4] / s AS nx, e[5] / s AS ny, e[6] / s AS nz, (e[7] / 10 + 1) / 2 AS r, (e[8] / 10 + 1) / 2 AS g, (e[9] / 10 + 1) / 2 AS b FROM pts0),
ptb AS (SELECT id, e[10] AS x, e[11] AS y, e[12] AS z FROM raw),
scan AS (SELECT event_id // 100 AS scan, event_id % 100 AS step, value AS range FROM events),
pix AS (SELECT event_id // 10000 AS img, (event_id % 10000) // 100 AS v, event_id % 100 AS u, value AS c0 FROM events),
net AS (SELECT id AS src, id + 1 AS dst, 1.0 + id % 7 AS weight FROM pts WHERE id + 1 < (SELECT count(*) FROM pts) UNION ALL SELECT id, (id * 7 + 3) % (SELECT count(*) FROM pts), 2.0 + id % 5 FROM pts WHERE (id * 7 + 3) % (SELECT count(*) FROM pts) NOT IN (id, id + 1)),
vox AS (SELECT DISTINCT floor(x / 0.5)::INT AS ix, floor(y / 0.5)::INT AS iy, floor(z / 0.5)::INT AS iz FROM pts),
voxb AS (SELECT DISTINCT floor(x / 0.5)::INT AS ix, floor(y / 0.5)::INT AS iy, floor(z / 0.5)::INT AS iz FROM ptb)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Inputs:
    """The views of VIEWS as frames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @property
    def _raw(self) -> DataFrame:
        return table(self.spark, self.sf_dir, "embeddings")

    def _e(self, i: int) -> Column:
        return F.col("embedding")[i - 1].cast("double") * 10

    @property
    def pts(self) -> DataFrame:
        s = F.sqrt(sum((self._e(i) * self._e(i) for i in (5, 6)), self._e(4) * self._e(4)))
        return self._raw.select(F.col("vec_id").alias("id"), "label", *[self._e(i).alias(c) for i, c in enumerate(XYZ, 1)], *[(self._e(i) / s).alias(c) for i, c in enumerate(points.NORMAL, 4)], *[((self._e(i) / 10 + 1) / 2).alias(c) for i, c in enumerate(points.COLOR, 7)])

    @property
    def xyz(self) -> DataFrame:
        return self.pts.select("id", *XYZ)

    @property
    def ptb(self) -> DataFrame:
        return self._raw.select(F.col("vec_id").alias("id"), *[self._e(i).alias(c) for i, c in enumerate(XYZ, 10)])

    @property
    def scan(self) -> DataFrame:
        return table(self.spark, self.sf_dir, "events").select(F.expr("event_id div 100").alias("scan"), (F.col("event_id") % 100).alias("step"), F.col("value").alias("range"))

    @property
    def pix(self) -> DataFrame:
        return table(self.spark, self.sf_dir, "events").select(F.expr("event_id div 10000").alias("img"), F.expr("(event_id % 10000) div 100").alias("v"), (F.col("event_id") % 100).alias("u"), F.col("value").alias("c0"))

    @property
    def net(self) -> DataFrame:
        n = self._raw.count()
        i = self._raw.select(F.col("vec_id").alias("src"))
        ring = i.where(F.col("src") + 1 < n).select("src", (F.col("src") + 1).alias("dst"), (1.0 + F.col("src") % 7).alias("weight"))
        leap = i.select("src", ((F.col("src") * 7 + 3) % n).alias("dst"), (2.0 + F.col("src") % 5).alias("weight"))
        return ring.unionByName(leap.where("dst <> src and dst <> src + 1"))

    @property
    def vox(self) -> DataFrame:
        return self.xyz.select(*points.voxel_keys(self.xyz, 0.5, [0.0] * 3)).distinct()

    @property
    def voxb(self) -> DataFrame:
        return self.ptb.select(*points.voxel_keys(self.ptb, 0.5, [0.0] * 3)).distinct()

    @property
    def nodes(self) -> DataFrame:
        return self.xyz

    @property
    def mesh(self) -> meshes.Mesh:
        """Triangles over neighbours in the order of ids."""
        n = self._raw.count()
        t = self._raw.select(F.col("vec_id").alias("tid")).where(F.col("tid") + 2 < n)
        return self.xyz, t.select("tid", F.col("tid").alias("v0"), (F.col("tid") + 1).alias("v1"), (F.col("tid") + 2).alias("v2"))


TRI = "tri AS (SELECT id AS tid, id AS v0, id + 1 AS v1, id + 2 AS v2 FROM pts WHERE id + 2 < (SELECT count(*) FROM pts))"
TRI_XYZ = TRI + ", txyz AS (SELECT tri.*, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1, c.x AS x2, c.y AS y2, c.z AS z2 FROM tri JOIN pts a ON a.id = v0 JOIN pts b ON b.id = v1 JOIN pts c ON c.id = v2), tn AS (SELECT *, (y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0) AS cx, (z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0) AS cy, (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0) AS cz FROM txyz)"


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, places) + F.lit(0.0)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])


def r(*names: str, places: int = 6) -> str:
    """Rounded SQL expressions; "e AS n" names one."""
    out = []
    for x in names:
        e, _, n = x.rpartition(" AS ")
        out.append(f"round({e or n}, {places}) + 0.0 AS {n}")
    return ", ".join(out)


def query(name: str, sql: str | None = None):
    """Registers a function of Inputs; sql follows the views, more of them first if it starts with WITH."""

    def add(f: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(Inputs(spark, sf_dir)))
        if sql:
            body = sql.strip()
            more = body[5:] if body.startswith("WITH ") else None
            ORACLES[name] = f"WITH RECURSIVE {VIEWS.strip()}, {more}" if more else f"WITH {VIEWS.strip()}\n{body}"
        return f

    return add


def numbers(spark: SparkSession, m: np.ndarray) -> DataFrame:
    """A matrix as (i, j, value)."""
    return spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(np.atleast_2d(m)) for j, v in enumerate(row)], "i int, j int, value double")


M = linalg.rigid(linalg.rotation_z(math.pi / 6), (1.0, -2.0, 0.5))


def _lin(m: np.ndarray, names=XYZ, shift=True) -> list[str]:
    return [" + ".join([f"({m[i, j]!r}) * {c}" for j, c in enumerate(names)] + ([repr(float(m[i, 3]))] if shift else [])).replace("np.float64", "") for i in range(3)]


P = "x, y, z"
_m = _lin(M)
_n = _lin(M, points.NORMAL, False)

# Projections

query("pr_01_transform", f"SELECT id, {r(*[f'{e} AS {c}' for e, c in zip(_m, XYZ)], *[f'{e} AS {c}' for e, c in zip(_n, points.NORMAL)])} FROM pts")(lambda c: points.transform(c.pts.select("id", *XYZ, *points.NORMAL), M))
query("pr_05_translate", f"SELECT id, {r('x + 1 AS x', 'y + 2 AS y', 'z + 3 AS z')} FROM pts")(lambda c: points.translate(c.xyz, (1, 2, 3)))
query("pr_05_translate_absolute", f"SELECT id, {r('x - avg(x) OVER () + 1 AS x', 'y - avg(y) OVER () + 2 AS y', 'z - avg(z) OVER () + 3 AS z')} FROM pts")(lambda c: points.translate(c.xyz, (1, 2, 3), relative=False))
query("pr_07_scale", f"SELECT id, {r(*[f'({k} - avg({k}) OVER ()) * 2 + avg({k}) OVER () AS {k}' for k in XYZ])} FROM pts")(lambda c: points.scale(c.xyz, 2.0))
query("pr_09_rotate", f"WITH m AS (SELECT avg(x) AS a, avg(y) AS b FROM pts) SELECT id, {r('a - (y - m.b) AS x', 'm.b + (x - a) AS y', 'z AS z')} FROM pts, m")(lambda c: points.rotate(c.xyz, np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1]])))
query("pr_11_normalize_normals", f"SELECT id, {r('nx', 'ny', 'nz')} FROM pts")(lambda c: points.normalize_normals(c.pts.select("id", *[(F.col(n) * 3).alias(n) for n in points.NORMAL])))
query("pr_12_paint_uniform_color", "SELECT id, 0.5::DOUBLE AS r, 0.0::DOUBLE AS g, 1.0::DOUBLE AS b FROM pts")(lambda c: points.paint_uniform_color(c.pts, (0.5, -1, 2)).select("id", *points.COLOR))
query("pr_13_orient_normals", f"SELECT id, {r(*[f'CASE WHEN nz < 0 THEN -{n} ELSE {n} END AS {n}' for n in points.NORMAL])} FROM pts")(lambda c: points.orient_normals_to_align_with_direction(c.pts).select("id", *points.NORMAL))
query("pr_18_get_voxel", "SELECT id, floor(x / 0.5)::INT AS ix, floor(y / 0.5)::INT AS iy, floor(z / 0.5)::INT AS iz FROM pts")(lambda c: c.xyz.select("id", *points.voxel_keys(c.xyz, 0.5, [0.0] * 3)))
query("pr_19_voxel_centers", f"SELECT ix, iy, iz, {r('(ix + 0.5) * 0.5 + 1 AS x', '(iy + 0.5) * 0.5 AS y', '(iz + 0.5) * 0.5 AS z')} FROM vox")(lambda c: voxels.centers(c.vox, 0.5, (1, 0, 0)))
query("pr_20_voxel_bounding_points", f"SELECT ix, iy, iz, (4 * a + 2 * b + c)::INT AS corner, {r('(ix + a) * 0.5 AS x', '(iy + b) * 0.5 AS y', '(iz + c) * 0.5 AS z')} FROM vox, range(2) p(a), range(2) q(b), range(2) s(c)")(lambda c: voxels.bounding_points(c.vox, 0.5, (0, 0, 0)))
query("pr_22_linear_index", "SELECT ix, iy, iz, CASE WHEN least(ix, iy, iz) + 4 >= 0 AND greatest(ix, iy, iz) + 4 < 8 THEN ((ix + 4) * 8 + iy + 4) * 8 + iz + 4 ELSE -1 END::INT AS cell FROM vox")(lambda c: c.vox.withColumn("cell", voxels.linear_index(F.col("ix"), F.col("iy"), F.col("iz"), 8)))
query("pr_29_line_coordinates", f"SELECT src, dst, {r('a.x AS x0', 'a.y AS y0', 'a.z AS z0', 'b.x AS x1', 'b.y AS y1', 'b.z AS z1')} FROM net JOIN pts a ON a.id = src JOIN pts b ON b.id = dst")(lambda c: graphs.ends(c.net.select("src", "dst"), c.nodes).select("src", "dst", "x0", "y0", "z0", "x1", "y1", "z1"))
query("pr_36_triangle_normals", f"WITH {TRI_XYZ} SELECT tid, v0, v1, v2, {r(*[f'{k} / sqrt(cx * cx + cy * cy + cz * cz) AS {n}' for k, n in zip(('cx', 'cy', 'cz'), points.NORMAL)])} FROM tn")(lambda c: meshes.triangle_normals(c.mesh))
query("pr_37_scan_scale", f"SELECT scan, step, {r('range * 2.5 AS range')} FROM scan")(lambda c: scans.scale(c.scan, 2.5))
query("pr_38_range_filter", "SELECT scan, step, CASE WHEN range BETWEEN 5 AND 50 THEN round(range, 6) + 0.0 END AS range FROM scan")(lambda c: scans.range_filter(c.scan, 5, 50))
query("pr_39_clip_intensity", f"SELECT img, v, u, {r('least(20.0, greatest(2.0, c0)) AS c0')} FROM pix")(lambda c: images.clip_intensity(c.pix, 2, 20))
query("pr_40_linear_transform", f"SELECT img, v, u, {r('c0 * 0.5 + 1 AS c0')} FROM pix")(lambda c: images.linear_transform(c.pix, 0.5, 1))
query("pr_41_depth_to_float", f"SELECT img, v, u, {r('CASE WHEN c0 / 10 >= 3 THEN 0.0 ELSE c0 / 10 END AS c0')} FROM pix")(lambda c: images.depth_to_float(c.pix, 10.9, 3.7))
query("pr_42_gray", f"SELECT img, v, u, {r('c0 * 0.299 + c0 * 2 * 0.587 + (c0 + 1) * 0.114 AS c0')} FROM pix")(lambda c: images.gray(c.pix.withColumns({"c1": F.col("c0") * 2, "c2": F.col("c0") + 1})))
query("pr_43_float_image", f"SELECT img, v, u, {r('c0 / 255 AS c0')} FROM pix")(lambda c: images.to_float(c.pix))
query("pr_44_from_float", "SELECT img, v, u, trunc(c0 * 255)::INT AS c0 FROM pix")(lambda c: images.from_float(c.pix))
K = np.array([[50.0, 0, 49.5], [0, 50.0, 49.5], [0, 0, 1]])
query("pr_45_distance_multiplier", f"WITH uv AS (SELECT v, u FROM range(100) a(v), range(100) b(u)) SELECT v::INT AS v, u::INT AS u, {r('sqrt(((u - 49.5) / 50) * ((u - 49.5) / 50) + ((v - 49.5) / 50) * ((v - 49.5) / 50) + 1) AS m')} FROM uv")(lambda c: images.distance_multiplier(c.spark, K, 100, 100))
query("pr_46_transpose", f"SELECT img, u AS v, v AS u, {r('c0')} FROM pix")(lambda c: images.transpose(c.pix))
query("pr_46_flip_vertical", f"SELECT img, 99 - v AS v, u, {r('c0')} FROM pix")(lambda c: images.flip_vertical(c.pix, 100))
query("pr_46_flip_horizontal", f"SELECT img, v, 99 - u AS u, {r('c0')} FROM pix")(lambda c: images.flip_horizontal(c.pix, 100))
query(
    "pr_47_float_value_at",
    f"""WITH spot AS (SELECT id, id % (SELECT max(img) + 1 FROM pix) AS own, 40 + x * 5 AS pu, 45 + y * 5 AS pv, least(greatest(floor(40 + x * 5)::INT, 0), 98) AS u0, least(greatest(floor(45 + y * 5)::INT, 0), 98) AS v0 FROM pts)
    SELECT id, {r('sum(c0 * (CASE WHEN u = u0 THEN 1 - (pu - u0) ELSE pu - u0 END) * (CASE WHEN v = v0 THEN 1 - (pv - v0) ELSE pv - v0 END)) AS value')}
    FROM spot LEFT JOIN pix ON img = own AND u IN (u0, u0 + 1) AND v IN (v0, v0 + 1) AND pu BETWEEN 0 AND 99 AND pv BETWEEN 0 AND 99 GROUP BY id""",
)(lambda c: images.value_at(c.xyz.select("id", (F.col("id") % (c.pix.agg(F.max("img")).first()[0] + 1)).alias("img"), (40 + F.col("x") * 5).alias("pu"), (45 + F.col("y") * 5).alias("pv")), c.pix.withColumns({"u": F.col("u").cast("int"), "v": F.col("v").cast("int")}), 100, 100))
query("pr_53_occupied_or_unknown", "WITH q AS (SELECT id, floor(x / 0.5)::INT AS ix, floor(y / 0.5)::INT AS iy, floor(z / 0.5)::INT AS iz FROM ptb) SELECT q.id, vox.ix IS NOT NULL AS occupied, vox.ix IS NULL AS unknown FROM q LEFT JOIN vox USING (ix, iy, iz)")(lambda c: voxels.state_of(c.ptb, c.vox.withColumn("prob_log", F.lit(0.85)), 0.5, (0, 0, 0)))

# Filters

query("fl_01_remove_none_finite", f"SELECT id, {r('x', 'y', 'z')} FROM pts WHERE id % 5 > 1")(lambda c: points.remove_none_finite_points(c.xyz.withColumn("x", F.when(F.col("id") % 5 == 0, F.lit(float("nan"))).when(F.col("id") % 5 == 1, F.lit(float("inf"))).otherwise(F.col("x")))))
query("fl_02_pass_through", f"SELECT id, {r('x', 'y', 'z')} FROM pts WHERE y BETWEEN -0.5 AND 1")(lambda c: points.pass_through_filter(c.xyz, 1, -0.5, 1.0))
query("fl_03_crop", f"SELECT id, {r('x', 'y', 'z')} FROM pts WHERE x BETWEEN -1 AND 1 AND y BETWEEN -1 AND 1 AND z BETWEEN -1 AND 1")(lambda c: points.crop(c.xyz, (-1, -1, -1), (1, 1, 1)))
query("fl_04_crop_oriented", f"SELECT id, {r('x', 'y', 'z')} FROM pts WHERE abs(0.6 * x + 0.8 * y) <= 1 AND abs(-0.8 * x + 0.6 * y) <= 0.5 AND abs(z - 0.1) <= 1.5")(lambda c: points.crop_oriented(c.xyz, (0, 0, 0.1), np.array([[0.6, -0.8, 0], [0.8, 0.6, 0], [0, 0, 1]]), (2, 1, 3)))
query("fl_05_indices_in_box", "SELECT id FROM pts WHERE x BETWEEN 0 AND 2 AND y BETWEEN 0 AND 2 AND z BETWEEN 0 AND 2")(lambda c: points.crop(c.xyz, (0, 0, 0), (2, 2, 2)).select("id"))
query("fl_07_select_by_index", f"SELECT id, {r('x')} FROM pts JOIN (SELECT id FROM pts WHERE id % 3 = 0 UNION ALL SELECT id FROM pts WHERE id % 9 = 0) USING (id)")(lambda c: points.select_by_index(c.xyz.select("id", "x"), c.xyz.where("id % 3 = 0").select("id").unionByName(c.xyz.where("id % 9 = 0").select("id"))))
query("fl_07_select_by_index_inverted", f"SELECT id, {r('x')} FROM pts WHERE id % 3 <> 0")(lambda c: points.select_by_index(c.xyz.select("id", "x"), c.xyz.where("id % 3 = 0"), invert=True))
query("fl_08_select_by_mask", f"SELECT id, {r('x')} FROM pts WHERE x > 0")(lambda c: points.select_by_mask(c.xyz.select("id", "x"), c.xyz.select("id", (F.col("x") > 0).alias("mask"))))
query("fl_09_uniform_down_sample", f"WITH n AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS rn, count(*) OVER () AS total FROM pts) SELECT id, {r('x')} FROM n WHERE rn % 7 = 0 AND rn < total // 7 * 7")(lambda c: points.uniform_down_sample(c.xyz.select("id", "x"), 7))
query("fl_10_radius_outlier", "SELECT a.id FROM pts a JOIN pts b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < 0.36 GROUP BY a.id HAVING count(*) > 4")(lambda c: points.remove_radius_outlier(c.xyz, 4, 0.6).select("id"))
KNN = "d AS (SELECT a.id AS q, b.id AS t, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM {q} a, {t} b), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, t) AS rn FROM d)"
query("fl_11_statistical_outlier", f"WITH {KNN.format(q='pts', t='pts')}, m AS (SELECT q, avg(d2) AS m FROM k WHERE rn <= 10 GROUP BY q), s AS (SELECT avg(m) + 1.5 * stddev_samp(m) AS lim FROM m WHERE m > 0) SELECT q AS id FROM m, s WHERE m > 0 AND m < lim")(lambda c: points.remove_statistical_outlier(c.xyz, 10, 1.5).select("id"))
query("fl_12_select_voxels", "SELECT vox.* FROM vox SEMI JOIN voxb USING (ix, iy, iz)")(lambda c: voxels.select(c.vox, c.voxb))
query("fl_12_select_voxels_inverted", "SELECT vox.* FROM vox ANTI JOIN voxb USING (ix, iy, iz)")(lambda c: voxels.select(c.vox, c.voxb, True))
query("fl_13_check_if_included", "WITH q AS (SELECT id, floor(x / 0.5)::INT AS ix, floor(y / 0.5)::INT AS iy, floor(z / 0.5)::INT AS iz FROM ptb) SELECT q.id, vox.ix IS NOT NULL AS included FROM q LEFT JOIN vox USING (ix, iy, iz)")(lambda c: voxels.included(c.ptb, c.vox, 0.5, (0, 0, 0)))
CAM = linalg.rigid(None, (0.0, 0.0, 4.0))
query(
    "fl_14_carve_depth_map",
    """WITH corner AS (SELECT ix, iy, iz, (ix + a) * 0.5 AS x, (iy + b) * 0.5 AS y, (iz + c) * 0.5 + 4.0 AS d FROM vox, range(2) p(a), range(2) q(b), range(2) s(c)),
    uv AS (SELECT *, floor(x * 50 / d + 49.5)::INT AS u, floor(y * 50 / d + 49.5)::INT AS v FROM corner WHERE d > 0)
    SELECT ix, iy, iz FROM uv JOIN (SELECT img, v, u, c0 / 10 AS c0 FROM pix) USING (v, u) WHERE c0 > 0 AND d >= c0 GROUP BY ALL HAVING count(DISTINCT img) = (SELECT count(DISTINCT img) FROM pix)""",
)(lambda c: voxels.carve(c.vox, images.linear_transform(c.pix, 0.1), K, CAM, 0.5, (0, 0, 0)))
query("fl_16_18_occupancy_split", "WITH e AS (SELECT ix, iy, iz, count(*) FILTER (hit) AS h, count(*) FILTER (NOT hit) AS m FROM (SELECT floor(x / 0.5)::INT AS ix, floor(y / 0.5)::INT AS iy, floor(z / 0.5)::INT AS iz, id % 3 = 0 AS hit FROM pts) GROUP BY ALL), p AS (SELECT ix, iy, iz, least(3.5, greatest(-2.0, m * -0.4) + h * 0.85)::DOUBLE AS p FROM e) SELECT ix, iy, iz, round(p, 6) + 0.0 AS prob_log, p > 0 AS occupied FROM p")(lambda c: voxels.known(voxels.updated(None, c.xyz.select(*points.voxel_keys(c.xyz, 0.5, [0.0] * 3), (F.col("id") % 3 == 0).alias("occupied")))).withColumn("occupied", F.col("prob_log") > 0))
query("fl_19_degenerate_triangles", f"WITH {TRI} SELECT tid, v0, v1, CASE WHEN tid % 4 = 0 THEN v0 ELSE v2 END AS v2 FROM tri WHERE tid % 4 <> 0")(lambda c: meshes.remove_degenerate_triangles(c.mesh[1].withColumn("v2", F.when(F.col("tid") % 4 == 0, F.col("v0")).otherwise(F.col("v2")))))
query("fl_20_unreferenced_vertices", f"WITH {TRI}, s AS (SELECT * FROM tri WHERE tid % 10 = 0), u AS (SELECT v0 AS id FROM s UNION SELECT v1 FROM s UNION SELECT v2 FROM s) SELECT row_number() OVER (ORDER BY id) - 1 AS id, {r('x', 'y', 'z')} FROM pts SEMI JOIN u USING (id)")(lambda c: meshes.remove_unreferenced_vertices((c.mesh[0], c.mesh[1].where("tid % 10 = 0")))[0])
query("fl_21_remove_edges", f"SELECT src, dst, {r('weight')} FROM net WHERE NOT (src % 10 = 0 AND dst = src + 1) AND NOT (dst % 10 = 0 AND src = dst + 1)")(lambda c: graphs.remove_edges(c.net, c.net.where("src % 10 = 0 and dst = src + 1")))
query("fl_25_aabb_aabb", "SELECT a.id AS a, b.id AS b FROM pts a JOIN ptb b ON abs(a.x - b.x) <= 0.5 AND abs(a.y - b.y) <= 0.5 AND abs(a.z - b.z) <= 0.5")(lambda c: _boxes(c.xyz, c.ptb))
SEG = "seg AS (SELECT a.id, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz FROM pts a JOIN ptb b USING (id))"
query("fl_31_point_line", f"WITH {SEG}, w AS (SELECT id, ax * 0 + ay AS px, ay * bz - az * by_ AS c1, az * bx - ax * bz AS c2, ax * by_ - ay * bx AS c3, bx, by_, bz FROM seg) SELECT id, {r('sqrt(c1 * c1 + c2 * c2 + c3 * c3) / sqrt(bx * bx + by_ * by_ + bz * bz) AS d')} FROM w")(lambda c: _segments(c).select("id", predicates.point_line(_abc("a"), [F.lit(0.0)] * 3, _abc("b")).alias("d")))
query("fl_33_point_aabb", f"SELECT id, {r('pow(greatest(-1 - x, 0, x - 1), 2) + pow(greatest(-0.5 - y, 0, y - 0.5), 2) + pow(greatest(0 - z, 0, z - 1), 2) AS d2')} FROM pts")(lambda c: c.xyz.select("id", predicates.point_aabb_squared([F.col(k) for k in XYZ], [F.lit(v) for v in (-1.0, -0.5, 0.0)], [F.lit(v) for v in (1.0, 0.5, 1.0)]).alias("d2")))
query("fl_28_sphere_aabb", "SELECT id FROM pts WHERE pow(greatest(-1 - x, 0, x - 1), 2) + pow(greatest(-0.5 - y, 0, y - 0.5), 2) + pow(greatest(0 - z, 0, z - 1), 2) <= 0.09")(lambda c: c.xyz.where(predicates.sphere_aabb([F.col(k) for k in XYZ], F.lit(0.3), [F.lit(v) for v in (-1.0, -0.5, 0.0)], [F.lit(v) for v in (1.0, 0.5, 1.0)])).select("id"))


def _abc(p: str) -> list[Column]:
    return [F.col(f"{p}{c}") for c in XYZ]


def _segments(c: Inputs) -> DataFrame:
    return c.xyz.select("id", *[F.col(k).alias(f"a{k}") for k in XYZ]).join(c.ptb.select("id", *[F.col(k).alias(f"b{k}") for k in XYZ]), "id")


def _boxes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of overlapping cubes, met on the cells of one table's centres."""
    near = spatial.radius_join(a, b, 0.9, keep_query=XYZ, keep_target=XYZ)
    box = lambda p, s: [F.col(f"{p}_{k}") + s * 0.25 for k in XYZ]
    return near.where(predicates.aabb_aabb(box("q", -1), box("q", 1), box("t", -1), box("t", 1))).select(F.col("q").alias("a"), F.col("t").alias("b"))


# Joins

query("jn_03_knn", f"WITH {KNN.format(q='ptb', t='pts')} SELECT q, t, {r('d2')} FROM k WHERE rn <= 5")(lambda c: spatial.knn_join(c.ptb, c.xyz, 5))
query("jn_04_radius", f"WITH {KNN.format(q='ptb', t='pts')} SELECT q, t, {r('d2')} FROM k WHERE d2 < 0.49")(lambda c: spatial.radius_join(c.ptb, c.xyz, 0.7))
query("jn_04_radius_capped", f"WITH {KNN.format(q='ptb', t='pts')} SELECT q, t, {r('d2')} FROM k WHERE d2 < 1 AND rn <= 3")(lambda c: spatial.radius_join(c.ptb, c.xyz, 1.0, max_nn=3))
query("jn_06_nearest", f"WITH {KNN.format(q='ptb', t='pts')} SELECT q, t, {r('d2')} FROM k WHERE rn = 1 AND d2 < 0.25")(lambda c: spatial.nearest(c.ptb, c.xyz, 0.5))
query("jn_03_knn_2d", f"WITH d AS (SELECT a.id AS q, b.id AS t, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM ptb a, pts b), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, t) AS rn FROM d) SELECT q, t, {r('d2')} FROM k WHERE rn <= 3")(lambda c: spatial.knn_join(c.ptb, c.xyz, 3, dims=("x", "y")))
FEAT = "f AS (SELECT id, e[1:16] AS a, e[17:32] AS b FROM raw), fd AS (SELECT p.id AS q, t.id AS t, list_sum(list_transform(range(1, 17), lambda k: (p.a[k] - t.b[k]) * (p.a[k] - t.b[k]))) AS d2 FROM f p, f t)"
query("jn_08_brute_force_nn", f"WITH {FEAT} SELECT q, arg_min(t, d2) AS t, {r('min(d2) AS d2')} FROM fd GROUP BY q")(lambda c: registration._nearest_features(_features(c, 1), _features(c, 17), 16))
query("jn_09_mutual_matching", f"WITH {FEAT}, x AS (SELECT q, arg_min(t, d2) AS t FROM fd GROUP BY q), y AS (SELECT t, arg_min(q, d2) AS q FROM fd GROUP BY t) SELECT x.q AS i, x.t AS j FROM x JOIN y ON x.q = y.q AND x.t = y.t")(lambda c: registration.match_features(_features(c, 1), _features(c, 17), 16))
query("jn_10_icp_correspondences", f"WITH {KNN.format(q='ptb', t='pts')}, c AS (SELECT * FROM k WHERE rn = 1 AND d2 < 1) SELECT {r('count(*) / (SELECT count(*) FROM ptb) AS fitness', 'sqrt(avg(d2)) AS inlier_rmse')} FROM c")(lambda c: _evaluated(c))
query("jn_12_voxel_voxel", "SELECT b.ix AS bx, b.iy AS by, b.iz AS bz, min({'x': a.ix, 'y': a.iy, 'z': a.iz}).x AS ax, min({'x': a.ix, 'y': a.iy, 'z': a.iz}).y AS ay, min({'x': a.ix, 'y': a.iy, 'z': a.iz}).z AS az FROM voxb b JOIN vox a ON abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 AND abs(a.iz - b.iz) <= 1 GROUP BY b.ix, b.iy, b.iz")(lambda c: voxels.collide_voxels(c.vox, c.voxb, 0.5, 0.5, (0, 0, 0), (0, 0, 0)))
query("jn_17_voxel_spheres", "WITH t AS (SELECT p.id AS pid, min({'x': ix, 'y': iy, 'z': iz}) AS v FROM ptb p JOIN vox ON pow(greatest(ix * 0.5 - x, 0, x - (ix + 1) * 0.5), 2) + pow(greatest(iy * 0.5 - y, 0, y - (iy + 1) * 0.5), 2) + pow(greatest(iz * 0.5 - z, 0, z - (iz + 1) * 0.5), 2) <= 0.16 GROUP BY p.id) SELECT pid, v.x AS ix, v.y AS iy, v.z AS iz FROM t")(lambda c: voxels.collide_spheres(c.vox, c.ptb.select(F.col("id").alias("pid"), *XYZ, F.lit(0.4).alias("radius")), 0.5, (0, 0, 0)))
query(
    "jn_13_voxel_lines",
    f"""WITH {SEG}, tt AS (SELECT id, ix, iy, iz, (ix * 0.5 - ax) / (bx - ax) AS x0, ((ix + 1) * 0.5 - ax) / (bx - ax) AS x1, (iy * 0.5 - ay) / (by_ - ay) AS y0, ((iy + 1) * 0.5 - ay) / (by_ - ay) AS y1, (iz * 0.5 - az) / (bz - az) AS z0, ((iz + 1) * 0.5 - az) / (bz - az) AS z1 FROM seg, vox),
    h AS (SELECT id, min({{'x': ix, 'y': iy, 'z': iz}}) AS v FROM tt WHERE greatest(0, least(x0, x1), least(y0, y1), least(z0, z1)) <= least(1, greatest(x0, x1), greatest(y0, y1), greatest(z0, z1)) GROUP BY id)
    SELECT id AS lid, v.x AS ix, v.y AS iy, v.z AS iz FROM h""",
)(lambda c: voxels.collide_lines(c.vox, _segments(c).select(F.col("id").alias("lid"), *[F.col(f"a{k}").alias(f"{k}0") for k in XYZ], *[F.col(f"b{k}").alias(f"{k}1") for k in XYZ]), 0.5, (0, 0, 0)))
query("jn_24_connect_nearest", f"WITH {KNN.format(q='pts', t='pts')}, n AS (SELECT q AS src, t AS dst, sqrt(d2) AS weight FROM k WHERE d2 < 0.36 AND rn <= 4 AND q <> t), o AS (SELECT * FROM n ANTI JOIN net USING (src, dst)) SELECT src, dst, {r('weight')} FROM net UNION ALL SELECT src, dst, {r('weight')} FROM o")(lambda c: graphs.connect_to_nearest_neighbors(c.net, c.nodes, 0.6, 3))
query("jn_25_add_node_and_connect", f"WITH n AS (SELECT id, sqrt(x * x + y * y + z * z) AS w FROM pts WHERE sqrt(x * x + y * y + z * z) < 1) SELECT src, dst, {r('weight')} FROM net UNION ALL SELECT 100000, id, {r('w')} FROM n UNION ALL SELECT id, 100000, {r('w')} FROM n")(lambda c: graphs.add_node_and_connect(c.net, c.nodes, 100000, (0, 0, 0), 1.0))
query("jn_26_weights_from_distance", f"SELECT src, dst, {r('sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS weight')} FROM net JOIN pts a ON a.id = src JOIN pts b ON b.id = dst")(lambda c: graphs.weights_from_distance(c.net, c.nodes))


def _features(c: Inputs, first: int) -> DataFrame:
    return c._raw.select(F.col("vec_id").alias("id"), F.transform(F.slice("embedding", first, 16), lambda x: x.cast("double") * 10).alias("feat"))


def _evaluated(c: Inputs) -> DataFrame:
    found = registration.evaluate(c.ptb, c.xyz, 1.0)
    return c.spark.createDataFrame([(found.fitness, found.inlier_rmse)], "fitness double, inlier_rmse double")


# Aggregates

query("ag_01_bounds", f"SELECT {r(*[f'{f}({k}) AS {f}_{k}' for f in ('min', 'max') for k in XYZ])} FROM pts")(lambda c: points.bounds(c.xyz))
query("ag_02_center", f"SELECT {r(*[f'avg({k}) AS {k}' for k in XYZ])} FROM pts")(lambda c: points.center(c.xyz))
query("ag_04_oriented_box_volume")(lambda c: c.spark.createDataFrame([(float(np.prod(points.oriented_bounding_box(c.xyz)[2])),)], "volume double"))
query(
    "ag_05_voxel_down_sample",
    f"WITH m AS (SELECT min(x) - 0.25 AS a, min(y) - 0.25 AS b_, min(z) - 0.25 AS c FROM pts) SELECT floor((x - a) / 0.5)::INT AS ix, floor((y - b_) / 0.5)::INT AS iy, floor((z - c) / 0.5)::INT AS iz, {r(*[f'avg({k}) AS {k}' for k in (*XYZ, *points.COLOR)])} FROM pts, m GROUP BY 1, 2, 3",
)(lambda c: points.voxel_down_sample(c.pts.select("id", *XYZ, *points.COLOR), 0.5))
query("ag_05_voxel_down_sample_large", f"WITH p AS (SELECT l_quantity * 0.8414709848078965 AS x, l_extendedprice * 0.0014142135623730951 AS y, l_discount * 0.7310585786300049 AS z FROM lineitem), m AS (SELECT min(x) - 2.5 AS a, min(y) - 2.5 AS b_, min(z) - 2.5 AS c FROM p) SELECT floor((x - a) / 5)::INT AS ix, floor((y - b_) / 5)::INT AS iy, floor((z - c) / 5)::INT AS iz, {r('avg(x) AS x', 'avg(y) AS y', 'avg(z) AS z')} FROM p, m GROUP BY 1, 2, 3")(lambda c: points.voxel_down_sample(table(c.spark, c.sf_dir, "lineitem").select(F.lit(0).alias("id"), (F.col("l_quantity") * 0.8414709848078965).alias("x"), (F.col("l_extendedprice") * 0.0014142135623730951).alias("y"), (F.col("l_discount") * 0.7310585786300049).alias("z")), 5.0))
query("ag_06_normals")(lambda c: points.estimate_normals(c.xyz, 12).select("id", *points.NORMAL))
query("ag_07_gaussian_filter", f"WITH {KNN.format(q='pts', t='pts')}, w AS (SELECT q, t, exp(-d2 / 0.5) AS w FROM k WHERE d2 < 0.64) SELECT q AS id, {r(*[f'sum({c} * w) / sum(w) AS {c}' for c in XYZ])} FROM w JOIN pts ON pts.id = t GROUP BY q")(lambda c: points.gaussian_filter(c.xyz, 0.8, 0.25, max_nn=10**6))
query("ag_09_model_resolution", f"WITH {KNN.format(q='pts', t='pts')} SELECT {r('sqrt(avg(d2)) AS resolution')} FROM k WHERE rn = 2")(lambda c: points.model_resolution(c.xyz))
query("ag_08_iss_keypoints")(lambda c: points.iss_keypoints(c.xyz, 1.2, 0.8).select("id"))
query("ag_14_kabsch_sums", f"SELECT count(*) AS n, {r('count(*) AS w', *[f'avg(p.{c}) AS q{c}' for c in XYZ], *[f'avg(t.{c}) AS t{c}' for c in XYZ], *[f'avg(p.{a} * t.{b}) AS {a}{b}' for a in XYZ for b in XYZ])} FROM ptb p JOIN pts t USING (id)")(lambda c: registration.sums_for_kabsch(_paired(c)).withColumn("w", F.col("w").cast("double")))
query("ag_18_point_to_point_rmse", f"SELECT {r('sqrt(avg((p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y) + (p.z - t.z) * (p.z - t.z))) AS rmse')} FROM ptb p JOIN pts t USING (id)")(lambda c: c.spark.createDataFrame([(registration.PointToPoint().rmse(_paired(c)),)], "rmse double"))
query("ag_19_point_to_plane_rmse", f"SELECT {r('sqrt(avg(pow((p.x - t.x) * nx + (p.y - t.y) * ny + (p.z - t.z) * nz, 2))) AS rmse')} FROM ptb p JOIN pts t USING (id)")(lambda c: c.spark.createDataFrame([(registration.PointToPlane().rmse(_paired(c, target=c.pts)),)], "rmse double"))
query("ag_26_voxel_bounds", f"SELECT {r(*[f'min({k}) * 0.5 + 1 AS min_{c}' for c, k in zip(XYZ, voxels.KEYS)], *[f'(max({k}) + 1) * 0.5 + 1 AS max_{c}' for c, k in zip(XYZ, voxels.KEYS)])} FROM vox")(lambda c: voxels.grid_bounds(c.vox, 0.5, (1, 1, 1)))
query("ag_26_voxel_center", f"SELECT {r(*[f'avg({k} + 0.5) * 0.5 AS {c}' for c, k in zip(XYZ, voxels.KEYS)])} FROM vox")(lambda c: voxels.grid_center(c.vox, 0.5, (0, 0, 0)))
query("ag_29_occupancy_insert")(lambda c: voxels.insert(None, c.xyz, (0.1, 0.2, 0.3), 0.5))
query("ag_32_set_free_area", "WITH c AS (SELECT ix, iy, iz FROM range(-2, 3) a(ix), range(-2, 3) b(iy), range(-2, 3) d(iz)) SELECT coalesce(vox.ix, c.ix)::INT AS ix, coalesce(vox.iy, c.iy)::INT AS iy, coalesce(vox.iz, c.iz)::INT AS iz, CASE WHEN c.ix IS NULL THEN 0.85 WHEN vox.ix IS NULL THEN -0.4 ELSE 0.45 END::DOUBLE AS prob_log FROM vox FULL JOIN c ON vox.ix = c.ix AND vox.iy = c.iy AND vox.iz = c.iz")(lambda c: voxels.set_free_area(c.vox.withColumn("prob_log", F.lit(0.85)), c.spark, (-1, -1, -1), (1.2, 1.2, 1.2), 0.5))
query("ag_33_vertex_normals", f"WITH {TRI_XYZ}, s AS (SELECT v AS id, sum(cx) AS a, sum(cy) AS b_, sum(cz) AS c FROM (SELECT unnest([v0, v1, v2]) AS v, cx, cy, cz FROM tn) GROUP BY v) SELECT id, {r(*[f'{k} / sqrt(a * a + b_ * b_ + c * c) AS {n}' for k, n in zip(('a', 'b_', 'c'), points.NORMAL)])} FROM s")(lambda c: meshes.vertex_normals(c.mesh))
EDGES = "ed AS (SELECT DISTINCT src, dst FROM (SELECT unnest([v0, v1, v1, v2, v0, v2]) AS src, unnest([v1, v0, v2, v1, v2, v0]) AS dst FROM tri))"
NBR = f"{TRI}, {EDGES}, nb AS (SELECT src AS id, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz FROM ed JOIN pts ON pts.id = dst GROUP BY src)"
query("ag_34_filter_sharpen", f"WITH {NBR} SELECT id, {r(*[f'{c} + 0.3 * ({c} * n - s{c}) AS {c}' for c in XYZ])} FROM pts JOIN nb USING (id)")(lambda c: meshes.filter_sharpen(c.mesh, 1, 0.3)[0])
query("ag_35_smooth_simple", f"WITH {NBR} SELECT id, {r(*[f'({c} + s{c}) / (1 + n) AS {c}' for c in XYZ])} FROM pts JOIN nb USING (id)")(lambda c: meshes.filter_smooth_simple(c.mesh, 1)[0])
LAP = f"{TRI}, {EDGES}, we AS (SELECT src, dst, 1 / (sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) + 1e-12) AS w FROM ed JOIN pts a ON a.id = src JOIN pts b ON b.id = dst), l1 AS (SELECT p.id, " + ", ".join(f"p.{c} + 0.5 * (sum(t.{c} * w) / sum(w) - p.{c}) AS {c}" for c in XYZ) + " FROM pts p JOIN we ON src = p.id JOIN pts t ON t.id = dst GROUP BY p.id, p.x, p.y, p.z)"
query("ag_36_smooth_laplacian", f"WITH {LAP} SELECT id, {r(*XYZ)} FROM l1")(lambda c: meshes.filter_smooth_laplacian(c.mesh, 1, 0.5)[0])
query("ag_37_smooth_taubin", f"WITH {LAP}, l2 AS (SELECT p.id, " + ", ".join(f"p.{c} - 0.53 * (sum(t.{c} * w) / sum(w) - p.{c}) AS {c}" for c in XYZ) + f" FROM l1 p JOIN we ON src = p.id JOIN l1 t ON t.id = dst GROUP BY p.id, p.x, p.y, p.z) SELECT id, {r(*XYZ)} FROM l2")(lambda c: meshes.filter_smooth_taubin(c.mesh, 1)[0])
query("ag_38_surface_area", f"WITH {TRI_XYZ} SELECT {r('sum(sqrt(cx * cx + cy * cy + cz * cz) / 2) AS area')} FROM tn")(lambda c: meshes.surface_area(c.mesh))
query("ag_39_max_line_length", f"SELECT {r('max(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))) AS length')} FROM net JOIN pts a ON a.id = src JOIN pts b ON b.id = dst")(lambda c: graphs.max_line_length(c.net, c.nodes))
query("ag_40_downsample", f"SELECT img, (v // 2)::INT AS v, (u // 2)::INT AS u, {r('avg(c0) AS c0')} FROM pix GROUP BY 1, 2, 3")(lambda c: images.downsample(c.pix, 100, 100))


def _conv(view: str, axis: str, taps) -> str:
    """A separable pass in SQL: each pixel reads its neighbours, the border repeated."""
    r_ = len(taps) // 2
    parts = " UNION ALL ".join(f"SELECT {i - r_} AS o, {w} AS w" for i, w in enumerate(taps))
    other = "u" if axis == "v" else "v"
    return f"SELECT p.img, p.v, p.u, sum(q.c0 * w) AS c0 FROM {view} p, ({parts}) taps JOIN {view} q ON q.img = p.img AND q.{other} = p.{other} AND q.{axis} = least(99, greatest(0, p.{axis} + o)) GROUP BY ALL"


for _name, _dx, _dy in (("gaussian3", images.GAUSSIAN3, images.GAUSSIAN3), ("gaussian5", images.GAUSSIAN5, images.GAUSSIAN5), ("sobel_dx", images.SOBEL_SLOPE, images.SOBEL_SMOOTH)):
    query(f"ag_42_{_name}", f"WITH p7 AS (SELECT img, v, u, c0 * 0.3141592653589793 AS c0 FROM pix), h AS ({_conv('p7', 'u', _dx)}), g AS ({_conv('h', 'v', _dy)}) SELECT img, v, u, {r('c0')} FROM g")(lambda c, dx=_dx, dy=_dy: images.filter_separable(images.linear_transform(c.pix, 0.3141592653589793), dx, dy, 100, 100))
query("ag_44_filter_horizontal", f"WITH h AS ({_conv('pix', 'u', (0.2, 0.3, 0.5))}) SELECT img, v, u, {r('c0')} FROM h")(lambda c: images.filter_horizontal(c.pix, (0.2, 0.3, 0.5), 100))
query("ag_45_bilateral", f"WITH s AS (SELECT p.img, p.v, p.u, q.c0, exp(-((q.u - p.u) * (q.u - p.u) + (q.v - p.v) * (q.v - p.v)) / 8.0) * exp(-(q.c0 - p.c0) * (q.c0 - p.c0) / 200.0) AS w FROM pix p JOIN pix q ON q.img = p.img AND q.u BETWEEN p.u - 2 AND p.u + 2 AND q.v BETWEEN p.v - 2 AND p.v + 2) SELECT img, v, u, {r('sum(w * c0) / sum(w) AS c0')} FROM s GROUP BY ALL")(lambda c: images.bilateral(c.pix, 100, 100, 2, 10.0, 2.0))


def _paired(c: Inputs, source: DataFrame | None = None, target: DataFrame | None = None) -> DataFrame:
    """Rows of equal id as pairs."""
    source, target = source or c.ptb, target or c.xyz
    names = [k for k in target.columns if k in (*XYZ, *points.NORMAL)]
    return source.select("id", *[F.col(k).alias(f"q_{k}") for k in XYZ]).join(target.select("id", *[F.col(k).alias(f"t_{k}") for k in names]), "id")


# Ranks

query("wn_03_segment_plane")(lambda c: points.segment_plane(c.xyz, 0.3, 50, seed=3)[1].select("id"))
query("wn_04_score_plane", f"WITH d AS (SELECT abs(0.6 * x + 0.8 * y - 0.1) AS d FROM pts) SELECT 0 AS model, count(*) AS inliers, {r('sum(d) AS error')} FROM d WHERE d < 0.4")(lambda c: points.score_planes(c.xyz, [np.array([0.6, 0.8, 0.0, -0.1])], 0.4))
query("wn_07_sample_points")(lambda c: meshes.sample_points_uniformly(c.mesh, 1000))
query("wn_08_running_area", f"WITH {TRI_XYZ} SELECT tid, {r('sum(sqrt(cx * cx + cy * cy + cz * cz) / 2) OVER (ORDER BY tid) AS upto', places=3)} FROM tn")(lambda c: ranking.with_running_sum(meshes.triangle_areas(c.mesh), "tid", "area", "upto").select("tid", F.round("upto", 3).alias("upto")))
query("wn_10_lexicographic_rank", "SELECT id, row_number() OVER (ORDER BY x, y, z) - 1 AS place FROM pts")(lambda c: ranking.with_row_number(c.xyz, "x", "place", "y", "z").select("id", "place"))
query("wn_11_csr_offsets", "WITH d AS (SELECT pts.id, count(net.src) AS degree FROM pts LEFT JOIN net ON net.src = pts.id GROUP BY pts.id) SELECT id, degree, (sum(degree) OVER (ORDER BY id) - degree)::BIGINT AS offset FROM d")(lambda c: graphs.csr_offsets(c.net, c.nodes))

# Sets

query("st_01_append", f"SELECT id, {r('x', 'y', 'z')} FROM pts UNION ALL SELECT id + (SELECT max(id) + 1 FROM pts), {r('x', 'y', 'z')} FROM ptb")(lambda c: points.concat(c.pts, c.ptb))
query("st_02_merge_voxels", "SELECT ix, iy, iz, avg(k)::DOUBLE AS r, avg(k)::DOUBLE AS g, avg(k)::DOUBLE AS b FROM (SELECT *, 0.25 AS k FROM vox UNION ALL SELECT *, 0.75 FROM voxb) GROUP BY ALL")(lambda c: voxels.merge(_colored(c.vox, 0.25), _colored(c.voxb, 0.75)))
query("st_03_add_voxels", "SELECT ix, iy, iz, min(k)::DOUBLE AS r FROM (SELECT *, 0.25 AS k FROM vox UNION ALL SELECT *, 0.75 FROM voxb) GROUP BY ALL")(lambda c: voxels.add(_colored(c.vox, 0.25).select(*voxels.KEYS, "r"), _colored(c.voxb, 0.75).select(*voxels.KEYS, "r")))
query("st_04_append_meshes", f"WITH {TRI} SELECT tid, v0, v1, v2 FROM tri UNION ALL SELECT tid + (SELECT max(tid) + 1 FROM tri), v0 + (SELECT max(id) + 1 FROM pts), v1 + (SELECT max(id) + 1 FROM pts), v2 + (SELECT max(id) + 1 FROM pts) FROM tri")(lambda c: meshes.concat(c.mesh, c.mesh)[1])
query("st_06_merge_scans", f"SELECT scan, step, {r('range')} FROM scan UNION ALL SELECT scan + (SELECT max(scan) + 1 FROM scan), step, {r('range')} FROM scan WHERE scan < 5")(lambda c: scans.merge(c.scan, c.scan.where("scan < 5")))
query("st_10_set_edge_weights", f"SELECT src, dst, {r('CASE WHEN src % 6 = 0 AND dst = src + 1 OR dst % 6 = 0 AND src = dst + 1 THEN 9.0 ELSE weight END AS weight')} FROM net")(lambda c: graphs.set_edge_weights(c.net, c.net.where("src % 6 = 0 and dst = src + 1"), 9.0))
query("st_13_edge_list", f"WITH {TRI}, {EDGES} SELECT src, dst FROM ed")(lambda c: meshes.edge_list(c.mesh[1]))
query("st_14_duplicated_vertices", f"WITH {TRI} SELECT tid, v0 % 50 AS v0, v1 % 50 AS v1, v2 % 50 AS v2 FROM tri")(lambda c: meshes.remove_duplicated_vertices((c.mesh[0].select("id", *[(F.col("id") % 50 * k).cast("double").alias(n) for k, n in ((1, "x"), (2, "y"), (3, "z"))]), c.mesh[1]))[1])
query("st_15_duplicated_triangles", f"WITH {TRI} SELECT tid, v0, v1, v2 FROM tri")(lambda c: meshes.remove_duplicated_triangles(c.mesh[1].unionByName(c.mesh[1].select((F.col("tid") + 10**6).alias("tid"), F.col("v1").alias("v0"), F.col("v2").alias("v1"), F.col("v0").alias("v2")))))


def _colored(df: DataFrame, v: float) -> DataFrame:
    return df.withColumns({c: F.lit(v) for c in points.COLOR})


# Graphs and registration

REACH = "far AS (SELECT 0::BIGINT AS id, 0.0::DOUBLE AS dist, 0 AS n UNION SELECT dst, min(dist + weight), any_value(n + 1) FROM far JOIN net ON src = id WHERE n < 60 GROUP BY dst, n)"
query("gr_02_add_edges", f"SELECT src, dst, {r('weight')} FROM net UNION ALL SELECT id, id + 100000, 4.0 FROM pts WHERE id < 10 UNION ALL SELECT id + 100000, id, 4.0 FROM pts WHERE id < 10")(lambda c: graphs.add_edges(c.net, c.xyz.where("id < 10").select(F.col("id").alias("src"), (F.col("id") + 100000).alias("dst")), 4.0))
query("gr_04_shortest_paths", f"WITH {REACH} SELECT id, {r('min(dist) AS dist')} FROM far GROUP BY id")(lambda c: graphs.shortest_paths(c.net, 0).select("id", "dist"))
query("gr_05_shortest_path")(lambda c: _path(c))
query("gr_06_dbscan")(lambda c: graphs.cluster_dbscan(c.xyz, 0.6, 4))
query("gr_07_icp")(lambda c: numbers(c.spark, registration.icp(points.transform(c.xyz, linalg.rigid(linalg.rotation_z(0.02), (0.02, 0.01, -0.01))), c.xyz, 0.5).transformation))
query("gr_10_icp_point_to_plane")(lambda c: numbers(c.spark, registration.icp(points.transform(c.xyz, linalg.rigid(linalg.rotation_z(0.02), (0.02, 0.01, -0.01))), c.pts, 0.5, estimation=registration.PointToPlane()).transformation))


def _path(c: Inputs) -> DataFrame:
    path, size = graphs.shortest_path(c.net, 0, 7)
    return c.spark.createDataFrame([(i, n, size) for i, n in enumerate(path)], "place int, id long, length double")


query("io_43_from_depth", f"SELECT img, v, u, {r('(u - 49.5) * c0 / 10 / 50 AS x', '(v - 49.5) * c0 / 10 / 50 AS y', 'c0 / 10 AS z')} FROM pix WHERE c0 > 0 AND c0 / 10 <= 4")(lambda c: images.back_project(c.pix, K, None, 10.0, 4.0))
query("io_46_from_scan", f"SELECT scan, step, {r('range', 'range * cos(-1.5 + step * 0.03) AS x', 'range * sin(-1.5 + step * 0.03) AS y', '0.0 AS z')} FROM scan WHERE range BETWEEN 1 AND 60")(lambda c: scans.to_points(c.scan, -1.5, 0.03, 1.0, 60.0))
query("io_48_from_disparity", f"SELECT img, v, u, {r('(u - 49.5) * (50 * 0.5 / c0) / 50 AS x', '(v - 49.5) * (50 * 0.5 / c0) / 50 AS y', '50 * 0.5 / c0 AS z')} FROM pix WHERE c0 > 0")(lambda c: images.from_disparity(c.pix, K, K, 0.5))
query("io_49_scan_from_points", f"WITH s AS (SELECT floor((z + 2) / 1.0)::INT AS scan, floor((atan2(y, x) + pi()) / 0.1)::INT AS step, sqrt(x * x + y * y) AS d FROM pts WHERE z >= -2 AND z < 2) SELECT scan, step, {r('min(d) AS range')} FROM s WHERE step BETWEEN 0 AND 62 GROUP BY 1, 2")(lambda c: scans.from_points(c.xyz, 0.1, -2.0, 2.0, 4))
query("io_51_dense_grid", "SELECT (i // 12)::INT AS ix, (i // 3 % 4)::INT AS iy, (i % 3)::INT AS iz FROM range(24) t(i)")(lambda c: voxels.dense(c.spark, 0.5, (1.0, 2.0, 1.5)))
query("io_53_voxels_from_points", f"SELECT floor(x / 0.5)::INT AS ix, floor(y / 0.5)::INT AS iy, floor(z / 0.5)::INT AS iz, {r('avg(r) AS r', 'avg(g) AS g', 'avg(b) AS b')} FROM pts GROUP BY 1, 2, 3")(lambda c: voxels.from_points(c.pts, 0.5, (0, 0, 0)))
query("io_60_lines_of_mesh", f"WITH {TRI}, {EDGES} SELECT src, dst FROM ed WHERE src < dst")(lambda c: meshes.line_set(c.mesh)[1])
query("io_84_sun_depth", "WITH w AS (SELECT img, v, u, trunc(c0 * 100)::INT AS d FROM pix) SELECT img, v, u, (((d >> 3) | (d << 13)) & 65535)::INT AS c0 FROM w")(lambda c: c.pix.select(*images.KEY, images.sun_depth((F.col("c0") * 100).cast("int")).alias("c0")))
query("io_85_nyu_depth", f"WITH w AS (SELECT img, v, u, trunc(c0 * 100)::INT AS d FROM pix), s AS (SELECT img, v, u, 351.3 / (1092.5 - (((d >> 8) & 255) | ((d & 255) << 8))) AS d FROM w) SELECT img, v, u, {r('CASE WHEN d <= 0 OR d > 10 THEN 0.0 ELSE d END AS c0')} FROM s")(lambda c: c.pix.select(*images.KEY, images.nyu_depth((F.col("c0") * 100).cast("int")).alias("c0")))


# Volumes, features, lattices

CELLS = "cells AS (SELECT DISTINCT unnest(range(floor((x - 0.6) / 0.5)::INT, floor((x + 0.6) / 0.5)::INT + 1))::INT AS ix, iy, iz FROM (SELECT x, unnest(range(floor((y - 0.6) / 0.5)::INT, floor((y + 0.6) / 0.5)::INT + 1))::INT AS iy, iz FROM (SELECT x, y, unnest(range(floor((z - 0.6) / 0.5)::INT, floor((z + 0.6) / 0.5)::INT + 1))::INT AS iz FROM pts)))"
TSDF = CELLS + """, mid AS (SELECT *, (ix + 0.5) * 0.5 AS x, (iy + 0.5) * 0.5 AS y, (iz + 0.5) * 0.5 + 4.0 AS d FROM cells), mid_uv AS (SELECT *, floor(x * 50 / d + 49.5)::INT AS u, floor(y * 50 / d + 49.5)::INT AS v FROM mid WHERE d > 0),
img0 AS (SELECT v, u, c0 / 10 AS depth FROM pix WHERE c0 > 0), vol AS (SELECT ix, iy, iz, avg(least(1.0, (depth - d) / 0.6)) AS tsdf, count(*)::DOUBLE AS weight FROM mid_uv JOIN img0 USING (v, u) WHERE depth - d > -0.6 GROUP BY ix, iy, iz)"""


def _volume(c: Inputs, before: DataFrame | None = None) -> DataFrame:
    cells = volumes.open_cells(c.xyz, 0.5, 0.6)
    pixels = c.pix.select("img", "v", "u", (F.col("c0") / 10).alias("depth"))
    return volumes.integrate(before, cells, pixels, K, CAM, 0.5, 0.6)


query("ag_67_open_cells", f"WITH {CELLS} SELECT ix, iy, iz FROM cells")(lambda c: volumes.open_cells(c.xyz, 0.5, 0.6))
query("ag_50_tsdf_integrate", f"WITH {TSDF} SELECT ix, iy, iz, {r('tsdf', 'weight')} FROM vol")(_volume)
query("ag_56_tsdf_integrate_again", f"WITH {TSDF} SELECT ix, iy, iz, {r('tsdf', 'weight * 2 AS weight')} FROM vol")(lambda c: _volume(c, _volume(c)))
query("ag_54_tsdf_voxel_points", f"WITH {TSDF} SELECT ix, iy, iz, {r('(ix + 0.5) * 0.5 AS x', '(iy + 0.5) * 0.5 AS y', '(iz + 0.5) * 0.5 AS z', '(tsdf + 1) / 2 AS r', '(tsdf + 1) / 2 AS g', '(tsdf + 1) / 2 AS b')} FROM vol WHERE tsdf < 0.98 AND tsdf >= -0.98")(lambda c: volumes.voxel_points(_volume(c), 0.5))
query(
    "ag_52_tsdf_surface_points",
    f"""WITH {TSDF}, near AS (SELECT * FROM vol WHERE tsdf < 0.98 AND tsdf >= -0.98),
    step AS (SELECT a.ix, a.iy, a.iz, axis::INT AS axis, abs(a.tsdf) / (abs(a.tsdf) + abs(b.tsdf)) * 0.5 AS s FROM near a, range(3) t(axis) JOIN near b ON b.ix = a.ix + (axis = 0)::INT AND b.iy = a.iy + (axis = 1)::INT AND b.iz = a.iz + (axis = 2)::INT WHERE a.tsdf * b.tsdf < 0)
    SELECT ix, iy, iz, axis, {r('(ix + 0.5) * 0.5 + CASE WHEN axis = 0 THEN s ELSE 0 END AS x', '(iy + 0.5) * 0.5 + CASE WHEN axis = 1 THEN s ELSE 0 END AS y', '(iz + 0.5) * 0.5 + CASE WHEN axis = 2 THEN s ELSE 0 END AS z')} FROM step""",
)(lambda c: volumes.surface_points(_volume(c), 0.5))
#: Cells of a cube over the voxels' bounds, and the nearest voxel's distance by trying all.
FIELD = "lim AS (SELECT min(ix) AS a, min(iy) AS b, min(iz) AS c, greatest(max(ix) - min(ix), max(iy) - min(iy), max(iz) - min(iz)) + 1 AS n FROM {cells}), cube AS (SELECT (a + i)::INT AS ix, (b + j)::INT AS iy, (c + k)::INT AS iz FROM lim, range(64) t(i), range(64) u(j), range(64) w(k) WHERE i < n AND j < n AND k < n), field AS (SELECT cube.ix, cube.iy, cube.iz, min((cube.ix - s.ix) * (cube.ix - s.ix) + (cube.iy - s.iy) * (cube.iy - s.iy) + (cube.iz - s.iz) * (cube.iz - s.iz)) AS d2 FROM cube, {cells} s GROUP BY ALL)"


def _field(cells: DataFrame) -> DataFrame:
    """The distance transform of voxels over a cube from their least keys on."""
    low = cells.agg(*[f(k).alias(f"{n}{k}") for k in voxels.KEYS for n, f in (("lo", F.min), ("hi", F.max))]).first()
    n = max(low[f"hi{k}"] - low[f"lo{k}"] for k in voxels.KEYS) + 1
    found = volumes.distance_transform(cells.select(*[(F.col(k) - low[f"lo{k}"]).alias(k) for k in voxels.KEYS]), n)
    return found.select(*[(F.col(a + k[1]) + low[f"lo{k}"]).alias(a + k[1]) for k in voxels.KEYS for a in "in"], "distance")


query("gr_23_distance_transform", f"WITH {FIELD.format(cells='vox')} SELECT ix, iy, iz, {r('sqrt(d2) AS distance')} FROM field")(lambda c: _field(c.vox).select(*voxels.KEYS, "distance"))
query("gr_42_colour_axis", f"WITH {FIELD.format(cells='voxb')} SELECT ix, {r('sum(sqrt(d2)) AS total', places=3)} FROM field GROUP BY ix")(lambda c: _field(c.voxb).groupBy("ix").agg(F.round(F.sum("distance"), 3).alias("total")))
query("ag_12_fpfh")(lambda c: features.fpfh(c.pts, 12).select("id", F.transform("feat", lambda x: F.round(x, 6)).alias("feat")))
query(
    "io_66_lattice_edges",
    f"WITH n AS (SELECT (x * 25 + y * 5 + z) AS id, x, y, z FROM range(5) a(x), range(5) b(y), range(5) c(z)) SELECT a.id AS src, b.id AS dst, {r('sqrt((a.x - b.x) * (a.x - b.x) * 0.16 + (a.y - b.y) * (a.y - b.y) * 0.16 + (a.z - b.z) * (a.z - b.z) * 0.36) AS weight')} FROM n a JOIN n b ON a.id <> b.id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1",
)(lambda c: planning.lattice(c.spark, (-1, -1, -1), (1, 1, 2), 5)[1])
query("io_62_box_lines", "SELECT b AS src, b + (1 << i) AS dst FROM range(8) t(b), range(3) s(i) WHERE (b >> i) & 1 = 0")(lambda c: planning.box_line_set(c.spark, (0, 0, 0), (1, 1, 1))[1].select("src", "dst"))
query("io_59_correspondence_lines", "SELECT id AS src, id + (SELECT max(id) + 1 FROM pts) AS dst FROM ptb")(lambda c: planning.correspondence_lines(c.xyz, c.ptb, c.ptb.select(F.col("id").alias("i"), F.col("id").alias("j")))[1])
query("io_87_primitive_voxels", "SELECT x::INT AS ix, y::INT AS iy, z::INT AS iz FROM range(-6, 6) a(x), range(-6, 6) b(y), range(-6, 6) c(z) WHERE pow(x * 0.25 + 0.125, 2) + pow(y * 0.25 + 0.125, 2) + pow(z * 0.25 + 0.125, 2) <= 1")(lambda c: planning.primitive_voxels(c.spark, "sphere", (1.0,), np.eye(4), 0.25))
OCC = "occ AS (SELECT ix, iy, iz, CASE WHEN (ix + iy + iz) % 3 = 0 THEN -0.4 ELSE 0.85 END::DOUBLE AS p FROM vox)"
query("io_47_points_of_occupancy", f"WITH {OCC} SELECT ix, iy, iz, {r('p AS prob_log', '(ix + 0.5) * 0.5 AS x', '(iy + 0.5) * 0.5 AS y', '(iz + 0.5) * 0.5 AS z')} FROM occ WHERE p > 0")(lambda c: voxels.points_of(_occupancy(c), 0.5))
query("io_56_voxels_of_occupancy", f"WITH {OCC} SELECT ix, iy, iz, 0.0::DOUBLE AS r, 0.0::DOUBLE AS g, 0.0::DOUBLE AS b FROM occ WHERE p > 0")(lambda c: voxels.voxels_of(_occupancy(c)))
query("io_57_occupancy_of_voxels", "SELECT ix, iy, iz, 0.85::DOUBLE AS prob_log FROM vox")(lambda c: voxels.occupancy_of(c.vox))
query("pr_65_tracked_bounds", f"SELECT {r(*[f'min({k}) * 0.5 AS min_{c}' for c, k in zip(XYZ, voxels.KEYS)], *[f'(max({k}) + 1) * 0.5 AS max_{c}' for c, k in zip(XYZ, voxels.KEYS)])} FROM vox")(lambda c: voxels.tracked_bounds(_occupancy(c), 0.5))
query("pr_21_paint_voxels", "SELECT vox.ix, vox.iy, vox.iz, CASE WHEN w.ix IS NULL THEN 0.25 ELSE 1.0 END::DOUBLE AS r FROM vox LEFT JOIN voxb w USING (ix, iy, iz)")(lambda c: voxels.paint(_colored(c.vox, 0.25), c.voxb, (1, 1, 1)).select(*voxels.KEYS, "r"))
query("jn_15_occupancy_voxels", f"WITH {OCC}, t AS (SELECT b.ix AS bx, b.iy AS \"by\", b.iz AS bz, min({{'x': a.ix, 'y': a.iy, 'z': a.iz}}) AS v FROM voxb b JOIN occ a ON a.p > 0 AND abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 AND abs(a.iz - b.iz) <= 1 GROUP BY b.ix, b.iy, b.iz) SELECT t.bx, t.\"by\", t.bz, v.x AS ax, v.y AS ay, v.z AS az FROM t")(lambda c: voxels.collide_occupied(_occupancy(c), c.voxb, 0.5, 0.5, (0, 0, 0), (0, 0, 0)))
query("jn_17_voxel_capsules")(lambda c: voxels.collide_capsules(c.vox, _segments(c).select(F.col("id").alias("pid"), *[F.col(f"a{k}").alias(f"{k}0") for k in XYZ], *[F.col(f"b{k}").alias(f"{k}1") for k in XYZ], F.lit(0.2).alias("radius")), 0.5, (0, 0, 0)))
query("jn_23_self_intersections")(lambda c: meshes.self_intersecting_triangles(c.mesh, 1.0))
query("io_55_voxelized_mesh")(lambda c: meshes.voxelized(c.mesh, 0.5))
query("gr_12_colored_icp")(lambda c: numbers(c.spark, alignment.colored_icp(points.transform(c.pts.select("id", *XYZ, *points.COLOR), linalg.rigid(None, (0.02, 0.01, -0.01))), c.pts, 0.5, iterations=5).transformation))
query("gr_14_generalized_icp")(lambda c: numbers(c.spark, alignment.generalized_icp(points.transform(c.pts.select("id", *XYZ, *points.NORMAL), linalg.rigid(None, (0.02, 0.01, -0.01))), c.pts, 0.5, iterations=5).transformation))
query("gr_16_fast_global")(lambda c: numbers(c.spark, alignment.fast_global(points.transform(c.xyz, M), c.xyz, _features(c, 1), _features(c, 1), 16, iterations=24).transformation))
query("gr_25_find_path")(lambda c: _planned(c))


def _occupancy(c: Inputs) -> DataFrame:
    # (the sum's sign doesn't matter: only multiples of three count)
    return c.vox.withColumn("prob_log", F.when((F.col("ix") + F.col("iy") + F.col("iz")) % 3 == 0, F.lit(-0.4)).otherwise(F.lit(0.85)))


def _planned(c: Inputs) -> DataFrame:
    nodes, edges = planning.lattice(c.spark, (-1, -1, -1), (1, 1, 1), 5)
    path, length = planning.find_path(nodes, edges, (-0.9, -0.9, -0.9), (0.5, 0.5, 0.5), 0.5, [(c.vox.where("ix = 0 and iy = 0"), 0.5, (0, 0, 0))])
    return c.spark.createDataFrame([(i, *map(float, p), float(length)) for i, p in enumerate(path)], "place int, x double, y double, z double, length double")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points thinned to one for each cell, with normals."""
    cloud = points.voxel_down_sample(Inputs(spark, sf_dir).pts.select("id", *XYZ), 0.5)
    numbered = cloud.withColumn("id", F.xxhash64("ix", "iy", "iz")).select("id", *XYZ)
    return points.estimate_normals(numbered, 10)


def _register_more() -> None:
    from . import entry_queries, fusion_queries, more_queries, more_sql, shape_queries  # noqa: F401  (they register on import)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _register_more()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _register_more()
    return dict(ORACLES)
