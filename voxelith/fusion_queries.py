"""Queries over volumes looked into, fused frames, streams, stereo, filtered registration and more sums; `queries` registers them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import more_queries as m
from . import queries as q
from .functions import linalg
from .operators import alignment, features, fusion, images, lattice, points, registration, stereo, volumes
from .operators.voxels import KEYS
from .plans.lineage import cut
from .plans.spatial import XYZ
from .queries import CAM, TSDF, Inputs, K, _paired, _volume, numbers, query, r
from .streaming import stateful

# Volumes


def _around(spots: str, keep: str) -> str:
    """SQL of the eight cells around spots (x, y, z and the columns `keep`) and their weights."""
    return f"""SELECT {keep}, fx + a AS ix, fy + b AS iy, fz + c AS iz, (CASE a WHEN 1 THEN gx - fx ELSE 1 - (gx - fx) END) * (CASE b WHEN 1 THEN gy - fy ELSE 1 - (gy - fy) END) * (CASE c WHEN 1 THEN gz - fz ELSE 1 - (gz - fz) END) AS w
    FROM (SELECT *, floor(gx)::INT AS fx, floor(gy)::INT AS fy, floor(gz)::INT AS fz FROM (SELECT {keep}, x / 0.5 - 0.5 AS gx, y / 0.5 - 0.5 AS gy, z / 0.5 - 0.5 AS gz FROM {spots})), range(2) p(a), range(2) q(b), range(2) s(c)"""


def _sides(spots: str, keep: str, gap: float) -> str:
    """SQL of spots moved `gap` cells to both sides on each axis."""
    return f"SELECT {keep}, axis, side, x + CASE axis WHEN 0 THEN side * {gap * 0.5} ELSE 0 END AS x, y + CASE axis WHEN 1 THEN side * {gap * 0.5} ELSE 0 END AS y, z + CASE axis WHEN 2 THEN side * {gap * 0.5} ELSE 0 END AS z FROM {spots}, range(3) t(axis), (VALUES (-1.0), (1.0)) u(side)"


GRADIENT = ", ".join(f"sum(CASE axis WHEN {i} THEN side * w * tsdf ELSE 0 END) AS {n}" for i, n in enumerate(points.NORMAL))
UNIT = [f"{n} / sqrt(nx * nx + ny * ny + nz * nz) AS {n}" for n in points.NORMAL]
query("ag_63_values", f"WITH {TSDF}, spots AS (SELECT id, x, y, z FROM ptb), near AS ({_around('spots', 'id')}), found AS (SELECT id, sum(w * tsdf) AS value FROM near JOIN vol USING (ix, iy, iz) GROUP BY id) SELECT id, {r('coalesce(value, 0) AS value')} FROM spots LEFT JOIN found USING (id)")(lambda c: fusion.values_at(c.ptb, _volume(c), 0.5))
query("ag_63_normals", f"WITH {TSDF}, spots AS (SELECT id, x, y, z FROM ptb), beside AS ({_sides('spots', 'id', 0.99)}), near AS ({_around('beside', 'id, axis, side')}), found AS (SELECT id, {GRADIENT} FROM near JOIN vol USING (ix, iy, iz) GROUP BY id) SELECT id, {r(*UNIT)} FROM spots LEFT JOIN found USING (id) WHERE nx * nx + ny * ny + nz * nz > 1e-18")(lambda c: fusion.normals_at(c.ptb, _volume(c), 0.5).where("nx is not null"))
RAYS = f"""box AS (SELECT min(ix) * 0.5 AS ax, (max(ix) + 1) * 0.5 AS bx, min(iy) * 0.5 AS ay, (max(iy) + 1) * 0.5 AS by_, min(iz) * 0.5 AS az, (max(iz) + 1) * 0.5 AS bz FROM vol),
    ray0 AS (SELECT v, u, (u - 49.5) / 50 AS rx, (v - 49.5) / 50 AS ry, 1.0 AS rz, sqrt((u - 49.5) / 50 * ((u - 49.5) / 50) + (v - 49.5) / 50 * ((v - 49.5) / 50) + 1) AS n FROM range(100) a(v), range(100) b(u)), ray1 AS (SELECT v, u, rx / n AS rx, ry / n AS ry, rz / n AS rz FROM ray0),
    ray AS (SELECT *, greatest(least(ax / rx, bx / rx), least(ay / ry, by_ / ry), least((az + 4) / rz, (bz + 4) / rz), 0) + 0.5 AS a, least(greatest(ax / rx, bx / rx), greatest(ay / ry, by_ / ry), greatest((az + 4) / rz, (bz + 4) / rz)) AS b FROM ray1, box),
    sample AS (SELECT *, unnest(range(0, floor((b - a) / 0.3)::INT + 1)) AS i FROM ray WHERE b > a), cell AS (SELECT v, u, i, floor((rx * (a + i * 0.3)) / 0.5)::INT AS ix, floor((ry * (a + i * 0.3)) / 0.5)::INT AS iy, floor((-4 + rz * (a + i * 0.3)) / 0.5)::INT AS iz FROM sample),
    seen AS (SELECT v, u, i, tsdf, lag(i) OVER w AS i0, lag(tsdf) OVER w AS t0 FROM cell JOIN vol USING (ix, iy, iz) WINDOW w AS (PARTITION BY v, u ORDER BY i)), first AS (SELECT v, u, arg_min({{'i': i, 't0': t0, 't1': tsdf}}, i) AS c FROM seen WHERE i0 = i - 1 AND t0 * tsdf < 0 GROUP BY v, u),
    hit AS (SELECT v, u, rx * t AS x, ry * t AS y, -4 + rz * t AS z FROM (SELECT v, u, rx, ry, rz, a + (c.i - 1) * 0.3 - 0.3 * c.t0 / (c.t1 - c.t0) AS t FROM first JOIN ray USING (v, u) WHERE c.t0 > 0)),
    beside AS ({_sides('hit', 'v, u', 1.0)}), near AS ({_around('beside', 'v, u, axis, side')}), slope AS (SELECT v, u, {GRADIENT} FROM near JOIN vol USING (ix, iy, iz) GROUP BY v, u)"""
query("jn_27_raycast", f"WITH {TSDF}, {RAYS} SELECT v::INT AS v, u::INT AS u, {r(*XYZ, *UNIT)} FROM hit JOIN slope USING (v, u) WHERE nx * nx + ny * ny + nz * nz > 1e-18")(lambda c: fusion.raycast(_volume(c), K, CAM, 100, 100, 0.5, 0.6))


# Fused frames: gentle waves, a little deeper from frame to frame, roughened by the data


def _depths(c: Inputs) -> DataFrame:
    wave = 2.0 + 0.2 * F.sin(F.col("u") / 15.0) + 0.15 * F.cos(F.col("v") / 20.0) + 0.01 * F.col("img")
    return c.pix.withColumn("c0", wave + F.least("c0", F.lit(50.0)) / 5000.0)


def _fusion() -> fusion.Fusion:
    return fusion.Fusion(K, 100, 100, 0.1, 0.2, levels=2, iterations=(1, 1), diameter=1, sigma_depth=0.1, sigma_space=2.0)


def _fused(c: Inputs) -> tuple[fusion.Fusion, list]:
    """All frames in order; a driver's loop, as each frame's pose depends on those before."""
    depths, state = _depths(c), _fusion()
    frames = sorted(x["img"] for x in depths.select("img").distinct().collect())  # one number a frame
    return state, [(i, state.process(depths.where(F.col("img") == i))) for i in frames]


def _poses(c: Inputs) -> DataFrame:
    return c.spark.createDataFrame([(i, a, b, float(p[a, b])) for i, p in _fused(c)[1] for a in range(3) for b in range(4)], "frame long, i int, j int, value double")


query("sm_05_process_frames")(_poses)
DEPTHS = "dep AS (SELECT img, v, u, 2.0 + 0.2 * sin(u / 15.0) + 0.15 * cos(v / 20.0) + 0.01 * img + least(c0, 50.0) / 5000.0 AS c0 FROM pix), soft AS (SELECT p.img, p.v, p.u, sum(q.c0 * exp(-((q.u - p.u) * (q.u - p.u) + (q.v - p.v) * (q.v - p.v)) / 8.0) * exp(-(q.c0 - p.c0) * (q.c0 - p.c0) / 0.02)) / sum(exp(-((q.u - p.u) * (q.u - p.u) + (q.v - p.v) * (q.v - p.v)) / 8.0) * exp(-(q.c0 - p.c0) * (q.c0 - p.c0) / 0.02)) AS c0 FROM dep p JOIN dep q ON q.img = p.img AND q.u BETWEEN p.u - 1 AND p.u + 1 AND q.v BETWEEN p.v - 1 AND p.v + 1 GROUP BY ALL)"
query("sm_06_surface", f"WITH {DEPTHS} SELECT img, v, u, {r('c0')} FROM soft")(lambda c: images.bilateral(_depths(c).where("c0 > 0"), 100, 100, 1, 0.1, 2.0))


def _pose_of_second(c: Inputs) -> DataFrame:
    """The motion to the first frame moved a centimetre back."""
    first = _depths(c).where("img = 0")
    state = _fusion()
    state.process(first)
    clouds = state.surface(first.withColumn("c0", F.col("c0") + 0.01))[1]
    return numbers(c.spark, state.aligned(np.eye(4), [cut(x) for x in clouds]))


query("sm_07_pose")(_pose_of_second)


def _model(c: Inputs) -> DataFrame:
    state, _ = _fused(c)
    return volumes.surface_points(state.volume, state.size)


query("sm_08_extract")(_model)

# Streams: the file as a stream, and what it had settled to at its end


def _stream(c: Inputs) -> DataFrame:
    schema = q.table(c.spark, c.sf_dir, "events").schema
    return c.spark.readStream.schema(schema).parquet(f"{c.sf_dir}/events.parque[t]")  # a pattern: the file or folder itself is no base of partitions


# made when a query runs: columns need a session, and registering has none
_cell = lambda: [(F.col("event_id") % 7).cast("int").alias("ix"), (F.col("event_id") % 5).cast("int").alias("iy"), F.expr("event_id div 1000 % 3").cast("int").alias("iz")]
CELL = "(event_id % 7)::INT AS ix, (event_id % 5)::INT AS iy, (event_id // 1000 % 3)::INT AS iz"
query("sm_09_occupancy_stream", f"WITH e AS (SELECT {CELL}, value > 20 AS hit FROM events) SELECT ix, iy, iz, {r('least(3.5, greatest(-2.0, -0.4 * count(*) FILTER (NOT hit)) + 0.85 * count(*) FILTER (hit))::DOUBLE AS prob_log')} FROM e GROUP BY ALL")(lambda c: stateful.settled(stateful.occupancy(_stream(c).select(*_cell(), (F.col("value") > 20).alias("occupied"))), *KEYS))
query("sm_10_distance_stream", f"WITH e AS (SELECT {CELL}, least(1.0, value / 50 - 0.5) AS t FROM events) SELECT ix, iy, iz, {r('avg(t) AS tsdf', 'count(*)::DOUBLE AS weight')} FROM e GROUP BY ALL")(lambda c: stateful.settled(stateful.distances(_stream(c).select(*_cell(), F.least(F.lit(1.0), F.col("value") / 50 - 0.5).alias("tsdf"))), *KEYS))
query("sm_11_windows", f"SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP))::BIGINT AS start, event_type, count(*) AS n, {r('avg(value) AS mean')} FROM events GROUP BY ALL")(lambda c: stateful.settled(stateful.windowed(_stream(c).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value", "1 hour", "10 days", "event_type"), "window", "event_type").select(F.unix_timestamp("window.start").alias("start"), "event_type", "n", "mean"))

# Depth images and sums


def _scaled(c: Inputs) -> DataFrame:
    frames = m._frames(c)
    return alignment.normalize_intensity(frames, frames, m._pixels(c))[0].select("img", "v", "u", "intensity")


query("ag_49_normalized", f"WITH {m.PIXEL_PAIRS}, t AS (SELECT avg(b.i) AS mean FROM best) SELECT img, v, u, {r('i * 0.5 / mean AS intensity')} FROM s, t")(_scaled)


def _weighted(c: Inputs) -> DataFrame:
    pairs = _paired(c, target=c.pts)
    _, b, r2, scale = alignment.weighted_jtj(pairs, registration.plane_rows(), 1.0)
    return c.spark.createDataFrame([tuple(map(float, (*b, r2, scale)))], ", ".join([*[f"b{i} double" for i in range(6)], "r2 double", "scale double"]))


ROWS = "g AS (SELECT p.x AS px, p.y AS py, p.z AS pz, t.nx, t.ny, t.nz, (p.x - t.x) * t.nx + (p.y - t.y) * t.ny + (p.z - t.z) * t.nz AS e FROM ptb p JOIN pts t USING (id)), w0 AS (SELECT sum(e * e * 6 / (5 + e * e)) AS scale FROM g), w1 AS (SELECT *, 6 / (5 + e * e / scale) AS w FROM g, w0)"
query("ag_17_weighted_sums", f"WITH {ROWS} SELECT {r('sum(w * e * (py * nz - pz * ny)) AS b0', 'sum(w * e * (pz * nx - px * nz)) AS b1', 'sum(w * e * (px * ny - py * nx)) AS b2', 'sum(w * e * nx) AS b3', 'sum(w * e * ny) AS b4', 'sum(w * e * nz) AS b5', 'sum(w * e * e) AS r2', 'any_value(scale) AS scale')} FROM w1")(_weighted)


def _pair(c: Inputs) -> tuple[DataFrame, DataFrame]:
    """The first image of gentle waves, and it seen a little from the side."""
    own = _depths(c).where("img = 0").select(F.col("v").cast("int").alias("v"), F.col("u").cast("int").alias("u"), (0.5 + 0.3 * F.sin(F.col("u") / 9.0) * F.cos(F.col("v") / 11.0)).alias("intensity"), F.col("c0").alias("depth"))
    return own, own.withColumn("u", F.col("u") - 1).where("u >= 0")


query("gr_30_weighted_odometry")(lambda c: numbers(c.spark, alignment.weighted_rgbd_odometry(*_pair(c), K, 100, 100, iterations=(2, 1))[1]))
query("gr_40_weighted_step")(lambda c: numbers(c.spark, alignment.weighted_rgbd_odometry(*_pair(c), K, 100, 100, iterations=(1,), previous=(0.0,) * 6, inverse_sigma=(1.0,) * 6)[2][None, :]))

# Features, lattices, stereo

query("ag_13_shot", "WITH n AS (SELECT a.id, count(b.id) AS n FROM pts a LEFT JOIN pts b ON b.id <> a.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < 1.44 GROUP BY a.id) SELECT id, 352::INT AS dims, CASE WHEN n >= 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS size FROM n")(lambda c: features.shot(c.pts, 1.2, 10**6).select("id", F.size("feat").alias("dims"), F.sqrt(F.aggregate("feat", F.lit(0.0), lambda a, x: a + x * x)).alias("size")))
query("ag_13_shot_features")(lambda c: features.shot(c.pts, 1.2).select("id", F.transform("feat", lambda x: F.round(x, 6)).alias("feat")))
_s = [4 * float(np.sqrt(1 / 6 / (i * (i + 1)))) / 0.7 for i in (1, 2, 3)]
query("pr_59_simplices", f"SELECT id, {r(f'{_s[0]} * x + {_s[1]} * y + {_s[2]} * z AS a', f'-{_s[0]} * x + {_s[1]} * y + {_s[2]} * z AS b', f'-2 * {_s[1]} * y + {_s[2]} * z AS c', '1.0::DOUBLE AS w')} FROM pts")(lambda c: lattice.splatted(c.xyz, 0.7).groupBy("id").agg(*[F.sum(F.col("w") * F.col(f"k{i}")).alias(n) for i, n in enumerate("abc")], F.sum("w").alias("w")))
query("ag_23_lattice", f"SELECT {r('count(*)::DOUBLE AS w', 'sum(x) AS wx', 'sum(x * x + y * y + z * z) AS wv')} FROM pts")(lambda c: lattice.lattice_of(c.xyz, 0.7).agg(F.sum("w").alias("w"), F.sum("wx").alias("wx"), F.sum("wv").alias("wv")))
query("ag_24_sliced")(lambda c: lattice.sliced(c.ptb, lattice.lattice_of(c.xyz, 0.7), 0.7).select("id", "tx", "ty", "tz", "weight", "m2"))


def _matched(c: Inputs) -> DataFrame:
    """Rows of equal id as model and filtered target."""
    t = c.pts.select("id", *[F.col(k).alias(f"t{k}") for k in XYZ])
    both = c.ptb.join(t, "id").withColumn("weight", 1 / (1.0 + F.col("id") % 3))
    return both.withColumn("m2", sum((F.col(f"t{k}") * F.col(f"t{k}") for k in XYZ), F.lit(0.1)))


MATCHED = "g AS (SELECT p.x, p.y, p.z, t.x AS tx, t.y AS ty, t.z AS tz, 1 / (1.0 + id % 3) AS w, t.x * t.x + t.y * t.y + t.z * t.z + 0.1 AS m2 FROM ptb p JOIN pts t USING (id))"
query("ag_25_sigma", f"WITH {MATCHED} SELECT {r('sqrt(sum(w * (x * x + y * y + z * z - 2 * (x * tx + y * ty + z * tz) + m2)) / (sum(w) * 3)) AS sigma')} FROM g")(lambda c: c.spark.createDataFrame([(lattice.spread_of(_matched(c)),)], "sigma double"))
query("ag_64_likelihood", f"WITH {MATCHED} SELECT {r('sum(w * w * ((x - tx) * (x - tx) + (y - ty) * (y - ty) + (z - tz) * (z - tz))) AS likelihood')} FROM g")(lambda c: c.spark.createDataFrame([(lattice.likelihood(_matched(c)),)], "likelihood double"))
query("gr_19_filter_registration")(lambda c: numbers(c.spark, lattice.filter_registration(points.transform(c.xyz, linalg.rigid(linalg.rotation_z(0.05), (0.05, -0.03, 0.02))), c.xyz, sigma=0.3, iterations=6).transformation))


def _stereo(c: Inputs) -> DataFrame:
    """Each image and it moved five pixels to the left: the disparity that most pixels get, and how many get one."""
    left = c.pix.select("img", "v", "u", F.floor("c0").cast("double").alias("c0"))
    right = left.withColumn("u", F.col("u") - 5).where("u >= 0")
    found = stereo.match(left, right, 100, 100, disparities=16)
    inside = found.where("v between 10 and 89 and u between 25 and 89")
    return inside.where(f"disparity <> {stereo.INVALID}").groupBy("img").agg(F.mode("disparity").alias("disparity"), (F.count(F.lit(1)) > 5000).alias("most"))


query("gr_34_stereo", "SELECT img, 5::INT AS disparity, true AS most FROM pix GROUP BY img")(_stereo)

# More SQL for what had none

query("wn_06_plane_refit", f"WITH s AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz, var_pop(x) AS xx, var_pop(y) AS yy, var_pop(z) AS zz, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz FROM pts WHERE z > 0.5), d AS (SELECT *, yy * zz - yz * yz AS dx, xx * zz - xz * xz AS dy, xx * yy - xy * xy AS dz FROM s), n AS (SELECT *, CASE WHEN dx >= dy AND dx >= dz THEN [dx, xz * yz - xy * zz, xy * yz - xz * yy] WHEN dy >= dz THEN [xz * yz - xy * zz, dy, xy * xz - yz * xx] ELSE [xy * yz - xz * yy, xy * xz - yz * xx, dz] END AS v FROM d), u AS (SELECT *, sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3]) AS l FROM n), p AS (SELECT [v[1] / l, v[2] / l, v[3] / l, -(v[1] * mx + v[2] * my + v[3] * mz) / l] AS p FROM u) SELECT 0 AS i, j::INT AS j, round(p[j + 1], 6) + 0.0 AS value FROM p, range(4) t(j)")(lambda c: numbers(c.spark, points.plane_of(c.xyz.where("z > 0.5"))))


def _farthest(n: int) -> str:
    """The choice unrolled: each step takes the point with the largest of the least distances so far."""
    parts = ["c0 AS (SELECT id, x, y, z FROM pts ORDER BY id LIMIT 1)", "f0 AS (SELECT pts.id, pts.x, pts.y, pts.z, (pts.x - c0.x) * (pts.x - c0.x) + (pts.y - c0.y) * (pts.y - c0.y) + (pts.z - c0.z) * (pts.z - c0.z) AS d FROM pts, c0)"]
    for i in range(1, n):
        parts.append(f"c{i} AS (SELECT id, x, y, z FROM f{i - 1} ORDER BY d DESC, id LIMIT 1)")
        parts.append(f"f{i} AS (SELECT f.id, f.x, f.y, f.z, least(f.d, (f.x - c{i}.x) * (f.x - c{i}.x) + (f.y - c{i}.y) * (f.y - c{i}.y) + (f.z - c{i}.z) * (f.z - c{i}.z)) AS d FROM f{i - 1} f, c{i})")
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT id FROM c{i}" for i in range(n))


query("wn_02_farthest_points", _farthest(10))(lambda c: points.farthest_point_down_sample(c.xyz, 10).select("id"))
NORMALS = f"WITH {q.KNN.format(q='ptb', t='pts')}, g AS (SELECT p.x AS px, p.y AS py, p.z AS pz, t.nx, t.ny, t.nz, (p.x - t.x) * t.nx + (p.y - t.y) * t.ny + (p.z - t.z) * t.nz AS e FROM k JOIN ptb p ON p.id = k.q JOIN pts t ON t.id = k.t WHERE rn = 1 AND d2 < 1), j AS (SELECT [py * nz - pz * ny, pz * nx - px * nz, px * ny - py * nx, nx, ny, nz] AS j FROM g)"
query("ag_16_jtj", f"{NORMALS} SELECT a::INT AS i, b::INT AS j, round(sum(j.j[a + 1] * j.j[b + 1]), 6) + 0.0 AS value FROM j, range(6) s(a), range(6) t(b) GROUP BY a, b")(lambda c: numbers(c.spark, registration.jtj(registration.correspondences(c.ptb, c.pts, 1.0, normals=True), registration.plane_rows())[0]))
INFORMATION = f"WITH {q.KNN.format(q='ptb', t='pts')}, g AS (SELECT t.x, t.y, t.z FROM k JOIN pts t ON t.id = k.t WHERE rn = 1 AND d2 < 0.25), j AS (SELECT unnest([[0, z, -y, 1, 0, 0], [-z, 0, x, 0, 1, 0], [y, -x, 0, 0, 0, 1]]) AS j FROM g)"
query("ag_48_information", f"{INFORMATION} SELECT a::INT AS i, b::INT AS j, round(sum(j.j[a + 1] * j.j[b + 1]), 6) + 0.0 AS value FROM j, range(6) s(a), range(6) t(b) GROUP BY a, b")(lambda c: numbers(c.spark, registration.information_matrix(registration.correspondences(c.ptb, c.xyz, 0.5))))

# Pixel pairs, volumes of two passes, pyramids

query("jn_31_nearest_pixel", f"WITH {m.PIXEL_PAIRS} SELECT img, tu, tv, round(min(z), 6) + 0.0 AS z FROM j GROUP BY img, tu, tv")(lambda c: m._pixels(c).select("img", "tu", "tv", "z"))
query("jn_32_merged_pairs", f"WITH {m.PIXEL_PAIRS} SELECT img, count(*) AS pairs FROM (SELECT DISTINCT img, tu, tv FROM j) GROUP BY img")(lambda c: m._pixels(c).groupBy("img").agg(F.count(F.lit(1)).alias("pairs")))
query("ag_57_surface_of_two", f"WITH {TSDF}, near AS (SELECT * FROM vol WHERE tsdf < 0.98 AND tsdf >= -0.98) SELECT axis::INT AS axis, count(*) AS n FROM near a, range(3) t(axis) JOIN near b ON b.ix = a.ix + (axis = 0)::INT AND b.iy = a.iy + (axis = 1)::INT AND b.iz = a.iz + (axis = 2)::INT WHERE a.tsdf * b.tsdf < 0 GROUP BY axis")(lambda c: volumes.surface_points(_volume(c, _volume(c)), 0.5).groupBy("axis").agg(F.count(F.lit(1)).alias("n")))
query("ag_68_distances_of_two", f"WITH {TSDF.replace('least(1.0, (depth - d) / 0.6)', 'least(1.0, (depth - d) * 2 / 0.6)').replace('depth - d > -0.6', '(depth - d) * 2 > -0.6')} SELECT ix, iy, iz, {r('tsdf', 'weight * 2 AS weight')} FROM vol")(lambda c: _scaled_twice(c))


def _scaled_twice(c: Inputs) -> DataFrame:
    twice = images.distance_multiplier(c.spark, K, 100, 100).withColumn("m", F.lit(2.0))
    pixels, cells = c.pix.select("img", "v", "u", (F.col("c0") / 10).alias("depth")), volumes.open_cells(c.xyz, 0.5, 0.6)
    once = volumes.integrate(None, cells, pixels, K, CAM, 0.5, 0.6, multiplier=twice)
    return volumes.integrate(once, cells, pixels, K, CAM, 0.5, 0.6, multiplier=twice)


query("ag_69_voxels_of_two", f"WITH {TSDF} SELECT ix, iy, iz, {r('(tsdf + 1) / 2 AS r')} FROM vol WHERE tsdf < 0.98 AND tsdf >= -0.98")(lambda c: volumes.voxel_points(_volume(c, _volume(c)), 0.5).select(*KEYS, "r"))
query("gr_38_odometry_levels", f"WITH h AS (SELECT v // 2 AS v, u // 2 AS u, c0 / 50 AS i, c0 / 10 AS d FROM pix WHERE img = 0 AND c0 > 0 AND c0 < 40) SELECT v::INT AS v, u::INT AS u, {r('avg(i) AS intensity', 'avg(d) AS depth')} FROM h GROUP BY 1, 2")(lambda c: alignment.odometry_levels(m._frame(c), m._frame(c), K, 100, 100, 2)[1][0])
