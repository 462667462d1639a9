"""Triangle meshes: vertices (id, x, y, z, and normals and colours where present) and triangles (tid, v0, v1, v2)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.leaves import PAIRS, TASKS, Leaves, placed, places
from ..plans.lineage import cut
from ..plans.ranking import with_row_number, with_running_sum
from ..plans.spatial import XYZ
from .points import COLOR, NORMAL, has

CORNERS = ("v0", "v1", "v2")
#: Triangles of a leaf.
FACES = 2048
Mesh = tuple[DataFrame, DataFrame]


# Factories: small arrays on the driver, then frames


def frames(spark: SparkSession, points: np.ndarray, triangles: np.ndarray) -> Mesh:
    v = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id long, x double, y double, z double")
    t = spark.createDataFrame([(i, *map(int, x)) for i, x in enumerate(triangles)], "tid long, v0 long, v1 long, v2 long")
    return v, t


def _joined(*parts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    points, triangles, n = [], [], 0
    for p, t in parts:
        points.append(p)
        triangles.append(t + n)
        n += len(p)
    return np.concatenate(points), np.concatenate(triangles)


#: Corners and faces of four solids, in the order that ids refer to. The icosahedron's corners are in units of (1, golden ratio).
BOX = [(0, 0, 0), (1, 0, 0), (0, 0, 1), (1, 0, 1), (0, 1, 0), (1, 1, 0), (0, 1, 1), (1, 1, 1)]
BOX_FACES = [(4, 7, 5), (4, 6, 7), (0, 2, 4), (2, 6, 4), (0, 1, 2), (1, 3, 2), (1, 5, 7), (1, 7, 3), (2, 3, 7), (2, 7, 6), (0, 4, 1), (1, 4, 5)]
TETRAHEDRON_FACES = [(0, 2, 1), (0, 3, 2), (0, 1, 3), (1, 2, 3)]
OCTAHEDRON = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (-1, 0, 0), (0, -1, 0), (0, 0, -1)]
OCTAHEDRON_FACES = [(0, 1, 2), (1, 3, 2), (3, 4, 2), (4, 0, 2), (0, 5, 1), (1, 5, 3), (3, 5, 4), (4, 5, 0)]
GOLDEN = (1 + math.sqrt(5)) / 2
ICOSAHEDRON = [(-1, 0, GOLDEN), (1, 0, GOLDEN), (1, 0, -GOLDEN), (-1, 0, -GOLDEN), (0, -GOLDEN, 1), (0, GOLDEN, 1), (0, GOLDEN, -1), (0, -GOLDEN, -1), (-GOLDEN, -1, 0), (GOLDEN, -1, 0), (GOLDEN, 1, 0), (-GOLDEN, 1, 0)]
ICOSAHEDRON_FACES = [
    (0, 4, 1), (0, 1, 5), (1, 4, 9), (1, 9, 10), (1, 10, 5), (0, 8, 4), (0, 11, 8), (0, 5, 11), (5, 6, 11), (5, 10, 6),
    (4, 8, 7), (4, 7, 9), (3, 6, 2), (3, 2, 7), (2, 6, 10), (2, 10, 9), (2, 9, 7), (3, 11, 6), (3, 8, 11), (3, 7, 8),
]


def box(w: float = 1.0, h: float = 1.0, d: float = 1.0):
    return np.array(BOX) * [w, h, d], np.array(BOX_FACES)


def tetrahedron(r: float = 1.0):
    """Three corners at a third of the radius below, the tip last."""
    turns = 2 * math.pi / 3 * np.arange(3)
    base = _rings(np.array([math.sqrt(8 / 9)]), np.array([-1 / 3]), turns)
    return r * np.concatenate([base, [[0, 0, 1]]]), np.array(TETRAHEDRON_FACES)


def octahedron(r: float = 1.0):
    return r * np.array(OCTAHEDRON, float), np.array(OCTAHEDRON_FACES)


def icosahedron(r: float = 1.0):
    """r scales corners of the norm sqrt(1 + golden ratio ** 2)."""
    return r * np.array(ICOSAHEDRON), np.array(ICOSAHEDRON_FACES)


def _turns(n: int) -> np.ndarray:
    return 2 * math.pi / n * np.arange(n)


def _rings(radii: np.ndarray, heights: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """Points of rings, one ring after another."""
    circle = np.stack([np.cos(turns), np.sin(turns)], axis=1)
    flat = radii[:, None, None] * circle
    return np.concatenate([flat, np.broadcast_to(heights[:, None, None], (*flat.shape[:2], 1))], axis=2).reshape(-1, 3)


def _bands(first: int, rows: int, cols: int, rising: bool = False) -> np.ndarray:
    """Two triangles for each cell between neighbouring rings; rings go down, or up where they are rising."""
    i, j = (x.reshape(-1) for x in np.indices((rows - 1, cols)))
    a, b = first + i * cols + j, first + i * cols + (j + 1) % cols
    if rising:
        a, b = b, a
    c, d = a + cols, b + cols
    return np.stack([c, b, a, c, d, b], axis=1).reshape(-1, 3)


def _fans(top: int, ring: int, bottom: int, other: int, cols: int) -> np.ndarray:
    """Triangles of two tips with their rings, in turn."""
    j = np.arange(cols)
    k = (j + 1) % cols
    return np.stack([np.full(cols, top), ring + j, ring + k, np.full(cols, bottom), other + k, other + j], axis=1).reshape(-1, 3)


def sphere(r: float = 1.0, resolution: int = 20):
    """Two poles, then the rings from above; twice `resolution` points in a ring."""
    cols, a = 2 * resolution, math.pi / resolution * np.arange(1, resolution)
    points = np.concatenate([[[0, 0, 1], [0, 0, -1]], _rings(np.sin(a), np.cos(a), _turns(cols))])
    return r * points, np.concatenate([_fans(0, 2, 1, 2 + (resolution - 2) * cols, cols), _bands(2, resolution - 1, cols)])


def half_sphere(r: float = 1.0, resolution: int = 20):
    """The upper half of a sphere, down to its equator."""
    cols, a = 2 * resolution, math.pi / resolution * np.arange(1, resolution // 2 + 1)
    points = np.concatenate([[[0, 0, 1]], _rings(np.sin(a), np.cos(a), _turns(cols))])
    return r * points, np.concatenate([_fans(0, 1, 0, 1, cols).reshape(-1, 2, 3)[:, 0], _bands(1, resolution // 2, cols)])


def tube(r: float = 1.0, h: float = 2.0, resolution: int = 20, split: int = 4):
    heights = h / 2 - h / split * np.arange(split + 1)
    return _rings(np.full(split + 1, r), heights, _turns(resolution)), _bands(0, split + 1, resolution)


def cylinder(r: float = 1.0, h: float = 2.0, resolution: int = 20, split: int = 4):
    """The middles of both ends, then the rings from above."""
    points = np.concatenate([[[0, 0, h / 2], [0, 0, -h / 2]], tube(r, h, resolution, split)[0]])
    return points, np.concatenate([_fans(0, 2, 1, 2 + split * resolution, resolution), _bands(2, split + 1, resolution)])


def capsule(r: float = 1.0, h: float = 2.0, resolution: int = 20, split: int = 4):
    """A tube, a half sphere above, and one turned over below."""
    p, t = half_sphere(r, resolution)
    return _joined(tube(r, h, resolution, split), (p + [0, 0, h / 2], t), (p * [1, -1, -1] - [0, 0, h / 2], t))


def cone(r: float = 1.0, h: float = 2.0, resolution: int = 20, split: int = 1):
    """The middle of the base, the tip, then the rings from below."""
    i = np.arange(split)
    points = np.concatenate([[[0, 0, 0], [0, 0, h]], _rings(r / split * (split - i), h / split * i, _turns(resolution))])
    # seen from below the base's triangles turn the other way
    fans = _fans(0, 2, 1, 2 + (split - 1) * resolution, resolution)[:, [0, 2, 1]]
    return points, np.concatenate([fans, _bands(2, split, resolution, rising=True)])


def torus(ring: float = 1.0, tube_radius: float = 0.5, rings: int = 30, sides: int = 20):
    v = _turns(sides)
    profile = np.stack([ring + tube_radius * np.cos(v), np.zeros(sides), tube_radius * np.sin(v)], axis=1)
    u = _turns(rings)
    points = np.stack([np.outer(np.cos(u), profile[:, 0]), np.outer(np.sin(u), profile[:, 0]), np.broadcast_to(profile[:, 2], (rings, sides))], axis=2).reshape(-1, 3)
    i, j = (x.reshape(-1) for x in np.indices((rings, sides)))
    at = lambda di, dj: (i + di) % rings * sides + (j + dj) % sides
    return points, np.stack([at(1, 0), at(1, 1), at(0, 0), at(0, 0), at(1, 1), at(0, 1)], axis=1).reshape(-1, 3)


def moebius(length: int = 70, width: int = 15, twists: int = 1, r: float = 1.0, flat: float = 1.0, w: float = 1.0, scale: float = 1.0):
    """A band of `length` by `width` points; neighbouring cells are cut along different diagonals, and odd twists close it upside down."""
    u, s = _turns(length)[:, None], -w / 2 + w / (width - 1) * np.arange(width)
    half = twists * u / 2
    points = scale * np.stack([np.cos(u) * (r + s * np.cos(half)), np.sin(u) * (r + s * np.cos(half)), flat * s * np.sin(half)], axis=2).reshape(-1, 3)
    i, j = (x.reshape(-1) for x in np.indices((length, width - 1)))
    a, b, even = i * width + j, i * width + j + 1, (i + j) % 2 == 0
    over = (i == length - 1) & (twists % 2 == 1)
    after = (i + 1) % length * width
    c, d = np.where(over, width - 1 - j, after + j), np.where(over, width - 2 - j, after + j + 1)
    one = np.where(even[:, None], np.stack([a, d, b], axis=1), np.stack([b, a, c], axis=1))
    two = np.where(even[:, None], np.stack([a, c, d], axis=1), np.stack([b, c, d], axis=1))
    # across the twist the faces look the other way
    one[over], two[over] = one[over][:, [0, 2, 1]], np.where(even[over][:, None], two[over][:, [0, 2, 1]], two[over][:, [1, 0, 2]])
    return points, np.stack([one, two], axis=1).reshape(-1, 3)


def arrow(cylinder_radius: float = 1.0, cone_radius: float = 1.5, cylinder_height: float = 5.0, cone_height: float = 4.0, resolution: int = 20, cylinder_split: int = 4, cone_split: int = 1):
    a, t = cylinder(cylinder_radius, cylinder_height, resolution, cylinder_split)
    b, u = cone(cone_radius, cone_height, resolution, cone_split)
    return _joined((a + [0, 0, cylinder_height / 2], t), (b + [0, 0, cylinder_height], u))


def coordinate_frame(size: float = 1.0, origin: Sequence[float] = (0, 0, 0)):
    a, t = arrow(0.035 * size, 0.06 * size, 0.8 * size, 0.2 * size)
    # arrows along x, y and z
    return _joined(*((p + np.asarray(origin), u) for p, u in (sphere(0.06 * size), (a[:, [2, 0, 1]], t), (a[:, [1, 2, 0]], t), (a, t))))


# Geometry


def corners(mesh: Mesh) -> DataFrame:
    """Triangles with their corners' places x0 .. z2."""
    vertices, out = mesh
    for n, c in enumerate(CORNERS):
        out = out.join(vertices.select(F.col("id").alias(c), *[F.col(x).alias(f"{x}{n}") for x in XYZ]), c)
    return out


def cross() -> list[Column]:
    a = [F.col(f"{c}1") - F.col(f"{c}0") for c in XYZ]
    b = [F.col(f"{c}2") - F.col(f"{c}0") for c in XYZ]
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def triangle_normals(mesh: Mesh, normalized: bool = True) -> DataFrame:
    """(tid, v0, v1, v2, nx, ny, nz); a triangle without area has (0, 0, 1) if unit normals are wanted."""
    out = corners(mesh).select("tid", *CORNERS, *[c.alias(n) for c, n in zip(cross(), NORMAL)])
    if normalized:
        size = F.sqrt(sum((F.col(n) * F.col(n) for n in NORMAL), F.lit(0.0)))
        out = out.withColumns({n: F.when(size > 0, F.col(n) / size).otherwise(F.lit(1.0 if n == "nz" else 0.0)) for n in NORMAL})
    return out


def vertex_normals(mesh: Mesh, normalized: bool = True) -> DataFrame:
    """(id, nx, ny, nz) of each vertex that has triangles: the sum of their normals, weighted by area."""
    each = triangle_normals(mesh, False).select(F.explode(F.array(*CORNERS)).alias("id"), *NORMAL)
    out = each.groupBy("id").agg(*[F.sum(n).alias(n) for n in NORMAL])
    if normalized:
        size = F.sqrt(sum((F.col(n) * F.col(n) for n in NORMAL), F.lit(0.0)))
        out = out.withColumns({n: F.when(size > 0, F.col(n) / size).otherwise(F.lit(1.0 if n == "nz" else 0.0)) for n in NORMAL})
    return out


def triangle_areas(mesh: Mesh) -> DataFrame:
    size = F.sqrt(sum((c * c for c in cross()), F.lit(0.0)))
    return corners(mesh).select("tid", *CORNERS, (size / 2).alias("area"))


def surface_area(mesh: Mesh) -> DataFrame:
    return triangle_areas(mesh).agg(F.sum("area").alias("area"))


def edge_list(triangles: DataFrame) -> DataFrame:
    """Distinct directed edges (src, dst): both directions of each side."""
    sides = [(a, b) for i, a in enumerate(CORNERS) for j, b in enumerate(CORNERS) if i != j]
    return triangles.select(F.explode(F.array(*[F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for a, b in sides])).alias("e")).select("e.src", "e.dst").distinct()


def line_set(mesh: Mesh) -> tuple[DataFrame, DataFrame]:
    """Vertices and each side once, the lower vertex first."""
    return mesh[0], edge_list(mesh[1]).where("src < dst")


# Cleaning


def remove_duplicated_vertices(mesh: Mesh) -> Mesh:
    """Of vertices at the same place the one with the least id stays; triangles refer to it."""
    vertices, triangles = mesh
    first = vertices.groupBy(*XYZ).agg(F.min("id").alias("first"))
    names = vertices.join(first, list(XYZ)).select("id", "first")
    for c in CORNERS:
        triangles = triangles.join(names.select(F.col("id").alias(c), F.col("first").alias("f__")), c).withColumn(c, F.col("f__")).drop("f__")
    return vertices.join(first.select(F.col("first").alias("id")), "id", "left_semi"), triangles.select("tid", *CORNERS)


def remove_duplicated_triangles(triangles: DataFrame) -> DataFrame:
    """Of triangles with the same corners in the same sense of rotation the one with the least tid stays."""
    a, b, c = (F.col(x) for x in CORNERS)
    turned = F.when((a <= b) & (a <= c), F.struct(a.alias("a"), b.alias("b"), c.alias("c"))).when((b <= a) & (b <= c), F.struct(b.alias("a"), c.alias("b"), a.alias("c"))).otherwise(F.struct(c.alias("a"), a.alias("b"), b.alias("c")))
    return triangles.groupBy(turned.alias("k")).agg(F.min(F.struct("tid", *CORNERS)).alias("t")).select("t.*")


def remove_degenerate_triangles(triangles: DataFrame) -> DataFrame:
    return triangles.where("v0 <> v1 and v1 <> v2 and v0 <> v2")


def remove_unreferenced_vertices(mesh: Mesh) -> Mesh:
    """Vertices that some triangle has, numbered anew without gaps."""
    vertices, triangles = mesh
    used = triangles.select(F.explode(F.array(*CORNERS)).alias("id")).distinct()
    kept = cut(with_row_number(vertices.join(used, "id", "left_semi"), "id", "new__"))
    names = kept.select("id", "new__")
    for c in CORNERS:
        triangles = triangles.join(names.withColumnRenamed("id", c), c).withColumn(c, F.col("new__")).drop("new__")
    return kept.drop("id").withColumnRenamed("new__", "id").select(*vertices.columns), triangles.select("tid", *CORNERS)


def concat(a: Mesh, b: Mesh) -> Mesh:
    n = (a[0].agg(F.max("id")).first()[0] or -1) + 1
    m = (a[1].agg(F.max("tid")).first()[0] or -1) + 1
    names = [c for c in a[0].columns if c in b[0].columns]
    v = a[0].select(*names).unionByName(b[0].select(*names).withColumn("id", F.col("id") + n))
    t = b[1].select((F.col("tid") + m).alias("tid"), *[(F.col(c) + n).alias(c) for c in CORNERS])
    return v, a[1].unionByName(t)


# Smoothing


def _names(vertices: DataFrame) -> list[str]:
    return [*XYZ, *(NORMAL if has(vertices, NORMAL) else ()), *(COLOR if has(vertices, COLOR) else ())]


def _around(vertices: DataFrame, edges: DataFrame, names: Sequence[str], weight: str | None = None) -> DataFrame:
    """Per vertex: n__ (number or weight of neighbours) and the (weighted) sums of their columns."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    there = edges.join(vertices.select(F.col("id").alias("dst"), *names), "dst")
    return there.groupBy(F.col("src").alias("id")).agg(F.sum(w).alias("n__"), *[F.sum(F.col(c) * w).alias(f"s_{c}") for c in names])


def _step(vertices: DataFrame, edges: DataFrame, formula, weight: str | None = None) -> DataFrame:
    names = _names(vertices)
    both = vertices.join(_around(vertices, edges, names, weight), "id", "left")
    new = {c: F.when(F.col("n__").isNull(), F.col(c)).otherwise(formula(F.col(c), F.col(f"s_{c}"), F.col("n__"))) for c in names}
    return both.withColumns(new).select(*vertices.columns)


def filter_sharpen(mesh: Mesh, iterations: int = 1, strength: float = 1.0) -> Mesh:
    vertices, edges = mesh[0], cut(edge_list(mesh[1]))
    for _ in range(iterations):
        vertices = _step(vertices, edges, lambda p, s, n: p + strength * (p * n - s))
    return vertices, mesh[1]


def filter_smooth_simple(mesh: Mesh, iterations: int = 1) -> Mesh:
    vertices, edges = mesh[0], cut(edge_list(mesh[1]))
    for _ in range(iterations):
        vertices = _step(vertices, edges, lambda p, s, n: (p + s) / (1 + n))
    return vertices, mesh[1]


def _weighted_edges(mesh: Mesh) -> DataFrame:
    """Edges with the inverse of their length in the mesh as given."""
    e = edge_list(mesh[1])
    for side, k in (("src", "0"), ("dst", "1")):
        e = e.join(mesh[0].select(F.col("id").alias(side), *[F.col(c).alias(c + k) for c in XYZ]), side)
    size = F.sqrt(sum(((F.col(f"{c}0") - F.col(f"{c}1")) * (F.col(f"{c}0") - F.col(f"{c}1")) for c in XYZ), F.lit(0.0)))
    return e.select("src", "dst", (1 / (size + 1e-12)).alias("w"))


def _laplacian(vertices: DataFrame, edges: DataFrame, factor: float) -> DataFrame:
    return _step(vertices, edges, lambda p, s, n: p + factor * (s / n - p), "w")


def filter_smooth_laplacian(mesh: Mesh, iterations: int = 1, factor: float = 0.5) -> Mesh:
    vertices, edges = mesh[0], cut(_weighted_edges(mesh))
    for _ in range(iterations):
        vertices = _laplacian(vertices, edges, factor)
    return vertices, mesh[1]


def filter_smooth_taubin(mesh: Mesh, iterations: int = 1, factor: float = 0.5, mu: float = -0.53) -> Mesh:
    vertices, edges = mesh[0], cut(_weighted_edges(mesh))
    for _ in range(iterations):
        vertices = _laplacian(_laplacian(vertices, edges, factor), edges, mu)
    return vertices, mesh[1]


# Sampling


def sample_points_uniformly(mesh: Mesh, n: int, seed: int = 0) -> DataFrame:
    """n points spread by area: each triangle gets the whole numbers between the running sums before and after it, scaled to n."""
    areas = cut(with_running_sum(triangle_areas(mesh), "tid", "area", "upto"))
    total = areas.agg(F.max("upto")).first()[0] or 0.0
    if not total:
        return mesh[0].limit(0).select("id", *XYZ)
    share = float(n) / total
    low, high = F.round((F.col("upto") - F.col("area")) * share).cast("long"), F.round(F.col("upto") * share).cast("long")
    spots = areas.select("tid", low.alias("a"), high.alias("b")).where("b > a").select("tid", F.explode(F.sequence(F.col("a"), F.col("b") - 1)).alias("id"))
    unit = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 30)) / float(1 << 30)
    where = spots.join(corners(mesh), "tid").withColumns({"p": F.sqrt(unit(1)), "q": unit(2)})
    return where.select("id", *[((1 - F.col("p")) * F.col(f"{c}0") + F.col("p") * (1 - F.col("q")) * F.col(f"{c}1") + F.col("p") * F.col("q") * F.col(f"{c}2")).alias(c) for c in XYZ])


# Meetings


def _cells(df: DataFrame, size: float, origin: Sequence[float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Triangles with each cell (ix, iy, iz) that their bounding box touches."""
    for i, (c, k) in enumerate(zip(XYZ, ("ix", "iy", "iz"))):
        names = [f"{c}{n}" for n in range(3)]
        low = F.floor((F.least(*names) - float(origin[i])) / size).cast("int")
        high = F.floor((F.greatest(*names) - float(origin[i])) / size).cast("int")
        df = df.withColumn(k, F.explode(F.sequence(low, high)))
    return df


def self_intersecting_triangles(mesh: Mesh, size: float) -> DataFrame:
    """(t0, t1), t0 < t1: triangles without a common vertex that meet.

    Triangles are dealt to leaves by their middles. Leaves whose boxes around whole triangles are apart are not compared; of the others each pair meets once, so no
    pair of triangles is found twice, and none is kept but those that meet. `size` (of the cells that paired them before) has no part in the result.
    """
    import pyarrow as pa

    places_ = [f"{c}{n}" for n in range(3) for c in XYZ]
    faces = corners(mesh).where(placed(places_)).withColumns({c: (F.least(*[f"{c}{n}" for n in range(3)]) + F.greatest(*[f"{c}{n}" for n in range(3)])) / 2 for c in XYZ})
    held = Leaves(faces, XYZ, "tid", [*CORNERS, *places_], size=FACES)
    columns = ["t", *[f"t_{c}" for c in (*CORNERS, *places_)], "leaf__"]
    lows, highs = ([f(*[f"t_{c}{n}" for n in range(3)]) for c in XYZ] for f in (F.least, F.greatest))
    boxes = held.rows.groupBy("leaf__").agg(*[F.min(x).alias(f"lo{c}") for c, x in zip(XYZ, lows)], *[F.max(x).alias(f"hi{c}") for c, x in zip(XYZ, highs)])
    boxes = sorted(tuple(r) for r in boxes.collect())  # one row for each leaf
    leaf, low, high = np.array([r[0] for r in boxes], int), np.array([r[1:4] for r in boxes]).reshape(-1, 3), np.array([r[4:] for r in boxes]).reshape(-1, 3)
    near = [(int(leaf[i]), int(leaf[j])) for i in range(len(leaf)) for j in i + np.flatnonzero((low[i:] <= high[i]).all(1) & (high[i:] >= low[i]).all(1))]
    spark = faces.sparkSession
    pairs = spark.createDataFrame(near, "one__ int, two__ int")
    tasks = max(1, min(len(near), max(TASKS, int(spark.conf.get("spark.sql.shuffle.partitions")))))

    def side(leaf_of: str):
        which = pairs.select(*[F.col(c).alias(c) for c in ("one__", "two__")], F.col(leaf_of).alias("leaf__"))
        rows = held.rows.select(*[F.col(c).alias(c) for c in columns])  # by new names: both sides come from one frame
        return rows.join(F.broadcast(which), "leaf__").drop("leaf__").repartition(tasks, "one__", "two__").groupBy("one__", "two__")

    def meet(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        same = key[0].as_py() == key[1].as_py()
        (ta, va, pa_), (tb, vb, pb) = ((x["t"].to_numpy(), np.stack([x[f"t_{c}"].to_numpy() for c in CORNERS], axis=1), places(x, [f"t_{c}" for c in places_]).astype(float).reshape(-1, 3, 3)) for x in (a, b))
        (la, ha), (lb, hb) = ((x.min(1), x.max(1)) for x in (pa_, pb))
        found, step = [np.zeros((0, 2), ta.dtype)], max(1, (PAIRS // 8) // max(1, len(tb)))
        for s in range(0, len(ta) if len(tb) else 0, step):
            e = slice(s, s + step)
            ok = ta[e, None] < tb if same else np.ones((len(ta[e]), len(tb)), bool)
            for i in range(3):
                ok &= (la[e, i, None] <= hb[:, i]) & (ha[e, i, None] >= lb[:, i])
            for i in range(3):
                for j in range(3):
                    ok &= va[e, i, None] != vb[:, j]
            i, j = np.nonzero(ok)
            i += s
            swap = ta[i] > tb[j]
            p, q = (np.where(swap[:, None, None], x, y) for x, y in ((pb[j], pa_[i]), (pa_[i], pb[j])))
            hit = triangles_meet(p, q)
            found.append(np.sort(np.stack([ta[i][hit], tb[j][hit]], axis=1), axis=1))
        t0, t1 = np.concatenate(found).T
        return pa.table({"t0": pa.array(t0, pa.int64()), "t1": pa.array(t1, pa.int64())})

    return side("one__").cogroup(side("two__")).applyInArrow(meet, "t0 long, t1 long")


def triangles_meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """boxes.triangles_triangles, with what lies on one side of a triangle's plane put aside first."""
    from .boxes import triangles_triangles

    left = np.arange(len(a))
    for x, y in ((a, b), (b, a)):
        n = np.cross(x[left, 1] - x[left, 0], x[left, 2] - x[left, 1])
        p, q = np.einsum("nij,nj->ni", x[left], n), np.einsum("nij,nj->ni", y[left], n)
        # a little more than the exact test calls apart
        apart = ((p.max(1) < q.min(1) - 2e-12) | (q.max(1) < p.min(1) - 2e-12)) & (np.linalg.norm(n, axis=1) > 2e-12)
        left = left[~apart]
    out = np.zeros(len(a), bool)
    out[left] = triangles_triangles(a[left], b[left])
    return out


def voxelized(mesh: Mesh, size: float, low: Sequence[float] | None = None) -> DataFrame:
    """Cells that some triangle meets; a cell's box is centred at its lower corner. Cells start half a voxel below the least corner unless `low` is given."""
    import pandas as pd

    from .boxes import triangles_boxes

    if low is None:
        r = mesh[0].agg(*[F.min(c).alias(c) for c in XYZ]).first()
        low = [(r[c] or 0.0) - size / 2 for c in XYZ]
    places = [f"{c}{n}" for n in range(3) for c in XYZ]
    # half a cell up: the box of cell i reaches from i - 1/2 to i + 1/2
    tried = _cells(corners(mesh), size, [v - size / 2 for v in low]).select("ix", "iy", "iz", F.array(*places).alias("p"))

    def meet(batches):
        for x in batches:
            at = x[["ix", "iy", "iz"]].to_numpy() * size + np.asarray(low)
            keep = triangles_boxes(np.array(x["p"].tolist(), float).reshape(-1, 3, 3), at, size)
            yield x.loc[keep, ["ix", "iy", "iz"]]

    return tried.mapInPandas(meet, "ix int, iy int, iz int").distinct()
