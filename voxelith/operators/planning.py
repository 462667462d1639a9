"""Lattices, line sets, primitives and paths around obstacles."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.linalg import rotation_from_axis_angle
from ..plans.spatial import XYZ
from . import graphs, meshes
from .voxels import KEYS, collide_lines

#: The sides of a box whose corners are numbered by bits z, y, x.
BOX_LINES = [(a, a | 1 << i) for a in range(8) for i in range(3) if not a >> i & 1]


def box_line_set(spark: SparkSession, low: Sequence[float], high: Sequence[float], rotation: np.ndarray | None = None) -> tuple[DataFrame, DataFrame]:
    """Corners and the twelve sides; a rotation turns the box about its centre."""
    low, high = np.asarray(low, float), np.asarray(high, float)
    p = np.array([[(high if c >> i & 1 else low)[i] for i in range(3)] for c in range(8)])
    if rotation is not None:
        mid = (low + high) / 2
        p = (p - mid) @ np.asarray(rotation).T + mid
    points = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double, z double")
    return points, spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(BOX_LINES)], "lid long, src long, dst long")


def camera_marker(spark: SparkSession, k: np.ndarray, extrinsic: np.ndarray, width: int, height: int, size: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """The camera's centre and the corners of its view at depth `size`, with eight lines."""
    m = np.linalg.inv(extrinsic)
    rays = [[(u - k[0, 2]) / k[0, 0], (v - k[1, 2]) / k[1, 1], 1.0] for u, v in ((0, 0), (width, 0), (width, height), (0, height))]
    p = np.concatenate([[np.zeros(3)], np.array(rays) * size]) @ m[:3, :3].T + m[:3, 3]
    lines = [(0, i) for i in range(1, 5)] + [(1, 2), (2, 3), (3, 4), (4, 1)]
    return spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double, z double"), spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(lines)], "lid long, src long, dst long")


def square_grid(spark: SparkSession, cell: float, n: int) -> tuple[DataFrame, DataFrame]:
    """4 (n + 1) end points and 2 (n + 1) lines of a square in the plane z = 0 around the origin."""
    h = cell * n / 2
    ends = [(x, y) for i in range(n + 1) for x, y in ((-h + i * cell, -h), (-h + i * cell, h), (-h, -h + i * cell), (h, -h + i * cell))]
    points = spark.createDataFrame([(i, float(x), float(y), 0.0) for i, (x, y) in enumerate(ends)], "id long, x double, y double, z double")
    return points, spark.createDataFrame([(i, 2 * i, 2 * i + 1) for i in range(2 * (n + 1))], "lid long, src long, dst long")


def correspondence_lines(a: DataFrame, b: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All points (b's ids moved up) and a line for each pair (i, j)."""
    n = (a.agg(F.max("id")).first()[0] or -1) + 1
    points = a.select("id", *XYZ).unionByName(b.select((F.col("id") + n).alias("id"), *XYZ))
    return points, pairs.select(F.col("i").alias("src"), (F.col("j") + n).alias("dst"))


def lattice(spark: SparkSession, low: Sequence[float], high: Sequence[float], resolution: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of a grid (the last ones a step inside the upper bounds) and edges to all nodes around, weighted by length."""
    r = resolution
    step = [(b - a) / r for a, b in zip(low, high)]
    i = spark.range(r**3).select("id", (F.col("id") / (r * r)).cast("int").alias("ix"), ((F.col("id") / r).cast("long") % r).cast("int").alias("iy"), (F.col("id") % r).cast("int").alias("iz"))
    nodes = i.select("id", *[(F.col(k) * step[n] + float(low[n])).alias(c) for n, (c, k) in enumerate(zip(XYZ, KEYS))])
    around = [o for o in itertools.product((-1, 0, 1), repeat=3) if any(o)]
    each = i.select("id", *KEYS, F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"d{n}") for n, v in enumerate(o)], F.lit(float(np.linalg.norm(np.multiply(o, step)))).alias("w")) for o in around])).alias("o"))
    to = [F.col(k) + F.col(f"o.d{n}") for n, k in enumerate(KEYS)]
    ok = F.lit(True)
    for t in to:
        ok = ok & t.between(0, r - 1)
    return nodes, each.where(ok).select(F.col("id").alias("src"), ((to[0] * r + to[1]) * r + to[2]).cast("long").alias("dst"), F.col("o.w").alias("weight"))


def find_path(nodes: DataFrame, edges: DataFrame, start: Sequence[float], goal: Sequence[float], reach: float, obstacles: Sequence[tuple[DataFrame, float, Sequence[float]]] = ()) -> tuple[list[tuple[float, float, float]], float]:
    """Places from start to goal over edges that meet no obstacle voxel (frames with their size and origin); nothing if there is no way."""
    n = (nodes.agg(F.max("id")).first()[0] or -1) + 1
    spark = nodes.sparkSession
    edges = graphs.add_node_and_connect(edges, nodes, n, start, reach)
    nodes = nodes.unionByName(spark.createDataFrame([(n, *map(float, start))], "id long, x double, y double, z double"))
    edges = graphs.add_node_and_connect(edges, nodes, n + 1, goal, reach)
    nodes = nodes.unionByName(spark.createDataFrame([(n + 1, *map(float, goal))], "id long, x double, y double, z double"))
    for voxels, size, origin in obstacles:
        lines = graphs.ends(edges.where("src < dst").select("src", "dst"), nodes).withColumn("lid", F.struct("src", "dst"))
        hit = collide_lines(voxels, lines, size, origin).select("lid.src", "lid.dst")
        edges = graphs.remove_edges(edges, hit)
    path, length = graphs.shortest_path(edges, n, n + 1)
    place = {r["id"]: (r["x"], r["y"], r["z"]) for r in nodes.where(F.col("id").isin(path)).collect()} if path else {}
    return [place[i] for i in path], length


# Primitives: kind, sizes and a 4 x 4 pose


def primitive_mesh(kind: str, sizes: Sequence[float], pose: np.ndarray):
    """Points and triangles of a box (three sides), sphere (radius), cylinder or capsule (radius, height), centred at the pose."""
    if kind == "box":
        p, t = meshes.box(*sizes)
        p = p - np.asarray(sizes) / 2
    else:
        p, t = {"sphere": meshes.sphere, "cylinder": meshes.cylinder, "capsule": meshes.capsule}[kind](*sizes)
    return p @ pose[:3, :3].T + pose[:3, 3], t


def _inside(kind: str, sizes: Sequence[float], p: np.ndarray) -> np.ndarray:
    if kind == "box":
        return (np.abs(p) <= np.asarray(sizes) / 2).all(axis=1)
    if kind == "sphere":
        return (p**2).sum(1) <= sizes[0] ** 2
    if kind == "capsule":
        z = np.clip(p[:, 2], -sizes[1] / 2, sizes[1] / 2)
        return p[:, 0] ** 2 + p[:, 1] ** 2 + (p[:, 2] - z) ** 2 <= sizes[0] ** 2
    raise ValueError(f"{kind} can't be filled with voxels")


def primitive_voxels(spark: SparkSession, kind: str, sizes: Sequence[float], pose: np.ndarray, size: float) -> DataFrame:
    """Cells whose centres lie in a box, sphere or capsule."""
    reach = {"box": lambda: np.linalg.norm(sizes) / 2, "sphere": lambda: sizes[0], "capsule": lambda: sizes[0] + sizes[1] / 2}[kind]()
    low, high = (np.floor((pose[:3, 3] + s * reach) / size).astype(int) for s in (-1, 1))
    cells = spark.range(1)
    for k, a, b in zip(KEYS, low, high):
        cells = cells.withColumn(k, F.explode(F.sequence(F.lit(int(a)), F.lit(int(b)))))
    back = np.linalg.inv(pose)

    def run(batches):
        for b in batches:
            p = (b[KEYS].to_numpy() + 0.5) * size @ back[:3, :3].T + back[:3, 3]
            yield b[_inside(kind, sizes, p)]

    return cells.select(*KEYS).mapInPandas(run, "ix int, iy int, iz int")


def swept_voxels(spark: SparkSession, kind: str, sizes: Sequence[float], pose: np.ndarray, goal: np.ndarray, size: float, sampling: int = 100) -> DataFrame:
    """Cells that the primitive fills on its way to another pose."""
    turn = goal[:3, :3] @ pose[:3, :3].T
    from ..functions.linalg import matrix_to_twist, rigid

    axis = matrix_to_twist(rigid(turn))[:3]
    out = None
    for s in np.linspace(0, 1, sampling):
        m = rigid(rotation_from_axis_angle(axis * s) @ pose[:3, :3], pose[:3, 3] + s * (goal[:3, 3] - pose[:3, 3]))
        part = primitive_voxels(spark, kind, sizes, m, size)
        out = part if out is None else out.unionByName(part)
    return out.distinct()
