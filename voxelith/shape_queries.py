"""Queries of shapes that are made from numbers alone, with SQL that makes them from their formulas; `queries` registers them."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from . import queries as q
from .functions import linalg
from .operators import meshes, planning
from .operators.boxes import Box, OrientedBox
from .queries import CAM, Inputs, K, M, numbers, query, r

XYZ = ("x", "y", "z")


def rows_of(c: Inputs, mesh: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Vertices ("v", id, x, y, z) and triangles ("t", id and the three vertices)."""
    parts = [(kind, i, *map(float, p)) for kind, part in zip("vt", mesh) for i, p in enumerate(part)]
    return c.spark.createDataFrame(parts, "kind string, id long, x double, y double, z double")


@dataclass
class Solid:
    """SQL of vertices and triangles (id, x, y, z each) and how many there are."""

    vertices: str
    triangles: str
    n: int
    m: int

    def __add__(self, other: Solid) -> Solid:
        v = f"{self.vertices} UNION ALL SELECT id + {self.n}, x, y, z FROM ({other.vertices})"
        t = f"{self.triangles} UNION ALL SELECT id + {self.m}, x + {self.n}, y + {self.n}, z + {self.n} FROM ({other.triangles})"
        return Solid(v, t, self.n + other.n, self.m + other.m)

    def at(self, x: str, y: str, z: str) -> Solid:
        return Solid(f"SELECT id, {x} AS x, {y} AS y, {z} AS z FROM ({self.vertices})", self.triangles, self.n, self.m)

    def sql(self) -> str:
        return f"SELECT 'v' AS kind, id, {r(*XYZ)} FROM ({self.vertices}) UNION ALL SELECT 't', id, x::DOUBLE, y::DOUBLE, z::DOUBLE FROM ({self.triangles})"


def listed(points: list, faces: list, scale: str = "1.0") -> Solid:
    v = ", ".join(f"({i}, {', '.join(f'({float(x)!r}) * {scale}' for x in p)})" for i, p in enumerate(points))
    t = ", ".join(f"({i}, {a}, {b}, {c})" for i, (a, b, c) in enumerate(faces))
    return Solid(f"SELECT id, x, y, z FROM (VALUES {v}) p(id, x, y, z)", f"SELECT id, x, y, z FROM (VALUES {t}) f(id, x, y, z)", len(points), len(faces))


def rings(first: int, rows: int, cols: int, radius: str, height: str) -> str:
    return f"SELECT {first} + i * {cols} + j AS id, ({radius}) * cos(2 * pi() * j / {cols}) AS x, ({radius}) * sin(2 * pi() * j / {cols}) AS y, ({height})::DOUBLE AS z FROM range({rows}) a(i), range({cols}) b(j)"


def bands(number: int, first: int, rows: int, cols: int, rising: bool = False) -> str:
    a, b = f"{first} + i * {cols} + j", f"{first} + i * {cols} + (j + 1) % {cols}"
    if rising:
        a, b = b, a
    return f"SELECT {number} + 2 * (i * {cols} + j) + k AS id, {a} + {cols} AS x, CASE k WHEN 0 THEN {b} ELSE {b} + {cols} END AS y, CASE k WHEN 0 THEN {a} ELSE {b} END AS z FROM range({rows - 1}) s(i), range({cols}) t(j), range(2) u(k)"


def fans(ring: int, other: int, cols: int, below: bool = False) -> str:
    """Of two tips, vertices 0 and 1."""
    j, n = "j", f"(j + 1) % {cols}"
    if below:
        j, n = n, j
    return f"SELECT 2 * j + k AS id, k AS x, CASE k WHEN 0 THEN {ring} + {j} ELSE {other} + {n} END AS y, CASE k WHEN 0 THEN {ring} + {n} ELSE {other} + {j} END AS z FROM range({cols}) t(j), range(2) u(k)"


def tips(*heights: str) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS id, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, ({h})::DOUBLE AS z" for i, h in enumerate(heights))


def sphere(radius: float = 1.0, n: int = 20) -> Solid:
    around = rings(2, n - 1, 2 * n, f"{radius} * sin(pi() * (i + 1) / {n})", f"{radius} * cos(pi() * (i + 1) / {n})")
    return Solid(f"{tips(str(radius), str(-radius))} UNION ALL {around}", f"{fans(2, 2 + 2 * n * (n - 2), 2 * n)} UNION ALL {bands(4 * n, 2, n - 1, 2 * n)}", 2 + 2 * n * (n - 1), 4 * n * (n - 1))


def half_sphere(radius: float = 1.0, n: int = 20) -> Solid:
    around = rings(1, n // 2, 2 * n, f"{radius} * sin(pi() * (i + 1) / {n})", f"{radius} * cos(pi() * (i + 1) / {n})")
    cap = f"SELECT j AS id, 0 AS x, 1 + j AS y, 1 + (j + 1) % {2 * n} AS z FROM range({2 * n}) t(j)"
    return Solid(f"{tips(str(radius))} UNION ALL {around}", f"{cap} UNION ALL {bands(2 * n, 1, n // 2, 2 * n)}", 1 + n * n, 2 * n + 4 * n * (n // 2 - 1))


def tube(radius: float = 1.0, h: float = 2.0, n: int = 20, split: int = 4) -> Solid:
    return Solid(rings(0, split + 1, n, str(radius), f"{h / 2} - {h} * i / {split}"), bands(0, 0, split + 1, n), n * (split + 1), 2 * n * split)


def cylinder(radius: float = 1.0, h: float = 2.0, n: int = 20, split: int = 4) -> Solid:
    around = rings(2, split + 1, n, str(radius), f"{h / 2} - {h} * i / {split}")
    return Solid(f"{tips(str(h / 2), str(-h / 2))} UNION ALL {around}", f"{fans(2, 2 + n * split, n)} UNION ALL {bands(2 * n, 2, split + 1, n)}", 2 + n * (split + 1), 2 * n * (split + 1))


def cone(radius: float = 1.0, h: float = 2.0, n: int = 20, split: int = 1) -> Solid:
    around = rings(2, split, n, f"{radius} * ({split} - i) / {split}", f"{h} * i / {split}")
    sides = f" UNION ALL {bands(2 * n, 2, split, n, rising=True)}" if split > 1 else ""
    return Solid(f"{tips('0', str(h))} UNION ALL {around}", f"{fans(2, 2 + n * (split - 1), n, below=True)}{sides}", 2 + n * split, 2 * n * split)


def capsule(radius: float = 1.0, h: float = 2.0, n: int = 20, split: int = 4) -> Solid:
    half = half_sphere(radius, n)
    return tube(radius, h, n, split) + half.at("x", "y", f"z + {h / 2}") + half.at("x", "-y", f"-z - {h / 2}")


def arrow(a: float = 1.0, b: float = 1.5, h: float = 5.0, tip: float = 4.0) -> Solid:
    return cylinder(a, h).at("x", "y", f"z + {h / 2}") + cone(b, tip).at("x", "y", f"z + {h}")


def torus(ring: float = 1.0, side: float = 0.5, u: int = 30, v: int = 20) -> Solid:
    flat = f"({ring} + {side} * cos(2 * pi() * j / {v}))"
    points = f"SELECT i * {v} + j AS id, {flat} * cos(2 * pi() * i / {u}) AS x, {flat} * sin(2 * pi() * i / {u}) AS y, {side} * sin(2 * pi() * j / {v}) AS z FROM range({u}) a(i), range({v}) b(j)"
    a, b, c, d = (f"(i + {di}) % {u} * {v} + (j + {dj}) % {v}" for di, dj in ((0, 0), (0, 1), (1, 0), (1, 1)))
    faces = f"SELECT 2 * (i * {v} + j) + k AS id, CASE k WHEN 0 THEN {c} ELSE {a} END AS x, {d} AS y, CASE k WHEN 0 THEN {a} ELSE {b} END AS z FROM range({u}) s(i), range({v}) t(j), range(2) w(k)"
    return Solid(points, faces, u * v, 2 * u * v)


def moebius(u: int = 70, v: int = 15) -> Solid:
    """One twist, all sizes one; the closing cells refer to the first points upside down."""
    s = f"(-0.5 + j / {v - 1}.0)"
    flat = f"(1 + {s} * cos(pi() * i / {u}))"
    points = f"SELECT i * {v} + j AS id, cos(2 * pi() * i / {u}) * {flat} AS x, sin(2 * pi() * i / {u}) * {flat} AS y, {s} * sin(pi() * i / {u}) AS z FROM range({u}) a(i), range({v}) b(j)"
    cells = f"SELECT i, j, i = {u - 1} AS over, (i + j) % 2 = 0 AS even, i * {v} + j AS a, i * {v} + j + 1 AS b, CASE WHEN i = {u - 1} THEN {v - 1} - j ELSE (i + 1) * {v} + j END AS c, CASE WHEN i = {u - 1} THEN {v - 2} - j ELSE (i + 1) * {v} + j + 1 END AS d FROM range({u}) s(i), range({v - 1}) t(j)"
    one = "CASE WHEN even AND over THEN [a, b, d] WHEN even THEN [a, d, b] WHEN over THEN [b, c, a] ELSE [b, a, c] END"
    two = "CASE WHEN even AND over THEN [a, d, c] WHEN even THEN [a, c, d] WHEN over THEN [c, b, d] ELSE [b, c, d] END"
    faces = f"SELECT id, f[1] AS x, f[2] AS y, f[3] AS z FROM (SELECT 2 * (i * {v - 1} + j) + k AS id, CASE k WHEN 0 THEN {one} ELSE {two} END AS f FROM ({cells}), range(2) w(k))"
    return Solid(points, faces, u * v, 2 * u * (v - 1))


_arrow = arrow(0.035, 0.06, 0.8, 0.2)
_base = [(math.sqrt(8 / 9), 0, -1 / 3), (-math.sqrt(2 / 9), math.sqrt(2 / 3), -1 / 3), (-math.sqrt(2 / 9), -math.sqrt(2 / 3), -1 / 3), (0, 0, 1)]
SOLIDS = {
    "67_tetrahedron": listed(_base, meshes.TETRAHEDRON_FACES),
    "68_octahedron": listed(meshes.OCTAHEDRON, meshes.OCTAHEDRON_FACES),
    "69_icosahedron": listed(meshes.ICOSAHEDRON, meshes.ICOSAHEDRON_FACES),
    "70_box": listed(meshes.BOX, meshes.BOX_FACES),
    "71_sphere": sphere(),
    "72_half_sphere": half_sphere(),
    "73_cylinder": cylinder(),
    "74_tube": tube(),
    "75_capsule": capsule(),
    "76_cone": cone(),
    "77_torus": torus(),
    "78_arrow": arrow(),
    "79_coordinate_frame": sphere(0.06) + _arrow.at("z", "x", "y") + _arrow.at("y", "z", "x") + _arrow,
    "80_moebius": moebius(),
}
for _name, _solid in SOLIDS.items():
    query(f"io_{_name}", _solid.sql())(lambda c, s=_name.split("_", 1)[1]: rows_of(c, getattr(meshes, s)()))
query("io_76_cone_in_rings", cone(0.5, 3.0, 12, 3).sql())(lambda c: rows_of(c, meshes.cone(0.5, 3.0, 12, 3)))
query("io_89_primitive_mesh", capsule(0.5, 1.0).at("x", "y", "z + 4").sql())(lambda c: rows_of(c, planning.primitive_mesh("capsule", (0.5, 1.0), CAM)))

# Lines

_turned = "SELECT b AS id, 0.5 + ((b & 1) - 0.5) * cos(0.3) - (((b >> 1) & 1) * 2 - 1) * sin(0.3) AS x, 1 + ((b & 1) - 0.5) * sin(0.3) + (((b >> 1) & 1) * 2 - 1) * cos(0.3) AS y, ((b >> 2) & 1) * 3.0 AS z FROM range(8) t(b)"
query("io_61_oriented_box_lines", f"SELECT id, {r(*XYZ)} FROM ({_turned})")(lambda c: planning.box_line_set(c.spark, (0, 0, 0), (1, 2, 3), linalg.rotation_z(0.3))[0])
query("io_63_camera_marker", f"SELECT id, {r(*XYZ)} FROM (SELECT 0 AS id, 0.0 AS x, 0.0 AS y, -4.0 AS z UNION ALL SELECT 1 + k, (CASE WHEN k IN (1, 2) THEN 100 ELSE 0 END - 49.5) / 50, (CASE WHEN k >= 2 THEN 100 ELSE 0 END - 49.5) / 50, -3.0 FROM range(4) t(k))")(lambda c: planning.camera_marker(c.spark, K, CAM, 100, 100)[0])
query("io_64_square_grid", f"SELECT id, {r(*XYZ)} FROM (SELECT 4 * i + k AS id, CASE k WHEN 2 THEN -1.0 WHEN 3 THEN 1.0 ELSE -1 + i * 0.5 END AS x, CASE k WHEN 0 THEN -1.0 WHEN 1 THEN 1.0 ELSE -1 + i * 0.5 END AS y, 0.0 AS z FROM range(5) a(i), range(4) b(k))")(lambda c: planning.square_grid(c.spark, 0.5, 4)[0])

# Matrices


def sql_of(rows: list[list[str]]) -> str:
    """(i, j, value) of a matrix of expressions."""
    return "SELECT * FROM (VALUES " + ", ".join(f"({i}, {j}, round(({e})::DOUBLE, 6) + 0.0)" for i, row in enumerate(rows) for j, e in enumerate(row)) + ") m(i, j, value)"


_a, _b, _c = (0.1, 0.2, 0.3)
_euler = [
    [f"cos({_b}) * cos({_c})", f"-cos({_b}) * sin({_c})", f"sin({_b})"],
    [f"cos({_a}) * sin({_c}) + sin({_a}) * sin({_b}) * cos({_c})", f"cos({_a}) * cos({_c}) - sin({_a}) * sin({_b}) * sin({_c})", f"-sin({_a}) * cos({_b})"],
    [f"sin({_a}) * sin({_c}) - cos({_a}) * sin({_b}) * cos({_c})", f"sin({_a}) * cos({_c}) + cos({_a}) * sin({_b}) * sin({_c})", f"cos({_a}) * cos({_b})"],
]
query("pr_14_euler", sql_of(_euler))(lambda c: numbers(c.spark, linalg.rotation_from_euler("xyz", (_a, _b, _c))))
query("pr_25_oriented_box", f"SELECT b::INT AS i, j::INT AS j, round(CASE j WHEN 0 THEN x + 1 WHEN 1 THEN y + 1 ELSE z + 1 END, 6) + 0.0 AS value FROM (SELECT id AS b, x, y, z FROM ({_turned})), range(3) s(j)")(lambda c: numbers(c.spark, OrientedBox.of(Box((0, 0, 0), (1, 2, 3))).rotate(linalg.rotation_z(0.3)).translate((1, 1, 1)).corners()))


def _axis_angle(v: tuple[float, float, float]) -> list[list[str]]:
    """Rodrigues' formula."""
    n = math.sqrt(sum(x * x for x in v))
    u = [x / n for x in v]
    cross = [[0, -u[2], u[1]], [u[2], 0, -u[0]], [-u[1], u[0], 0]]
    return [[f"{float(i == j)} * cos({n}) + (1 - cos({n})) * ({u[i] * u[j]!r}) + sin({n}) * ({cross[i][j]!r})" for j in range(3)] for i in range(3)]


query("gr_21_twist", sql_of([[*row, str(t)] for row, t in zip(_axis_angle((0.1, 0.2, 0.3)), (1, 2, 3))] + [["0", "0", "0", "1"]]))(lambda c: numbers(c.spark, linalg.twist_to_matrix([0.1, 0.2, 0.3, 1, 2, 3])))
#: The first column is the direction itself.
query("pr_58_rotation_to_axis", sql_of([["1 / sqrt(14)"], ["2 / sqrt(14)"], ["3 / sqrt(14)"]]))(lambda c: numbers(c.spark, linalg.rotation_between_x_axis_and((1, 2, 3))[:, :1]))
#: A root's square is the matrix.
query("gr_22_square_root", sql_of([["4", "1", "0"], ["1", "3", "0"], ["0", "0", "2"]]))(lambda c: numbers(c.spark, (s := linalg.sqrt_symmetric(np.array([[4.0, 1, 0], [1, 3, 0], [0, 0, 2]]))) @ s))
_back = np.linalg.inv(M)
query("ag_14_kabsch", sql_of([[repr(float(v)) for v in row] for row in _back]))(lambda c: numbers(c.spark, q.registration.kabsch_of(q._paired(c, q.points.transform(c.xyz, M)))))
