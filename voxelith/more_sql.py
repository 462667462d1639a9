"""SQL for queries that are registered elsewhere: separating axes, clusters, paths, motions that are found again."""

from __future__ import annotations

import numpy as np

from . import queries as q
from .functions import linalg
from .queries import M, ORACLES, QUERIES, TRI_XYZ, VIEWS
from .shape_queries import sql_of

XYZ = "xyz"


def oracle(name: str, sql: str) -> None:
    """As query() does, for a query that is there."""
    assert name in QUERIES and name not in ORACLES, name
    body = sql.strip()
    ORACLES[name] = f"WITH RECURSIVE {VIEWS.strip()}, {body[5:]}" if body.startswith("WITH ") else f"WITH {VIEWS.strip()}\n{body}"


# Motions that registration finds again: the inverse of what moved the source

for _name, _m in (
    ("gr_07_icp", linalg.rigid(linalg.rotation_z(0.02), (0.02, 0.01, -0.01))),
    ("gr_10_icp_point_to_plane", linalg.rigid(linalg.rotation_z(0.02), (0.02, 0.01, -0.01))),
    ("gr_11_symmetric_icp", linalg.rigid(None, (0.02, 0.01, 0))),
    ("gr_12_colored_icp", linalg.rigid(None, (0.02, 0.01, -0.01))),
    ("gr_14_generalized_icp", linalg.rigid(None, (0.02, 0.01, -0.01))),
    ("gr_16_fast_global", M),
):
    oracle(_name, sql_of([[repr(float(v)) for v in row] for row in np.linalg.inv(_m)]))

_t = 0.8
oracle("io_86_urdf", sql_of([[f"cos({_t})", f"-sin({_t})", "0", "1"], [f"sin({_t})", f"cos({_t})", "0", "0"], ["0", "0", "1", "0"], ["0", "0", "0", "1"]]))
oracle("gr_27_forward_kinematics", sql_of([[f"cos({_t})", f"-sin({_t})", "0", f"1 + 2 * cos({_t}) - 2 * sin({_t})"], [f"sin({_t})", f"cos({_t})", "0", f"2 * sin({_t}) + 2 * cos({_t})"], ["0", "0", "1", "0"], ["0", "0", "0", "1"]]))

# Graphs

oracle(
    "gr_06_dbscan",
    """WITH near AS (SELECT a.id AS a, b.id AS b FROM pts a JOIN pts b ON a.id <> b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < 0.36),
    core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 4), inner_ AS (SELECT near.* FROM near JOIN core p ON p.id = a JOIN core s ON s.id = b),
    reach(id, root) AS (SELECT id, id FROM core UNION SELECT inner_.b, reach.root FROM reach JOIN inner_ ON inner_.a = reach.id), comp AS (SELECT id, min(root) AS component FROM reach GROUP BY id),
    border AS (SELECT near.a AS id, arg_min(component, near.b) AS component FROM near JOIN comp ON comp.id = near.b WHERE near.a NOT IN (SELECT id FROM core) GROUP BY near.a),
    placed AS (SELECT * FROM comp UNION ALL SELECT * FROM border), sizes AS (SELECT component, row_number() OVER (ORDER BY component) - 1 AS cluster FROM (SELECT component FROM placed GROUP BY component HAVING count(*) >= 4))
    SELECT pts.id, coalesce(cluster, -1)::BIGINT AS cluster FROM pts LEFT JOIN placed ON placed.id = pts.id LEFT JOIN sizes ON sizes.component = placed.component""",
)
oracle(
    "gr_05_shortest_path",
    f"""WITH {q.REACH}, d AS (SELECT id, min(dist) AS dist FROM far GROUP BY id), before AS (SELECT net.dst AS id, min(net.src) AS prev FROM net JOIN d p ON p.id = net.src JOIN d e ON e.id = net.dst WHERE p.dist + net.weight = e.dist GROUP BY net.dst),
    back(id, k) AS (SELECT 7::BIGINT, 0 UNION ALL SELECT prev, k + 1 FROM back JOIN before USING (id) WHERE back.id <> 0)
    SELECT ((SELECT max(k) FROM back) - k)::INT AS place, back.id, round((SELECT dist FROM d WHERE d.id = 7), 6) AS length FROM back""",
)

# Separating axes: vectors are triples of expressions


def _minus(a: list[str], b: list[str]) -> list[str]:
    return [f"({x} - {y})" for x, y in zip(a, b)]


def _cross(a: list[str], b: list[str]) -> list[str]:
    return [f"({a[i]} * {b[j]} - {a[j]} * {b[i]})" for i, j in ((1, 2), (2, 0), (0, 1))]


def _along(p: list[str], axis: list[str]) -> str:
    return " + ".join(f"{x} * {y}" for x, y in zip(p, axis))


def _named(prefix: str, vectors: list[list[str]]) -> tuple[str, list[list[str]]]:
    """SELECT items that name the parts of vectors, and the names."""
    names = [[f"{prefix}{i}{c}" for c in XYZ] for i in range(len(vectors))]
    return ", ".join(f"{e} AS {n}" for v, own in zip(vectors, names) for e, n in zip(v, own)), names


def _corners(letter: str) -> list[list[str]]:
    return [[f"{letter}{c}{i}" for c in XYZ] for i in range(3)]


def _edges(letter: str) -> tuple[str, list[list[str]]]:
    p = _corners(letter)
    return _named(f"e{letter}", [_minus(p[(i + 1) % 3], p[i]) for i in range(3)])


def triangles_meet(source: str, keep: str) -> str:
    """SQL of `keep` and hit for rows of two triangles (ax0 .. az2, bx0 .. bz2)."""
    a, b = _corners("a"), _corners("b")
    ea, na = _edges("a")
    eb, nb = _edges("b")
    normals, names = _named("n", [_cross(na[0], na[1]), _cross(nb[0], nb[1])])
    axes = [*names, *(_cross(x, y) for x in na for y in nb), *(_cross(names[0], x) for x in na), *(_cross(names[1], x) for x in nb)]
    apart = []
    for x in axes:
        p, s = ([_along(v, x) for v in t] for t in (a, b))
        apart.append(f"(sqrt({_along(x, x)}) >= 1e-12 AND (greatest({', '.join(p)}) < least({', '.join(s)}) - 1e-12 OR greatest({', '.join(s)}) < least({', '.join(p)}) - 1e-12))")
    return f"SELECT {keep}, NOT ({' OR '.join(apart)}) AS hit FROM (SELECT *, {normals} FROM (SELECT *, {ea}, {eb} FROM {source}))"


def triangle_meets_box(source: str, keep: str, half: float) -> str:
    """SQL of `keep` and hit for rows of a triangle (ax0 .. az2) around a cube's centre."""
    a = _corners("a")
    ea, na = _edges("a")
    unit = [["1" if i == j else "0" for j in range(3)] for i in range(3)]
    normal, names = _named("n", [_cross(na[0], na[1])])
    meets = []
    for x in [*unit, names[0], *(_cross(e, u) for e in na for u in unit)]:
        p, reach = [_along(v, x) for v in a], f"{half} * (" + " + ".join(f"abs({y})" for y in x) + ")"
        meets.append(f"(least({', '.join(p)}) <= {reach} AND greatest({', '.join(p)}) >= -({reach}))")
    return f"SELECT {keep}, {' AND '.join(meets)} AS hit FROM (SELECT *, {normal} FROM (SELECT *, {ea} FROM {source}))"


THREE = "three AS (SELECT id // 3 AS id, " + ", ".join(f"max({c}) FILTER (id % 3 = {i}) AS a{c}{i}" for i in range(3) for c in XYZ) + " FROM pts GROUP BY id // 3 HAVING count(*) = 3)"
NEXT = f"{THREE}, pairs AS (SELECT a.*, " + ", ".join(f"b.a{c}{i} AS b{c}{i}" for i in range(3) for c in XYZ) + " FROM three a JOIN three b ON b.id = (a.id + 1) % (SELECT count(*) FROM three))"
oracle("fl_23_triangle_triangle", f"WITH {NEXT} {triangles_meet('pairs', 'id')}")
oracle("fl_24_triangle_box", f"WITH {THREE} {triangle_meets_box('three', 'id', 1.0)}")
BOUNDS = " AND ".join(f"greatest(a.{c}0, a.{c}1, a.{c}2) >= least(b.{c}0, b.{c}1, b.{c}2) AND greatest(b.{c}0, b.{c}1, b.{c}2) >= least(a.{c}0, a.{c}1, a.{c}2)" for c in XYZ)
MEETING = f"{TRI_XYZ}, pairs AS (SELECT a.tid AS t0, b.tid AS t1, " + ", ".join(f"{s}.{c}{i} AS {s}{c}{i}" for s in "ab" for i in range(3) for c in XYZ) + f" FROM txyz a JOIN txyz b ON a.tid < b.tid AND {BOUNDS} AND len(list_intersect([a.v0, a.v1, a.v2], [b.v0, b.v1, b.v2])) = 0), met AS ({triangles_meet('pairs', 't0, t1')})"
oracle("jn_23_self_intersections", f"WITH {MEETING} SELECT t0, t1 FROM met WHERE hit")
CUBES = (
    f"{TRI_XYZ}, low AS (SELECT " + ", ".join(f"min({c}) - 0.25 AS l{c}" for c in XYZ) + " FROM pts), spread AS (SELECT *, "
    + ", ".join(f"unnest(range(floor((least({c}0, {c}1, {c}2) - l{c} + 0.25) / 0.5)::INT, floor((greatest({c}0, {c}1, {c}2) - l{c} + 0.25) / 0.5)::INT + 1)) AS i{c}" for c in "x")
    + " FROM txyz, low), spread2 AS (SELECT *, unnest(range(floor((least(y0, y1, y2) - ly + 0.25) / 0.5)::INT, floor((greatest(y0, y1, y2) - ly + 0.25) / 0.5)::INT + 1)) AS iy FROM spread), spread3 AS (SELECT *, unnest(range(floor((least(z0, z1, z2) - lz + 0.25) / 0.5)::INT, floor((greatest(z0, z1, z2) - lz + 0.25) / 0.5)::INT + 1)) AS iz FROM spread2), "
    + "around AS (SELECT ix, iy, iz, " + ", ".join(f"{c}{i} - (i{c} * 0.5 + l{c}) AS a{c}{i}" for i in range(3) for c in XYZ) + f" FROM spread3), met AS ({triangle_meets_box('around', 'ix, iy, iz', 0.25)})"
)
oracle("io_55_voxelized_mesh", f"WITH {CUBES} SELECT DISTINCT ix::INT AS ix, iy::INT AS iy, iz::INT AS iz FROM met WHERE hit")

# Scans, segments, primitives

_looks = " OR ".join(f"coalesce((atan2(abs({o} * sin({0.03 * n})), range - {o} * cos({0.03 * n})) < 0.2 OR atan2(abs({o} * sin({0.03 * n})), range - {o} * cos({0.03 * n})) > 2.9) AND range > {o}, false)" for o, n in (("p2", 2), ("p1", 1), ("f1", 1), ("f2", 2)))
oracle("fl_22_scan_shadows", f"WITH n AS (SELECT *, lag(range, 1) OVER w AS p1, lag(range, 2) OVER w AS p2, lead(range, 1) OVER w AS f1, lead(range, 2) OVER w AS f2 FROM scan WINDOW w AS (PARTITION BY scan ORDER BY step)), s AS (SELECT scan, step, range, {_looks} AS shadow FROM n), m AS (SELECT *, max(shadow::INT) OVER (PARTITION BY scan ORDER BY step ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM s) SELECT scan, step, CASE WHEN near = 1 THEN NULL ELSE round(range, 6) + 0.0 END AS range FROM m")
oracle("io_88_swept_voxels", "SELECT DISTINCT x::INT AS ix, y::INT AS iy, z::INT AS iz FROM range(-8, 13) a(x), range(-8, 8) b(y), range(-8, 8) c(z), range(8) s(k) WHERE pow(x * 0.25 + 0.125 - k / 7.0, 2) + pow(y * 0.25 + 0.125, 2) + pow(z * 0.25 + 0.125, 2) <= 0.25")


def _to_segment(p: list[str], a: list[str], d: list[str]) -> str:
    """The squared distance of a point to the segment from a along d."""
    t = f"least(1.0, greatest(0.0, ({_along(_minus(p, a), d)}) / ({_along(d, d)})))"
    return " + ".join(f"pow({x} - {y} - {t} * {z}, 2)" for x, y, z in zip(p, a, d))


_a, _b, _d = ["ax", "ay", "az"], ["bx", "by_", "bz"], ["dx", "dy", "dz"]
_zero, _one = ["0.0"] * 3, ["1.0"] * 3
oracle(
    "fl_34_segment_segment",
    f"""WITH {q.SEG}, w AS (SELECT *, bx - ax AS dx, by_ - ay AS dy, bz - az AS dz FROM seg), g AS (SELECT *, {_along(_d, _d)} AS a, {_along(_d, _one)} AS b, {_along(_d, _a)} AS c, {_along(_one, _a)} AS f FROM w), h AS (SELECT *, (b * f - 3 * c) / (3 * a - b * b) AS s FROM g), k AS (SELECT *, (b * s + f) / 3 AS t FROM h)
    SELECT id, round(least({_to_segment(_a, _zero, _one)}, {_to_segment(_b, _zero, _one)}, {_to_segment(_zero, _a, _d)}, {_to_segment(_one, _a, _d)}, CASE WHEN s BETWEEN 0 AND 1 AND t BETWEEN 0 AND 1 THEN {' + '.join(f'pow({x} + s * {y} - t, 2)' for x, y in zip(_a, _d))} ELSE 1e30 END), 6) + 0.0 AS d2 FROM k""",
)
