"""Queries see every row: against brute force over the whole table."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from voxelith import queries
from voxelith.functions import predicates
from voxelith.operators.boxes import Box, triangle_box, triangle_triangle
from voxelith.plans.spatial import XYZ

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return queries.queries()[name](spark, SF).collect()


def places(spark):
    return np.array([r[1:] for r in queries.Inputs(spark, SF).xyz.orderBy("id").collect()])


def test_points_in_threes(spark):
    p = places(spark)
    t = p[: len(p) // 3 * 3].reshape(-1, 3, 3)
    assert {tuple(r) for r in rows(spark, "fl_23_triangle_triangle")} == {(i, triangle_triangle(x, t[(i + 1) % len(t)])) for i, x in enumerate(t)}
    assert {tuple(r) for r in rows(spark, "fl_24_triangle_box")} == {(i, triangle_box(x, Box((-1, -1, -1), (1, 1, 1)))) for i, x in enumerate(t)}
    assert sorted(r["id"] for r in rows(spark, "fl_29_box_box")) == list(range(len(t)))


def test_triangles_of_the_mesh(spark):
    p = places(spark)
    t = [p[i : i + 3] for i in range(len(p) - 2)]
    met = {tuple(r) for r in rows(spark, "jn_23_self_intersections")}
    for i in (0, 100, len(t) - 40):
        assert {j for a, j in met if a == i} == {j for j in range(i + 3, len(t)) if triangle_triangle(t[i], t[j])}
    assert max(met)[0] >= 60
    # cells that a triangle only touches are left out
    low, size, half = p.min(0) - 0.25, 0.5, 0.25 - 1e-9
    # all cells of some triangles, and for some cells a triangle
    got = {tuple(r) for r in rows(spark, "io_55_voxelized_mesh")}
    cells = set()
    for x in t[:5] + t[-20:]:
        first, last = (np.floor((v - low) / size).astype(int) for v in (x.min(0), x.max(0)))
        for cell in itertools.product(*(range(a, b + 2) for a, b in zip(first, last))):
            at = np.array(cell) * size + low
            if cell not in cells and triangle_box(x, Box(tuple(at - half), tuple(at + half))):
                cells.add(tuple(map(int, cell)))
    assert cells <= got
    for cell in sorted(got)[::40]:
        at = np.array(cell) * size + low
        assert any(triangle_box(x, Box(tuple(at - size / 2), tuple(at + size / 2))) for x in t)


def test_capsules(spark):
    c = queries.Inputs(spark, SF)
    both = queries._segments(c).crossJoin(c.vox)
    low = [F.col(k) * 0.5 for k in ("ix", "iy", "iz")]
    hit = predicates.capsule_aabb(F.lit(0.2), [F.col(f"a{k}") for k in XYZ], [F.col(f"b{k}") - F.col(f"a{k}") for k in XYZ], low, [v + 0.5 for v in low])
    want = {}
    for i, *v in both.where(hit).select("id", "ix", "iy", "iz").collect():
        want[i] = min(want.get(i, tuple(v)), tuple(v))
    assert {r[0]: tuple(r[1:]) for r in rows(spark, "jn_17_voxel_capsules")} == want and max(want) >= 50
