"""Distances and intersection tests as column expressions; a point is a sequence of three columns or numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = Sequence[Column]


def dot(a: Point, b: Point) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def sub(a: Point, b: Point) -> list[Column]:
    return [x - y for x, y in zip(a, b)]


def cross(a: Point, b: Point) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def aabb_aabb(low0: Point, high0: Point, low1: Point, high1: Point) -> Column:
    out = F.lit(True)
    for a, b, c, d in zip(low0, high0, low1, high1):
        out = out & (a <= d) & (c <= b)
    return out


def point_aabb_squared(p: Point, low: Point, high: Point) -> Column:
    total = F.lit(0.0)
    for x, a, b in zip(p, low, high):
        g = F.greatest(a - x, F.lit(0.0), x - b)
        total = total + g * g
    return total


def sphere_aabb(center: Point, radius: Column, low: Point, high: Point) -> Column:
    return point_aabb_squared(center, low, high) <= radius * radius


def ray_aabb(p: Point, d: Point, low: Point, high: Point) -> Column:
    """The least parameter at which the ray is in the box; null if it misses."""
    enter, leave, ok = F.lit(0.0), F.lit(float("inf")), F.lit(True)
    for x, v, a, b in zip(p, d, low, high):
        t0, t1 = (a - x) / F.nullif(v, F.lit(0.0)), (b - x) / F.nullif(v, F.lit(0.0))
        enter, leave = F.greatest(enter, F.least(t0, t1)), F.least(leave, F.greatest(t0, t1))
        ok = ok & ((v != 0) | ((x >= a) & (x <= b)))
    return F.when(ok & (enter <= leave), enter)


def point_line(p: Point, a: Point, b: Point) -> Column:
    """Distance from the line through a and b."""
    u = sub(b, a)
    c = cross(sub(p, a), u)
    return F.sqrt(dot(c, c)) / F.sqrt(dot(u, u))


def point_plane(p: Point, a: Point, b: Point, c: Point) -> Column:
    """Signed distance from the plane through a, b and c."""
    n = cross(sub(b, a), sub(c, a))
    return dot(n, sub(p, a)) / F.sqrt(dot(n, n))


def segment_segment_squared(p0: Point, q0: Point, p1: Point, q1: Point) -> Column:
    """Least squared distance of two segments: the nearest of the free optimum, if it lies within both, and of the four ends to the other segment."""
    u, v, w = sub(q0, p0), sub(q1, p1), sub(p0, p1)
    a, b, c, d, e = dot(u, u), dot(u, v), dot(v, v), dot(u, w), dot(v, w)
    det = a * c - b * b
    s, t = (b * e - c * d) / F.nullif(det, F.lit(0.0)), (a * e - b * d) / F.nullif(det, F.lit(0.0))
    gap = [w[i] + s * u[i] - t * v[i] for i in range(3)]
    free = F.when((s >= 0) & (s <= 1) & (t >= 0) & (t <= 1), dot(gap, gap))
    ends = [point_segment_squared(p0, p1, q1), point_segment_squared(q0, p1, q1), point_segment_squared(p1, p0, q0), point_segment_squared(q1, p0, q0)]
    return F.least(free, *ends)


def point_segment_squared(p: Point, a: Point, b: Point) -> Column:
    u, w = sub(b, a), sub(p, a)
    t = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(w, u) / F.nullif(dot(u, u), F.lit(0.0)))), F.lit(0.0))
    gap = [w[i] - t * u[i] for i in range(3)]
    return dot(gap, gap)


def capsule_aabb(radius: Column, p: Point, d: Point, low: Point, high: Point, steps: int = 48) -> Column:
    """Whether a capsule around the segment from p to p + d meets a box.

    The squared distance from the box to the segment's points is convex in the parameter, so halving the interval by the slope's sign finds
    the least one; nothing grows with the number of steps.
    """
    keep = F.struct(*[F.struct(x.alias("p"), v.alias("d"), a.alias("a"), b.alias("b")).alias(f"k{i}") for i, (x, v, a, b) in enumerate(zip(p, d, low, high))])

    def bound(value: Column, use) -> Column:
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def gap(k: Column, t: Column) -> Column:
        """How far a coordinate lies beyond the box, with its sign."""
        x = k["p"] + t * k["d"]
        return F.when(x > k["b"], x - k["b"]).when(x < k["a"], x - k["a"]).otherwise(F.lit(0.0))

    def slope(s: Column, t: Column) -> Column:
        return sum((gap(s[f"k{i}"], t) * s[f"k{i}"]["d"] for i in range(1, 3)), gap(s["k0"], t) * s["k0"]["d"])

    def halved(s: Column, at: Column) -> Column:
        m = (at["l"] + at["h"]) / 2
        return bound(slope(s, m) > 0, lambda up: F.struct(F.when(up, at["l"]).otherwise(m).alias("l"), F.when(up, m).otherwise(at["h"]).alias("h")))

    def least(s: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("l"), F.lit(1.0).alias("h"))
        found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda at, _: halved(s, at), lambda at: (at["l"] + at["h"]) / 2)
        return bound(found, lambda t: sum((gap(s[f"k{i}"], t) * gap(s[f"k{i}"], t) for i in range(1, 3)), gap(s["k0"], t) * gap(s["k0"], t)))

    return bound(keep, least) <= radius * radius + 1e-12
