"""Axis-aligned and oriented boxes as plain values."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Box:
    low: tuple[float, ...]
    high: tuple[float, ...]

    @property
    def extent(self) -> np.ndarray:
        return np.subtract(self.high, self.low)

    @property
    def center(self) -> np.ndarray:
        return np.add(self.high, self.low) / 2

    @property
    def volume(self) -> float:
        return float(np.prod(self.extent))

    @property
    def empty(self) -> bool:
        return self.volume <= 0

    def translate(self, t, relative: bool = True) -> Box:
        shift = np.asarray(t, float) - (0 if relative else self.center)
        return Box(tuple(np.add(self.low, shift)), tuple(np.add(self.high, shift)))

    def scale(self, s: float, center: bool = True) -> Box:
        c = self.center if center else np.zeros(len(self.low))
        return Box(tuple((np.asarray(self.low) - c) * s + c), tuple((np.asarray(self.high) - c) * s + c))

    def rotate(self, r) -> Box:
        raise TypeError("an axis-aligned box can't be turned; make it an oriented one")

    def corners(self) -> np.ndarray:
        n = len(self.low)
        return np.array([[(self.high if c >> i & 1 else self.low)[i] for i in range(n)] for c in range(1 << n)])

    def percentage(self, p) -> np.ndarray:
        """Where in the box a point lies, 0 to 1 on each axis."""
        return (np.asarray(p) - self.low) / self.extent

    def __add__(self, other: Box) -> Box:
        if self.empty or other.empty:
            return other if self.empty else self
        return Box(tuple(np.minimum(self.low, other.low)), tuple(np.maximum(self.high, other.high)))

    def __str__(self) -> str:
        return f"[({', '.join(f'{v:.4f}' for v in self.low)}) - ({', '.join(f'{v:.4f}' for v in self.high)})]"


@dataclass(frozen=True)
class OrientedBox:
    center: np.ndarray
    rotation: np.ndarray
    extent: np.ndarray

    @staticmethod
    def of(box: Box) -> OrientedBox:
        return OrientedBox(box.center, np.eye(3), box.extent)

    @property
    def volume(self) -> float:
        return float(np.prod(self.extent))

    def translate(self, t, relative: bool = True) -> OrientedBox:
        return OrientedBox(np.asarray(t, float) + (self.center if relative else 0), self.rotation, self.extent)

    def scale(self, s: float, center: bool = True) -> OrientedBox:
        return OrientedBox(self.center if center else self.center * s, self.rotation, np.asarray(self.extent) * s)

    def rotate(self, r, center: bool = True) -> OrientedBox:
        return OrientedBox(self.center if center else r @ self.center, r @ self.rotation, self.extent)

    def corners(self) -> np.ndarray:
        signs = np.array([[1 if c >> i & 1 else -1 for i in range(3)] for c in range(8)]) / 2
        return self.center + (signs * self.extent) @ np.asarray(self.rotation).T

    def bounds(self) -> Box:
        reach = np.abs(self.rotation) @ np.asarray(self.extent) / 2
        return Box(tuple(self.center - reach), tuple(self.center + reach))


def box_box(a: OrientedBox, b: OrientedBox) -> bool:
    """Whether two boxes meet: no axis of either, and no cross product of two, separates them."""
    axes = [*np.asarray(a.rotation).T, *np.asarray(b.rotation).T]
    axes += [np.cross(x, y) for x in np.asarray(a.rotation).T for y in np.asarray(b.rotation).T]
    gap = np.asarray(b.center) - a.center
    for x in axes:
        if np.linalg.norm(x) < 1e-12:
            continue
        ra, rb = (np.abs(np.asarray(o.rotation).T @ x) @ np.asarray(o.extent) / 2 for o in (a, b))
        if abs(gap @ x) > ra + rb + 1e-12:
            return False
    return True


def triangle_box(triangle: np.ndarray, box: Box) -> bool:
    """Whether a triangle meets a box: neither the box's axes, nor the triangle's normal, nor cross products of edges separate them."""
    t = np.asarray(triangle, float) - box.center
    half, edges = box.extent / 2, np.roll(t, -1, axis=0) - t
    axes = [*np.eye(3), np.cross(edges[0], edges[1]), *(np.cross(e, x) for e in edges for x in np.eye(3))]
    for x in axes:
        p = t @ x
        if p.min() > np.abs(x) @ half or p.max() < -np.abs(x) @ half:
            return False
    return True


def triangle_triangle(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two triangles meet, also where they lie in one plane."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    ea, eb = np.roll(a, -1, axis=0) - a, np.roll(b, -1, axis=0) - b
    na, nb = np.cross(ea[0], ea[1]), np.cross(eb[0], eb[1])
    axes = [na, nb, *(np.cross(x, y) for x in ea for y in eb)]
    axes += [np.cross(na, x) for x in ea] + [np.cross(nb, x) for x in eb]
    for x in axes:
        if np.linalg.norm(x) < 1e-12:
            continue
        p, q = a @ x, b @ x
        if p.max() < q.min() - 1e-12 or q.max() < p.min() - 1e-12:
            return False
    return True


def triangles_boxes(triangles: np.ndarray, centers: np.ndarray, size: float) -> np.ndarray:
    """triangle_box for each triangle (n, 3, 3) and the cube about its centre (n, 3)."""
    t = triangles - centers[:, None, :]
    edges = np.roll(t, -1, axis=1) - t
    axes = [np.broadcast_to(x, centers.shape) for x in np.eye(3)] + [np.cross(edges[:, 0], edges[:, 1])] + [np.cross(edges[:, i], x) for i in range(3) for x in np.eye(3)]
    meet = np.ones(len(t), bool)
    for x in axes:
        p, reach = np.einsum("nij,nj->ni", t, x), np.abs(x).sum(1) * size / 2
        meet &= (p.min(1) <= reach) & (p.max(1) >= -reach)
    return meet


def triangles_triangles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """triangle_triangle for each pair of triangles (n, 3, 3)."""
    ea, eb = np.roll(a, -1, axis=1) - a, np.roll(b, -1, axis=1) - b
    na, nb = np.cross(ea[:, 0], ea[:, 1]), np.cross(eb[:, 0], eb[:, 1])
    axes = [na, nb, *(np.cross(ea[:, i], eb[:, j]) for i in range(3) for j in range(3))]
    axes += [np.cross(na, ea[:, i]) for i in range(3)] + [np.cross(nb, eb[:, i]) for i in range(3)]
    meet = np.ones(len(a), bool)
    for x in axes:
        p, q = np.einsum("nij,nj->ni", a, x), np.einsum("nij,nj->ni", b, x)
        apart = (p.max(1) < q.min(1) - 1e-12) | (q.max(1) < p.min(1) - 1e-12)
        meet &= ~apart | (np.linalg.norm(x, axis=1) < 1e-12)
    return meet
