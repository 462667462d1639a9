"""Small dense linear algebra on the driver: matrices that become literals of column expressions."""

from __future__ import annotations

import numpy as np


def rotation_x(a: float) -> np.ndarray:
    c, s = np.cos(a), np.sin(a)
    return np.array([[1, 0, 0], [0, c, -s], [0, s, c]])


def rotation_y(a: float) -> np.ndarray:
    c, s = np.cos(a), np.sin(a)
    return np.array([[c, 0, s], [0, 1, 0], [-s, 0, c]])


def rotation_z(a: float) -> np.ndarray:
    c, s = np.cos(a), np.sin(a)
    return np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]])


def rotation_from_euler(order: str, angles) -> np.ndarray:
    """Product of axis rotations in the order named, for example "xyz"; one angle for each letter."""
    by_axis = {"x": rotation_x, "y": rotation_y, "z": rotation_z}
    out = np.eye(3)
    for axis, a in zip(order.lower(), angles):
        out = out @ by_axis[axis](a)
    return out


def rotation_from_axis_angle(v) -> np.ndarray:
    """Rodrigues: the vector's direction is the axis, its length the angle."""
    v = np.asarray(v, float)
    angle = np.linalg.norm(v)
    if angle == 0:
        return np.eye(3)
    k = cross_matrix(v / angle)
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * (k @ k)


def cross_matrix(v) -> np.ndarray:
    x, y, z = v
    return np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])


def rotation_from_quaternion(q) -> np.ndarray:
    """(w, x, y, z), normalised first."""
    w, *v = np.asarray(q, float) / np.linalg.norm(q)
    k = cross_matrix(v)
    return np.eye(3) + 2 * w * k + 2 * (k @ k)


def rigid(rotation=None, translation=(0, 0, 0)) -> np.ndarray:
    m = np.eye(4)
    m[:3, :3] = np.eye(3) if rotation is None else rotation
    m[:3, 3] = translation
    return m


def twist_to_matrix(v) -> np.ndarray:
    """(rotation vector, translation) to a 4 x 4 matrix."""
    return rigid(rotation_from_axis_angle(v[:3]), v[3:])


def matrix_to_twist(m) -> np.ndarray:
    r = np.asarray(m)[:3, :3]
    angle = np.arccos(np.clip((np.trace(r) - 1) / 2, -1, 1))
    if angle < 1e-12:
        axis = np.zeros(3)
    elif np.pi - angle < 1e-6:
        values, vectors = np.linalg.eigh((r + r.T) / 2)
        axis = vectors[:, np.argmax(values)] * angle
    else:
        axis = np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]]) * angle / (2 * np.sin(angle))
    return np.concatenate([axis, np.asarray(m)[:3, 3]])


def rotation_between_x_axis_and(v) -> np.ndarray:
    """A rotation that turns (1, 0, 0) into the direction of v; the identity if they are nearly opposite."""
    v = np.asarray(v, float) / np.linalg.norm(v)
    e = np.array([1.0, 0, 0])
    c = e @ v
    if c < -0.99:
        return np.eye(3)
    k = cross_matrix(np.cross(e, v))
    return np.eye(3) + k + k @ k / (1 + c)


def solve_psd(a: np.ndarray, b: np.ndarray, least_determinant: float | None = 1e-6) -> np.ndarray | None:
    """The solution of a x = b for a symmetric matrix; None if the determinant is too small or nothing finite comes out."""
    if least_determinant is not None and not abs(np.linalg.det(a)) > least_determinant:
        return None
    try:
        x = np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return None
    return x if np.isfinite(x).all() else None


def sqrt_symmetric(m: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(m)
    return (vectors * np.sqrt(np.maximum(values, 0))[..., None, :]) @ np.swapaxes(vectors, -1, -2)


def intrinsic_pyramid(k: np.ndarray, levels: int) -> list[np.ndarray]:
    """Camera matrices of images halved again and again; a pixel's centre keeps its place."""
    out = [np.asarray(k, float)]
    for _ in range(levels - 1):
        m = out[-1].copy()
        m[0, 0], m[1, 1] = m[0, 0] / 2, m[1, 1] / 2
        m[:2, 2] = (m[:2, 2] + 0.5) / 2 - 0.5
        out.append(m)
    return out


def kabsch(n: float, mean_p: np.ndarray, mean_q: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """The rigid motion that takes p nearest to q, from their means and the mean of p qT (not centred)."""
    h = cross - np.outer(mean_p, mean_q)
    u, _, vt = np.linalg.svd(h)
    d = np.sign(np.linalg.det(vt.T @ u.T)) or 1.0
    r = vt.T @ np.diag([1, 1, d]) @ u.T
    return rigid(r, mean_q - r @ mean_p)
