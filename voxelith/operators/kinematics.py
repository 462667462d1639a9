"""Kinematic chains: link poses from joint values."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..functions.linalg import rigid, rotation_from_axis_angle, rotation_x, rotation_y, rotation_z


def offset(xyz, rpy) -> np.ndarray:
    return rigid(rotation_z(rpy[2]) @ rotation_y(rpy[1]) @ rotation_x(rpy[0]), xyz)


def joint_motion(kind: str, axis, value: float) -> np.ndarray:
    axis = np.asarray(axis, float)
    size = np.linalg.norm(axis)
    unit = axis / size if size else axis
    if kind in ("revolute", "continuous"):
        return rigid(rotation_from_axis_angle(unit * value))
    if kind == "prismatic":
        return rigid(None, unit * value)
    return np.eye(4)


def forward(joints: DataFrame, root: str, values: dict[str, float], base: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Pose of each link below the root; a robot has few joints, so this runs on the driver. Joints without a value stand at their offset."""
    rows = joints.collect()
    out = {root: np.eye(4) if base is None else base}
    todo = [root]
    while todo:
        parent = todo.pop()
        for j in rows:
            if j["parent"] == parent and j["child"] not in out:
                m = offset(j["xyz"], j["rpy"])
                if j["name"] in values:
                    m = m @ joint_motion(j["type"], j["axis"], values[j["name"]])
                out[j["child"]] = out[parent] @ m
                todo.append(j["child"])
    return out
