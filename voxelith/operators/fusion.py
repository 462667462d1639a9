"""Looking into signed distance volumes and fusing depth frames: trilinear values, normals, raycasting, and a pipeline of frames.

Volumes are the sparse frames of `volumes`; a cell that is absent has the value 0, as one that no image has seen.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.linalg import intrinsic_pyramid
from ..plans.lineage import cut
from ..plans.spatial import XYZ
from . import images, registration
from .points import NORMAL, transform
from .volumes import integrate, open_cells
from .voxels import KEYS

ORIGIN = (0.0, 0.0, 0.0)


def _corners(spots: DataFrame, size: float, origin: Sequence[float]) -> DataFrame:
    """Each spot with the eight cells around it and their trilinear weights (w__)."""
    place = {c: (F.col(c) - float(o)) / size - 0.5 for c, o in zip(XYZ, origin)}
    spots = spots.withColumns({f"{c}g__": e for c, e in place.items()})
    spots = spots.withColumns({f"{c}f__": F.floor(f"{c}g__").cast("int") for c in XYZ})
    share = {c: F.col(f"{c}g__") - F.col(f"{c}f__") for c in XYZ}
    cells = []
    for n in range(8):
        up = [n >> i & 1 for i in range(3)]
        w = F.lit(1.0)
        for c, u in zip(XYZ, up):
            w = w * (share[c] if u else 1 - share[c])
        cells.append(F.struct(*[(F.col(f"{c}f__") + u).alias(k) for c, k, u in zip(XYZ, KEYS, up)], w.alias("w__")))
    names = [c for c in spots.columns if not c.endswith("__")]
    return spots.withColumn("cell__", F.explode(F.array(*cells))).select(*names, "cell__.*")


def values_at(points: DataFrame, volume: DataFrame, size: float, origin: Sequence[float] = ORIGIN) -> DataFrame:
    """(id, value) of each point (id, x, y, z): the trilinear mean of the eight cells around it."""
    around = _corners(points.select("id", *XYZ), size, origin).join(volume.select(*KEYS, "tsdf"), KEYS)
    found = around.groupBy("id").agg(F.sum(F.col("w__") * F.col("tsdf")).alias("value"))
    return points.select("id").join(found, "id", "left").select("id", F.coalesce("value", F.lit(0.0)).alias("value"))


def normals_at(points: DataFrame, volume: DataFrame, size: float, origin: Sequence[float] = ORIGIN, gap: float = 0.99) -> DataFrame:
    """(id, nx, ny, nz): unit vectors of the differences of the values `gap` cells to both sides on each axis; null where all are 0."""
    sides = [F.struct(F.lit(i).alias("axis"), F.lit(float(s)).alias("side"), *[(F.col(c) + (s * gap * size if i == j else 0.0)).alias(c) for j, c in enumerate(XYZ)]) for i in range(3) for s in (-1, 1)]
    spots = points.select("id", F.explode(F.array(*sides)).alias("s")).select("id", "s.*")
    around = _corners(spots, size, origin).join(volume.select(*KEYS, "tsdf"), KEYS)
    part = F.col("side") * F.col("w__") * F.col("tsdf")
    sums = around.groupBy("id").agg(*[F.sum(F.when(F.col("axis") == i, part).otherwise(0.0)).alias(n) for i, n in enumerate(NORMAL)])
    norm = F.sqrt(sum((F.col(n) * F.col(n) for n in NORMAL), F.lit(0.0)))
    return points.select("id").join(sums, "id", "left").select("id", *[F.when(norm > 0, F.col(n) / norm).alias(n) for n in NORMAL])


def _span(o: Sequence[float], d: Sequence, low: Sequence[float], high: Sequence[float]) -> tuple:
    """Where a ray enters and leaves a box."""
    enter, leave = [], []
    for p, v, a, b in zip(o, d, low, high):
        inside = a <= p <= b
        x, y = (a - p) / F.nullif(v, F.lit(0.0)), (b - p) / F.nullif(v, F.lit(0.0))
        enter.append(F.when(v == 0, F.lit(-1e30 if inside else 1e30)).otherwise(F.least(x, y)))
        leave.append(F.when(v == 0, F.lit(1e30 if inside else -1e30)).otherwise(F.greatest(x, y)))
    return F.greatest(*enter), F.least(*leave)


def raycast(volume: DataFrame, k: np.ndarray, extrinsic: np.ndarray, width: int, height: int, size: float, trunc: float, origin: Sequence[float] = ORIGIN) -> DataFrame:
    """(v, u, x, y, z, nx, ny, nz): where the ray of each pixel first passes from before the surface to behind it; no row where none does, or where it first leaves it.

    Rays are looked at every half truncation from one cell behind where they enter the volume's box. The samples meet the cells in an equi-join; a crossing
    lies between neighbouring samples of unlike sign, by linear interpolation. Normals come from differences one cell to both sides.
    """
    spark = volume.sparkSession
    r = volume.agg(*[f(c).alias(f"{n}{c}") for c in KEYS for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if r[f"lo{KEYS[0]}"] is None:
        return spark.createDataFrame([], ", ".join(["v int", "u int", *[f"{c} double" for c in (*XYZ, *NORMAL)]]))
    low = [r[f"lo{c}"] * size + float(o) for c, o in zip(KEYS, origin)]
    high = [(r[f"hi{c}"] + 1) * size + float(o) for c, o in zip(KEYS, origin)]
    pose = np.linalg.inv(extrinsic)
    eye = [float(x) for x in pose[:3, 3]]
    rays = spark.range(width * height).select(F.expr(f"id div {width}").cast("int").alias("v"), (F.col("id") % width).cast("int").alias("u"))
    flat = [(F.col("u") - float(k[0, 2])) / float(k[0, 0]), (F.col("v") - float(k[1, 2])) / float(k[1, 1]), F.lit(1.0)]
    ray = [sum((float(pose[i, j]) * flat[j] for j in range(1, 3)), float(pose[i, 0]) * flat[0]) for i in range(3)]
    rays = rays.withColumns({f"r{c}": e for c, e in zip(XYZ, ray)}).withColumn("n", F.sqrt(sum((F.col(f"r{c}") * F.col(f"r{c}") for c in XYZ), F.lit(0.0))))
    rays = rays.withColumns({f"r{c}": F.col(f"r{c}") / F.col("n") for c in XYZ})
    enter, leave = _span(eye, [F.col(f"r{c}") for c in XYZ], low, high)
    step = trunc / 2
    rays = rays.withColumns({"from": F.greatest(enter, F.lit(0.0)) + size, "till": leave}).where("till > from")
    rays = cut(rays.select("v", "u", "rx", "ry", "rz", "from", "till"))  # plain columns from here on: the expressions would be repeated in each use
    samples = rays.withColumn("i", F.explode(F.sequence(F.lit(0), F.floor((F.col("till") - F.col("from")) / step).cast("int"))))
    at = F.col("from") + F.col("i") * step
    samples = samples.withColumns({key: F.floor((p + F.col(f"r{c}") * at - float(o)) / size).cast("int") for key, c, p, o in zip(KEYS, XYZ, eye, origin)})
    seen = samples.select("v", "u", "i", *KEYS).join(volume.select(*KEYS, "tsdf"), KEYS).select("v", "u", "i", "tsdf")
    before = Window.partitionBy("v", "u").orderBy("i")  # as many rows as a ray has samples
    seen = seen.withColumns({"i0": F.lag("i").over(before), "t0": F.lag("tsdf").over(before)}).where((F.col("i0") == F.col("i") - 1) & (F.col("t0") * F.col("tsdf") < 0))
    first = seen.groupBy("v", "u").agg(F.min(F.struct("i", "t0", "tsdf")).alias("c")).where("c.t0 > 0")
    along = F.col("from") + (F.col("c.i") - 1) * step - step * F.col("c.t0") / (F.col("c.tsdf") - F.col("c.t0"))
    hit = first.join(rays, ["v", "u"]).select("v", "u", *[(p + F.col(f"r{c}") * along).alias(c) for c, p in zip(XYZ, eye)])
    hit = cut(hit.withColumn("id", F.col("v").cast("long") * width + F.col("u")))
    return hit.join(normals_at(hit, volume, size, origin, 1.0), "id").where("nx is not null").select("v", "u", *XYZ, *NORMAL)


def frame_normals(cloud: DataFrame) -> DataFrame:
    """A cloud by pixels (v, u, x, y, z) with normals from the pixels to the right and below; points that lack one of these are left out. They face the camera."""
    out = cloud
    for name, dv, du in (("p", 0, 1), ("q", 1, 0)):
        out = out.join(cloud.select((F.col("v") - dv).alias("v"), (F.col("u") - du).alias("u"), *[F.col(c).alias(f"{name}{c}") for c in XYZ]), ["v", "u"])
    a, b = ([F.col(f"{s}{c}") - F.col(c) for c in XYZ] for s in "pq")
    n = [b[1] * a[2] - b[2] * a[1], b[2] * a[0] - b[0] * a[2], b[0] * a[1] - b[1] * a[0]]
    out = out.withColumns(dict(zip(NORMAL, n))).withColumn("n__", F.sqrt(sum((F.col(c) * F.col(c) for c in NORMAL), F.lit(0.0)))).where("n__ > 0")
    return out.select(*cloud.columns, *[(F.col(c) / F.col("n__")).alias(c) for c in NORMAL])


@dataclass
class Fusion:
    """Depth frames fused one after another: each is aligned with the surface so far, integrated, and the surface is looked at again from its pose.

    The state is the pose, the volume and the surface as seen last, each written to the checkpoint folder, so a lost executor costs no more than a frame.
    Cells are opened around the frame's points and along with those open before. Alignment always counts as a success.
    """

    k: np.ndarray
    width: int
    height: int
    size: float
    trunc: float
    levels: int = 4
    iterations: Sequence[int] = (20, 20, 20, 20)
    diameter: int = 1
    sigma_depth: float = 1.0
    sigma_space: float = 10.0
    cutoff: float = 3.0
    distance: float = 0.5
    origin: Sequence[float] = ORIGIN
    pose: np.ndarray = field(default_factory=lambda: np.eye(4))
    volume: DataFrame | None = None
    models: list[DataFrame] = field(default_factory=list)
    frames: int = 0

    def reset(self) -> None:
        self.pose, self.volume, self.models, self.frames = np.eye(4), None, [], 0

    def _level(self, i: int) -> tuple[np.ndarray, int, int]:
        return intrinsic_pyramid(self.k, i + 1)[i], self.width >> i, self.height >> i

    def surface(self, depth: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
        """The smoothed depths (img, v, u, c0) and the clouds (id, v, u, x, y, z, nx, ny, nz) of each level, the finest first."""
        smooth, clouds = [], []
        for i, (d, w, h) in enumerate(images.pyramid(depth.select(*images.KEY, "c0"), self.width, self.height, self.levels, smooth=False)):
            k, _, _ = self._level(i)
            soft = images.bilateral(d.where("c0 > 0"), w, h, self.diameter, self.sigma_depth, self.sigma_space)
            smooth.append(soft)
            points = images.back_project(soft, k, None, 1.0, self.cutoff)
            points = points.select("v", "u", *XYZ)
            clouds.append(frame_normals(points).withColumn("id", F.col("v").cast("long") * w + F.col("u")))
        return smooth, clouds

    def aligned(self, extrinsic: np.ndarray, clouds: list[DataFrame]) -> np.ndarray:
        """The extrinsic that takes the surface as seen last to the frame, coarse to fine, by distances to tangent planes."""
        for i in range(self.levels - 1, -1, -1):
            model = self.models[i].withColumn("id", F.col("v").cast("long") * (self.width >> i) + F.col("u"))
            extrinsic = registration.icp(model, clouds[i], self.distance, extrinsic, registration.PointToPlane(), self.iterations[i]).transformation
        return extrinsic

    def process(self, depth: DataFrame) -> np.ndarray:
        """Takes in a frame of depths (img, v, u, c0); returns the camera's pose."""
        smooth, clouds = self.surface(depth)
        clouds = [cut(c) for c in clouds]
        extrinsic = np.linalg.inv(self.pose)
        if self.frames:
            extrinsic = self.aligned(extrinsic, clouds)
            self.pose = np.linalg.inv(extrinsic)
        cells = open_cells(transform(clouds[0].select("id", *XYZ), self.pose), self.size, self.trunc, self.origin)
        if self.volume is not None:
            cells = cells.unionByName(self.volume.select(*KEYS)).distinct()
        pixels = smooth[0].select("v", "u", F.col("c0").alias("depth"))
        self.volume = cut(integrate(self.volume, cells, pixels, self.k, extrinsic, self.size, self.trunc, self.origin))
        self.models = []
        for i in range(self.levels):
            k, w, h = self._level(i)
            self.models.append(cut(raycast(self.volume, k, extrinsic, w, h, self.size, self.trunc, self.origin)))
        self.frames += 1
        return self.pose
