"""Spark readers and writers of point, mesh, voxel and image files.

Reading goes through Spark's binaryFile source, so any store that Spark reaches works, and each file is parsed by one task. A file holds one
cloud and its header the number of points, so writing gathers one cloud on the driver (as the formats demand), with rows in the order of id;
tables that don't fit there belong into Parquet.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import formats

CLOUD = "path string, id long, x double, y double, z double, nx double, ny double, nz double, r double, g double, b double"
CLOUD_COLUMNS = [c.split()[0] for c in CLOUD.split(", ")]


def _extension(path: str) -> str:
    return path.rsplit(".", 1)[-1].lower()


def cloud_of(path: str, data: bytes) -> dict[str, np.ndarray]:
    kind = _extension(path)
    if kind == "pcd":
        return formats.read_pcd(data)
    if kind == "ply":
        v = formats.read_ply(data)["vertex"]
        out = {c: v[c] for c in ("x", "y", "z", "nx", "ny", "nz") if c in v}
        if {"red", "green", "blue"} <= set(v):
            out |= {c: v[n] / 255 for c, n in zip("rgb", ("red", "green", "blue"))}
        return out
    raise ValueError(f"no reader for .{kind}")


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_point_cloud(spark: SparkSession, path: str | list[str], remove_nan: bool = True, remove_infinite: bool = True) -> DataFrame:
    """path, id (the place in its file), x, y, z, and normals and colours where files have them (else null)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for name, data in zip(p["path"], p["content"]):
                cols = cloud_of(name, bytes(data))
                n = len(cols["x"])
                yield pd.DataFrame({c: name if c == "path" else np.arange(n) if c == "id" else cols.get(c, np.full(n, None)) for c in CLOUD_COLUMNS}, index=range(n))

    out = _files(spark, path).mapInPandas(parse, CLOUD)
    for c in "xyz":
        if remove_nan:
            out = out.where(~F.isnan(c) & F.col(c).isNotNull())
        if remove_infinite:
            out = out.where(F.abs(c) != float("inf"))
    return out


def read_triangle_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and triangles of .ply, .stl and .obj files."""

    def load(name: str, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        kind = _extension(name)
        if kind == "obj":
            return formats.read_obj(data.decode("utf-8", "replace"))
        if kind == "stl":
            points, _ = formats.read_stl(data)
            return points.reshape(-1, 3), np.arange(3 * len(points)).reshape(-1, 3)
        if kind == "ply":
            found = formats.read_ply(data)
            p = np.stack([found["vertex"][c] for c in "xyz"], axis=1)
            faces = found.get("face", {})
            lists = faces.get("vertex_indices", faces.get("vertex_index", []))
            t = [tuple(int(f[k]) for k in x) for f in lists for x in ([(0, 1, 2)] if len(f) == 3 else formats.ear_clip(p[np.asarray(f, int)]))]
            return p, np.array(t, int).reshape(-1, 3)
        raise ValueError(f"no reader for .{kind}")

    def vertices(batches):
        for b in batches:
            for name, data in zip(b["path"], b["content"]):
                p, _ = load(name, bytes(data))
                yield pd.DataFrame({"path": name, "id": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]}, index=range(len(p)))

    def triangles(batches):
        for b in batches:
            for name, data in zip(b["path"], b["content"]):
                _, t = load(name, bytes(data))
                yield pd.DataFrame({"path": name, "tid": np.arange(len(t)), "v0": t[:, 0], "v1": t[:, 1], "v2": t[:, 2]}, index=range(len(t)))

    files = _files(spark, path)
    return files.mapInPandas(vertices, "path string, id long, x double, y double, z double"), files.mapInPandas(triangles, "path string, tid long, v0 long, v1 long, v2 long")


def read_image(spark: SparkSession, path: str) -> DataFrame:
    """Pixels (path, v, u, c0, c1, c2) of .png files."""

    def parse(batches):
        for b in batches:
            for name, data in zip(b["path"], b["content"]):
                a = formats.read_png(bytes(data))
                h, w, channels = a.shape
                v, u = np.divmod(np.arange(h * w), w)
                cols = {f"c{i}": a[..., i].reshape(-1).astype(float) if i < channels else np.full(h * w, None) for i in range(3)}
                yield pd.DataFrame({"path": name, "v": v, "u": u, **cols}, index=range(h * w))

    return _files(spark, path).mapInPandas(parse, "path string, v int, u int, c0 double, c1 double, c2 double")


def read_jpeg(spark: SparkSession, path: str) -> DataFrame:
    """Pixels (path, v, u, c0, c1, c2; red first) of .jpg files, by Spark's image source; gray ones have c0 only."""

    def parse(batches):
        for b in batches:
            for x in b.itertuples(index=False):
                a = np.frombuffer(bytes(x.data), np.uint8).reshape(x.height, x.width, x.nChannels)[:, :, ::-1]
                v, u = np.divmod(np.arange(x.height * x.width), x.width)
                cols = {f"c{i}": a[..., i].reshape(-1).astype(float) if i < x.nChannels else np.full(len(v), None) for i in range(3)}
                yield pd.DataFrame({"path": x.origin, "v": v, "u": u, **cols}, index=range(len(v)))

    images = spark.read.format("image").option("dropInvalid", True).load(path)
    return images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(parse, "path string, v int, u int, c0 double, c1 double, c2 double")


def _jpeg(spark: SparkSession, png: bytes, quality: int) -> bytes:
    """A picture coded anew by the driver's Java runtime."""
    jvm = spark._jvm
    io = jvm.javax.imageio
    out = jvm.java.io.ByteArrayOutputStream()
    writer = io.ImageIO.getImageWritersByFormatName("jpeg").next()
    how = writer.getDefaultWriteParam()
    how.setCompressionMode(io.ImageWriteParam.MODE_EXPLICIT)
    how.setCompressionQuality(quality / 100)
    stream = io.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, io.IIOImage(io.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(png))), None, None), how)
    stream.close()
    writer.dispose()
    return bytes(out.toByteArray())


def write_images(df: DataFrame, folder: str, width: int, height: int, kind: str = "png", depth: int = 8, quality: int = 90) -> None:
    """A file <img>.png or <img>.jpg for each image of a table (img, v, u, c0 [, c1, c2]); images are coded where their rows are and pass through the driver one at a time."""
    if kind not in ("png", "jpg"):
        raise ValueError(f"no writer for .{kind}")
    names = [c for c in ("c0", "c1", "c2") if c in df.columns]

    def code(p: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((height, width, len(names)), np.uint16 if depth == 16 else np.uint8)
        image[p["v"].to_numpy(int), p["u"].to_numpy(int)] = p[names].to_numpy()
        return pd.DataFrame({"img": [p["img"].iloc[0]], "data": [formats.write_png(image)]})

    for row in df.select("img", "v", "u", *names).groupBy("img").applyInPandas(code, "img long, data binary").toLocalIterator():
        data = bytes(row["data"])
        put(df.sparkSession, f"{folder}/{row['img']}.{kind}", data if kind == "png" else _jpeg(df.sparkSession, data, quality))


def write_jpeg(df: DataFrame, path: str, width: int, height: int, quality: int = 90) -> None:
    """One or three channels of 8 bits (v, u, c0 [, c1, c2])."""
    put(df.sparkSession, path, _jpeg(df.sparkSession, formats.write_png(_image(df, width, height, 8)), quality))


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes a file to any store that Spark reaches."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def _columns(df: DataFrame, names: list[str]) -> dict[str, np.ndarray]:
    rows = df.orderBy("id").select(*names).toPandas()
    return {c: rows[c].to_numpy(float) for c in names}


def write_point_cloud(df: DataFrame, path: str, ascii: bool = False, compressed: bool = False) -> None:
    names = [c for group in (("x", "y", "z"), ("nx", "ny", "nz"), ("r", "g", "b")) if set(group) <= set(df.columns) for c in group]
    cols = _columns(df, names)
    kind = _extension(path)
    if kind == "pcd":
        data = formats.write_pcd(cols, "ascii" if ascii else "binary_compressed" if compressed else "binary")
    elif kind == "ply":
        own = {c: v for c, v in cols.items() if c not in "rgb"}
        if "r" in cols:
            own |= {n: np.clip(np.round(cols[c] * 255), 0, 255) for c, n in zip("rgb", ("red", "green", "blue"))}
        data = formats.write_ply({"vertex": own}, ascii, {n: "u1" for n in ("red", "green", "blue")})
    else:
        raise ValueError(f"no writer for .{kind}")
    put(df.sparkSession, path, data)


def write_triangle_mesh(vertices: DataFrame, triangles: DataFrame, path: str, ascii: bool = False) -> None:
    """Vertex ids have to be 0, 1, 2 ..."""
    cols = _columns(vertices, ["x", "y", "z"])
    p = np.stack([cols[c] for c in "xyz"], axis=1)
    t = triangles.orderBy("tid").select("v0", "v1", "v2").toPandas().to_numpy(int)
    kind = _extension(path)
    if kind == "ply":
        data = formats.write_ply({"vertex": cols}, ascii, faces=t)
    elif kind == "obj":
        data = formats.write_obj(p, t).encode()
    elif kind == "stl":
        c = p[t]
        n = np.cross(c[:, 1] - c[:, 0], c[:, 2] - c[:, 0])
        size = np.linalg.norm(n, axis=1, keepdims=True)
        data = formats.write_stl(c, np.divide(n, size, out=np.zeros_like(n), where=size > 0))
    else:
        raise ValueError(f"no writer for .{kind}")
    put(vertices.sparkSession, path, data)


def write_image(df: DataFrame, path: str, width: int, height: int, depth: int = 8) -> None:
    put(df.sparkSession, path, formats.write_png(_image(df, width, height, depth)))


def _image(df: DataFrame, width: int, height: int, depth: int) -> np.ndarray:
    names = [c for c in ("c0", "c1", "c2") if c in df.columns]
    rows = df.select("v", "u", *names).toPandas()
    image = np.zeros((height, width, len(names)), np.uint16 if depth == 16 else np.uint8)
    image[rows["v"], rows["u"]] = rows[names].to_numpy()
    return image


def write_voxel_grid(df: DataFrame, path: str, size: float, origin=(0.0, 0.0, 0.0), ascii: bool = False) -> None:
    rows = df.orderBy("ix", "iy", "iz").select("ix", "iy", "iz", "r", "g", "b").toPandas()
    cols = {n: rows[c].to_numpy(float) for n, c in zip(("x", "y", "z"), ("ix", "iy", "iz"))} | {n: np.clip(np.round(rows[c].to_numpy(float) * 255), 0, 255) for n, c in zip(("red", "green", "blue"), "rgb")}
    head = {"origin": {c: np.array([v]) for c, v in zip("xyz", origin)}, "voxel_size": {"val": np.array([size])}}
    put(df.sparkSession, path, formats.write_ply(head | {"vertex": cols}, ascii, {n: "u1" for n in ("red", "green", "blue")}))


def read_voxel_grid(spark: SparkSession, path: str) -> tuple[DataFrame, float, tuple[float, ...]]:
    data = bytes(_files(spark, path).first()["content"])
    found = formats.read_ply(data)
    v = found["vertex"]
    rows = pd.DataFrame({"ix": v["x"].astype(int), "iy": v["y"].astype(int), "iz": v["z"].astype(int), **{c: v[n] / 255 for c, n in zip("rgb", ("red", "green", "blue"))}})
    return spark.createDataFrame(rows, "ix int, iy int, iz int, r double, g double, b double"), float(found["voxel_size"]["val"][0]), tuple(float(found["origin"][c][0]) for c in "xyz")


# Descriptions

CAMERA = "width int, height int, intrinsic_matrix array<double>"


def read_camera(spark: SparkSession, path: str) -> DataFrame:
    """Camera files: width, height and the 3 x 3 matrix, column by column."""
    return spark.read.schema(CAMERA).json(path, multiLine=True)


def matrix_of(values: list[float], size: int = 3) -> np.ndarray:
    return np.array(values, float).reshape(size, size).T


def read_trajectory(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, k, pose) of each block of five lines in a log."""

    def parse(batches):
        for b in batches:
            for data in b["content"]:
                w = bytes(data).decode().split()
                for a in range(0, len(w) - 18, 19):
                    yield pd.DataFrame({"i": [int(w[a])], "j": [int(w[a + 1])], "k": [int(w[a + 2])], "pose": [[float(x) for x in w[a + 3 : a + 19]]]})

    return _files(spark, path).mapInPandas(parse, "i int, j int, k int, pose array<double>")


def read_urdf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Links (name) and joints (name, type, parent, child, xyz, rpy, axis) of a robot description."""
    root = ET.fromstring(bytes(_files(spark, path).first()["content"]))
    three = lambda e, name, default: [float(x) for x in (e.get(name) if e is not None and e.get(name) else default).split()]
    links = [(x.get("name"),) for x in root.findall("link")]
    joints = [(j.get("name"), j.get("type"), j.find("parent").get("link"), j.find("child").get("link"), three(j.find("origin"), "xyz", "0 0 0"), three(j.find("origin"), "rpy", "0 0 0"), three(j.find("axis"), "xyz", "1 0 0")) for j in root.findall("joint")]
    return spark.createDataFrame(links, "name string"), spark.createDataFrame(joints, "name string, type string, parent string, child string, xyz array<double>, rpy array<double>, axis array<double>")
