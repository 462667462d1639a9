"""Point, mesh and image files as bytes: parsing and building with numpy. Spark sources in `files` use these on the workers."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

#: Type names of PLY headers.
PLY_TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}


@dataclass
class Element:
    name: str
    count: int
    #: (name, type) or (name, type of the count, type of the items)
    properties: list[tuple] = field(default_factory=list)


def ply_header(data: bytes) -> tuple[str, list[Element], int]:
    end = data.index(b"end_header")
    stop = data.index(b"\n", end) + 1
    kind, elements = "", []
    for line in data[:end].decode("ascii", "replace").splitlines():
        w = line.split()
        if not w:
            continue
        if w[0] == "format":
            kind = w[1]
        elif w[0] == "element":
            elements.append(Element(w[1], int(w[2])))
        elif w[0] == "property":
            elements[-1].properties.append((w[4], PLY_TYPES[w[2]], PLY_TYPES[w[3]]) if w[1] == "list" else (w[2], PLY_TYPES[w[1]]))
    if not data.startswith(b"ply") or kind not in ("ascii", "binary_little_endian", "binary_big_endian"):
        raise ValueError("not a PLY file")
    return kind, elements, stop


def read_ply(data: bytes) -> dict[str, dict[str, list | np.ndarray]]:
    """Columns by element; list properties are lists of arrays."""
    kind, elements, at = ply_header(data)
    out: dict[str, dict] = {}
    if kind == "ascii":
        lines = iter(data[at:].decode("ascii").splitlines())
        for e in elements:
            rows = []
            while len(rows) < e.count:
                if (w := next(lines).split()):
                    rows.append(w)
            cols: dict = {p[0]: [] for p in e.properties}
            for w in rows:
                i = 0
                for p in e.properties:
                    if len(p) == 2:
                        cols[p[0]].append(float(w[i]))
                        i += 1
                    else:
                        n = int(w[i])
                        cols[p[0]].append(np.array(w[i + 1 : i + 1 + n], float))
                        i += 1 + n
            out[e.name] = {p[0]: np.array(cols[p[0]]) if len(p) == 2 else cols[p[0]] for p in e.properties}
        return out
    order = "<" if kind == "binary_little_endian" else ">"
    for e in elements:
        if all(len(p) == 2 for p in e.properties):
            kind_ = np.dtype([(p[0], order + p[1]) for p in e.properties])
            rows = np.frombuffer(data, kind_, e.count, at)
            at += kind_.itemsize * e.count
            out[e.name] = {p[0]: rows[p[0]].astype(float) for p in e.properties}
            continue
        cols = {p[0]: [] for p in e.properties}
        for _ in range(e.count):
            for p in e.properties:
                if len(p) == 2:
                    cols[p[0]].append(float(np.frombuffer(data, order + p[1], 1, at)[0]))
                    at += np.dtype(p[1]).itemsize
                else:
                    n = int(np.frombuffer(data, order + p[1], 1, at)[0])
                    at += np.dtype(p[1]).itemsize
                    cols[p[0]].append(np.frombuffer(data, order + p[2], n, at).astype(float))
                    at += np.dtype(p[2]).itemsize * n
        out[e.name] = {p[0]: np.array(cols[p[0]]) if len(p) == 2 else cols[p[0]] for p in e.properties}
    return out


def write_ply(elements: dict[str, dict[str, np.ndarray]], ascii: bool = False, kinds: dict[str, str] | None = None, faces: np.ndarray | None = None) -> bytes:
    """elements: columns by element; doubles unless `kinds` names another type; faces: rows of vertex numbers."""
    kinds = kinds or {}
    back = {"f8": "double", "f4": "float", "u1": "uchar", "i4": "int"}
    head = ["ply", f"format {'ascii' if ascii else 'binary_little_endian'} 1.0"]
    for name, cols in elements.items():
        head.append(f"element {name} {len(next(iter(cols.values()), []))}")
        head += [f"property {back[kinds.get(c, 'f8')]} {c}" for c in cols]
    if faces is not None:
        head += [f"element face {len(faces)}", "property list uchar int vertex_indices"]
    out = ["\n".join([*head, "end_header", ""]).encode()]
    for cols in elements.values():
        kind = np.dtype([(c, "<" + kinds.get(c, "f8")) for c in cols])
        rows = np.empty(len(next(iter(cols.values()), [])), kind)
        for c, v in cols.items():
            rows[c] = v
        out.append("".join(" ".join(repr(x) for x in row.tolist()) + "\n" for row in rows).encode() if ascii else rows.tobytes())
    if faces is not None:
        if ascii:
            out.append("".join(f"{len(f)} {' '.join(map(str, f))}\n" for f in np.asarray(faces, int).tolist()).encode())
        else:
            rows = np.empty(len(faces), np.dtype([("n", "u1"), ("v", "<i4", (3,))]))
            rows["n"], rows["v"] = 3, faces
            out.append(rows.tobytes())
    return b"".join(out)


# PCD


def pcd_header(data: bytes) -> tuple[dict[str, list[str]], int]:
    found: dict[str, list[str]] = {}
    at = 0
    while True:
        stop = data.index(b"\n", at)
        line = data[at:stop].decode("ascii", "replace").strip()
        at = stop + 1
        if line and not line.startswith("#"):
            w = line.split()
            found[w[0].upper()] = w[1:]
            if w[0].upper() == "DATA":
                break
    found.setdefault("COUNT", ["1"] * len(found["FIELDS"]))
    if not {"x", "y", "z"} <= set(found["FIELDS"]):
        raise ValueError("a cloud needs x, y and z")
    return found, at


def lzf_decompress(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        c = data[i]
        i += 1
        if c < 32:  # a run of plain bytes
            out += data[i : i + c + 1]
            i += c + 1
            continue
        n = c >> 5
        if n == 7:
            n += data[i]
            i += 1
        start = len(out) - ((c & 31) << 8) - data[i] - 1
        i += 1
        for k in range(n + 2):  # may overlap what it writes
            out.append(out[start + k])
    if len(out) != size:
        raise ValueError("the compressed part is damaged")
    return bytes(out)


def lzf_compress(data: bytes) -> bytes:
    out, plain, seen, i = bytearray(), bytearray(), {}, 0

    def flush():
        for k in range(0, len(plain), 32):
            part = plain[k : k + 32]
            out.append(len(part) - 1)
            out.extend(part)
        plain.clear()

    while i < len(data):
        key = data[i : i + 3]
        j = seen.get(key, -1) if len(key) == 3 else -1
        seen[key] = i
        if j >= 0 and i - j <= 8192:
            n = 3
            while n < 264 and i + n < len(data) and data[i + n] == data[j + n]:
                n += 1
            flush()
            back = i - j - 1
            if n - 2 < 7:
                out.append((n - 2) << 5 | back >> 8)
            else:
                out += bytes([7 << 5 | back >> 8, n - 2 - 7])
            out.append(back & 255)
            i += n
        else:
            plain.append(data[i])
            i += 1
    flush()
    return bytes(out)


def packed_rgb(value: np.ndarray) -> dict[str, np.ndarray]:
    """Colours of packed 32-bit values (the bytes b, g, r from the lowest)."""
    v = value.astype("<u4")
    return {"r": (v >> 16 & 255) / 255, "g": (v >> 8 & 255) / 255, "b": (v & 255) / 255}


def read_pcd(data: bytes) -> dict[str, np.ndarray]:
    """x, y, z and where present nx, ny, nz and r, g, b."""
    head, at = pcd_header(data)
    n = int(head["POINTS"][0])
    names = head["FIELDS"]
    types = [{"F": "f", "I": "i", "U": "u"}[t] + s for t, s in zip(head["TYPE"], head["SIZE"])]
    counts = [int(c) for c in head["COUNT"]]
    kind = head["DATA"][0]
    cols: dict[str, np.ndarray] = {}
    if kind == "ascii":
        rows = [line.split() for line in data[at:].decode("ascii").splitlines() if line.strip()][:n]
        i = 0
        for name, t, c in zip(names, types, counts):
            cols[name] = np.array([w[i] for w in rows], float).astype(t) if rows else np.zeros(0, t)
            i += c
    elif kind == "binary":
        d = np.dtype([(name, "<" + t, (c,)) if c > 1 else (name, "<" + t) for name, t, c in zip(names, types, counts)])
        rows = np.frombuffer(data, d, n, at)
        cols = {name: rows[name] for name in names}
    elif kind == "binary_compressed":
        small, big = struct.unpack_from("<II", data, at)
        raw, i = lzf_decompress(data[at + 8 : at + 8 + small], big), 0
        for name, t, c in zip(names, types, counts):
            cols[name] = np.frombuffer(raw, "<" + t, n * c, i)
            i += n * c * np.dtype(t).itemsize
    else:
        raise ValueError(f"unknown kind of data: {kind}")
    out = {c: np.asarray(cols[c], float) for c in "xyz"}
    for own, name in (("nx", "normal_x"), ("ny", "normal_y"), ("nz", "normal_z")):
        if name in cols:
            out[own] = np.asarray(cols[name], float)
    for name in ("rgb", "rgba"):
        if name in cols:
            v = cols[name]
            out |= packed_rgb(v.astype("<f4").view("<u4") if v.dtype.kind == "f" else v)
    return out


def write_pcd(cols: dict[str, np.ndarray], kind: str = "binary") -> bytes:
    n = len(cols["x"])
    out = {c: np.asarray(cols[c], "<f4") for c in "xyz"}
    if "nx" in cols:
        out |= {name: np.asarray(cols[own], "<f4") for own, name in (("nx", "normal_x"), ("ny", "normal_y"), ("nz", "normal_z"))}
    if "r" in cols:
        r, g, b = (np.clip(np.round(np.asarray(cols[c], float) * 255), 0, 255).astype("<u4") for c in "rgb")
        out["rgb"] = (r << 16 | g << 8 | b).astype("<u4").view("<f4")
    names = list(out)
    head = ["# .PCD v0.7", "VERSION 0.7", "FIELDS " + " ".join(names), "SIZE" + " 4" * len(names), "TYPE" + " F" * len(names), "COUNT" + " 1" * len(names), f"WIDTH {n}", "HEIGHT 1", "VIEWPOINT 0 0 0 1 0 0 0", f"POINTS {n}", f"DATA {kind}", ""]
    start = "\n".join(head).encode()
    if kind == "ascii":
        return start + "".join(" ".join(repr(float(out[c][i])) for c in names) + "\n" for i in range(n)).encode()
    if kind == "binary":
        rows = np.empty(n, np.dtype([(c, "<f4") for c in names]))
        for c in names:
            rows[c] = out[c]
        return start + rows.tobytes()
    raw = b"".join(out[c].tobytes() for c in names)
    small = lzf_compress(raw)
    return start + struct.pack("<II", len(small), len(raw)) + small


# Meshes


def read_stl(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Corner points (n, 3, 3) and normals of a binary file."""
    n = struct.unpack_from("<I", data, 80)[0]
    rows = np.frombuffer(data, np.dtype([("normal", "<f4", (3,)), ("points", "<f4", (3, 3)), ("more", "<u2")]), n, 84)
    return rows["points"].astype(float), rows["normal"].astype(float)


def write_stl(points: np.ndarray, normals: np.ndarray) -> bytes:
    rows = np.zeros(len(points), np.dtype([("normal", "<f4", (3,)), ("points", "<f4", (3, 3)), ("more", "<u2")]))
    rows["points"], rows["normal"] = points, normals
    return b"\0" * 80 + struct.pack("<I", len(points)) + rows.tobytes()


def ear_clip(points: np.ndarray) -> list[tuple[int, int, int]]:
    """Triangles of a simple polygon in space."""
    left = list(range(len(points)))
    normal = np.zeros(3)
    for a, b in zip(points, np.roll(points, -1, axis=0)):
        normal += np.cross(a, b)
    out = []
    while len(left) > 3:
        for i, b in enumerate(left):
            a, c = left[i - 1], left[(i + 1) % len(left)]
            pa, pb, pc = points[a], points[b], points[c]
            if np.dot(np.cross(pb - pa, pc - pb), normal) <= 0:
                continue
            inside = False
            for k in left:
                if k not in (a, b, c):
                    p = points[k]
                    s = [np.dot(np.cross(q - o, p - o), normal) for o, q in ((pa, pb), (pb, pc), (pc, pa))]
                    inside |= min(s) >= 0
            if not inside:
                out.append((a, b, c))
                left.pop(i)
                break
        else:  # nothing to cut off: a fan of what is left
            out += [(left[0], left[i], left[i + 1]) for i in range(1, len(left) - 1)]
            return out
    return [*out, tuple(left)] if len(left) == 3 else out


def read_obj(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and triangles; larger faces are cut into triangles."""
    points, faces = [], []
    for line in text.splitlines():
        w = line.split()
        if w and w[0] == "v":
            points.append([float(x) for x in w[1:4]])
        elif w and w[0] == "f":
            i = [int(x.split("/")[0]) for x in w[1:]]
            faces.append([k - 1 if k > 0 else len(points) + k for k in i])
    p = np.array(points, float).reshape(-1, 3)
    triangles = [tuple(f[k] for k in t) for f in faces for t in ([(0, 1, 2)] if len(f) == 3 else ear_clip(p[f]))]
    return p, np.array(triangles, int).reshape(-1, 3)


def write_obj(points: np.ndarray, triangles: np.ndarray) -> str:
    return "".join(f"v {x!r} {y!r} {z!r}\n" for x, y, z in np.asarray(points, float).tolist()) + "".join(f"f {a + 1} {b + 1} {c + 1}\n" for a, b, c in np.asarray(triangles, int).tolist())


# Images


def read_png(data: bytes) -> np.ndarray:
    """(height, width, channels) of a gray or RGB image of 8 or 16 bits that isn't interlaced."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, packed, width, height, depth, kind = 8, [], 0, 0, 0, 0
    while at < len(data):
        n, tag = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        at += 12 + n
        if tag == b"IHDR":
            width, height, depth, kind, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if depth not in (8, 16) or kind not in (0, 2, 4, 6) or interlace:
                raise ValueError("only plain gray and RGB images are read")
        elif tag == b"IDAT":
            packed.append(body)
        elif tag == b"IEND":
            break
    channels, size = {0: 1, 2: 3, 4: 2, 6: 4}[kind], depth // 8
    step, stride = channels * size, width * channels * size
    raw = zlib.decompress(b"".join(packed))
    rows, above = np.empty((height, stride), np.uint8), np.zeros(stride, np.uint8)
    for y in range(height):
        how, line = raw[y * (stride + 1)], np.frombuffer(raw, np.uint8, stride, y * (stride + 1) + 1).copy()
        if how == 1:
            for x in range(step):
                line[x::step] = np.cumsum(line[x::step], dtype=np.uint8)
        elif how == 2:
            line += above
        elif how in (3, 4):
            for x in range(stride):
                a = int(line[x - step]) if x >= step else 0
                b, c = int(above[x]), int(above[x - step]) if x >= step else 0
                if how == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[x] = (int(line[x]) + guess) & 255
        rows[y] = above = line
    out = rows.reshape(height, width, channels, size)
    return out[..., 0] if size == 1 else out[..., 0].astype(np.uint16) << 8 | out[..., 1]


def write_png(image: np.ndarray) -> bytes:
    image = image if image.ndim == 3 else image[..., None]
    height, width, channels = image.shape
    size = image.dtype.itemsize
    raw = image.astype(">u2" if size == 2 else "u1").tobytes()
    stride = width * channels * size
    lines = b"".join(b"\0" + raw[y * stride : (y + 1) * stride] for y in range(height))

    def chunk(tag: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))

    head = struct.pack(">IIBBBBB", width, height, size * 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


# Messages


def read_point_message(data: bytes, fields: dict[str, int], step: int, dense: bool = True) -> dict[str, np.ndarray]:
    """Points of a packed message: fields maps x, y, z and perhaps rgb to their offsets in a row of `step` bytes.

    Rows that aren't finite become infinite, or are left out if the cloud is to be dense.
    """
    rows = np.frombuffer(data, np.uint8, len(data) // step * step).reshape(-1, step)
    take = lambda o, kind: np.ascontiguousarray(rows[:, o : o + 4]).view(kind)[:, 0]
    out = {c: take(fields[c], "<f4").astype(float) for c in "xyz"}
    if "rgb" in fields:
        out |= packed_rgb(take(fields["rgb"], "<u4"))
    ok = np.isfinite(out["x"]) & np.isfinite(out["y"]) & np.isfinite(out["z"])
    if dense:
        return {c: v[ok] for c, v in out.items()}
    for c in "xyz":
        out[c] = np.where(ok, out[c], np.inf)
    return out


def write_point_message(cols: dict[str, np.ndarray]) -> bytes:
    """x, y, z and one, then the packed colour at byte 16; 32 bytes a row."""
    n = len(cols["x"])
    rows = np.zeros(n, np.dtype({"names": ["x", "y", "z", "w", "rgb"], "formats": ["<f4"] * 4 + ["<u4"], "offsets": [0, 4, 8, 12, 16], "itemsize": 32}))
    for c in "xyz":
        rows[c] = cols[c]
    rows["w"] = 1
    if "r" in cols:
        r, g, b = (np.clip(np.round(np.asarray(cols[c], float) * 255), 0, 255).astype("<u4") for c in "rgb")
        rows["rgb"] = r << 16 | g << 8 | b
    return rows.tobytes()


def read_image_message(data: bytes, width: int, height: int, encoding: str) -> np.ndarray:
    """(height, width, 3) of a packed image, red first."""
    if encoding not in ("rgb8", "bgr8"):
        raise ValueError(f"unknown encoding: {encoding}")
    image = np.frombuffer(data, np.uint8, width * height * 3).reshape(height, width, 3)
    return image if encoding == "rgb8" else image[..., ::-1]


def write_image_message(image: np.ndarray, encoding: str = "rgb8") -> bytes:
    if encoding not in ("rgb8", "bgr8"):
        raise ValueError(f"unknown encoding: {encoding}")
    return np.ascontiguousarray(image if encoding == "rgb8" else image[..., ::-1]).tobytes()
