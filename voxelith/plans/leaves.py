"""Points dealt to boxes of a bounded number of rows (the leaves of a k-d tree): nearest partners and whole neighbourhoods without a row for each pair within a radius.

The tree is made from a sample, which decides only where boxes end: every row goes to the leaf that its place leads to. Work within a leaf is done in numpy, in
blocks of PAIRS distances at most; distances are summed in the order of the axes, as column expressions do. Rows without a place (null, NaN) have no partners.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .lineage import cut

#: Rows of a leaf, levels of a tree at most, distances held at once, pairs that a group gives at most (about), and tasks at least where there are as many groups.
LEAF, DEEPEST, PAIRS, GIVEN = 1024, 14, 1 << 19, 1 << 20
TASKS = 96


@dataclass
class Tree:
    """Node i has the children 2 i + 1 (up to the cut) and 2 i + 2; rows end 2 ** depth leaves."""

    depth: int
    axis: np.ndarray
    cut: np.ndarray

    def leaf(self, p: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(p), np.int64), np.arange(len(p))
        for _ in range(self.depth):
            at = 2 * at + 1 + (p[rows, self.axis[at]] > self.cut[at])
        return (at - (2**self.depth - 1)).astype(np.int32)


def tree_of(sample: np.ndarray, depth: int) -> Tree:
    """Cuts at the sample's medians across the widest axis."""
    inner = 2**depth - 1
    axis, cuts, held = np.zeros(inner, np.int64), np.zeros(inner), {0: sample}
    for i in range(inner):
        p = held.pop(i)
        if len(p):
            axis[i] = a = int(np.ptp(p, axis=0).argmax())
            cuts[i] = np.median(p[:, a])
        up = p[:, axis[i]] > cuts[i]
        held[2 * i + 1], held[2 * i + 2] = p[~up], p[up]
    return Tree(depth, axis, cuts)


def places(table, names: Sequence[str]) -> np.ndarray:
    """(rows, axes) of an Arrow table or batch."""
    return np.stack([table[c].to_numpy() for c in names], axis=1)


def placed(names: Sequence[str]) -> Column:
    """Whether a row has a place."""
    ok = F.lit(True)
    for c in names:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c)
    return ok


def routed(df: DataFrame, tree: Tree, names: Sequence[str], name: str = "leaf__") -> DataFrame:
    """df with the leaf of each row."""
    if not tree.depth:
        return df.withColumn(name, F.lit(0))
    names = list(names)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.leaf(places(b, names)))], [*b.schema.names, name])

    return df.mapInArrow(run, StructType([*df.schema.fields]).add(name, IntegerType()))


def box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances (points, boxes); never more than to any point of the box, as it is rounded alike."""
    total = np.zeros((len(q), len(low)))
    for i in range(q.shape[1]):
        x = q[:, i, None]
        d = np.maximum(np.maximum(low[None, :, i] - x, x - high[None, :, i]), 0.0)
        total = d * d if i == 0 else total + d * d
    return total


def squares(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    total = None
    for i in range(q.shape[1]):
        d = q[:, i, None] - t[None, :, i]
        d *= d
        if total is None:
            total = d
        else:
            total += d
    return total


def best_of(q: np.ndarray, t: np.ndarray, k: int, r2: float, closed: bool, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, target, d2) by places in the arrays: the k nearest within the radius (and the query's own bound), ties to the target that comes first; queries in their order."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    step = max(1, PAIRS // max(1, len(t)))
    for s in range(0, len(q) if len(t) else 0, step):
        d2 = squares(q[s : s + step], t)
        far = ~(d2 <= r2 if closed else d2 < r2)
        if bound is not None:
            far |= ~(d2 <= bound[s : s + step, None])
        np.copyto(d2, np.inf, where=far)
        if k == 1:
            j = d2.argmin(axis=1)
            i = np.arange(len(d2))
            ok = ~far[i, j]
            i, j = i[ok], j[ok]
        else:
            if k < len(t):
                far |= d2 > np.partition(d2, k - 1, axis=1)[:, k - 1 : k]
            i, j = np.nonzero(~far)
            order = np.lexsort((j, d2[i, j], i))
            i, j = i[order], j[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            i, j = i[rank < k], j[rank < k]
        out.append((i + s, j, d2[i, j]))
    return tuple(np.concatenate(x) for x in zip(*out))


class Leaves:
    """A table of targets, dealt once: `rows` (t, t_ columns, leaf__), the tree, and each leaf's tight box."""

    def __init__(self, target: DataFrame, dims: Sequence[str], target_id: str = "id", keep: Sequence[str] = (), size: int | None = None):
        self.dims, self.keep = list(dims), list(keep)
        self.names = [f"t_{c}" for c in self.dims]
        rows = target.select(F.col(target_id).alias("t"), *[F.col(c).cast("double" if c in self.dims else target.schema[c].dataType).alias(f"t_{c}") for c in dict.fromkeys([*self.dims, *self.keep])])
        rows = rows.where(placed(self.names))
        self.count = rows.count()
        depth = min(DEEPEST, max(0, math.ceil(math.log2(max(1, self.count) / (size or LEAF)))))
        sample = np.zeros((0, len(self.dims)))
        if depth:
            share = min(1.0, 64 * 2**depth / self.count)
            sample = np.array([list(r) for r in rows.select(*self.names).sample(share, seed=7).collect()]).reshape(-1, len(self.dims))  # 64 rows for each leaf
        self.tree = tree_of(sample, depth)
        self.rows = routed(rows, self.tree, self.names)
        if depth:
            self.rows = cut(self.rows)
        lows, highs = ([f(c).alias(f"{n}{c}") for c in self.names] for n, f in (("lo", F.min), ("hi", F.max)))
        boxes = sorted(self.rows.groupBy("leaf__").agg(*lows, *highs).collect(), key=lambda r: r["leaf__"])  # one row for each leaf
        self.leaf = np.array([r["leaf__"] for r in boxes], np.int32)
        self.low, self.high = (np.array([[r[f"{n}{c}"] for c in self.names] for r in boxes]).reshape(-1, len(self.dims)) for n in ("lo", "hi"))

    def met(self, query: DataFrame, most: int, f: Callable, schema: StructType) -> DataFrame:
        """f(queries, targets) for groups of at most about `most` queries (with leaf__) of a leaf, beside the leaf's targets."""
        spark = query.sparkSession
        sizes = query.groupBy("leaf__").count().collect()  # one row for each leaf
        parts = [(r["leaf__"], -(-r["count"] // most)) for r in sizes]
        # a number of tasks that Spark keeps: by the size of what is read it would leave a few
        tasks = max(1, min(sum(n for _, n in parts), max(TASKS, int(spark.conf.get("spark.sql.shuffle.partitions")))))
        parts = spark.createDataFrame(parts, "leaf__ int, parts__ int")
        own = query.join(F.broadcast(parts), "leaf__").withColumn("part__", F.pmod(F.xxhash64("q"), F.col("parts__")).cast("int")).drop("parts__")
        other = self.rows.join(F.broadcast(parts), "leaf__").withColumn("part__", F.explode(F.sequence(F.lit(0), F.col("parts__") - 1))).drop("parts__")
        own, other = (x.repartition(tasks, "leaf__", "part__").groupBy("leaf__", "part__") for x in (own, other))
        return own.cogroup(other).applyInArrow(f, schema)


def k_nearest(query: DataFrame, target: DataFrame | Leaves, k: int, radius: float | None, dims: Sequence[str], query_id: str = "id", target_id: str = "id", keep_query: Sequence[str] = (), keep_target: Sequence[str] = (), closed: bool = False) -> DataFrame:
    """(q, t, d2, q_ and t_ columns): the k nearest targets of each query in each leaf that may have one of its k nearest within the radius (None: anywhere), ties by the lower id.

    A query's k-th partner in its own leaf bounds how far others can be; it is then looked for in the leaves that this reaches. What is shuffled grows with the
    queries, the targets and the pairs that are given, not with what lies within the radius.
    """
    import pyarrow as pa

    held = target if isinstance(target, Leaves) else Leaves(target, dims, target_id, keep_target)
    dims, names, qn = list(dims), held.names, [f"q_{c}" for c in dims]
    r2 = math.inf if radius is None else radius * radius
    closed = closed or radius is None
    most = max(256, min(20_000, GIVEN // k))
    q = query.select(F.col(query_id).alias("q"), *[F.col(c).cast("double" if c in dims else query.schema[c].dataType).alias(f"q_{c}") for c in dict.fromkeys([*dims, *keep_query])]).where(placed(qn))
    own = [f.name for f in q.schema.fields]
    leaf, low, high = held.leaf, held.low, held.high

    if held.tree.depth:

        def reach(a: pa.Table, b: pa.Table) -> pa.Table:
            p, bound = places(a, qn), np.full(a.num_rows, r2)
            i, _, d2 = best_of(p, places(b, names), k, r2, closed)
            last = np.flatnonzero(np.diff(i, append=-1)) if len(i) else i  # a query's last partner is its farthest
            full = np.bincount(i, minlength=len(p)) >= k
            far = np.zeros(len(p))
            far[i[last]] = d2[last]
            bound[full] = far[full]
            ends, found, step = [0], [], max(1, PAIRS // max(1, len(leaf)))
            for s in range(0, len(p), step):
                x, y = np.nonzero(box_distance(p[s : s + step], low, high) <= bound[s : s + step, None])
                found.append(leaf[y])
                ends.append(np.bincount(x, minlength=min(step, len(p) - s)))
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(ends[1:]) if found else np.zeros(0, np.int64))])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32), pa.int32()))
            return pa.table({**{c: a[c] for c in own}, "bound__": bound, "leaves__": lists})

        schema = StructType([*q.schema.fields]).add("bound__", "double").add("leaves__", ArrayType(IntegerType()))
        q = cut(held.met(routed(q, held.tree, qn), most, reach, schema))
        q = q.select(*own, "bound__", F.explode("leaves__").alias("leaf__"))
    else:
        q = q.withColumns({"bound__": F.lit(math.inf), "leaf__": F.lit(0)})
    kept_q, kept_t = [f"q_{c}" for c in keep_query], [f"t_{c}" for c in keep_target]

    def take(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("t") if b.num_rows else b
        i, j, d2 = best_of(places(a, qn), places(b, names), k, r2, closed, a["bound__"].to_numpy())
        a, b = a.select(["q", *kept_q]).take(pa.array(i)), b.select(["t", *kept_t]).take(pa.array(j))
        return pa.table({"q": a["q"], "t": b["t"], "d2": d2, **{c: a[c] for c in kept_q}, **{c: b[c] for c in kept_t}})

    schema = StructType().add("q", q.schema["q"].dataType).add("t", held.rows.schema["t"].dataType).add("d2", "double")
    for c in kept_q:
        schema = schema.add(c, q.schema[c].dataType)
    for c in kept_t:
        schema = schema.add(c, held.rows.schema[c].dataType)
    return held.met(q, most, take, schema)


def neighbourhoods(query: DataFrame, target: DataFrame, radius: float, f: Callable, schema: StructType | str, dims: Sequence[str], query_id: str = "id", keep_query: Sequence[str] = (), keep_target: Sequence[str] = ()) -> DataFrame:
    """f(queries, targets), two Arrow tables: groups of queries that lie together, beside all targets that any of them may have within the radius.

    A target goes to each group whose box, grown by the radius, holds it; a group holds no more than its queries and these targets.
    """
    dims, qn = list(dims), [f"q_{c}" for c in dims]
    held = Leaves(query, dims, query_id, keep_query, 4 * LEAF)  # of the queries: these are dealt, targets go to them
    tn = [f"t_{c}" for c in dims]
    t = target.select(F.col("id").alias("t"), *[F.col(c).cast("double" if c in dims else target.schema[c].dataType).alias(f"t_{c}") for c in dict.fromkeys([*dims, *keep_target])]).where(placed(tn))
    leaf, low, high, r2 = held.leaf, held.low, held.high, radius * radius

    def reached(batches):
        import pyarrow as pa

        for b in batches:
            p, step = places(b, tn), max(1, PAIRS // max(1, len(leaf)))
            for s in range(0, len(p), step):
                i, j = np.nonzero(box_distance(p[s : s + step], low, high) <= r2)
                part = b.slice(s, step).take(pa.array(i))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaf[j], pa.int32())], [*b.schema.names, "leaf__"])

    t = t.mapInArrow(reached, StructType([*t.schema.fields]).add("leaf__", IntegerType()))
    own = held.rows.select(F.col("t").alias("q"), *[F.col(c).alias("q" + c[1:]) for c in held.rows.columns if c.startswith("t_")], "leaf__")
    tasks = max(1, min(len(leaf), max(TASKS, int(query.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    own, t = (x.repartition(tasks, "leaf__").groupBy("leaf__") for x in (own, t))
    return own.cogroup(t).applyInArrow(f, schema)
