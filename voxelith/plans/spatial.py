"""Range joins as equi-joins on grid cells, nearest-neighbour joins over boxes of a bounded number of rows.

A target point has one cell; a query point looks into the cells around it. Cells are as wide as the radius, so all partners within the
radius are in the 3**d cells around, and the join is an ordinary hash or merge join that Spark can split where a cell is crowded.
Where only the nearest partners count, no row is made for the others (`leaves`).
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .leaves import Leaves, k_nearest

XYZ = ("x", "y", "z")
#: More partners than these are taken from all pairs.
MANY = 10_000


def cell(names: Sequence[str], size: float, prefix: str = "") -> list[Column]:
    return [F.floor(F.col(f"{prefix}{c}") / size).cast("long") for c in names]


def squared_distance(names: Sequence[str], a: str, b: str) -> Column:
    total = None
    for c in names:
        d = F.col(f"{a}{c}") - F.col(f"{b}{c}")
        total = d * d if total is None else total + d * d
    return total


def radius_join(query: DataFrame, target: DataFrame, radius: float, dims: Sequence[str] = XYZ, max_nn: int | None = None, query_id: str = "id", target_id: str = "id", keep_query: Sequence[str] = (), keep_target: Sequence[str] = (), closed: bool = False) -> DataFrame:
    """(q, t, d2): all targets nearer to a query than the radius (closed: or as near), itself included if it is in both tables; at most max_nn, the nearest first.

    Columns of keep_query and keep_target come along with prefixes q_ and t_.
    """
    dims = list(dims)
    if max_nn is not None and max_nn <= MANY:
        return nearest_of(k_nearest(query, target, max_nn, radius, dims, query_id, target_id, keep_query, keep_target, closed), max_nn)
    q = query.select(F.col(query_id).alias("q"), *[F.col(c).alias(f"q_{c}") for c in dict.fromkeys([*dims, *keep_query])])
    t = target.select(F.col(target_id).alias("t"), *[F.col(c).alias(f"t_{c}") for c in dict.fromkeys([*dims, *keep_target])])
    t = t.withColumns({f"c{i}": c for i, c in enumerate(cell(dims, radius, "t_"))})
    around = F.array(*[F.struct(*[F.lit(o).alias(f"o{i}") for i, o in enumerate(step)]) for step in itertools.product((-1, 0, 1), repeat=len(dims))])
    q = q.withColumn("o", F.explode(around))
    q = q.withColumns({f"c{i}": c + F.col(f"o.o{i}") for i, c in enumerate(cell(dims, radius, "q_"))}).drop("o")
    d2 = squared_distance(dims, "q_", "t_")
    near = d2 <= radius * radius if closed else d2 < radius * radius
    found = q.join(t, [f"c{i}" for i in range(len(dims))]).where(near).withColumn("d2", d2)
    keep = ["q", "t", "d2", *[f"q_{c}" for c in keep_query], *[f"t_{c}" for c in keep_target]]
    found = found.select(*keep)
    return found if max_nn is None else nearest_of(found, max_nn)


def nearest_of(pairs: DataFrame, k: int) -> DataFrame:
    """The k pairs of each q with the least d2, then the least t."""
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d2", "t"))
    return pairs.withColumn("rank__", rank).where(F.col("rank__") <= k).drop("rank__")


def knn_join(query: DataFrame, target: DataFrame, k: int, dims: Sequence[str] = XYZ, query_id: str = "id", target_id: str = "id", keep_query: Sequence[str] = (), keep_target: Sequence[str] = ()) -> DataFrame:
    """(q, t, d2) of the k nearest targets of each query, ties by the lower id, itself included if it is in both tables. Fewer than k targets give fewer pairs."""
    if k < 1:
        raise ValueError("k has to be positive")
    return nearest_of(k_nearest(query, target, k, None, dims, query_id, target_id, keep_query, keep_target), k)


def nearest(query: DataFrame, target: DataFrame | Leaves, radius: float, dims: Sequence[str] = XYZ, **more) -> DataFrame:
    """(q, t, d2) of the nearest target within the radius. Targets of many calls may be given as Leaves, dealt once."""
    return nearest_of(k_nearest(query, target, 1, radius, dims, **more), 1)
