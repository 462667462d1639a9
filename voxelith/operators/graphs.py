"""Graphs: nodes (id, x, y, z) and edges (src, dst, weight); an undirected graph has each edge in both directions."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import components as connected
from ..plans.lineage import cut
from ..plans.spatial import XYZ, cell, radius_join, squared_distance


def both_ways(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])
    return edges.unionByName(back).dropDuplicates(["src", "dst"])


def add_edges(edges: DataFrame, more: DataFrame, weight: float = 1.0, directed: bool = False) -> DataFrame:
    """Edges with others added (weight 1 unless they have one); an edge that is there keeps its weight."""
    new = more if "weight" in more.columns else more.withColumn("weight", F.lit(weight))
    new = new.select("src", "dst", "weight") if directed else both_ways(new.select("src", "dst", "weight"))
    return edges.unionByName(new.join(edges.select("src", "dst"), ["src", "dst"], "left_anti"))


def remove_edges(edges: DataFrame, gone: DataFrame, directed: bool = False) -> DataFrame:
    listed = gone.select("src", "dst") if directed else both_ways(gone.select("src", "dst"))
    return edges.join(listed, ["src", "dst"], "left_anti")


def set_edge_weights(edges: DataFrame, chosen: DataFrame, weight: float, directed: bool = False) -> DataFrame:
    listed = (chosen.select("src", "dst").distinct() if directed else both_ways(chosen.select("src", "dst"))).withColumn("new__", F.lit(float(weight)))
    return edges.join(listed, ["src", "dst"], "left").select("src", "dst", F.coalesce("new__", "weight").alias("weight"))


def ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with their ends' places x0 .. z0 and x1 .. z1."""
    for side, n in (("src", "0"), ("dst", "1")):
        edges = edges.join(nodes.select(F.col("id").alias(side), *[F.col(c).alias(c + n) for c in XYZ]), side)
    return edges


def length():
    return F.sqrt(sum(((F.col(f"{c}0") - F.col(f"{c}1")) * (F.col(f"{c}0") - F.col(f"{c}1")) for c in XYZ), F.lit(0.0)))


def weights_from_distance(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return ends(edges.select("src", "dst"), nodes).select("src", "dst", length().alias("weight"))


def max_line_length(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return ends(edges.select("src", "dst"), nodes).agg(F.max(length()).alias("length"))


def connect_to_nearest_neighbors(edges: DataFrame, nodes: DataFrame, distance: float, most: int = 30) -> DataFrame:
    """Edges with those added from each node to at most so many nearest others within the distance; the weight is the distance."""
    near = radius_join(nodes, nodes, distance, max_nn=most + 1).where("q <> t")
    new = near.select(F.col("q").alias("src"), F.col("t").alias("dst"), F.sqrt("d2").alias("weight"))
    return edges.unionByName(new.join(edges.select("src", "dst"), ["src", "dst"], "left_anti"))


def add_node_and_connect(edges: DataFrame, nodes: DataFrame, node_id: int, place: Sequence[float], distance: float) -> DataFrame:
    d = F.sqrt(sum(((F.col(c) - float(v)) * (F.col(c) - float(v)) for c, v in zip(XYZ, place)), F.lit(0.0)))
    new = nodes.where(d < distance).select(F.lit(node_id).cast("long").alias("src"), F.col("id").alias("dst"), d.alias("weight"))
    return edges.unionByName(both_ways(new))


def csr_offsets(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, degree, offset): how many edges leave each node, and how many leave those before it."""
    from ..plans.ranking import with_running_sum

    degree = nodes.select("id").join(edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree")), "id", "left").na.fill({"degree": 0})
    return with_running_sum(degree, "id", "degree", "upto").select("id", "degree", (F.col("upto") - F.col("degree")).alias("offset"))


def shortest_paths(edges: DataFrame, start: int, end: int | None = None, rounds: int = 10_000) -> DataFrame:
    """(id, dist, prev) of each node that can be reached, by relaxing the edges of what changed until nothing does.

    Of equally short ways the one over the lower node counts. With an end, what is no nearer than the end is not followed.
    """
    spark = edges.sparkSession
    edges = edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")).persist()
    known = spark.createDataFrame([(start, 0.0, -1)], "id long, dist double, prev long")
    front = known
    for _ in range(rounds):
        bound = None if end is None else known.where(F.col("id") == end).agg(F.min("dist")).first()[0]
        ahead = front if bound is None else front.where(F.col("dist") < bound)
        step = ahead.join(edges, ahead["id"] == edges["src"]).groupBy(F.col("dst").alias("id")).agg(F.min(F.struct((F.col("dist") + F.col("weight")).alias("dist"), F.col("src").alias("prev"))).alias("b")).select("id", "b.dist", "b.prev")
        old = known.select("id", F.col("dist").alias("old__"))
        front = cut(step.where(F.col("dist") < float("inf")).join(old, "id", "left").where(F.col("old__").isNull() | (F.col("dist") < F.col("old__"))).select("id", "dist", "prev"))
        if front.isEmpty():
            edges.unpersist()
            return known
        known = cut(known.unionByName(front).groupBy("id").agg(F.min(F.struct("dist", "prev")).alias("b")).select("id", "b.dist", "b.prev"))
    raise RuntimeError("the paths did not settle")


def shortest_path(edges: DataFrame, start: int, end: int) -> tuple[list[int], float]:
    """Nodes from start to end and the length; no nodes and infinity if there is no way."""
    found = cut(shortest_paths(edges, start, end))
    last = found.where(F.col("id") == end).first()
    if last is None:
        return [], float("inf")
    # jumps of 1, 2, 4 ... nodes back, until the end's leads out of the path: as many joins as the logarithm of the path's length
    jumps = [found.where("prev <> -1").select("id", "prev")]
    while True:
        step = jumps[-1]
        far = cut(step.join(step.select(F.col("id").alias("prev"), F.col("prev").alias("further")), "prev").select("id", F.col("further").alias("prev")))
        if far.where(F.col("id") == end).isEmpty():
            break
        jumps.append(far)
    on = edges.sparkSession.createDataFrame([(end,)], "id long")
    for jump in jumps[::-1]:
        on = cut(on.unionByName(jump.join(on, "id", "left_semi").select(F.col("prev").alias("id"))).distinct())
    before = {r["id"]: r["prev"] for r in found.join(on, "id", "left_semi").collect()}  # the path itself, which is the result
    path, now = [end], before[end]
    while now != -1:
        path.append(now)
        now = before[now]
    return path[::-1], last["dist"]


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id that can be reached."""
    found = connected(edges, "src", "dst").select(F.col("node").alias("id"), "component")
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _core_components(core: DataFrame, near: DataFrame, eps: float) -> DataFrame:
    """(id, component) of core points: chains of steps shorter than eps, without a row for each pair within eps.

    Cells are so small that all points of one are within eps of each other; its least point stands for it. Cells are joined along `near` (some pairs within eps), then
    only points of cells that are near each other and still in different components are compared.
    """
    keys = ["c0", "c1", "c2"]
    placed = core.withColumns(dict(zip(keys, cell(XYZ, 0.999 * eps / 3**0.5))))
    placed = cut(placed.join(placed.groupBy(*keys).agg(F.min("id").alias("rep")), keys))
    reps = placed.select("id", "rep")
    steps = near.join(reps.select(F.col("id").alias("src"), F.col("rep").alias("a")), "src").join(reps.select(F.col("id").alias("dst"), F.col("rep").alias("b")), "dst")
    cells = placed.select(*keys, F.col("rep").alias("id")).distinct()
    found = components(cells, steps.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
    cells = cut(cells.join(found, "id"))
    beyond = F.array(*[F.struct(*[F.lit(o).alias(f"o{i}") for i, o in enumerate(step)]) for step in itertools.product(range(-2, 3), repeat=3)])
    other = cells.select(F.col("id").alias("b"), F.col("component").alias("dst"), *keys)
    around = cells.select(F.col("id").alias("a"), F.col("component").alias("src"), F.explode(beyond).alias("o"), *keys).withColumns({k: F.col(k) + F.col(f"o.o{i}") for i, k in enumerate(keys)})
    apart = around.join(other, keys).where("src < dst").select("a", "b", "src", "dst")
    sides = [placed.select(F.col("rep").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in XYZ]) for s in "ab"]
    links = apart.join(sides[0], "a").join(sides[1], "b").where(squared_distance(XYZ, "a_", "b_") < eps * eps).select("src", "dst").distinct()
    whole = components(cells.select(F.col("component").alias("id")).distinct(), links).withColumnRenamed("id", "first")
    of_cell = cells.select(F.col("id").alias("rep"), F.col("component").alias("first")).join(whole, "first")
    return placed.select("id", "rep").join(of_cell, "rep").select("id", "component")


def cluster_dbscan(points: DataFrame, eps: float, min_points: int) -> DataFrame:
    """(id, cluster): clusters of core points (at least min_points others within eps) and what is within eps of one; -1 for the rest.

    Clusters are numbered by their least core point, 0 first; a border point goes to the cluster of the least core id around; clusters
    with fewer than min_points points are noise.
    """
    # as many partners as tell a core point, and all of any other point; of two points in one place the other may stand for the point itself
    near = cut(radius_join(points, points, eps, max_nn=max(min_points, 1) + 1).where("q <> t").select(F.col("q").alias("src"), F.col("t").alias("dst")))
    core = cut(near.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_points).select(F.col("src").alias("id")))
    own = cut(_core_components(points.select("id", *XYZ).join(core, "id"), near, eps))
    border = near.join(own.select(F.col("id").alias("dst"), "component"), "dst").join(core.select(F.col("id").alias("src")), "src", "left_anti")
    border = border.groupBy(F.col("src").alias("id")).agg(F.min_by("component", "dst").alias("component"))
    placed = own.unionByName(border)
    sizes = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_points)
    from ..plans.ranking import with_row_number

    numbered = with_row_number(sizes.select("component"), "component", "cluster")
    found = placed.join(numbered, "component").select("id", "cluster")
    return points.select("id").join(found, "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"))
