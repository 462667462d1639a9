"""Connected components with DataFrame operations only.

Large-star and small-star rounds in turn: every node's neighbours are hung on the smallest one around, until nothing changes;
the number of rounds grows with the logarithm of the longest path. Each round pre-aggregates before it shuffles, joins by
node and is written to the shared folder, so hubs are split by skew joins and a lost executor costs no more than one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import saved


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for each node of the edges; component is the smallest node that can be reached.

    Edges with a null end and loops are ignored, repeated edges count once.
    """
    one = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    # hi > lo throughout
    flat = saved(one.select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct())
    state = None
    for _ in range(rounds):
        both = flat.unionByName(flat.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        # large star: larger neighbours are hung on the smallest node around u, u included
        # (what is joined is written first: an exchange right below a join can be split where a hub makes it skewed)
        least = saved(both.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("u"), F.least("m", "hi").alias("m")))
        large = saved(both.where("lo > hi").select(F.col("hi").alias("u"), F.col("lo").alias("v")).join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        # small star: smaller neighbours and u itself are hung on the smallest of them
        low = saved(large.groupBy("hi").agg(F.min("lo").alias("m")))
        small = large.join(low, "hi").select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo")))).alias("e")).select("e.hi", "e.lo").where("hi <> lo").distinct()
        flat = saved(small)
        now = flat.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = flat.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return flat.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
