"""Row numbers and running sums over a whole table without sorting it in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _range_of(df: DataFrame, order: str) -> tuple[Column, int]:
    """A bucket number that grows with the order column; buckets hold about one input partition each."""
    parts = max(1, df.rdd.getNumPartitions())
    if parts == 1:
        return F.lit(0), 1
    cuts = df.agg(F.percentile_approx(order, [k / parts for k in range(1, parts)], 10000).alias("q")).first()["q"]
    bounds = sorted(set(cuts or []))
    if not bounds:
        return F.lit(0), 1
    powers = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    held = F.lit(bounds)
    at = F.aggregate(F.lit(powers), F.lit(0), lambda a, p: F.when((a + p <= len(bounds)) & (F.get(held, a + p - 1) <= F.col(order)), a + p).otherwise(a))
    return F.coalesce(at, F.lit(0)), len(bounds) + 1


def with_row_number(df: DataFrame, order: str, name: str = "row_number", *ties: str) -> DataFrame:
    """df with 0, 1, 2 ... in ascending order of a numeric column (then of `ties`)."""
    bucket, _ = _range_of(df, order)
    dealt = df.withColumn("bucket__", bucket)
    counts = sorted((r["bucket__"], r["n"]) for r in dealt.groupBy("bucket__").agg(F.count(F.lit(1)).alias("n")).collect())  # as many as input partitions
    before, total = {}, 0
    for b, n in counts:
        before[b] = total
        total += n
    base = F.create_map(*[F.lit(x) for p in before.items() for x in p])[F.col("bucket__")] if before else F.lit(0)
    own = F.row_number().over(Window.partitionBy("bucket__").orderBy(order, *ties))
    return dealt.withColumn(name, (base + own - 1).cast("long")).drop("bucket__")


def with_running_sum(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """df with the sum of value over all rows up to each, in ascending order of a unique numeric column."""
    bucket, _ = _range_of(df, order)
    dealt = df.withColumn("bucket__", bucket)
    sums = sorted((r["bucket__"], r["n"] or 0) for r in dealt.groupBy("bucket__").agg(F.sum(value).alias("n")).collect())
    before, total = {}, 0
    for b, n in sums:
        before[b] = total
        total += n
    base = F.create_map(*[F.lit(x) for p in before.items() for x in p])[F.col("bucket__")] if before else F.lit(0)
    own = F.sum(value).over(Window.partitionBy("bucket__").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn(name, base + own).drop("bucket__")
