"""Streams of scans and hits: state that the batch operators hold as tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.voxels import HIGH, HIT, KEYS, LOW, MISS
from ..plans.lineage import folder


def scan_ring(stream: DataFrame, capacity: int, key: str = "sensor") -> DataFrame:
    """For each batch and sensor the scans that a ring of so many holds: stream has key, scan, ranges (array); out: key, scan, ranges."""

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        for p in batches:
            held += [(int(s), [float(x) for x in r]) for s, r in zip(p["scan"], p["ranges"])]
        held = sorted(held, key=lambda x: x[0])[-capacity:]
        state.update(([s for s, _ in held], [r for _, r in held]))
        yield pd.DataFrame({key: [k[0]] * len(held), "scan": [s for s, _ in held], "ranges": [r for _, r in held]})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, scan long, ranges array<double>", "scans array<long>, ranges array<array<double>>", "update", GroupStateTimeout.NoTimeout)


def occupancy(stream: DataFrame) -> DataFrame:
    """Log-odds of each voxel after each batch of hits and misses (ix, iy, iz, occupied); within a batch misses come first."""

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hits = misses = 0
        for p in batches:
            n = int(p["occupied"].sum())
            hits, misses = hits + n, misses + len(p) - n
        p = state.get[0] if state.exists else 0.0
        p = min(HIGH, max(LOW, p + MISS * misses) + HIT * hits)
        state.update((p,))
        yield pd.DataFrame({**dict(zip(KEYS, ([v] for v in k))), "prob_log": [p]})

    return stream.groupBy(*KEYS).applyInPandasWithState(step, "ix int, iy int, iz int, prob_log double", "p double", "update", GroupStateTimeout.NoTimeout)


def distances(stream: DataFrame) -> DataFrame:
    """The running mean of each voxel's truncated distances (ix, iy, iz, tsdf) after each batch, and how many there were."""

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, n = state.get if state.exists else (0.0, 0)
        for p in batches:
            total, n = total + float(p["tsdf"].sum()), n + len(p)
        state.update((total, n))
        yield pd.DataFrame({**dict(zip(KEYS, ([v] for v in k))), "tsdf": [total / n], "weight": [float(n)]})

    return stream.groupBy(*KEYS).applyInPandasWithState(step, "ix int, iy int, iz int, tsdf double, weight double", "total double, n long", "update", GroupStateTimeout.NoTimeout)


def settled(updates: DataFrame, *keys: str) -> DataFrame:
    """The last row that a stream of updates had for each key once all its input was read: each batch goes to the checkpoint folder with its number."""
    spark = updates.sparkSession
    path = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    query = updates.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    query = query.foreachBatch(lambda df, number: df.withColumn("batch__", F.lit(number)).write.mode("append").parquet(f"{path}/rows")).start()
    query.awaitTermination()
    names = [f.name for f in updates.schema if f.name not in keys]
    try:
        rows = spark.read.parquet(f"{path}/rows")
    except AnalysisException:  # no input, no batch
        return spark.createDataFrame([], updates.schema)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*names), "batch__").alias("last"))
    return last.select(*keys, "last.*").select(*updates.columns)


def windowed(stream: DataFrame, time: str, value: str, width: str, late: str, *keys: str) -> DataFrame:
    """Number and mean of values in windows of event time; what is later than `late` is left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
