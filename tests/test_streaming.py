from pyspark.sql import functions as F

from voxelith.streaming import stateful


def run(df, name, mode="update"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def test_ring_and_occupancy(spark, tmp_path):
    scans = spark.createDataFrame([("a", i, [float(i)]) for i in range(7)], "sensor string, scan long, ranges array<double>")
    scans.coalesce(1).write.parquet(f"{tmp_path}/scans")
    stream = spark.readStream.schema(scans.schema).parquet(f"{tmp_path}/scans")
    got = run(stateful.scan_ring(stream, 3), "ring").collect()
    assert sorted(r["scan"] for r in got) == [4, 5, 6]
    hits = spark.createDataFrame([(0, 0, 0, True), (0, 0, 0, False), (1, 0, 0, False)], "ix int, iy int, iz int, occupied boolean")
    hits.coalesce(1).write.parquet(f"{tmp_path}/hits")
    stream = spark.readStream.schema(hits.schema).parquet(f"{tmp_path}/hits")
    got = {r["ix"]: round(r["prob_log"], 6) for r in run(stateful.occupancy(stream), "occupancy").collect()}
    assert got == {0: 0.45, 1: -0.4}


def test_windows(spark, tmp_path):
    df = spark.createDataFrame([(f"2024-01-01 00:0{i}:30", float(i)) for i in range(6)], "ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/events")
    got = run(stateful.windowed(stream, "ts", "value", "2 minutes", "1 minute"), "windows", "complete").collect()
    assert sorted((r["n"], r["mean"]) for r in got) == [(2, 0.5), (2, 2.5), (2, 4.5)]
