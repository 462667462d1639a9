import hashlib
import random

from pyspark.sql import functions as F

from voxelith.llm import shards


def hashed(i, text):
    inner = hashlib.md5((text or "").encode()).hexdigest()
    return int(hashlib.md5(f"{'' if i is None else i}:{inner}".encode()).hexdigest()[:15], 16)


def brute(rows, limit):
    out = {}

    def split(own, prefix):
        if not own:
            return
        if sum(n for _, n in own) <= limit or len({h for h, _ in own}) == 1:
            for h, _ in own:
                out[h] = prefix
            return
        d = len(prefix)
        for bit in "01":
            split([x for x in own if f"{x[0]:060b}"[d] == bit], prefix + bit)

    split([(hashed(i, t), len((t or "").encode())) for i, t in rows], "")
    return out


def test_shards_are_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, "é" * rng.randrange(300)) for i in range(700)] + [(None, "n"), (900, None), (901, ""), (902, "x" * 50000)] + [(903, "same" * 100)] * 60
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Shard", F.lit("clash")).withColumn("depth__", F.lit(0)).repartition(4)
    for limit in (1 << 40, 20000, 900):
        placed, listed = shards.assign(df, limit)
        want = brute(rows, limit)
        got = placed.collect()
        assert len(got) == len(rows)
        for r in got:
            assert r["shard"] == want[hashed(r["doc_id"], r["text"])]
            assert r["n_bytes"] == len((r["text"] or "").encode())
        sums = {r["shard"]: (r["bytes"], r["rows"]) for r in listed.collect()}
        assert set(sums) == set(want.values())
        for s, (n, count) in sums.items():
            own = [r for r in got if r["shard"] == s]
            assert (n, count) == (sum(r["n_bytes"] for r in own), len(own))
            assert n <= limit or len({hashed(r["doc_id"], r["text"]) for r in own}) == 1


def test_empty_table_and_files(spark, tmp_path):
    df = spark.createDataFrame([(i, "t" * i) for i in range(100)], "doc_id long, text string")
    placed, listed = shards.assign(df.limit(0), 10)
    assert placed.count() == 0 and listed.count() == 0
    listed = shards.write(df, str(tmp_path / "out"), 1000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and back.select("shard").distinct().count() == listed.count() > 1
