import hashlib
import math

import xxhash
from pyspark.sql import functions as F

from voxelith.llm import fingerprint as fp
from voxelith.llm import queries


def brute(text):
    text = text or ""
    h = lambda s: xxhash.xxh64(s.encode(), seed=42).intdigest()
    wide = [0] * fp.WIDE
    for p in text.split("\n"):
        if p:
            for k in range(fp.WIDE // 2):
                x = h(f"{k}:{p}")
                wide[2 * k] = (wide[2 * k] + (x & fp.LOW32)) & fp.LOW32
                wide[2 * k + 1] = (wide[2 * k + 1] + (x >> 32)) & fp.LOW32
    import re

    signs = [0] * fp.SIGNS
    for c in re.split(fp.CLAUSE, text):
        if c:
            x = h(c)
            for j in range(fp.SIGNS):
                signs[j] += 1 if x >> j & 1 else -1
    return wide, signs


def hexed(v):
    return "".join(f"{x:08x}" for x in v[0]) + "".join(f"{x % (1 << 32):08x}" for x in v[1])


def like(a, b):
    if a == b:
        return 1.0
    dot = lambda x, y: sum(p * q for p, q in zip(x[1], y[1]))
    n = math.sqrt(dot(a, a)) * math.sqrt(dot(b, b))
    return min(1.0, max(0.0, dot(a, b) / n)) if n else 0.0


def check(rows, got):
    """rows: (doc_id, text) in order; got: the query's rows."""
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) == len(by)
    for i, (doc, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = by[doc]
        a, b, c = brute(text), brute(edited), brute(following)
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == hexed(a) and r["edited_fingerprint"] == hexed(b)
        assert abs(r["near_edited"] - like(a, b)) < 1e-9 and abs(r["near_next"] - like(a, c)) < 1e-9


def test_query_is_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    check(rows, queries.op5_fingerprint(spark, sf).collect())


def test_odd_rows_over_many_ranges(spark, tmp_path):
    rows = [(i * i - 5000, f"line {i}, {'é' * (i % 7)}; 漢字\nmore of {i % 5}\n\n𝟘" if i % 9 else (None if i % 2 else "")) for i in range(150)]
    spark.createDataFrame(rows[::-1], "doc_id long, text string").withColumn("own", F.lit("clash")).repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    check(rows, queries.op5_fingerprint(spark, str(tmp_path)).collect())


def test_repeated_and_null_ids(spark, tmp_path):
    rows = [(None, "n"), (1, "a"), (1, "b"), (1, "b"), (2, "long " * 30000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op5_fingerprint(spark, str(tmp_path)).collect()
    assert len(got) == 5
    spark.createDataFrame(rows[:1], "doc_id long, text string").limit(0).write.parquet(f"{tmp_path}/e/documents.parquet")
    assert queries.op5_fingerprint(spark, f"{tmp_path}/e").count() == 0


def test_paragraphs_come_and_go(spark):
    df = spark.createDataFrame([("a\nb\nc", "c\na\nb", "b", "a\nc", "a\nb\nb\nc")], "whole string, shuffled string, part string, less string, more string")
    for c in df.columns:
        df = fp.with_vector(df, F.col(c), f"v_{c}")
    r = df.select(
        (fp.hexed(F.col("v_whole")) == fp.hexed(F.col("v_shuffled"))).alias("order"),
        (fp.hexed(fp.deleted(F.col("v_whole"), F.col("v_part"))) == fp.hexed(F.col("v_less"))).alias("deletion"),
        (fp.hexed(fp.inserted(F.col("v_whole"), F.col("v_part"))) == fp.hexed(F.col("v_more"))).alias("insertion"),
        (fp.hexed(F.col("v_whole")) != fp.hexed(F.col("v_more"))).alias("counts"),
    ).first()
    assert all(r)


def test_ids_of_any_type_and_many_rows_without_one(spark, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_BYTES", 500)
    rows = [(f"id {i:03d}" if i % 3 else None, f"text {i}, of some length\n{'word ' * (i % 11)}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumn("mark__", F.lit(1)).withColumn("range__", F.lit(2)).repartition(5)
    got = fp.with_next(df, "doc_id", ["text"]).collect()
    assert len(got) == 200 and set(got[0].asDict()) == {"doc_id", "text", "mark__", "range__", "next_text"}
    mark = lambda t: (xxhash.xxh64(t.encode(), seed=42).intdigest() + (1 << 63)) % (1 << 64) - (1 << 63)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", mark(r[1])))
    want = {a: b[1] for a, b in zip(order, order[1:] + order[:1])}
    assert {(r["doc_id"], r["text"]): r["next_text"] for r in got} == want
    assert len(fp.edited_by_next(df).collect()) == 200


def test_many_equal_clauses_keep_their_direction(spark):
    df = spark.createDataFrame([("a," * 40000 + "b", "a," * 41000 + "b")], "x string, y string")
    for c in df.columns:
        df = fp.with_vector(df, F.col(c), f"v_{c}")
    assert df.select(fp.likeness(F.col("v_x"), F.col("v_y"))).first()[0] > 0.99
