import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from voxelith.llm import queries, substrings
from voxelith.llm.tokens import split, word_hashes


def brute(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdé", k=rng.randrange(1, 4))) for _ in range(60)]
    passages = [rng.choices(vocabulary, k=rng.randrange(5, 30)) for _ in range(12)]
    texts = []
    for _ in range(80):
        parts = []
        for _ in range(rng.randrange(6)):
            parts += rng.choice([rng.choice(passages), rng.choices(vocabulary, k=rng.randrange(12)), ["x"] * rng.randrange(14), ["p", "q"] * rng.randrange(8)])
        texts.append(rng.choice([" ", "\n", "\t \r"]).join(parts))
    return [*texts, None, "", " ", texts[0], "a b c d"]


def test_what_is_left_is_brute_force(spark):
    for seed, window in ((1, 8), (2, 5), (3, 12)):
        texts = corpus(seed)
        rows = list(enumerate(texts))
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Places__", F.lit(1)).withColumn("removed", F.lit("clash")).repartition(5)
        got = {r["doc_id"]: r for r in substrings.dedup(df, window=window).collect()}
        assert len(got) == len(rows)
        for i, want in enumerate(brute(texts, window)):
            assert (got[i]["n_words"], got[i]["n_removed"], got[i]["text"]) == want, (seed, i)
            assert sum(b - a for a, b in got[i]["removed"]) == want[1]


def test_equal_windows_have_equal_anchors():
    rng = random.Random(8)
    words = rng.choices([f"w{i}" for i in range(9)], k=4000)
    window = 10
    sizes, at = [], 0
    while at < len(words):
        sizes.append(min(len(words) - at, rng.randrange(5, 300)))
        at += sizes[-1]
    s = substrings.Stretch(word_hashes([w.encode() for w in words]), np.array(sizes))
    anchor, _, first, count = substrings.instances(s, window)
    of = {}
    covered = 0
    for a, f, n in zip(anchor.tolist(), first.tolist(), count.tolist()):
        covered += n
        for i in range(f, f + n):
            assert of.setdefault(tuple(words[i : i + window]), a) == a
    assert covered == sum(max(0, n - window + 1) for n in sizes)


def test_ties_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(50))
    long = " ".join(f"v{i % 997}_{i // 997 if i % 2 else 0}" for i in range(60000))
    df = spark.createDataFrame([(1, text), (1, text), (None, None), (2, long)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substrings.dedup(df).collect())
    want = brute([None, text, text, long], 35)
    assert got == [(0, 0, 0), (1, 50, 50), (1, 50, 50), (2, 60000, want[3][1])]
    assert substrings.dedup(df.limit(0)).count() == 0


def test_query_is_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op4_substrings(spark, sf).collect()}
    want = brute([r["text"] for r in rows], 35)
    assert got == {r["doc_id"]: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for r, (n, gone, kept) in zip(rows, want)}
    assert split("a b") == [b"a", b"b"]


def test_columns_may_have_any_name(spark):
    text = " ".join(f"w{i}" for i in range(12))
    df = spark.createDataFrame([(1, text), (2, text + " more"), (3, None)], "doc_id long, text string")
    names = ["id", "ID__", "other__", "own_id__", "other_id__", "other_key__", "text_key", "text_key__", "Places__", "anchor", "start"]
    for n in names:
        df = df.withColumn(n, F.lit(n))
    got = {r["doc_id"]: r for r in substrings.dedup(df, window=8).collect()}
    assert {i: r["text"] for i, r in got.items()} == {1: "", 2: "more", 3: ""}
    assert all(r[n] == n for r in got.values() for n in names)
