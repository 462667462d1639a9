import random

import numpy as np
from pyspark.sql import functions as F

from voxelith.llm import decontaminate as dc
from voxelith.llm import queries


def least_edits(item, words):
    """Least word edits between item and any stretch of words, by plain dynamic programming."""
    row = np.zeros(len(words) + 1, int)
    code = {w: i for i, w in enumerate(dict.fromkeys([*item, *words]))}
    own = np.array([code[w] for w in words], int)
    steps = np.arange(len(words) + 1)
    for i, w in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (own != code[w]), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def brute(docs, items, rate):
    out = {}
    for i, text in docs:
        words = dc.words_of(text)
        for k, item in items:
            own = dc.words_of(item)
            if own:
                d = least_edits(own, words)
                if d <= int(rate * len(own) + 1e-9):
                    out[i, k] = d
    return out


def test_matches_are_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 8, 15, 40])))) for k in range(25)] + [(90, None), (91, " !? "), (92, "")]
    docs = []
    for i in range(150):
        words = rng.choices(vocabulary, k=rng.randrange(60))
        own = dc.words_of(rng.choice(items)[1])
        for _ in range(rng.randrange(1 + len(own) // 2)):
            p = rng.randrange(len(own) + 1)
            own[p : p + rng.randrange(2)] = rng.choices(vocabulary, k=rng.randrange(2))
        p = rng.randrange(len(words) + 1)
        docs.append((i, ", ".join(words[:p] + [w.upper() for w in own] + words[p:])))
    docs += [(200, None), (201, ""), (202, "?!"), (203, " ".join(rng.choices(vocabulary, k=30000)))]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit("clash")).withColumn("item_id", F.lit(1))
    b = spark.createDataFrame(items, "item_id int, text string")
    for rate in (0.0, 0.25):
        want = brute(docs, items, rate)
        for size in (1 << 20, 100):
            got = dc.matches(d, b, rate, block_bytes=size).collect()
            assert {(r["id"], r["item"]): r["edits"] for r in got} == want and len(got) == len(want)
        texts = dict(docs)
        for r in got:
            # the reported place has the reported edits
            own, words = dc.words_of(dict(items)[r["item"]]), dc.words_of(texts[r["id"]])[r["start"] : r["end"]]
            row = list(range(len(words) + 1))
            for i, x in enumerate(own, 1):
                last, row[0] = row[0], i
                for j, y in enumerate(words, 1):
                    last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
            assert row[-1] == r["edits"]


def test_clean_and_empty_tables(spark):
    item = "one two three four five six seven eight"
    d = spark.createDataFrame([(1, f"x {item} y"), (1, f"x {item} y"), (2, "nothing"), (None, item), (3, None)], "doc_id long, text string")
    b = spark.createDataFrame([(7, item), (7, item)], "item_id long, text string")
    found = dc.matches(d, b)
    assert sorted((r["id"] or 0, r["item"], r["edits"]) for r in found.collect()) == [(0, 7, 0), (1, 7, 0), (1, 7, 0)]
    assert sorted(r["doc_id"] for r in dc.clean(d, found).collect()) == [2, 3]
    assert dc.matches(d.limit(0), b).count() == 0
    none = dc.matches(d, b.limit(0))
    assert none.count() == 0 and dc.clean(d, none).count() == 5


def test_query_is_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in queries.op3_decontaminate(spark, sf).collect()}
    assert got == brute(docs, items, 0.25)
