import random

from pyspark.sql import functions as F

from voxelith.llm import neardup
from voxelith.plans.components import components


def brute_components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)] + [(5, 5)]
    df = spark.createDataFrame([*edges, edges[0], (None, 3), (4, None)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    real = [(a, b) for a, b in edges if a != b]
    assert got == brute_components({x for e in real for x in e}, real)
    assert components(df.limit(0)).count() == 0


def shingles(text, words=5):
    ws = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(ws[i : i + words]) for i in range(max(1, len(ws) - words + 1))} if ws else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = list(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, brute_components(ids, links)


def test_groups_are_brute_force(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("aeioustrnÉ", k=rng.randrange(2, 7))) for _ in range(400)]
    rows = []
    for g in range(25):
        words = rng.choices(vocabulary, k=rng.randrange(3, 150))
        for _ in range(rng.choice([1, 2, 6, 30])):
            own = list(words)
            for _ in range(rng.choice([0, 1, 2, 3, 6])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                own += words[: rng.randrange(len(words))]
            rows.append("  ".join(own) if g == 3 else "  ".join(own).swapcase() if rng.random() < 0.2 else "\n".join(own))
    rows += [None, "", " \t\n", "one", "One", "one two three", "ONE two three", "a a a a a a a a", "a a a a a a"]
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash"))
    sizes, own = brute(rows)
    got = {r["id"]: r for r in neardup.groups(df).collect()}
    assert len(got) == len(rows)
    # swapcase() also changes letters beyond A-Z, so the sets are taken from the very texts
    for i, _ in rows:
        assert got[i]["n_shingles"] == sizes[i]
        assert got[i]["component_id"] == own[i], i
        assert got[i]["kept"] == (own[i] == i)


def test_ties_and_empty_tables(spark):
    text = "these five words and some more of them"
    df = spark.createDataFrame([(3, text), (3, text), (1, text), (None, text), (None, None)], "doc_id long, text string")
    got = neardup.groups(df).collect()
    assert sorted((r["id"] or -1, r["component_id"], r["kept"]) for r in got if r["n_shingles"]) == [(-1, 1, False), (1, 1, True), (3, 1, False), (3, 1, False)]
    assert [(r["component_id"], r["kept"]) for r in got if not r["n_shingles"]] == [(None, True)]
    assert neardup.groups(df.limit(0)).count() == 0


def test_query_is_brute_force(spark):
    from voxelith.llm import queries

    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    sizes, own = brute(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in queries.op7_neardup(spark, sf).collect()}
    assert got == {i: (sizes[i], own[i], own[i] == i) for i, _ in rows}


def test_a_large_family_with_changes_all_over(spark):
    """Documents that share most shingles with a common ancestor, and many of them too few with one another."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(160):
        words = list(base)
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(3)] = [f"v{rng.randrange(40)}" for _ in range(rng.randrange(1, 4))]
        rows.append((i, " ".join(words)))
    _, of = brute(rows)
    got = {r["id"]: r["component_id"] for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == of
    assert 5 < len(set(of.values())) < 150


def test_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(60000))
    rows = [(1, long), (2, long + " end"), (3, "w1 " * 60000), (4, long[: len(long) // 2])]
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit(1)).withColumn("set", F.lit(1))).collect()}
    assert got[1] == (59996, 1) and got[2] == (59997, 1) and got[3] == (1, 3) and got[4][1] == 4
