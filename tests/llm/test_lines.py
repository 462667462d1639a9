import random
from collections import Counter

from pyspark.sql import functions as F

from voxelith.llm import lines, queries


def distance(a, b):
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, text, n):
    for _ in range(n):
        i = rng.randrange(max(1, len(text)))
        text = rng.choice([text[:i] + text[i + 1 :], text[:i] + rng.choice("abé") + text[i:], text[:i] + rng.choice("abé") + text[i + 1 :]])
    return text


def test_band_is_the_distance(spark):
    rng = random.Random(5)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choices("abé", k=rng.randrange(1, 30)))
        pairs.append((a, edited(rng, a, rng.randrange(6))))
    df = spark.createDataFrame(pairs, "a string, b string")
    for k in (0, 1, 2, 3, 4):
        got = df.select("a", "b", lines.within(F.col("a"), F.col("b"), k).alias("near")).collect()
        for r in got:
            assert r["near"] == (distance(r["a"], r["b"]) <= k), (r, k)


def brute(rows, threshold, shortest, exact_from=None):
    """rows: (id, text); what stays of each text, rows being ordered by id."""
    exact_from = shortest if exact_from is None else exact_from
    seen, out = {}, []
    order = []
    for i, (_, text) in enumerate(rows):
        for p, line in enumerate((text or "").split("\n")):
            if len(line) >= exact_from and line not in seen:
                seen[line] = (i, p)
                order.append(line)
    # each edit changes the count of two letters at most by one, so most pairs need no table
    counts = [Counter(x) for x in order]
    few = lambda x, y: (x - y).total() <= threshold and (y - x).total() <= threshold
    late = set()
    for n, b in enumerate(order):
        if len(b) >= shortest and any(len(a) >= shortest and abs(len(a) - len(b)) <= threshold and few(counts[m], counts[n]) and distance(a, b) <= threshold for m, a in enumerate(order[:n])):
            late.add(b)
    for i, (_, text) in enumerate(rows):
        if text is None:
            out.append(None)
            continue
        parts = text.split("\n")
        out.append("\n".join(x for p, x in enumerate(parts) if len(x) < exact_from or (seen[x] == (i, p) and x not in late)))
    return out


def test_what_stays_is_brute_force(spark):
    rng = random.Random(11)
    base = ["".join(rng.choices("abcdé ", k=rng.randrange(6, 26))) for _ in range(25)]
    rows = []
    for i in range(60):
        parts = [edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randrange(1, 6))]
        rows.append((i, "\n".join(parts + [""] * rng.randrange(2))))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "x" * 9000), (104, "x" * 9001), (105, "x" * 9005), (106, base[0])]
    for threshold in (0, 1, 2, 3):
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Key", F.lit("k")).withColumn("n_lines", F.lit("clash"))
        got = {r["doc_id"]: r for r in lines.dedup(df, threshold=threshold, shortest=8).collect()}
        assert len(got) == len(rows)
        want = brute(rows, threshold, 8)
        for (i, text), stays in zip(rows, want):
            assert got[i]["text"] == stays, (threshold, i)
            assert got[i]["n_lines"] == (len(text.split("\n")) if text else 0)
            if text:
                assert got[i]["n_lines"] - got[i]["n_removed"] == (len(stays.split("\n")) if stays or "" in text.split("\n") else 0)


def test_equal_rows_are_alike_and_tables_may_be_empty(spark):
    text = "a line that is long enough to count\nanother line that is long enough"
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in lines.dedup(df).collect())
    assert got == [(0, text), (1, ""), (1, ""), (2, "")]
    assert lines.dedup(df.limit(0)).count() == 0


def test_short_lines_take_part_with_equal_ones_only(spark):
    long = "a line that is long enough to count"
    rows = [(1, f"Les.\n{long}\n\nLes,"), (2, f"Les.\n\n{long}!"), (3, "Les.\nx\nLes;"), (4, "Les,\nx")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in lines.dedup(df, exact_from=1).collect()}
    assert got == {1: (rows[0][1], 4, 0), 2: ("", 3, 2), 3: ("x\nLes;", 3, 1), 4: ("", 2, 2)}


def test_the_query_leaves_no_equal_lines(spark):
    sf = "/root/testdata/sf0.001"
    texts = [t for (t,) in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() if t]
    parts = [p for t in texts for p in t.split("\n")]
    found = queries.op10_lines(spark, sf).agg(F.sum(F.col("n_lines") - F.col("n_removed"))).head()[0]
    assert found <= len({p for p in parts if p}) + parts.count("")


def test_a_family_of_lines_with_changes_all_over(spark):
    """Many lines that share their segments, most of them beyond the threshold of one another and of the first one."""
    rng = random.Random(3)
    base = "".join(rng.choices("abcdefgh ", k=60))
    rows = [(0, base)]
    for i in range(1, 130):
        at, word = rng.randrange(len(base)), "".join(rng.choices("xyz", k=rng.randrange(1, 7)))
        line = rng.choice([base[:at] + word + base[at:], base[:at] + base[at + len(word) :], base[:at] + word + base[at + len(word) :]])
        rows.append((i, edited(rng, line, rng.choice([0, 0, 1, 2, 3]))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for threshold in (1, 2):
        got = {r["doc_id"]: r["text"] for r in lines.dedup(df, threshold=threshold).collect()}
        assert [got[i] for i, _ in rows] == brute(rows, threshold, 20)


def test_the_query_is_brute_force(spark):
    """On whole texts of a few documents, short lines included."""
    sf = "/root/testdata/sf0.001"
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())[:25]
    got = {r["doc_id"]: r["text"] for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string"), threshold=2, shortest=20, exact_from=1).collect()}
    assert [got[i] for i, _ in rows] == brute(rows, 2, 20, 1)


def test_counts_of_lines_within_the_threshold_are_alike(spark):
    rng = random.Random(7)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choices("abcdefgh é\U0001f600\U0001f601字", k=rng.randrange(1, 60)))
        pairs.append((a, edited(rng, a, rng.randrange(5))))
    pairs += [("a" * 70000, "a" * 69999 + "b"), ("a" * 70000 + "z" * 12, "c" * 12 + "a" * 70000)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for k in (0, 1, 2, 3):
        x, y = lines.counted(F.col("a"), k), lines.counted(F.col("b"), k)
        equal = F.array(*[p == q for p, q in zip(x, y)])
        got = df.select("a", "b", lines.alike(x, y, F.length("a"), F.length("b"), k).alias("alike"), F.exists(equal, lambda e: e).alias("meet")).collect()
        for r in got[:-2]:
            few = distance(r["a"], r["b"]) <= k
            assert not few or (r["alike"] and r["meet"]), (r, k)
        assert [r["alike"] for r in got[-2:]] == [k > 0, False]


def test_a_family_of_lines_is_not_paired_all_with_all(spark, monkeypatch):
    """Lines that differ from the earliest one by other words at the same few places meet by their spans, not by their counts."""
    rng = random.Random(13)
    base = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(60)]
    rows = [(0, " ".join(base))]
    for i in range(1, 400):
        words = list(base)
        for _ in range(2):
            words[rng.choice([25, 26, 27])] = "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(6, 9)))
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, edited(rng, rows[i][1], 2)) for i in range(0, 400, 20)]
    made, own = [], lines._with_texts
    monkeypatch.setattr(lines, "_with_texts", lambda pairs, texts: made.append(pairs.count()) or own(pairs, texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lines.dedup(df, threshold=2).collect()}
    assert [got[i] for i, _ in rows] == brute(rows, 2, 20)
    assert made[-1] < 2 * len(rows), made
