import math
import random

import pytest
from pyspark.sql import functions as F

from voxelith.llm import langid, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op2_language(spark, SF).collect()
    assert len(got) == len(docs)
    import zlib

    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    named = [r for r in held if docs[r["doc_id"]]["lang"]]
    assert sum(docs[r["doc_id"]]["lang"] == r["lang_pred"] for r in named) >= 0.97 * len(named)
    assert all(0 <= r["score"] <= 1 for r in got)


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        lang, letters = rng.choice([("xx", "abcde"), ("yy", "defgh")])
        rows.append((i, " ".join("".join(rng.choices(letters, k=rng.randrange(2, 6))) for _ in range(30)), lang, f"s{i}"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_unseen_words_back_off(small):
    model = langid.fit(small)
    assert model.langs == ["xx", "yy"]
    assert "aabbccaabbcc" not in model.words
    assert model.predict("aabbccaabbcc!")[0] == "xx"
    assert model.predict("HHGGhhgghhgg")[0] == "yy"
    # a known word's own frequency is used, an unknown one is made of its longest known n-grams
    word = next(iter(model.words))
    assert (model.table[model.rows_of([word])[0]] == model.word_logs[model.words[word]]).all()
    assert (model.table[model.rows_of(["abcabcabc"])[0]] == model.unseen("abcabcabc")).all()
    unseen = model.unseen("ab")
    assert unseen.shape == (2,) and unseen[0] > unseen[1]


def test_odd_rows(spark, small):
    model = langid.fit(small)
    rows = [(1, None), (2, ""), (3, "12 -- 34 _ %%"), (7, "½ ② Ⅷ ² ٣"), (4, "abc " * 50000), (4, "abc " * 50000), (None, "gh"), (5, "漢字 кот"), (6, "a" * 100000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Score", F.lit("clash"))
    got = langid.predict(df, model).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] in (1, 2, 3, 7):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in ("xx", "yy") and 0 < r["score"] <= 1
    assert langid.predict(df.limit(0), model).count() == 0


def test_without_labels_nothing_is_known(spark, small):
    model = langid.fit(small.withColumn("lang", F.lit(None).cast("string")))
    assert model.predict("abc") == ("und", 0.0)


def test_the_sample_is_bounded_and_skips_what_is_held_out(spark, small):
    only_held = small.where(langid.held_out())
    assert langid.fit(only_held).langs == []
    model = langid.fit(small, per_language=20, words=15, grams=40)
    assert len(model.words) <= 30 and len(model.grams) <= 80


def test_the_model_and_the_scores_are_brute_force(spark, small):
    """All of it by plain counting: every row is in the sample, which is larger than the table."""
    long = "abcab" * 30
    rows = [tuple(r) for r in small.collect()] + [(1000 + i, f"{long} ½ straße", "xx", "s") for i in range(4)]
    df = spark.createDataFrame(rows, small.schema)
    import zlib

    words, grams = {}, {}
    for i, text, lang, _ in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            for w in text.lower().replace("½", " ").split():
                for p in [w[k : k + langid.PIECE] for k in range(0, len(w), langid.PIECE)]:
                    words.setdefault(p, {}).setdefault(lang, 0)
                    words[p][lang] += 1
    for w, by in words.items():
        for lang, n in by.items():
            for size in range(1, langid.LONGEST + 1):
                for k in range(len(w) + 3 - size):
                    g = f"^{w}$"[k : k + size]
                    grams.setdefault(size, {}).setdefault(g, {}).setdefault(lang, 0)
                    grams[size][g][lang] += math.sqrt(n)
    kept = {w: {k: n for k, n in by.items() if n >= 2} for w, by in words.items()}
    kept = {w: by for w, by in kept.items() if by}

    def logs(table, key, lang):
        total = sum(0.5 + by.get(lang, 0) for by in table.values()) + 1
        return math.log((0.5 + table[key].get(lang, 0)) / total)

    def score(text, lang):
        out = 0.0
        for w in langid.words_of(text):
            if w in kept:
                out += logs(kept, w, lang)
                continue
            i, marked = 0, f"^{w}$"
            while i < len(marked):
                size = next((s for s in range(min(langid.LONGEST, len(marked) - i), 0, -1) if marked[i : i + s] in grams[s]), 0)
                out += logs(grams[size], marked[i : i + size], lang) - langid.STEP * (langid.LONGEST - size) if size else langid.FLOOR
                i += size or 1
        return out

    model = langid.fit(df, words=10**6, grams=10**6)
    assert long[: langid.PIECE] in model.words
    for text in ["abcde", "fgh fgh abc zzz", "dede edde", long, f"{long}x hh", "strasse straße", rows[0][1], rows[1][1]]:
        x, y = score(text, "xx"), score(text, "yy")
        lang, got = model.predict(text)
        assert lang == ("xx" if x >= y else "yy")
        assert abs(got - 1 / (1 + math.exp(-abs(x - y)))) < 1e-3
