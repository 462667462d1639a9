import corpus_pipeline
import numpy as np
import public_tokenizers as P
import tiktoken

from voxelith.llm import bpe, langid

from .test_decontaminate import brute as brute_leaks
from .test_lines import brute as brute_lines
from .test_neardup import brute as brute_groups

SF = "/root/testdata/sf0.001"


def test_run_is_the_stages_by_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(table)
    rows = sorted((r["doc_id"], r["text"]) for r in table.collect())
    rows = [(i, t) for i, t in rows if (p := model.predict(t))[0] != "und" and p[1] >= 0.5]
    rows = [(i, t) for (i, before), t in zip(rows, brute_lines(rows, 2, 20, 1)) if t == before or t.strip()]
    _, of = brute_groups(rows)
    rows = [(i, t) for i, t in rows if of[i] == i]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {i for i, _ in brute_leaks(rows, items, 0.25)}
    rows = [(i, t) for i, t in rows if i not in bad]
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.Vocabulary(P.path("byte_bpe_50k.tiktoken")).ranks, special_tokens={})
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == {i for i, _ in rows} and 100 < len(got) < table.count()
    for i, t in rows:
        r = got[i]
        assert r["lossless"] and r["n_chars"] == len(t)
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids == library.encode_ordinary(t) and r["n_tokens"] == len(ids)


def test_stages_keep_the_columns_and_bear_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words of a text that has letters", "en", "s", 5), (3, "some words of a text that has letters", None, "s", 5), (3, "some words of a text that has letters", None, "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    for df in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, SF)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            out.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, df, SF).count() == df.count()
