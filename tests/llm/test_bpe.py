import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from voxelith.llm import bpe

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.Vocabulary(RANKS).ranks, special_tokens={})


def test_ids_are_the_library_s(library):
    rng = random.Random(7)
    letters = "abst'' '' \n\t  1é٣!?-’rveldm　 \x1cᲉ漢𝟘"
    texts = ["".join(rng.choices(letters, k=rng.randrange(50))) for _ in range(5000)]
    texts += ["", "'", "'s", "it's 'll", "  'll", "\n's", "a" * 3000, " " * 700 + "x", "x \n ", "<|endoftext|>", "'" * 300 + "re"]
    words = bpe.Vocabulary(RANKS)
    got = [np.frombuffer(x, "<u4").tolist() for x in words.encode(texts)]
    assert got == [library.encode_ordinary(t) for t in texts]


def test_heap_and_scan_of_short_slices_agree():
    words = bpe.Vocabulary(RANKS)
    rng = random.Random(3)
    for n in (25, 60, 400):
        raw = "".join(rng.choices("abcdehilnorst", k=n)).encode()
        parts = [raw[i : i + 1] for i in range(n)]
        while True:
            ranked = [(words.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in words.ranks]
            if not ranked:
                break
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert words.merge(raw) == [words.ranks[p] for p in parts]


def test_round_trip_with_odd_rows(spark, library):
    long = "Ünïcode wörds, 漢字 and '' spaces   \n" * 4000
    rows = [(1, "it's fine", "a"), (1, "it's fine", "a"), (2, None, None), (3, "", "b"), (None, " x", "c"), (4, long, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS string").withColumn("decoded", F.lit(1))
    got = bpe.decode(bpe.encode(df, RANKS), RANKS).collect()
    assert len(got) == len(rows)
    for r in got:
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(r["text"] or "")
        starts = np.frombuffer(r["offsets"], "<u4")
        assert len(starts) * 4 == len(r["ids"]) and (len(starts) == 0 or starts[0] == 0)
    empty = df.limit(0)
    assert bpe.decode(bpe.encode(empty, RANKS), RANKS).count() == 0


def test_query_is_the_library(spark, library):
    from voxelith.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op1_bpe(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
