"""One query for each operator, over its whole table, with production parameters; SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, fingerprint, langid, licenses, lines, neardup, oracles, shards, substrings, urls
from .common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the bytes they decode to, as digests."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(table(spark, sf_dir, "documents"), ranks, keep=["doc_id"])
    return bpe.decode(ids, ranks).select(
        "doc_id",
        F.expr("length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every text, by a model that never saw the held-out documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.predict(docs, langid.fit(docs), keep=["doc_id"])
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item that a document holds, with its edits and place."""
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), rate=0.25)
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "edits", "item_words", F.col("start").alias("start_word"), F.col("end").alias("end_word"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text once repeated windows of 35 words are removed."""
    found = substrings.dedup(table(spark, sf_dir, "documents"), window=35, keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are."""
    both = fingerprint.edited_by_next(table(spark, sf_dir, "documents"))
    own, edited, following = F.col("own"), F.col("edited_v"), F.col("next_v")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint.hexed(own).alias("fingerprint"),
        fingerprint.hexed(edited).alias("edited_fingerprint"),
        fingerprint.likeness(own, edited).alias("near_edited"),
        fingerprint.likeness(own, following).alias("near_next"),
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each license notice in a document, with its coverage and place."""
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "license", "coverage", "matched", F.col("start").alias("start_char"), F.col("end").alias("end_char"))


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of near-duplicates."""
    found = neardup.groups(table(spark, sf_dir, "documents").select("doc_id", "text"), words=5, percent=75)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


SHARD_BYTES = 1 << 20


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard."""
    placed, _ = shards.assign(table(spark, sf_dir, "documents"), SHARD_BYTES, keep=["doc_id"])
    return placed.select("doc_id", "shard", "n_bytes")


URL_RULES = [
    urls.Rule("block", "com", "/en/"),
    urls.Rule("allow", "example.com", "/en/7"),
    urls.Rule("allow", "net", "/de/"),
    urls.Rule("block", "example.net", "/de/8"),
    urls.Rule("block", "org", "/es/"),
]


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's rule and verdict."""
    judged = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line deduplication leaves of every text: every line that is not empty takes part, those under 20 code points against equal ones only."""
    found = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), threshold=2, shortest=20, exact_from=1)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_language": op2_language,
        "op3_decontaminate": op3_decontaminate,
        "op4_substrings": op4_substrings,
        "op5_fingerprint": op5_fingerprint,
        "op6_licenses": op6_licenses,
        "op7_neardup": op7_neardup,
        "op8_shards": op8_shards,
        "op9_urls": op9_urls,
        "op10_lines": op10_lines,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.sql(SHARD_BYTES, [(r.verdict, r.host, r.path) for r in URL_RULES])
