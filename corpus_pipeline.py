"""A corpus pipeline over `documents`: each stage works on all that its predecessor kept, and its decisions take effect.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of `documents`. What goes in is not changed but for the
text that line deduplication shortens (n_chars follows). Empty tables pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.llm import bpe, decontaminate, langid, lines, neardup
from voxelith.llm.common import bounded_batches, free_name, saved, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: null texts, texts without letters, and those that no language explains better than all others together go."""
    bounded_batches(spark)
    lang, score = free_name(docs, "lang_pred__"), free_name(docs, "score__")
    found = langid.predict(docs, langid.fit(docs), lang_col=lang, score_col=score)
    return found.where((F.col(lang) != "und") & (F.col(score) >= 0.5)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand earlier in the corpus; those that lost all they had but empty lines go."""
    before, gone = free_name(docs, "lines__"), free_name(docs, "removed__")
    found = lines.dedup(docs, threshold=2, shortest=20, lines_col=before, removed_col=gone, exact_from=1)
    found = found.where((F.col(gone) == 0) | F.col("text").rlike(r"\S"))
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; of rows equal in id and text the one whose other columns sort first."""
    bounded_batches(spark)
    groups = saved(neardup.groups(docs, words=5, percent=75))
    kept = groups.where("kept").select(F.col("id").alias("id__"), F.col("text_key").alias("text_key__")).distinct()
    out = docs.join(kept, docs["doc_id"].eqNullSafe(kept["id__"]) & (F.xxhash64(docs["text"]) == kept["text_key__"]), "left_semi")
    repeats = groups.where("kept").groupBy("id", "text_key").count().where("count > 1")
    # only where ids repeat is there anything left to do
    return out if repeats.isEmpty() else out.groupBy("doc_id", "text").agg(F.min(F.struct(*[c for c in out.columns if c not in ("doc_id", "text")])).alias("rest")).select("doc_id", "text", "rest.*").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    bounded_batches(spark)
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"), rate=0.25)
    return decontaminate.clean(docs, found)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document (little-endian unsigned 32-bit integers), and whether they decode to its text."""
    bounded_batches(spark)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = bpe.decode(bpe.encode(docs, ranks), ranks)
    lossless = (F.col("decoded") == F.col("text").cast("binary")).alias("lossless")
    return found.select("doc_id", "lang", "source", "n_chars", F.expr("length(ids) div 4").cast("long").alias("n_tokens"), "ids", lossless)


STAGES = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: Language scores and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
