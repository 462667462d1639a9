"""Helpers that the text operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import folder


#: Rows that go to a Python worker at once: texts are long, and a batch is held several times over.
BATCH_ROWS = 500


def bounded_batches(spark: SparkSession) -> None:
    """Makes Arrow batches of the session no larger than BATCH_ROWS rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, codec: str | None = None) -> DataFrame:
    """df written to the shared folder and read again: it survives lost executors and cuts the lineage.

    The folder's owner removes old tables; a returned frame may read them lazily.
    """
    path = f"{folder(df.sparkSession)}/voxelith-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name = f"{name}_"
    return name



def dropped(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names in any case, so that new ones of these names don't clash."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def text_of(df: DataFrame, col: str = "text"):
    """The text with null as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))
