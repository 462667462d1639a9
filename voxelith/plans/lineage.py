"""Cutting the lineage of loops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where none is set a temporary one is, but only if driver and executors are one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='voxelith-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def saved(df: DataFrame) -> DataFrame:
    """df written to that folder and read again: it survives lost executors, and what is read is split anew by size.

    The folder's owner removes old tables; a returned frame may read them lazily.
    """
    path = f"{folder(df.sparkSession)}/voxelith-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """df computed and written to the checkpoint folder, so that plans of loops don't grow and lost executors cost one round."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint()
