"""Cutting lineage in storage that outlives an executor."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only where that is unset, as in tests, a folder of our
    own is taken; a cluster must name one that all executors share."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="millrace-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and return a frame that reads it from there."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, by a Parquet table in the checkpoint folder. What is read back knows its size, so that small
    tables are broadcast, and carries nothing of the plan that made it, which matters in long loops."""
    path = f"{folder(df.sparkSession)}/table-{uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``stored`` wrote, when nothing will read it again."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
