"""Cutting lineage in storage that outlives an executor, and clearing it."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from millrace.plans.durable import cut, folder

__all__ = ["cut", "discard", "folder", "remove", "stored"]


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, by a Parquet table in the checkpoint folder: smaller than a checkpoint for many rows."""
    path = f"{folder(df.sparkSession)}/table-{uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``stored`` wrote, when nothing will read it again."""
    remove(df.sparkSession, df.stored_at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage, whatever file system it is on."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
