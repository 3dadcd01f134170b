"""Scores that are there and scores that are still to make, by partitions of a cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.constraints import ConstraintError
from millrace.sources.stores import file_paths


def scoring_work(runs: DataFrame, settings: DataFrame, manifests: DataFrame) -> DataFrame:
    """Every run with every setting on every manifest; all three are small frames of names."""
    return runs.crossJoin(F.broadcast(settings)).crossJoin(F.broadcast(manifests)).distinct()


def cached_partitions(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """The partitions (keys) of a table that is partitioned by them, from its listing: no file is opened. Only
    partitions with a part file count. A folder that isn't there has none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], ", ".join(f"{k} string" for k in keys))
    parts = file_paths(spark, folder, "part-*").select(F.split("name", "/").alias("steps")).where(F.size("steps") == len(keys) + 1)
    value = lambda i, k: F.url_decode(F.regexp_replace(F.get("steps", F.lit(i)), f"^{k}=", "")).alias(k)
    return parts.select(*(value(i, k) for i, k in enumerate(keys))).distinct()


def still_to_score(work: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """The rows of ``work`` (keys) that the cache has no partition for."""
    return work.join(F.broadcast(cached_partitions(work.sparkSession, folder, keys)), keys, "left_anti")


def score_missing(work: DataFrame, score: Callable[[DataFrame], DataFrame], folder: str, keys: list[str]) -> int:
    """Score what is missing and append it to the cache; returns how many pieces of work that were.

    ``score`` makes rows with the ``keys`` from the open work, and isn't called if there is none. Keys must be
    texts without a null. A piece of work that gives no rows is an error: it would be scored again each time.
    """
    open_work = still_to_score(work.select(*keys), folder, keys).cache()
    n = open_work.count()
    if n:
        score(open_work).write.mode("append").partitionBy(*keys).parquet(folder)
        left = still_to_score(open_work, folder, keys).count()
        if left:
            raise ConstraintError(f"{left} of {n} pieces of work gave no rows")
    open_work.unpersist()
    return n
