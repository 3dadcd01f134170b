"""Audits kept up to date as rows arrive. An extension: the batch operators say what is right."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import missing_token


def running_counts(stream: DataFrame, column: str, time: str, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """(start, value, n) of each window of event time; late rows count until the delay has passed."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), missing_token(column).alias("value")).agg(
        F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "value", "n")


def first_arrivals(stream: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each key within the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
