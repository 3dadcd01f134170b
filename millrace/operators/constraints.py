"""Checks that fail closed, with a few sorted examples in the message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import text_of, unsafe_path


class ConstraintError(ValueError):
    """A table doesn't hold what it must."""


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The table, if it has the columns."""
    if missing := sorted(set(names) - set(df.columns)):
        raise ConstraintError(f"missing columns: {', '.join(missing)}")
    return df


def require_none(bad: DataFrame, what: str, *columns: str) -> None:
    """Raise if ``bad`` has rows, naming up to five of them."""
    if examples := bad.select(*columns).distinct().orderBy(*columns).limit(5).collect():
        raise ConstraintError(f"{what}: " + "; ".join(" ".join(map(str, r)) for r in examples))


def key_violations(df: DataFrame, *keys: str) -> DataFrame:
    """(key_column, value, n) of empty and repeated values of columns that must be unique."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(k).alias("key_column"), text_of(k).alias("value")) for k in keys))).alias("x")).select("x.*")
    counts = long.groupBy("key_column", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.where((F.col("n") > 1) | (F.col("value") == ""))


def split_violations(df: DataFrame, groups: list[str], split: str = "split") -> DataFrame:
    """(group_column, value, n_splits) of groups that lie in several splits; empty values don't count."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(g).alias("group_column"), text_of(g).alias("value")) for g in groups))).alias("x"), split)
    pairs = long.where(F.col("x.value") != "").select("x.group_column", "x.value", split).distinct()
    return pairs.groupBy("group_column", "value").agg(F.count(F.lit(1)).alias("n_splits")).where(F.col("n_splits") > 1)


def unexpected_values(df: DataFrame, column: str, expected: list[str]) -> DataFrame:
    """(value) present but not expected; nothing is unexpected if nothing is named."""
    found = df.select(text_of(column).alias("value")).distinct()
    return found.where(~F.col("value").isin(expected)) if expected else found.limit(0)


def method_violations(df: DataFrame, method: str, split: str, methods: dict[str, list[str]], disjoint: bool = True) -> DataFrame:
    """(method, problem): methods that are configured but absent, or occur in splits beyond their own."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(m, s) for s, ms in methods.items() for m in ms], "method string, split string")
    here = df.select(F.lower(F.trim(text_of(method))).alias("method"), F.col(split).alias("split")).where(F.col("method") != "").distinct()
    absent = wanted.join(here, ["method", "split"], "left_anti").select("method", F.lit("absent").alias("problem"))
    if not disjoint:
        return absent
    stray = here.join(wanted.select("method").distinct(), "method").join(wanted, ["method", "split"], "left_anti")
    return absent.unionByName(stray.select("method", F.lit("in another split").alias("problem")))


def conflicting_duplicates(df: DataFrame, key: str, facts: list[str], order: list[Column | str]) -> tuple[DataFrame, DataFrame]:
    """(first row of each key, keys whose rows disagree on the facts).

    The first row is the least by ``order``; ``max_by`` of whole rows keeps it to one partial
    aggregate, without a window over a key's rows.
    """
    rest = [c for c in df.columns if c != key]
    rank = F.struct(*order, *(F.col(c).cast("string") for c in facts))
    first = df.groupBy(key).agg(F.min_by(F.struct(*rest), rank).alias("row")).select(key, "row.*")
    bad = df.select(key, F.struct(*facts).alias("facts")).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return first, bad.select(key, "n")


def unsafe_paths(df: DataFrame, path: str) -> DataFrame:
    """Rows whose relative path leaves the root or holds reserved characters."""
    return df.where(unsafe_path(F.col(path)))


def same_provenance(inputs: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """(column, values) of provenance columns that differ between inputs; there are few inputs."""
    long = inputs.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), text_of(c).alias("value")) for c in columns))).alias("x")).select("x.*").distinct()
    return long.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("value")), ",").alias("values")).where("n > 1").drop("n")


def same_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys that only one side has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))
