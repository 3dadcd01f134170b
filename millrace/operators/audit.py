"""Counts, cross-tables, missing values, duplicates, leakage, purity and gates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalars import missing_token, text_of


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n) with missing values under ``<MISSING>``."""
    return df.groupBy(missing_token(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def cross_table(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """(a, b, n) for every pair of a value of one column and one of the other, 0 where none meets."""
    pairs = df.groupBy(missing_token(rows).alias("a"), missing_token(columns).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    grid = pairs.select("a").distinct().crossJoin(pairs.select("b").distinct())  # distinct values, not rows
    return grid.join(pairs, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def missingness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n_missing) from one pass over the table."""
    columns = columns or df.columns
    counts = df.agg(*(F.count_if(text_of(c) == "").alias(f"m{i}") for i, c in enumerate(columns)))
    pairs = ", ".join(f"'{c}', m{i}" for i, c in enumerate(columns))
    return counts.selectExpr(f"stack({len(columns)}, {pairs}) as (column, n_missing)")


def first_ids(df: DataFrame, column: str, id_col: str, examples: int) -> DataFrame:
    """(key, ids): the least ``examples`` ids of each non-empty value.

    Spark keeps that many rows of a key in each task before it shuffles them.
    """
    spread = df.where(text_of(column) != "").select(F.col(column).cast("string").alias("key"), F.col(id_col).alias("id"))
    ranked = spread.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("r") <= examples)
    return ranked.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids"))


def duplicate_groups(df: DataFrame, column: str, split: str = "split") -> DataFrame:
    """Non-empty values held by two rows or more: key, n, splits (sorted, non-empty), crosses.

    Counts are partial before the shuffle, so a value with most rows is no burden.
    """
    keyed = df.where(text_of(column) != "").select(F.col(column).cast("string").alias("key"), text_of(split).alias("split"))
    per_split = keyed.groupBy("key", "split").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_split.groupBy("key").agg(F.sum("n").alias("n"), F.array_sort(F.collect_set(F.when(F.col("split") != "", F.col("split")))).alias("s"))
        .where(F.col("n") > 1)
        .select("key", "n", F.array_join("s", ",").alias("splits"), (F.size("s") > 1).alias("crosses"))
    )


def duplicate_examples(df: DataFrame, column: str, id_col: str, split: str = "split", groups: int = 20, examples: int = 10) -> DataFrame:
    """The first ``groups`` duplicate groups by key, with their least ids (a report's head)."""
    head = duplicate_groups(df, column, split).orderBy("key").limit(groups)
    return head.join(first_ids(df, column, id_col, examples), "key")


def duplicate_summary(df: DataFrame, column: str, split: str = "split") -> DataFrame:
    """One row: n_groups, n_rows, cross_groups, cross_rows."""
    none = F.lit(0).cast("long")
    return duplicate_groups(df, column, split).agg(
        F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum("n"), none).alias("n_rows"), F.count_if("crosses").alias("cross_groups"),
        F.coalesce(F.sum(F.when(F.col("crosses"), F.col("n"))), none).alias("cross_rows"))


def group_overlap(df: DataFrame, column: str, split: str = "split") -> DataFrame:
    """Values that occur in several splits: key, n, splits."""
    return duplicate_groups(df, column, split).where("crosses").select("key", "n", "splits")


def label_purity(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """How well each column alone tells the label: column, n, n_values, purity, majority, lift.

    Over labelled rows. A column with more values than max(50, a fifth of the rows) says nothing
    and has null figures.
    """
    labelled = df.where(text_of(label) != "").select(
        F.explode(F.array(*(F.struct(F.lit(c).alias("column"), missing_token(c).alias("value")) for c in columns))).alias("x"), text_of(label).alias("label"))
    counts = labelled.groupBy("x.column", "x.value", "label").agg(F.count(F.lit(1)).alias("n"))
    by_value = counts.groupBy("column", "value").agg(F.max("n").alias("best"), F.sum("n").alias("n"))
    pure = by_value.groupBy("column").agg(F.sum("best").alias("best"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_values"))
    by_label = counts.groupBy("column", "label").agg(F.sum("n").alias("n")).groupBy("column").agg(F.max("n").alias("top"))
    usable = F.col("n_values") <= F.greatest(F.lit(50).cast("long"), F.floor(F.col("n") * F.lit(0.2)))
    share = lambda c: F.when(usable, F.round(F.col(c) / F.col("n"), 8))
    return pure.join(by_label, "column").select(
        "column", "n", "n_values", share("best").alias("purity"), share("top").alias("majority"),
        F.when(usable, F.round(F.col("best") / F.col("n") - F.col("top") / F.col("n"), 8)).alias("lift"))


@dataclass(frozen=True)
class Gates:
    """Most rows or groups that each check may find, and when a column counts as a give-away."""

    missing_label: int = 0
    missing_key: int = 0
    exact_duplicates_across: int = 0
    near_duplicates_across: int = 0
    groups_across: int = 0
    purity: float = 0.98
    lift: float = 0.05
    fail_on_purity: bool = False


def quality_gates(df: DataFrame, id_col: str, label: str, exact: str, near: str, groups: list[str], gates: Gates = Gates(), split: str = "split") -> DataFrame:
    """(gate, actual, limit, verdict) with the verdicts pass, warn and fail."""
    across = lambda c: duplicate_groups(df, c, split).agg(F.count_if("crosses").alias("actual"))
    found = [
        (df.agg(F.count_if(text_of(label) == "").alias("actual")), "missing_label", gates.missing_label),
        (df.agg(F.count_if(text_of(id_col) == "").alias("actual")), "missing_key", gates.missing_key),
        (across(exact), "exact_duplicates_across", gates.exact_duplicates_across),
        (across(near), "near_duplicates_across", gates.near_duplicates_across),
        *((across(g), f"groups_across:{g}", gates.groups_across) for g in groups),
    ]
    rows = None
    for frame, name, limit in found:
        one = frame.select(F.lit(name).alias("gate"), F.col("actual").cast("double").alias("actual"), F.lit(float(limit)).alias("limit"),
                           F.when(F.col("actual") > limit, "fail").otherwise("pass").alias("verdict"))
        rows = one if rows is None else rows.unionByName(one)
    tells = (F.col("purity") >= gates.purity) & (F.col("lift") >= gates.lift)
    pure = label_purity(df, groups, label).select(
        F.concat(F.lit("purity:"), "column").alias("gate"), F.coalesce("purity", F.lit(0.0)).alias("actual"), F.lit(gates.purity).alias("limit"),
        F.when(F.coalesce(tells, F.lit(False)), "fail" if gates.fail_on_purity else "warn").otherwise("pass").alias("verdict"))
    return rows.unionByName(pure)


def audit_report(df: DataFrame, id_col: str, label: str, exact: str, near: str, groups: list[str], split: str = "split", gates: Gates = Gates()) -> DataFrame:
    """The whole audit in long form: section, key, metric, value."""
    row = lambda d, section, key, metric, value: d.select(
        F.lit(section).alias("section"), key.alias("key"), F.lit(metric).alias("metric"), value.cast("double").alias("value"))
    parts = [row(missingness(df), "missing", F.col("column"), "n", F.col("n_missing"))]
    for c in (label, split):
        parts.append(row(value_counts(df, c), f"count:{c}", F.col("value"), "n", F.col("n")))
    parts.append(row(cross_table(df, split, label), "cross", F.concat_ws("|", "a", "b"), "n", F.col("n")))
    for c in (exact, near):
        summary = duplicate_summary(df, c, split)
        parts += [row(summary, f"duplicates:{c}", F.lit(""), m, F.col(m)) for m in ("n_groups", "n_rows", "cross_groups", "cross_rows")]
    for g in groups:
        parts.append(row(group_overlap(df, g, split), f"overlap:{g}", F.col("key"), "n", F.col("n")))
    parts.append(row(label_purity(df, groups, label), "purity", F.col("column"), "purity", F.col("purity")))
    verdict = F.when(F.col("verdict") == "pass", 0).when(F.col("verdict") == "warn", 1).otherwise(2)
    parts.append(row(quality_gates(df, id_col, label, exact, near, groups, gates, split), "gate", F.col("gate"), "verdict", verdict))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def selection_counts(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by composite key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
