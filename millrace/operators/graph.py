"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.durable import discard, stored


def _to_least(pairs: DataFrame, lower_only: bool) -> DataFrame:
    """Link the neighbours of each node to the least of them and the node.

    ``pairs`` (u, v); with ``lower_only`` v < u and u itself is linked as well, else only v > u.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = pairs.join(least, "u")
    if lower_only:
        out = met.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        return out.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
    return met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b); the label is the component's least node.

    Each round links every node to the least node it knows of, first over its greater and then
    over its lesser neighbours, until the links are stars. The rounds grow with the logarithm of
    the number of nodes; a round is joins and minima, which Spark splits at hot nodes.
    """
    edges, before = stored(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        last, edges = edges, stored(_to_least(_to_least(both, False), True))
        discard(last)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    out = stored(stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct()))
    discard(edges)
    return out


def token_components(rows: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, root) of rows that share tokens, directly or over others; the root is the component's
    least token. Rows without tokens are left out."""
    each = rows.select(key, F.explode(F.array_sort(F.array_distinct(tokens))).alias("b"), F.array_min(tokens).alias("a"))
    labels = components(each.select("a", "b"))
    least = rows.where(F.size(tokens) > 0).select(key, F.array_min(tokens).alias("node")).distinct()
    return least.join(labels, "node", "left").select(key, F.coalesce("label", "node").alias("root"))
