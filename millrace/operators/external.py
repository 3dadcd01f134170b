"""Decisions on an external set: labels by medium, people that development knows, and a paired comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import identity_tokens, text_of
from millrace.operators.fusion import bootstrap_difference


def people(domain: str, media: Column) -> Column:
    """Sorted identity tokens of a medium's name, as ``domain:token``; none if the name tells nobody."""
    return F.transform(F.array_sort(identity_tokens(media)), lambda t: F.concat(F.lit(f"{domain}:"), t))


def development_identities(manifest: DataFrame, domain: str = "cdf") -> DataFrame:
    """(identity) of everybody in the validation videos of a domain."""
    rows = manifest.where((F.col("split") == "validation") & (F.col("source_domain") == domain))
    return rows.select(F.explode(people(domain, text_of("video_id"))).alias("identity")).distinct()


def labelled(decisions: DataFrame, labels: DataFrame) -> DataFrame:
    """Decisions (media_id, ...) with ``label`` 1 for FAKE and 0 for REAL by ``labels`` (media_id, label). A
    decision on a medium without a label is an error when its row is read, as is a medium with two labels."""
    told = labels.groupBy("media_id").agg(F.min("label").alias("told"), F.max("label").alias("other"))
    unknown = F.raise_error(F.concat(F.lit("no single label for "), text_of("media_id"))).cast("int")
    sure = F.when(F.col("told") == F.col("other"), F.col("told"))
    number = F.when(sure == "FAKE", 1).when(sure == "REAL", 0).otherwise(unknown)
    return decisions.join(told, "media_id", "left").withColumn("label", number).drop("told", "other")


def paired_comparison(decisions: DataFrame, labels: DataFrame, baseline: str, candidate: str, repeats: int, seed: str, domain: str = "cdf", bundle: str = "bundle") -> DataFrame:
    """(domain, diff, low, high, valid, clear, shared): the bootstrap of two bundles' areas over the media
    that both decided.

    Clusters are components of people, so that a person's real and fake videos stay together; a medium
    that names nobody is a cluster of its own.
    """
    each = labelled(decisions.where(F.col(bundle).isin(baseline, candidate) & F.col("probability").isNotNull()), labels)
    score = lambda name: F.max(F.when(F.col(bundle) == name, F.col("probability")))
    both = each.groupBy("media_id", "label").agg(score(baseline).alias("base"), score(candidate).alias("candidate")).where("base IS NOT NULL AND candidate IS NOT NULL")
    named = people(domain, text_of("media_id"))
    rows = both.select("base", "candidate", "label", F.lit(domain).alias("domain"), F.when(F.col("label") == 1, "fake").otherwise("").alias("method"),
                       F.when(F.size(named) > 0, named).otherwise(F.array(F.concat(F.lit(f"{domain}:video:"), "media_id"))).alias("lineage"))
    shared = rows.agg(F.count(F.lit(1)).alias("shared"))
    return bootstrap_difference(rows, "base", "candidate", "method", "domain", "lineage", repeats, seed).crossJoin(F.broadcast(shared))  # one row
