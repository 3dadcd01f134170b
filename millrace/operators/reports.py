"""Reports over several runs at once: one threshold table for all runs, domains and methods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import text_of
from millrace.operators.constraints import ConstraintError, require_none, same_provenance
from millrace.operators.metrics import against_reals, best_threshold, curve_metrics, metric_report, spread, threshold_table, video_scores

METRICS = ("auroc", "average_precision", "tpr_at_fpr", "eer")


def video_rows(frames: DataFrame, keys: list[str], lineage: str = "lineage_video_ids", score: str = "score") -> DataFrame:
    """(keys, score, frames, lineage): mean score of each video with its one lineage. A video whose frames
    tell several, an empty one among them, is an error when its row is read."""
    told = F.max(text_of(lineage))
    conflict = F.raise_error(F.concat(F.lit("several lineages in "), F.concat_ws("/", *(F.col(k).cast("string") for k in keys)))).cast("string")
    out = frames.groupBy(*keys).agg(F.avg(score).alias("score"), F.count(F.lit(1)).alias("frames"), told.alias("told"), F.min(text_of(lineage)).alias("other"))
    return out.select(*keys, "score", "frames", F.when(F.col("told") == F.col("other"), F.col("told")).otherwise(conflict).alias(lineage))


def run_metrics(videos: DataFrame, runs: list[str], method: str = "method", domain: str = "domain", label: str = "label", score: str = "score", budget: float = 0.01) -> DataFrame:
    """(runs, domain, method, metric, value): every metric of each method's fakes against the reals of their
    run and domain, and the unweighted mean of the methods as ``macro``.

    A method without reals or fakes is an error when its row is read: a mean over fewer methods would look
    better. All of it is one threshold table and one aggregate.
    """
    place = "place_of_run"
    rows = videos.withColumn(place, F.struct(*(F.col(r) for r in runs), F.col(domain).alias("domain")))
    table = threshold_table(against_reals(rows, method, place, label), [place, "slice_method"], label, score)
    lacking = F.raise_error(F.concat(F.lit("a class is missing for "), text_of("slice_method"), F.lit(" in "), F.to_json(place))).cast("double")
    whole = table.withColumn("n", F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("n")).otherwise(lacking))
    each = curve_metrics(whole, [place, "slice_method"], budget)
    values = F.explode(F.create_map(*(x for m in METRICS for x in (F.lit(m), F.col(m))))).alias("metric", "value")
    long = each.select(place, F.col("slice_method").alias("method"), values)
    named = F.when(F.grouping("method") == 1, "macro").otherwise(F.col("method")).alias("name")
    both = long.groupingSets([[place, "metric", "method"], [place, "metric"]], place, "metric", "method").agg(F.avg("value").alias("value"), named)
    return both.select(*(F.col(f"{place}.{r}").alias(r) for r in runs), F.col(f"{place}.domain").alias("domain"), F.col("name").alias("method"), "metric", "value")


def seed_summary(videos: DataFrame, metadata: DataFrame, provenance: list[str], keys: list[str], seeds: int = 3, run: str = "run") -> DataFrame:
    """(domain, method, metric, mean, sd, low, high, n_seeds) over runs that differ in their seed only.

    ``metadata`` (run, seed, provenance) must have exactly ``seeds`` runs of different seeds and equal
    provenance, and each run must score the same ``keys`` once each; anything else is an error.
    """
    told = metadata.select(run, "seed", *provenance).limit(seeds + 1).collect()
    if len(told) != seeds or len({r[run] for r in told}) != seeds:
        raise ConstraintError(f"a summary needs {seeds} runs")
    if len({r.seed for r in told}) != seeds or any(r.seed is None for r in told):
        raise ConstraintError(f"a summary needs {seeds} different seeds")
    require_none(same_provenance(metadata, run, provenance), "runs that don't share their provenance", "column", "values")
    asked = videos.join(F.broadcast(metadata.select(run)), run, "left_semi")
    counts = asked.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.size(F.collect_set(run)).alias("runs"))
    require_none(counts.where((F.col("runs") != seeds) | (F.col("rows") != seeds)), "keys that aren't scored once by each run", *keys)
    return spread(run_metrics(asked, [run]), ["domain", "method", "metric"], "value")


def compare_runs(values: DataFrame, comparisons: DataFrame, run: str = "run") -> DataFrame:
    """(name, domain, method, metric, baseline, candidate, diff, status) of configured comparisons
    (name, baseline, candidate) of runs.

    A comparison of which a run is absent has one row that names it in ``status``, without values; a slice
    that one of two present runs lacks is ``lacks a slice``. Others are ``ok``.
    """
    there = values.select(F.col(run).alias("there")).distinct()
    known = comparisons.join(there, F.col("baseline") == F.col("there"), "left").withColumn("has_baseline", F.col("there").isNotNull()).drop("there").join(
        there, F.col("candidate") == F.col("there"), "left").withColumn("has_candidate", F.col("there").isNotNull()).drop("there")
    absent = F.concat(F.lit("absent: "), F.concat_ws(", ", F.when(~F.col("has_baseline"), F.col("baseline").cast("string")), F.when(~F.col("has_candidate"), F.col("candidate").cast("string"))))
    whole = F.col("has_baseline") & F.col("has_candidate")
    sides = known.where(whole).select("name", F.explode(F.array(F.struct(F.lit("b").alias("side"), F.col("baseline").alias("of")), F.struct(F.lit("c").alias("side"), F.col("candidate").alias("of")))).alias("s")).select("name", "s.*")
    met = sides.join(values, F.col("of") == F.col(run)).groupBy("name", "domain", "method", "metric").agg(
        F.max(F.when(F.col("side") == "b", F.col("value"))).alias("baseline"), F.max(F.when(F.col("side") == "c", F.col("value"))).alias("candidate"))
    status = F.when(F.col("baseline").isNull() | F.col("candidate").isNull(), "lacks a slice").otherwise("ok")
    out = met.select("name", "domain", "method", "metric", "baseline", "candidate", (F.col("candidate") - F.col("baseline")).alias("diff"), status.alias("status"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("domain", "string"), ("method", "string"), ("metric", "string"), ("baseline", "double"), ("candidate", "double"), ("diff", "double"))]
    return out.unionByName(known.where(~whole).select("name", *nothing, absent.alias("status")))


def locked_report(frames: DataFrame, keys: list[str], split: str = "split", label: str = "label", score: str = "score") -> DataFrame:
    """(split, unit, threshold, metrics) of validation and test frames and of their videos (``keys``), all at
    the threshold of best balanced accuracy of the validation videos; the test rows never move it.

    A validation split without both classes is an error.
    """
    rows = frames.where(F.col(split).isin("validation", "test"))
    videos = video_scores(rows, [split, *keys, label], score)
    table = threshold_table(videos.where(F.col(split) == "validation"), [split], label)
    best = best_threshold(table, [split]).first()
    if best is None:
        raise ConstraintError("no threshold: the validation videos lack a class")
    long = rows.select(split, F.lit("frame").alias("unit"), F.col(label).alias("label"), F.col(score).cast("double").alias("score")).unionByName(
        videos.select(split, F.lit("video").alias("unit"), F.col(label).alias("label"), "score"))
    return metric_report(long, [split, "unit"], best.threshold).withColumn("threshold", F.lit(best.threshold))
