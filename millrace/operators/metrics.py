"""Binary-classification metrics per slice, all from one table of distinct scores.

``threshold_table`` has, for each slice and distinct score, the positives and negatives at or above
it; ties move together. Every metric is an aggregate over it, and weights stand for repeated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A slice's scores are summed in this many runs between quantiles, so that no task holds a whole slice, wherever
#: its scores crowd; a power of two.
RUNS = 256


def threshold_table(rows: DataFrame, slices: list[str], label: str = "label", score: str = "score", weight: Column | None = None, keep: str | None = None) -> DataFrame:
    """(slices, score, pos, neg, tp, fp, p, n): rows of each class at a score, at or above it, in all;
    and ``keep``, a column of rows that are summed by score already.

    Rows are first summed by distinct score. The running sums are those of the runs of scores above
    plus that inside the run; runs are parted at approximate quantiles of their slice, which only decide
    where a score is summed, not what comes out.
    """
    w = (weight if weight is not None else F.lit(1)).cast("double")
    extra = [keep] if keep else []
    sums = rows.select(*slices, F.col(score).cast("double").alias("score"), *(F.when(F.col(label) == y, w).otherwise(0.0).alias(c) for y, c in ((1, "pos"), (0, "neg"))), keep) if keep else rows.groupBy(
        *slices, F.col(score).cast("double").alias("score")).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col(label) == 0, w).otherwise(0.0)).alias("neg"))
    cuts = F.percentile_approx(F.col(score).cast("double"), [i / RUNS for i in range(1, RUNS)], 8 * RUNS).alias("cuts")
    ends = rows.groupBy(*slices).agg(cuts)
    same = [sums[s].eqNullSafe(ends[s]) for s in slices]
    met = sums.join(ends, _all(same)) if slices else sums.crossJoin(F.broadcast(ends))  # one row
    # how many cuts the score reaches, by halves
    steps = F.array(*(F.lit(RUNS >> i) for i in range(1, RUNS.bit_length())))
    run = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get("cuts", at + step - 1) <= F.col("score"), at + step).otherwise(at))
    placed = met.select(*(sums[s] for s in slices), "score", "pos", "neg", run.alias("run"), *extra)
    totals = placed.groupBy(*slices, "run").agg(F.sum("pos").alias("run_pos"), F.sum("neg").alias("run_neg"))
    above = Window.partitionBy(*slices).orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*slices)
    starts = totals.select(
        *slices, "run", F.coalesce(F.sum("run_pos").over(above), F.lit(0.0)).alias("pos0"), F.coalesce(F.sum("run_neg").over(above), F.lit(0.0)).alias("neg0"),
        F.sum("run_pos").over(whole).alias("p"), F.sum("run_neg").over(whole).alias("n"))
    inside = Window.partitionBy(*slices, "run").orderBy(F.desc("score"))
    summed = placed.withColumn("tp1", F.sum("pos").over(inside)).withColumn("fp1", F.sum("neg").over(inside))
    back = summed.join(starts, _all([summed[s].eqNullSafe(starts[s]) for s in slices] + [summed["run"] == starts["run"]]))
    return back.select(*(summed[s] for s in slices), "score", "pos", "neg", (F.col("pos0") + F.col("tp1")).alias("tp"), (F.col("neg0") + F.col("fp1")).alias("fp"), "p", "n", *extra)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _by(df: DataFrame, slices: list[str]):
    return df.groupBy(*slices)


def _auroc() -> Column:
    won = F.sum(F.col("pos") * (F.col("n") - F.col("fp") + F.col("neg") / 2))
    return F.try_divide(won, F.max("p") * F.max("n")).alias("auroc")


def _average_precision() -> Column:
    return F.try_divide(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.max("p")).alias("average_precision")


def _tpr_at_fpr(budget: float) -> Column:
    rate = F.try_divide(F.col("tp"), F.col("p"))
    return F.coalesce(F.max(F.when(F.try_divide(F.col("fp"), F.col("n")) <= budget, rate)), F.lit(0.0)).alias("tpr_at_fpr")


def _eer() -> Column:
    # the crossing lies between the last point below 0 and the first at or above it
    fpr, gap = F.col("fp") / F.col("n"), F.col("fp") / F.col("n") - (1 - F.col("tp") / F.col("p"))
    there = (F.col("p") > 0) & (F.col("n") > 0)
    point, order = F.struct(fpr.alias("fpr"), gap.alias("gap")), F.struct(gap.alias("g"), (-F.col("score")).alias("s"))
    u, v = F.max_by(F.when(there, point), F.when(there & (gap < 0), order)), F.min_by(F.when(there, point), F.when(there & (gap >= 0), order))
    x0, g0 = F.coalesce(u["fpr"], F.lit(0.0)), F.coalesce(u["gap"], F.lit(-1.0))
    return (x0 + (v["fpr"] - x0) * (-g0) / (v["gap"] - g0)).alias("eer")


def curve_metrics(table: DataFrame, slices: list[str], budget: float = 0.01) -> DataFrame:
    """(slices, auroc, average_precision, tpr_at_fpr, eer) in one aggregate."""
    return _by(table, slices).agg(_auroc(), _average_precision(), _tpr_at_fpr(budget), _eer())


def auroc(table: DataFrame, slices: list[str]) -> DataFrame:
    """Area under the ROC curve with half credit for ties; null if a class is absent."""
    return _by(table, slices).agg(_auroc())


def average_precision(table: DataFrame, slices: list[str]) -> DataFrame:
    """Precision at each distinct score, weighted by the positives there; null without positives."""
    return _by(table, slices).agg(_average_precision())


def tpr_at_fpr(table: DataFrame, slices: list[str], budget: float = 0.01) -> DataFrame:
    """The best true-positive rate whose false-positive rate is within the budget; 0 if none is."""
    return _by(table, slices).agg(_tpr_at_fpr(budget))


def equal_error_rate(table: DataFrame, slices: list[str]) -> DataFrame:
    """Where the false-positive and false-negative rates meet, by linear interpolation between scores."""
    return _by(table.where((F.col("p") > 0) & (F.col("n") > 0)), slices).agg(_eer())


def calibration(rows: DataFrame, slices: list[str], label: str = "label", score: str = "score", bins: int = 10) -> DataFrame:
    """Brier score and expected calibration error over bins of equal width, the last one closed."""
    at = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    sums = rows.groupBy(*slices, at.alias("bin")).agg(
        F.count(F.lit(1)).alias("k"), F.sum(score).alias("s"), F.sum(F.col(label).cast("double")).alias("y"), F.sum((F.col(score) - F.col(label)) ** 2).alias("q"))
    return sums.groupBy(*slices).agg((F.sum("q") / F.sum("k")).alias("brier"), (F.sum(F.abs(F.col("s") - F.col("y"))) / F.sum("k")).alias("ece"))


def at_threshold(rows: DataFrame, slices: list[str], threshold: float | Column, label: str = "label", score: str = "score") -> DataFrame:
    """f1 and balanced_accuracy of scores at or above the threshold."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    called, y = F.col(score) >= t, F.col(label)
    return rows.groupBy(*slices).agg(
        F.try_divide(2.0 * F.count_if(called & (y == 1)), F.count_if(called) + F.count_if(y == 1)).alias("f1"),
        ((F.try_divide(F.count_if(called & (y == 1)), F.count_if(y == 1)) + F.try_divide(F.count_if(~called & (y == 0)), F.count_if(y == 0))) / 2).alias("balanced_accuracy"))


def best_threshold(table: DataFrame, slices: list[str]) -> DataFrame:
    """(threshold, balanced_accuracy): the observed score of best balanced accuracy, the lowest of equals."""
    value = (F.col("tp") / F.col("p") + 1 - F.col("fp") / F.col("n")) / 2
    order = F.col("tp") * F.col("n") - F.col("fp") * F.col("p")  # of whole numbers, so that equals are equal
    return table.where((F.col("p") > 0) & (F.col("n") > 0)).groupBy(*slices).agg(
        F.max(F.struct(order.alias("o"), (-F.col("score")).alias("s"), value.alias("v"))).alias("x")).select(
        *slices, (-F.col("x.s")).alias("threshold"), F.col("x.v").alias("balanced_accuracy"))


def against_reals(rows: DataFrame, method: str, domain: str, label: str = "label") -> DataFrame:
    """Each method's fakes with all reals of its domain: reals are repeated for each method there is.

    Methods are a few names, found from the fakes, not rows.
    """
    fakes = rows.where(F.col(label) == 1)
    methods = fakes.select(domain, F.col(method).alias("slice_method")).distinct()
    reals = rows.where(F.col(label) == 0).join(methods, domain)
    return fakes.withColumn("slice_method", F.col(method)).unionByName(reals.select(*rows.columns, "slice_method"))


def areas_by_method(rows: DataFrame, slices: list[str], method: str, label: str = "label", score: str = "score", weight: Column | None = None) -> DataFrame:
    """(slices, slice_method, auroc): each method's fakes against all reals of their slice, half credit
    for ties; null without reals.

    The reals are summed once, not repeated for each method: the running sums hold them, and a score's
    fakes are a short list by method beside it.
    """
    w = (weight if weight is not None else F.lit(1)).cast("double")
    each = rows.groupBy(*slices, F.col(method).alias("slice_method"), F.col(score).cast("double").alias("score"), F.col(label).alias("label")).agg(F.sum(w).alias("w"))
    at = each.groupBy(*slices, "score").agg(
        F.collect_list(F.when(F.col("label") == 1, F.struct("slice_method", "w"))).alias("fakes"), F.sum(F.when(F.col("label") == 0, F.col("w")).otherwise(0.0)).alias("w"))
    table = threshold_table(at.withColumn("label", F.lit(0)), slices, weight=F.col("w"), keep="fakes")
    won = table.select(*slices, "n", (F.col("n") - F.col("fp") + F.col("neg") / 2).alias("lower"), F.inline("fakes"))
    return won.groupBy(*slices, "slice_method").agg(F.try_divide(F.sum(F.col("w") * F.col("lower")), F.sum("w") * F.max("n")).alias("auroc"))


def metric_report(rows: DataFrame, slices: list[str], threshold: float, label: str = "label", score: str = "score", budget: float = 0.01) -> DataFrame:
    """All metrics of each slice in one row."""
    out = curve_metrics(threshold_table(rows, slices, label, score), slices, budget)
    for more in (calibration(rows, slices, label, score), at_threshold(rows, slices, threshold, label, score)):
        out = out.join(more, slices, "left")
    return out


def macro_by_method(rows: DataFrame, method: str, domain: str, label: str = "label", score: str = "score", budget: float = 0.01) -> DataFrame:
    """(domain, method, auroc, average_precision, tpr_at_fpr, eer) and the unweighted mean as method ``macro``."""
    paired, slices = against_reals(rows, method, domain, label), [domain, "slice_method"]
    table = threshold_table(paired, slices, label, score)
    each = curve_metrics(table, slices, budget)
    names = ["auroc", "average_precision", "tpr_at_fpr", "eer"]
    mean = each.groupBy(domain).agg(*(F.avg(c).alias(c) for c in names)).select(domain, F.lit("macro").alias("slice_method"), *names)
    return each.select(domain, "slice_method", *names).unionByName(mean)


def fake_recall(rows: DataFrame, slices: list[str], threshold: float, label: str = "label", score: str = "score") -> DataFrame:
    """Share of fakes at or above the threshold."""
    return rows.where(F.col(label) == 1).groupBy(*slices).agg(F.avg((F.col(score) >= threshold).cast("double")).alias("recall"))


def video_scores(frames: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """(keys, score, frames): mean score of each video."""
    return frames.groupBy(*keys).agg(F.avg(score).alias("score"), F.count(F.lit(1)).alias("frames"))


def robust_logits(frames: DataFrame, keys: list[str], logit: str) -> DataFrame:
    """Five ways to sum up a video's logits: mean_probability (as a logit), mean, median, trimmed (a
    fifth off each side) and top_quarter.

    Rank and count are enough: each is an aggregate over ranked rows of one video.
    """
    within = Window.partitionBy(*keys)
    ranked = frames.select(*keys, F.col(logit).alias("x")).withColumn("r", F.row_number().over(within.orderBy("x"))).withColumn("k", F.count(F.lit(1)).over(within))
    side = F.floor(F.col("k") * 0.2)
    top = F.greatest(F.lit(1), F.ceil(F.col("k") * 0.25))
    p = F.avg(1 / (1 + F.exp(-F.col("x"))))
    return ranked.groupBy(*keys).agg(
        F.log(p / (1 - p)).alias("mean_probability"), F.avg("x").alias("mean"), F.avg(F.when(F.col("r").between(F.floor((F.col("k") + 1) / 2), F.floor(F.col("k") / 2) + 1), F.col("x"))).alias("median"),
        F.avg(F.when((F.col("r") > side) & (F.col("r") <= F.col("k") - side), F.col("x"))).alias("trimmed"), F.avg(F.when(F.col("r") > F.col("k") - top, F.col("x"))).alias("top_quarter"))


def spread(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, mean, sd, low, high, n_seeds): over seeds; the standard deviation of one value is 0."""
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n_seeds"))


def robustness(rows: DataFrame, slices: list[str], corruption: str, clean: str, label: str = "label", score: str = "score") -> DataFrame:
    """(slices, corruption, auroc, drop): area by corruption and its drop from the clean one."""
    every = auroc(threshold_table(rows, [*slices, corruption], label, score), [*slices, corruption])
    base = every.where(F.col(corruption) == clean).select(*slices, F.col("auroc").alias("base"))
    return every.join(base, slices).select(*slices, corruption, "auroc", (F.col("base") - F.col("auroc")).alias("drop"))
