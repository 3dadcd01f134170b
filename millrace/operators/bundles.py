"""Release bundles: aggregation, calibration and threshold of many models at once, and the decisions they make.

A bundle is fixed on the development videos of one domain alone, in this order: how a video's logits are
summed up, slope and offset of the calibration, the threshold of the calibrated scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalars import sigmoid, text_of
from millrace.operators.constraints import ConstraintError
from millrace.operators.fusion import AGGREGATIONS, TIE_MARGIN
from millrace.operators.metrics import areas_by_method, best_threshold, robust_logits, threshold_table
from millrace.plans.durable import discard, stored


def _same(a: str, b: str, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def fit_platt_groups(rows: DataFrame, keys: list[str], value: str = "logit", label: str = "label", ridge: float = 1e-9, rounds: int = 100, stop: float = 1e-10) -> DataFrame:
    """(keys, slope, offset, rows, converged): sigmoid(slope x + offset) of greatest likelihood in each group,
    by damped Newton steps from slope 0 and the group's own odds.

    Rows are first summed by group and value. A round is one aggregate over the groups that still move: it
    tries each group's step at the group's own pace. What doesn't raise the likelihood is tried again at
    half the pace, down to 1e-8. Groups and their steps stay a table; the driver only counts open ones.
    Rows without value or label take no part. A group of one class has no best slope: slope and offset are
    null. One whose classes lie apart ends when a step no longer lessens the loss. Null keys are a group.
    """
    x, n, pos = F.col("x"), F.col("n"), F.col("pos")
    kept = rows.where(F.col(value).isNotNull() & F.col(label).isNotNull())
    counted = stored(kept.groupBy(*keys, F.col(value).cast("double").alias("x")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum((F.col(label) == 1).cast("double")).alias("pos")))
    odds = F.coalesce(F.log(F.try_divide(F.col("ones"), F.col("rows") - F.col("ones"))), F.lit(0.0))
    number = [F.lit(v).cast("double").alias(c) for c, v in (("da", 0.0), ("db", 0.0), ("pace", 1.0), ("best", float("inf")))]
    two = F.sum("pos").between(1.0, F.sum("n") - 1)
    state = stored(counted.groupBy(*keys).agg(F.sum("n").cast("long").alias("rows"), F.sum("pos").alias("ones"), two.alias("two")).select(
        *keys, "rows", "two", F.lit(0.0).alias("a"), odds.alias("b"), *number, F.lit(0).alias("steps"), F.lit(False).alias("converged"), F.col("two").alias("open")))
    while not state.where("open").isEmpty():
        z = (F.col("a") - F.col("pace") * F.col("da")) * x + F.col("b") - F.col("pace") * F.col("db")
        p = sigmoid(z)
        v = n * p * (1 - p)
        loss = n * (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))) - pos * z
        sums = counted.alias("c").join(state.where("open").alias("s"), _same("c", "s", keys)).groupBy(*(F.col(f"s.{k}").alias(k) for k in keys)).agg(
            F.sum(loss).alias("loss"), F.sum((n * p - pos) * x).alias("ga"), F.sum(n * p - pos).alias("gb"), (F.sum(v * x * x) + ridge).alias("haa"), F.sum(v * x).alias("hab"), (F.sum(v) + ridge).alias("hbb"))
        met = state.alias("s").join(sums.alias("t"), _same("s", "t", keys), "left").select("s.*", *(f"t.{c}" for c in ("loss", "ga", "gb", "haa", "hab", "hbb")))
        taken = F.col("open") & ((F.col("loss") <= F.col("best")) | (F.col("pace") <= 1e-8))
        moved = F.greatest(F.abs(F.col("pace") * F.col("da")), F.abs(F.col("pace") * F.col("db")))
        still = taken & (F.col("steps") > 0) & ((moved < stop) | (F.col("best") - F.col("loss") < stop))
        det = F.col("haa") * F.col("hbb") - F.col("hab") * F.col("hab")
        step = {"da": F.try_divide(F.col("hbb") * F.col("ga") - F.col("hab") * F.col("gb"), det), "db": F.try_divide(F.col("haa") * F.col("gb") - F.col("hab") * F.col("ga"), det)}
        over = taken & (F.col("steps") >= rounds)
        before, state = state, stored(met.select(
            *keys, "rows", "two", *(F.when(taken, F.col(c) - F.col("pace") * F.col(f"d{c}")).otherwise(F.col(c)).alias(c) for c in ("a", "b")),
            *(F.when(taken, F.coalesce(step[c], F.lit(0.0))).otherwise(F.col(c)).alias(c) for c in ("da", "db")),
            F.when(taken, F.lit(1.0)).when(F.col("open"), F.col("pace") / 2).otherwise(F.col("pace")).alias("pace"), F.when(taken, F.col("loss")).otherwise(F.col("best")).alias("best"),
            F.when(taken, F.col("steps") + 1).otherwise(F.col("steps")).alias("steps"), (F.col("converged") | still).alias("converged"), (F.col("open") & ~still & ~over).alias("open")))
        discard(before)
    discard(counted)
    return state.select(*keys, F.when(F.col("two"), F.col("a")).alias("slope"), F.when(F.col("two"), F.col("b")).alias("offset"), "rows", "converged")


def _picked(name: Column) -> Column:
    """A video's logit summed up in the way that is named."""
    out = F.when(name == AGGREGATIONS[0], F.col(AGGREGATIONS[0]))
    for other in AGGREGATIONS[1:]:
        out = out.when(name == other, F.col(other))
    return out


def fit_bundles(frames: DataFrame, bundle: list[str], logit: str, video: str, method: str, domain: str, select_on: str, label: str = "label", model: Column | None = None) -> DataFrame:
    """(bundle, aggregation, auroc, slope, offset, threshold, balanced_accuracy, videos, version): one row for
    each bundle, fixed on the frames of the domain ``select_on``; other domains never move it.

    The aggregation is the first in order of preference whose macro area is within the margin of the best;
    slope, offset and threshold follow for it. ``version`` is the model's name and twelve digits of the hash
    of all of that. A bundle without both classes gets no row.
    """
    if clash := sorted({*bundle} & {"video", "method", "label", *AGGREGATIONS}):
        raise ConstraintError(f"bundle columns clash with the operator's: {', '.join(clash)}")
    named = frames.where(F.col(domain) == select_on).select(*bundle, F.col(video).alias("video"), F.col(method).alias("method"), F.col(label).alias("label"), F.col(logit).alias("x"))
    videos = stored(robust_logits(named, [*bundle, "video", "method", "label"], "x"))
    ways = F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(a).alias("aggregation"), F.col(a).alias("score")) for i, a in enumerate(AGGREGATIONS)))).alias("way")
    areas = areas_by_method(videos.select(*bundle, "method", "label", ways).select(*bundle, "method", "label", "way.*"), [*bundle, "place", "aggregation"], "method")
    macro = areas.groupBy(*bundle, "place", "aggregation").agg(F.avg("auroc").alias("auroc"))
    best = F.max("auroc").over(Window.partitionBy(*bundle))  # one row for each way
    near = macro.withColumn("best", best).where(F.col("auroc") >= F.col("best") - TIE_MARGIN)
    chosen = near.groupBy(*bundle).agg(F.min_by("aggregation", "place").alias("aggregation"), F.min_by("auroc", "place").alias("auroc"))
    summed = stored(videos.alias("v").join(chosen.alias("c"), _same("v", "c", bundle)).select(*(f"v.{k}" for k in bundle), "label", _picked(F.col("c.aggregation")).alias("logit")))
    fitted = stored(fit_platt_groups(summed, bundle))
    scored = summed.alias("v").join(fitted.alias("f"), _same("v", "f", bundle)).select(*(f"v.{k}" for k in bundle), "label", sigmoid(F.col("slope") * F.col("logit") + F.col("offset")).alias("score"))
    bounds = best_threshold(threshold_table(scored, bundle), bundle)
    out = chosen.alias("c").join(fitted.alias("f"), _same("c", "f", bundle)).join(bounds.alias("b"), _same("c", "b", bundle)).select(
        *(F.col(f"c.{k}").alias(k) for k in bundle), "aggregation", "auroc", "slope", "offset", "threshold", "balanced_accuracy", F.col("rows").alias("videos"))
    told = F.sha2(F.to_json(F.struct(*out.columns)), 256)
    return out.withColumn("version", F.concat_ws("-", model if model is not None else F.concat_ws("/", *(text_of(k) for k in bundle)), F.substring(told, 1, 12)))


def decide_media(crops: DataFrame, bundles: DataFrame, bundle: list[str], media: str = "media_id", frame: str = "frame", kind: str = "kind", status: str = "status", reason: str = "reason",
                 faces: str = "faces", logit: str = "logit", least: int = 4) -> DataFrame:
    """(bundle, media, kind, decision, probability, logit, frames_sampled, frames_scored, max_faces,
    abstain_reason, exclusions): one decision for each medium of scored crops.

    ``bundles`` (bundle, aggregation, slope, offset, threshold) meet the crops of their own bundle columns;
    without any, one row of bundles serves all. Crops whose status is ``ok`` and that have a logit are
    scored; a video needs ``least`` of them, an image one, else the decision is ABSTAIN: a video for
    ``too_few_faces``, an image for its first reason by frame, or ``no_face``. ``exclusions`` counts the
    reasons (null is empty) and is null for decided media. The kind is that of the first frame; ties of
    frame go by kind and reason. Crops without bundle are left out.
    """
    keys = [*bundle, media]
    good = F.coalesce((F.col(status) == "ok") & F.col(logit).isNotNull(), F.lit(False))
    order = F.struct(F.col(frame).isNotNull(), F.col(frame), text_of(kind), text_of(reason))
    # by reason first, so that a medium's row is made of its few reasons and not of its frames
    parts = crops.groupBy(*keys, good.alias("good"), F.when(~good, text_of(reason)).alias("why")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.coalesce(F.col(faces).cast("long"), F.lit(0))).alias("faces"), F.min(order).alias("at"), F.min_by(F.col(kind), order).alias("kind"))
    counts = parts.groupBy(*keys).agg(
        F.min_by("kind", "at").alias("kind"), F.sum("n").alias("frames_sampled"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("frames_scored"), F.max("faces").alias("max_faces"),
        F.min_by("why", F.when(~F.col("good"), F.col("at"))).alias("first_reason"), F.array_sort(F.collect_list(F.when(~F.col("good"), F.struct("why", "n")))).alias("exclusions"))
    logits = robust_logits(crops.where(good).select(*keys, F.col(logit).cast("double").alias("x")), keys, "x")
    met = counts.alias("m").join(logits.alias("l"), _same("m", "l", keys), "left").select("m.*", *(f"l.{a}" for a in AGGREGATIONS))
    told = bundles.select(*bundle, "aggregation", "slope", "offset", "threshold")
    joined = met.alias("m").join(told.alias("b"), _same("m", "b", bundle)) if bundle else met.alias("m").crossJoin(F.broadcast(told.limit(2)).alias("b"))  # one row
    video = F.col("kind") == "video"
    enough = F.col("frames_scored") >= F.when(video, least).otherwise(1)
    value = F.when(enough, _picked(F.col("aggregation")))
    probability = F.when(value.isNotNull(), sigmoid(F.col("slope") * value + F.col("offset")))
    decision = F.when(~enough, "ABSTAIN").when(probability >= F.col("threshold"), "FAKE").otherwise("REAL")
    why = F.when(~enough, F.when(video, "too_few_faces").otherwise(F.coalesce("first_reason", F.lit("no_face"))))
    return joined.select(
        *(F.col(f"m.{k}").alias(k) for k in keys), "kind", decision.alias("decision"), probability.alias("probability"), value.alias("logit"), "frames_sampled", "frames_scored", "max_faces",
        why.alias("abstain_reason"), F.when(~enough, F.map_from_entries("exclusions")).alias("exclusions"))
