"""Bundles and media decisions against plain Python."""

import math
import statistics
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import bundles, fusion
from millrace.operators.constraints import ConstraintError


def newton(x, y):
    """Maximum likelihood by plain damped steps from the odds; there the gradient is zero."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    w = np.array([0.0, math.log(y.mean() / (1 - y.mean()))])
    loss = lambda w: np.sum(np.logaddexp(0, w[0] * x + w[1]) - y * (w[0] * x + w[1]))
    for _ in range(300):
        p = 1 / (1 + np.exp(-(w[0] * x + w[1])))
        g = np.array([np.sum((p - y) * x), np.sum(p - y)])
        v = p * (1 - p)
        h = np.array([[np.sum(v * x * x), np.sum(v * x)], [np.sum(v * x), np.sum(v)]]) + 1e-9 * np.eye(2)
        step, size = np.linalg.solve(h, g), 1.0
        while loss(w - size * step) > loss(w) and size > 1e-8:
            size /= 2
        w = w - size * step
    assert np.abs(g).max() < 1e-6
    return w


def test_platt_of_many_groups_at_once(spark):
    rng, rows = np.random.default_rng(3), []
    for g, (scale, shift) in enumerate([(1.0, 0.0), (6.0, 3.0), (0.05, -2.0), (1.0, 40.0), (-2.0, 0.5)]):
        for i in range(60):
            y = int(rng.random() < 0.5)
            rows.append((f"g{g}" if g else None, float(round((y + rng.normal(0, 0.8)) * scale + shift, 2)), y))
    rows += [("one", 1.0, 1), ("one", 2.0, 1), ("g1", None, 1), ("g1", 2.0, None)]
    got = {r.g: r for r in bundles.fit_platt_groups(spark.createDataFrame(rows, "g string, logit double, label int"), ["g"]).collect()}
    for g in ("g1", "g2", "g3", "g4", None):
        x, y = zip(*[(x, y) for h, x, y in rows if h == g and x is not None and y is not None])
        assert np.allclose((got[g].slope, got[g].offset), newton(x, y), rtol=1e-5, atol=1e-6) and got[g].converged and got[g].rows == 60
    assert not got["one"].converged and got["one"].slope is None and len(got) == 6
    apart = bundles.fit_platt_groups(spark.createDataFrame([("a", 1.0, 0), ("a", 2.0, 1)], "g string, logit double, label int"), ["g"], rounds=4).first()
    assert not apart.converged and apart.slope > 3  # classes that lie apart have no best slope
    alone = fusion.fit_platt(spark.createDataFrame([r for r in rows if r[0] == "g1" and None not in r], "g string, logit double, label int"))
    assert np.allclose(alone, (got["g1"].slope, got["g1"].offset), rtol=1e-5)


def summed_up(logits, way):
    ordered, n = sorted(logits), len(logits)
    if way == "mean_probability":
        p = statistics.fmean(1 / (1 + math.exp(-x)) for x in ordered)
        return math.log(p / (1 - p))
    if way == "trimmed":
        cut = int(n * 0.2)
        return statistics.fmean(ordered[cut : n - cut] or ordered)
    return {"mean": statistics.fmean, "median": statistics.median, "top_quarter": lambda x: statistics.fmean(x[-max(1, math.ceil(n * 0.25)) :])}[way](ordered)


def area(fakes, reals):
    return statistics.fmean((f > r) + (f == r) / 2 for f in fakes for r in reals)


def test_bundles_are_fixed_on_one_domain(spark):
    rng, rows = np.random.default_rng(8), []
    for b in ("m1", "m2"):
        for v in range(40):
            method = ["real", "x", "y"][v % 3]
            for f in range(int(rng.integers(1, 9))):
                base = (v % 3 > 0) * (1.5 if b == "m1" else 0.7) + rng.normal(0, 1.2) + (4 if b == "m2" and f == 0 else 0) * (v % 3 > 0)
                rows += [(b, f"v{v}", method, d, int(v % 3 > 0), f, float(base if d == "ff" else -base)) for d in ("ff", "cdf")]
    df = spark.createDataFrame(rows, "model string, video string, method string, domain string, label int, frame int, logit double")
    got = {r.model: r for r in bundles.fit_bundles(df, ["model"], "logit", "video", "method", "domain", "ff").collect()}
    for b in ("m1", "m2"):
        videos = defaultdict(list)
        for m, v, method, d, y, _, x in rows:
            if m == b and d == "ff":
                videos[v, method, y].append(x)
        areas = {}
        for way in fusion.AGGREGATIONS:
            s = {k: summed_up(x, way) for k, x in videos.items()}
            areas[way] = statistics.fmean(area([x for k, x in s.items() if k[1] == m], [x for k, x in s.items() if k[2] == 0]) for m in ("x", "y"))
        way = next(w for w in fusion.AGGREGATIONS if areas[w] >= max(areas.values()) - 0.002)
        scores = [(summed_up(x, way), k[2]) for k, x in videos.items()]
        a, o = newton(*zip(*scores))
        p = [(1 / (1 + math.exp(-(a * x + o))), y) for x, y in scores]
        balanced = {t: (statistics.fmean(q >= t for q, y in p if y) + statistics.fmean(q < t for q, y in p if not y)) / 2 for t, _ in p}
        want = min(t for t in balanced if balanced[t] >= max(balanced.values()) - 1e-12)
        r = got[b]
        assert (r.aggregation, r.videos) == (way, 40) and np.allclose((r.auroc, r.slope, r.offset, r.threshold, r.balanced_accuracy), (areas[way], a, o, want, balanced[want]), rtol=1e-5)
        assert r.version.startswith(f"{b}-") and len(r.version) == len(b) + 13
    assert got["m1"].version != got["m2"].version
    with pytest.raises(ConstraintError, match="clash"):
        bundles.fit_bundles(df.withColumn("mean", F.lit(1)), ["mean"], "logit", "video", "method", "domain", "ff")


CROP = "model string, media_id string, frame int, kind string, status string, reason string, faces string, logit double"


def test_media_are_decided_by_their_crops(spark):
    rng, rows = np.random.default_rng(5), []
    for i in range(60):
        kind = "image" if i % 3 == 0 else "video"
        for f in rng.permutation(1 if i % 6 == 0 else int(rng.integers(1, 12))).tolist():
            ok = rng.random() < 0.6
            rows.append(("m", f"v{i}", f, kind if f else "video" if i % 9 == 0 else kind, "ok" if ok else "skipped", None if ok else str(rng.choice(["blurred", "no_face", "small"])), str(int(rng.integers(0, 4))), float(rng.normal(0, 2)) if ok else None))
    rows += [("m", "none", 0, "image", "skipped", None, None, None), ("m", "lost", 0, "image", "ok", None, "x1" if False else None, None), ("other", "v1", 0, "image", "ok", None, "1", 1.0)]
    told = spark.createDataFrame([("m", "trimmed", 1.5, -0.2, 0.55), ("unused", "mean", 1.0, 0.0, 0.5)], "model string, aggregation string, slope double, offset double, threshold double")
    got = {r.media_id: r for r in bundles.decide_media(spark.createDataFrame(rows, CROP), told, ["model"]).collect()}
    media = defaultdict(list)
    for r in rows:
        if r[0] == "m":
            media[r[1]].append(r)
    assert set(got) == set(media)
    for m, crops in media.items():
        crops.sort(key=lambda r: r[2])
        logits = [r[7] for r in crops if r[4] == "ok" and r[7] is not None]
        reasons = [r[5] or "" for r in crops if not (r[4] == "ok" and r[7] is not None)]
        g, kind = got[m], crops[0][3]
        assert (g.kind, g.frames_sampled, g.frames_scored, g.max_faces) == (kind, len(crops), len(logits), max(int(r[6] or 0) for r in crops))
        if len(logits) < (4 if kind == "video" else 1):
            want = "too_few_faces" if kind == "video" else (reasons[0] if reasons else "no_face")
            assert (g.decision, g.probability, g.logit, g.abstain_reason, g.exclusions) == ("ABSTAIN", None, None, want, dict(Counter(reasons)))
        else:
            x = summed_up(logits, "trimmed")
            p = 1 / (1 + math.exp(-(1.5 * x - 0.2)))
            assert g.decision == ("FAKE" if p >= 0.55 else "REAL") and abs(g.probability - p) < 1e-12 and g.abstain_reason is g.exclusions is None
    one = bundles.decide_media(spark.createDataFrame(rows, CROP), told.where("model = 'm'").drop("model"), [], least=1)
    assert one.count() == len(media) and bundles.decide_media(spark.createDataFrame([], CROP), told, ["model"]).count() == 0
