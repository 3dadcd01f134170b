"""Operators on hand-made cases, against plain Python, and on odd input."""

import hashlib
import json
import math
import zipfile
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace import cli
from millrace.functions import scalars as s
from millrace.operators import audit, catalog, constraints, fusion, gates, graph, media, metrics, reporting, sampling
from millrace.sources import readers, writers
from millrace.streaming import incremental


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def audit_rows(spark):
    return spark.createDataFrame([
        ("a", "x/a.png", "REAL", "train", "p1", "", "h1"), ("b", "x/b.png", "REAL", "test", "p1", "", "h1"),
        ("c", "x/c.png", "FAKE", "train", "p2", "swap", "h2"), ("d", "x/d.png", "FAKE", "validation", "p3", "swap", "h3"),
        ("e", "x/e.png", "", "train", "p4", "swap", "")], "id string, path string, label string, split string, identity string, method string, hash string")


# audit

def test_audit_of_a_small_catalog(spark):
    df = audit_rows(spark)
    assert rows_of(audit.value_counts(df, "label"), "value", "n") == [("<MISSING>", 1), ("FAKE", 2), ("REAL", 2)]
    table = {(r.a, r.b): r.n for r in audit.cross_table(df, "split", "label").collect()}
    assert len(table) == 9 and table["train", "REAL"] == 1 and table["test", "FAKE"] == 0
    assert dict(rows_of(audit.missingness(df), "column", "n_missing"))["hash"] == 1
    assert rows_of(audit.duplicate_groups(df, "hash"), "key", "n", "splits", "crosses") == [("h1", 2, "test,train", True)]
    assert tuple(audit.duplicate_summary(df, "hash").first()) == (1, 2, 1, 2)
    assert rows_of(audit.group_overlap(df, "identity"), "key") == [("p1",)]
    pure = {r.column: r for r in audit.label_purity(df, ["method", "identity"], "label").collect()}
    assert pure["method"].purity == 1.0 and pure["method"].lift == 0.5 and pure["method"].n == 4
    verdicts = {r.gate: r.verdict for r in audit.quality_gates(df, "id", "label", "hash", "hash", ["identity", "method"]).collect()}
    assert verdicts["missing_label"] == "fail" and verdicts["purity:method"] == "warn" and verdicts["missing_key"] == "pass"
    report = audit.audit_report(df, "id", "label", "hash", "hash", ["identity"])
    assert ("gate", "missing_label", 2.0) in rows_of(report, "section", "key", "value")


def test_purity_guard_is_strict(spark):
    df = spark.createDataFrame([(f"v{i}", "A") for i in range(51)] + [("v0", "B")] * 10, "c string, label string")
    assert audit.label_purity(df, ["c"], "label").first().purity is None
    df = spark.createDataFrame([(f"v{i}", "A") for i in range(50)], "c string, label string")
    assert audit.label_purity(df, ["c"], "label").first().purity == 1.0


def test_audit_of_an_empty_table(spark):
    df = audit_rows(spark).limit(0)
    assert tuple(audit.duplicate_summary(df, "hash").first()) == (0, 0, 0, 0)
    assert audit.cross_table(df, "split", "label").count() == 0 and audit.label_purity(df, ["method"], "label").count() == 0
    assert {r.n_missing for r in audit.missingness(df).collect()} == {0}


# constraints

def test_constraints(spark):
    df = audit_rows(spark)
    with pytest.raises(constraints.ConstraintError, match="missing columns: no, nope"):
        constraints.require_columns(df, ["id", "nope", "no"])
    with pytest.raises(constraints.ConstraintError, match="repeated: h1"):
        constraints.require_none(constraints.key_violations(df, "hash").where("value <> ''"), "repeated", "value")
    assert rows_of(constraints.key_violations(df, "id", "hash"), "key_column", "value", "n") == [("hash", "", 1), ("hash", "h1", 2)]
    assert rows_of(constraints.split_violations(df, ["identity", "hash"]), "group_column", "value") == [("hash", "h1"), ("identity", "p1")]
    assert rows_of(constraints.unexpected_values(df, "split", ["train", "test"]), "value") == [("validation",)]
    assert constraints.unexpected_values(df, "split", []).count() == 0
    first, bad = constraints.conflicting_duplicates(df, "hash", ["label", "split"], ["id"])
    assert rows_of(first, "hash", "id") == [("", "e"), ("h1", "a"), ("h2", "c"), ("h3", "d")] and rows_of(bad, "hash", "n") == [("h1", 2)]
    paths = spark.createDataFrame([(p,) for p in ("a/b.png", "", "/a", "a/../b", "a//b", "./a", "c:d", None)], "path string")
    assert constraints.unsafe_paths(paths, "path").count() == 7
    inputs = spark.createDataFrame([("r1", "m1", "h"), ("r2", "m2", "h")], "run string, manifest string, hash string")
    assert rows_of(constraints.same_provenance(inputs, "run", ["manifest", "hash"]), "column", "values") == [("manifest", "m1,m2")]


# sampling

def greedy(sizes, images, frames):
    left, out = images, {}
    for group, n in sizes:
        take = min(n, frames, left)
        if take <= 0:
            break
        out[group], left = take, left - take
    return out


def test_quota_is_the_greedy_one(spark):
    rng = np.random.default_rng(0)
    for seed in ("a", "b"):
        counts = {g: int(rng.integers(1, 9)) for g in range(40)}
        df = spark.createDataFrame([("c", g) for g, n in counts.items() for _ in range(n)], "cell string, g long")
        got = sampling.quota_groups(df, ["cell"], "g", seed, 70, 4).collect()
        order = sorted(counts, key=lambda g: (__import__("hashlib").sha256(f"{seed}\0{g}".encode()).hexdigest(), g))
        assert {r.g: r.take for r in got} == greedy([(g, counts[g]) for g in order], 70, 4)
        capped = sampling.quota_groups(df, ["cell"], "g", seed, 70, 4, max_groups=5).collect()
        assert {r.g for r in capped} == set(order[:5])


def python_positions(n, limit):
    if n <= limit:
        return list(range(n))
    return [n // 2] if limit == 1 else [round(i * (n - 1) / (limit - 1)) for i in range(limit)]


def test_even_positions(spark):
    df = spark.createDataFrame([(n,) for n in range(60)], "n long")
    for limit in (1, 2, 3, 7):
        got = {r.n: r.p for r in df.select("n", s.even_positions(F.col("n"), limit).alias("p")).collect()}
        assert all(got[n] == python_positions(n, limit) for n in got)


def test_subset_doesn_t_depend_on_the_order_of_rows(spark):
    rows = [(label, split, f"m{m}" if label == "FAKE" else "", f"{split}{m}{label}{g}", f)
            for split in ("train", "test") for label in ("FAKE", "REAL") for m in range(2) for g in range(3) for f in range(5)]
    schema, spec = "label string, split string, method string, group string, frame int", sampling.SubsetSpec("s", 6, 3)
    one = sampling.build_subset(spark.createDataFrame(rows, schema), spec).collect()
    two = sampling.build_subset(spark.createDataFrame(rows[::-1], schema), spec).collect()
    assert sorted(one) == sorted(two)
    assert Counter((r.split, r.label) for r in one) == {(a, b): 12 for a in ("train", "test") for b in ("FAKE", "REAL")}
    frames = sorted(r.frame for r in one if r.group == next(r.group for r in one if r.label == "FAKE"))
    assert frames == [0, 2, 4]


def test_weights_share_equally(spark):
    df = spark.createDataFrame([(0, "", "r1"), (0, "", "r1"), (0, "", "r2"), (1, "a", "v1"), (1, "a", "v2"), (1, "a", "v2"), (1, "b", "v3")], "label int, method string, video string")
    w = {(r.label, r.method, r.video): r.weight * r.n for r in sampling.sampling_weights(df, "label", "method", "video").collect()}
    assert abs(sum(w.values()) - 1) < 1e-12 and abs(w[0, "", "r1"] - 0.25) < 1e-12 and abs(w[1, "b", "v3"] - 0.25) < 1e-12 and abs(w[1, "a", "v1"] - 0.125) < 1e-12


def test_draws_follow_the_weights(spark):
    df = spark.createDataFrame([(f"k{i}", float(i)) for i in range(1, 5)], "k string, w double")
    drawn = Counter(r.k for r in sampling.weighted_draw(df, "k", "w", 4000, "s").collect())
    assert sum(drawn.values()) == 4000 and all(abs(drawn[f"k{i}"] / 4000 - i / 10) < 0.03 for i in range(1, 5))


def test_pruning_judges_the_original_rows(spark):
    df = spark.createDataFrame([("train", "a", "x", "p"), ("validation", "b", "x", "q"), ("test", "c", "y", "q"), ("train", "d", "z", "")], "split string, video string, f string, g string")
    removed = sampling.prune_cross_split(df, ["f", "g"], {"train": 1, "validation": 2, "test": 3})
    assert rows_of(removed, "split", "video") == [("train", "a"), ("validation", "b")]


def test_partition_keeps_entities_apart(spark):
    rows = [(f"v{i}", [f"e{i // 2}", f"e{(i * 7) % 40 + 100}"]) for i in range(60)]
    out = {r.video: r.split for r in sampling.entity_partition(spark.createDataFrame(rows, "video string, e array<string>"), "video", "e", "s", [("train", 0.5), ("test", 0.5)]).collect()}
    split_of = {}
    for v, entities in rows:
        for e in entities:
            assert split_of.setdefault(e, out[v]) == out[v]


def test_components_of_a_long_path(spark):
    links = [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)] + [("z1", "z2")]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert {got[n] for n in got if n[0] == "n"} == {"n000"} and got["z2"] == "z1"


# gates

def test_identity_tokens_and_lineage(spark):
    df = spark.createDataFrame([("id1_id2_xid3_0001", "cdf"), ("012_345", "ff"), ("none", "celeba")], "v string, d string")
    out = [tuple(r) for r in df.select(s.identity_tokens(F.col("v")), s.source_entities(F.col("d"), F.col("v")), s.lineage_tokens(F.col("d"), F.col("v"), F.lit(""))).collect()]
    assert out[0][:2] == (["id1", "id2"], ["cdf:id1", "cdf:id2"]) and out[1][1] == ["ff:012", "ff:345"] and out[1][2] == ["ff:012", "ff:345"]
    assert out[2] == ([], ["celeba:none"], ["celeba:none"])


def test_held_out_rows_count_under_the_first_reason(spark):
    df = spark.createDataFrame([(1, ["a"], False), (2, [], True), (3, ["b"], True), (4, ["c"], False), (5, ["a"], True)], "k long, e array<string>, bad boolean")
    owned = spark.createDataFrame([("a",)], "entity string")
    out = gates.heldout_cascade(df, "k", "e", owned, [("collision", F.col("bad"))])
    assert rows_of(out, "k", "reason") == [(1, "entity"), (2, "no_entity"), (3, "collision"), (4, ""), (5, "entity")]


def test_cells_and_links(spark):
    df = spark.createDataFrame([("ff", "a", "v1"), ("ff", "a", "v1"), ("ff", "b", "v2")], "d string, m string, v string")
    targets = spark.createDataFrame([("ff", "a", 2), ("x", "y", 1)], "d string, m string, target long")
    assert rows_of(gates.cell_targets(df, ["d", "m"], "v", targets), "d", "m", "found", "missing") == [("ff", "a", 1, 1), ("x", "y", 0, 1)]
    assert rows_of(gates.unexpected_cells(df, ["d", "m"], targets), "d", "m") == [("ff", "b")]


# metrics

def auroc_of(y, x):
    pairs = [(a > b) + (a == b) / 2 for a, i in zip(x, y) if i for b, j in zip(x, y) if not j]
    return sum(pairs) / len(pairs)


def python_metrics(y, x):
    p, n = sum(y), len(y) - sum(y)
    order = sorted(set(x), reverse=True)
    curve = [(sum(i and v >= t for i, v in zip(y, x)), sum((not i) and v >= t for i, v in zip(y, x)), t) for t in order]
    ap = sum((tp - before) / p * tp / (tp + fp) for (tp, fp, _), before in zip(curve, [0, *(c[0] for c in curve)]))
    at = max([tp / p for tp, fp, _ in curve if fp / n <= 0.25], default=0.0)
    x0, g0, eer = 0.0, -1.0, None
    for tp, fp, _ in curve:
        gap = fp / n - 1 + tp / p
        if gap >= 0:
            eer = x0 + (fp / n - x0) * -g0 / (gap - g0)
            break
        x0, g0 = fp / n, gap
    best = max((tp * n - fp * p, -t) for tp, fp, t in curve)
    return auroc_of(y, x), ap, at, eer, -best[1]


def test_metrics_against_plain_python(spark):
    rng, rows = np.random.default_rng(1), []
    for slice_ in range(30):
        n = int(rng.integers(2, 50))
        y = [0, 1, *rng.integers(0, 2, n - 2).tolist()]
        rows += [(slice_, i, float(v)) for i, v in zip(y, rng.integers(0, 12, n) / 11)]
    df = spark.createDataFrame(rows, "s int, label int, score double")
    table = metrics.threshold_table(df, ["s"])
    out = metrics.auroc(table, ["s"]).join(metrics.average_precision(table, ["s"]), "s").join(metrics.tpr_at_fpr(table, ["s"], 0.25), "s").join(
        metrics.equal_error_rate(table, ["s"]), "s").join(metrics.best_threshold(table, ["s"]), "s")
    for r in out.collect():
        y, x = [b for a, b, _ in rows if a == r.s], [c for a, _, c in rows if a == r.s]
        assert np.allclose([r.auroc, r.average_precision, r.tpr_at_fpr, r.eer, r.threshold], python_metrics(y, x), atol=1e-12), r


def test_metrics_on_hand_values(spark):
    one = lambda y, x: spark.createDataFrame(list(zip(y, map(float, x))), "label int, score double")
    table = lambda y, x: metrics.threshold_table(one(y, x), [])
    assert metrics.auroc(table([0, 1], [0.5, 0.5]), []).first()[0] == 0.5
    assert abs(metrics.average_precision(table([1, 0, 1, 0], [0.9, 0.8, 0.7, 0.1]), []).first()[0] - 5 / 6) < 1e-12
    assert abs(metrics.equal_error_rate(table([0, 0, 0, 1], [0.9, 0.1, 0.2, 0.5]), []).first()[0] - 1 / 3) < 1e-12
    c = metrics.calibration(one([0, 1], [0.25, 0.75]), []).first()
    assert (c.brier, c.ece) == (0.0625, 0.25)
    assert metrics.at_threshold(one([1, 0], [0.5, 0.4]), [], 0.5).first().f1 == 1.0
    assert metrics.auroc(table([1, 1], [0.5, 0.6]), []).first()[0] is None


def test_weights_stand_for_repeated_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(0, 2)), float(rng.integers(0, 9)), int(rng.integers(1, 4))) for _ in range(60)]
    df = spark.createDataFrame(rows, "label int, score double, w int")
    again = spark.createDataFrame([(y, x) for y, x, w in rows for _ in range(w)], "label int, score double")
    a = metrics.auroc(metrics.threshold_table(df, [], weight=F.col("w")), []).first()[0]
    assert abs(a - metrics.auroc(metrics.threshold_table(again, []), []).first()[0]) < 1e-12


def test_robust_logits(spark):
    x = [-2.0, -1.0, 0.5, 1.0, 4.0, 9.0]
    df = spark.createDataFrame([("v", a) for a in x] + [("w", 1.0)], "v string, x double")
    got = {r.v: r for r in metrics.robust_logits(df, ["v"], "x").collect()}
    p = np.mean(1 / (1 + np.exp(-np.array(x))))
    assert np.allclose([got["v"].mean, got["v"].median, got["v"].trimmed, got["v"].top_quarter, got["v"].mean_probability], [np.mean(x), 0.75, np.mean(x[1:5]), 6.5, np.log(p / (1 - p))])
    assert got["w"].median == got["w"].trimmed == got["w"].top_quarter == 1.0


def test_spread_of_one_seed(spark):
    r = metrics.spread(spark.createDataFrame([("a", 1.0)], "k string, v double"), ["k"], "v").first()
    assert (r.mean, r.sd, r.n_seeds) == (1.0, 0.0, 1)


# fusion

def test_align_refuses(spark):
    frame = lambda rows: spark.createDataFrame(rows, "id string, d string, x double")
    left = frame([("a", "ff", 1.0), ("b", "ff", 2.0)])
    assert rows_of(fusion.align(left, left, "id", ["d"], ["x"]), "id", "x_left", "x_right") == [("a", 1.0, 1.0), ("b", 2.0, 2.0)]
    for bad, why in ((frame([("a", "ff", 1.0)]), "one side"), (frame([("a", "ff", 1.0), ("b", "cdf", 1.0)]), "d differs"), (frame([("a", "ff", 1.0), ("b", "ff", 1.0), ("b", "ff", 1.0)]), "repeated")):
        with pytest.raises(constraints.ConstraintError, match=why):
            fusion.align(left, bad, "id", ["d"], ["x"])


def test_platt_recovers_its_parameters(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal(20_000) * 2
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(1.7 * x - 0.4)))).astype(int)
    a, b = fusion.fit_platt(spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "logit double, label int"))
    assert abs(a - 1.7) < 0.1 and abs(b + 0.4) < 0.1


def test_decisions_abstain(spark):
    df = spark.createDataFrame([("a", 3.0, 5, 1), ("b", -3.0, 5, 1), ("c", 3.0, 3, 1), ("d", None, None, 0)], "v string, x double, n int, label int")
    out = fusion.decide(df, "x", "n", 1.0, 0.0, 0.5)
    assert rows_of(out, "v", "decision") == [("a", "FAKE"), ("b", "REAL"), ("c", "ABSTAIN"), ("d", "ABSTAIN")]
    r = fusion.decision_counts(out.withColumn("all", F.lit(1)), "label", ["all"]).first()
    assert (r.fake, r.real, r.abstain, r.accuracy) == (1, 1, 2, 0.5)


def test_bootstrap_of_equal_models_is_zero(spark):
    rng = np.random.default_rng(4)
    rows = [(f"{m}{g}", "ff", m, int(m != "real"), [f"s{g}"], float(rng.random())) for g in range(8) for m in ("real", "a", "b")]
    df = spark.createDataFrame([(*r, r[5]) for r in rows], "row_key string, domain string, method string, label int, lineage array<string>, base double, candidate double")
    r = fusion.bootstrap_difference(df, "base", "candidate", "method", "domain", "lineage", 30, "s").first()
    assert (r.diff, r.low, r.high, r.clear) == (0.0, 0.0, 0.0, False) and r.valid > 0


BOOT = "domain string, method string, label int, lineage array<string>, base double, candidate double"


def test_bootstrap_against_brute_force(spark):
    """Every replicate by hand: each domain's own components and draws, areas by comparing all pairs of a
    method. Both domains know the tokens s0..s24, and a row of cdf joins two that ff keeps apart."""
    rng, names, repeats = np.random.default_rng(6), ["real", "a", "b"], 60
    rows = [("cdf", "a", 1, ["s3", "", "s4"], 0.5, 0.25), ("cdf", "real", 0, ["s4", "s5", None], 0.5, 0.75)]
    for i in range(140):
        m = names[int(rng.integers(3))]
        rows.append(("ff" if i % 3 else "cdf", m, int(m != "real"), [f"s{int(rng.integers(25))}"], float(rng.integers(0, 12)) / 12, float(rng.integers(0, 12)) / 12))
    got = {r.domain: r for r in fusion.bootstrap_difference(spark.createDataFrame(rows, BOOT), "base", "candidate", "method", "domain", "lineage", repeats, "s").collect()}
    sha = lambda *x: hashlib.sha256("\0".join(map(str, x)).encode()).hexdigest()
    assert set(got) == {"ff", "cdf"}
    for domain in got:
        own = [(m, y, "s3" if domain == "cdf" and t[0] in ("s4", "s5") else t[0], a, b) for d, m, y, t, a, b in rows if d == domain]
        roots = sorted({r[2] for r in own}, key=lambda x: (sha(domain, domain + "\0" + x)[:2], x))

        def macro(weight, side):
            out = []
            for m in ("a", "b"):
                pairs = [(weight[p[2]] * weight[n[2]], p[side], n[side]) for p in own if p[0] == m for n in own if n[1] == 0]
                total = sum(w for w, *_ in pairs)
                if not total:
                    return None
                out.append(sum(w * ((a > b) + (a == b) / 2) for w, a, b in pairs) / total)
            return sum(out) / 2

        diffs = []
        for i in range(repeats):
            picks = Counter(roots[int(sha("s", domain, i, slot)[:12], 16) % len(roots)] for slot in range(len(roots)))
            a, b = (macro(picks, side) for side in (3, 4))
            if a is not None and b is not None:
                diffs.append(b - a)
        diffs.sort()
        one = Counter({r: 1 for r in roots})
        want = (macro(one, 4) - macro(one, 3), diffs[math.floor(0.025 * (len(diffs) - 1))], diffs[math.ceil(0.975 * (len(diffs) - 1))])
        assert got[domain].valid == len(diffs) and np.allclose((got[domain].diff, got[domain].low, got[domain].high), want, atol=1e-12)


@pytest.mark.parametrize("spoil, told", [
    (lambda r: (*r[:3], [], *r[4:]), "needs the lineage"), (lambda r: (*r[:3], None, *r[4:]), "needs the lineage"),
    (lambda r: (*r[:5], None), "both models' scores"), (lambda r: (*r[:3], ["s0"], *r[4:]), "two independent groups"),
    (lambda r: (r[0], "a", 1, *r[3:]), "lacks reals or fakes"),
])
def test_bootstrap_refuses(spark, spoil, told):
    """What spoils the result of ff leaves cdf's row readable only if that is alone."""
    rows = [("ff", m, int(m != "real"), [f"s{g}"], g / 8, g / 9) for g in range(8) for m in ("real", "a")]
    spoilt = [spoil(r) for r in rows] if told[:3] in ("two", "lac") else [spoil(rows[0]), *rows[1:]]
    with pytest.raises(Exception, match=told):
        fusion.bootstrap_difference(spark.createDataFrame(spoilt, BOOT), "base", "candidate", "method", "domain", "lineage", 30, "s").collect()


def test_won_pairs_over_batches(monkeypatch):
    rng = np.random.default_rng(7)
    n, repeats = 60, 4
    score, label, k = np.sort(rng.integers(0, 9, n) / 9.0), rng.integers(0, 2, n), rng.integers(1, 3, n).astype(float)
    method = [None if y == 0 else "ab"[int(rng.integers(2))] for y in label]
    times = rng.integers(0, 3, (n, repeats + 1)).astype(np.uint8)
    batch = pa.RecordBatch.from_pydict({"domain": ["d"] * n, "model": ["m"] * n, "score": score, "method": method, "label": label, "k": k, "times": [x.tobytes() for x in times]})
    want = {m: sum(np.outer(k[i] * k[j] * ((score[i] > score[j]) + (score[i] == score[j]) / 2), times[i].astype(float) * times[j])[0] for i in range(n) if method[i] == m for j in range(n) if label[j] == 0) for m in "ab"}
    for size in (1, 7, 500):
        monkeypatch.setattr(fusion, "TOGETHER", size)
        got = {r["slice_method"]: np.frombuffer(r["won"]) for out in fusion._won_pairs(repeats)(iter([batch])) for r in out.to_pylist()}
        assert all(np.allclose(got[m], want[m]) for m in "ab")


def test_bootstrap_needs_half_of_its_replicates(spark):
    rows = [(f"{m}{g}", "ff", m, int(m != "real"), [f"{m}{g}"], 0.5, 0.5) for m, g in [("real", 0), *((f"m{i}", 0) for i in range(5))]]
    df = spark.createDataFrame(rows, "row_key string, domain string, method string, label int, lineage array<string>, base double, candidate double")
    with pytest.raises(Exception, match="too few valid bootstrap replicates in ff"):
        fusion.bootstrap_difference(df, "base", "candidate", "method", "domain", "lineage", 30, "s").collect()


def test_verdict_is_the_majority(spark):
    df = spark.createDataFrame([(1, "ff", 0.0, -0.1), (1, "cdf", 0.2, 0.1), (2, "ff", -0.2, 0.1), (2, "cdf", 0.1, 0.1), (3, "ff", 0.1, 0.05)], "seed int, domain string, diff double, low double")
    assert tuple(fusion.verdict(df, "ff").first()) == (2, 3, True)


# media and reports

def test_difference_hash_and_faces(spark):
    rng = np.random.default_rng(5)
    gray = rng.integers(0, 256, (8, 9))
    bits = (gray[:, :-1] > gray[:, 1:]).ravel()
    want = f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"
    df = spark.createDataFrame([(gray.ravel().tolist(),)], "g array<int>")
    assert df.select(media.difference_hash(F.col("g"))).first()[0] == want
    faces = spark.createDataFrame([(1, []), (2, [(0.5, 100.0, 100.0)]), (3, [(0.9, 50.0, 90.0)]), (4, [(0.9, 70.0, 90.0), (0.95, 80.0, 90.0), (0.1, 500.0, 500.0)])],
                                  "k int, f array<struct<score:double,width:double,height:double>>")
    got = {r.k: r.p for r in faces.select("k", media.face_policy(F.col("f")).alias("p")).collect()}
    assert [got[k].status for k in (1, 2, 3, 4)] == ["no_face", "low_confidence", "face_too_small", "ok"] and got[4].face.width == 80.0


def test_scoring_hook_and_corruptions(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", -1.0)], "sample_id string, x double")

    def load():
        return lambda batch: (batch.column(1).to_pylist(), [[v, 0.0] for v in batch.column(1).to_pylist()])

    out = {r.sample_id: r for r in media.score_rows(df, ["x"], load).collect()}
    assert abs(out["a"].score - 1 / (1 + np.exp(-1))) < 1e-12 and out["b"].embedding == [-1.0, 0.0]
    plan = media.corruption_plan(df, "sample_id")
    assert plan.count() == 2 * 19
    for r in plan.collect():
        assert int(r.noise_seed) == int.from_bytes(hashlib.sha256(f"{r.sample_id}\0{r.name}\0{r.level:g}".encode()).digest()[:8], "little")
    assert {(r.name, r.level) for r in plan.collect()} >= {("blur", 0.5), ("blur", 1.0), ("blur", 2.0), ("noise", 2.0), ("noise", 5.0), ("noise", 10.0)}


def test_media_kinds(spark):
    kinds = lambda *names: [r[0] for r in spark.createDataFrame([(n,) for n in names], "p string").select(s.media_kind(F.col("p"))).collect()]
    assert kinds("a/b.TIF", "c.tiff", "d.jpg", "e.m4v", "f.MP4") == ["image"] * 3 + ["video"] * 2
    with pytest.raises(Exception, match="unsupported media type: b.txt"):
        kinds("a/b.txt")


def test_markdown(spark):
    df = spark.createDataFrame([("ff", 0.5, 0.1, 0.25, 0.75)], "k string, m double, sd double, lo double, hi double")
    assert reporting.markdown_rows(df, ["k"], "m", "sd", "lo", "hi").first().line == "| ff | 0.5000 ± 0.1000 [0.2500, 0.7500] |"
    assert df.select(reporting.signed("m")).first()[0] == "+0.5000"


# sources and sinks

def test_readers(spark, tmp_path):
    (tmp_path / "m.csv").write_text('id,text,empty\n001,"a ""q"", b",\n2,NA,x\n')
    assert rows_of(readers.read_metadata(spark, str(tmp_path / "m.csv")), "id", "text", "empty") == [("001", 'a "q", b', ""), ("2", "NA", "x")]
    (tmp_path / "m.jsonl").write_text('{"a": 1, "b": [1, 2]}\n\n{"a": null}\n')
    assert rows_of(readers.read_metadata(spark, str(tmp_path / "m.jsonl")), "a", "b") == [("", ""), ("1", '["1","2"]')]
    (tmp_path / "bad.ndjson").write_text('{"a": 1}\n[1]\n')
    with pytest.raises(constraints.ConstraintError, match="not JSON objects"):
        readers.read_metadata(spark, str(tmp_path / "bad.ndjson"))
    (tmp_path / "r.json").write_text(json.dumps({"records": [{"a": 1}, {"a": "x"}]}))
    assert rows_of(readers.read_metadata(spark, str(tmp_path / "r.json")), "a") == [("1",), ("x",)]
    (tmp_path / "o.json").write_text(json.dumps([{"a": 1}]))
    assert rows_of(readers.read_metadata(spark, str(tmp_path / "o.json")), "a") == [("1",)]
    with pytest.raises(ValueError, match="unsupported"):
        readers.read_metadata(spark, "x.parquet")
    (tmp_path / "ex.txt").write_text("# head\na # why\n\n b\n")
    assert rows_of(readers.read_exclusions(spark, str(tmp_path / "ex.txt")), "id") == [("a",), ("b",)]


def test_nested_catalog_and_archives(spark, tmp_path):
    folder = tmp_path / "c"
    folder.mkdir()
    (folder / "B.json").write_text(json.dumps({"cat": {"fake": {"train": {"c23": {"v1": {"label": "Fake", "frames": ["f1", "f2"]}}}}}}))
    (folder / "a.json").write_text(json.dumps({"cat": {"real": {"test": {"v2": {"label": "Real", "frames": []}}}}}))
    out = readers.read_catalog(spark, str(folder / "*.json")).select("keys", "source_rank", F.expr("variant_get(record, '$.label', 'string')").alias("label")).collect()
    assert {(tuple(r["keys"]), r.source_rank, r.label) for r in out} == {(("cat", "real", "test", "v2"), 1, "Real"), (("cat", "fake", "train", "c23", "v1"), 2, "Fake")}
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("d/1.png", b"abc")
        z.writestr("d/readme.txt", b"")
    assert rows_of(readers.read_zip_listing(spark, str(tmp_path / "x.zip")), "member", "size") == [("d/1.png", 3)]
    with zipfile.ZipFile(tmp_path / "y.zip", "w") as z:
        z.writestr("../1.png", b"abc")
    with pytest.raises(Exception, match="unsafe member"):
        readers.read_zip_listing(spark, str(tmp_path / "y.zip")).collect()
    media_folder = tmp_path / "m"
    media_folder.mkdir()
    (media_folder / "A.png").write_bytes(b"1")
    (media_folder / "a.jpg").write_bytes(b"22")
    assert rows_of(readers.read_file_index(spark, str(media_folder), (".png", ".jpg")), "stem", "n") == [("a", 2)]
    assert {r.size for r in readers.read_payloads(spark, str(media_folder)).collect()} == {1, 2}


def test_artifacts_are_addressed_by_content(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, t string")
    name, path = writers.write_artifact(df, str(tmp_path), {"k": 1})
    again, _ = writers.write_artifact(df.repartition(3).orderBy(F.desc("id")), str(tmp_path))
    assert name == again and writers.verify_artifact(spark, path) == (True, [])
    other, _ = writers.write_artifact(df.limit(1), str(tmp_path))
    assert other != name
    df.limit(1).write.mode("overwrite").parquet(f"{path}/rows")
    good, errors = writers.verify_artifact(spark, path)
    assert not good and "the rows' digest differs" in errors
    with pytest.raises(RuntimeError, match="was changed"):
        writers.write_artifact(df, str(tmp_path))
    assert cli.main(["verify", path], spark) == 2


def test_reports_are_written_once(spark, tmp_path):
    path = writers.write_report(spark, {"b": 1, "a": 2}, str(tmp_path), "r.json")
    assert writers.write_report(spark, {"a": 2, "b": 1}, str(tmp_path), "r.json") == path
    with pytest.raises(RuntimeError, match="other content"):
        writers.write_report(spark, {"a": 3}, str(tmp_path), "r.json")
    assert "report-" in writers.write_report(spark, {"a": 3}, str(tmp_path))
    assert writers.spec_fingerprint({"b": 1, "a": 2}) == writers.spec_fingerprint({"a": 2, "b": 1})


def test_scores_are_appended_once(spark, tmp_path):
    df = spark.createDataFrame([("r", "clean", 1.0), ("r", "blur", 2.0)], "run string, kind string, x double")
    path = str(tmp_path / "scores")
    assert writers.write_missing_scores(df.where("kind = 'clean'"), path, ["run", "kind"]) == 1
    assert writers.write_missing_scores(df, path, ["run", "kind"]) == 1 and writers.write_missing_scores(df, path, ["run", "kind"]) == 0
    assert spark.read.parquet(path).count() == 2
    writers.write_csv(df, str(tmp_path / "csv"), ["kind"])
    assert rows_of(readers.read_csv(spark, str(tmp_path / "csv")), "kind", "x") == [("blur", "2.0"), ("clean", "1.0")]
    writers.write_predictions(spark.createDataFrame([("s", 1, 0.5)], "sample_id string, label int, score double"), str(tmp_path / "p"))
    assert readers.read_predictions(spark, str(tmp_path / "p")).first().score == 0.5


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "m.csv").write_text("id,label,split,hash,group\n1,REAL,train,a,g1\n2,FAKE,test,a,g2\n")
    args = [str(tmp_path / "m.csv"), "--id", "id", "--label", "label", "--exact", "hash", "--near", "hash", "--group", "group"]
    assert cli.main(["audit", *args], spark) == 2
    assert cli.main(["digest", str(tmp_path / "m.csv")], spark) == 0 and '"n": 2' in capsys.readouterr().out


# streams

def test_counts_of_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (1, "a", "2024-01-01 00:00:01"), (2, "", "2024-01-03 00:00:00"), (3, "b", "2024-01-09 00:00:00")], "id int, c string, t string").select(
        "id", "c", F.to_timestamp("t").alias("t")).write.parquet(str(folder))
    stream = spark.readStream.schema("id int, c string, t timestamp").parquet(str(folder))
    for name, df, want in (("counts", incremental.running_counts(stream, "c", "t"), {("a", 2), ("<MISSING>", 1)}), ("firsts", incremental.first_arrivals(stream, "id", "t"), {1, 2, 3})):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
        rows = spark.table(name).collect()
        assert (set((r.value, r.n) for r in rows) if name == "counts" else set(r.id for r in rows)) == want


def test_registry():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert len(names) >= 60 and set(__spark_entry__.oracle_sql()) <= set(names)


# catalogs, manifests, protocols

def test_catalogs_of_any_depth(spark, tmp_path):
    node = {"label": "fake", "frames": ["b.png", "a.png"]}
    for i in range(12, 0, -1):
        node = {f"k{i}": node}
    (tmp_path / "deep_ff.json").write_text(json.dumps(node))
    row = readers.read_catalog(spark, str(tmp_path / "deep_ff.json")).first()
    assert row["keys"] == [f"k{i}" for i in range(1, 13)]
    for bad, place in (([1, 2], "<root>"), ({"a": {"b": [1]}}, "a/b"), ({"a": 3}, "a"), ({"a": None}, "a")):
        (tmp_path / "bad.json").write_text(json.dumps(bad))
        with pytest.raises(constraints.ConstraintError, match=f"expected an object.*{place}"):
            readers.read_catalog(spark, str(tmp_path / "bad.json"))


def catalog_of(spark, tmp_path, files):
    folder = tmp_path / f"c{len(list(tmp_path.iterdir()))}"
    folder.mkdir()
    for name, content in files.items():
        (folder / name).write_text(json.dumps(content))
    return readers.read_catalog(spark, str(folder / "*.json"))


def test_normalize_merges_and_refuses(spark, tmp_path):
    record = lambda frames, **more: {"frames": frames, **more}
    files = {"SimSwap_ff.json": {"fake": {"train": {"c23": {"1_2": record(["x\\f_07.png", "x/g.png"])}}}, "real": {"val": {"v9": record(["r.png"])}}},
             "wav2lip_ff.json": {"real": {"test": {"v9": record(["r.png"], source_video_id="7 | 8")}}}}
    rows = {r.source_path: r for r in catalog.normalize_catalog(catalog_of(spark, tmp_path, files), "s").collect()}
    one, two = rows["x/f_07.png"], rows["r.png"]
    assert set(rows) == {"x/f_07.png", "x/g.png", "r.png"} and (one.label, one.fake_method, one.frame_index, one.compression) == ("FAKE", "simswap", "7", "c23")
    assert one.lineage_video_ids == "ff:1|ff:2" and rows["x/g.png"].frame_index == "0"  # positions go by the official names
    token = hashlib.sha256(b"x/f_07.png").hexdigest()[:12]
    assert one.relative_path == f"images/ff/simswap/train/c23/1_2/{token}_f_07.png" and one.image_id == hashlib.sha256(one.relative_path.encode()).hexdigest()[:24]
    assert two.official_splits == "test|validation" and two.source_json == "SimSwap_ff.json" and two.lineage_video_ids == "ff:v9"
    for bad, why in (({"nope_ff.json": {"fake": {"train": {"v": record([])}}}}, "unsupported method"), ({"wav2lip.json": {"fake": {"train": {"v": record(["a"])}}}}, "unsupported catalog"),
                     ({"wav2lip_ff.json": {"fake": {"train": {"test": {"v": record(["a"])}}}}}, "exactly one split"), ({"wav2lip_ff.json": {"x": {"train": {"v": record(["a"])}}}}, "label"),
                     ({"wav2lip_ff.json": {"fake": {"train": {"..": record(["a"])}}}}, "unsafe video name"), ({"wav2lip_ff.json": {"fake": {"train": {"v": record(3)}}}}, "invalid frames"),
                     ({"wav2lip_ff.json": {"fake": {"train": {"v": record(["a"])}, "test": {"w": record(["a"])}}}}, "conflicting")):
        with pytest.raises(Exception, match=why):
            catalog.normalize_catalog(catalog_of(spark, tmp_path, bad)).collect()


def test_paths_and_manifest(spark):
    files = spark.createDataFrame([("a/1.png",), ("a/2.png",), ("a/b/3.png",), ("c/x1.png",), ("c/x2.png",)], "path string")
    asked = ["a/1.png", "a\\2.png", "./a/../a/1.png", "../a/1.png", "/a/1.png", "", "a/9.png", "c/x?.png", "a/b/*.png", "*/1.png", "a/[12].png", "a/[!1].png", "a/*/9.png"]
    rows = spark.createDataFrame([(str(i), q) for i, q in enumerate(asked)], "id string, q string")
    got = {int(r.id): (r.status, r.relative_path) for r in catalog.resolve_paths(rows, F.col("q"), files).collect()}
    want = [("ok", "a/1.png"), ("ok", "a/2.png"), ("ok", "a/1.png"), ("outside_data_root", ""), ("outside_data_root", ""), ("missing_path_value", ""), ("missing_image", ""),
            ("ambiguous_path", ""), ("ok", "a/b/3.png"), ("ok", "a/1.png"), ("ambiguous_path", ""), ("ok", "a/2.png"), ("missing_image", "")]
    assert [got[i] for i in range(len(asked))] == want
    table = spark.createDataFrame([(" 7 ", " REAL", "train ", "1"), ("", "FAKE", "test", "2"), (None, "FAKE", "test", "2")], "id string, label string, split string, n string")
    made = catalog.project_manifest(table, files, "s", "v", "id", "label", "split", "a/{n}.png", ["n", "n"])
    assert made.columns == [*catalog.MANIFEST, "n"]
    out = made.orderBy("source_id").collect()
    assert [(r.source_id, r.label, r.split, r.status, r.relative_path) for r in out] == [("", "FAKE", "test", "ok", "a/2.png")] * 2 + [("7", "REAL", "train", "ok", "a/1.png")]
    assert out[2].sample_id == hashlib.sha256(b"s\0v\x007").hexdigest() and out[0].sample_id == out[1].sample_id != out[2].sample_id
    for bad in (["label"], ["nope"]):
        with pytest.raises(constraints.ConstraintError):
            catalog.project_manifest(table, files, "s", "v", "id", "label", "split", "a/{n}.png", bad)
    with pytest.raises(constraints.ConstraintError, match="missing column: zz"):
        catalog.from_template("{zz}", ["a"])


def test_subset_and_manifest_must_match(spark):
    subset = spark.createDataFrame([("a", "train", "v1"), ("b", "test", "v2")], "image_id string, split string, video_id string")
    made = lambda rows: spark.createDataFrame(rows, "source_id string, split string, video_id string, status string, px string")
    good = [("a", "train", "v1", "ok", "p"), ("b", "test", "v2", "ok", "q")]
    check = lambda rows: catalog.require_same_samples(subset, made(rows), ["px"], ["train", "test"])
    assert rows_of(check(good), "image_id", "px") == [("a", "p"), ("b", "q")]
    for bad, why in ((good[:1], "one side"), ([*good, ("c", "test", "v", "ok", "r")], "one side"), ([good[0], ("b", "test", "v2", "bad", "q")], "fingerprints"),
                     ([good[0], ("b", "test", "v2", "ok", "")], "fingerprints"), ([good[0], ("b", "train", "v2", "ok", "q")], "differ"), ([*good, good[1]], "repeated")):
        with pytest.raises(constraints.ConstraintError, match=why):
            check(bad)


def test_pruning_removes_groups_and_leaves_nothing(spark):
    rows = spark.createDataFrame([("1", "train", "v1", "h1"), ("2", "train", "v1", "h2"), ("3", "test", "v2", "h1"), ("4", "train", "v3", "h3")], "id string, split string, video string, px string")
    order = {"test": 3, "validation": 2, "train": 1}
    assert rows_of(sampling.pruned(rows, ["px"], order), "id") == [("3",), ("4",)]
    both = spark.createDataFrame([("1", "train", "v1", "a", "x"), ("2", "test", "v2", "a", "y"), ("3", "test", "v2", "b", "z"), ("4", "validation", "v4", "c", "z")], "id string, split string, video string, px string, dh string")
    assert rows_of(sampling.pruned(both, ["px", "dh"], order), "id") == [("2",), ("3",)]


def test_audits_pass_and_fail(spark):
    columns = ", ".join(f"{c} string" for c in gates.AUDITED)
    row = lambda i, split, label, method, domain="ff", **more: tuple({**dict(zip(gates.AUDITED, (f"s{i}", split, label, method, f"v{i}", domain, f"{domain}:v{i}", "", "", f"p{i}", f"d{i}", "ok"))), **more}.values())
    clean = [row(1, "train", "FAKE", "a"), row(2, "train", "REAL", ""), row(3, "test", "FAKE", "b"), row(4, "test", "REAL", "")]
    audit_of = lambda rows: {(r.section, r.key): r.n for r in gates.unseen_audit(spark.createDataFrame(rows, columns), {"train": ["a"], "test": ["b"]}).where("failure").collect()}
    assert audit_of(clean) == {}
    bad = [*clean, row(5, "test", "FAKE", "a"), row(6, "x", "REAL", ""), row(7, "test", "REAL", "", pixel_sha256="p1"), row(8, "test", "REAL", "", domain="cdf", lineage_video_ids=""), row(9, "test", "REAL", "", target_identity_id="id3"), row(10, "train", "REAL", "", video_id="id3_a")]
    assert audit_of(bad) == {("forbidden", "test/a"): 1, ("invalid", ""): 1, ("overlap", "pixel"): 1, ("overlap", "identity"): 1, ("missing", "parent"): 1, ("missing", "identity"): 1}
    assert audit_of(clean[:2]) == {("absent", "test/b"): 0, ("absent", "test/real"): 0}
    held = lambda rows, targets: {(r.section, r.key): r.n for r in gates.heldout_audit(spark.createDataFrame(rows, columns), spark.createDataFrame(clean, columns), targets).where("failure").collect()}
    fresh = [row(11, "test", "FAKE", "b"), row(12, "test", "REAL", "")]
    assert held(fresh, {("ff", "b"): 1, ("ff", "real"): 1}) == {}
    assert held([*fresh, row(1, "test", "FAKE", "c")], {("ff", "b"): 2, ("ff", "real"): 1}) == {
        ("unexpected", "ff/c"): 1, ("short", "ff/b"): 1, ("overlap", "video"): 1, ("overlap", "parent"): 1, ("overlap", "identity"): 1, ("overlap", "pixel"): 1, ("overlap", "dhash"): 1}


def test_external_report_and_abstentions(spark):
    rows = spark.createDataFrame([("m", "v1", 1, 0.9, ["x"]), ("m", "v2", 0, 0.2, ["y"]), ("m", "v3", 1, None, ["z"]), ("m", "v4", 0, 0.6, [])], "bundle string, video string, label int, probability double, identities array<string>")
    got = {(r.variant, r.population): (r.videos, r.auroc) for r in fusion.external_report(rows, spark.createDataFrame([("y",)], "identity string")).collect()}
    assert got == {("excluding_abstentions", "all"): (3, 1.0), ("excluding_abstentions", "identity_disjoint"): (2, 1.0), ("abstain_as_0.5", "all"): (4, 0.75), ("abstain_as_0.5", "identity_disjoint"): (3, 0.5)}


def test_aggregation_prefers_the_first_within_the_margin(spark):
    rows = [(f"v{i}{m}", m, int(m != "real"), "ff", float(i + (3 if m != "real" else 0))) for i in range(6) for m in ("real", "a") for _ in range(3)]
    out = fusion.select_aggregation(spark.createDataFrame(rows, "video string, method string, label int, domain string, x double"), "x", "video", "method", "domain", "ff")
    assert [r.aggregation for r in out.where("chosen").collect()] == ["mean_probability"] and out.count() == 5


@pytest.mark.parametrize("runs", [1, 2, 256])
def test_threshold_tables_where_scores_crowd(spark, monkeypatch, runs):
    """Scores at 0 and 1 with one outlier, ties, a null slice and a null score: counts are those of sorting."""
    monkeypatch.setattr(metrics, "RUNS", runs)
    rng = np.random.default_rng(9)
    rows = [(("a", None)[i % 2], float(rng.choice([0.0, 1.0, 0.5, rng.random() * 1e-6, 1 - rng.random() * 1e-6])), int(rng.integers(2))) for i in range(600)] + [("a", 1e9, 1), ("a", -1e9, 0), ("a", None, 1)]
    got = metrics.threshold_table(spark.createDataFrame(rows, "s string, score double, label int"), ["s"]).collect()
    for name in ("a", None):
        own = [(x, y) for s_, x, y in rows if s_ == name]
        above = lambda t, y: sum(1 for x, z in own if z == y and (x is not None and (t is None or x >= t) or t is None and x is None))
        mine = [r for r in got if r.s == name]
        assert len(mine) == len({x for x, _ in own}) and all((r.tp, r.fp) == (above(r.score, 1), above(r.score, 0)) for r in mine)
        assert {(r.p, r.n) for r in mine} == {(sum(y for _, y in own), sum(1 - y for _, y in own))}
