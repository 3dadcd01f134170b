"""Reports over runs, plane similarities and extended catalogs against plain Python."""

import hashlib
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import geometry
from millrace.operators import listings, reports
from millrace.operators.constraints import ConstraintError

VIDEO = "run string, domain string, method string, video string, label int, score double"


def videos(seed=2, runs=("r1", "r2", "r3")):
    rng = np.random.default_rng(seed)
    return [(r, d, m, f"v{i}", int(m != "real"), float(rng.integers(0, 30)) / 30) for r in runs for d in ("ff", "cdf") for m in ("real", "a", "b") for i in range(12)]


def area(rows, run, domain, method):
    own = [r for r in rows if r[0] == run and r[1] == domain]
    return statistics.fmean((f[5] > r[5]) + (f[5] == r[5]) / 2 for f in own if f[2] == method for r in own if r[4] == 0)


META = "run string, seed long, model string, manifest string"


def test_seed_summary(spark):
    rows = videos()
    meta = spark.createDataFrame([("r1", 1, "m", "x"), ("r2", 2, "m", "x"), ("r3", 3, "m", "x")], META)
    df = spark.createDataFrame(rows, VIDEO)
    out = {(r.domain, r.method, r.metric): r for r in reports.seed_summary(df, meta, ["model", "manifest"], ["domain", "method", "video", "label"]).collect()}
    assert len(out) == 2 * 3 * 4 and {m for *_, m in out} == set(reports.METRICS)
    for d in ("ff", "cdf"):
        each = {m: [area(rows, r, d, m) for r in ("r1", "r2", "r3")] for m in ("a", "b")}
        each["macro"] = [statistics.fmean(x) for x in zip(each["a"], each["b"])]
        for m, values in each.items():
            r = out[d, m, "auroc"]
            assert np.allclose((r.mean, r.sd, r.low, r.high), (statistics.fmean(values), statistics.stdev(values), min(values), max(values))) and r.n_seeds == 3
    for bad, told in ((meta.limit(2), "needs 3 runs"), (meta.withColumn("seed", F.lit(1)), "different seeds"), (meta.withColumn("model", F.col("run")), "provenance: model r1,r2,r3")):
        with pytest.raises(ConstraintError, match=told):
            reports.seed_summary(df, bad, ["model", "manifest"], ["domain", "method", "video", "label"])
    for spoilt in (df.where("NOT (run = 'r2' AND video = 'v3' AND method = 'a' AND domain = 'ff')"), df.union(df.limit(1))):
        with pytest.raises(ConstraintError, match="aren't scored once"):
            reports.seed_summary(spoilt, meta, ["model", "manifest"], ["domain", "method", "video", "label"])
    with pytest.raises(Exception, match="a class is missing for a"):
        reports.run_metrics(df.where("NOT (label = 0 AND domain = 'cdf')"), ["run"]).collect()


def test_comparisons_skip_absent_runs(spark):
    values = spark.createDataFrame([("r1", "ff", "a", "auroc", 0.5), ("r2", "ff", "a", "auroc", 0.75), ("r2", "ff", "b", "auroc", 0.5)], "run string, domain string, method string, metric string, value double")
    asked = spark.createDataFrame([("one", "r1", "r2"), ("two", "r1", "r9"), ("three", "r8", "r9")], "name string, baseline string, candidate string")
    got = sorted((tuple(r) for r in reports.compare_runs(values, asked).collect()), key=str)
    assert got == sorted([("one", "ff", "a", "auroc", 0.5, 0.75, 0.25, "ok"), ("one", "ff", "b", "auroc", None, 0.5, None, "lacks a slice"),
                          ("two", *[None] * 6, "absent: r9"), ("three", *[None] * 6, "absent: r8, r9")], key=str)


def test_videos_have_one_lineage(spark):
    df = spark.createDataFrame([("v", "a|b", 0.25), ("v", "a|b", 0.75), ("w", "", 1.0)], "video string, lineage_video_ids string, score double")
    assert {tuple(r) for r in reports.video_rows(df, ["video"]).collect()} == {("v", 0.5, 2, "a|b"), ("w", 1.0, 1, "")}
    with pytest.raises(Exception, match="several lineages in v"):
        reports.video_rows(df.union(spark.createDataFrame([("v", None, 1.0)], df.schema)), ["video"]).collect()


def umeyama(source, target):
    """Rotation, scale and shift by singular values, reflections turned back."""
    s, t = source - source.mean(axis=0), target - target.mean(axis=0)
    u, d, v = np.linalg.svd(t.T @ s / len(s))
    turn = np.diag([1, np.sign(np.linalg.det(u) * np.linalg.det(v))])
    rotation = u @ turn @ v
    scale = np.trace(np.diag(d) @ turn) / (s**2).sum(axis=1).mean()
    return scale * rotation, target.mean(axis=0) - scale * rotation @ source.mean(axis=0)


def test_similarities_against_singular_values(spark):
    rng, rows = np.random.default_rng(4), []
    for i in range(50):
        n = int(rng.integers(2, 9))
        source = rng.normal(0, 10, (n, 2))
        target = source * [1, -1 if i % 5 == 0 else 1] @ rng.normal(0, 1, (2, 2)) + rng.normal(0, 1, (n, 2)) if i % 2 else rng.normal(3, 2, (n, 2))
        rows.append((i, source.reshape(-1).tolist(), target.reshape(-1).tolist()))
    rows += [(100, [1.0, 1.0], [2.0, 2.0]), (101, [1.0, 1.0, 1.0, 1.0], [2.0, 2.0, 3.0, 3.0]), (102, [1.0] * 4, [1.0] * 6), (103, [], []), (104, None, None)]
    s, t = geometry.points_of(F.col("s")), geometry.points_of(F.col("t"))
    df = spark.createDataFrame(rows, "id long, s array<double>, t array<double>").select("id", "s", "t", geometry.similarity(s, t).alias("m"))
    out = df.select("id", "m", geometry.mean_distance(geometry.moved(F.col("m"), s), t).alias("d")).collect()
    for r in out:
        if r.id >= 100:
            assert r.m is None and r.d is None
            continue
        source, target = (np.array(x).reshape(-1, 2) for x in rows[r.id][1:])
        matrix, shift = umeyama(source, target)
        assert np.allclose([[r.m.a, -r.m.b], [r.m.b, r.m.a]], matrix) and np.allclose((r.m.x, r.m.y), shift)
        assert math.isclose(r.d, np.linalg.norm(source @ matrix.T + shift - target, axis=1).mean(), rel_tol=1e-9, abs_tol=1e-9)


METHODS = {"m1": ("train/m1.zip", "face_swap"), "m2": ("test/m2.zip", "face_reenactment")}
CATALOG = "relative_path string, label string, fake_method string, source_domain string, video_id string, source_video_id string, lineage_video_ids string"


def base(spark):
    rows = [("images/a.png", "FAKE", "old", "ff", "ff:001_002", "", ""), ("images/b.png", "REAL", "", "cdf", "cdf:id1_0001", "", "cdf:x"), ("images/c.png", "REAL", "", "ff", "ff:7", " 9 | 8 ", None)]
    df = spark.createDataFrame(rows, CATALOG)
    rest = ["image_id", "split", "official_splits", "manipulation_family", "identity_id", "frame_index", "compression", "source_json", "source_path", "target_identity_id"]
    return df.select("*", *(F.lit("").alias(c) for c in rest))


def test_catalogs_grow_by_listings(spark):
    members = [("train/m1.zip", "m1/ff/frames/01_02/003.png"), ("train/m1.zip", "m1/readme.txt"), ("test/m2.zip", "m2/cdf/id3_0001/x12.JPG"), ("test/m2.zip", "m2/ff/5/x.jpeg"), ("test/other.zip", "o/ff/1/1.png")]
    listed = spark.createDataFrame(members, "archive string, member string")
    out = {r.source_path or r.relative_path: r for r in listings.extend_catalog(base(spark), listed, "seed", METHODS, "p").collect()}
    assert len(out) == 6 and [out[f"images/{x}.png"].lineage_video_ids for x in "abc"] == ["ff:001|ff:002", "cdf:x", "ff:8|ff:9"]
    for archive, member in (members[0], members[2], members[3]):
        r = out["deepfakes_detection_datasets/DF40/" + member]
        domain, video, frame = ("cdf" if "/cdf/" in member else "ff"), member.split("/")[-2], member.split("/")[-1]
        dealt = hashlib.sha256("\0".join(["p", "seed", domain, video]).encode()).hexdigest()
        split = "train" if archive.startswith("train") else "validation" if dealt[0] < "8" else "test"
        token = hashlib.sha256(r.source_path.encode()).hexdigest()[:12]
        assert (r.split, r.video_id, r.source_json, r.label) == (split, f"{domain}:{video}", f"archive:{archive}", "FAKE")
        assert r.relative_path == f"images/{domain}/{r.fake_method}/{split}/none/{video}/{token}_{frame}" and r.image_id == hashlib.sha256(r.relative_path.encode()).hexdigest()[:24]
    assert {r.frame_index for r in out.values()} == {"", "3", "12", "0"}
    assert listings.listed_rows(spark.createDataFrame([("train/m1.zip", "a/b/1.png")], listed.schema), METHODS, "s", defaults={"m1": "ff"}).first().source_domain == "ff"


@pytest.mark.parametrize("members, change, told", [
    ([("train/m1.zip", "ff/1.png")], None, "unsafe archive member"), ([("train/m1.zip", "ff/../1.png")], None, "unsafe archive member"), ([("train/m1.zip", "ff/cdf/1/1.png")], None, "several domains"),
    ([("train/m1.zip", "a/b/1.png")], None, "no domain"), ([("train/m1.zip", "m/ff/1/1.png")] * 2, None, "paths of several rows"), ([], None, "missing archives: test/m2.zip"),
    ([("train/m1.zip", "m/ff/1/1.png")], lambda c: c.where("false"), "catalog is empty"), ([], lambda c: c.withColumn("fake_method", F.lit("m2")), "has already"),
])
def test_listings_that_are_refused(spark, members, change, told):
    listed = spark.createDataFrame(members + ([("test/m2.zip", "m/ff/2/2.png")] if told != "missing archives: test/m2.zip" else [("train/m1.zip", "x.png")]), "archive string, member string")
    catalog = base(spark)
    with pytest.raises(Exception, match=told):
        listings.extend_catalog(change(catalog) if change else catalog, listed, "seed", METHODS).collect()
