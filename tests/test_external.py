"""External sets, cached scores, locked thresholds and lookups of single files."""

import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions.scalars import run_seed
from millrace.operators import external, fusion, reports
from millrace.operators.constraints import ConstraintError
from millrace.sources import archives, scores, stores

DECISION = "bundle string, media_id string, probability double"


def decisions(seed=1):
    rng, rows, labels = np.random.default_rng(seed), [], []
    for i in range(60):
        fake = i % 2
        media = f"id{i % 9}_id{i % 7}_{i:04}" if i % 5 else f"clip{i}"
        labels.append((media, "FAKE" if fake else "REAL"))
        rows += [(b, media, None if rng.random() < 0.15 else float(np.clip(0.5 + (fake - 0.5) * k + rng.normal(0, 0.3), 0, 1))) for b, k in (("b", 0.2), ("c", 0.8))]
    return rows, labels


def test_bundles_are_compared_on_media_that_both_decided(spark):
    rows, labels = decisions()
    df, told = spark.createDataFrame(rows, DECISION), spark.createDataFrame(labels, "media_id string, label string")
    got = external.paired_comparison(df, told, "b", "c", 40, "s").first()
    score = {(b, m): p for b, m, p in rows}
    both = [(m, y) for m, y in labels if None not in (score["b", m], score["c", m])]
    lineage = lambda m: sorted({f"cdf:{t}" for t in m.split("_") if t.startswith("id")}) or [f"cdf:video:{m}"]
    plain = [(score["b", m], score["c", m], int(y == "FAKE"), "cdf", "fake" if y == "FAKE" else "", lineage(m)) for m, y in both]
    want = fusion.bootstrap_difference(spark.createDataFrame(plain, "base double, candidate double, label int, domain string, method string, lineage array<string>"), "base", "candidate", "method", "domain", "lineage", 40, "s").first()
    assert got.shared == len(both) < 60 and tuple(got)[:-1] == tuple(want)
    with pytest.raises(Exception, match="no single label for id1_id1_0001"):
        external.labelled(df, told.where("media_id <> 'id1_id1_0001'")).collect()


def test_development_identities(spark):
    rows = [("validation", "cdf", "cdf:id3_id1_0001"), ("validation", "cdf", "cdf:id3_0002"), ("validation", "ff", "ff:id9"), ("test", "cdf", "cdf:id8_0001"), ("validation", "cdf", "opaque"), ("validation", "cdf", None)]
    df = spark.createDataFrame(rows, "split string, source_domain string, video_id string")
    assert sorted(r[0] for r in external.development_identities(df).collect()) == ["cdf:id1", "cdf:id3"]


def test_a_second_run_scores_nothing(spark, tmp_path):
    names = lambda xs, n: spark.createDataFrame([(x,) for x in xs], f"{n} string")
    work = scores.scoring_work(names(["r1", "r 2"], "run"), names(["clean", "jpeg=50/x"], "setting"), names(["ff", "cdf"], "manifest"))
    keys, cache, asked = ["run", "setting", "manifest"], str(tmp_path / "cache"), []

    def score(open_work):
        asked.extend(tuple(r) for r in open_work.collect())
        return open_work.withColumn("sample_id", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn("score", F.lit(0.5))

    assert scores.score_missing(work.where("manifest = 'ff'"), score, cache, keys) == 4 and len(asked) == 4
    assert scores.score_missing(work, score, cache, keys) == 4 and len(set(asked)) == len(asked) == 8
    assert scores.score_missing(work, score, cache, keys) == 0 and len(asked) == 8
    assert spark.read.parquet(cache).count() == 16
    with pytest.raises(ConstraintError, match="2 of 2 pieces of work gave no rows"):
        scores.score_missing(work.limit(2).withColumn("run", F.concat("run", "manifest", "setting")), lambda w: score(w).where("false"), cache, keys)


def test_thresholds_are_locked_on_validation(spark):
    rng, rows = np.random.default_rng(3), []
    for split in ("validation", "test", "train"):
        for v in range(30):
            rows += [(split, f"v{v}", v % 2, float(np.clip((0.35 if split == "test" else 0.5) + (v % 2 - 0.5) * 0.4 + rng.normal(0, 0.2), 0, 1))) for _ in range(3)]
    df = spark.createDataFrame(rows, "split string, video string, label int, score double")
    got = {(r.split, r.unit): r for r in reports.locked_report(df, ["video"]).collect()}
    means = {k: np.mean([x for s, v, _, x in rows if (s, v) == k]) for k in {(s, v) for s, v, *_ in rows}}
    own = [(m, int(v[1:]) % 2) for (s, v), m in means.items() if s == "validation"]
    balanced = {t: (np.mean([m >= t for m, y in own if y]) + np.mean([m < t for m, y in own if not y])) / 2 for t, _ in own}
    best = min(t for t in balanced if balanced[t] >= max(balanced.values()) - 1e-12)
    assert set(got) == {(s, u) for s in ("validation", "test") for u in ("frame", "video")} and all(np.isclose(r.threshold, best) for r in got.values())
    test = [(m, int(v[1:]) % 2) for (s, v), m in means.items() if s == "test"]
    want = (np.mean([m >= best for m, y in test if y]) + np.mean([m < best for m, y in test if not y])) / 2
    assert np.isclose(got["test", "video"].balanced_accuracy, want)
    with pytest.raises(ConstraintError, match="lack a class"):
        reports.locked_report(df.where("label = 1"), ["video"])


def test_external_media_are_extracted_once(spark, tmp_path):
    (tmp_path / "down").mkdir()
    with zipfile.ZipFile(tmp_path / "down/x.zip", "w") as z:
        for name in ("set/real/a.mp4", "set/fake/b.mp4", "set/fake/c.mp4"):
            z.writestr(name, name)
    rows = spark.createDataFrame([("cdf:a", "real/a.mp4", "test"), ("cdf:b", "b.mp4", "test"), ("cdf:c", "c.mp4", "train")], "media_id string, file string, split string")
    members = archives.read_archives(spark, str(tmp_path / "down"))
    for _ in range(2):
        got = {r.media_id: r.path for r in archives.prepare_media(rows, "file", members, str(tmp_path / "out")).collect()}
        assert got == {"cdf:a": f"{tmp_path}/out/set/real/a.mp4", "cdf:b": f"{tmp_path}/out/set/fake/b.mp4"}
    assert sorted(p.name for p in (tmp_path / "out").rglob("*") if p.is_file()) == ["a.mp4", "b.mp4"]
    with pytest.raises(ConstraintError, match="members of several rows"):
        archives.prepare_media(rows.union(rows), "file", members, str(tmp_path / "out"))


def test_lookups_of_one(spark, tmp_path):
    for name in ("fusion-a.json", "other.json"):
        (tmp_path / name).write_text("{}")
    assert stores.single_file(spark, str(tmp_path), "fusion-*.json").endswith("/fusion-a.json")
    for pattern, n in (("*.json", 2), ("none*", 0)):
        with pytest.raises(ValueError, match=f"found {n}"):
            stores.single_file(spark, str(tmp_path), pattern)
    names = spark.createDataFrame([("m-freq-20260101-x",), ("frequency_resnet18-20991231",)], "n string")
    assert [r[0] for r in names.select(run_seed(F.col("n"), ("-freq-", "frequency_resnet18-"))).collect()] == [20260101, 20991231]
    with pytest.raises(Exception, match="no seed in a run's name: m-freq-2026"):
        spark.createDataFrame([("m-freq-2026",)], "n string").select(run_seed(F.col("n"), ("-freq-",))).collect()
