"""Subsets by quotas against one group after the other, and specifications with all their faults."""

import hashlib
import math
import random

import pytest

from millrace.operators import subsets
from millrace.operators.constraints import ConstraintError
from millrace.sources import sums, writers

ROW = "image_id string, label string, split string, fake_method string, source_domain string, video string, person string, frame string, extra int"
RAW = {
    "seed": "s", "id": "image_id", "label": "label", "split": "split", "method": "fake_method", "domain": "source_domain", "group_columns": ["person", "video"], "frame": "frame", "ratio": 0.7, "strict": False,
    "rules": {"train": {"methods": [" A ", "b"], "images": 20, "groups": 9, "frames": 3}, "test": {"methods": ["c"], "images": 1, "groups": 5, "frames": 4, "domains": {"ff": 12, "cdf": 5}}},
}


def catalog(seed=1):
    draw, rows = random.Random(seed), []
    for i in range(700):
        real = draw.random() < 0.4
        video = draw.randrange(60)
        split = "train" if video % 2 else "test"
        method = "" if real else draw.choice(["a", "B "] if split == "train" else ["c", "zzz"])
        rows.append((f"i{i}", "REAL" if real else "FAKE", split, method, draw.choice(["ff", "ff", "cdf"]), f"v{video}", f"p{video // 2 % 9}" if video % 5 == 0 else "", draw.choice([str(i % 17), f"x{i % 5}", ""]), i))
    return rows


def even(n, limit):
    if n <= limit:
        return list(range(n))
    return [n // 2] if limit == 1 else [round(i * (n - 1) / (limit - 1)) for i in range(limit)]


def one_by_one(rows, raw):
    sha = lambda *x: hashlib.sha256("\0".join(x).encode()).hexdigest()
    group = lambda r: f"person:{r[6]}" if r[6] else f"video:{r[5]}"

    def order(r):
        try:
            return (False, float(r[7]), r[7], r[0])
        except ValueError:
            return (True, 0.0, r[7], r[0])

    def take(pool, salt, images, frames, groups):
        out, left = [], images
        for g in sorted({group(r) for r in pool}, key=lambda g: (sha(raw["seed"], *salt, g), g))[:groups]:
            if left <= 0:
                break
            own = sorted((r for r in pool if group(r) == g), key=order)
            picked = [own[i] for i in even(len(own), min(frames, left))]
            out += picked
            left -= len(picked)
        return out, left

    chosen, short = [], []
    for split, rule in raw["rules"].items():
        fakes = []
        for m in rule["methods"]:
            for domain, images in sorted(rule.get("domains", {}).items()) or [("", rule["images"])]:
                pool = [r for r in rows if r[1] == "FAKE" and r[2] == split and r[3].strip().lower() == m.strip().lower() and domain in ("", r[4])]
                got, left = take(pool, [split, m], images, rule["frames"], rule["groups"])
                fakes += got
                short += [(split, m, domain, images, images - left)] if left else []
        chosen += [(r[0], "fake", group(r)) for r in fakes]
        for domain in sorted({r[4] for r in fakes}):
            target = math.ceil(sum(r[4] == domain for r in fakes) * raw["ratio"])
            got, left = take([r for r in rows if r[1] == "REAL" and r[2] == split and r[4] == domain], [split, "real", domain], target, rule["frames"], None)
            chosen += [(r[0], "real", group(r)) for r in got]
            short += [(split, "REAL", domain, target, target - left)] if left else []
    return sorted(chosen), sorted(short)


@pytest.mark.parametrize("seed", [1, 2])
def test_quotas_against_one_group_after_the_other(spark, tmp_path, seed):
    rows, spec = catalog(seed), subsets.spec_of(RAW)
    chosen, short = subsets.select_subset(spark.createDataFrame(rows, ROW).repartition(3), spec)
    want, want_short = one_by_one(rows, RAW)
    assert sorted((r.image_id, r.selection_role, r.selection_group) for r in chosen.collect()) == want
    assert sorted(tuple(r) for r in short.collect()) == want_short and chosen.columns == [f.split()[0] for f in ROW.split(", ")] + ["selection_group", "selection_role"]
    report = subsets.selection_report(chosen, short, spec)
    assert sum(r["images"] for r in report["selection_counts"]) == len(want) and len(report["quota_shortfalls"]) == len(want_short)
    name, path = writers.write_artifact(chosen, str(tmp_path), spec, report, sums=True)
    assert writers.verify_artifact(spark, path) == (True, []) and sums.require_sums(spark, path).count() >= 2
    part = next((tmp_path / name / "rows").glob("part-*"))
    part.with_name("part-more.parquet").write_bytes(b"")
    assert "rows/part-more.parquet is not listed" in writers.verify_artifact(spark, path)[1]


def test_strict_quotas_and_other_errors(spark):
    rows = spark.createDataFrame(catalog(), ROW)
    with pytest.raises(ConstraintError, match="quotas that aren't met: "):
        subsets.select_subset(rows, subsets.spec_of(RAW | {"strict": True, "rules": {"test": RAW["rules"]["test"] | {"domains": {"ff": 5000}}}}))
    with pytest.raises(ConstraintError, match="without a configured method: train nobody"):
        subsets.select_subset(rows, subsets.spec_of(RAW | {"rules": {"train": RAW["rules"]["train"] | {"methods": ["a", "nobody"]}}}))
    with pytest.raises(ConstraintError, match="ids chosen twice"):
        subsets.select_subset(rows.union(rows).withColumn("video", rows["image_id"]), subsets.spec_of(RAW | {"group_columns": ["video"], "rules": {"train": {"methods": ["a"], "images": 2000, "groups": 1000, "frames": 9}}}))
    with pytest.raises(ConstraintError, match="missing columns: person"):
        subsets.select_subset(rows.drop("person"), subsets.spec_of(RAW))


def test_specifications_name_all_their_faults():
    spec = subsets.spec_of(RAW)
    assert spec.rules["test"].domains == {"ff": 12, "cdf": 5} and writers.spec_fingerprint(spec) == writers.spec_fingerprint(subsets.spec_of(dict(reversed(RAW.items()))))
    bad = {k: v for k, v in RAW.items() if k != "seed"} | {"ratio": "1", "strict": 1, "group_columns": [], "odd": 1, "disjoint": "maybe", "rules": {
        "train": {"methods": ["a", 3], "images": 0, "groups": True, "frames": 2.5, "more": 1}, "test": 5, "dev": {"methods": ["x"], "images": 1, "groups": 1, "domains": {"ff": 0}}}}
    with pytest.raises(ConstraintError) as told:
        subsets.spec_of(bad)
    for fault in ("odd is unknown", "seed is missing", "ratio must be a number", "strict must be a yes or no", "group_columns must be a list of texts", "disjoint must be", "rules.train.methods must be a list of texts",
                  "rules.train.images must be at least 1", "rules.train.groups must be a whole number", "rules.train.frames must be a whole number", "rules.train.more is unknown", "rules.test must be a mapping",
                  "rules.dev.frames is missing", "rules.dev.domains.ff must be at least 1"):
        assert fault in str(told.value), fault
    shared = {"train": {"methods": ["a"], "images": 1, "groups": 1, "frames": 1}, "test": {"methods": ["A "], "images": 1, "groups": 1, "frames": 1}}
    with pytest.raises(ConstraintError, match="a is a method of train and test"):
        subsets.spec_of(RAW | {"rules": shared})
    assert subsets.spec_of(RAW | {"rules": shared, "disjoint": "none"})
    for raw in (None, [], RAW | {"rules": {}}, RAW | {"rules": 3}):
        with pytest.raises(ConstraintError):
            subsets.spec_of(raw)
