"""Entity-disjoint selection against one pick after the other."""

import hashlib
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions.scalars import lineage_tokens, source_entities
from millrace.operators import partition
from millrace.operators.constraints import ConstraintError
from millrace.operators.partition import PartitionSpec

CANDIDATE = "label string, method string, domain string, video string, entities array<string>"
SPEC = PartitionSpec("s-1", {"train": ["a", "b"], "validation": ["c"], "test": ["d", "e"]}, {"test": {"ff": 6, "cdf": 3}, "validation": {"ff": 5, "cdf": 4}, "train": {"ff": 12}})


def one_by_one(rows, spec):
    """Each pick looks at all candidates again."""
    owner, taken, out, short = {}, set(), [], []
    sha = lambda *x: hashlib.sha256("\0".join(x).encode()).hexdigest()
    for split, method, quotas in spec.stages:
        for domain, quota in quotas.items():
            cell = {v: e for label, m, d, v, e in rows if d == domain and (m == method if method else label == "REAL") and e}
            salt = [split, method] if method else ["real", split]
            for pick in range(quota):
                able = []
                for v, e in cell.items():
                    owners = {owner.get((domain, x)) for x in e}
                    if (method, domain, v) not in taken and not owners - {None, split}:
                        able.append((sum((domain, x) not in owner for x in e), sha(spec.seed, *salt, domain, v), v))
                if not able:
                    short.append((split, method or "real", domain, quota, pick))
                    break
                v = min(able)[2]
                taken.add((method, domain, v))
                owner |= {(domain, x): split for x in cell[v]}
                out.append((split, "FAKE" if method else "REAL", method or "", domain, v, pick + 1))
    return sorted(out), sorted(short)


def made(seed, n, entities):
    draw, rows = random.Random(seed), []
    for i in range(n):
        domain = draw.choice(["ff", "ff", "cdf"])
        block = draw.randrange(max(1, entities // 6))
        rows.append((*draw.choice([("FAKE", m) for m in "abcde"] + [("REAL", "")] * 6), domain, f"v{i}", sorted({f"e{6 * block + draw.randrange(6)}" for _ in range(draw.randint(0, 3))})))
    return rows


@pytest.mark.parametrize("seed, n, entities, bucket", [(1, 700, 300, 20_000), (2, 700, 300, 5), (3, 500, 60, 1), (4, 300, 6, 50)])
def test_picks_equal_those_of_one_long_sequence(spark, monkeypatch, seed, n, entities, bucket):
    """In one bucket, in many, with scarce entities, and where everything hangs together."""
    monkeypatch.setattr(partition, "BUCKET", bucket)
    rows = made(seed, n, entities)
    picked = partition.disjoint_partition(spark.createDataFrame(rows + rows[:20], CANDIDATE), SPEC).cache()
    got = sorted((r.split, r.label, r.method, r.domain, r.video, r["pick"]) for r in picked.collect())
    want, short = one_by_one(rows, SPEC)
    assert got == want and sorted(tuple(r) for r in partition.partition_shortfalls(picked, SPEC).collect()) == short
    assert partition.owners_in_conflict(picked).count() == 0 and (short != []) == (seed == 4)
    assert len({(r[2], r[3], r[4]) for r in got}) == len(got)


def test_merged_sequences_are_the_whole_one():
    """A pick that frees another: the freed one follows at once, though its hash is larger."""
    rows = pd.DataFrame([("ff", 0, "x", ["p", "q"], ["p", "q"], 3, "1"), ("ff", 0, "y", ["q", "p"], ["q", "p"], 3, "9"), ("ff", 0, "z", ["r"], ["r"], 3, "5"), ("ff", 0, "w", ["o"], [], 3, "7")],
                        columns=["domain", "bucket", "video", "entities", "free", "quota", "hash"])
    out = partition._sequence(rows)
    assert out["video"].tolist() == ["w", "z", "x"] and out["top_new"].tolist() == [0, 1, 2]
    out = partition._sequence(rows.assign(quota=9))
    assert out["video"].tolist() == ["w", "z", "x", "y"] and out["top_hash"].tolist() == ["7", "5", "1", "1"]


def test_no_candidates(spark):
    none = spark.createDataFrame([], CANDIDATE)
    assert partition.disjoint_partition(none, SPEC).count() == 0
    assert partition.partition_shortfalls(partition.disjoint_partition(none, SPEC), SPEC).count() == 13
    with pytest.raises(ConstraintError, match="several splits"):
        PartitionSpec("s", {"train": ["a"], "test": ["a"]}, {})
    with pytest.raises(ConstraintError, match="without a place"):
        PartitionSpec("s", {"dev": ["a"]}, {})


def catalog_rows(spark):
    rows = []
    for i in range(40):
        for k in range(2):
            for method, split, source in (("a", "train" if i % 8 else "test", "x.json"), ("c", "test", "archive:test/c.zip"), ("d", "test", "archive:train/d.zip" if i % 9 == 0 else "archive:test/d.zip"), ("zzz", "train", "x.json"), ("", "train", "x.json")):
                rows.append(("FAKE" if method else "REAL", split, method, "ff", f"ff:{i:03}_{(i * 7 + 1) % 40:03}" if method else f"ff:{i:03}", source, f"in/{method}/{i}/{k}.png", "c23" if i % 2 else "", "1", 7))
    return spark.createDataFrame(rows, "label string, split string, fake_method string, source_domain string, video_id string, source_json string, source_path string, compression string, frame_index string, extra int")


def test_rows_of_a_partition(spark):
    spec = PartitionSpec("s", {"train": ["a"], "validation": ["c"], "test": ["d"]}, {"test": {"ff": 4}, "validation": {"ff": 3}, "train": {"ff": 5}})
    rows = catalog_rows(spark)
    able = partition.eligible_rows(rows, spec)
    assert {r.fake_method for r in able.collect()} == {"a", "c", "d", ""} and able.where("fake_method = 'a' AND split <> 'train'").count() == 0 == able.where("source_json = 'archive:train/d.zip'").count()
    picked = partition.disjoint_partition(partition.candidates_of(able), spec)
    out = partition.partition_rows(rows, picked, spec)
    found = out.collect()
    assert len(found) == 2 * 24 and out.columns[:10] == rows.columns and {r.extra for r in found} == {7}
    parents = {}
    for r in found:
        for e in r.lineage_video_ids.split("|"):
            assert parents.setdefault(e, r.split) == r.split
        token = hashlib.sha256(r.source_path.encode()).hexdigest()[:12]
        assert r.relative_path == f"images/ff/{r.fake_method or 'real'}/{r.split}/{r.compression or 'none'}/{r.video_id[3:]}/{token}_{r.source_path.split('/')[-1]}"
        assert r.image_id == hashlib.sha256(r.relative_path.encode()).hexdigest()[:24]
    greedy = PartitionSpec("s", spec.methods, {"test": {"ff": 4000}})
    with pytest.raises(ConstraintError, match="too few disjoint groups: test d ff"):
        partition.partition_rows(rows, partition.disjoint_partition(partition.candidates_of(able), greedy), greedy)
    with pytest.raises(ConstraintError, match="one path"):
        partition.partition_rows(rows.union(rows), picked, spec)


def test_entities_and_lineage_by_name(spark):
    names = [("ff", "ff:137_165"), ("ff", "652_video_method"), ("ff", "ff:opaque"), ("cdf", "cdf:id2_id1_0001"), ("cdf", "cdf:opaque"), ("celeba", "celeba:12_3")]
    df = spark.createDataFrame(names, "d string, v string")
    got = [r[0] for r in df.select(source_entities(F.col("d"), F.col("v"))).collect()]
    assert got == [["ff:137", "ff:165"], ["ff:652"], ["ff:video:opaque"], ["cdf:id1", "cdf:id2"], [], ["celeba:12_3"]]
    explicit = spark.createDataFrame([(" b | a |",), ("  ",), (None,)], "x string").select(lineage_tokens(F.lit("ff"), F.lit("1_2"), F.col("x")))
    assert [r[0] for r in explicit.collect()] == [["ff:a", "ff:b"], ["ff:1", "ff:2"], ["ff:1", "ff:2"]]
