"""Hard negatives against all pairs in Python integers, and the bounds that let lists be skipped."""

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import negatives, queries

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, part int, rank string"


def floor256(x):
    return max(-(2**62), min(2**62, math.floor(min(max(x * 256, -1e308), 1e308))))


def brute(rows, every, k=5, m=3):
    """Rows are (id, vector, label), ids unique."""
    usable = [(i, [floor256(x) for x in v], y) for i, v, y in rows if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, va, ya in usable:
        if a % every:
            continue
        scored = [(max(-(2**63), min(2**63 - 1, sum(x * z for x, z in zip(va, v)))), i, y) for i, v, y in usable if i != a and len(v) == len(va)]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for p, i, _ in [s for s in scored if s[2] == ya][:k]:
            found = [s for s in scored if s[2] != ya and 50 * p <= 100 * s[0] <= 95 * p][:m]
            out += [(a, i, rank, j, p, n) for rank, (n, j, _) in enumerate(found, 1)]
    return sorted(out)


def mined(df, every, **more):
    got = negatives.mine_hard_negatives(df, F.col("vec_id") % every == 0, **more).collect()
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got)


def test_negatives_of_the_table_equal_all_pairs(spark):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    got = queries.op11_hard_negatives(spark, DATA).collect()
    assert sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got) == brute(rows, 50)


def clustered(n, seed=3):
    draw = np.random.default_rng(seed)
    centres = draw.normal(0, 1, (6, 8))
    return [(i, (centres[i % 6] + draw.normal(0, 0.05, 8)).tolist(), int(draw.integers(0, 3))) for i in range(n)]


def test_lists_split_into_parts_give_the_same(spark, monkeypatch):
    """A third of all rows are one vector, lists fall into several parts, blocks are small."""
    monkeypatch.setattr(negatives, "BLOCK", 16)
    rows = clustered(240) + [(1000 + i, [0.5] * 8, i % 2) for i in range(120)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5)
    want = brute(rows, 20)
    assert want and mined(df, 20, part_rows=20) == mined(df, 20) == want


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 1.9], 2), (3, [1.0, 1.9], 2), (4, None, 1), (5, [1.0, None], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 2),
            (8, [1.0, 2.0], None), (None, [1.0, 2.0], 1), (9, [], 1), (10, [], 2), (11, [], 1), (12, [0.0, 0.0], 1), (13, [0.0, 0.0], 2), (14, [1e300, 2.0], 1),
            (15, [9e299, 1.0], 1), (16, [-1e300, 2.0], 2), (17, [1.0, 2.0, 3.0], 1), (18, [-1.0, -2.0], 1), (19, [0.002, 0.0], 2), (20, [1.0, 1.5], 2)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert mined(df, 1) == brute(rows, 1)
    assert mined(df.where("false"), 1) == [] and mined(df, 10**6) == brute(rows, 10**6)
    # a row that comes twice counts once, as anchor and as partner
    assert mined(df.union(df), 1) == brute(rows, 1)


def test_bounds_hold_every_score(spark):
    vectors = np.array([v for _, v, _ in clustered(300)])
    codes = negatives.whole_numbers(vectors, 256.0)
    lists = negatives.Lists({8: negatives.fit_centroids(codes, 12)})
    own, gaps = lists.nearest(codes)
    lists.radii = {8: np.array([gaps[own == j].max(initial=0) for j in range(len(lists.of(8)))])}
    least, greatest = lists.bounds(codes)
    scores = negatives.products(codes, codes)
    assert (least[:, own] <= scores).all() and (scores <= greatest[:, own]).all()
    assert np.allclose(negatives.products(codes[:3] * 2**20, codes[:4] * 2**20).astype(float), codes[:3] @ codes[:4].T * 2.0**40)


def test_a_search_stops_below_the_kth_score(monkeypatch):
    """Of six far clusters only the anchor's own is read, and its result is that of reading all."""
    rows = clustered(600)
    codes = negatives.whole_numbers(np.array([v for _, v, _ in rows]), 256.0)
    ids, labels = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    lists = negatives.Lists({8: np.stack([codes[ids % 6 == j].mean(axis=0) for j in range(6)])})
    own, gaps = lists.nearest(codes)
    lists.radii = {8: np.array([gaps[own == j].max() for j in range(6)])}
    index = {j: [(ids[own == j], labels[own == j], codes[own == j])] for j in range(6)}
    visited = []
    real = negatives.Task.visit
    monkeypatch.setattr(negatives.Task, "visit", lambda self, w, i, *rest: (visited.append(len(i)), real(self, w, i, *rest))[1])
    everything = np.array([-(2**63)]), np.array([2**63 - 1])
    task = negatives.Task(codes[:1], ids[:1], labels[:1], np.array([0]), *everything, True, 5)
    task.search(index, lists)
    others = sorted((-int(s), int(i)) for s, i, y in zip(negatives.products(codes[:1], codes)[0], ids, labels) if y == labels[0] and i != ids[0])
    assert task.best[0] == others[:5] and sum(visited) < len(rows)


def test_window_shares_are_whole_hundredths(spark):
    scores = [0, 1, 2, 19, 20, 101, 12345, 2**63 - 1]
    got = spark.createDataFrame([(s,) for s in scores], "score long").select(negatives._share("score", 50, True).alias("low"), negatives._share("score", 95, False).alias("high")).collect()
    assert [tuple(r) for r in got] == [(math.ceil(Fraction(50 * s, 100)), 95 * s // 100) for s in scores]
