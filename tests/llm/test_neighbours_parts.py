"""Queries are copied to every part of the candidates: by a shuffle, to as many parts as the candidates need."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import neighbours


def held(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_copies_of_queries_are_never_broadcast(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CANDIDATES", 16)
    monkeypatch.setattr(neighbours, "PART_COMPONENTS", 500)
    vectors = np.random.default_rng(7).standard_normal((600, 6))
    docs = held(spark, [(i, v.tolist()) for i, v in enumerate(vectors)])
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        found = neighbours.nearest(docs.where("vec_id % 50 = 0"), docs, 3)
        got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    want = set()
    for q in range(0, 600, 50):
        far = neighbours.exact_distances(np.repeat(vectors[q : q + 1], 600, axis=0), vectors).tolist()
        want |= {(q, rank, i, s) for rank, (s, i) in enumerate(sorted((s, i) for i, s in enumerate(far) if i != q)[:3], 1)}
    assert got == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_parts_follow_the_candidates(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CANDIDATES", 10)
    cores = spark.sparkContext.defaultParallelism
    docs = held(spark, [(i, [1.0, 2.0, 3.0]) for i in range(1000)] + [(1000, None), (1001, [])]).select("vec_id", F.col("embedding").alias("v"))
    assert neighbours._parts_for(docs) == 2 * cores  # whatever spark.sql.shuffle.partitions says
    assert neighbours._parts_for(docs.where("vec_id < 25")) == 3
    assert neighbours._parts_for(docs.where("vec_id >= 1000")) == neighbours._parts_for(docs.where("false")) == 1
    monkeypatch.setattr(neighbours, "PART_COMPONENTS", 30)
    assert neighbours._parts_for(docs) == 100


@pytest.mark.parametrize("kind", [np.float32, np.float64])
@pytest.mark.parametrize("dim", [1, 3, 64, 300])
def test_known_reach_loses_no_pair(kind, dim, monkeypatch):
    """Rows of many sizes, copies and near copies: the bound and the tile give every pair within reach, ties included."""
    bound, seen = neighbours._within, []
    monkeypatch.setattr(neighbours, "_within", lambda *a: seen.append(bound(*a)) or seen[-1])
    rng = np.random.default_rng(dim)
    most = 30 if kind is np.float32 else 140
    size = 10.0 ** rng.integers(-most, most, 90)
    size[:60] = 10.0 ** rng.integers(-2, 3, 60)
    vectors = (rng.standard_normal((90, dim)) * size[:, None]).astype(kind)
    vectors[30:45] = vectors[:15]
    vectors[45:60] = (vectors[:15].astype(np.float64) * (1 + 1e-7 * rng.standard_normal((15, dim)))).astype(kind)
    block = neighbours.Block.of(np.arange(90) % 80, vectors)
    far = np.array([neighbours.exact_distances(np.repeat(v[None], 90, axis=0), vectors) for v in vectors])
    other = block.ids[:, None] != block.ids
    for rank in (0, 1, 2, 5, 40):
        reach = np.array([np.sort(d[o])[rank] for d, o in zip(far, other)])
        q, c, scores = neighbours.search_tile(block, block, 60, reach)
        assert np.array_equal(scores, far[q, c]) and other[q, c].all()
        want = set(zip(*(x.tolist() for x in np.nonzero(other & (far <= reach[:, None])))))
        assert set(zip(q.tolist(), c.tolist())) >= want <= set(zip(*(x.tolist() for x in seen[-1])))
    assert len(seen) == 5


@pytest.mark.parametrize("scale", [1.0, 1e160, 1e-160, 1e307, 1e-320])
def test_nearest_over_many_blocks_of_extreme_vectors(scale):
    rng = np.random.default_rng(8)
    vectors = rng.standard_normal((400, 5)) * np.where(np.arange(400) % 7 == 0, 1.0, scale)[:, None]
    vectors[200:220] = vectors[:20]
    asked = neighbours.Block.of(np.arange(0, 400, 9), vectors[::9])
    best = neighbours.Best(asked.ids, 6)
    with np.errstate(over="ignore"):
        for lo in range(0, 400, 32):
            block = neighbours.Block.of(np.arange(lo, min(lo + 32, 400)), vectors[lo : lo + 32])
            q, c, scores = neighbours.search_tile(asked, block, 6, best.reach)
            best.take(q, block.ids[c], scores)
        for place, i in enumerate(asked.ids.tolist()):
            far = neighbours.exact_distances(np.repeat(vectors[i][None], 400, axis=0), vectors).tolist()
            assert best.lists[place] == sorted((s, j) for j, s in enumerate(far) if j != i)[:6]


def test_known_reach_costs_one_matrix_in_single_precision():
    rng = np.random.default_rng(9)
    asked, block = (neighbours.Block.of(np.arange(n) + first, rng.standard_normal((n, 64)).astype(np.float32)) for n, first in ((512, 0), (2048, 1000)))
    reach = np.full(512, 7.5)
    neighbours.search_tile(asked, block, 10, reach)
    tracemalloc.start()
    try:
        q, _, scores = neighbours.search_tile(asked, block, 10, reach)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert 0 < (scores <= 7.5).sum() <= len(q) < 10_000 and most < 2 * 4 * 512 * 2048  # before, some matrices of doubles


def test_one_large_candidate_lets_no_others_pass():
    rng = np.random.default_rng(10)
    vectors = rng.standard_normal((2048, 64))
    vectors[7] *= 1e6
    asked, block = neighbours.Block.of(np.arange(512) + 5000, rng.standard_normal((512, 64))), neighbours.Block.of(np.arange(2048), vectors)
    tracemalloc.start()
    try:
        q, c, _ = neighbours.search_tile(asked, block, 10, np.full(512, 7.5))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert 0 < len(q) < 10_000 and most < 2 * 4 * 512 * 2048
