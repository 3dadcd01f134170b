"""Nearest neighbours by a block matrix join over int8 codes.

Rows become blocks of vectors with int8 codes, a scale and the exact length of what rounding lost.
The product of two blocks of codes gives all distances of the tile up to those lengths; only pairs
whose lower bound is within reach are recomputed from the original vectors, in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import merge
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block of candidates and of queries.
CANDIDATES, QUERIES = 2048, 512
#: Query blocks whose results a task holds before it hands them on.
HELD = 32
#: Components of the candidates of a part: those blocks are held while the blocks of queries pass.
PART_COMPONENTS = 2**23

_BLOCK = "part int, dim int, ids binary, vectors binary, codes binary, scales binary, errors binary"


@dataclass
class Block:
    """Vectors of one length with their codes: ``vectors`` is ``scales * codes`` up to ``errors``."""

    ids: np.ndarray
    vectors: np.ndarray
    codes: np.ndarray
    scales: np.ndarray
    errors: np.ndarray

    @staticmethod
    def of(ids: np.ndarray, vectors: np.ndarray) -> Block:
        exact = vectors.astype(np.float64)
        scales = np.maximum(np.abs(exact).max(axis=1) / 127.0, 1e-300)
        codes = np.rint(exact / scales[:, None]).astype(np.int8)
        with np.errstate(over="ignore"):
            errors = scales * np.linalg.norm(exact / scales[:, None] - codes, axis=1)
        return Block(ids, vectors, codes, scales, errors)

    def row(self, parts: int) -> tuple:
        body = self.ids.tobytes()
        return (xxhash.xxh3_64_intdigest(body) % parts, self.vectors.shape[1], body,
                *(np.ascontiguousarray(x).tobytes() for x in (self.vectors, self.codes, self.scales, self.errors)))

    @staticmethod
    def read(dim: int, ids: bytes, vectors: bytes, codes: bytes, scales: bytes, errors: bytes) -> Block:
        n = len(ids) // 8
        kind = np.float32 if len(vectors) == 4 * n * dim else np.float64
        return Block(np.frombuffer(ids, np.int64), np.frombuffer(vectors, kind).reshape(n, dim),
                     np.frombuffer(codes, np.int8).reshape(n, dim), np.frombuffer(scales), np.frombuffer(errors))


def _usable(ids: pa.Array, lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of each vector length: finite, not all zero, with an id."""
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    there = (lengths > 0) & ids.is_valid().to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths[there]).tolist():
        take = pa.array(np.flatnonzero(there & (lengths == dim)))
        vectors = lists.take(take).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        if vectors.dtype not in (np.float32, np.float64):
            vectors = vectors.astype(np.float64)
        keys = ids.take(take).to_numpy(zero_copy_only=False)
        good = np.isfinite(vectors).all(axis=1) & (vectors != 0).any(axis=1)
        if good.any():
            yield keys[good].astype(np.int64), vectors[good]


def _blocks(rows: DataFrame, size: int, parts: int) -> DataFrame:
    """(id, vector) rows as blocks, each in one of ``parts`` by a hash of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}

        def out(ids: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
            names = [f.split()[0] for f in _BLOCK.split(", ")]
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
            row = Block.of(ids, vectors).row(parts)
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=names)

        for batch in batches:
            for ids, vectors in _usable(batch.column(0), batch.column(1)):
                held = waiting.setdefault(vectors.shape[1], [])
                held.append((ids, vectors))
                if sum(len(x) for x, _ in held) >= size:
                    ids, vectors = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
                    full = len(ids) // size * size
                    for lo in range(0, full, size):
                        yield out(ids[lo : lo + size], vectors[lo : lo + size])
                    held[:] = [(ids[full:], vectors[full:])] if full < len(ids) else []
        for held in waiting.values():
            if held:
                yield out(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))

    return rows.mapInArrow(run, _BLOCK)


def _parts_for(vectors: DataFrame) -> int:
    """Parts for the candidates ``v``: two for each core if there are so many blocks, and more if a part
    would hold more than ``PART_COMPONENTS``. Every query is copied to each part, so their number must
    not grow with the shuffle partitions."""
    rows, components = vectors.agg(F.count("v"), F.sum(F.greatest(F.size("v"), F.lit(0)).cast("long"))).first()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    return max(1, min(2 * cores, ceil(rows / CANDIDATES)), ceil((components or 0) / PART_COMPONENTS))


def exact_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance of each row of ``a`` and ``b`` in double precision, summed in order."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        gap = a[:, i].astype(np.float64) - b[:, i].astype(np.float64)
        total += gap * gap
    return np.sqrt(total)


def search_tile(queries: Block, candidates: Block, k: int, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query places, candidate places, distances) of every pair that can be among the ``k``
    nearest of its query, given that ``k`` candidates are known within ``reach`` (infinite: not yet known).
    The tile's own ``k`` nearest narrow it until all queries have one; then ``reach`` alone decides.

    Bounds are made in units of the tile's largest scale, where nothing overflows; what underflows there,
    and what the squares of very small distances lose, is part of the slack. Very large distances may be
    infinite in double precision, and then are equal, so their bounds rule nothing out."""
    dim = queries.codes.shape[1]
    unit = max(queries.scales.max(), candidates.scales.max())
    scales = [b.scales / unit for b in (queries, candidates)]
    own = [(b.codes.astype(np.int64) ** 2).sum(axis=1) * s**2 for b, s in zip((queries, candidates), scales)]
    lost = np.sqrt(dim) * (1e-155 + 3e-162 / unit)
    with np.errstate(over="ignore"):
        if np.isfinite(reach).all():
            far = (reach + queries.errors) / unit + 1e-7 * np.sqrt(own[0]) + lost
            q, c = _within(queries, candidates, scales, own, far, candidates.errors / unit)
            if 8 * len(q) <= len(queries.ids) * len(candidates.ids):  # else sizes are too far apart for single precision
                other = queries.ids[q] != candidates.ids[c]
                q, c = q[other], c[other]
                return q, c, exact_distances(queries.vectors[q], candidates.vectors[c])
        exact_in = np.float32 if dim * 127 * 127 < 2**24 else np.float64  # sums of products stay whole numbers
        product = queries.codes.astype(exact_in) @ candidates.codes.astype(exact_in).T
        square = own[0][:, None] + own[1] - 2.0 * scales[0][:, None] * scales[1] * product
        near = np.sqrt(np.maximum(square, 0.0))
        slack = queries.errors[:, None] / unit + candidates.errors / unit + 1e-7 * (near + np.sqrt(own[0])[:, None]) + lost
        others = queries.ids[:, None] != candidates.ids
        high = (near + slack) * unit
        high = np.where(others & (high < 1e150), high, np.inf)
        if high.shape[1] >= 2 * k + 2:
            # the k nearest of different ids: a candidate that is repeated counts once
            reach = np.minimum(reach, _kth_of_different(high, candidates.ids, k))
        q, c = np.nonzero(others & ((near - slack) * unit <= reach[:, None]))
        return q, c, exact_distances(queries.vectors[q], candidates.vectors[c])


def _within(
    queries: Block, candidates: Block, scales: list[np.ndarray], own: list[np.ndarray], far: np.ndarray, errors: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """Every pair whose codes may lie within ``far + errors`` of each other, by one product in single precision.

    |q - c| <= far + error, squared, is |q|^2 - far^2 <= 2qc + 2 far error - |c|^2 + error^2: what depends on
    both sides is a column more. So is what rounding can lose, in proportion to each candidate's own size."""
    dim = queries.codes.shape[1]
    more, lost, most = 1.0 + 1e-6, (dim + 8) * 2.0**-22, np.sqrt(dim)
    far, errors = np.minimum(far, 1000.0 * most), np.minimum(errors, most)  # no two rows are farther apart, no error is larger
    ones = np.ones(len(far))
    left = np.column_stack([2.0 * scales[0][:, None] * queries.codes, 2.0 * far, lost * np.sqrt(own[0]), ones]).astype(np.float32)
    rest = errors**2 * more * (1.0 + lost) - own[1] * (1.0 - lost)
    right = np.column_stack([scales[1][:, None] * candidates.codes, errors * more * (1.0 + lost), 2.0 * np.sqrt(own[1]), rest]).astype(np.float32)
    least = (own[0] - far**2 * more - dim * 1e-34).astype(np.float32)
    return np.nonzero(left @ right.T >= np.nextafter(least, np.float32(-np.inf))[:, None])


def _kth_of_different(high: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if len(np.unique(ids)) < len(ids):
        order = np.argsort(ids, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], np.diff(ids[order]) != 0)))
        high = np.minimum.reduceat(high[:, order], starts, axis=1)
        if high.shape[1] < k:
            return np.full(len(high), np.inf)
    return np.partition(high, k - 1, axis=1)[:, k - 1]


class Best:
    """The ``k`` nearest of each query of a block so far, as sorted lists of (distance, id)."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.lists: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.reach = np.full(len(ids), np.inf)

    def take(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        order = np.lexsort((ids, scores, q))
        q, found = q[order], list(zip(scores[order].tolist(), ids[order].tolist()))
        for place in np.unique(q).tolist():
            a, b = np.searchsorted(q, [place, place + 1])
            kept, seen = [], set()
            for item in merge(self.lists[place], found[a:b]):
                if item[1] not in seen:
                    seen.add(item[1])
                    kept.append(item)
                    if len(kept) == self.k:
                        self.reach[place] = item[0]
                        break
            self.lists[place] = kept

    def rows(self) -> pa.RecordBatch:
        every = [(int(q), i, s) for q, found in zip(self.ids, self.lists) for s, i in found]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in every], pa.int64()), pa.array([r[1] for r in every], pa.int64()), pa.array([r[2] for r in every], pa.float64())],
            names=["query_id", "vec_id", "score"])


def nearest(
    queries: DataFrame, candidates: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", parts: int | None = None,
) -> DataFrame:
    """The ``k`` nearest candidates of every query: query_id, rank (from 1), vec_id, score.

    score is the Euclidean distance of the original vectors in double precision; ties go to the
    smaller id. A query isn't its own candidate: rows of its id are left out. Rows without an id,
    and vectors that are null, empty, zero or hold null or non-finite components, take no part;
    vectors meet only those of their own length. A candidate id that is repeated counts once, with
    its nearest vector; so does a repeated query. Fewer candidates give fewer rows, empty tables
    none. Other columns are not read.

    Candidates are dealt into ``parts`` (by default by ``PART_COMPONENTS``), and every block of
    queries goes to each: a tile is one joined row, and a task holds some blocks at a time.
    Both sides are shuffled at any size: what Spark would estimate for a broadcast leaves out
    that queries are copied. Nothing is left out by the codes: the result is exact.
    """
    vectors = candidates.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    parts = parts or _parts_for(vectors)
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    asked = asked.repartition(max(1, ceil(asked.count() / QUERIES)))
    q = _blocks(asked, QUERIES, 1).drop("part").select(
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "dim", *(F.col(c).alias(f"q_{c}") for c in ("ids", "vectors", "codes", "scales", "errors")))
    c = _blocks(vectors, CANDIDATES, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], tuple[Block, Best]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                dim, *body = (column[i].as_py() for column in batch.columns)
                key = (dim, body[0] + body[1][:64])
                if key not in held:
                    if len(held) >= HELD:
                        yield from (best.rows() for _, best in held.values())
                        held.clear()
                    block = Block.read(dim, *body[:5])
                    held[key] = block, Best(block.ids, k)
                block, best = held[key]
                there = Block.read(dim, *body[5:])
                at, to, scores = search_tile(block, there, k, best.reach)
                best.take(at, there.ids[to], scores)
        yield from (best.rows() for _, best in held.values())

    tiles = q.join(c.hint("merge"), ["part", "dim"]).select(
        "dim", "q_ids", "q_vectors", "q_codes", "q_scales", "q_errors", "ids", "vectors", "codes", "scales", "errors")
    found = tiles.mapInArrow(run, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
