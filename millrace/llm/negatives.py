"""Hard negatives by inverted lists under K-means centroids, pruned by the Cauchy-Schwarz inequality.

Vectors are made whole numbers, so that inner products are exact. Every row goes to the list of its
nearest centroid, and a list keeps its radius, the largest distance of a row to the centroid. For an
anchor a, a list of centroid c and radius r has scores within a.c - |a|r and a.c + |a|r only: it is
passed over if these lie outside the window asked for, and an anchor is done with its lists, taken by
falling upper bound, as soon as that bound is strictly below the k-th score found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.durable import discard, stored

#: K-means learns from about so many rows, of so many bytes at most; all rows are indexed.
SAMPLE, SAMPLE_BYTES = 32_768, 64_000_000
#: Most lists, and most bytes of their centroids, which every task holds.
LISTS, CENTROID_BYTES = 4096, 16_000_000
#: Rows of the index that a task holds while anchors pass by; lists of more are split.
PART_ROWS = 131_072
#: Anchors that are searched together, and rows of a list that are multiplied at once.
ANCHORS, BLOCK = 256, 4096
#: Components are held to this, so that every product fits a Python integer of modest size.
LARGEST = 2.0**62

_ROW = "id long, label long, asks boolean, dim int, list int, gap double, codes binary"


def whole_numbers(vectors: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) of each component, in double precision."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(vectors.astype(np.float64) * scale), -LARGEST, LARGEST)


def _pack(codes: np.ndarray) -> np.ndarray:
    """Codes in the smallest of two types that holds them."""
    return codes.astype(np.int16) if np.abs(codes).max(initial=0) < 2**15 else codes


def _unpack(body: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(body, np.int16 if len(body) == 2 * rows * dim else np.float64).reshape(rows, dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, in the fastest type that can't round them."""
    most = (np.abs(a).sum(axis=1).max(initial=0) * np.abs(b).max(initial=0)) if a.size and b.size else 0
    if most < 2**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = [[int(x) for x in row] for row in b]
    return np.array([[sum(int(x) * y for x, y in zip(row, other)) for other in exact] for row in a], object).reshape(len(a), len(b))


@dataclass
class Lists:
    """Centroids by vector length and, once all rows are dealt, the radius and the parts of each list."""

    centroids: dict[int, np.ndarray]
    radii: dict[int, np.ndarray] | None = None

    def nearest(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, distance to its centroid) of each row."""
        c = self.of(codes.shape[1])
        near = (codes @ c.T) * -2.0 + (c * c).sum(axis=1)
        own = near.argmin(axis=1)
        return own, np.linalg.norm(codes - c[own], axis=1)

    def of(self, dim: int) -> np.ndarray:
        return self.centroids.get(dim, np.zeros((1, dim)))

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) score that each list can have for each anchor, rounding allowed for."""
        c, radii = self.of(anchors.shape[1]), self.radii[anchors.shape[1]]
        middle, length = anchors @ c.T, np.linalg.norm(anchors, axis=1)[:, None]
        slack = length * (radii + 1e-9 * (np.linalg.norm(c, axis=1) + radii)) + 1e-6
        return middle - slack, middle + slack


def fit_centroids(rows: np.ndarray, k: int, rounds: int = 10, seed: int = 1) -> np.ndarray:
    """K-means of at most ``k`` centroids; a centroid that gets no row stays where it is."""
    different = np.unique(rows, axis=0)
    c = different[np.sort(np.random.default_rng(seed).permutation(len(different))[:k])].astype(np.float64)
    for _ in range(rounds):
        own = ((rows @ c.T) * -2.0 + (c * c).sum(axis=1)).argmin(axis=1)
        counts = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, rows)
        c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
    return c


def _usable(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, whole-numbered vectors) by vector length; vectors with nulls or non-finite components go."""
    lists = batch.column("vector")
    there = lists.is_valid().to_numpy(zero_copy_only=False)
    lengths = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths[there]).tolist():
        take = np.flatnonzero(there & (lengths == dim))
        vectors = lists.take(pa.array(take)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(take), dim)
        good = np.isfinite(vectors).all(axis=1)
        if good.any():
            yield take[good], whole_numbers(vectors[good], scale)


def _arrays(kinds: str, columns: list) -> pa.RecordBatch:
    of = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "tinyint": pa.int8(), "boolean": pa.bool_()}
    names = [f.split() for f in kinds.split(", ")]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, of[kind]) for x, (_, kind) in zip(columns, names)], names=[n for n, _ in names])


def _coded(rows: DataFrame, lists: Lists, scale: float) -> DataFrame:
    """Rows (id, label, asks, vector) as codes with the list that each belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for take, codes in _usable(batch, scale):
                own, gaps = lists.nearest(codes)
                told = (batch.column(c).take(pa.array(take)) for c in ("id", "label", "asks"))
                yield _arrays(_ROW, [*told, [codes.shape[1]] * len(take), own, gaps, [_pack(x).tobytes() for x in codes]])

    return rows.mapInArrow(run, _ROW)


def fit_lists(rows: DataFrame, scale: float, sample: int = SAMPLE) -> Lists:
    """Centroids learned from a sample of about ``sample`` rows, drawn by a hash of id and vector."""
    n = rows.count()
    drawn = rows
    if n > sample:
        drawn = rows.where(F.pmod(F.xxhash64("id", "vector"), F.lit(2**30)) < int(2**30 * sample / n))
    widest = rows.agg(F.max(F.size("vector"))).first()[0] or 1
    some = drawn.select("vector").limit(max(64, min(2 * sample, SAMPLE_BYTES // (8 * max(widest, 1))))).toArrow()
    found: dict[int, list[np.ndarray]] = {}
    for batch in some.to_batches():
        for _, codes in _usable(batch, scale):
            found.setdefault(codes.shape[1], []).append(codes)
    centroids = {}
    for dim, held in ((d, h) for d, h in found.items() if d):
        all_of = np.concatenate(held)
        k = min(LISTS, max(1, CENTROID_BYTES // (8 * max(dim, 1) * len(found))), max(1, isqrt(max(n, 1))), len(all_of))
        centroids[dim] = fit_centroids(all_of, k)
    return Lists(centroids)


def _long(x: int) -> int:
    return max(-(2**63), min(2**63 - 1, x))


@dataclass
class Task:
    """Windows of a block of anchors: what each asks for, and the ``k`` best that were found so far."""

    anchors: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    place: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool
    k: int

    def __post_init__(self) -> None:
        self.best: list[list[tuple[int, int]]] = [[] for _ in self.place]
        self.floor = np.array(self.low)

    def alive(self, least: np.ndarray, greatest: np.ndarray) -> np.ndarray:
        """Which windows (rows) a list (columns) can still give something to: a bound equal to the k-th
        score can, as ties go by id."""
        return (greatest[self.place] >= self.floor[:, None]) & (least[self.place] <= self.high[:, None])

    def visit(self, windows: np.ndarray, ids: np.ndarray, labels: np.ndarray, codes: np.ndarray) -> None:
        """Take rows of a list into account for some windows."""
        at = np.unique(self.place[windows])
        scores = products(self.anchors[at], codes)
        own = scores[np.searchsorted(at, self.place[windows])]
        fits = (self.labels[self.place[windows]][:, None] == labels) == self.same
        fits &= self.ids[self.place[windows]][:, None] != ids
        fits &= (own >= self.floor[windows][:, None]) & (own <= self.high[windows][:, None])
        if own.dtype != object and len(ids) > 4 * self.k:
            # only what reaches the block's own k-th score can be among the best; an id may come twice
            reach = np.where(fits, own, np.iinfo(np.int64).min)
            if len(np.unique(ids)) == len(ids):
                fits &= own >= np.partition(reach, len(ids) - self.k, axis=1)[:, len(ids) - self.k][:, None]
        for i in np.flatnonzero(fits.any(axis=1)).tolist():
            window, hit = int(windows[i]), np.flatnonzero(fits[i])
            kept: dict[int, int] = {}
            for score, row in sorted([*self.best[window], *((-int(own[i, j]), int(ids[j])) for j in hit.tolist())]):
                kept.setdefault(row, score)
                if len(kept) == self.k:
                    break
            self.best[window] = [(score, row) for row, score in kept.items()]
            if len(kept) == self.k:
                self.floor[window] = max(int(self.low[window]), _long(-self.best[window][-1][0]))

    def search(self, index: dict[int, list[tuple]], lists: Lists) -> None:
        """Visit the lists that this task holds, by falling upper bound."""
        names = np.array(sorted(index), np.int64)
        least, greatest = (x[:, names] for x in lists.bounds(self.anchors))
        top = greatest.max(axis=0)
        for j in np.argsort(-top, kind="stable").tolist():
            if top[j] < self.floor.min():
                break
            windows = np.flatnonzero(self.alive(least[:, [j]], greatest[:, [j]])[:, 0])
            for ids, labels, codes in index[int(names[j])] if len(windows) else ():
                self.visit(windows, ids, labels, codes)


#: Rows of the index (kind 0) hold one vector, those of anchors (kind 1) a block of them.
_PASSING = "part int, kind tinyint, dim int, list int, id long, label long, codes binary, ids binary, labels binary, places binary, lows binary, highs binary"
_FOUND = "anchor_id long, low long, high long, id long, score long"


def _search(index: DataFrame, anchors: DataFrame, lists: Lists, parts_of: dict[tuple[int, int], list[int]], same: bool, k: int) -> DataFrame:
    """The ``k`` best rows of each anchor's windows in each part of the index.

    anchors: id, label, dim, list, codes, windows (array of (low, high)). Blocks of anchors of near
    lists go to the parts that hold a list which a window reaches into; a task reads its part of the
    index first, at most about PART_ROWS rows, and then lets the blocks of anchors pass.
    """
    part_of = {key: np.array(parts) for key, parts in parts_of.items()}

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}
        for batch in batches:
            for dim, row in zip(batch.column("dim").to_pylist(), zip(*(batch.column(c).to_pylist() for c in ("id", "label", "codes", "windows")))):
                held = waiting.setdefault(dim, [])
                held.append(row)
                if len(held) == ANCHORS:
                    yield from out(dim, waiting.pop(dim))
        for dim, held in waiting.items():
            yield from out(dim, held)

    def out(dim: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, labels = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
        codes = np.concatenate([_unpack(r[2], 1, dim) for r in rows]).astype(np.float64)
        place = np.repeat(np.arange(len(rows)), [len(r[3]) for r in rows])
        low, high = (np.array([w[name] for r in rows for w in r[3]], np.int64) for name in ("low", "high"))
        task = Task(codes, ids, labels, place, low, high, same, k)
        reached = np.flatnonzero(task.alive(*lists.bounds(codes)).any(axis=0)).tolist()
        parts = sorted({p for name in reached for p in part_of.get((dim, name), np.empty(0, np.int64)).tolist()})
        body = [x.tobytes() for x in (_pack(codes), ids, labels, place, low, high)]
        if parts:
            yield _arrays(_PASSING, [parts, *([x] * len(parts) for x in (1, dim, 0, None, None, *body))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, loose, held = None, {}, {}
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for here, kind, dim, name, row, label, codes, ids, labels, places, lows, highs in zip(*columns):
                if here != part:
                    part, loose, held = here, {}, {}
                if kind == 0:
                    loose.setdefault((dim, name), []).append((row, label, codes))
                    continue
                for key in [key for key in loose if key[0] == dim]:
                    rows = loose.pop(key)
                    own = [np.array([r[i] for r in rows], np.int64) for i in (0, 1)]
                    vectors = np.concatenate([_unpack(r[2], 1, dim) for r in rows])
                    held.setdefault(dim, {})[key[1]] = [(own[0][i : i + BLOCK], own[1][i : i + BLOCK], vectors[i : i + BLOCK]) for i in range(0, len(rows), BLOCK)]
                n = len(ids) // 8
                task = Task(_unpack(codes, n, dim).astype(np.float64), np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64),
                            np.frombuffer(places, np.int64), np.frombuffer(lows, np.int64), np.frombuffer(highs, np.int64), same, k)
                task.search(held.get(dim, {}), lists)
                rows = [(int(task.ids[task.place[w]]), int(task.low[w]), int(task.high[w]), row, _long(-score))
                        for w, found in enumerate(task.best) for score, row in found]
                if rows:
                    yield _arrays(_FOUND, [list(x) for x in zip(*rows)])

    blocks = anchors.repartitionByRange(F.col("dim"), F.col("list"), F.col("id")).sortWithinPartitions("dim", "list", "id").mapInArrow(block, _PASSING)
    return index.unionByName(blocks).repartition("part").sortWithinPartitions("part", "kind", "dim", "list").mapInArrow(run, _FOUND)


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The ``k`` best of each key with rank; an id that comes twice counts with its best score."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    best = found.groupBy(*keys, "id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, least: float = 0.5, most: float = 0.95,
    scale: float = 256.0, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", part_rows: int = PART_ROWS,
) -> DataFrame:
    """For each anchor and each of its first ``positives`` rows of the same label, the first
    ``negatives`` rows of other labels whose score lies between ``least`` and ``most`` times the
    positive's (both in whole hundredths): anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score. Exact.

    A score is the inner product of the vectors, their components made whole by floor(scale * x);
    higher scores come first, ties go to the smaller id. Rows of the anchor's own id are no partners.
    Rows with a null id, label, vector or component, or with a component that isn't finite, take no
    part; vectors meet only those of their own length. A positive score below zero leaves an empty
    window. A repeated id counts once as a partner, with its best score; a repeated anchor once, with
    its least label and vector. Scores beyond a long stop at its bounds. Empty tables, or no anchors,
    give no rows; other columns are not read.

    K-means learns from a bounded sample, all rows are indexed. The index is dealt into parts of
    ``part_rows`` rows; blocks of anchors pass the parts that their windows reach into, once for the
    positives and once for the negatives.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("asks"), F.col(vector_col).alias("vector"))
    lists = fit_lists(rows, scale)
    coded = stored(_coded(rows, lists, scale))
    parts_of = _deal(coded, lists, part_rows)
    where = F.broadcast(spark.createDataFrame([(d, x, p[0], len(p)) for (d, x), p in parts_of.items()], "dim int, list int, first int, pieces int"))
    nothing = [F.lit(None).cast("binary").alias(c) for c in ("ids", "labels", "places", "lows", "highs")]
    index = coded.join(where, ["dim", "list"]).select(
        (F.col("first") + F.pmod(F.xxhash64("id", "codes"), F.col("pieces"))).cast("int").alias("part"), F.lit(0).cast("tinyint").alias("kind"), "dim", "list", "id", "label", "codes", *nothing)
    anchors = stored(coded.where("asks").groupBy("id").agg(F.min(F.struct("label", "dim", "list", "codes")).alias("a")).select("id", "a.*"))
    whole = F.array(F.struct(F.lit(-(2**63)).cast("long").alias("low"), F.lit(2**63 - 1).cast("long").alias("high")))
    near = _first(_search(index, anchors.withColumn("windows", whole), lists, parts_of, True, positives), ["anchor_id"], positives)
    window = [_share("score", round(100 * least), True).alias("low"), _share("score", round(100 * most), False).alias("high")]
    near = stored(near.where(F.col("score") >= 0).select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), *window))
    windows = near.groupBy(F.col("anchor_id").alias("id")).agg(F.array_sort(F.collect_set(F.struct("low", "high"))).alias("windows"))
    keys = ["anchor_id", "low", "high"]
    far = _first(_search(index, anchors.join(windows, "id"), lists, parts_of, False, negatives), keys, negatives)
    out = stored(near.join(far, keys).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    for table in (coded, anchors, near):
        discard(table)
    return out


def _share(score: str, hundredths: int, up: bool) -> Column:
    """That many hundredths of a score of 0 or more, rounded up or down, without leaving a long."""
    rest = f"({score} % 100) * {hundredths}" + " + 99" * up
    return F.expr(f"({score} div 100) * {hundredths} + ({rest}) div 100")


def _deal(coded: DataFrame, lists: Lists, part_rows: int) -> dict[tuple[int, int], list[int]]:
    """Note the radius of each list, and pack the lists into parts one after the other; a list too large
    for a part gets several of its own. What the driver sees is a row for each list."""
    sizes = coded.groupBy("dim", "list").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius")).orderBy("dim", "list").collect()
    partitions = int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    room = min(part_rows, max(BLOCK, ceil(sum(r.n for r in sizes) / partitions)))
    lists.radii = {dim: np.zeros(len(lists.of(dim))) for dim in {r.dim for r in sizes}}
    parts_of, at, used = {}, 0, 0
    for r in sizes:
        lists.radii[r.dim][r.list] = r.radius
        if used and used + r.n > room:
            at, used = at + 1, 0
        pieces = ceil(r.n / room)
        parts_of[r.dim, r.list] = list(range(at, at + pieces))
        at, used = (at + pieces, 0) if pieces > 1 else (at, used + r.n)
    return parts_of
