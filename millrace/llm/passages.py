"""Near-duplicate passages across documents, by compact windows.

A document is a sequence of word shingles. For one min-hash function, the Cartesian tree of the
sequence's hash values names for each shingle the widest interval of which it is the minimum: all
subsequences in that interval that hold the shingle share its signature. Intervals at least as wide as
the shortest passage are compact windows, about two for each such width of text. Two passages agree in
a function where windows of the same minimum hold them. The windows of two functions are joined by
their intervals in each document: where both hold one subsequence, their pair of minima is a key, and
documents that share a key agree in these two functions at that place. There they are compared, word
by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.durable import discard, stored
from millrace.llm.words import SHINGLE, WordHashes, jaccard, mix, shingle_hashes, words

_PLACE = np.uint64(2**24 - 1)
_STEP = 0x9E3779B97F4A7C15
#: Shingles whose minima are looked for together; longer texts are cut into parts that overlap by a window.
PART = 2**17
#: Bytes of text whose windows are made together.
SLICE = 4_000_000
#: Up to this many documents whose texts a round needs, their ids are broadcast to pick the texts before the shuffle.
FEW = 500_000
#: Windows of one key in a batch that go to the key's task; of more, one does, and the others are joined with it later.
PLAIN = 8
#: Parts into which a key's windows set aside are dealt.
SALTS = 32
#: Words of a bin in which windows and places of one document meet.
BIN = 256
#: How often windows without a passage are grouped anew, each time by as many more functions.
LEVELS = 1


@dataclass(frozen=True)
class PassageSettings:
    """Passages of ``min_words`` or more are found. Their windows must agree in two neighbours of a ring
    of ``functions`` hash functions: at similarity 0.8, 4 functions miss a passage of the shortest length
    with a chance of 0.078, an exact one never. (All pairs of 4 miss 0.027, with half as many rows
    again.)"""

    min_words: int = 50
    functions: int = 4
    similarity: float = 0.8
    shingle: int = SHINGLE

    @property
    def width(self) -> int:
        return self.min_words - self.shingle + 1

    @property
    def pairs(self) -> list[tuple[int, int]]:
        return [(f, (f + 1) % self.functions) for f in range(self.functions)]


def _ruling(shingles: np.ndarray, width: int, function: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the least value in each run of ``width`` shingles, all values). Of equal values the
    first is the least."""
    values = mix(shingles + np.uint64((function + 1) * _STEP % 2**64))
    low, reach = (values & ~_PLACE) | np.arange(len(values), dtype=np.uint64), 1
    while reach < width:
        step = min(reach, width - reach)
        low = np.minimum(low[:-step], low[step:])
        reach += step
    return (low & _PLACE).astype(np.int64), values


def compact_windows(shingles: np.ndarray, width: int, functions: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(function, keys, lefts, centres, rights) of the windows at least ``width`` wide, ends
    inclusive.

    The Cartesian tree's nodes of that width are the minima of the sliding windows of ``width``
    shingles, so only they are built; equal values count as smaller to the left. A node's interval
    ends where its run of sliding windows ends, or, if it outlasts the window, at the nearest
    smaller node. For at most 16 million shingles; ``meeting_windows`` reads longer texts in parts.
    """
    n = len(shingles)
    if n < width:
        return
    if n > int(_PLACE):
        raise ValueError("a text of more than 16 million words must be read in parts")
    for f in range(functions):
        at, values = _ruling(shingles, width, f)
        first = np.flatnonzero(np.concatenate(([True], np.diff(at) != 0)))
        last = np.concatenate((first[1:], [len(at)])) - 1
        centre, left, right = at[first], first.copy(), last + width - 1
        ranks, places = ((values[centre] & ~_PLACE) | centre.astype(np.uint64)).tolist(), centre.tolist()
        for open_side, order, out, past, edge in (
            (first == centre - width + 1, range(len(places)), left, 1, 0), (last == centre, range(len(places) - 1, -1, -1), right, -1, n - 1)):
            if not open_side.any():
                continue
            stack: list[int] = []
            wanted = open_side.tolist()
            for i in order:
                rank = ranks[i]
                while stack and ranks[stack[-1]] > rank:
                    stack.pop()
                if wanted[i]:
                    out[i] = places[stack[-1]] + past if stack else edge
                stack.append(i)
        yield f, values[centre].view(np.int64), left, centre, right


def meeting_windows(texts: list[np.ndarray], s: PassageSettings, first: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, key, left, right) of the places where compact windows of two functions
    join, for neighbours in the ring of functions from ``first`` on; ends inclusive.

    A key stands for the two minima. Its place is the union of the passages of the shortest length that
    both windows hold; these are neighbours, so they are the runs in which both sliding minima stay,
    and the tree's wider intervals aren't needed. Places of one key that overlap in a text, as in
    periodic texts, are one. Rows are sorted by key, text and place.
    """
    w, found = s.width, []
    for numbers, offsets, joined in _parts(texts, w):
        starts = np.concatenate(([0], np.cumsum([len(x) for x in joined])))
        every = np.concatenate(joined)
        if len(every) < w:
            continue
        owner = np.repeat(np.arange(len(joined)), np.diff(starts))
        whole = np.flatnonzero(owner[: len(every) - w + 1] == owner[w - 1 :])  # runs inside one text
        fresh = np.concatenate(([True], np.diff(owner[whole]) != 0))
        minima = []
        for f in range(first, first + s.functions):
            at, values = _ruling(every, w, f)
            at = at[whole]
            minima.append((values[at], np.concatenate(([True], np.diff(at) != 0)) | fresh))
        for no, (f, g) in enumerate(s.pairs):
            (one, turns), (two, turns_too) = minima[f], minima[g]
            begins = np.flatnonzero(turns | turns_too)
            ends = np.concatenate((begins[1:], [len(whole)])) - 1
            key = mix(one[begins] ^ mix(two[begins] + np.uint64((first + no + 1) * _STEP % 2**64)))
            text = owner[whole[begins]]
            shift = offsets[text] - starts[text]
            found.append((numbers[text], key.view(np.int64), whole[begins] + shift, whole[ends] + w - 1 + shift))
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    text, key, left, right = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(key, kind="stable")  # a pair's rows come by text and place
    text, key, left, right = text[order], key[order], left[order], right[order]
    same = (text[1:] == text[:-1]) & (key[1:] == key[:-1]) & (left[1:] <= right[:-1] + 1)
    heads = np.flatnonzero(np.concatenate(([True], ~same)))
    return text[heads], key[heads], left[heads], np.maximum.reduceat(right, heads)


def run_hashes(shingles: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` shingles, put together from runs of powers of two."""
    n = len(shingles) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, run, size = np.zeros(n, np.uint64), 0, mix(shingles), 1
    while True:
        if width & size:
            out = mix(out * np.uint64(_STEP) + run[done : done + n])
            done += size
        if done == width:
            return out
        run = mix(run[:-size] * np.uint64(_STEP) + run[size:])
        size *= 2


def _parts(texts: list[np.ndarray], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(text numbers, offsets in them, arrays) of about ``PART`` shingles together; a longer text comes
    in parts that overlap by all but one shingle of a window."""
    numbers, offsets, held, size = [], [], [], 0
    for i, text in enumerate(texts):
        for lo in range(0, max(1, len(text) - width + 1), PART):
            piece = text[lo : lo + PART + width - 1]
            if held and size + len(piece) > PART + width - 1:
                yield np.array(numbers), np.array(offsets), held
                numbers, offsets, held, size = [], [], [], 0
            if len(piece) >= width:
                numbers.append(i)
                offsets.append(lo)
                held.append(piece)
                size += len(piece)
    if held:
        yield np.array(numbers), np.array(offsets), held


def matching_passages(a: np.ndarray, b: np.ndarray, s: PassageSettings) -> list[tuple[int, int, int, int, float]]:
    """(start in b, end in b, start in a, end in a, similarity) of shingle runs of ``a`` and ``b``
    that are near-duplicates, ends exclusive.

    Sliding windows of ``b`` with as many shingles of ``a`` as two sets of that size must share
    are joined to runs; a run stands if it, or one of its windows, has the similarity with what
    lies at the same offset in ``a``.
    """
    w = s.width
    if len(b) < w or len(a) < w:
        return []
    order = np.argsort(a, kind="stable")
    where = np.minimum(np.searchsorted(a[order], b), len(a) - 1)
    met = a[order][where] == b
    to = np.where(met, order[where], -1)
    need = ceil(w * 2 * s.similarity / (1 + s.similarity) - 1e-9)
    # repeated shingles make a set smaller than its window, so that they may match more often
    total = np.concatenate(([0], np.cumsum(met)))
    good = np.flatnonzero(total[w:] - total[:-w] >= need)
    out = []
    for run in np.split(good, np.flatnonzero(np.diff(good) > w) + 1):
        if not len(run):
            continue
        inside = np.flatnonzero(met[run[0] : run[-1] + w]) + run[0]
        x, y = int(inside[0]), int(inside[-1]) + 1
        offset = int(np.median(to[inside] - inside))
        # of several equal shingles the one at the run's offset
        beside = np.clip(inside + offset, 0, len(a) - 1)
        at = np.where(a[beside] == b[inside], beside, to[inside])
        close = at[np.abs(at - inside - offset) <= w]
        at = close if len(close) else at
        p, q = int(at.min()), int(at.max()) + 1
        same = jaccard(np.unique(a[p:q]), np.unique(b[x:y]))
        starts = run[:: max(1, w // 4)].tolist() + [int(run[-1])]
        while same < s.similarity - 1e-12 and starts:
            start = starts.pop()
            places = np.flatnonzero(met[start : start + w]) + start
            lo = min(max(0, start + int(np.median(to[places] - places))), len(a) - w)
            same = max(same, jaccard(np.unique(a[lo : lo + w]), np.unique(b[start : start + w])))
        if same >= s.similarity - 1e-12:
            out.append((x, y, p, q, same))
    return out


#: A window's left end, width and state share one number, as these rows are most of what is shuffled.
_WINDOWS = {"key": pa.int64(), "node": pa.int64(), "place": pa.int64()}
#: States of a window: dealt by its key; so, with others of its batch set aside; set aside.
_ALONE, _FIRST, _ASIDE = 0, 1, 2


def _packed(left: np.ndarray, right: np.ndarray, state: np.ndarray) -> np.ndarray:
    return left.astype(np.int64) << 32 | (right - left).astype(np.int64) << 2 | state


def _batch(columns: list[np.ndarray], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(k.to_pandas_dtype())) for c, k in zip(columns, kinds.values())], names=list(kinds))


def _slices(ends: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``size`` bytes, or one row; ``ends`` are the running sums."""
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right")))
        yield lo, hi
        lo = hi


def _windows(docs: DataFrame, s: PassageSettings) -> DataFrame:
    """The joined windows of all documents.

    They are dealt by their key. Where a slice of a batch has more than ``PLAIN`` of a key, only that of its least
    node is; the others are set aside and dealt by a hash, so that a key that most documents have
    brings few rows a batch to the task that gets it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy())
            for lo, hi in _slices(sizes, SLICE):
                part = batch.slice(lo, hi - lo)
                part = part.take(pa.array(np.argsort(part.column(0).to_numpy(), kind="stable")))
                nodes = part.column(0).to_numpy()
                text, key, left, right = meeting_windows([shingle_hashes(hashes.of(words(t.as_py())), s.shingle) for t in part.column(1)], s)
                if not len(key):
                    continue
                node = nodes[text]
                begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                counts = np.diff(np.concatenate((begins, [len(key)])))
                state = np.repeat(np.where(counts > PLAIN, _ASIDE, _ALONE), counts)
                state[begins[counts > PLAIN]] = _FIRST
                yield _batch([key, node, _packed(left, right, state)], _WINDOWS)

    return docs.mapInArrow(run, "key long, node long, place long")


def _merged(rows: DataFrame) -> DataFrame:
    """(key, a, al, ar, b, l, r): windows of ``b`` beside that of the least node ``a`` that has their key, from
    windows dealt and sorted by key and node. Windows set aside have no ``a``; the heads that they need
    have no ``b``."""
    kinds = {"key": pa.int64(), "a": pa.int64(), "al": pa.int32(), "ar": pa.int32(), "b": pa.int64(), "l": pa.int32(), "r": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[np.ndarray] | None = None  # the head that the next batch may go on with
        for batch in batches:
            key, node, place = (c.to_numpy() for c in batch.columns)
            left, right, state = place >> 32, (place >> 32) + ((place & 0xFFFFFFFF) >> 2), place & 3
            aside = state == _ASIDE
            out = [[key[aside], np.zeros(aside.sum(), np.int64), *[np.zeros(aside.sum(), np.int32)] * 2, node[aside], left[aside], right[aside]]]
            here = [x[~aside] for x in (key, node, left, right, state)]
            if last is not None:
                here = [np.concatenate(x) for x in zip(last, here)]
            key, node, left, right, state = here
            if len(key):
                new = np.concatenate(([True], key[1:] != key[:-1]))
                head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
                last = [x[head[-1:]] for x in (key, node, left, right)] + [np.zeros(1, np.int64)]
                met = node != node[head]
                out.append([key[met], node[head][met], left[head][met], right[head][met], node[met], left[met], right[met]])
                wanted = head[state == _FIRST]
                out.append([key[wanted], node[wanted], left[wanted], right[wanted], *[np.zeros(len(wanted), np.int64)] * 3])
            else:
                wanted = np.empty(0)
            columns = [np.concatenate(c) for c in zip(*out)]
            n, no_a, no_b = len(columns[0]), len(out[0][0]), len(wanted)
            hidden = {"a": np.arange(n) < no_a, "b": np.arange(n) >= n - no_b}
            arrays = [pa.array(c.astype(k.to_pandas_dtype()), k, mask=hidden.get(name)) for (name, k), c in zip(kinds.items(), columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=list(kinds))

    return rows.mapInArrow(run, "key long, a long, al int, ar int, b long, l int, r int")


def _meet(windows: DataFrame) -> DataFrame:
    """The merged windows, dealt by their key or, if set aside, by a hash."""
    own = F.when(F.col("place").bitwiseAND(3) == _ASIDE, F.xxhash64("key", "node")).otherwise(F.col("key"))
    return _merged(windows.repartition(own).sortWithinPartitions("key", "node", "place"))


def _hits(met: DataFrame) -> DataFrame:
    """All windows beside their key's head: those dealt with it, and those set aside, which are dealt into
    ``SALTS`` parts of their key, each with the head in front."""
    packed = F.shiftleft(F.col("l").cast("long"), 32).bitwiseOR(F.shiftleft((F.col("r") - F.col("l")).cast("long"), 2))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    heads = met.where(F.col("b").isNull()).select("key", F.col("a").alias("node"), F.col("al").alias("l"), F.col("ar").alias("r")).distinct()
    aside = met.where(F.col("a").isNull()).select("key", F.col("b").alias("node"), packed.alias("place"), F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt"))
    parts = aside.unionByName(heads.select("key", "node", packed.alias("place"), salts))
    late = _merged(parts.repartition("key", "salt").sortWithinPartitions("key", "salt", "node", "place").select("key", "node", "place"))
    return met.where(F.col("a").isNotNull() & F.col("b").isNotNull()).unionByName(late)


def _places(hits: DataFrame, s: PassageSettings) -> DataFrame:
    """(a, b, a_lo, a_hi, b_lo, b_hi): where documents meet. Intervals of ``b`` that overlap are joined.
    A place gets a margin of one passage, for ends whose windows were compared with another document."""
    pair = Window.partitionBy("a", "b").orderBy("l", "r", "al")
    before = F.max("r").over(pair.rowsBetween(Window.unboundedPreceding, -1))
    islands = hits.withColumn("fresh", (F.coalesce(before, F.lit(-1)) < F.col("l")).cast("int")).withColumn(
        "island", F.sum("fresh").over(pair.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("a", "b", "island").agg(
        F.greatest(F.min("al") - s.width, F.lit(0)).alias("a_lo"), (F.max("ar") + s.width).alias("a_hi"),
        F.greatest(F.min("l") - s.width, F.lit(0)).alias("b_lo"), (F.max("r") + s.width).alias("b_hi"),
    ).drop("island")


def _picked(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The documents named, picked before a shuffle if they are few; else all."""
    wanted = nodes.distinct()
    return docs.join(F.broadcast(wanted), "node", "left_semi") if wanted.limit(FEW + 1).count() <= FEW else docs


def _compare(places: DataFrame, docs: DataFrame, s: PassageSettings) -> DataFrame:
    """(a, b, a_lo, a_hi, b_lo, b_hi, start, end, a_start, a_end, similarity) of each passage and its
    place; start is null for a place without one. Word numbers, ends exclusive. A stored table, for which
    that of the places goes."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = []
            for text, lo, hi in zip(batch.column("text"), batch.column("lo").to_pylist(), batch.column("hi").to_pylist()):
                body.append(b" ".join(words(text.as_py())[lo : hi + s.shingle]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("lo"), batch.column("hi"), pa.array(body, pa.binary())], names=["node", "lo", "hi", "body"])

    spans = places.select(F.col("a").alias("node"), F.col("a_lo").alias("lo"), F.col("a_hi").alias("hi")).unionByName(
        places.select(F.col("b").alias("node"), F.col("b_lo").alias("lo"), F.col("b_hi").alias("hi"))).distinct()
    cuts = stored(spans.join(_picked(docs, spans.select("node")), "node").select("node", "lo", "hi", "text").mapInArrow(pieces, "node long, lo int, hi int, body binary"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        names = ["a", "b", "a_lo", "a_hi", "b_lo", "b_hi", "start", "end", "a_start", "a_end", "similarity"]
        kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 8, pa.float64()]
        for batch in batches:
            rows = []
            for a, b, a_lo, a_hi, b_lo, b_hi, a_body, b_body in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "a_lo", "a_hi", "b_lo", "b_hi", "a_body", "b_body"))):
                more = s.shingle - 1
                if a_body == b_body:  # copies, as most are
                    n = a_body.count(b" ") + 1 - more
                    found = [(0, n, 0, n, 1.0)] if n >= s.width else []
                else:
                    left, right = (shingle_hashes(hashes.of(x.split()), s.shingle) for x in (a_body, b_body))
                    found = matching_passages(left, right, s)
                place = a, b, a_lo, a_hi, b_lo, b_hi
                rows += [(*place, b_lo + x, b_lo + y + more, a_lo + p, a_lo + q + more, j) for x, y, p, q, j in found] or [(*place, *[None] * 5)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    side = lambda x: cuts.select(*(F.col(c).alias(f"{x}{'' if c == 'node' else '_' + c}") for c in ("node", "lo", "hi", "body")))
    out = stored(places.join(side("b"), ["b", "b_lo", "b_hi"]).join(side("a"), ["a", "a_lo", "a_hi"]).select(
        "a", "b", "a_lo", "a_hi", "b_lo", "b_hi", "a_body", "b_body").mapInArrow(
        compare, "a long, b long, a_lo int, a_hi int, b_lo int, b_hi int, start int, end int, a_start int, a_end int, similarity double"))
    discard(cuts)
    discard(places)
    return out


def _still_open(members: DataFrame, compared: DataFrame, by: list[str]) -> DataFrame:
    """Members, one for each value of ``by``, open if they were and lie in no place with a passage."""
    good = compared.where(F.col("start").isNotNull())
    bins = lambda c: F.floor(F.col(c) / BIN)
    places = good.select(F.col("b").alias("at"), F.col("b_lo").alias("lo"), F.col("b_hi").alias("hi")).unionByName(
        good.select(F.col("a").alias("at"), F.col("a_lo").alias("lo"), F.col("a_hi").alias("hi"))).distinct().withColumn("bin", F.explode(F.sequence(bins("lo"), bins("hi"))))
    binned = members.withColumn("own", bins("l"))
    inside = (binned["node"] == places["at"]) & (binned["own"] == places["bin"]) & (binned["l"] >= places["lo"]) & (binned["r"] <= places["hi"])
    return binned.join(places, inside, "left").groupBy(*by).agg((F.bool_and("open") & (F.count("lo") == 0)).alias("open"))


def _in_groups(members: DataFrame) -> DataFrame:
    """Members of those groups that hold several documents and an open window."""
    groups = members.groupBy("g").agg(F.bool_or("open").alias("any"), F.min("node").alias("first"), F.max("node").alias("last"))
    return members.join(groups.where(F.col("any") & (F.col("first") < F.col("last"))).select("g"), "g", "left_semi")


def _regrouped(going: DataFrame, docs: DataFrame, s: PassageSettings, level: int) -> DataFrame:
    """(g, node, l, r, open): windows of groups with an open window, in smaller groups.

    A window is open if no passage was found where it lies; the others are there to be compared with, and
    of those whose words are the same all around, one stands for all. A smaller group is the old one with
    one of the keys that the functions of this level give at the same place: windows that only share a
    frequent line part, while a passage of similarity 0.8 stays together but for 0.078 of cases. Another
    group is all open windows that hold the same shortest passage, word for word: its members are copies
    of its least one, so that no copy is missed.
    """
    kinds = {"g": pa.int64(), "node": pa.int64(), "l": pa.int32(), "r": pa.int32(), "open": pa.bool_()}
    columns = "g long, node long, l int, r int, open boolean"

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _slices(np.cumsum(pc.binary_length(batch.column(2)).to_numpy()), SLICE):
                yield batch.slice(lo, hi - lo)

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            parts = []
            for node, held, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                found = words(text.as_py())
                group, left, right, is_open = (held.values.field(c).to_numpy(zero_copy_only=False) for c in ("g", "l", "r", "open"))
                seen = [b" ".join(found[max(0, a - s.width) : b + s.width + s.shingle]) for a, b in zip(left.tolist(), right.tolist())]
                content = np.array([xxhash.xxh3_64_intdigest(x) for x in seen], np.uint64).view(np.int64)
                parts.append([group, np.full(len(group), node), left, right, is_open, content])
            if parts:
                yield _batch([np.concatenate(c) for c in zip(*parts)], kinds | {"content": pa.int64()})

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in sliced(batches):
            parts = []
            texts = [shingle_hashes(hashes.of(words(t.as_py())), s.shingle) for t in batch.column(2)]
            number, keys, lefts, rights = meeting_windows(texts, s, first=level * s.functions)
            order = np.lexsort((lefts, number))
            number, keys, lefts, rights = number[order], keys[order].view(np.uint64), lefts[order], rights[order]
            ends = np.searchsorted(number, np.arange(len(texts) + 1))
            for i, (node, held) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                group, left, right, is_open = (held.values.field(c).to_numpy(zero_copy_only=False) for c in ("g", "l", "r", "open"))
                key, lo, hi = (x[ends[i] : ends[i + 1]] for x in (keys, lefts, rights))
                widest = int((hi - lo).max(initial=0))
                # windows with a whole passage in common begin between these places
                begin = np.searchsorted(lo, left - widest)
                counts = np.searchsorted(lo, right - s.width + 1, "right") - begin
                mine = np.repeat(np.arange(len(group)), counts)
                other = np.arange(len(mine)) - np.repeat(np.cumsum(counts) - counts, counts) + begin[mine]
                l, r = np.maximum(left[mine], lo[other]), np.minimum(right[mine], hi[other])
                good = r - l + 1 >= s.width
                g = mix(group[mine].view(np.uint64) ^ mix(key[other])).view(np.int64)
                parts.append([x[good] for x in (g, np.full(len(g), node), l, r, is_open[mine])])
                # exact copies meet by the hash of a whole shortest passage, whoever else has its words
                spans = np.zeros(len(texts[i]) + 2, np.int64)
                np.add.at(spans, left[is_open], 1)
                np.add.at(spans, np.maximum(left, right - s.width + 2)[is_open], -1)
                at = np.flatnonzero(np.cumsum(spans)[: max(0, len(texts[i]) - s.width + 1)] > 0)
                if len(at):
                    runs = run_hashes(texts[i], s.width)[at].view(np.int64)
                    parts.append([runs, np.full(len(at), node), at, at + s.width - 1, np.ones(len(at), bool)])
            if parts:
                yield _batch([np.concatenate(c) for c in zip(*parts)], kinds)

    def with_texts(windows: DataFrame) -> DataFrame:
        listed = windows.groupBy("node").agg(F.collect_list(F.struct("g", "l", "r", "open")).alias("windows"))
        return listed.join(_picked(docs, windows.select("node")), "node").select("node", "windows", "text")

    each = stored(with_texts(going).mapInArrow(contents, columns + ", content long"))
    same = each.where("NOT open").groupBy("g", "content").agg(F.min(F.struct("node", "l", "r", "open")).alias("one"))
    fewer = stored(_in_groups(each.where("open").drop("content").unionByName(same.select("g", "one.*"))))
    smaller = stored(with_texts(fewer).mapInArrow(again, columns))
    out = stored(_in_groups(smaller.groupBy("g", "node", "l", "r").agg(F.bool_and("open").alias("open"))))
    for table in (each, fewer, smaller):
        discard(table)
    return out


def _beside_heads(members: DataFrame, asked: bool = False) -> DataFrame:
    """(g, a, al, ar, b, l, r, open, a_open) of members beside the first window of their group's least
    document; with ``asked`` only those where a window of either is open."""
    heads = members.groupBy("g").agg(F.min(F.struct("node", "l", "r")).alias("at"), F.min(F.struct("node", (~F.col("open")).alias("shut"))).alias("own")).select(
        "g", F.col("at.node").alias("a"), F.col("at.l").alias("al"), F.col("at.r").alias("ar"), (~F.col("own.shut")).alias("a_open"))
    met = members.join(heads, "g").where(F.col("node") != F.col("a"))
    return (met.where("open OR a_open") if asked else met).select("g", "a", "al", "ar", F.col("node").alias("b"), "l", "r", "open", "a_open")


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: PassageSettings = PassageSettings(),
) -> DataFrame:
    """Passages that are near-duplicates of a passage of another document.

    Returns one row for each passage: id, start_word, end_word (exclusive), rep_id, rep_start,
    rep_end, similarity. The representative is the smallest id among the documents that it was
    compared with; it has a row of its own, with itself as representative. Passages are at least
    ``min_words`` long, and two are near-duplicates if windows of that many words at the same
    offset have sets of word shingles of the Jaccard similarity; longer runs of such windows are
    one passage.

    Of the windows that share a key, each is compared with the first one of the least id. Those that
    found no passage there go on in smaller groups, by the keys of as many other functions, where each is
    compared with the first of the least id again: ``LEVELS`` times; and in groups of those that hold the
    same shortest passage word for word, so that no exact passage is missed. A changed one is missed if each
    time all the minima of its windows lie in words that it shares with documents of smaller id without
    being similar to them. Which documents are compared depends
    on the ids and texts alone, not on how the rows are partitioned. Texts of any length are read whole.
    Null, empty
    and short texts have no passages; nor have rows without an id. Repeats inside one document don't
    count. Rows of one id are one document. Other columns are not read.
    """
    s = settings
    rows = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")).where(
        F.col("node").isNotNull() & F.col("text").isNotNull())
    met = stored(_meet(_windows(rows, s)))
    compared = _compare(stored(_places(_hits(met), s)), rows, s)
    held, found = [compared], compared.where(F.col("start").isNotNull())
    members = _hits(met).select(F.col("key").alias("g"), F.col("b").alias("node"), "l", "r", F.lit(True).alias("open")).distinct()
    for level in range(1, LEVELS + 1):
        going = stored(_in_groups(_still_open(members, compared, ["g", "node", "l", "r"])))
        if level == 1:
            discard(met)
        if going.isEmpty():
            discard(going)
            break
        smaller = _regrouped(going, rows, s, level)
        discard(going)
        beside = stored(_beside_heads(smaller, level == LEVELS))
        discard(smaller)
        held.append(beside)
        hits = beside.where("open OR a_open").select("a", "b", "al", "ar", "l", "r").distinct()
        compared = _compare(stored(_places(hits, s)), rows, s)
        held.append(compared)
        found = found.unionByName(compared.where(F.col("start").isNotNull()))
        members = beside.select("g", F.col("b").alias("node"), "l", "r", "open")
    shape = [F.col("start").alias("start_word"), F.col("end").alias("end_word"), F.col("a").alias("rep_id"), F.col("a_start").alias("rep_start"),
             F.col("a_end").alias("rep_end"), "similarity"]
    others = found.select(F.col("b").alias(id_col), *shape)
    reps = found.select("a", "a_start", "a_end").distinct().select(
        F.col("a").alias(id_col), F.col("a_start").alias("start_word"), F.col("a_end").alias("end_word"), F.col("a").alias("rep_id"),
        F.col("a_start").alias("rep_start"), F.col("a_end").alias("rep_end"), F.lit(1.0).alias("similarity"))
    out = stored(others.unionByName(reps).distinct())
    for table in held:
        discard(table)
    return out
