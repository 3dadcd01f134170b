"""Near-duplicate documents: DartMinHash signatures, banded candidates, exact verification, classes.

A document is a weighted set of word shingles; the weight is how often it holds the shingle. Each shingle owns a strip of the plane weight x time,
in which darts fall at hashed places, the same in every document. A dart counts where its weight is
below the shingle's weight in the document. Each dart also belongs to a hashed coordinate; the
earliest dart of a coordinate is its signature value. Two documents agree there with the probability
of their weighted Jaccard similarity. Only darts of the early times are thrown, enough to fill the
coordinates, so the work is the number of shingles plus the number of darts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm.durable import discard, stored
from millrace.llm.words import SHINGLE, WordHashes, jaccard, mix, shingle_hashes, words

SIMILARITY = 0.8
#: Members of a bucket in a block.
BLOCK = 192
#: Blocks of a bucket in a group; a task compares the blocks of two groups.
BESIDE = 64
#: Shingles whose darts are thrown together.
TOGETHER = 2**16
#: Up to this many documents whose texts are needed, their ids are broadcast to pick the texts before the shuffle.
FEW = 500_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SALT = np.uint64(0xD1B54A32D192ED03)


def _times(number: int, constant: np.uint64) -> np.uint64:
    """The product modulo 2^64."""
    return np.uint64(number * int(constant) % 2**64)


@dataclass(frozen=True)
class DartSettings:
    """``bands`` of ``rows`` coordinates. At similarity 0.8, bands of 4 miss a pair with a chance
    of 0.59 to the power of the bands: 24 bands, 3 in a million."""

    bands: int = 24
    rows: int = 4
    shingle: int = SHINGLE

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows


def _darts(strips: np.ndarray, limit: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(times, identities, places of their strips) of the darts up to each strip's time ``limit``.

    The gaps between a strip's darts are exponential, drawn from hashes of the strip and the
    dart's number, so that any limit sees the same darts.
    """
    times, names, owners = [], [], []
    now, draw, place = np.zeros(len(strips)), 0, np.arange(len(strips))
    while len(strips):
        draw += 1
        name = mix(strips + _times(draw, _STEP))
        now = now - np.log(_uniform(name)) / rate
        live = now <= limit
        strips, now, place, limit = strips[live], now[live], place[live], limit[live]
        times.append(now)
        names.append(name[live])
        owners.append(place)
    return np.concatenate(times), np.concatenate(names), np.concatenate(owners)


def _uniform(hashes: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1, never 0, of 64-bit hashes."""
    return (hashes >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


def _boxes(weights: np.ndarray) -> Iterator[tuple[int, float, float, np.ndarray]]:
    """(number, bottom, height, places of the elements that reach into it): [0, 1), [1, 2), [2, 4), ..."""
    number, low, height = 0, 0.0, 1.0
    while (inside := np.flatnonzero(weights > low)).size:
        yield number, low, height, inside
        number, low, height = number + 1, low + height, height if number == 0 else 2 * height


def signatures(elements: list[np.ndarray], weights: list[np.ndarray], settings: DartSettings) -> np.ndarray:
    """The earliest dart of every coordinate, one row for each weighted set. ``elements`` are different
    hashes, at least one in a set; ``weights`` are positive.

    The darts of all sets are thrown together, each set's up to the time by which they likely fill its
    coordinates; a set with a coordinate left throws again up to twice that time.
    """
    k, n = settings.coordinates, len(elements)
    out, limit, left = np.zeros((n, k), np.uint64), np.array([(log(k) + 4) / float(w.sum()) for w in weights]), np.arange(n)
    while len(left):
        owner = np.repeat(left, [len(elements[i]) for i in left])
        base, weight = mix(np.concatenate([elements[i] for i in left])), np.concatenate([weights[i] for i in left])
        parts = []
        for number, low, height, inside in _boxes(weight):
            times, names, strip = _darts(mix(base[inside] + _times(number, _SALT)), limit[owner[inside]], k * height)
            place = inside[strip]
            reach = weight[place]
            if reach.min(initial=np.inf) < low + height:  # else the regions fill the box
                below = low + height * _uniform(mix(names ^ _SALT)) < reach
                times, names, place = times[below], names[below], place[below]
            parts.append((times, names, owner[place]))
        times, names, row = (np.concatenate(x) for x in zip(*parts))
        slot = row * k + (mix(names + _SALT) % np.uint64(k)).astype(np.int64)
        filled = np.zeros((n, k), bool)
        filled.flat[slot] = True
        latest_first = np.argsort(-times, kind="stable")
        out.flat[slot[latest_first]] = names[latest_first]  # the earliest is written last
        left = left[~filled[left].all(axis=1)]
        limit = limit * 2
    return out


def signature(elements: np.ndarray, weights: np.ndarray, settings: DartSettings) -> np.ndarray:
    """The signature of one weighted set."""
    return signatures([elements], [weights], settings)[0]


def band_keys(sig: np.ndarray, settings: DartSettings) -> np.ndarray:
    """One key for each band of the signature, different between bands."""
    rows = sig.reshape(settings.bands, settings.rows)
    keys = np.arange(1, settings.bands + 1, dtype=np.uint64) * _SALT
    for i in range(settings.rows):
        keys = mix(keys * _STEP + rows[:, i])
    return keys.view(np.int64)


def shingle_bag(text: str | None, hashes: WordHashes, n: int) -> np.ndarray:
    """Sorted hashes of a text's shingles, each occurrence of one being a value of its own, so that the
    Jaccard similarity of two bags is the weighted one of the shingles' counts."""
    found = np.sort(shingle_hashes(hashes.of(words(text)), n))
    if not len(found):
        return found
    place = np.arange(len(found))
    first = np.maximum.accumulate(np.where(np.concatenate(([True], found[1:] != found[:-1])), place, 0))
    return np.unique(found ^ mix((place - first).astype(np.uint64) * _STEP))  # the first occurrence is the shingle's own hash


def _signatures(settings: DartSettings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ids, bands, prints, held, size = [], [], [], [], 0

            def throw() -> None:
                for sig in signatures([e for e, _ in held], [c for _, c in held], settings) if held else ():
                    bands.append(band_keys(sig, settings))
                    prints.append(sig.astype(np.uint16).tobytes())
                held.clear()

            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = shingle_hashes(hashes.of(words(text.as_py())), settings.shingle)
                if len(found):
                    elements, counts = np.unique(found, return_counts=True)
                    ids.append(key)
                    held.append((elements, counts.astype(np.float64)))
                    size += len(elements)
                    if size > TOGETHER:
                        throw()
                        size = 0
            throw()
            flat = np.concatenate(bands) if bands else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * settings.bands, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists, pa.array(prints, pa.binary())], names=["node", "bands", "sig"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float, n: int) -> DataFrame:
    """Those pairs (a, b) whose texts' weighted shingles have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, kept = WordHashes(), None, None
        for batch in batches:
            a, b, a_text, b_text = batch.columns
            good = []
            for i, key in enumerate(a.to_pylist()):
                if key != last:  # rows come sorted by a
                    last, kept = key, None
                if kept is None or kept[0] != a_text[i].as_py():
                    kept = (a_text[i].as_py(), shingle_bag(a_text[i].as_py(), hashes, n))
                good.append(jaccard(kept[1], shingle_bag(b_text[i].as_py(), hashes, n)) >= similarity - 1e-12)
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return (
        pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b")
        .join(texts.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a")
        .select("a", "b", "a_text", "b_text").mapInArrow(run, "a long, b long").distinct()
    )


def _least_agreement(similarity: float, k: int) -> int:
    """The number of ``k`` coordinates below which signatures of that similarity agree once in ten
    million times at most, by the binomial distribution."""
    chance, total = (1 - similarity) ** k, 0.0
    for n in range(k):
        total += chance
        if total > 1e-7:
            return n
        chance *= (k - n) / (n + 1) * similarity / (1 - similarity) if similarity < 1 else 0.0
    return k


def _across(rows: DataFrame, signed: DataFrame, texts: DataFrame, similarity: float, settings: DartSettings) -> DataFrame:
    """(a, b) pairs of nodes that join classes in the buckets of ``rows`` (band, pos, node, m, label).

    A class of more than ``BLOCK`` members in a bucket is a team of its own, the smaller ones are one
    team together; teams are dealt into blocks of about ``BLOCK``. Blocks of different teams meet, and
    those of the small classes meet each other. A large class never meets itself, so that the blocks
    of a bucket that one class fills are as many as its members, not their square. A team's
    blocks are dealt in groups of ``BESIDE``, and each pair of groups that meet is a task's: no task gets a
    bucket's pairs together, and a block is sent once for each group that it meets.
    Shingles are compared by 32 bits of their hashes, and what comes near the similarity is handed on to
    be verified.
    """

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [np.unique(shingle_bag(t.as_py(), hashes, settings.shingle).astype(np.uint32)).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    nodes = rows.select("node").distinct()
    profiles = texts.join(nodes, "node", "left_semi").select("node", "text").mapInArrow(profile, "node long, shingles binary")
    counted = rows.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"))
    classes = counted.withColumn("team", F.when(F.col("n") > BLOCK, F.col("label").cast("string")).otherwise(""))
    teams = stored(classes.groupBy("band", "team").agg(F.sum("n").alias("size")))
    teamed = rows.join(classes.drop("n"), ["band", "label"]).join(teams, ["band", "team"])
    full = teamed.join(profiles, "node").join(signed.select("node", F.transform("bands", lambda x: F.pmod(x, F.lit(2**31)).cast("int")).alias("keys"), "sig"), "node")
    dealt_by = F.when(F.col("team") == "", F.col("label")).otherwise(F.col("node"))  # a small class stays together
    block = F.pmod(F.xxhash64(dealt_by), F.ceil(F.col("size") / F.lit(BLOCK))).cast("int")
    blocks = stored_blocks = stored(full.select(
        "band", "pos", "team", block.alias("block"), F.struct("node", "label", "sig", "keys", "shingles").alias("member")).groupBy(
        "band", "pos", "team", "block").agg(F.collect_list("member").alias("members")))
    group = F.floor(F.col("block") / F.lit(BESIDE)).cast("int")
    blocks = blocks.withColumn("group", group)
    groups = teams.select("band", "team", F.explode(F.sequence(F.lit(0), F.floor((F.ceil(F.col("size") / F.lit(BLOCK)) - 1) / F.lit(BESIDE)).cast("int"))).alias("group"))
    tiles = groups.join(groups.select("band", F.col("team").alias("team_b"), F.col("group").alias("group_b")), "band").where(
        "team < team_b OR team = '' AND team_b = '' AND group <= group_b")
    left = blocks.join(tiles, ["band", "team", "group"])
    right = blocks.select("band", F.col("team").alias("team_b"), F.col("group").alias("group_b"), F.col("block").alias("block_b"), F.col("members").alias("others")).join(
        tiles, ["band", "team_b", "group_b"])
    cross = left.join(right, ["band", "team", "group", "team_b", "group_b"]).where("team <> team_b OR block < block_b").select("pos", "members", "others")
    own = blocks.where("team = ''").select("pos", "members", F.lit(None).cast(blocks.schema["members"].dataType).alias("others"))
    least = _least_agreement(similarity, settings.coordinates)

    def read(values: pa.Array) -> tuple:
        nodes, labels, sigs, sets = (values.field(i).to_pylist() for i in (0, 1, 2, 4))
        keys = values.field(3).flatten().to_numpy().reshape(len(nodes), settings.bands)
        return np.array(nodes), np.array(labels), np.stack([np.frombuffer(x, np.uint16) for x in sigs]), keys, [np.frombuffer(x, np.uint32) for x in sets]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, pos in enumerate(batch.column(0).to_pylist()):
                left = read(batch.column(1)[i].values)
                right = left if not batch.column(2)[i].is_valid else read(batch.column(2)[i].values)
                found += links_between(left, right, pos, similarity, least, settings)
            yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in found], pa.int64()), pa.array([max(x) for x in found], pa.int64())], names=["a", "b"])

    out = stored(own.unionByName(cross).mapInArrow(compare, "a long, b long").distinct())
    discard(teams)
    discard(stored_blocks)
    return out


def links_between(left: tuple, right: tuple, pos: int, similarity: float, least: int, settings: DartSettings) -> list[tuple[int, int]]:
    """Pairs of members of two blocks that join their classes: for each pair of classes the first that
    surely has the similarity, and all that are within the error of the short hashes.

    A block is (nodes, labels, 16-bit signatures, 31 bits of the band keys, sorted shingle bags). Classes joined here
    count as one from then on. ``pos`` is the bucket's band; pairs that share an earlier one, by their
    keys, are left to it.
    """
    nodes_a, labels_a, sig_a, keys_a, sets_a = left
    nodes_b, labels_b, sig_b, keys_b, sets_b = right
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    out = []
    for i in range(len(nodes_a)):
        equal = sig_b == sig_a[i]
        agree = equal.sum(axis=1)
        near = np.flatnonzero((agree >= least) & (labels_b != labels_a[i]))
        near = near[(keys_b[near] == keys_a[i]).argmax(axis=1) == pos]
        for j in near[np.argsort(-agree[near], kind="stable")].tolist():
            a, b = int(nodes_a[i]), int(nodes_b[j])
            one, two = find(int(labels_a[i])), find(int(labels_b[j]))
            pair = (a, b) if a < b else (b, a)
            if one == two:
                continue
            x, y = sets_a[i], sets_b[j]
            if min(len(x), len(y)) < (similarity - 0.01) * max(len(x), len(y)):
                continue
            same = jaccard(x, y)
            if same >= similarity - 0.005:
                out.append(pair)
                if same >= similarity + 0.005:
                    root[max(one, two)] = min(one, two)
    return out


def near_duplicate_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
    settings: DartSettings = DartSettings(),
) -> DataFrame:
    """One row per document: id, text_id, class_id, keep.

    ``text_id`` is the smallest id with exactly the same text, ``class_id`` the smallest id that is
    reached over links: pairs of texts whose word shingles, weighted by their counts, have a Jaccard
    similarity of ``similarity`` or more. ``keep`` marks the class's first document.

    Candidates share a band of their DartMinHash signatures. In a bucket, all members are first
    compared with its most central one. Members of a bucket that still holds several classes are
    then compared across these, in blocks: a task gets two blocks and hands on the links that it
    finds, not the pairs. A pair is looked at if its signatures agree in as many
    coordinates as they would at this similarity but for one time in ten million; then, in the first
    band that the two share, its shingles are compared. No bucket and no member has a cap.

    Null and empty texts are alone in their class; texts without words, and texts equal in their
    words only, are handled as any other (a text of under five words is one shingle, one without
    words equals only its exact copies). Rows of a null id take the class of an equal text that
    has an id, else null. Rows of one id are one document. Other columns are not read.
    """
    rows = stored(docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.when(F.octet_length(text_col) > 0, F.unhex(F.md5(F.col(text_col).cast("binary")))).alias("text_key")))
    firsts = rows.where(F.col("text_key").isNotNull()).groupBy("text_key").agg(F.min("id").alias("node"))
    nodes = firsts.where(F.col("node").isNotNull()).select("node").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    signed = stored(texts.mapInArrow(_signatures(settings), "node long, bands array<long>, sig binary").join(nodes, "node"))
    members = signed.select("node", F.posexplode("bands").alias("pos", "band")).distinct()

    sizes = members.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1)
    shared = stored(members.join(sizes, "band").select("band", "pos", "node", "m"))
    # who meets many others is likely the text that they were copied from
    met = shared.groupBy("node").agg(F.sum("m").alias("met"))
    placed = shared.join(met, "node").select("band", "node", F.struct((-F.col("met")).alias("x"), F.col("node").alias("head")).alias("rank"))
    heads = placed.groupBy("band").agg(F.min("rank").alias("rank")).select("band", F.col("rank.head").alias("head"))
    pairs = shared.join(heads, "band").where(F.col("node") != F.col("head")).select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    named = shared.select("node").distinct()
    few = named.limit(FEW + 1).count() <= FEW
    wanted = stored(texts.join(F.broadcast(named) if few else named, "node", "left_semi"))
    links = stored(_verified(pairs, wanted, similarity, settings.shingle))
    labels = components(links)
    held = [rows, signed, shared, wanted, links, labels]

    rows_of = shared.join(labels, "node", "left").select("band", "pos", "node", "m", F.coalesce("label", "node").alias("label"))
    # a bucket of two was its head and the other
    mixed = rows_of.where("m > 2").groupBy("band").agg(F.min("label").alias("c0"), F.max("label").alias("c1")).where("c0 < c1").select("band")
    mixed_rows = stored(rows_of.join(mixed, "band"))
    held.append(mixed_rows)
    if not mixed_rows.isEmpty():
        more = _across(mixed_rows, signed, wanted, similarity, settings)
        links = stored(links.unionByName(_verified(more, wanted, similarity, settings.shingle)))
        labels = components(links)
        held += [more, links, labels]

    classes = firsts.join(labels, "node", "left").select("text_key", "node", F.coalesce("label", "node").alias("label"))
    out = stored(rows.join(classes, "text_key", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("node", "id").alias("text_id"),
        F.coalesce("label", "id").alias("class_id"),
        F.coalesce(F.coalesce("label", "id") == F.col("id"), F.lit(False)).alias("keep"),
    ))
    for table in held:
        discard(table)
    return out


def keep_first_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each class, with its own columns. Rows without an id stay as they are.

    Rows of one id are one document: those of different texts all stay, and of those of one text the
    first by their other columns.
    """
    kept = near_duplicate_classes(docs, id_col, text_col, **options).where("keep").select(F.col(id_col)).distinct()
    others = [F.col(c) for c, kind in docs.dtypes if c not in (id_col, text_col) and "map<" not in kind]
    same = Window.partitionBy(id_col, F.sha2(F.col(text_col).cast("binary"), 256)).orderBy(*(others or [F.lit(0)]))
    first = docs.join(kept, id_col, "left_semi").select("*", F.row_number().over(same).alias("near_dups_again"))
    return first.where("near_dups_again = 1").select(docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
