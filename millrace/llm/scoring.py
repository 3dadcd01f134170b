"""Scoring documents by a gated recurrent language model and by corpus counts.

Four passes, all on Spark: the tokens of all training documents are counted; every task trains the
model on all its training documents, and the tasks' models are averaged; every document is scored,
with the frequent tokens' counts at hand; the other tokens meet their counts in one join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.durable import discard, stored
from millrace.llm.recurrent import END, FIRST, OTHER, Net, Shape, Trainer, log_probs

#: Frequent tokens whose counts every task holds: at most so many, of at most LONGEST bytes (11 MB).
FREQUENT = 262_144
#: Longer tokens are known by a digest, marked so that it is no token of that length.
LONGEST = 32
#: Texts that a task holds at a time: at least one, and no more bytes together beyond the first.
CHUNK = 4_000_000
#: Different tokens that a task counts before it hands them on.
COUNTED = 400_000
#: Models that one task, or the driver, adds up.
ADDED = 32

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text: runs of ``[^\\x20\\x09-\\x0D]`` after A-Z are lower-cased."""
    return text.translate(_LOWER).split() if text else []


def key(token: bytes) -> bytes:
    """What a token is known by: itself, or a digest if it is long. The end of a text is ``b""``."""
    return token if len(token) <= LONGEST else bytes(17) + xxhash.xxh3_128_digest(token)


def held_out(doc_id: Column) -> Column:
    """Whether the CRC-32 of the id as text leaves 2 when divided by 7; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _texts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[list[bytes | None]]:
    for batch in batches:
        yield batch.column(column).cast(pa.binary()).to_pylist()


def count_tokens(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, n) over all documents, the end of each included; counted in the tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            short: Counter[bytes] = Counter()
            for token, n in found.items():
                short[key(token)] += n
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(short), pa.binary()), pa.array(list(short.values()), pa.int64())], names=["token", "n"])

        for texts in _texts(batches, "text"):
            for text in texts:
                found.update(tokens(text))
                found[b""] += 1
                if len(found) > COUNTED:
                    yield out()
        if found:
            yield out()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


@dataclass
class Counts:
    """What every task knows of the corpus: the frequent tokens by falling count, and the totals."""

    frequent: list[bytes]
    counts: np.ndarray
    tokens: int
    types: int
    ends: int
    shape: Shape

    @staticmethod
    def of(counted: DataFrame, shape: Shape, most: int = FREQUENT) -> Counts:
        """Frequent are all tokens above the least count that leaves no more than ``most`` of them;
        it is found from a table of counts by their logarithm, so the driver gets no more than those."""
        word = F.col("token") != b""
        band = F.floor(F.log2(F.col("n")) * 16).cast("int")
        bands = counted.where(word & (F.length("token") <= LONGEST)).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("types")).orderBy(F.desc("band")).collect()
        least, held = None, 0
        for row in bands:
            held += row.types
            if held > most:
                break
            least = row.band
        some = counted.where(word & (F.length("token") <= LONGEST) & (band >= (2**30 if least is None else least))).toArrow()
        rows = sorted(zip(some["token"].to_pylist(), some["n"].to_pylist()), key=lambda x: (-x[1], x[0]))
        total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(~word, F.col("n"))), F.lit(0))).first()
        return Counts([t for t, _ in rows], np.array([n for _, n in rows], np.int64), total[0], total[1], total[2], shape)

    @property
    def vocabulary(self) -> int:
        return min(self.shape.words, len(self.frequent))

    @property
    def others(self) -> int:
        """Training tokens outside the model's vocabulary."""
        return self.tokens - self.ends - int(self.counts[: self.vocabulary].sum())

    def base_of(self, n):
        """A token's base probability before the logarithm, by its count."""
        return (n + 1) / float(self.tokens + self.types + 1)

    def share_of(self, n):
        """The probability of a word outside the vocabulary among those, by its count: one is added
        to each count, and one more type stands for words never seen."""
        types = self.types - (self.ends > 0) - self.vocabulary
        return (n + 1) / float(self.others + types + 1)

    def start(self) -> Net:
        return Net.start(self.shape, self.counts[: self.vocabulary], self.others, self.ends)


class Reader:
    """Texts as places among the frequent tokens (-1: none) and as the model's ids."""

    def __init__(self, counts: Counts, most: int | None = None):
        self.places = dict(zip(counts.frequent[:most], range(len(counts.frequent))))
        self.vocabulary = counts.vocabulary

    def places_of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.places.get, found, repeat(-1)), np.int32, len(found))

    def ids_of(self, places: np.ndarray) -> np.ndarray:
        ids = np.full(len(places) + 1, END, np.int32)
        ids[:-1] = np.where((places >= 0) & (places < self.vocabulary), places + FIRST, OTHER)
        return ids


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches with about CHUNK bytes of text, and those texts."""
    for batch in batches:
        texts, at, size = batch.column("text").cast(pa.binary()).to_pylist(), 0, 0
        for i, text in enumerate(texts):
            if i > at and size + len(text or b"") > CHUNK:
                yield batch.slice(at, i - at), texts[at:i]
                at, size = i, 0
            size += len(text or b"")
        if at < len(texts):
            yield batch.slice(at), texts[at:]


def train(docs: DataFrame, counts: Counts, text_col: str = "text", rate: float = 0.3) -> Net:
    """The model after one pass over all documents.

    Every task starts from the same weights, whose biases are the corpus's shares, and learns from
    all its documents; the models are averaged by the number of their tokens. They are added up
    ADDED at a time in tasks until no more than that are left, so the driver never holds more.
    """
    start = counts.start()

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, trainer = Reader(counts, counts.vocabulary), Trainer(start, rate)
        for _, texts in _chunks(batches):
            trainer.learn([reader.ids_of(reader.places_of(tokens(t))) for t in texts])
        if trainer.seen:
            yield _models([(trainer.net.flat.astype(np.float64) * trainer.seen).tobytes()], [trainer.seen])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = None, 0
        for batch in batches:
            for body, n in zip(batch.column("body"), batch.column("seen").to_pylist()):
                own = np.frombuffer(body.as_buffer(), np.float64)
                total, seen = own.copy() if total is None else total + own, seen + n
        if total is not None:
            yield _models([total.tobytes()], [seen])

    models = stored(docs.select(F.col(text_col).alias("text")).mapInArrow(learn, "body binary, seen long"))
    left = models.count()
    while left > ADDED:
        left, before = ceil(left / ADDED), models
        models = stored(before.repartition(left).mapInArrow(add, "body binary, seen long"))
        discard(before)
    rows = models.collect()
    discard(models)
    seen = sum(r.seen for r in rows)
    if not seen:
        return start
    return Net(counts.shape, (sum(np.frombuffer(r.body, np.float64) for r in rows) / seen).astype(np.float32))


def _models(bodies: list[bytes], seen: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bodies, pa.binary()), pa.array(seen, pa.int64())], names=["body", "seen"])


_SCORED = "row_no long, doc_id {id}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rest array<struct<token:binary,n:int>>"


def _score_rows(docs: DataFrame, counts: Counts, net: Net) -> DataFrame:
    """Every row of (doc_id, held_out, text) with its score so far, and the tokens that aren't frequent."""
    schema = _SCORED.format(id=docs.schema["doc_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, row_no = Reader(counts), TaskContext.get().partitionId() << 40
        base, share = np.log10(counts.base_of(counts.counts)), np.log10(counts.share_of(counts.counts))
        share[: counts.vocabulary] = 0.0
        end = np.log10(counts.base_of(counts.ends))
        for part, texts in _chunks(batches):
            ids, rows, rest, times, edges = [], [], [], [], [0]
            for text in texts:
                found = tokens(text)
                places = reader.places_of(found)
                head = places[places >= 0]
                seldom = Counter([key(found[i]) for i in np.flatnonzero(places < 0).tolist()])
                rest.extend(seldom)
                times.extend(seldom.values())
                edges.append(len(rest))
                ids.append(reader.ids_of(places))
                rows.append((len(found) + 1, len(head) + (counts.ends > 0), float(base[head].sum()) + end, float(share[head].sum())))
            score = log_probs(net, ids) / np.log(10) + np.array([r[3] for r in rows])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row_no, row_no + len(rows)), pa.int64()), part.column("doc_id"), part.column("held_out"),
                 *(pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)), pa.array([r[2] for r in rows], pa.float64()), pa.array(score), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays([pa.array(rest, pa.binary()), pa.array(times, pa.int32())], ["token", "n"]))],
                names=[part.split()[0] for part in schema.split(", ")])
            row_no += len(rows)

    return docs.mapInArrow(run, schema)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shape: Shape = Shape()) -> DataFrame:
    """Score every document by a model that learns from those that aren't held out.

    Returns ``id_col``, held_out, n_tokens (words and one end), n_known (tokens seen in training),
    train_tokens, base_score and score, both log10 probabilities: base_score by the counts of single
    tokens with one added, score by the recurrent model. A word outside the model's vocabulary has
    the probability of any such word, times its own share among them by the corpus's counts.

    A null text is empty: one token, its end. Repeated rows are scored each. A null id counts as an
    empty one and isn't held out. If nothing is there to learn from, train_tokens is 0 and every
    probability is 1 for the only, unseen type. An empty table gives an empty result; other columns
    are not read. What is learned covers all training rows; which rows a task learns from together
    follows the input's partitions, so scores move a little with these, base scores don't.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    learned = rows.where(~F.col("held_out"))
    counted = stored(count_tokens(learned))
    counts = Counts.of(counted, shape)
    net = train(learned, counts)
    scored = stored(_score_rows(rows, counts, net))
    n = F.coalesce(F.col("seen"), F.lit(0)).cast("double")
    rest = (
        scored.select("row_no", F.explode("rest").alias("r")).select("row_no", "r.token", F.col("r.n").alias("times"))
        .join(counted.withColumnRenamed("n", "seen"), "token", "left")
        .groupBy("row_no").agg(
            F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more_known"),
            F.sum(F.col("times") * F.log10(counts.base_of(n))).alias("more_base"),
            F.sum(F.col("times") * F.log10(counts.share_of(n))).alias("more_score"))
    )
    out = stored(scored.drop("rest").join(rest, "row_no", "left").select(
        F.col("doc_id").alias(id_col), "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score")))
    discard(scored)
    discard(counted)
    return out
