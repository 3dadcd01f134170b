"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A letter n-gram is the product of its letters'
vectors, each rotated by its place in the n-gram; a document is the sum of its n-grams; a language
is the sum of its documents. The prediction is the language of largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.memory import lean, sliced

UNDETERMINED = "und"


@dataclass(frozen=True)
class ProfileSettings:
    """``sample_per_language`` bounds, in expectation, the labelled rows read for one language."""

    dimensions: int = 1024
    n: int = 3
    seed: int = 20240613
    sample_per_language: int = 3000
    remembered: int = 20_000
    batch: int = 64


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngram_keys(text: str | None, n: int) -> np.ndarray:
    """A 64-bit key of every letter n-gram, words being bounded by one space; none without letters."""
    if not text:
        return np.empty(0, np.uint64)
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    is_letter = _letters()[points]
    if not is_letter.any():
        return np.empty(0, np.uint64)
    points = np.where(is_letter, points, np.uint32(32))
    points = np.concatenate(([np.uint32(32)], points, [np.uint32(32)])).astype(np.uint64)
    points = points[np.concatenate(([True], (points[1:] != 32) | (points[:-1] != 32)))]
    count = max(1, len(points) - n + 1)
    keys = np.zeros(count, np.uint64)
    for i in range(n):
        part = points[i : i + count]
        keys[: len(part)] |= part << np.uint64(21 * (n - 1 - i))
    return keys


class Encoder:
    """Vectors of n-grams and documents. At most ``remembered`` n-gram vectors are held."""

    def __init__(self, settings: ProfileSettings):
        self.s, self.letters, self.rows = settings, {}, {}
        self.table = np.empty((settings.remembered, settings.dimensions), np.int8)

    def letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            if len(self.letters) > 5000:
                self.letters.clear()
            draw = np.random.default_rng([self.s.seed, point]).integers(0, 2, self.s.dimensions, np.int8)
            self.letters[point] = draw * np.int8(2) - np.int8(1)
        return self.letters[point]

    def bound(self, key: int) -> np.ndarray:
        n, out = self.s.n, np.ones(self.s.dimensions, np.int8)
        for i in range(n):
            out = out * np.roll(self.letter(key >> 21 * (n - 1 - i) & 0x1FFFFF), n - 1 - i)
        return out

    def vectors(self, keys: np.ndarray) -> np.ndarray:
        known = self.rows
        if len(known) + len(keys) > self.s.remembered:
            known.clear()
        if len(keys) > self.s.remembered:
            return np.stack([self.bound(k) for k in keys.tolist()])
        at = []
        for k in keys.tolist():
            row = known.get(k)
            if row is None:
                row = known[k] = len(known)
                self.table[row] = self.bound(k)
            at.append(row)
        return self.table[at]

    def documents(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Unit vector of each text, and whether it has letters at all."""
        out = np.zeros((len(texts), self.s.dimensions), np.float32)
        counted = [np.unique(ngram_keys(t, self.s.n), return_counts=True) for t in texts]
        for lo in range(0, len(texts), self.s.batch):
            part = counted[lo : lo + self.s.batch]
            every = np.unique(np.concatenate([k for k, _ in part]))
            for start in range(0, len(every), self.s.remembered):
                keys = every[start : start + self.s.remembered]
                weights = np.zeros((len(part), len(keys)), np.float32)
                for row, (k, c) in enumerate(part):
                    a, b = np.searchsorted(k, keys[0]), np.searchsorted(k, keys[-1], "right")
                    weights[row, np.searchsorted(keys, k[a:b])] = c[a:b]
                out[lo : lo + len(part)] += weights @ self.vectors(keys).astype(np.float32)
        has = np.fromiter((len(k) > 0 for k, _ in counted), bool, len(counted))
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1), has


@dataclass(frozen=True)
class LanguageModel:
    """Unit prototypes of the learned languages, in the order of their names."""

    languages: tuple[str, ...]
    prototypes: np.ndarray
    settings: ProfileSettings

    def predict(self, texts: list[str | None], encoder: Encoder) -> tuple[list[str], np.ndarray]:
        vectors, has = encoder.documents(texts)
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        cosine = vectors.astype(np.float64) @ self.prototypes.T
        best = cosine.argmax(axis=1)
        score = np.where(has, np.clip(cosine[np.arange(len(texts)), best], 0.0, 1.0), 0.0)
        return [self.languages[b] if h else UNDETERMINED for b, h in zip(best, has)], score


def fit_languages(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    settings: ProfileSettings = ProfileSettings(),
) -> LanguageModel:
    """Learn a prototype of every non-null language from a bounded sample of the labelled rows.

    A language of more rows than ``sample_per_language`` is thinned by a hash of the row's id and
    text, so rows of one id or none are drawn apart; others are read whole. Rows of null text are left out. What reaches the driver is one
    vector for each language. Ties in the prediction go to the language first by name.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col)).count().collect()}
    if not counts:
        return LanguageModel((), np.zeros((0, settings.dimensions)), settings)
    shares = F.create_map(
        *[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, settings.sample_per_language / n))]
    )
    draw = F.pmod(F.xxhash64(F.lit(settings.seed), F.col(id_col).cast("string"), F.col(text_col)), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw < F.element_at(shares, F.col(lang_col))).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    )

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sums = Encoder(settings), {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            vectors, _ = encoder.documents(texts)
            for lang in sorted(set(langs)):
                mine = vectors[[x == lang for x in langs]].sum(axis=0, dtype=np.float64)
                sums[lang] = sums.get(lang, 0) + mine
        for lang, total in sums.items():
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(total)),
                "place": pa.array(range(len(total)), pa.int32()),
                # whole millionths, so that the sum doesn't depend on the order of the tasks
                "part": pa.array(np.rint(total * 1e6).astype(np.int64)),
            })

    sums = (
        sample.mapInArrow(bundle, "lang string, place int, part long")
        .groupBy("lang", "place").agg(F.sum("part").alias("part")).collect()
    )
    languages = tuple(sorted({r["lang"] for r in sums}))
    prototypes = np.zeros((len(languages), settings.dimensions))
    for r in sums:
        prototypes[languages.index(r["lang"]), r["place"]] = r["part"]
    norms = np.linalg.norm(prototypes, axis=1, keepdims=True)
    return LanguageModel(languages, prototypes / np.where(norms > 0, norms, 1), settings)


def predict_language(text: Column, model: LanguageModel) -> Column:
    """Struct (lang, score) of each text: ``und`` and 0 if it is null or has no letter."""
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(model.settings)
        for batch in sliced(batches, 256):
            langs, score = model.predict(batch.to_pylist(), encoder)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(score)], fields=list(kind))

    return F.arrow_udf(lean(run), "struct<lang:string,score:double>").asNondeterministic()(text)


def held_out(id_col: Column) -> Column:
    """Whether the row is kept out of learning: CRC-32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2, F.lit(False))


def identify_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    settings: ProfileSettings = ProfileSettings(),
) -> DataFrame:
    """Learn from the rows not held out, then predict every row.

    Returns ``id_col``, held_out, lang_pred, score. Null, empty and letterless texts give ``und``
    and 0, as does every text when nothing could be learned. Repeated rows are each predicted. A
    null id counts as the empty string. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = fit_languages(rows.where(~held_out(F.col("key"))), "key", "text", "lang", settings)
    return (
        rows.select("key", held_out(F.col("key")).alias("held_out"), predict_language(F.col("text"), model).alias("found"))
        .select(F.col("key").alias(id_col), "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
    )
