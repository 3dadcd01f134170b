"""Benchmark decontamination: exact occurrences of benchmark word windows in training texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.words import WordHashes, ngram_hashes, words

WINDOW = 10
#: Benchmarks of more words than this are matched by a shuffle join instead of a broadcast. A window takes about half a
#: kilobyte in a worker, so the index stays below 100 MB.
BROADCAST_WORDS = 200_000


@dataclass(frozen=True)
class BenchmarkIndex:
    """Windows of all items by length: sorted hashes, and for each the different word windows with
    the items that hold them."""

    by_length: dict[int, tuple[np.ndarray, dict[int, list[tuple[tuple[bytes, ...], tuple[int, ...]]]]]]


def item_windows(found: list[bytes], window: int = WINDOW) -> list[tuple[bytes, ...]]:
    """The windows of an item's words: runs of ``window``, or all words if there are fewer."""
    if not found:
        return []
    n = min(window, len(found))
    return [tuple(found[i : i + n]) for i in range(len(found) - n + 1)]


def index_items(items: list[tuple[str, str | None]], window: int = WINDOW) -> BenchmarkIndex:
    """Index (item_id as text, text) pairs; items without words have no windows."""
    holders: dict[tuple[bytes, ...], set] = {}
    for item, text in items:
        for w in item_windows(words(text), window):
            holders.setdefault(w, set()).add(item)
    hashes, by_length = WordHashes(), {}
    for w in sorted(holders):
        h = int(ngram_hashes(hashes.of(list(w)), len(w))[0])
        by_length.setdefault(len(w), {}).setdefault(h, []).append((w, tuple(sorted(holders[w]))))
    return BenchmarkIndex({n: (np.array(sorted(d), np.uint64), d) for n, d in by_length.items()})


def scan(text: str | None, index: BenchmarkIndex, hashes: WordHashes) -> tuple[int, np.ndarray, list[str]]:
    """Number of words, which of them are inside an occurrence, and the items, sorted as strings."""
    found = words(text)
    hit, items = np.zeros(len(found), bool), set()
    values = hashes.of(found)
    for n, (known, windows) in index.by_length.items():
        grams = ngram_hashes(values, n)
        if not len(grams):
            continue
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        for i in np.flatnonzero(known[at] == grams).tolist():
            here = tuple(found[i : i + n])
            for candidate, holders in windows[int(grams[i])]:
                if candidate == here:  # equal hashes are only candidates
                    hit[i : i + n] = True
                    items.update(holders)
    return len(found), hit, sorted(items)


def hit_spans(hit: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of hit words, ends exclusive."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]


def scan_column(text: Column, index: BenchmarkIndex) -> Column:
    """Struct (n_words, n_hit, items, spans) of each text; spans are pairs of word numbers."""
    shared: dict = {}

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = shared.setdefault("hashes", WordHashes())
        for batch in batches:
            n_words, n_hit, items, spans = [], [], [], []
            for value in batch:
                n, hit, held = scan(value.as_py(), index, hashes)
                n_words.append(n)
                n_hit.append(int(hit.sum()))
                items.append(held)
                spans.append([list(s) for s in hit_spans(hit)] if held else [])
            yield pa.StructArray.from_arrays(
                [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())),
                 pa.array(spans, pa.list_(pa.list_(pa.int32())))],
                names=["n_words", "n_hit", "items", "spans"],
            )

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    kind = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<array<int>>>"
    return F.arrow_udf(run, kind).asNondeterministic()(text)


def _windows_of_items(items: DataFrame, window: int) -> DataFrame:
    """(gram, n_gram, item) of every window, without duplicates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams = sorted(set(item_windows(words(text), window)))
                yield pa.RecordBatch.from_pydict({
                    "gram": pa.array([b" ".join(g) for g in grams], pa.binary()),
                    "n_gram": pa.array([len(g) for g in grams], pa.int32()),
                    "item": pa.array([item] * len(grams), pa.string()),
                })

    return items.mapInArrow(run, "gram binary, n_gram int, item string")


def _by_join(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """(key, n_words, n_hit, items, spans) by joining document windows with item windows.

    For benchmarks too large to broadcast. Window lengths are few; each document window is one
    row, keyed by its words, and Spark splits the windows that are too frequent.
    """
    grams = _windows_of_items(items, window)
    lengths = sorted(r[0] for r in grams.select("n_gram").distinct().collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words(text)
                cut = [(b" ".join(found[i : i + n]), n, i) for n in lengths for i in range(len(found) - n + 1)]
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array([key] * len(cut), pa.string()),
                    "gram": pa.array([c[0] for c in cut], pa.binary()),
                    "n_gram": pa.array([c[1] for c in cut], pa.int32()),
                    "start": pa.array([c[2] for c in cut], pa.int32()),
                })

    hits = docs.select("key", "text").mapInArrow(run, "key string, gram binary, n_gram int, start int").join(
        grams, ["gram", "n_gram"]
    )
    items_of = hits.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    ends = Window.partitionBy("key").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    merged = (
        hits.select("key", "start", (F.col("start") + F.col("n_gram")).alias("stop")).distinct()
        .withColumn("reached", F.coalesce(F.max("stop").over(ends), F.lit(-1)))
        .withColumn("island", F.sum((F.col("start") > F.col("reached")).cast("int")).over(
            Window.partitionBy("key").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("key", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
        .groupBy("key").agg(
            F.sum(F.col("stop") - F.col("start")).alias("n_hit"),
            F.array_sort(F.collect_list(F.array("start", "stop"))).alias("spans"))
    )
    return merged.join(items_of, "key")


def scan_documents(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, broadcast_words: int = BROADCAST_WORDS,
    output: str = "leak",
) -> DataFrame:
    """Add ``output``: struct (n_words, n_hit, items, spans) of benchmark windows in each text.

    The windows of a benchmark of at most ``broadcast_words`` words, which is counted first, go to
    every task as a hash set; equal hashes are verified word by word. A larger benchmark is joined
    by a shuffle. Null texts have no words; repeated items are items of their own id; items
    without words have no windows; a null item_id counts as the empty string; an empty benchmark
    hits nothing. Other columns pass through, but for one named ``output``.
    """
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    if size[0] // 2 + size[1] <= broadcast_words:  # a word and its separator take two bytes at least
        index = index_items([tuple(r) for r in items.collect()], window)
        return docs.withColumn(output, scan_column(F.col(text_col), index))
    keyed = docs.withColumn("leak_row", F.sha2(F.col(text_col).cast("binary"), 256))
    texts = keyed.select(F.col("leak_row").alias("key"), F.col(text_col).alias("text")).dropDuplicates(["key"])
    found = _by_join(texts, items, window).withColumnRenamed("key", "leak_row").withColumnRenamed("items", "leak_items")
    none = index_items([], window)
    return (
        keyed.withColumn("leak_words", scan_column(F.col(text_col), none)["n_words"]).join(
            found.select("leak_row", F.col("n_hit").alias("leak_hit"), "leak_items", F.col("spans").alias("leak_spans")),
            "leak_row", "left")
        .withColumn(output, F.struct(
            F.col("leak_words").alias("n_words"), F.coalesce("leak_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("leak_items", F.array().cast("array<string>")).alias("items"),
            F.coalesce("leak_spans", F.array().cast("array<array<int>>")).alias("spans")))
        .drop("leak_row", "leak_words", "leak_hit", "leak_items", "leak_spans")
    )


def contamination_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows = docs.select(F.col(id_col).alias("key"), F.col(options.pop("text_col", "text")).alias("text"))
    leak = scan_documents(rows, benchmark, "text", **options)
    return leak.select(
        F.col("key").alias(id_col), F.col("leak.n_words").alias("n_words"), F.col("leak.n_hit").alias("n_hit"),
        F.size("leak.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("leak.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("leak.n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any benchmark window, with their own columns."""
    marked = scan_documents(docs, benchmark, output="leak_found", **options)
    return marked.where(F.col("leak_found.n_hit") == 0).drop("leak_found")
