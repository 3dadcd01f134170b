"""Word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie. Where greedy longest match can't go on from a node, its failure link names
the node where matching resumes after the pieces that are then certain, and only the number of
those pieces is kept: counts need no pieces. Each character follows one edge and links pop pieces
that it paid for, so a word takes time linear in its length.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.pieces import MARK, MODEL_FILE, NORMAL, PieceModel, load_model

#: Pre-tokens: runs of word characters, and single other characters that aren't white space.
PRETOKEN = re.compile(r"\w+|[^\w\s]")
REMEMBERED = 300_000
LONG_WORD = 200


class LongestMatch:
    """Counts greedy longest-match pieces of words.

    ``first`` are pieces that start a word, ``later`` those that go on with it. A word that can't
    be cut whole into pieces is one unknown token.
    """

    def __init__(self, first: set[str], later: set[str]):
        self.edges: list[dict[str, int]] = [{}, {}]  # 0: start of a word, 1: start of a later piece
        self.is_piece, self.starts_word = [False, False], [True, False]
        for root, vocabulary in ((0, first), (1, later)):
            for piece in vocabulary:
                node = root
                for c in piece:
                    if c not in self.edges[node]:
                        self.edges[node][c] = len(self.edges)
                        self.edges.append({})
                        self.is_piece.append(False)
                    node = self.edges[node][c]
                if node > 1:
                    self.is_piece[node] = True
        self._link()

    def _link(self) -> None:
        """Failure link of each node and the pieces popped on the way; -1 where matching must end."""
        n = len(self.edges)
        self.fail, self.popped = [-1] * n, [0] * n
        queue = deque([0, 1])
        while queue:
            node = queue.popleft()
            for c, child in self.edges[node].items():
                queue.append(child)
                if self.is_piece[child]:
                    self.fail[child], self.popped[child] = 1, 1
                    continue
                at, count = self.fail[node], self.popped[node]
                while at >= 0 and c not in self.edges[at]:
                    count, at = count + self.popped[at], self.fail[at]
                if at >= 0:
                    self.fail[child], self.popped[child] = self.edges[at][c], count
        # a child's link is at a lesser depth than the child, so that it is known before it's used

    def count(self, word: str) -> int:
        """Number of pieces, or 0 if the word can't be cut whole."""
        edges, fail, popped = self.edges, self.fail, self.popped
        node = total = 0
        for c in word:
            while c not in edges[node]:
                total, node = total + popped[node], fail[node]
                if node < 0:
                    return 0
            node = edges[node][c]
        while node != 1:
            total, node = total + popped[node], fail[node]
            if node < 0:
                return 0
        return total


def word_vocabulary(model: PieceModel) -> tuple[set[str], set[str]]:
    """Word-piece vocabularies in a SentencePiece model: pieces with the marker start words."""
    pieces = [p for p, _, kind in model.pieces if kind == NORMAL]
    first = {p[1:] for p in pieces if p.startswith(MARK) and len(p) > 1 and MARK not in p[1:]}
    return first, {p for p in pieces if MARK not in p}


class TokenCounter:
    """Counts the tokens of texts; made once in each task."""

    def __init__(self, first: set[str], later: set[str]):
        self.automaton = LongestMatch(first, later)
        self.known: dict[str, int] = {}

    def count(self, text: str | None) -> tuple[int, int, int]:
        """(tokens, words, unknown words) of a text; an unknown word is one token."""
        if not text:
            return 0, 0, 0
        known, automaton = self.known, self.automaton
        tokens = words = unknown = 0
        for word in PRETOKEN.findall(text):
            n = known.get(word)
            if n is None:
                n = automaton.count(word)
                if len(word) <= LONG_WORD:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = n
            words += 1
            tokens += n or 1
            unknown += not n
        return tokens, words, unknown


def token_counts(text: Column, first: set[str], later: set[str]) -> Column:
    """Struct (n_tokens, n_words, n_unknown) of each text."""
    names = ("n_tokens", "n_words", "n_unknown")

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = TokenCounter(first, later)
        for batch in batches:
            found = [counter.count(t.as_py()) for t in batch]
            yield pa.StructArray.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=names)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "struct<n_tokens:bigint,n_words:bigint,n_unknown:bigint>").asNondeterministic()(text)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_file: str = MODEL_FILE) -> DataFrame:
    """One row per document: id, n_tokens, n_words, n_unknown, for the vocabulary in a
    SentencePiece model file. Null and empty texts count 0. Repeated rows are each counted. Other
    columns are not read."""
    first, later = word_vocabulary(load_model(vocabulary_file))
    rows = docs.select(F.col(id_col).alias("key"), token_counts(F.col(text_col), first, later).alias("n"))
    return rows.select(F.col("key").alias(id_col), "n.*")
