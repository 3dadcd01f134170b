"""The recurrent model against loops over scalars, its gradient against differences, and corpus counts by hand."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import recurrent, scoring
from millrace.llm.recurrent import END, FIRST, Lanes, Net, Shape, Trainer, log_probs, window_gradient

DATA = "/root/testdata/sf0.001"
SMALL = Shape(hidden=3, classes=2, words_per_class=3)


def net(shape=SMALL, seed=2):
    out = Net.start(shape, np.arange(shape.words, 0, -1), 4, 3, seed)
    out.flat[:] += np.random.default_rng(seed).normal(0, 0.3, out.flat.shape).astype(np.float32)
    return out


def by_hand(n, ids):
    """Log-probability of a text, one unit and one word at a time, and the last distribution over all ids."""
    h, state, total = n.shape.hidden, np.zeros(n.shape.hidden), 0.0
    sigma = lambda x: 1 / (1 + np.exp(-x))
    soft = lambda x: np.exp(x) / np.exp(x).sum()
    for before, target in zip([END, *ids[:-1]], ids):
        moved, pushed = state @ n.state.astype(float), n.inputs[before].astype(float)
        fall, reset = sigma(pushed[:h] + moved[:h]), sigma(pushed[h : 2 * h] + moved[h : 2 * h])
        new = np.tanh(pushed[2 * h :] + reset * moved[2 * h :])
        state = (1 - fall) * new + fall * state
        classes = soft(state @ n.to_class.astype(float) + n.class_bias)
        every = [classes[0], classes[1]]
        for c in range(n.shape.classes):
            every += (classes[2 + c] * soft(state @ n.to_word[c].astype(float) + n.word_bias[c])).tolist()
        total += math.log(every[target])
    return total, every


def texts(seed, sizes):
    draw = np.random.default_rng(seed)
    return [np.array([*draw.choice([0, *range(FIRST, FIRST + SMALL.words)], n), END], np.int32) for n in sizes]


def test_probabilities_against_loops():
    n, some = net(), texts(1, [0, 1, 5, 40, 3, 7, 2])
    want = [by_hand(n, t)[0] for t in some]
    for lanes, steps in ((1, 64), (3, 4), (256, 1), (2, 7)):
        assert np.allclose(log_probs(n, some, lanes, steps), want, atol=1e-4)
    assert abs(sum(by_hand(n, some[3])[1]) - 1) < 1e-9
    assert len(log_probs(n, [])) == 0


def test_gradient_against_differences():
    n, dealt = net(), Lanes(texts(4, [6, 3, 9, 2]), 2)
    _, before, targets, real = next(dealt.windows(8))
    state = np.random.default_rng(5).normal(0, 0.5, (3, before.shape[1])).astype(np.float32)
    loss, grad, _ = window_gradient(n, before, targets, real, state)
    draw = np.random.default_rng(6)
    for i in draw.choice(len(n.flat), 60, replace=False):
        at = []
        for step in (1e-2, -1e-2):
            moved = Net(n.shape, n.flat.copy())
            moved.flat[i] += step
            at.append(window_gradient(moved, before, targets, real, state)[0])
        assert abs((at[0] - at[1]) / 2e-2 - grad.flat[i]) < 2e-2 * max(1, abs(grad.flat[i]))
    assert loss > 0


def test_start_is_the_share_of_counts():
    n = Net.start(SMALL, np.array([50, 30, 10]), 7, 3)
    n.to_class[:], n.to_word[:] = 0, 0
    _, every = by_hand(n, np.array([END], np.int32))
    each = np.array([50, 30, 10, 0, 0, 0]) + 1
    assert np.allclose(every, np.array([8, 4, *each]) / (12 + each.sum()), atol=1e-6)


def test_training_learns_what_follows_what():
    """A text that repeats three words: after training, each is nearly sure from the one before."""
    shape = Shape(hidden=8, classes=2, words_per_class=2)
    text = np.array([2, 3, 4] * 30 + [END], np.int32)
    start = Net.start(shape, np.array([30, 30, 30]), 0, 1)
    trainer = Trainer(start, 0.2, ((0, (8, 16)),))
    for _ in range(40):
        trainer.learn([text] * 8)
    assert log_probs(trainer.net, [text])[0] > 0.2 * log_probs(start, [text])[0]
    assert np.isfinite(trainer.net.flat).all() and trainer.seen == 40 * 8 * len(text)


def spelled(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def brute(rows):
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows}
    counts = Counter(w for i, t in rows if not held[i] for w in spelled(t))
    n, v = sum(counts.values()), len(counts)
    return [(i, held[i], len(spelled(t)), sum(counts[w] > 0 for w in spelled(t)), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in spelled(t))) for i, t in rows]


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "A a À à x\x1cy"), (4, "A a À à x\x1cy"), (None, "no id"), (9, "w" * 500 + " é" * 30), (10, "w" * 500), (11, "word " * 30_000), (12, "é b \x0b c")]


@pytest.mark.parametrize("frequent", [262_144, 3])
def test_base_scores_against_counting(spark, monkeypatch, frequent):
    """Also where few tokens are held by the tasks, and where a join gives the other counts."""
    monkeypatch.setattr(scoring.Counts.of, "__defaults__", (frequent,))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + ODD
    df = spark.createDataFrame([(i, t, 1, b"x") for i, t in rows], "doc_id long, text string, n int, token binary").repartition(3)
    got = scoring.score_documents(df).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    for r, want in zip(sorted(got, key=key), sorted(brute(rows), key=key), strict=True):
        assert tuple(r)[:5] == want[:5] and math.isclose(r.base_score, want[5], rel_tol=1e-9, abs_tol=1e-9) and math.isfinite(r.score) and r.score <= 0


def test_the_model_beats_the_counts_on_held_out_texts(spark):
    rows = scoring.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in rows) > 0.97 * sum(r.base_score for r in rows)


def test_shares_of_words_outside_the_vocabulary_sum_to_one(spark):
    df = spark.createDataFrame([("b a a a c c d e",), ("a b f",)], "text string")
    counts = scoring.Counts.of(scoring.count_tokens(df).cache(), SMALL, 2)
    assert counts.frequent in ([b"a"], [b"a", b"b"], [b"a", b"c"]) or len(counts.frequent) <= 2
    every = {r.token: r.n for r in scoring.count_tokens(df).collect()}
    other = [n for t, n in every.items() if t and t not in counts.frequent[: counts.vocabulary]]
    assert math.isclose(sum(counts.share_of(n) for n in [*other, 0]), 1.0)
    assert math.isclose(sum(counts.base_of(n) for n in [*every.values(), 0]), 1.0)
    assert (counts.tokens, counts.types, counts.ends) == (13, 7, 2)


def test_models_are_added_in_levels(spark, monkeypatch):
    df = spark.read.parquet(f"{DATA}/documents.parquet").select("text").repartition(6)
    df = spark.createDataFrame(df.collect(), "text string").repartition(6).sortWithinPartitions("text").cache()
    counts = scoring.Counts.of(scoring.count_tokens(df), SMALL)
    flat = scoring.train(df, counts).flat
    monkeypatch.setattr(scoring, "ADDED", 2)
    assert np.allclose(flat, scoring.train(df, counts).flat, atol=1e-5) and not np.allclose(flat, counts.start().flat)


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    schema = "doc_id long, text string"
    r = scoring.score_documents(spark.createDataFrame([(held, "some words")], schema)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)
    assert scoring.score_documents(spark.createDataFrame([], schema)).count() == 0


def test_long_tokens_are_known_by_a_digest():
    assert scoring.key(b"x" * 32) == b"x" * 32 and len(scoring.key(b"x" * 33)) == 33 and scoring.key(b"x" * 33) != scoring.key(b"x" * 34)
    assert scoring.tokens("A\x0bÀ b".encode()) == [b"a", "À".encode(), b"b"] and scoring.tokens(None) == scoring.tokens(b"") == []
    assert recurrent.OTHER == 0
