"""The tagger's windows: those left out can't hold a span that would be kept."""

import numpy as np

from millrace.llm import pii, tagger


class Loud:
    """Tags so many characters that spans run on over many windows."""

    def decode(self, ids):
        return np.where(ids % 7 == 3, 9, 10 * (ids % 11 > 0)).astype(np.int8)


def everywhere(text):
    return list(range(0, len(text), pii.STEP))


def test_windows_left_out_change_nothing(monkeypatch):
    rng = np.random.default_rng(8)
    pieces = ["no hint of it ", "plain words, and more.  ", "correct-horse-battery ", "größtenteils ", "x1 ", "a@b.cc ", ".,;:!? ", "..hidden ", "k" * 150 + " ", "x-" * 90 + " ", "漢字" * 40, " "]
    texts = ["".join(rng.choice(pieces, int(n))) for n in rng.integers(1, 60, 60)] + ["", None, "   ", "short", "." * 300]
    for model in (Loud(), tagger.trained()):
        got = pii.find_pii(texts, model)
        with monkeypatch.context() as all_of_them:
            all_of_them.setattr(pii, "window_starts", everywhere)
            assert got == pii.find_pii(texts, model)
    assert any(every for _, every in pii.find_pii(texts, Loud()))


def test_a_secret_without_a_digit_is_looked_at():
    """Before, only windows that hold a digit, an at sign or an equals sign were."""

    class Words:
        def decode(self, ids):
            return np.where(ids > 1, 10, 0).astype(np.int8)

    text = "the pass phrase is " + "of it " * 20 + "correct-horse-battery"
    assert ("secret", text.index("correct"), len(text)) in pii.find_pii([text], Words())[0][1]


def test_fast_decoding_takes_the_best_path():
    model, ids = tagger.trained(), np.random.default_rng(3).integers(0, tagger.N_CHARS, (40, tagger.WINDOW))
    emitted, _ = model.emissions(ids)
    moves, rows = model.w["A"] + tagger.allowed(), np.arange(40)
    score, back = model.w["s"] + emitted[0], []
    for t in range(1, tagger.WINDOW):
        ways = score[:, :, None] + moves
        back.append(ways.argmax(axis=1))
        score = ways.max(axis=1) + emitted[t]
    best = [score.argmax(axis=1)]
    for step in reversed(back):
        best.append(step[rows, best[-1]])
    assert (model.decode(ids) == np.array(best[::-1]).T).all()


def test_choosing_windows_is_linear():
    for text in ("a" * 400_000, "." * 400_000, "a." * 200_000, "a- " * 100_000):
        pii.window_starts(text)
