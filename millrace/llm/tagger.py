"""A character-level bidirectional LSTM with a CRF on top, trained and run in numpy."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np

#: The kinds with a fixed pattern, and those that only the tagger knows: keys, tokens and passwords.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: The fitted weights; ``python -m millrace.llm.tagger`` fits and writes them anew.
WEIGHTS = Path(__file__).with_name("tagger_weights.npz")
#: 0 is outside; kind k begins with 1 + 2k and goes on with 2 + 2k.
N_TAGS = 1 + 2 * len(KINDS)
N_CHARS = 100
WINDOW = 96
FORBIDDEN = -1e4


def char_ids(text: str) -> np.ndarray:
    """Class of each code point: printable ASCII one by one, the rest by kind; 0 is padding."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out = np.where((points >= 32) & (points < 127), points - 31, 99).astype(np.int64)
    for i in np.flatnonzero(out == 99).tolist():
        c = text[i]
        out[i] = 96 if c.isspace() else 97 if c.isalpha() else 98 if c.isdigit() else 99
    return out


def allowed() -> np.ndarray:
    """Transition mask: a kind goes on only after it began."""
    mask = np.zeros((N_TAGS, N_TAGS))
    for j in range(2, N_TAGS, 2):
        mask[:, j] = FORBIDDEN
        mask[j - 1, j] = mask[j, j] = 0
    return mask


def tags_of(n: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    """Tag of each of ``n`` characters."""
    out = np.zeros(n, np.int64)
    for kind, a, b in spans:
        out[a:b] = 2 + 2 * KINDS.index(kind)
        out[a] -= 1
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


@dataclass
class Tagger:
    """Weights by name; all float32."""

    w: dict[str, np.ndarray]
    hidden: int

    @staticmethod
    def fresh(hidden: int, embed: int, rng: np.random.Generator) -> Tagger:
        def draw(*shape):
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        w = {"E": draw(N_CHARS, embed) * 3, "O": draw(2 * hidden, N_TAGS), "bo": np.zeros(N_TAGS, np.float32),
             "A": np.zeros((N_TAGS, N_TAGS), np.float32), "s": np.zeros(N_TAGS, np.float32)}
        for side in "fb":
            w |= {f"X{side}": draw(embed, 4 * hidden), f"H{side}": draw(hidden, 4 * hidden),
                  f"b{side}": np.repeat(np.float32([0, 1, 0, 0]), hidden)}
        return Tagger(w, hidden)

    def _run(self, x: np.ndarray, side: str, keep: bool):
        """States over time of one direction; x is (T, B, embed). With ``keep`` what backward needs."""
        h, (T, B, _) = self.hidden, x.shape
        pre = x @ self.w[f"X{side}"] + self.w[f"b{side}"]
        state, cell = np.zeros((B, h), np.float32), np.zeros((B, h), np.float32)
        out, tape, U = np.empty((T, B, h), np.float32), [], self.w[f"H{side}"]
        for t in range(T) if side == "f" else range(T - 1, -1, -1):
            z = pre[t] + state @ U
            i, f, o, g = _sigmoid(z[:, :h]), _sigmoid(z[:, h : 2 * h]), _sigmoid(z[:, 2 * h : 3 * h]), np.tanh(z[:, 3 * h :])
            before, was = cell, state
            cell = f * cell + i * g
            squashed = np.tanh(cell)
            state = out[t] = o * squashed
            if keep:
                tape.append((t, i, f, o, g, before, was, squashed))
        return out, tape

    def emissions(self, ids: np.ndarray, keep: bool = False):
        """(T, B, tags) scores for ids (B, T)."""
        x = self.w["E"][ids.T]
        forward, tape_f = self._run(x, "f", keep)
        backward, tape_b = self._run(x, "b", keep)
        both = np.concatenate([forward, backward], axis=2)
        return both @ self.w["O"] + self.w["bo"], (x, both, tape_f, tape_b)

    def _passed(self, ids: np.ndarray, side: str) -> np.ndarray:
        """States (T, hidden, B) of one direction as ``_run`` has them, with the rows side by side."""
        h, (B, T) = self.hidden, ids.shape
        pushed = self.w["E"] @ self.w[f"X{side}"] + self.w[f"b{side}"]
        weights = np.ascontiguousarray(self.w[f"H{side}"].T)
        state, cell, out, columns = np.zeros((h, B), np.float32), np.zeros((h, B), np.float32), np.empty((T, h, B), np.float32), np.ascontiguousarray(ids.T)
        z, one = np.empty((4 * h, B), np.float32), np.empty((h, B), np.float32)
        for t in range(T) if side == "f" else range(T - 1, -1, -1):
            np.matmul(weights, state, out=z)
            z += pushed[columns[t]].T
            gates = z[: 3 * h]
            gates *= np.float32(0.5)
            np.tanh(z, out=z)
            gates += np.float32(1)
            gates *= np.float32(0.5)
            cell *= z[h : 2 * h]
            cell += np.multiply(z[:h], z[3 * h :], out=one)
            state = np.tanh(cell, out=out[t])
            state *= z[2 * h : 3 * h]
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Best tag sequence of each row, by Viterbi; the way back is looked for on the best path only."""
        A = self.w["A"] + allowed().astype(np.float32)
        O, h = np.ascontiguousarray(self.w["O"].T), self.hidden
        score = np.matmul(O[:, :h], self._passed(ids, "f"))
        score += np.matmul(O[:, h:], self._passed(ids, "b"))
        score += self.w["bo"][:, None]
        T, K, B = score.shape
        score[0] += self.w["s"][:, None]
        ways = np.empty((K, K, B), np.float32)
        for t in range(1, T):
            score[t] += np.add(score[t - 1][:, None], A[:, :, None], out=ways).max(axis=0)
        tags = np.empty((T, B), np.int8)
        tags[-1] = score[-1].argmax(axis=0)
        for t in range(T - 1, 0, -1):
            tags[t - 1] = (score[t - 1] + A[:, tags[t]]).argmax(axis=0)
        return tags.T

    def loss_and_gradient(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tag sequences, and its gradient."""
        em, (x, both, tape_f, tape_b) = self.emissions(ids, keep=True)
        T, B, K = em.shape
        A = self.w["A"] + allowed()
        y, rows = tags.T, np.arange(B)
        alpha, beta = np.empty((T, B, K)), np.zeros((T, B, K))
        alpha[0] = self.w["s"] + em[0]
        for t in range(1, T):
            alpha[t] = em[t] + _lse(alpha[t - 1][:, :, None] + A, 1)
        for t in range(T - 2, -1, -1):
            beta[t] = _lse(A + (em[t + 1] + beta[t + 1])[:, None, :], 2)
        log_z = _lse(alpha[-1], 1)
        gold = self.w["s"][y[0]] + em[np.arange(T)[:, None], rows, y].sum(axis=0) + A[y[:-1], y[1:]].sum(axis=0)
        node = np.exp(alpha + beta - log_z[:, None])
        edge = np.exp(alpha[:-1, :, :, None] + A + (em[1:] + beta[1:])[:, :, None, :] - log_z[:, None, None]).sum(axis=(0, 1))
        node[np.arange(T)[:, None], rows, y] -= 1
        np.add.at(edge, (y[:-1].ravel(), y[1:].ravel()), -1)
        d_em = (node / B).astype(np.float32)
        grad = {"A": (edge / B).astype(np.float32), "s": d_em[0].sum(axis=0), "bo": d_em.sum(axis=(0, 1)),
                "O": np.tensordot(both, d_em, axes=([0, 1], [0, 1]))}
        d_both, d_x = d_em @ self.w["O"].T, np.zeros_like(x)
        for side, tape, d_out in (("f", tape_f, d_both[:, :, : self.hidden]), ("b", tape_b, d_both[:, :, self.hidden :])):
            U, d_state, d_cell = self.w[f"H{side}"], 0, 0
            dz, dU = np.empty((T, B, 4 * self.hidden), np.float32), np.zeros_like(self.w[f"H{side}"])
            for t, i, f, o, g, before, was, squashed in reversed(tape):
                d_state = d_state + d_out[t]
                d_cell = d_cell + d_state * o * (1 - squashed**2)
                dz[t] = np.concatenate(
                    [d_cell * g * i * (1 - i), d_cell * before * f * (1 - f), d_state * squashed * o * (1 - o), d_cell * i * (1 - g**2)], axis=1)
                dU += was.T @ dz[t]
                d_state, d_cell = dz[t] @ U.T, d_cell * f
            grad |= {f"H{side}": dU, f"b{side}": dz.sum(axis=(0, 1)), f"X{side}": np.tensordot(x, dz, axes=([0, 1], [0, 1]))}
            d_x += dz @ self.w[f"X{side}"].T
        grad["E"] = np.zeros_like(self.w["E"])
        np.add.at(grad["E"], ids.T, d_x)
        return float((log_z - gold).mean()), grad


def fit(ids: np.ndarray, tags: np.ndarray, hidden: int = 20, embed: int = 12, epochs: int = 4, batch: int = 48,
        rate: float = 0.012, seed: int = 5) -> Tagger:
    """Train by Adam with a falling rate on windows (N, T) and their tags."""
    rng = np.random.default_rng(seed)
    model = Tagger.fresh(hidden, embed, rng)
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    steps, step = epochs * (len(ids) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(ids))
        for lo in range(0, len(ids) - batch + 1, batch):
            pick, step = order[lo : lo + batch], step + 1
            _, grad = model.loss_and_gradient(ids[pick], tags[pick])
            norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
            pace = rate * (1 - 0.95 * step / steps)
            for k, g in grad.items():
                g = g * np.float32(min(1.0, 5.0 / (norm + 1e-9)))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model.w[k] = (model.w[k] - pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


class Examples:
    """Invented prose with labelled personal data and with things that only look like it."""

    LETTERS = "eeeeaaaiiooutnrslhdcmpgbfvyäéñöüßçè"

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def pick(self, options):
        return options[int(self.rng.integers(len(options)))]

    def digits(self, n: int) -> str:
        return "".join(map(str, self.rng.integers(0, 10, n)))

    def word(self, letters: str = LETTERS) -> str:
        out = "".join(self.pick(letters) for _ in range(int(self.rng.integers(2, 10))))
        return self.pick((out, out, out, out.capitalize(), out.upper()))

    def ascii_word(self) -> str:
        return self.word(self.LETTERS[:25]).lower()

    def email(self) -> str:
        name = self.pick((self.ascii_word(), f"{self.ascii_word()}.{self.digits(2)}", f"{self.ascii_word()}_{self.ascii_word()}",
                          f"{self.word()}.{self.word()}", f"{self.ascii_word()}+{self.ascii_word()}"))
        host = self.pick((f"mail{self.digits(1)}.example", self.ascii_word(), f"{self.ascii_word()}-{self.ascii_word()}", self.word()))
        return f"{name}@{host}.{self.pick(('com', 'org', 'net', 'de', 'co.uk'))}"

    def ip(self) -> str:
        return ".".join(str(x) for x in self.rng.integers(0, 256, 4))

    def card(self) -> str:
        body = self.pick("3456") + self.digits(14)
        total = sum(x if i % 2 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, body)))
        number, between = body + str(-total % 10), self.pick(("", "", " ", "-", ".", "  "))
        return between.join(number[i : i + 4] for i in range(0, 16, 4))

    def phone(self) -> str:
        a, b, c = self.digits(3), self.digits(3), self.digits(4)
        return self.pick((f"+1 ({a}) {b}-{c}", f"+{self.digits(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{self.digits(2)}{a}{b}{c}"))

    def drawn(self, letters: str, least: int, most: int) -> str:
        return "".join(self.pick(letters) for _ in range(int(self.rng.integers(least, most + 1))))

    def secret(self) -> tuple[str, int, int]:
        """A secret with what leads to it, and where it lies."""
        hexed, mixed = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
        value = self.pick((self.drawn(hexed, 32, 32), self.drawn(hexed, 40, 40), self.drawn(hexed.upper(), 40, 40), self.drawn(mixed, 20, 40),
                           "AKIA" + self.drawn("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16, 16), f"{self.pick(('ghp', 'sk', 'xoxb', 'pk'))}{self.pick('_-')}{self.drawn(mixed, 24, 36)}",
                           f"{self.ascii_word()}{self.digits(3)}{self.pick('!#$%')}{self.drawn(mixed, 2, 6)}"))
        name = self.pick(("token", "secret", "password", "api_key", "key", "apikey", "access_token", "auth", "passwd", "pwd", "client_secret"))
        lead = self.pick((name, name, name.upper(), name.capitalize())) + self.pick((" = ", "=", ": ", " : ", ":", " := "))
        mark = self.pick(('"', '"', "'", ""))
        return f"{lead}{mark}{value}{mark}", len(lead) + len(mark), len(lead) + len(mark) + len(value)

    def decoy(self) -> str:
        d, hexed = self.digits, "0123456789abcdef"
        return self.pick((d(4), f"{d(1)}.{d(1)}", f"{d(1)}.{d(2)}.{d(1)}", f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}/{d(2)}/{d(4)}", f"{d(2)}:{d(2)}",
                          f"${d(3)}.{d(2)}", f"{d(3)},{d(3)}", f"commit {self.drawn(hexed, 40, 40)}", self.drawn(hexed, 32, 40), f"{self.ascii_word()} = {d(3)}",
                          f'{self.ascii_word()} = "{self.word()}"', f"{self.ascii_word()}: {self.word()}", f"http://{self.ascii_word()}.org/{d(4)}",
                          f"@{self.ascii_word()}", f"{self.ascii_word()}{d(2)}", f"{d(7)}", f"#{d(5)}", f"{d(16)}", f"{d(25)}", f"{self.ascii_word()} @ {d(2)}"))

    def text(self, least: int) -> tuple[str, list[tuple[str, int, int]]]:
        out, spans, n = [], [], 0
        while n < least:
            draw = self.rng.random()
            kind = self.pick(KINDS) if draw < 0.14 else ""
            if kind == "secret":
                piece, a, b = self.secret()
                spans.append((kind, n + a, n + b))
            else:
                piece = getattr(self, kind)() if kind else self.decoy() if draw < 0.26 else self.word()
                if kind:
                    spans.append((kind, n, n + len(piece)))
            piece += self.pick(("", "", "", "", ",", ".", "!!", "###", "%%%", "&&&", " |", ";")) + self.pick((" ", " ", " ", "\n"))
            out.append(piece)
            n += len(piece)
        return "".join(out), spans


def fit_examples(windows: int = 6000, seed: int = 5) -> Tagger:
    """A tagger fitted to invented labelled windows."""
    source, ids, tags = Examples(seed), [], []
    while len(ids) < windows:
        text, spans = source.text(WINDOW * 8)
        codes, labels = char_ids(text), tags_of(len(text), spans)
        for lo in range(0, len(text) - WINDOW + 1, WINDOW):
            ids.append(codes[lo : lo + WINDOW])
            tags.append(labels[lo : lo + WINDOW].copy())
    return fit(np.stack(ids[:windows]), np.stack(tags[:windows]), hidden=24, epochs=5, seed=seed)


@lru_cache(1)
def trained() -> Tagger:
    """The tagger whose weights lie beside this module, read once in the driver and sent with the tasks."""
    with np.load(WEIGHTS) as file:
        weights = {name: file[name] for name in file.files}
    return Tagger(weights, len(weights["Hf"]))


if __name__ == "__main__":
    np.savez_compressed(WEIGHTS, **fit_examples().w)
