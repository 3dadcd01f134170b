"""A gated recurrent language model in numpy: its cell, a class-factored softmax, training and scoring.

Vocabulary ids: 0 a word outside the vocabulary, 1 the end of a text (also what stands before its
first word), 2 and more the words by falling count. The classes of the softmax are those two alone
and ``words_per_class`` words each; a word's probability is its class's times its own in that class.

Texts lie one behind the other in lanes, and all lanes step together through windows of ``steps``
tokens. The state goes on from window to window, so a text is scored as a whole whatever its length;
gradients end at a window's edge.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heapreplace

import numpy as np

OTHER, END, FIRST = 0, 1, 2


@dataclass(frozen=True)
class Shape:
    """``hidden`` units; ``classes`` of ``words_per_class`` words beside the two single ones."""

    hidden: int = 16
    classes: int = 16
    words_per_class: int = 64

    @property
    def words(self) -> int:
        return self.classes * self.words_per_class

    def parts(self) -> dict[str, tuple[int, ...]]:
        h, c, w = self.hidden, self.classes, self.words_per_class
        return {"inputs": (FIRST + c * w, 3 * h), "state": (h, 3 * h), "to_class": (h, 2 + c), "class_bias": (2 + c,),
                "to_word": (c, h, w), "word_bias": (c, w)}


class Net:
    """The parameters as one flat vector with named views."""

    def __init__(self, shape: Shape, flat: np.ndarray):
        self.shape, self.flat, at = shape, flat, 0
        for name, size in shape.parts().items():
            n = int(np.prod(size))
            setattr(self, name, flat[at : at + n].reshape(size))
            at += n

    @staticmethod
    def size(shape: Shape) -> int:
        return sum(int(np.prod(s)) for s in shape.parts().values())

    @staticmethod
    def start(shape: Shape, words: np.ndarray, other: int, ends: int, seed: int = 1) -> Net:
        """Random weights; the biases give each word the share of its count (one is added to each)."""
        net = Net(shape, np.zeros(Net.size(shape), np.float32))
        draw = np.random.default_rng(seed)
        net.inputs[:] = draw.normal(0, 0.3, net.inputs.shape)
        net.state[:] = draw.normal(0, 0.5 / np.sqrt(shape.hidden), net.state.shape)
        net.to_class[:] = draw.normal(0, 0.05, net.to_class.shape)
        net.to_word[:] = draw.normal(0, 0.05, net.to_word.shape)
        counts = np.zeros(shape.words)
        counts[: len(words)] = words
        each = counts.reshape(shape.classes, shape.words_per_class) + 1
        net.word_bias[:] = np.log(each / each.sum(axis=1, keepdims=True))
        net.class_bias[:] = np.log(np.concatenate(([other + 1, ends + 1], each.sum(axis=1))))
        net.class_bias[:] -= np.log(np.exp(net.class_bias).sum())
        return net

    def classes_of(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < FIRST, ids, 2 + (ids - FIRST) // self.shape.words_per_class)


def _softmax(logits: np.ndarray, at: np.ndarray, every: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(log-probability of the entry ``at`` of each column, all probabilities, if ``every``); changes ``logits``."""
    logits -= logits.max(axis=0)
    own = logits[at, np.arange(len(at))]
    np.exp(logits, out=logits)
    total = logits.sum(axis=0)
    if every:
        logits /= total
    return own - np.log(total), logits


def _by_unit(steps: np.ndarray) -> np.ndarray:
    """(steps, units, lanes) as (units, steps * lanes)."""
    return np.ascontiguousarray(steps.transpose(1, 0, 2)).reshape(steps.shape[1], -1)


def _states(net: Net, before: np.ndarray, state: np.ndarray, keep: list | None) -> np.ndarray:
    """States (steps, hidden, lanes) after each step of a window of (steps, lanes) tokens, from
    ``state`` (hidden, lanes); ``keep`` gets what gradients need, in the same layout.

    A gate is half of 1 + tanh(half its sum). The halves are in the weights, so ``gates`` are twice the
    gates here, and what the second one multiplies is half of it; all of this is exact."""
    h, (steps, lanes) = net.shape.hidden, before.shape
    half = np.float32(0.5)
    inputs = np.array(net.inputs.T, order="C")
    inputs[: 2 * h] *= half
    pushed = np.ascontiguousarray(np.take(inputs, before, axis=1).transpose(1, 0, 2))
    weights = np.ascontiguousarray(net.state.T) * half
    kept = steps if keep is not None else 1
    starts, gates_of, new_of, moved_of = (np.empty((kept, n, lanes), np.float32) for n in (h, 2 * h, h, 3 * h))
    out = np.empty((steps, h, lanes), np.float32)
    fresh = before == END
    resets = fresh.any(axis=1)
    for t in range(steps):
        at = t if kept > 1 else 0
        gates, new, moved, after = gates_of[at], new_of[at], moved_of[at], out[t]
        if resets[t]:
            state = np.where(fresh[t], np.float32(0), state)
        if keep is not None:
            starts[at] = state
        np.matmul(weights, state, out=moved)
        np.add(moved[: 2 * h], pushed[t, : 2 * h], out=gates)
        np.tanh(gates, out=gates)
        gates += np.float32(1)
        np.multiply(gates[h:], moved[2 * h :], out=new)
        new += pushed[t, 2 * h :]
        np.tanh(new, out=new)
        np.subtract(state, new, out=after)
        after *= gates[:h]
        after *= half
        after += new
        state = after
    if keep is not None:
        keep += [starts, gates_of[:, :h], gates_of[:, h:], new_of, moved_of[:, 2 * h :]]
    return out


def _word_groups(net: Net, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, slice]]]:
    """Places of the targets that are words of the vocabulary, by class; their positions in the class; and
    each class's slice of both."""
    places = np.flatnonzero(targets >= FIRST)
    groups, within = np.divmod(targets[places] - FIRST, net.shape.words_per_class)
    order = np.argsort(groups, kind="stable")
    edges = np.searchsorted(groups[order], np.arange(net.shape.classes + 1)).tolist()
    return places[order], within[order], [(c, slice(a, b)) for c, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]


def window_log_probs(net: Net, before: np.ndarray, targets: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(natural log-probability of every target, state after the window)."""
    states = _states(net, before, state, None)
    flat, goal = _by_unit(states), targets.reshape(-1)
    found, _ = _softmax(net.to_class.T @ flat + net.class_bias[:, None], net.classes_of(goal), False)
    places, within, groups = _word_groups(net, goal)
    own, logs = np.take(flat, places, axis=1), np.empty(len(places), np.float32)
    for c, some in groups:
        logs[some] = _softmax(net.to_word[c].T @ own[:, some] + net.word_bias[c][:, None], within[some], False)[0]
    found[places] += logs
    return found.reshape(targets.shape), states[-1]


def window_gradient(net: Net, before: np.ndarray, targets: np.ndarray, real: np.ndarray, state: np.ndarray) -> tuple[float, Net, np.ndarray]:
    """(loss, its gradient, state after the window) of the ``real`` targets, truncated at the window."""
    h, (steps, lanes), kept = net.shape.hidden, before.shape, []
    states = _states(net, before, state, kept)
    flat, goal, weight = _by_unit(states), targets.reshape(-1), real.reshape(-1).astype(np.float32)
    whole = bool(real.all())
    grad = Net(net.shape, np.zeros_like(net.flat))
    classes = net.classes_of(goal)
    logs, wrong = _softmax(net.to_class.T @ flat + net.class_bias[:, None], classes)
    loss = -float(logs @ weight)
    wrong[classes, np.arange(len(goal))] -= 1
    if not whole:
        wrong *= weight
    grad.to_class[:], grad.class_bias[:] = flat @ wrong.T, wrong.sum(axis=1)
    back = net.to_class @ wrong
    places, within, groups = _word_groups(net, goal)
    owns, weights, backs = np.take(flat, places, axis=1), weight[places], np.empty((h, len(places)), np.float32)
    for c, some in groups:
        own, goals = owns[:, some], within[some]
        logs, wrong = _softmax(net.to_word[c].T @ own + net.word_bias[c][:, None], goals)
        loss -= float(logs @ weights[some])
        wrong[goals, np.arange(len(goals))] -= 1
        if not whole:
            wrong *= weights[some]
        grad.to_word[c], grad.word_bias[c] = own @ wrong.T, wrong.sum(axis=1)
        backs[:, some] = net.to_word[c] @ wrong
    back[:, places] += backs
    back = np.ascontiguousarray(back.reshape(h, steps, lanes).transpose(1, 0, 2))
    starts, fall, reset, new, held = kept  # of both gates twice, and of what the second multiplies half
    fall = fall * np.float32(0.5)
    # what one unit of a step's state brings to the step's three inner sums
    left = 1 - fall
    per_new = new * new
    np.subtract(1, per_new, out=per_new)
    per_new *= left
    per_moved = np.empty((steps, 3 * h, lanes), np.float32)
    per_fall, per_reset, per_held = (per_moved[:, i * h : (i + 1) * h] for i in range(3))
    np.subtract(starts, new, out=per_fall)
    per_fall *= fall
    per_fall *= left
    np.multiply(reset, np.float32(0.5), out=per_held)
    per_held *= per_new
    np.multiply(per_held, held, out=per_reset)
    per_reset *= 2 - reset
    moved = np.empty_like(per_moved)
    fresh = before == END
    resets = fresh.any(axis=1)
    carried, kept_state = np.zeros((h, lanes), np.float32), np.empty((h, lanes), np.float32)
    for t in range(steps - 1, -1, -1):
        total = back[t]
        total += carried
        np.multiply(per_moved[t].reshape(3, h, lanes), total, out=moved[t].reshape(3, h, lanes))
        np.matmul(net.state, moved[t], out=carried)
        carried += np.multiply(total, fall[t], out=kept_state)
        if resets[t]:
            carried *= ~fresh[t]
    pulled = _by_unit(moved)
    grad.state[:] = _by_unit(starts) @ pulled.T
    per_new *= back
    pulled[2 * h :] = _by_unit(per_new)
    ids = before.reshape(-1).astype(np.min_scalar_type(len(net.inputs)))  # few bits are sorted faster
    order = np.argsort(ids, kind="stable")
    seen, first = np.unique(ids[order], return_index=True)
    grad.inputs[seen] = np.add.reduceat(np.take(pulled, order, axis=1), first, axis=1).T
    return loss, grad, states[-1]


class Lanes:
    """Texts (arrays of ids, each ending in END) dealt to lanes of even load, longest first."""

    def __init__(self, texts: list[np.ndarray], lanes: int):
        self.texts = texts
        order = sorted(range(len(texts)), key=lambda i: (-len(texts[i]), i))
        load = [(0, i) for i in range(min(lanes, len(texts)))]
        heapify(load)
        held: list[list[int]] = [[] for _ in load]
        for i in order:
            size, lane = load[0]
            held[lane].append(i)
            heapreplace(load, (size + len(texts[i]), lane))
        lanes_of = sorted(held, key=lambda own: -sum(len(texts[i]) for i in own))
        self.order = [i for own in lanes_of for i in own]
        self.tokens = [np.concatenate([texts[i] for i in own]) for own in lanes_of]
        self.loads = np.array([len(x) for x in self.tokens])

    def windows(self, steps: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first step, tokens before, targets, which targets are real) of the lanes that still go on."""
        for at in range(0, int(self.loads.max(initial=0)), steps):
            lanes = int((self.loads > at).sum())
            most = min(steps, int(self.loads[0]) - at)
            run = np.full((most + 1, lanes), END, np.int32)
            for lane in range(lanes):
                piece = self.tokens[lane][max(0, at - 1) : at + most]
                lead = 0 if at else 1
                run[lead : lead + len(piece), lane] = piece
            real = np.arange(at, at + most)[:, None] < self.loads[:lanes]
            yield at, run[:-1], run[1:], real

    def gather(self, logs: list[np.ndarray]) -> np.ndarray:
        """Sums by text of what each lane holds by token."""
        out = np.zeros(len(self.texts))
        sizes = [len(self.texts[i]) for i in self.order]
        out[self.order] = np.add.reduceat(np.concatenate(logs), np.cumsum([0, *sizes[:-1]]))
        return out


def log_probs(net: Net, texts: list[np.ndarray], lanes: int = 256, steps: int = 64) -> np.ndarray:
    """Natural log-probability of each text, in double precision sums."""
    if not texts:
        return np.zeros(0)
    dealt = Lanes(texts, lanes)
    logs = [np.zeros(n) for n in dealt.loads]
    state = np.zeros((net.shape.hidden, len(logs)), np.float32)
    for at, before, targets, _ in dealt.windows(steps):
        found, state = window_log_probs(net, before, targets, state[:, : before.shape[1]])
        for lane in range(before.shape[1]):
            own = logs[lane][at : at + len(found)]
            own[:] = found[: len(own), lane]
    return dealt.gather(logs)


#: Tokens learned until windows grow, and their (lanes, steps): small steps first, cheaper windows later.
GROWTH = ((0, (64, 32)), (500_000, (128, 64)))
#: Tokens after which a text's learning goes on in another lane, so that no lane is left alone with it.
PIECE = 1024


class Trainer:
    """Truncated backpropagation with one adaptive step (Adagrad) a window."""

    def __init__(self, net: Net, rate: float = 0.3, growth: tuple = GROWTH):
        self.net = Net(net.shape, net.flat.copy())
        self.rate, self.growth = np.float32(rate), growth
        self.squares = np.full_like(net.flat, 0.1)
        self.seen = 0

    def learn(self, texts: list[np.ndarray]) -> float:
        """One pass over some texts; the loss in natural logarithms."""
        if not texts:
            return 0.0
        texts = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
        lanes, steps = [size for least, size in self.growth if self.seen >= least][-1]
        dealt, total = Lanes(texts, lanes), 0.0
        state = np.zeros((self.net.shape.hidden, len(dealt.loads)), np.float32)
        for _, before, targets, real in dealt.windows(steps):
            loss, grad, state = window_gradient(self.net, before, targets, real, state[:, : before.shape[1]])
            total += loss
            self.seen += int(real.sum())
            # by the size of a full window: the last lanes, alone with long texts, move little
            grad.flat *= np.float32(1 / np.sqrt(lanes * steps))
            self.squares += grad.flat * grad.flat
            self.net.flat -= self.rate * grad.flat / np.sqrt(self.squares)
        return total
