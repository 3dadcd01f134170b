"""What a token costs in op12: no Python call for a word outside the vocabulary, steps in one piece of memory."""

import sys

import numpy as np
import pytest

from millrace.llm import scoring
from millrace.llm.recurrent import END, FIRST, Net, Shape, window_gradient, window_log_probs

SMALL = Shape(hidden=3, classes=2, words_per_class=3)


def test_unknown_words_cost_no_python_calls():
    reader = scoring.Reader(scoring.Counts([b"a", b"b"], np.array([5, 3]), 20, 9, 1, SMALL))
    found, calls = [b"a", b"b", *(b"%d" % i for i in range(1000))], []
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event == "call" else None)
    try:
        places = reader.places_of(found)
    finally:
        sys.setprofile(None)
    assert places.tolist() == [0, 1, *[-1] * 1000] and len(calls) < 10


@pytest.mark.parametrize("steps", [1, 2, 9])
def test_steps_lie_in_one_piece_and_both_passes_agree(steps):
    net = Net.start(SMALL, np.arange(SMALL.words, 0, -1), 4, 3)
    draw = np.random.default_rng(steps)
    net.flat[:] += draw.normal(0, 0.3, net.flat.shape).astype(np.float32)
    run = draw.choice([0, END, *range(FIRST, FIRST + SMALL.words)], (steps + 1, 5)).astype(np.int32)
    state, real = draw.normal(0, 0.5, (3, 5)).astype(np.float32), draw.random((steps, 5)) < 0.7
    logs, after = window_log_probs(net, run[:-1], run[1:], state)
    loss, grad, same = window_gradient(net, run[:-1], run[1:], real, state)
    assert after.flags.c_contiguous and same.flags.c_contiguous
    assert np.array_equal(after, same) and np.isclose(loss, -logs[real].sum(), atol=1e-4)
    for i in draw.choice(len(net.flat), 20, replace=False):
        at = []
        for by in (1e-2, -1e-2):
            moved = Net(SMALL, net.flat.copy())
            moved.flat[i] += by
            at.append(window_gradient(moved, run[:-1], run[1:], real, state)[0])
        assert abs((at[0] - at[1]) / 2e-2 - grad.flat[i]) < 2e-2 * max(1, abs(grad.flat[i]))
