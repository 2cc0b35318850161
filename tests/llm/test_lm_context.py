"""How much of a text the language model sees when it tells a subword."""

from __future__ import annotations

import numpy as np

from perkloom.llm import attention, lm_scoring


def test_every_subword_is_told_with_half_a_window_of_context():
    tokens = np.arange(1_000)
    told = {}
    for x, y, keep in lm_scoring._windows(tokens, -1):
        for row, after, kept in zip(x, y, keep, strict=True):
            for at in np.flatnonzero(kept):
                told[int(after[at])] = {int(t) for t in row[: at + 2]} - {-1}
    assert sorted(told) == tokens.tolist()
    for token, seen in told.items():
        assert len(seen) >= min(token, attention.WINDOW // 2)


def test_window_and_training_are_whole():
    assert attention.WINDOW >= 32 and lm_scoring.STEPS >= 4_000


def test_told_rows_are_those_of_whole_windows():
    random = np.random.default_rng(3)
    size = attention.KNOWN + 1
    network = attention.Attention(random.integers(1, 100, size), random.random((size, size)))
    x = random.integers(0, size, (50, attention.WINDOW + 1))
    keep = random.random((50, attention.WINDOW)) < 0.7
    keep[::2, : attention.OVERLAP] = False
    whole = network._hidden(x)[-1][keep]
    assert np.abs(network._told(x, keep) - whole).max() < 1e-5
    assert network._told(x[:0], keep[:0]).shape == (0, attention.HIDDEN)
