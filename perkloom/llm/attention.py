"""A small causal self-attention model of subword sequences, in numpy.

Every subword has a query, a key, a value and two hidden rows (as the current subword and as the
one before). Attention over the subwords so far, with a learned weight for distance, is added
to the hidden rows; the next subword is told in two steps, its class and its place in the class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WINDOW = 32  # subwords read at once
OVERLAP = WINDOW // 2  # of those, read again as context of the next window
QUERY, HIDDEN = 8, 24
CLASSES = 32  # of as many members
KNOWN = CLASSES * CLASSES - 1  # frequent subwords; the last member stands for all others


class Attention:
    def __init__(self, counts: np.ndarray, pairs: np.ndarray, seed: int = 11):
        """``counts`` of the known subwords and, last, all others; ``pairs`` of neighbours."""
        random = np.random.default_rng(seed)
        size = KNOWN + 1
        self.place = _classes(counts, pairs)  # class * CLASSES + member
        normal = lambda *shape: random.normal(0, 0.1, shape).astype(np.float32)
        share = np.zeros(size)
        share[self.place] = (counts + 0.5) / (counts + 0.5).sum()
        share = share.reshape(CLASSES, CLASSES)
        self.p = {
            "query": normal(size, QUERY) * 3, "key": normal(size, QUERY) * 3, "value": normal(size, HIDDEN),
            "now": normal(size, HIDDEN) * 5, "before": normal(size, HIDDEN) * 3,
            "near": np.linspace(0, -1.5, WINDOW).astype(np.float32),
            "class": normal(HIDDEN, CLASSES), "class0": np.log(share.sum(1)).astype(np.float32),
            "member": normal(CLASSES, HIDDEN, CLASSES),
            "member0": np.log(share / share.sum(1, keepdims=True)).astype(np.float32),
        }
        self.mask = np.tril(np.ones((WINDOW, WINDOW), np.float32))
        self.distance = np.abs(np.subtract.outer(np.arange(WINDOW), np.arange(WINDOW)))

    def _hidden(self, x: np.ndarray, training: bool = False, start: int = 0):
        """x: (windows, WINDOW + 1) subwords; the first is only seen as the one before. Rows from
        ``start`` on are worked out; those before it are context."""
        p, now = self.p, x[:, 1:]
        q = np.take(p["query"], now[:, start:], axis=0)
        k, v = (np.take(p[n], now, axis=0) for n in ("key", "value"))
        near = (np.exp(p["near"])[self.distance] * self.mask)[start:]
        a = q @ k.transpose(0, 2, 1)
        np.minimum(a, 60, out=a)  # far above any weight that matters
        np.exp(a, out=a)
        a *= near
        total = a @ np.ones((WINDOW, 1), a.dtype)  # faster than a sum over a short axis
        if training:
            a /= total
            pre = a @ v
        else:
            pre = a @ v
            pre /= total
        pre += np.take(p["now"], now[:, start:], axis=0)
        pre += np.take(p["before"], x[:, start:-1], axis=0)
        return q, k, v, a, pre

    def _told(self, x: np.ndarray, keep: np.ndarray) -> np.ndarray:
        """Hidden rows where ``keep``. Windows that only tell their second half, as all but the first
        of a text do, have only that worked out."""
        later = ~keep[:, :OVERLAP].any(1)
        owner = np.repeat(later, keep.sum(1))
        h = np.empty((len(owner), HIDDEN), np.float32)
        h[owner] = self._hidden(x[later], start=OVERLAP)[-1][keep[later, OVERLAP:]]
        h[~owner] = self._hidden(x[~later])[-1][keep[~later]]
        return h

    def scores(self, x: np.ndarray, y: np.ndarray, keep: np.ndarray) -> np.ndarray:
        """Log-probabilities of the next subwords y where ``keep``, in that order."""
        h = np.maximum(self._told(x, keep), 0)
        place = self.place[y[keep]]
        part, member = place // CLASSES, place % CLASSES
        rows, ones = np.arange(len(h)), np.ones(CLASSES, np.float32)
        logit = h @ self.p["class"]
        logit += self.p["class0"]
        found = logit[rows, part]
        found -= np.log(np.exp(logit, out=logit) @ ones)
        order = np.argsort(part.astype(np.uint8), kind="stable")
        h, member = h[order], member[order]
        edges = np.searchsorted(part[order], np.arange(CLASSES + 1))
        logit = np.empty((len(h), CLASSES), np.float32)
        for c in range(CLASSES):
            a, b = edges[c], edges[c + 1]
            if a < b:
                np.matmul(h[a:b], self.p["member"][c], out=logit[a:b])
                logit[a:b] += self.p["member0"][c]
        inner = logit[rows, member]
        inner -= np.log(np.exp(logit, out=logit) @ ones)
        found[order] += inner
        return found

    def _gradients(self, x: np.ndarray, y: np.ndarray, keep: np.ndarray):
        p, n = self.p, keep.sum()
        q, k, v, a, pre = self._hidden(x, training=True)
        h = np.maximum(pre, 0)[keep]
        place = self.place[y[keep]]
        part = place // CLASSES
        order = np.argsort(part.astype(np.uint8), kind="stable")  # rows of a class stand together
        h, part, member = h[order], part[order], place[order] % CLASSES
        edges = np.searchsorted(part, np.arange(CLASSES + 1))
        spans = [(c, edges[c], edges[c + 1]) for c in np.flatnonzero(np.diff(edges))]
        rows = np.arange(len(h))
        outer = _softmax(h @ p["class"] + p["class0"])
        inner = np.empty((len(h), CLASSES), h.dtype)
        for c, i, j in spans:
            inner[i:j] = _softmax(h[i:j] @ p["member"][c] + p["member0"][c])
        loss = -np.log(outer[rows, part] * inner[rows, member]).mean()
        outer[rows, part] -= 1
        inner[rows, member] -= 1
        outer /= n
        inner /= n
        g = {key: np.zeros_like(value) for key, value in p.items()}
        g["class"], g["class0"] = h.T @ outer, outer.sum(0)
        back = outer @ p["class"].T
        for c, i, j in spans:
            g["member"][c], g["member0"][c] = h[i:j].T @ inner[i:j], inner[i:j].sum(0)
            back[i:j] += inner[i:j] @ p["member"][c].T
        back *= h > 0
        told = np.empty_like(back)
        told[order] = back
        up = np.zeros_like(pre)
        up[keep] = told
        da = up @ v.transpose(0, 2, 1)
        ds = a * (da - (a * da).sum(2, keepdims=True))
        g["near"] = np.bincount(self.distance.ravel(), ds.sum(0).ravel(), WINDOW).astype(np.float32)
        # What each place of a window adds to the rows of its subword, added up subword by subword.
        adds = {"before": up, "now": up, "value": a.transpose(0, 2, 1) @ up, "query": ds @ k,
                "key": ds.transpose(0, 2, 1) @ q}
        wide = np.zeros((*x.shape, sum(d.shape[2] for d in adds.values())), pre.dtype)
        at, columns = 0, {}
        for name, d in adds.items():
            columns[name] = slice(at, at := at + d.shape[2])
            wide[:, slice(0, -1) if name == "before" else slice(1, None), columns[name]] = d
        flat = x.ravel()
        order = np.argsort(flat.astype(np.uint16), kind="stable")
        found = flat[order]
        first = np.flatnonzero(np.diff(found, prepend=-1))
        sums = np.add.reduceat(wide.reshape(len(flat), -1)[order], first)
        for name, column in columns.items():
            g[name][found[first]] = sums[:, column]
        return loss, g

    def set_weights(self, flat: np.ndarray) -> None:
        """All weights from one row of numbers, in the order of ``p``."""
        edges = np.cumsum([w.size for w in self.p.values()])[:-1]
        for (key, w), part in zip(self.p.items(), np.split(flat, edges), strict=True):
            self.p[key] = part.reshape(w.shape).copy()

    def _update(self, batches, pace) -> None:
        """Adam; ``pace`` gives the rate of a step, counted from 1."""
        m = {key: np.zeros_like(value) for key, value in self.p.items()}
        v = {key: np.zeros_like(value) for key, value in self.p.items()}
        for t, (x, y, keep) in enumerate(batches, 1):
            _, g = self._gradients(x, y, keep)
            for key, d in g.items():
                m[key] = 0.9 * m[key] + 0.1 * d
                v[key] = 0.99 * v[key] + 0.01 * d * d
                self.p[key] -= pace(t) * (m[key] / (1 - 0.9**t)) / (np.sqrt(v[key] / (1 - 0.99**t)) + 1e-8)

    def train(self, tokens: np.ndarray, steps: int, batch: int = 64, rate: float = 0.02, seed: int = 7) -> None:
        """Random windows of one long sequence; the rate falls to nothing."""
        random = np.random.default_rng(seed)
        if len(tokens) < WINDOW + 2:
            return
        keep = np.ones((batch, WINDOW), bool)

        def batches():
            for _ in range(steps):
                at = random.integers(0, len(tokens) - WINDOW - 1, batch)[:, None] + np.arange(WINDOW + 2)
                rows = tokens[at]
                yield rows[:, :-1], rows[:, 2:], keep

        self._update(batches(), lambda t: rate * min(1, t / 100) * (1 - t / (steps + 1)))

    def learn(self, sequences: Iterator[np.ndarray], end: int, rate: float, batch: int = 256, seed: int = 7) -> int:
        """One pass over all sequences, each of which ends with ``end``: every subword is told once, in windows that
        follow one another. Those of a sequence come in random order. Gives the number of subwords told."""
        random = np.random.default_rng(seed)
        told = 0

        def batches():
            nonlocal told
            for tokens in sequences:
                n, windows = len(tokens), -(-len(tokens) // WINDOW)
                told += n
                padded = np.concatenate([[end, end], tokens, np.full(windows * WINDOW - n, end)])
                first = random.permutation(windows)[:, None] * WINDOW
                for i in range(0, windows, batch):
                    at = first[i : i + batch]
                    rows = padded[at + np.arange(WINDOW + 2)]
                    yield rows[:, :-1], rows[:, 2:], at + np.arange(WINDOW) < n

        self._update(batches(), lambda t: rate * min(1, t / 20))
        return told


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _classes(counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Classes of equal size of subwords that follow the same ones: halved again and again along
    the main direction of the square roots of how often each follows each."""
    size = KNOWN + 1
    follow = np.sqrt(pairs / np.maximum(pairs.sum(0, keepdims=True), 1)).T
    groups = [np.arange(size)]
    while len(groups) < CLASSES:
        halves = []
        for g in groups:
            rows = follow[g] - follow[g].mean(0)
            direction = np.ones(rows.shape[1])
            for _ in range(20):
                direction = rows.T @ (rows @ direction)
                direction /= max(np.linalg.norm(direction), 1e-12)
            order = np.lexsort((g, rows @ direction))
            halves += [g[order[: len(g) // 2]], g[order[len(g) // 2 :]]]
        groups = halves
    place = np.empty(size, np.int64)
    for c, g in enumerate(groups):
        place[np.sort(g)] = c * CLASSES + np.arange(CLASSES)
    return place
