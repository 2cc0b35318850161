"""Links by likeness against the sets of all pairs."""

from __future__ import annotations

import numpy as np

from llm_helpers import rows_by_id

from perkloom.llm import simhash


def edited(random, words, share):
    """``words`` with scattered ones replaced, until ``share`` of the five-word shingles is left."""
    words, whole = list(words), np.unique(simhash.shingle_hashes(" ".join(words), 5))
    while True:
        before = list(words)
        words[random.integers(len(words))] = f"new{random.integers(10**9)}"
        found = np.unique(simhash.shingle_hashes(" ".join(words), 5))
        shared = len(np.intersect1d(whole, found))
        if shared / (len(whole) + len(found) - shared) < share:
            return before, words  # just above and just below


def test_links_are_those_of_the_sets(make):
    random = np.random.default_rng(5)
    rows, want = [], {}
    for n in range(60):
        words = [f"w{x}" for x in random.integers(0, 5_000, random.integers(100, 600))]
        above, below = edited(random, words, 0.8)
        chosen = [words, above if n % 2 else below]
        for k, text in enumerate(chosen):
            rows.append((10 * n + k, " ".join(text)))
            want[10 * n + k] = 10 * n if n % 2 else 10 * n + k
    fp = {d: simhash.simhash(simhash.shingle_hashes(t, 3)) for d, t in rows}
    for n in range(0, 60, 2):  # linked by the fingerprint, whatever the sets
        if (fp[10 * n] ^ fp[10 * n + 1]).bit_count() <= simhash.RADIUS:
            want[10 * n + 1] = 10 * n
    assert rows_by_id(simhash.near_or_like(make(rows)), "component_id") == want


def groups_of(rows, similarity=0.8):
    """Smallest linked doc_id of each row of texts, by the sets of all pairs and the three bits."""
    fp = [simhash.simhash(simhash.shingle_hashes(t or "", 3)) for _, t in rows]
    sets = [set(simhash.shingle_set(t or "").tolist()) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            shared, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            alike = shared >= similarity * either and either > 0
            if label[i] != label[j] and (alike or (fp[i] ^ fp[j]).bit_count() <= simhash.RADIUS):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    least = {}
    for (d, _), g in zip(rows, label, strict=True):
        least[g] = min(d, least.get(g, d))
    return {d: least[g] for (d, _), g in zip(rows, label, strict=True)}


def crowd(random, n, shared, words=300):
    """Texts of which any two share about ``shared`` of their five-word shingles."""
    keep = int(words * 2 * shared / (1 + shared))
    common = " ".join(f"c{i}" for i in range(keep))
    return [f"{common} " + " ".join(f"x{x}" for x in random.integers(0, 10**9, words - keep)) for _ in range(n)]


def test_crowds_without_pairs(make):
    random = np.random.default_rng(6)
    for shared, groups in ((0.85, 1), (0.75, 2000)):
        rows = list(enumerate(crowd(random, 2000, shared)))
        df = make(rows)
        found = simhash.near_or_like(df, tile=300).select("component_id").distinct().count()
        if groups == 1:
            assert found == 1
        else:  # but for those whose fingerprints are three bits apart
            fp = [simhash.simhash(simhash.shingle_hashes(t, 3)) for _, t in rows]
            near = sum((a ^ b).bit_count() <= simhash.RADIUS for i, a in enumerate(fp) for b in fp[:i])
            assert groups - near <= found <= groups


def test_tiles_are_cut_by_bytes_and_number(make):
    random = np.random.default_rng(7)
    rows = []
    for n in range(40):
        words = [f"w{x}" for x in random.integers(0, 5_000, random.integers(5, 2000))]
        rows += [(len(rows) + k, " ".join(t)) for k, t in enumerate((words, *edited(random, words, 0.8)))]
    want = groups_of(rows)
    for options in ({}, {"tile": 3}, {"tile_bytes": 20_000}):
        assert rows_by_id(simhash.near_or_like(make(rows), **options), "component_id") == want


def test_given_documents(small):
    rows = [(r["doc_id"], r["text"]) for r in small.collect()]
    assert rows_by_id(simhash.near_or_like(small), "component_id") == groups_of(rows)
