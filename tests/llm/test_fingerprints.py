"""Winnowing and SimHash against plain versions."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from llm_helpers import rows_by_id

from perkloom.llm import components, simhash, winnowing


def plain_winnow(text, k=winnowing.K, w=winnowing.W):
    points = re.sub("[\x20\x09-\x0d]", "", text)
    grams = []
    for i in range(max(1, len(points) - k + 1) if points else 0):
        h = xxhash.xxh64_intdigest(points[i : i + k].encode("utf-32-be"), 42)
        grams.append((h - 2**64 if h >= 2**63 else h) % winnowing.PRIME)
    if not grams:
        return []
    kept = []
    for i in range(max(1, len(grams) - w + 1)):
        window = list(enumerate(grams))[i : i + w]
        low = min(h for _, h in window)
        place = max(p for p, h in window if h == low)
        if (low, place) not in kept:
            kept.append((low, place))
    return kept


def unpacked(kept):
    return [(x // winnowing.POSITIONS, winnowing.POSITIONS - 1 - x % winnowing.POSITIONS) for x in kept]


def test_kept_hashes_are_window_minima_rightmost_on_ties(make):
    texts = ["", " \t\n", "abc", "a b c d e f g", "aaaa " * 60, "the quick brown fox jumps over the lazy dog " * 5,
             "é漢😀 " * 30, "x" * 15, "x" * 16, "ab" * 16]
    got = winnowing.fingerprints(make(texts)).withColumn("at", winnowing.positions("kept"))
    for r in got.collect():
        want = plain_winnow(r["text"])
        assert unpacked(r["kept"]) == want and r["at"] == [p for _, p in want]


def test_edited_texts_keep_what_their_whole_text_keeps(make):
    random = np.random.default_rng(3)
    lengths = [0, 1, 2, 5, 14, 15, 16, 17, 29, 30, 31, 32, 33, 44, 45, 46, 47, 48, 60, 61, 62, 63, 64, 90, 150, 400]
    texts = []
    for letters in ("ab ", "abcdefghij é漢😀", "a"):
        for n in random.permutation(lengths * 3):
            texts.append("".join(random.choice(list(letters), int(n))))
    rows = winnowing.edited(make(texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert unpacked(r["kept"]) == plain_winnow(texts[r["doc_id"]])
        assert unpacked(r["edited_kept"]) == plain_winnow(r["edited"])


def test_one_character_more_leaves_unbroken_runs_alike(make):
    random = np.random.default_rng(5)
    chinese = "".join(chr(0x4E00 + int(i)) for i in random.integers(0, 20_000, 4_000))
    url = "https://host.example/" + "".join(random.choice(list("abcdef0123456789-/"), 4_000))
    spaced = " ".join("".join(random.choice(list("abcdefgh"), 6)) for _ in range(600))
    texts = [t for whole in (chinese, url, spaced) for t in (whole[:10] + "x" + whole[10:], whole)]
    near = {r["doc_id"]: r["near_next"] for r in winnowing.edited_likeness(make(texts)).collect()}
    assert near[1] > 0.9 and near[3] > 0.9 and near[5] > 0.9
    assert near[2] < 0.1 and near[4] < 0.1


def test_shared_passage_is_found(make):
    random = np.random.default_rng(7)
    for _ in range(5):
        passage = "".join(random.choice(list("abcdefgh"), winnowing.K + winnowing.W - 1))
        docs = make([f"alphabeta{passage}gamma", f"other words before {passage[:9]} {passage[9:]}andafter"])
        a, b = (set(r["hashes"]) for r in winnowing.fingerprints(docs).collect())
        assert a & b


def plain_op1(docs):
    rows = sorted(((d, t or "") for d, t in docs), reverse=True)
    found = {}
    for i, (doc_id, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        third = len(text) // 3
        found[doc_id] = (len(text), hashlib.sha256((text[: len(text) - third] + after[:third]).encode()).hexdigest())
    return found


def test_edited_text_over_many_ranges(small):
    got = winnowing.edited_likeness(small)
    want = plain_op1([(r["doc_id"], r["text"]) for r in small.collect()])
    assert rows_by_id(got, "n_chars", "edited_sha256") == want
    ranges = winnowing.Ranges(small.select("doc_id"), rows_apart=7)
    assert ranges.cuts > 20
    linked = winnowing.with_next(small.select("doc_id", "text"), ranges, ["doc_id"])
    ids = sorted((r["doc_id"] for r in small.collect()), reverse=True)
    assert rows_by_id(linked, "next") == {a: (b,) for a, b in zip(ids, ids[1:] + ids[:1], strict=True)}


def test_winnowing_hard_rows(hard, empty, make):
    rows = winnowing.edited_likeness(hard).collect()
    assert len(rows) == 11
    same = [r for r in rows if r["doc_id"] in (0, 5)]
    assert len({r["fingerprint"] for r in same}) == 1
    for r in rows:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert winnowing.edited_likeness(empty).count() == 0
    assert winnowing.edited_likeness(make(["only one text here"])).first()["near_next"] == 1.0


def plain_simhash(text, size=3):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius=3):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= radius and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_simhash_bits_and_groups(small):
    got = simhash.near_duplicates(small, tile=8)
    docs = sorted((r["doc_id"], r["text"]) for r in small.collect())
    fps = [plain_simhash(t) for _, t in docs]
    label = plain_components(fps)
    want = {d: (f"{fp:016x}", docs[g][0]) for (d, _), fp, g in zip(docs, fps, label, strict=True)}
    assert rows_by_id(got, "fingerprint", "component_id") == want


def test_every_pair_within_the_radius_is_linked(spark):
    random = np.random.default_rng(1)
    base = random.integers(0, 2**63, 60, dtype=np.uint64)
    fps = list(base)
    for fp in base:  # chains of three steps of up to three bits
        for _ in range(3):
            for bit in random.integers(0, 64, random.integers(1, 4)):
                fp = fp ^ np.uint64(1 << int(bit))
            fps.append(fp)
    fps = np.unique(np.array(fps, np.uint64))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint")
    found = components.components(simhash.links(df, tile=16))
    root = {r["node"]: r["root"] for r in found.collect()}
    label = plain_components([int(x) for x in fps])
    signed = fps.view(np.int64).tolist()
    groups = {}
    for x, g in zip(signed, label, strict=True):
        groups.setdefault(g, set()).add(root.get(x, x))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_simhash_hard_rows(hard, empty):
    rows = simhash.near_duplicates(hard).collect()
    assert len(rows) == 11
    blank = {r["component_id"] for r in rows if r["doc_id"] in (1, 2, 3)}
    assert blank == {1}
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.near_or_like(empty).count() == 0
    assert len(simhash.near_or_like(hard).collect()) == 11


def test_likeness_links_near_copies_only(make):
    words = [f"w{i}" for i in range(400)]
    changed = [*words[:200], "other", *words[201:]]
    half = words[:200] + [f"z{i}" for i in range(200)]
    docs = make([(10, " ".join(words)), (20, " ".join(changed)), (30, " ".join(half)), (40, "short text")])
    assert rows_by_id(simhash.near_or_like(docs), "component_id") == {10: 10, 20: 10, 30: 30, 40: 40}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 180)] + [(300, 299), (7, 7)]
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    root = {r["node"]: r["root"] for r in components.components(df).collect()}
    assert all(root[i] == 1 for i in range(1, 61))
    assert all(root[i] == 100 for i in range(100, 180))
    assert root[300] == root[299] == 299
    nothing = components.components(df.where(F.lit(False)))
    assert nothing.count() == 0
