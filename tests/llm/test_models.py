"""Personal data, language model and classifiers."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import rows_by_id

from perkloom.llm import attention, labelled, lm_scoring, pii, quality, toxicity

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    found = []
    for kind, (name, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m[0])
            if name == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if name == "card":
                twice = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
                if not 16 <= len(digits) <= 19 or sum(d - 9 if d > 9 else d for d in twice) % 10:
                    continue
            if name == "phone" and not 8 <= len(digits) <= 15:
                continue
            found.append((kind, *m.span()))
    return found


PARTS = ["a@b.c", "@", ".", "x-y.z@w", "1.2.3.4", "256.1.1.1", "0000001.2.3.4", "4111111111111111", " ", "-", "+1 (555) 010-9999", "+", "5", "12", "é", "\n"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=25))
def test_base_spans_match_the_rules(parts):
    text = "".join(parts)
    assert [tuple(s) for s in pii.base_spans(text)] == plain_spans(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" * 150_000, "1:" * 100_000):
        pii.loose_spans(text, pii.base_spans(text))


def test_personal_data_of_all_documents(small):
    got = rows_by_id(pii.personal_data(small), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    for r in small.collect():
        base = plain_spans(r["text"] or "")
        written = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base]
        *counts, digest, spans = got[r["doc_id"]]
        assert counts == [sum(k == n for k, _, _ in base) for n in range(4)]
        assert digest == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert set(written) <= set(spans.split(",")) | {""}


def test_patterns_find_what_is_not_well_formed(make):
    texts = [f"please call me at +1 555 010 {n:04d} today" for n in range(20)]
    texts += ["please call me at 555-010-7777 today", "the order was 555-010-8888 pieces long"]
    texts += [f"my address is user{n}@host{n}.example.org ok" for n in range(20)] + ["my address is root@localhost ok"]
    rows = pii.personal_data(make(texts)).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[20]["spans"] == "phone:18:30" and by_id[20]["n_phone"] == 0
    assert by_id[21]["spans"] == ""
    assert by_id[42]["spans"] == "email:14:28"


def test_a_second_round_trusts_what_the_first_found(make):
    texts = [f"ring us on +1 555 010 {n:04d} now" for n in range(40)]
    texts += [f"ring us on 555-010-{n:04d} now" for n in range(8)]  # found by pattern: values
    texts += [f"desk number is 555-010-{n:04d} there" for n in range(8)]  # the same values, new pattern
    texts += ["desk number is 555-999-1234 there"]
    once = pii.personal_data(make(texts), rounds=1).collect()
    more = pii.personal_data(make(texts), rounds=3).collect()
    assert {r["doc_id"] for r in once if r["n_found"]} == set(range(40, 48))
    assert {r["doc_id"] for r in more if r["n_found"]} == set(range(40, 57))


def test_pii_hard_rows(hard, empty):
    assert len(pii.personal_data(hard).collect()) == 11
    assert pii.personal_data(empty).count() == 0


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_base_score_and_counts(small):
    docs = {r["doc_id"]: r["text"] or "" for r in small.collect()}
    lower = {d: re.sub("[A-Z]", lambda m: m[0].lower(), t) for d, t in docs.items()}
    tokens = {d: [*re.findall("[^\x20\x09-\x0d]+", t), None] for d, t in lower.items()}
    counts = Counter(w for d, ws in tokens.items() if fold(d, 5) != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for r in lm_scoring.lm_scores(small, steps=60).collect():
        ws = tokens[r["doc_id"]]
        want = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert r["held_out"] == (fold(r["doc_id"], 5) == 1)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert abs(r["base_score"] - want) < 1e-6 * abs(want)
        assert math.isfinite(r["score"]) and r["score"] < 0


def trained(steps=300):
    rng = np.random.default_rng(3)
    tokens = rng.integers(0, 40, 6_000)
    tokens[2::3] = (tokens[1::3] + tokens[::3]) % 40  # told by the two before
    counts = np.bincount(tokens, minlength=attention.KNOWN + 1).astype(float)
    size = attention.KNOWN + 1
    pairs = np.bincount(tokens[:-1] * size + tokens[1:], minlength=size * size).reshape(size, size)
    network = attention.Attention(counts, pairs.astype(float))
    network.train(tokens, steps)
    return network, tokens


def test_probabilities_add_to_one_and_look_only_back():
    network, tokens = trained(50)
    x = np.repeat(tokens[None, : attention.WINDOW + 1], attention.KNOWN + 1, axis=0)
    keep = np.zeros((len(x), attention.WINDOW), bool)
    keep[:, 20] = True
    y = np.zeros((len(x), attention.WINDOW), int)
    y[:, 20] = np.arange(len(x))
    logs = network.scores(x, y, keep)
    assert abs(np.exp(logs.astype(float)).sum() - 1) < 1e-3
    later = x.copy()
    later[:, 22:] = 5  # after the current subword
    assert np.allclose(network.scores(later, y, keep), logs, atol=1e-5)


def test_gradients_are_those_of_the_loss():
    network, tokens = trained(5)
    for key in network.p:
        network.p[key] = network.p[key].astype(float)
    at = np.arange(3)[:, None] * 50 + np.arange(attention.WINDOW + 2)
    x, y = tokens[at][:, :-1], tokens[at][:, 2:]
    keep = np.ones(y.shape, bool)
    _, g = network._gradients(x, y, keep)
    rng = np.random.default_rng(0)
    for key, value in network.p.items():
        places = np.argwhere(np.abs(g[key]) > 1e-6)
        for place in places[rng.integers(0, len(places), 3)]:
            place, old = tuple(place), value[tuple(place)]
            value[place] = old + 1e-5
            up, _ = network._gradients(x, y, keep)
            value[place] = old - 1e-5
            down, _ = network._gradients(x, y, keep)
            value[place] = old
            assert abs((up - down) / 2e-5 - g[key][place]) < 1e-4 + 0.02 * abs(g[key][place])


def test_training_beats_frequencies():
    network, tokens = trained()
    share = np.bincount(tokens, minlength=40) / len(tokens)
    at = np.arange(0, 3_000, attention.WINDOW)[:, None] + np.arange(attention.WINDOW + 2)
    rows = tokens[at]
    logs = network.scores(rows[:, :-1], rows[:, 2:], np.ones((len(rows), attention.WINDOW), bool))
    assert logs.mean() > np.log(share[rows[:, 2:]]).mean()


@pytest.mark.parametrize("n", [1, 7, 8, 31, 32, 33, 56, 57, 200, 60_000])
def test_windows_tell_each_subword_once(n):
    tokens = np.arange(n)
    told, read = [], []
    for x, y, keep in lm_scoring._windows(tokens, -1):
        told += y[keep].tolist()
        read += x[:, 1:][keep].tolist()
    assert told == list(range(n)) and read == [-1, *range(n - 1)]


def test_documents_score_alike_in_any_batch():
    counts = np.zeros(lm_scoring.SUBWORDS)
    counts[:3_000] = np.arange(3_000, 0, -1)
    rng = np.random.default_rng(4)
    scorer = lm_scoring.Scorer(counts, rng.integers(0, 3_000, 4_000), steps=5)
    documents = [rng.integers(0, 50_000, n).tolist() for n in (1, 5, 90, 3_000, 1, 70_000)]
    together = scorer.scores(documents)
    assert np.allclose(together, [scorer.scores([d])[0] for d in documents], rtol=1e-4)


def test_lm_hard_rows(hard, empty):
    rows = lm_scoring.lm_scores(hard, steps=5).collect()
    assert len(rows) == 11
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert lm_scoring.lm_scores(empty, steps=5).count() == 0


@pytest.fixture(scope="module")
def judged(spark, make):
    """Texts whose class shows, some held out."""
    rng = np.random.default_rng(5)
    plain = [f"w{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(900):
        words = [plain[j] for j in rng.integers(0, 300, 60)]
        toxic, bad = i % 4 == 0, i % 5 == 0
        if toxic:
            for at in rng.integers(0, 60, 6):
                words[at] = ["nasty", "vile", "rotten"][at % 3]
        text = " ".join(words)
        texts.append(text.upper().replace(" ", "!! ") if bad else text)
        labels.append((i, int(not bad), int(toxic)))
    labels += [(None, 1, 1), (3, None, None)]
    return make(texts), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("op, label, folds, held, threshold", [
    (toxicity.toxicity, "toxic", 3, 1, 0.7), (quality.quality, "quality", 5, 0, 0.3),
])
def test_held_out_accuracy(judged, op, label, folds, held, threshold):
    docs, labels = judged
    rows = op(docs, labels).join(labels.dropna(), "doc_id").collect()
    out = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (fold(r["doc_id"], folds) == held) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold) for r in rows)
    assert np.mean([r["predicted"] == r[label] for r in out]) > 0.97


def test_held_out_labels_are_not_read(judged):
    docs, labels = judged
    sample, there = labelled.labelled_sample(docs, labels, "toxic", 3, 1, 100)
    rows = sample.collect()
    assert all(fold(r["doc_id"], 3) != 1 for r in rows)
    assert there == Counter(r["toxic"] for r in labels.dropna().collect() if fold(r["doc_id"], 3) != 1)
    assert len(rows) < 260


def test_kneser_ney_by_hand(spark):
    rows = [("", "a", 10, 2), ("", "b", 1, 9), ("", "c", 2, 2), ("a", "b", 1, 8), ("a", "c", 2, 1), ("b", "a", 5, 0)]
    m = toxicity.Models(spark.createDataFrame(rows, "before string, word string, ordinary bigint, toxic bigint"))
    d, n = toxicity.DISCOUNT, (13, 13)
    free = ((3 + 1 + 2) / 13, (2 + 3 + 2) / 13)
    shared = {"a": 2 / 7, "b": 2 / 7}
    p = {w: [max(c - d, 0) / k + f * shared[w] for c, k, f in zip(x, n, free, strict=True)] for w, x in {"a": (10, 2), "b": (1, 9)}.items()}
    assert m.word == pytest.approx({w: math.log(q[1] / q[0]) for w, q in p.items()})
    assert m.unseen == pytest.approx(math.log(free[1] / free[0]))
    # after a: ordinary 3 pairs seen, all given to the backoff; toxic 9, of which 4 are
    both = [(max(x - d, 0) / k + f * q) for x, k, f, q in zip((1, 8), (3, 9), (1, 4 / 9), p["b"], strict=True)]
    assert m.pair[("a", "b")] == pytest.approx(math.log(both[1] / both[0]))
    assert m.backoff["a"] == pytest.approx(math.log((4 / 9) / 1))


@pytest.mark.parametrize("op", [toxicity.toxicity, quality.quality])
def test_classifier_hard_rows(spark, hard, empty, make, op):
    labels = spark.createDataFrame([(0, 1, 1), (5, 0, 0), (8, 1, 1)], "doc_id bigint, quality int, toxic int")
    none = labels.limit(0)
    assert len(op(hard, labels).collect()) == 11
    assert {r["score"] for r in op(hard, none).collect()} == {0.0}
    assert op(empty, none).count() == 0 and op(empty, labels).count() == 0


def test_shapes():
    assert [quality.shape(t) for t in ("Word", "WORD", "a1b2c3", "%%%", "é")] == ["(Xx)", "(X)", "(x9x9)", "(#)", "(x)"]
    v = quality.Vocabulary(["the"])
    assert v.numbers("the the Odd %%").tolist() == [
        v.number["the"], v.number[quality.REPEAT], v.number["(Xx)"], v.number["(#)"]
    ]
