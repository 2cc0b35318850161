"""The cleaning stages, each against a plain version on its own input."""

from __future__ import annotations

import hashlib
import math
import os
import re
import sys
from collections import Counter

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline
from llm_helpers import rows_by_id
from test_likeness import groups_of

from perkloom.llm import bpe, common, mixing, toxicity

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage by its name, and the order of the names."""
    docs, seen = common.documents(spark, SF_DIR), {}
    for name, stage in corpus_pipeline.STAGES:
        out = common.stored(stage(spark, docs, SF_DIR), "test-stage")
        seen[name] = (docs, out)
        docs = out
    return seen


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_all_but_the_last_return_documents(stages):
    names = list(stages)
    assert names == ["toxicity", "exact dedup", "near dedup", "mixing", "encoding"]
    for name in names[:-1]:
        assert stages[name][1].columns == COLUMNS
        assert {tuple(r) for r in stages[name][1].collect()} <= {tuple(r) for r in stages[name][0].collect()}


def test_rejected_documents_go(spark, stages):
    docs, out = stages["toxicity"]
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    toxic = {r["doc_id"] for r in toxicity.toxicity(docs, labels).collect() if r["predicted"]}
    assert ids(out) == Counter(d for d in ids(docs) if d not in toxic)


def test_one_of_equal_texts_stays(stages):
    docs, out = stages["exact dedup"]
    groups = {}
    for r in docs.collect():
        key = re.sub("[\x20\x09-\x0d]+", "", r["text"] or "")
        groups.setdefault(key, []).append((-len(r["text"] or ""), r["doc_id"]))
    assert ids(out) == Counter(min(g)[1] for g in groups.values())


def test_one_of_near_copies_stays(stages):
    docs, out = stages["near dedup"]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert ids(out) == Counter(set(groups_of(rows).values()))


def test_documents_stay_as_often_as_they_are_taken(stages):
    docs, out = stages["mixing"]
    there, sizes, taken = ids(out), Counter(), Counter()
    source = rows_by_id(docs, "source")
    for r in mixing.mix(docs).collect():
        share = r["taken"] / r["size"] if r["size"] else 0
        assert math.floor(share) <= there[r["doc_id"]] <= math.ceil(share)
        sizes[source[r["doc_id"]]] += r["taken"]
        taken[source[r["doc_id"]]] += r["size"] * there[r["doc_id"]]
    assert sum(taken.values()) == pytest.approx(sum(sizes.values()), rel=0.15)


def test_texts_are_encoded(stages):
    docs, out = stages["encoding"]
    c = bpe.codec(bpe.vocabulary_path())
    want = Counter()
    for r in docs.collect():
        found = c.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        back = c.tokenizer.decode(found, skip_special_tokens=False)
        want[(
            r["doc_id"], len(found), hashlib.sha256(",".join(map(str, found)).encode()).hexdigest(),
            hashlib.sha256(back.encode()).hexdigest(),
        )] += 1
    got = out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert Counter(map(tuple, got)) == want


def test_run_is_the_stages_one_after_another(spark, stages):
    got = Counter(map(tuple, corpus_pipeline.run(spark, SF_DIR).collect()))
    assert got == Counter(map(tuple, stages["encoding"][1].collect()))


def rows_of(df):
    return Counter((r["doc_id"], r["text"], r["lang"]) for r in df.collect())


@pytest.fixture(scope="module")
def repeated(spark):
    """Ids that repeat, with equal and with other texts, and rows without one."""
    a, b, c = (" ".join(f"{x}{i % 90}" for i in range(400)) for x in "abc")
    rows = [
        (1, a, "en"), (1, a, "de"), (1, b, "en"), (1, a.replace(" ", "\t"), "en"), (2, a, "en"), (None, c, "en"),
        (None, c, "en"), (None, c + " end", "en"), (None, b, "en"), (3, None, "en"), (3, "", "en"), (None, None, "fr"),
    ]
    return spark.createDataFrame(
        [(d, t, x, "s", None) for d, t, x in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint"
    ).repartition(3)


def test_repeated_and_missing_ids_in_dedup(spark, repeated):
    a, b, c = (" ".join(f"{x}{i % 90}" for i in range(400)) for x in "abc")
    exact = corpus_pipeline.without_copies(spark, repeated, SF_DIR)
    kept = rows_of(exact)
    assert sum(kept.values()) == 5  # a, b, c, c with an end, nothing
    assert {(d, t) for d, t, _ in kept} <= {(1, a), (1, a.replace(" ", "\t")), (1, b), (None, c), (None, c + " end"), (3, None), (3, "")}
    assert rows_of(corpus_pipeline.without_copies(spark, repeated.repartition(5), SF_DIR)) == kept
    near = rows_of(corpus_pipeline.without_near_copies(spark, repeated, SF_DIR))
    assert sorted((str(d), (t or "")[:2]) for d, t, _ in near) == [("1", "a0"), ("1", "b0"), ("3", ""), ("None", "c0")]
    assert rows_of(corpus_pipeline.without_near_copies(spark, repeated.repartition(5), SF_DIR)) == near


def test_repeated_and_missing_ids_in_mixing(spark, repeated):
    out = rows_of(corpus_pipeline.mixed(spark, repeated, SF_DIR))
    there = rows_of(repeated)
    assert set(out) <= set(there)
    # One source: every word is taken once, so every document stays as often as it is there.
    assert out == Counter({r: n for r, n in there.items() if r[1]} | {r: out[r] for r in there if not r[1] and out[r]})


def test_stages_on_hard_rows(spark, hard, empty):
    for docs in (hard, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = common.stored(stage(spark, docs, SF_DIR), "test-hard")
            if name != "encoding":
                assert out.columns == docs.columns
            docs = out
    assert docs.count() == 0
