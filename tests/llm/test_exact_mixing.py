"""Exact dedup and mixing against plain versions."""

from __future__ import annotations

import hashlib
import re

from llm_helpers import rows_by_id

from perkloom.llm import exact_dedup, mixing


def plain_dedup(rows):
    groups = {}
    for doc_id, text in rows:
        text = text or ""
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", "", text), []).append((-len(text), doc_id))
    found = {}
    for norm, members in groups.items():
        keep = min(members)[1]
        for _, doc_id in members:
            found[doc_id] = (keep, len(members), doc_id == keep, hashlib.sha256(norm.encode()).hexdigest())
    return found


COLUMNS = ["keep_id", "group_size", "kept", "text_sha256"]


def test_dedup_matches_plain(small):
    want = plain_dedup([(r["doc_id"], r["text"]) for r in small.collect()])
    assert rows_by_id(exact_dedup.exact_dedup(small), *COLUMNS) == want
    assert rows_by_id(exact_dedup.exact_dedup(small, keep_chunks=False), *COLUMNS) == want


def test_colliding_chunk_hashes_are_told_apart(small):
    want = plain_dedup([(r["doc_id"], r["text"]) for r in small.collect()])
    got = exact_dedup.exact_dedup(small, bits=4, minimum=8, maximum=64)
    assert rows_by_id(got, *COLUMNS) == want


def test_chunks_follow_content(make):
    passage = "the same passage stands in both of them, " * 40
    docs = make(["a start " + passage, "quite another and longer start " + passage])
    a, b = (
        r["c"] for r in docs.select(
            exact_dedup.chunks(exact_dedup.normalised(docs["text"]), 16, 256).alias("c")
        ).collect()
    )
    assert len(set(a) & set(b)) >= len(set(a)) // 2
    assert "".join(a) == re.sub(r"\s", "", "a start " + passage)


def test_dedup_hard_rows(hard, empty):
    rows = exact_dedup.exact_dedup(hard).collect()
    assert len(rows) == 11
    assert sum(r["kept"] for r in rows) == len({r["text_sha256"] for r in rows})
    assert {r["keep_id"] for r in rows if r["doc_id"] in (1, 2, 3)} == {3}
    assert exact_dedup.exact_dedup(empty).count() == 0


def plain_targets(sizes):
    """Share by weight, stop at three times the size, share the rest again."""
    names = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    full, rest, left = {}, float(sum(sizes.values())), set(names)
    while left:
        total = sum(weight[s] for s in left)
        over = [s for s in left if rest * weight[s] / total > 3 * sizes[s]]
        if not over:
            return full | {s: rest * weight[s] / total for s in left}
        for s in over:
            full[s] = 3.0 * sizes[s]
        left -= set(over)
        rest = sum(sizes.values()) - sum(full.values())
    return full


def test_targets_fill_up(spark):
    sizes = {"a": 1000, "b": 10, "ä": 500, None: 7, "c": 0, "Z": 90_000}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_permutation_is_one(spark):
    for size in (1, 2, 7, 1000):
        expr = mixing.permuted("id", f"{size}L", "17, 3, 1")
        found = [r[0] for r in spark.range(size).selectExpr(expr).collect()]
        assert sorted(found) == list(range(size))
    assert found != list(range(size))


def test_shard_draws_add_up(spark):
    df = spark.createDataFrame(
        [(0, 10_000, 30_000.0), (1, 50_000, 20_000.0), (2, 400, 1_000.0)],
        "sid int, source_size bigint, target double",
    )
    rows = mixing.shard_counts(df, shard_slots=100).collect()
    blocks = {s: -(-n // mixing.BLOCK_WORDS) for s, n in ((0, 10_000), (1, 50_000), (2, 400))}
    slots = {0: 30_000 * blocks[0] / 10_000, 1: 20_000 * blocks[1] / 50_000, 2: 1_000 * blocks[2] / 400}
    shards = {r["shard"] for r in rows}
    per_shard = sum(slots.values()) / len(shards)
    for shard in shards:
        assert abs(sum(r["draws"] for r in rows if r["shard"] == shard) - per_shard) <= 1
    for sid, want in slots.items():
        assert abs(sum(r["draws"] for r in rows if r["sid"] == sid) - want) < 0.05 * want + 5


def test_mix_meets_its_targets(small):
    rows = mixing.mix(small).collect()
    docs = {r["doc_id"]: r for r in small.collect()}
    words = {d: len(re.findall("[^\x20\x09-\x0d]+", r["text"] or "")) for d, r in docs.items()}
    sizes = {}
    for d, r in docs.items():
        sizes[r["source"]] = sizes.get(r["source"], 0) + words[d]
    want, taken = plain_targets(sizes), {}
    for r in rows:
        source = docs[r["doc_id"]]["source"]
        assert r["size"] == words[r["doc_id"]] and r["source_size"] == sizes[source]
        assert abs(r["target"] - want[source]) < 1e-6 * want[source]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source] = taken.get(source, 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) < 0.05 * want[s] + mixing.BLOCK_WORDS for s in want)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(small).collect()))


def test_mix_hard_rows(hard, empty, make):
    rows = mixing.mix(hard).collect()
    assert len(rows) == 11
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.mix(empty).count() == 0
    assert [r["taken"] for r in mixing.mix(make([None, ""])).collect()] == [0, 0]
