"""BPE by tree concatenation and separator scans against the libraries."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import rows_by_id

from perkloom.llm import bpe, token_counts


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(bpe.vocabulary_path(), bpe.vocabulary_path(bpe.RANKS))


def in_leaves(codec, text, leaf):
    return codec.tree([codec.encode(text[i : i + leaf]) for i in range(0, max(1, len(text)), leaf)])


PIECES = [
    "the", "tion", " ", "  ", "\n", "'s", "'re", "it'", "123", "é", "漢字", "\N{GRINNING FACE}", "<|endoftext|>",
    "<|endof", "text|>", "...", "!?", "　", "\xa0", "a" * 90, "xq" * 60, "0" * 70, "=" * 80, " " * 75,
]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=60), st.integers(3, 200))
def test_leaves_join_to_the_whole(parts, leaf):
    codec = bpe.codec(bpe.vocabulary_path(), bpe.vocabulary_path(bpe.RANKS))
    text = "".join(parts)
    joined, whole = in_leaves(codec, text, leaf), codec.encode(text)
    assert joined.ids.tolist() == whole.ids.tolist() == codec.ids(text)
    assert joined.at.tolist() == whole.at.tolist()
    assert codec.decode([joined.ids.tolist()]) == [text]


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz", "a", "'", " ", "0123456789", "漢字仮名", "=-"])
def test_unsplit_runs_join_without_reading_them_again(codec, alphabet, monkeypatch):
    rng = random.Random(alphabet)
    text = "".join(rng.choice(alphabet) for _ in range(20_000))
    leaves = [codec.encode(text[i : i + 2_500]) for i in range(0, len(text), 2_500)]
    read = []
    monkeypatch.setattr(codec, "encode", lambda t, encode=codec.encode: (read.append(len(t)), encode(t))[1])
    joined = codec.tree(leaves)
    monkeypatch.undo()
    assert joined.ids.tolist() == codec.encode(text).ids.tolist()
    assert len(alphabet) == 1 or sum(read) < len(text)  # windows only


def digests(text):
    c = bpe.codec(bpe.vocabulary_path())
    ids = c.tokenizer.encode(text or "", add_special_tokens=False).ids
    back = c.tokenizer.decode(ids, skip_special_tokens=False)
    assert back == (text or "")
    return (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


COLUMNS = ["n_tokens", "ids_sha256", "decoded_sha256"]


def test_round_trip_of_all_documents(small):
    want = {r["doc_id"]: digests(r["text"]) for r in small.collect()}
    assert rows_by_id(bpe.round_trip(small), *COLUMNS) == want
    paths = bpe.vocabulary_path(), bpe.vocabulary_path(bpe.RANKS)
    assert rows_by_id(bpe.round_trip(small, *paths, leaf=700), *COLUMNS) == want


def test_encode_then_decode(small):
    tokens = bpe.encoded(small, leaf=1_000)
    assert rows_by_id(bpe.decoded(tokens), "text") == rows_by_id(small, "text")


def test_bpe_hard_rows(hard, empty):
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, *digests(r["text"])) for r in hard.collect())
    got = bpe.round_trip(hard, leaf=30_000).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, *[r[c] for c in COLUMNS]) for r in got) == want
    assert bpe.round_trip(empty).count() == 0


def test_long_white_space_is_one_piece(codec):
    path = bpe.vocabulary_path(bpe.RANKS)
    for text in (" " * 5_000 + "x", "a" + " " * 3_000, "b" + "\n" * 2_000 + " y", "é" + "　" * 1_500 + "z \n" + " " * 1_200 + "'s"):
        assert token_counts.token_ids(text, path) == codec.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(token_counts.token_ids(" " * 2_000_000 + "x", path)) > 0


@pytest.mark.parametrize("block", [5, 64, 65_536])
def test_documents_are_counted_across_blocks(small, block):
    path = bpe.vocabulary_path(bpe.RANKS)
    want = {r["doc_id"]: len(token_counts.token_ids(r["text"] or "", path)) for r in small.collect()}
    got = token_counts.document_token_counts(small.repartition(3), block_tokens=block)
    assert rows_by_id(got, "n_tokens") == want
    spans = {}
    for r in got.collect():
        spans.setdefault(r["file"], []).append((r["ordinal"], r["first"], r["n_tokens"]))
    for rows in spans.values():
        rows.sort()
        assert [o for o, _, _ in rows] == list(range(len(rows)))
        assert all(a[1] + a[2] + 1 == b[1] for a, b in zip(rows, rows[1:], strict=False))


def test_flat_files_of_a_store(spark, tmp_path):
    rng, want = np.random.default_rng(2), {}
    for n, size in enumerate([0, 1, 40, 1_000, 4_096]):
        tokens = rng.integers(0, 30, size).astype("<u2")
        tokens[tokens == 0] = token_counts.END_OF_DOCUMENT
        (tmp_path / f"{n}.bin").write_bytes(tokens.tobytes())
        ends = np.flatnonzero(tokens == token_counts.END_OF_DOCUMENT)
        starts = np.concatenate([[0], ends + 1])
        stops = np.append(ends, size)
        if not len(ends) or ends[-1] == size - 1:
            starts, stops = (starts[:-1], stops[:-1]) if len(ends) else (starts, stops)
        if size:
            want[f"{n}.bin"] = list(zip(starts.tolist(), (stops - starts).tolist(), strict=True))
    blocks = token_counts.blocks_of_files(spark, str(tmp_path), block_tokens=16)
    found = token_counts.token_counts(token_counts.separators(blocks), section_blocks=4).collect()
    got = {}
    for r in sorted(found, key=lambda r: r["ordinal"]):
        got.setdefault(r["file"].rsplit("/", 1)[1], []).append((r["first"], r["n_tokens"]))
    assert got == want


def test_token_counts_hard_rows(hard, empty):
    rows = token_counts.document_token_counts(hard).collect()
    assert len(rows) == 11
    assert [r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)] == [0, 0]
    assert token_counts.document_token_counts(empty).count() == 0
