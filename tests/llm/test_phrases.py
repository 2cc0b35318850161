"""Collocations against plain counting."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np

from perkloom.llm import phrases


def brute(rows, support=30, per_lang=2000):
    """Rows of the list from (lang, text)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, counted in f.items():
        found = {p: a for p, a in counted.items() if len(p) > 1 and a >= support}
        gone = {
            p[i : i + size] for p, a in found.items() for size in range(2, len(p))
            for i in range(len(p) - size + 1) if 100 * a >= 80 * counted[p[i : i + size]]
        }
        rows = []
        for p, a in found.items():
            if p not in gone:
                cuts = [(counted[p[:k]], counted[p[k:]]) for k in range(1, len(p))]
                score, _, left, right = min((2_000_000 * a // (x + y), k, x, y) for k, (x, y) in enumerate(cuts))
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:per_lang], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return out


def result(df, **options):
    found = phrases.collocations(df, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made(spark, rows):
    return spark.createDataFrame(
        [(i, t, x, "a", None) for i, (x, t) in enumerate(rows)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    )


def texts(seed, n=120):
    random = np.random.default_rng(seed)
    vocabulary = ["the", "The", "of", "new", "york", "city", "é", "漢字", "a b", "x\x00y", "STRASSE", "ß", "İ"]
    signs = [" ", "  ", "\t", ", ", ".", "\n", "\x0b", "; ", "! ", "?", ":"]
    weights = np.array([12, 4, 2, 1, 1, 1, 1, 1, 1, 1, 1], float)
    rows = []
    for i in range(n):
        words = random.choice(vocabulary, random.integers(0, 80), p=np.arange(13, 0, -1) / 91)
        between = random.choice(signs, len(words), p=weights / weights.sum())
        text = "".join(w + s for w, s in zip(words, between, strict=True))
        rows.append((["en", "de", None, "und", ""][i % 5], text))
    return rows


def test_small_corpora_are_counted_exactly(spark):
    for seed, support in ((1, 30), (2, 3), (3, 1)):
        rows = texts(seed)
        df = made(spark, rows).repartition(5)
        assert result(df, support=support) == brute(rows, support)


def test_small_blocks_and_crowded_bit_maps(spark, monkeypatch):
    rows = texts(4) + [("en", "new york city the new york city of " * 300), ("en", "y" * 5000 + " new york")]
    df = made(spark, rows)
    want = brute(rows, 4)
    assert result(df, support=4, block_words=50) == want
    assert result(df.repartition(7), support=4, bits=4) == want
    assert result(df, support=4, shards=1) == want
    assert result(df.repartition(3), support=4, bucket_words=100) == want
    monkeypatch.setattr(phrases, "TALLIED_TEXTS", 10)
    assert result(df, support=4, block_words=300) == want
    cutter = phrases._Cutter(20)
    monkeypatch.setattr(phrases, "SLICE", 16)
    got, all_words = [], " ".join(f"w{i % 7}," * (i % 5 == 0) + f"w{i % 11} " for i in range(100))
    for block in [*cutter.add(all_words.encode()), cutter.block()]:
        words = [b"", *block["words"].split(b"\n")]
        got += [words[i].decode() for i in np.frombuffer(block["ids"], "<i4")[block["head"] :].tolist() if i]
    assert got == re.findall("[^ ,]+", all_words)


def test_ranks_end_at_the_limit_and_ties_go_by_bytes(spark):
    rows = [("en", ". ".join(f"a{i} b{i}" for i in range(50)) + ". \U0001f600 z. ￮ z")] * 30
    df = made(spark, rows)
    assert result(df) == brute(rows)
    assert result(df, per_lang=7) == brute(rows, per_lang=7)


def test_hard_rows(hard, empty):
    rows = [("en", r["text"]) for r in hard.select("text").collect()]
    assert result(hard, support=2) == brute(rows, 2)
    assert result(empty) == set()


def test_sql_twin(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    rel = con.sql(phrases.ORACLE)
    assert rel.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = phrases.op12_phrases(spark, "/root/testdata/sf0.001")
    assert {tuple(r) for r in got.collect()} == set(rel.fetchall())


def test_runs_come_back():
    random = np.random.default_rng(9)
    for n in (1, 2, 1000):
        numbers = np.unique(random.integers(0, 2**48, n).astype(np.uint64))
        counts = random.integers(1, 2**40, len(numbers))
        got = phrases._unpacked(phrases._packed(numbers, counts))
        assert (got[0] == numbers).all() and (got[1] == counts).all()
    parts = [(np.array([1, 5, 9], np.uint64), np.array([1, 1, 2])), (np.array([0, 5], np.uint64), np.array([7, 3]))]
    numbers, counts = phrases._summed(parts)
    assert numbers.tolist() == [0, 1, 5, 9] and counts.tolist() == [7, 1, 4, 2]
