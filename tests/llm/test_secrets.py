"""Secret scans against plain searches."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from llm_helpers import rows_by_id

from perkloom.llm import secret_scan

BASE = [
    ("assign", r"(?ai:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))",
     lambda m: len(m[2]) >= 6),
    ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24),
]


def brute(text):
    """(n_assign, n_access, n_hex, base_sha256, written) of the base kinds."""
    found, counts = [], []
    for k, (name, pattern, holds) in enumerate(BASE):
        ok = [m for m in re.finditer(pattern, text or "") if holds(m)]
        counts.append(len(ok))
        found += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in ok]
    written = ",".join(x for *_, x in sorted(found))
    return (*counts, hashlib.sha256(written.encode()).hexdigest(), written)


def result(df):
    return rows_by_id(secret_scan.scan(df), "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def crc_token(prefix, body):
    value, tail = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        tail = secret_scan.BASE62[digit] + tail
    return prefix + body + tail


def base58_token(payload):
    raw = payload + hashlib.sha256(hashlib.sha256(payload).digest()).digest()[:4]
    value, text = int.from_bytes(raw, "big"), ""
    while value:
        value, digit = divmod(value, 58)
        text = secret_scan.BASE58[digit] + text
    return text


# Published examples of the formats.
AGE = "AGE-SECRET-KEY-1GFPYYSJZGFPYYSJZGFPYYSJZGFPYYSJZGFPYYSJZGFPYYSJZGFPQ4EGAEX"
NOTE = "nsec1vl029mgpspedva04g90vltkh6fvh240zqtv9k0t9af8935ke9laqsnlfe5"


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r["doc_id"]: brute(r["text"]) for r in docs.select("doc_id", "text").collect()}
    assert any(w[0] for w in want.values()) and any(w[2] for w in want.values())
    assert result(docs) == want


def test_random_pieces(make):
    pieces = [
        "password", "PassWord", "passwd", "secret", "SECRET", "token", "api_key", "apikey", "API_Key", "api__key",
        '"', "'", " ", "  ", ":", "=", "\t", "AKIA", "akia", "AKIAAKIA", "A1B2C3D4E5F6G7H8", "Z9", "abc", "12345",
        "deadbeef", "0123456789abcdef", "0" * 24, "F", "g", "\n", "ſecret", "toKen", "é", "漢", "\U0001f600", "=x/", "-.", "İ",
    ]
    draw = random.Random(7)
    texts = ["".join(draw.choices(pieces, k=draw.randrange(40))) for _ in range(3000)]
    assert result(make(texts)) == {i: brute(t) for i, t in enumerate(texts)}


def test_places_are_code_points_and_failed_matches_are_not_tried_again(make):
    texts = [
        "\U0001f600 token=abcdef", "password=ab password=abcdef", "token: token=abcdef", 'API_KEY" = "abc/def=',
        "AKIA" + "A" * 15, "AKIA" + "A" * 16, "a" * 23, "a" * 24, "secret==abcde", "token='abc", "",
    ]
    got = result(make(texts))
    assert got[0][4] == "assign:2:14"
    assert got[1][4] == "assign:12:27"
    assert got[2][4] == brute(texts[2])[4]
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_tokens_with_checksums_are_added(make):
    forge = crc_token("ghp_", "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5")
    package = crc_token("npm_", "Zz9Yy8Xx7Ww6Vv5Uu4Tt3Ss2Rr1Qq0")
    wallet = base58_token(bytes.fromhex("0488ade4") + bytes(range(74)))
    assert len(forge) == len(package) == 40 and len(wallet) == 111 and wallet.startswith("xprv")
    for n, (kind, token) in enumerate([("forge", forge), ("package", package), ("wallet", wallet), ("age", AGE), ("note", NOTE)]):
        wrong = token[:-1] + ("q" if token[-1] != "q" else "p")
        wrong = wrong.upper() if kind == "age" else wrong
        texts = [f"é {token} x", token, f"{wrong}", f"{token}_", token[:-1], f"{token} {token}", f"{token.swapcase()}", f"token={token}"]
        got = result(make(texts))
        base = {i: brute(t) for i, t in enumerate(texts)}
        size = len(token)
        assert {i: g[:4] for i, g in got.items()} == {i: b[:4] for i, b in base.items()}, n
        added = {i: [s for s in g[4].split(",") if s.startswith(kind)] for i, g in got.items()}
        assert added[0] == [f"{kind}:2:{2 + size}"]
        assert added[1] == [f"{kind}:0:{size}"]
        assert added[5] == [f"{kind}:0:{size}", f"{kind}:{size + 1}:{2 * size + 1}"]
        assert not (added[2] or added[3] or added[4] or added[6])
        assert got[7][4].split(",")[0].startswith("assign:0:") and added[7] == [f"{kind}:6:{6 + size}"]


@pytest.mark.parametrize("check, token", [
    (secret_scan.bech32_check, AGE), (secret_scan.bech32_check, NOTE),
    (secret_scan.base58_check, "5HueCGU8rMjxEXxiPuD5BDku4MkFqeZyd4dZ1jvhTVqvbTLvyTJ"),
])
def test_checksums_of_published_examples(check, token):
    assert check(token)
    for i in range(len(token) - 8, len(token)):
        other = "q" if token[i].lower() != "q" else "z"
        changed = token[:i] + (other.upper() if token.isupper() else other) + token[i + 1 :]
        assert not check(changed)


def test_hard_rows(hard, empty):
    got = secret_scan.scan(hard).collect()
    assert sorted((str(r["doc_id"]), r["spans"]) for r in got) == sorted(
        (str(r["doc_id"]), brute(r["text"])[4]) for r in hard.select("doc_id", "text").collect()
    )
    out = secret_scan.scan(empty)
    assert out.count() == 0
    assert out.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"]


def test_long_texts_are_read_once(make):
    text = "token " * 200_000 + "a" * 1_000_000 + " AKIA" * 100_000 + "password=" + "x" * 500_000
    assert result(make([text])) == {0: brute(text)}
