"""Secret scans: keyword automaton, anchored patterns near its hits, embedded checksums.

One Aho-Corasick automaton finds all keywords of a text in a single pass. Only where a keyword
stands is a pattern tried, anchored at that place; texts without any keyword are done after the
pass. Long runs of hexadecimal digits have no keyword and are found as runs. Kinds whose tokens
carry a checksum are only reported where it holds, so look-alikes stay out.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable
from functools import cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perkloom.llm.common import documents, whole_text

# Alphabets and prefixes of public token formats.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_STEPS = [0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3]

MIN_HEX = 24
MIN_ACCESS = 20
MIN_VALUE = 6
HEX = re.compile(r"[0-9a-f]{%d,}" % MIN_HEX)
ASSIGN = re.compile(
    r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)


def crc_tail(token: str) -> bool:
    """The last six characters are the CRC-32 of what stands between prefix and them, in base 62."""
    body, tail = token[token.index("_") + 1 : -6], token[-6:]
    value = 0
    for c in tail:
        value = value * 62 + BASE62.index(c)
    return value == zlib.crc32(body.encode())


def base58_check(token: str) -> bool:
    """The last four of the decoded bytes start the double SHA-256 of the others."""
    value = 0
    for c in token:
        value = value * 58 + BASE58.index(c)
    ones = len(token) - len(token.lstrip("1"))
    raw = b"\0" * ones + value.to_bytes((value.bit_length() + 7) // 8, "big")
    return len(raw) > 4 and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def bech32_check(token: str) -> bool:
    """The checksum of a bech32 string, which is all in upper or all in lower case."""
    name, _, data = token.lower().rpartition("1")
    value = 1
    for v in [ord(c) >> 5 for c in name] + [0] + [ord(c) & 31 for c in name] + [BECH32.index(c) for c in data]:
        top, value = value >> 25, (value & 0x1FFFFFF) << 5 ^ v
        for i, step in enumerate(BECH32_STEPS):
            value ^= step if top >> i & 1 else 0
    return value == 1


class Kind(NamedTuple):
    name: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    holds: Callable[[re.Match], bool]
    any_case: bool = False


def _bounded(body: str) -> re.Pattern:
    """A token that does not go on in letters, digits or underscores."""
    return re.compile(body + r"(?![A-Za-z0-9_])")


KINDS = [
    Kind("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"), ASSIGN,
         lambda m: m.end(1) - m.start(1) >= MIN_VALUE, True),
    Kind("access", ("AKIA",), re.compile("AKIA[A-Z0-9]+"), lambda m: m.end() - m.start() >= MIN_ACCESS),
    Kind("hex", (), HEX, lambda m: True),
    # Added: tokens with a checksum of their own.
    Kind("forge", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), _bounded("gh[pousr]_[A-Za-z0-9]{36}"),
         lambda m: crc_tail(m[0])),
    Kind("package", ("npm_",), _bounded("npm_[A-Za-z0-9]{36}"), lambda m: crc_tail(m[0])),
    Kind("wallet", ("xprv", "yprv", "zprv", "tprv"), _bounded(f"[xyzt]prv[{BASE58}]{{107}}"),
         lambda m: base58_check(m[0])),
    Kind("age", ("AGE-SECRET-KEY-1",), _bounded(f"AGE-SECRET-KEY-1[{BECH32.upper()}]{{58}}"),
         lambda m: bech32_check(m[0])),
    Kind("note", ("nsec1",), _bounded(f"nsec1[{BECH32}]{{58}}"), lambda m: bech32_check(m[0])),
]
BASE = 3


class Span(NamedTuple):
    start: int
    kind: int
    end: int


@cache
def automaton():
    """Every keyword in lower case, with its length and (kind, keyword where its case matters)."""
    import ahocorasick

    by_word = {}
    for k, kind in enumerate(KINDS):
        for word in kind.keywords:
            by_word.setdefault(word.lower(), []).append((k, None if kind.any_case else word))
    found = ahocorasick.Automaton()
    for word, of in by_word.items():
        found.add_word(word, (len(word), of))
    found.make_automaton()
    return found


def lowered(text: str) -> str:
    """A-Z in lower case; every code point keeps its place."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def spans(text: str) -> list[Span]:
    """All secrets of a text by start, then kind. Of each kind, leftmost matches that do not overlap;
    one that fails its test is dropped and not tried again."""
    hits = [[] for _ in KINDS]
    for last, (length, of) in automaton().iter(lowered(text)):
        start = last + 1 - length
        for k, word in of:
            if word is None or text.startswith(word, start):
                hits[k].append(start)
    found = [Span(m.start(), k, m.end()) for k, kind in enumerate(KINDS) if not kind.keywords
             for m in kind.pattern.finditer(text) if kind.holds(m)]
    for k, kind in enumerate(KINDS):
        done = 0
        for start in sorted(hits[k]):
            if start >= done and (m := kind.pattern.match(text, start)):
                done = m.end()
                if kind.holds(m):
                    found.append(Span(start, k, done))
    return sorted(found)


def written(found: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind].name}:{s.start}:{s.end}" for s in found)


FOUND = (
    "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, "
    "found array<struct<kind:string,start:int,end:int>>"
)


def scan(docs: DataFrame) -> DataFrame:
    """Secrets of every whole text, well-formed ones and tokens whose checksum holds.

    Returns one row per input row: ``doc_id``, ``n_assign``, ``n_access``, ``n_hex`` (base kinds),
    ``base_sha256`` (of kind:start:end of those, by start, then kind), ``spans`` (all, so written) and
    ``found`` (all, as structures). Places are code points, ends exclusive. Null texts are empty; a
    text of any length is read whole, in one pass; repeated rows and rows without doc_id each give
    a row. Extra columns are ignored; an empty table gives an empty result. No shuffle."""

    @F.pandas_udf(FOUND)
    def find(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            found = spans(text)
            base = [s for s in found if s.kind < BASE]
            rows.append([
                *(sum(s.kind == k for s in base) for k in range(BASE)),
                hashlib.sha256(written(base).encode()).hexdigest(), written(found),
                [{"kind": KINDS[s.kind].name, "start": s.start, "end": s.end} for s in found],
            ])
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"])

    return docs.select("doc_id", find(whole_text()).alias("f")).select("doc_id", "f.*")


def op13_secrets(spark, sf_dir):
    return scan(documents(spark, sf_dir)).drop("found")
