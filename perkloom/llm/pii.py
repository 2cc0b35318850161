"""Personal data by bootstrapped contextual extraction.

Well-formed identifiers (e-mail, IP address, payment card, phone) are the seeds. The words
around a seed are its patterns. Spark holds the graph of patterns and the distinct values
seen in them: a pattern is as good as the share of its values that are seeds or already
trusted, a value is as good as its patterns together. After a few rounds the patterns of high
confidence mark further identifiers, of a looser form, that stand in them. Seeds are always
kept.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perkloom.llm.common import documents, stored, whole_text

KINDS = ["email", "ip", "card", "phone"]
ROUNDS = 3
MIN_SUPPORT = 3  # distinct trusted values a pattern needs
MIN_CONFIDENCE = 0.8
CONTEXT = 48  # code points looked at on either side

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is tried from its start only: what fails there fails further in.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HOST = re.compile(r"[A-Za-z0-9-]+")
HEX_IP = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])")
GROUPED = re.compile(r"(?<![0-9A-Za-z+])\(?[0-9][0-9().\x20-]*[0-9](?![0-9A-Za-z])")
WORDS = re.compile(r"\w+")
DIGITS = re.compile("[0-9]")


class Span(NamedTuple):
    kind: int
    start: int
    end: int


def _digits(text: str) -> str:
    return "".join(DIGITS.findall(text))


def _luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) * (1 + n % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _addresses(text: str, domain: re.Pattern) -> list[tuple[int, int]]:
    """Leftmost matches of LOCAL+ @ domain. What stands before an @ is the longest run of
    local characters that the match before has left, so each @ is looked at once."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        start = done + len(before.rstrip(LOCAL))
        m = domain.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            done = m.end()
        # Characters before this @ belong to no later match.
        done = max(done, at + 1)
        at = text.find("@", done)
    return found


def base_spans(text: str) -> list[Span]:
    """Well-formed identifiers, by kind, then start: leftmost non-overlapping matches per kind,
    less those that fail the kind's test."""
    spans = [Span(0, a, b) for a, b in _addresses(text, DOMAIN)]
    spans += [Span(1, *m.span()) for m in IP.finditer(text) if all(map(_byte, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            spans.append(Span(2, *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            spans.append(Span(3, *m.span()))
    return spans


def loose_spans(text: str, base: list[Span]) -> list[Span]:
    """Places that could be identifiers of a kind but are not well-formed, clear of ``base``."""
    spans = [Span(0, a, b) for a, b in _addresses(text, HOST)]
    spans += [Span(1, *m.span()) for m in IP.finditer(text)]
    if ":" in text:
        spans += [Span(1, *m.span()) for m in HEX_IP.finditer(text)]
    for m in GROUPED.finditer(text):
        if m.end() - m.start() >= 7:
            n = len(_digits(m[0]))
            spans += [Span(2, *m.span())] * (12 <= n <= 19) + [Span(3, *m.span())] * (7 <= n <= 15)
    if not spans:
        return spans
    taken = sorted((s.start, s.end) for s in base)
    starts = [a for a, _ in taken]
    ends = []  # furthest end so far
    for _, b in taken:
        ends.append(max(b, ends[-1] if ends else 0))

    def free(s: Span) -> bool:
        i = bisect.bisect_left(starts, s.end)
        return i == 0 or ends[i - 1] <= s.start

    return [s for s in spans if free(s)]


def patterns(text: str, span: Span) -> list[str]:
    """The two words before, and one word on either side; digits count as one. A place without
    a word beside it has no pattern of that sort."""
    cut = max(0, span.start - CONTEXT)
    left = WORDS.findall(text[cut : span.start].lower())
    if cut and len(left) > 2:
        left = left[1:]  # may have been cut
    right = WORDS.findall(text[span.end : span.end + CONTEXT].lower())
    left, right = [[DIGITS.sub("0", w) for w in side] for side in (left[-2:], right[:1])]
    found = []
    if len(left) == 2:
        found.append(f"{left[0]} {left[1]} _")
    if left and right:
        found.append(f"{left[-1]} _ {right[0]}")
    return found


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in sorted(spans))


FOUND = (
    "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, "
    "base array<struct<kind:int,start:int,end:int>>, "
    "places array<struct<kind:int,start:int,end:int,value:string,seed:boolean,patterns:array<string>>>"
)


def places(docs: DataFrame) -> DataFrame:
    """(doc_id, FOUND): seeds of every whole text, and all places with their patterns."""

    @F.pandas_udf(FOUND)
    def find(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            base = sorted(base_spans(text))
            at = [(s, True) for s in base] + [(s, False) for s in loose_spans(text, base)]
            rows.append([
                *(sum(s.kind == k for s in base) for k in range(len(KINDS))),
                hashlib.sha256(written(base).encode()).hexdigest(),
                [s._asdict() for s in base],
                [s._asdict() | {"value": text[s.start : s.end].lower(), "seed": seed, "patterns": patterns(text, s)}
                 for s, seed in at],
            ])
        columns = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "places"]
        return pd.DataFrame(rows, columns=columns)

    return docs.select("doc_id", find(whole_text()).alias("f")).select("doc_id", "f.*")


def trusted_patterns(
    found: DataFrame, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """(kind, pattern, confidence) of the patterns to extract with.

    Every round scores the patterns from the values and the values from the patterns, by
    joins and sums over the distinct edges of the graph."""
    edges = stored(
        found.select(F.explode("places").alias("p"))
        .select("p.kind", "p.value", "p.seed", F.explode("p.patterns").alias("pattern"))
        .distinct(), "edges",
    )
    one_pattern = ["kind", "pattern"]

    def scored(values: DataFrame) -> DataFrame:
        totals = values.groupBy(*one_pattern).agg(
            F.sum("score").alias("trust"), F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("score") >= min_confidence).alias("support"),
        )
        return totals.where(F.col("support") >= min_support).select(
            *one_pattern, (F.col("trust") / F.col("n")).alias("confidence")
        )

    # A value is an identifier of one kind; a seed of another kind counts against a pattern.
    kinds = edges.select("pattern", F.explode(F.array(*[F.lit(k) for k in range(len(KINDS))])).alias("kind"),
                         F.col("kind").alias("own"), "value", "seed")
    kinds = kinds.where("own = kind or seed").withColumn("seed", F.col("seed") & (F.col("own") == F.col("kind")))
    kinds = kinds.groupBy("kind", "pattern", "value").agg(F.max("seed").alias("seed"))
    graph = stored(kinds, "graph")
    values = graph.withColumn("score", F.col("seed").cast("double"))
    best = stored(scored(values), "patterns")
    for _ in range(rounds - 1):
        believed = graph.where("not seed").join(best, one_pattern).groupBy("kind", "value").agg(
            (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))).alias("_belief")
        )
        values = graph.join(believed, ["kind", "value"], "left").withColumn(
            "score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("_belief", F.lit(0.0)))
        )
        best = stored(scored(values), "patterns")
    return best.where(F.col("confidence") >= min_confidence)


def personal_data(docs: DataFrame, **options) -> DataFrame:
    """Identifiers of every whole text, well-formed ones and those found by their context.

    Returns one row per input row: ``doc_id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``
    (well-formed), ``base_sha256`` (of kind:start:end of those, by kind and start), ``spans`` (all, so
    written) and ``n_found`` (added by context). Null texts are empty; a place that several kinds
    claim goes to the pattern of most confidence. Rows with equal or null ids are kept apart.
    Extra columns are ignored; an empty table gives an empty result."""
    found = stored(
        places(docs).withColumn("row", F.monotonically_increasing_id()), "places"
    )
    trusted = trusted_patterns(found, **options)
    loose = (
        found.select("row", F.explode("places").alias("p")).where("not p.seed")
        .select("row", "p.kind", "p.start", "p.end", F.explode("p.patterns").alias("pattern"))
    )
    added = (
        loose.join(trusted, ["kind", "pattern"])
        .groupBy("row", "start", "end")
        .agg(F.max(F.struct("confidence", (-F.col("kind")).alias("kind"))).alias("best"))
        .groupBy("row").agg(F.collect_list(F.struct(
            (-F.col("best.kind")).alias("kind"), "start", "end")).alias("added"))
    )
    everything = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(
        "array<struct<kind:int,start:int,end:int>>"))))
    written_out = F.transform(everything, lambda s: F.concat_ws(
        ":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1), s["start"], s["end"]))
    return found.drop("places").join(added, "row", "left").select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256",
        F.array_join(written_out, ",").alias("spans"),
        F.coalesce(F.size("added"), F.lit(0)).alias("n_found"),
    )


def op4_pii(spark, sf_dir):
    return personal_data(documents(spark, sf_dir))
