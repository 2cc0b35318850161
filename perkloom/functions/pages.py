"""Raw page bytes to readable text, as Column expressions.

Two steps have no built-in form and run as Arrow-batched UDFs: charsets other than
UTF-8, and collecting the string leaves of JSON of any depth.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Callable
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from perkloom.functions import fixed_values as V
from perkloom.functions.text import trim_all

UTF8 = ("utf-8", "utf8", "unicode-1-1-utf-8")
# Labels the web reads as windows-1252.
LATIN = ("iso-8859-1", "latin1", "iso8859-1", "us-ascii", "ascii", "windows-1252", "cp1252")


# --- charset ------------------------------------------------------------------
def charset(content_type: Column, body: Column, head_bytes: int | None = None) -> Column:
    """Header, else the meta tag (in the first ``head_bytes``, if given), else utf-8."""
    head = F.decode(body if head_bytes is None else F.substring(body, 1, head_bytes), "ISO-8859-1")
    in_header = F.regexp_extract(content_type, V.CHARSET_IN_HEADER, 1)
    in_meta = F.regexp_extract(head, V.CHARSET_IN_META, 1)
    stated = F.coalesce(
        F.when(in_header != "", in_header), F.when(in_meta != "", in_meta), F.lit("utf-8")
    )
    return F.lower(stated)


def _decode_one(body, label: str):
    if body is None:
        return None
    name = "cp1252" if label in LATIN else label
    try:
        codecs.lookup(name)
    except LookupError:
        name = "utf-8"
    return bytes(body).decode(name, errors="replace")


@F.pandas_udf(StringType())
def _decode_other(body: pd.Series, label: pd.Series) -> pd.Series:
    return pd.Series([_decode_one(b, c) for b, c in zip(body, label)])


def decode_bytes(body: Column, label: Column) -> Column:
    """Bytes to text; bytes that do not fit become the replacement mark. UTF-8 stays
    in the JVM, and an unknown label is read as UTF-8."""
    is_utf8 = label.isin(*UTF8)
    other = _decode_other(F.when(~is_utf8, body), F.when(~is_utf8, label))
    return F.when(is_utf8, F.make_valid_utf8(body.cast("string"))).otherwise(other)


# --- entities -------------------------------------------------------------------
def _code_point(number: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, the value worked out once however often it is used: functions over arrays
    are not searched for common parts, and steps that use their input twice would double at each step."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _numeric_entities(text: Column, pattern: str, base: int) -> Column:
    """Replace each distinct reference; the ampersand last, so that no reference
    formed by a replacement is read again."""

    def number(entity: Column) -> Column:
        digits = F.regexp_replace(entity, "[&#xX;]", "")
        short = F.length(F.regexp_replace(digits, "^0+", "")) <= 7
        return F.when(short, F.conv(digits, base, 10).cast("bigint"))

    def read(text: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        valid = F.filter(
            found,
            lambda e: (number(e) <= 0x10FFFF) & ~number(e).between(0xD800, 0xDFFF),
        )
        ordered = F.sort_array(F.transform(
            valid, lambda e, i: F.struct((number(e) == 38).alias("last"), i.alias("at"), e.alias("entity"))
        ))
        replaced = F.aggregate(
            ordered, text,
            lambda acc, e: F.replace(acc, e["entity"], _code_point(number(e["entity"]))),
        )
        return F.when(F.contains(text, F.lit("&#")), replaced).otherwise(text)

    return _once(text, read)


def _named_entities(text: Column, names: list[str]) -> Column:
    """Replace each distinct reference; none of ``names`` stands for nothing or the ampersand, so
    no reference is formed, and their order is free."""
    marks = F.create_map(*[F.lit(x) for n in names for x in (f"&{n};", V.NAMED_ENTITIES[n])])

    def read(text: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(f"&(?i:{'|'.join(names)});"), F.lit(0))
        replaced = F.aggregate(
            F.array_distinct(found), text, lambda acc, e: F.replace(acc, e, marks[F.lower(e)])
        )
        return F.when(F.contains(text, F.lit("&")), replaced).otherwise(text)

    return _once(text, read)


def decode_entities(text: Column) -> Column:
    """Hexadecimal, then decimal, then the named references; others stay."""
    out = _numeric_entities(text, "&#[xX][0-9a-fA-F]+;", 16)
    out = _numeric_entities(out, "&#[0-9]+;", 10)
    names = [n for n in V.NAMED_ENTITIES if n != "amp"] + ["amp"]
    # Where one stands for nothing or the ampersand, what it leaves may form others: those keep their turn.
    for alone, group in groupby(names, lambda n: n if V.NAMED_ENTITIES[n] in ("", "&") else None):
        if alone is None:
            out = _named_entities(out, list(group))
        else:
            out = F.regexp_replace(out, f"&(?i:{alone});", F.lit(V.NAMED_ENTITIES[alone]))
    return out


# --- text -----------------------------------------------------------------------
def html_to_text(html: Column) -> Column:
    """Readable text with block boundaries kept as line breaks."""
    out = html
    for tag in V.DROPPED_ELEMENTS:
        out = F.regexp_replace(out, V.DROPPED_ELEMENT.replace("{tag}", tag), " ")
    out = F.regexp_replace(out, V.COMMENT, " ")
    out = F.regexp_replace(out, V.BLOCK_END, "\n")
    out = decode_entities(F.regexp_replace(out, V.ANY_TAG, " "))
    out = F.regexp_replace(out, V.SPACE_RUN, " ")
    out = F.array_join(F.transform(F.split(out, "\n"), trim_all), "\n")
    return trim_all(F.regexp_replace(out, V.BLANK_LINES, "\n\n"))


# --- JSON-LD --------------------------------------------------------------------
_SKIP = re.compile(V.JSON_LD_SKIP)


def _leaves(node, out: dict) -> None:
    if isinstance(node, str):
        value = node.strip()
        if V.JSON_LD_MIN <= len(value) and not _SKIP.match(value):
            out[value] = None
    elif isinstance(node, list):
        for item in node:
            _leaves(item, out)
    elif isinstance(node, dict):
        for key, item in node.items():
            if not key.startswith("@"):
                _leaves(item, out)


@F.pandas_udf(ArrayType(StringType()))
def _string_leaves(blocks: pd.Series) -> pd.Series:
    def read(texts):
        out: dict[str, None] = {}
        for text in texts if texts is not None else []:
            try:
                _leaves(json.loads(text), out)
            except ValueError:
                continue  # a malformed block does not cost the rest of the page
        return list(out)

    return blocks.map(read)


def json_ld_text(html: Column, limit: int | None = None, longest: int | None = None) -> Column:
    """Unique readable strings of the page's structured data, cut at ``limit`` if given; without
    those of over ``longest`` characters, if given."""
    blocks = F.transform(
        F.regexp_extract_all(html, F.lit(V.JSON_LD_BLOCK), F.lit(1)),
        lambda b: decode_entities(trim_all(b)),
    )
    # Most pages have no such block; they never reach Python with any payload.
    leaves = _string_leaves(F.when(F.size(blocks) > 0, blocks))
    if longest is not None:
        leaves = F.filter(leaves, lambda s: F.length(s) <= longest)
    joined = F.array_join(leaves, " · ")
    text = F.coalesce(joined, F.lit(""))
    if limit is None:
        return text
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))
    ).otherwise(text)


# --- quality --------------------------------------------------------------------
def quality(html: Column, text: Column) -> dict[str, Column]:
    html_chars, text_chars = F.length(html), F.length(text)
    return {
        "html_chars": html_chars,
        "text_chars": text_chars,
        "text_ratio": F.when(html_chars == 0, F.lit(0.0)).otherwise(text_chars / html_chars),
        "offer_terms": F.regexp_count(text, F.lit(V.OFFER_TERMS)),
    }


def diagnosis() -> Column:
    """Why a page is not worth reading, the first reason that applies; null if it is."""
    html, text = F.col("html_chars"), F.col("text_chars")
    return (
        F.when(
            text < V.TEXT_FLOOR,
            F.format_string(V.SAY_TOO_SHORT, text),
        )
        .when(
            (html > V.SHELL_HTML) & (F.col("text_ratio") < V.SHELL_RATIO) & (text < V.SHELL_TEXT),
            F.format_string(V.SAY_SHELL, html, text),
        )
        .when(
            F.col("offer_terms") < V.TERMS_FLOOR,
            F.format_string(V.SAY_NO_TERMS, text),
        )
    )


def page_text(structured: Column, body: Column) -> Column:
    return F.when(structured != "", F.concat(structured, F.lit("\n\n"), body)).otherwise(body)


def bounded(text: Column, limit: int | None = None) -> Column:
    """The text handed on, cut with a visible mark beyond the limit if one is given."""
    if limit is None:
        return text
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(V.PAGE_TEXT_MARK))
    ).otherwise(text)
