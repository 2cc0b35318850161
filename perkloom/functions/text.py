"""Names, slugs and stable ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from perkloom.functions import fixed_values as V
from perkloom.functions.money import number_text

SPACE_EDGES = r"^[\s\u00a0\ufeff]+|[\s\u00a0\ufeff]+$"


def trim_all(text: Column) -> Column:
    """Trim every kind of white space, not only the ASCII blank."""
    return F.regexp_replace(text, "(?U)" + SPACE_EDGES, "")


def name_key(name: Column) -> Column:
    """The form two merchant names are compared in."""
    return F.regexp_replace(F.lower(name), "(?U)" + V.NAME_NOISE, "")


def slug(name: Column) -> Column:
    """Lower-case letters and digits of any script, joined by single underscores."""
    joined = F.regexp_replace(F.lower(trim_all(name)), V.NOT_IN_SLUG, "_")
    return F.regexp_replace(joined, "^_|_$", "")


def list_program_id(list_slug: Column) -> Column:
    """Program id of a list: camel case and punctuation become underscores."""
    split = F.regexp_replace(list_slug, V.CAMEL_BREAK, "$1_$2")
    joined = F.regexp_replace(split, V.NOT_IN_PROGRAM_ID, "_")
    return F.lower(F.regexp_replace(joined, "^_|_$", ""))


def benefit_id(program: Column, merchant: Column, type_: Column, value: Column) -> Column:
    """Id of an offer from its identity, so a re-crawl lands on the same row."""
    digest = F.sha2(F.concat_ws("|", program, merchant, type_, number_text(value)), 256)
    return F.concat_ws("_", program, merchant, F.substring(digest, 1, 12))
