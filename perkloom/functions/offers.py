"""Reading a one-line deal, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from perkloom.functions import fixed_values as V
from perkloom.functions.text import trim_all


def _wide(pattern: str) -> str:
    """White space in the vocabularies includes the no-break space."""
    return pattern.replace(r"\s", r"[\s\u00a0]")


def says(text: Column, pattern: str) -> Column:
    return text.rlike(_wide(pattern))


def stated_end(text: Column) -> Column:
    """Instant of a stated "until d/m/y"; null unless it is a real date."""
    part = lambda i: F.regexp_extract(text, _wide(V.UNTIL_DATE), i)
    year = F.when(F.length(part(3)) == 2, F.concat(F.lit("20"), part(3))).otherwise(part(3))
    stamp = F.concat(
        F.lpad(year, 4, "0"), F.lit("-"), F.lpad(part(2), 2, "0"), F.lit("-"),
        F.lpad(part(1), 2, "0"), F.lit(f" {V.UNTIL_TIME}Z"),
    )
    return F.when(part(1) != "", F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ssX")))


def deal_segment(text: Column) -> Column:
    """The part of a bulleted line that states the offer; null if none does.

    Labels such as "100% vegan" carry figures too, so a figure counts only next to
    discount wording, or bare in a segment that is no label.
    """
    segments = F.filter(
        F.transform(F.split(text, V.SEGMENT_MARK), trim_all), lambda s: s != ""
    )
    worded = F.filter(segments, lambda s: says(s, V.DISCOUNT_WORDS) & s.rlike("[0-9]"))
    bare = F.filter(
        segments,
        lambda s: (s.rlike("[%₪]") | says(s, V.SHEKEL_FIGURE))
        & s.rlike("[0-9]")
        & ~says(s, V.LABEL_WORDS),
    )
    return F.coalesce(
        F.get(worded, F.lit(0)),
        F.get(bare, F.lit(0)),
        F.when((F.size(segments) <= 1) & says(text, V.DISCOUNT_WORDS), text),
        F.when(says(text, V.BOGO_WORDS), text),
    )


def plain_text(deal: Column) -> Column:
    """The deal without quoted spans: figures there belong to a product name."""
    for quoted in V.QUOTED_SPANS:
        deal = F.regexp_replace(deal, quoted, " ")
    return deal


def percent_figure(plain: Column) -> Column:
    return F.nullif(F.regexp_extract(plain, _wide(V.PERCENT_FIGURE), 1), F.lit(""))


def shekel_figure(plain: Column) -> Column:
    sums = [F.regexp_extract(plain, _wide(V.SHEKEL_FIGURE), i) for i in (1, 2)]
    return F.coalesce(*[F.nullif(s, F.lit("")) for s in sums]).cast("double")


def several_sums(text: Column) -> Column:
    """More than one sum, or "from": the saving is not any of the figures."""
    each = F.regexp_count(text, F.lit(_wide(V.SHEKEL_EACH)))
    return (each > 1) | text.contains(V.FROM_WORDS)
