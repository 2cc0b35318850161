"""Pages to accepted text, with the reason for each page left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perkloom.functions import fixed_values as V
from perkloom.functions import pages as fn


def decode_pages(raw: DataFrame, head_bytes: int | None = None) -> DataFrame:
    """``body`` (binary) and ``content_type`` to ``charset`` and ``html``."""
    stated = fn.charset(F.col("content_type"), F.col("body"), head_bytes)
    return raw.withColumn("charset", stated).withColumn(
        "html", fn.decode_bytes(F.col("body"), F.col("charset"))
    )


def refine(pages: DataFrame, structured_limit: int | None = None) -> DataFrame:
    """Adds ``text``, the quality figures and ``problem`` (null = accepted)."""
    structured = fn.json_ld_text(F.col("html"), structured_limit)
    body = fn.html_to_text(F.col("html"))
    read = pages.withColumns({"_ld": structured, "_body": body})
    # Unpacked from a one-element array: a filter on what follows from the text then
    # stays above it instead of reading the page twice.
    text = F.explode(F.array(fn.page_text(F.col("_ld"), F.col("_body"))))
    with_text = read.withColumn("text", text).drop("_ld", "_body")
    return with_text.withColumns(fn.quality(F.col("html"), F.col("text"))).withColumn(
        "problem", fn.diagnosis()
    )


def accepted(refined: DataFrame, limit: int | None = None) -> DataFrame:
    """Pages worth reading on; their text whole unless a limit is given."""
    return refined.where("problem IS NULL").withColumn("text", fn.bounded(F.col("text"), limit))


def rejected(refined: DataFrame) -> DataFrame:
    return refined.where("problem IS NOT NULL")


def offer_page_text(records: DataFrame) -> DataFrame:
    """``page_text`` of a collected record: the binding section leads, the whole
    body always follows."""
    sections = F.map_entries(F.coalesce("sections", F.create_map().cast("map<string,string>")))
    named = lambda e: F.concat(e["key"], F.lit(":\n"), e["value"])
    filled = lambda e: e["value"].isNotNull()
    binding = F.filter(
        sections, lambda e: (e["key"] == V.BINDING_HEADING) & (F.coalesce(e["value"], F.lit("")) != "")
    )
    others = F.filter(sections, lambda e: (e["key"] != V.BINDING_HEADING) & filled(e))
    stated = lambda column, label: F.when(
        F.col(column) != "", F.concat(F.lit(label), F.col(column))
    )
    return records.withColumn(
        "page_text",
        F.concat_ws(
            "\n\n",
            stated("merchant_name", V.PAGE_MERCHANT),
            stated("listing_headline", V.PAGE_HEADLINE),
            F.transform(binding, named),
            F.transform(others, named),
            F.concat(F.lit(V.PAGE_BODY), F.col("terms_text")),
        ),
    )
