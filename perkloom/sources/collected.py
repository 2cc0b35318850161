"""Collected offers: tolerant readers and the raw-listing projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from perkloom.functions import fixed_values as V
from perkloom.operators.ingest import last_per
from perkloom.schemas import COLLECTED, EXTRACTION_RESULT

_BAD = "_bad"


def read_lines(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """Lines with ``line_no``, which orders them within a list, and ``list``, the
    file's name without its ending.

    Files are split as usual: the split's offset and the position in the split
    together give the order, so no file is read whole by one task. With ``parts`` a list is a
    folder of numbered parts, as a sorted table is written, and the part comes first in the order.
    """
    meta = F.col("_metadata")
    part = F.regexp_extract(meta.file_name, r"^part-(\d+)", 1).cast("int")
    folder = F.regexp_extract(meta.file_path, "([^/]+)/[^/]+$", 1)
    return (
        spark.read.text(path)
        .withColumn("_part", part if parts else F.lit(0))
        .withColumn("_start", meta.file_block_start)
        .withColumn("list", folder if parts else F.regexp_replace(meta.file_name, r"\.[^.]*$", ""))
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        # Offsets and row positions both grow along the file.
        .withColumn("line_no", F.struct("_part", "_start", "_row"))
        .drop("_part", "_start", "_row")
    )


def parse_records(lines: DataFrame) -> DataFrame:
    """Records of JSON lines. Blank and unparseable lines are skipped, and so are
    records without an address or text."""
    with_bad = StructType([*COLLECTED.fields, StructField(_BAD, StringType())])
    parsed = F.from_json(
        "value", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    )
    return (
        lines.where(F.trim("value") != "")
        .withColumn("r", parsed)
        .where(f"r.{_BAD} IS NULL AND r.offer_url <> '' AND r.terms_text <> ''")
        .select("list", "line_no", "r.*")
        .drop(_BAD)
    )


def read_collected(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """One record per address of a list: the last line wins."""
    return last_per(parse_records(read_lines(spark, path, parts)), ["list", "offer_url"], "line_no")


def dedupe_collected(records: DataFrame, order: str = "line_no") -> DataFrame:
    whole = records.where("offer_url <> '' AND terms_text <> ''")
    return last_per(whole, ["offer_url"], order)


def list_programs(spark: SparkSession, mapping: dict[str, str] | None = None) -> DataFrame:
    """(list, program_id) for the lists whose program is known."""
    return spark.createDataFrame(
        list((mapping or V.LIST_PROGRAMS).items()), "list string, program_id string"
    )


def with_program(records: DataFrame, programs: DataFrame) -> DataFrame:
    """Records of mapped lists with their program; other lists are skipped."""
    return records.join(programs, "list")


def from_listing(rows: DataFrame) -> DataFrame:
    """Raw listing rows to collected records.

    ``rows``: list, id, bizname, category, bestsubcat, address. Only rows whose
    subtitle states a deal are kept.
    """
    headline = F.coalesce("bestsubcat", F.lit(""))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit(V.RECORD_MERCHANT), "bizname"),
        F.concat(F.lit(V.RECORD_CATEGORY), F.coalesce("category", F.lit(""))),
        F.concat(F.lit(V.RECORD_HEADLINE), headline),
        F.when(F.col("address") != "", F.concat(F.lit(V.RECORD_ADDRESS), "address")),
    )
    return (
        rows.where(headline.rlike(V.DEAL_WORDS))
        .withColumn("terms_text", text)
        .select(
            F.lit(V.RECORD_SITE).alias("site"),
            F.col("list").alias("category"),
            F.concat(F.lit(V.RECORD_URL), F.col("id").cast("string")).alias("offer_url"),
            F.col("bizname").alias("merchant_name"),
            headline.alias("listing_headline"),
            "terms_text",
            F.sha2("terms_text", 256).alias("content_hash"),
        )
    )


def read_extraction(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Extraction results, one row per offer: a result a file, or with ``lines`` a result a line,
    where files are split."""
    files = spark.read.schema(EXTRACTION_RESULT).option("mode", "FAILFAST").json(path, multiLine=not lines)
    return files.select(
        F.col("_metadata.file_name").alias("file"), F.posexplode("benefits").alias("seq", "b")
    ).select("file", "seq", "b.*")


def select_program(sources: DataFrame, program_id: str | None) -> DataFrame:
    """Sources of one program, or all; choosing none is an error."""
    chosen = sources if program_id is None else sources.where(F.col("program_id") == program_id)
    if chosen.isEmpty():
        raise ValueError(f"no sources matched program {program_id}")
    return chosen
