"""Exact dedup by content-defined chunk recipes.

A text, without white space, is cut where its own bytes say so. Chunks are deduplicated
to verified identifiers: a 64-bit hash, plus a rank where different chunks turn out to
share a hash, which is found by comparing contents, not assumed away. A text is then its
recipe, the ordered list of chunk identifiers, and equal recipes are equal texts. Long
texts are moved once, as distinct chunks; everything after that moves recipes.

Main path: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perkloom.llm.common import SPACE, stored, whole_text

MIN_CHUNK, MAX_CHUNK = 256, 4096


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, "")


def chunk_pattern(minimum: int = MIN_CHUNK, maximum: int = MAX_CHUNK) -> str:
    """A chunk ends after two characters in a row whose low bits are 2 or 7 of 8 (one place
    in sixteen), at ``minimum`` characters or more, or after ``maximum``. The classes cover
    the first 384 code points; scripts beyond them are cut at ``maximum``."""
    ends = "".join(f"\\x{{{c:x}}}" for c in range(0x180) if c % 8 in (2, 7))
    return f"(?s).{{{minimum},{maximum}}}?(?<=[{ends}][{ends}])|.{{1,{maximum}}}"


def chunks(text: Column, minimum: int = MIN_CHUNK, maximum: int = MAX_CHUNK) -> Column:
    return F.regexp_extract_all(text, F.lit(chunk_pattern(minimum, maximum)), F.lit(0))


def chunk_hash(chunk: Column, bits: int = 64) -> Column:
    h = F.xxhash64(chunk)
    return h if bits == 64 else F.shiftrightunsigned(h, 64 - bits)


def chunk_store(rows: DataFrame, bits: int = 64) -> DataFrame:
    """Every distinct chunk once: ``hash``, ``chunk``. Equal chunks of one task meet before
    the shuffle, so a passage that all documents share travels once per task."""
    each = rows.select(F.explode("chunks").alias("chunk"))
    return each.select(chunk_hash(F.col("chunk"), bits).alias("hash"), "chunk").distinct()


def verified_ranks(store: DataFrame) -> DataFrame:
    """Chunks that share their hash with a different chunk: ``hash``, ``chunk``, ``rank``
    (from 0, by content). Empty unless hashes collide; only then are chunks moved again."""
    shared = stored(
        store.groupBy("hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"), "shared"
    )
    if shared.isEmpty():
        return shared.select("hash", F.lit("").alias("chunk"), F.lit(0).alias("rank"))
    by_content = store.join(shared, "hash").groupBy("hash").agg(
        F.array_sort(F.collect_list("chunk")).alias("_all")  # as long as the collision is wide
    )
    return stored(by_content.select("hash", F.posexplode("_all").alias("rank", "chunk")), "colliding")


def recipes(docs: DataFrame, bits: int = 64, keep_chunks: bool = True, **size: int) -> DataFrame:
    """One row per document: ``row`` (its number in the written table), ``doc_id``, ``n`` (code
    points of the original text), ``text_sha256``, ``recipe`` (ordered verified chunk identifiers).

    With ``keep_chunks`` texts are cut once: the written table is read for its chunks by one step
    and for its narrow columns by the others. Without, they are cut again and less is written."""
    cut = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        F.length(whole_text()).cast("bigint").alias("n"), normalised(whole_text()).alias("_norm"),
    ).select(
        "row", "doc_id", "n", F.sha2(F.col("_norm").cast("binary"), 256).alias("text_sha256"),
        chunks(F.col("_norm"), **size).alias("chunks"),
    ).withColumn("recipe", F.transform("chunks", lambda c: F.struct(
        chunk_hash(c, bits).alias("hash"), F.lit(0).alias("rank"))))
    if keep_chunks:
        cut = stored(cut, "cut")
        narrow = cut.drop("chunks")
    else:
        narrow = stored(cut.drop("chunks"), "cut")
    colliding = verified_ranks(chunk_store(cut, bits))
    if colliding.isEmpty():  # every identifier is verified as it stands
        return narrow
    named = cut if keep_chunks else stored(cut, "chunks")
    ranked = (
        named.select("row", F.posexplode("chunks").alias("pos", "chunk"))
        .withColumn("hash", chunk_hash(F.col("chunk"), bits))
        .join(colliding, ["hash", "chunk"])
        .groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("pos", "rank"))).alias("_ranks"))
    )
    fixed = named.drop("chunks").join(ranked, "row", "left").withColumn(
        "recipe",
        F.expr("transform(recipe, (r, i) -> named_struct('hash', r.hash, 'rank', coalesce(_ranks[i], 0)))"),
    )
    return stored(fixed.drop("_ranks"), "recipes")


def exact_dedup(docs: DataFrame, bits: int = 64, keep_chunks: bool = True, **size: int) -> DataFrame:
    """Which documents stay when texts are compared without white space.

    Returns one row per input row: ``doc_id``, ``keep_id`` (most code points in the original
    text, then smallest doc_id), ``group_size``, ``kept``, ``text_sha256``. Null texts are
    empty, and empty texts equal each other. Rows without doc_id come after all others when
    the row to keep is chosen; of rows alike in length and doc_id the first read is kept, so
    one row of each group is. Other columns are ignored; an empty table gives an empty result."""
    rows = recipes(docs, bits, keep_chunks, **size)
    # Lengths are compared first; one candidate per recipe leaves each task.
    best = rows.groupBy("recipe").agg(
        F.min(F.struct(
            (-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"
        )).alias("_best"),
        F.count(F.lit(1)).alias("group_size"),
    )
    keep = best.select(
        "recipe", F.col("_best.doc_id").alias("keep_id"), F.col("_best.row").alias("_keep"), "group_size"
    )
    return rows.join(keep, "recipe").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("_keep")).alias("kept"), "text_sha256"
    )


def op10_exact_dedup(spark, sf_dir):
    from perkloom.llm.common import documents

    return exact_dedup(documents(spark, sf_dir))


ORACLE = """
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER g AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       first_value(doc_id) OVER g = doc_id AS kept,
       sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm ORDER BY n DESC, doc_id)
"""
