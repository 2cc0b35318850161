"""Cleaning a corpus, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns documents for the next, with the columns of
``documents``; the last returns token digests. Rows are told apart by doc_id and text, so ids may
repeat or lack: of rows alike in both, deduplication keeps one, and mixing takes all rows of an id
at one rate. An empty table passes all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perkloom.llm import bpe, exact_dedup, mixing, simhash, toxicity
from perkloom.llm.common import documents, stored, whole_text


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    packed = docs.withColumn("_document", F.struct(*docs.columns))
    scored = toxicity.toxicity(packed, labels, carry=("_document",))
    return scored.where("predicted = 0").select("_document.*")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal without white space, the one to keep stays."""
    decided = exact_dedup.exact_dedup(docs, keep_chunks=False)
    kept = decided.where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    named = docs.withColumn("_text", F.sha2(exact_dedup.normalised(whole_text()).cast("binary"), 256))
    same = named["doc_id"].eqNullSafe(kept["_id"]) & (named["_text"] == kept["_sha"])
    return _one_of_each(named.join(kept, same, "left_semi"), "_text", docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays (one without an id
    if none has one): fingerprints within three bits, or four fifths of five-word shingles in common."""
    groups = simhash.near_or_like(docs, similarity=0.8)
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_key") == F.col("keep_key"))
    first = groups.where(stays).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    named = docs.withColumn("_text", F.xxhash64(whole_text()))
    same = named["doc_id"].eqNullSafe(first["_id"]) & (named["_text"] == first["_key"])
    return _one_of_each(named.join(first, same, "left_semi"), "_text", docs.columns)


def _one_of_each(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """One row for each id and text, the same one whenever it is asked for."""
    picked = F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("_row")
    return rows.groupBy("doc_id", text).agg(picked).select("_row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: words taken over words held, the fraction
    decided by a hash of id and text. Documents that the mix does not take go."""
    rates = mixing.mix(docs).groupBy(F.col("doc_id").alias("_id")).agg(
        (F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).alias("_rate")
    ).where("_rate > 0")
    chance = F.pmod(F.xxhash64(F.lit(mixing.SEED), "doc_id", "text"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    counted = docs.join(rates, docs["doc_id"].eqNullSafe(rates["_id"])).withColumn(
        "_n", F.floor(F.col("_rate") + chance).cast("int")
    ).where("_n > 0")
    return counted.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document."""
    return bpe.round_trip(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("mixing", mixed),
    ("encoding", encoded),
]
ORACLE_SQL = None  # the toxicity model is not expressible


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each one written and read again by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
