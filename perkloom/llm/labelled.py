"""Bounded samples of labelled documents to fit classifiers on."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from perkloom.llm.common import crc_fold, stored
from perkloom.llm.simhash import shingle_hashes


@F.pandas_udf(LongType())
def family(texts: pd.Series) -> pd.Series:
    """The smallest hash of three words in a row; of all words if there are fewer."""
    found = (shingle_hashes(t, 3) for t in texts)
    return pd.Series([int(h.view(np.int64).min()) if len(h) else 0 for h in found], dtype="int64")


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int,
) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, y, u), and the number of training documents by class.

    The table holds about ``per_class`` training documents of each class, chosen by a hash of
    their ids; ``u`` is another hash, uniform in 0..1, to split them by. Of the texts of a class
    whose smallest shingle hash agrees, which copies and near copies share, one stays, so that no
    text weighs by having been copied.

    Rows of fold ``held_out`` are never read. Labels without id or value are ignored; of several
    labels of a document the largest counts. The sample's ids, whose number is bounded by
    ``per_class``, are broadcast, so texts are not shuffled."""
    marked = (
        labels.select("doc_id", F.col(label).alias("y")).dropna()
        .where(crc_fold("doc_id", folds) != held_out)
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    there = {r["y"]: r["n"] for r in marked.where("y in (0, 1)").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for y, n in there.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, per_class / n))).otherwise(share)
    uniform = lambda salt: F.shiftrightunsigned(F.xxhash64(F.lit(salt), "doc_id"), 11) / F.lit(float(2**53))
    chosen = marked.where(uniform("sample") < share)
    sample = (
        docs.select("doc_id", "text").dropna().join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "text", F.col("y").cast("int").alias("y"), uniform("split").alias("u"),
                family("text").alias("_family"))
        .groupBy("_family", "y").agg(F.min(F.struct("doc_id", "text", "u")).alias("first"))
        .select("first.doc_id", "first.text", "y", "first.u")
    )
    return stored(sample, f"sample-{label}"), {y: there.get(y, 0) for y in (0, 1)}
