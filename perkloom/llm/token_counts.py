"""Token counts of documents in flat token files, by scanning for separators.

A flat token file is nothing but token identifiers, document after document, each closed by
an end-of-document identifier. There is no index: where documents start is found by
searching. Files are read in blocks of fixed length that know nothing of documents. Each block
is searched on its own, vectorised; then running sums over the blocks of a file, first inside
sections of blocks and then over sections, say how many tokens and documents came before each
block and where the last separator was, which stitches documents that cross blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perkloom.llm.bpe import RANKS, ranks, vocabulary_path
from perkloom.llm.common import documents, stored, whole_text

END_OF_DOCUMENT = 50_256
BLOCK_TOKENS = 65_536
SECTION_BLOCKS = 1024
# Unicode white space, in runs too long for the tokenizer's pattern search.
LONG_SPACE = re.compile("[\t-\r \x85\xa0  -     　]{1000,}")


def token_ids(text: str, path: str) -> list[int]:
    """Ids of a text; names of special tokens in it are ordinary text."""
    tokenizer, ids, at = ranks(path), [], 0
    for run in LONG_SPACE.finditer(text):
        # A run is one piece but for its last character, which may belong to what follows.
        end = run.end() if run.end() == len(text) else run.end() - 1
        ids += tokenizer.encode_ordinary(text[at : run.start()])
        ids += tokenizer._encode_single_piece(text[run.start() : end])
        at = end
    return ids + tokenizer.encode_ordinary(text[at:])


def token_blocks(docs: DataFrame, path: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Flat token files of all documents, one per task, as blocks: ``file``, ``block``,
    ``tokens`` (unsigned 16-bit, little-endian) and ``ended``, the names in file order of the
    documents that end in the block (files do not carry names; where they end is not kept)."""
    path = path or vocabulary_path(RANKS)
    name_type = docs.schema["doc_id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = TaskContext.get().partitionId()
        rest, names, block = np.empty(0, "<u2"), [], 0  # names: (doc_id, tokens from rest's start)
        schema = None

        def row(tokens, ended):
            return pa.RecordBatch.from_arrays(
                [pa.array([file], pa.int32()), pa.array([block], pa.int64()),
                 pa.array([tokens.tobytes()], pa.binary()), pa.array([ended], pa.list_(schema))],
                ["file", "block", "tokens", "ended"],
            )

        for batch in batches:
            schema = batch.column(0).type
            parts, size = [rest], len(rest)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = token_ids(text.as_py(), path)
                ids.append(END_OF_DOCUMENT)
                parts.append(np.array(ids, "<u2"))
                size += len(ids)
                names.append((doc_id, size - 1))
                while size >= block_tokens:
                    rest = np.concatenate(parts)
                    ended = [d for d, end in names if end < block_tokens]
                    yield row(rest[:block_tokens], ended)
                    names = [(d, end - block_tokens) for d, end in names[len(ended):]]
                    rest = rest[block_tokens:]
                    parts, size, block = [rest], len(rest), block + 1
            rest = np.concatenate(parts)
        if len(rest):
            yield row(rest, [d for d, _ in names])

    texts = docs.select("doc_id", whole_text().alias("text"))
    return texts.mapInArrow(
        write, f"file int, block bigint, tokens binary, ended array<{name_type}>"
    )


def blocks_of_files(spark: SparkSession, paths: list[str] | str, block_tokens: int = BLOCK_TOKENS, width: int = 2) -> DataFrame:
    """Blocks of flat token files that lie in a store: ``file`` (its path), ``block``,
    ``tokens`` and an empty ``ended``. Files should be of a size that one task can hold."""
    size = block_tokens * width
    return (
        spark.read.format("binaryFile").load(paths)
        .where("length > 0")
        .withColumn("block", F.explode(F.expr(f"sequence(0L, (length - 1) div {size})")))
        .select(
            F.col("path").alias("file"), "block",
            F.expr(f"substring(content, cast(block * {size} + 1 as int), {size})").alias("tokens"),
            F.array().cast("array<bigint>").alias("ended"),
        )
    )


def separators(blocks: DataFrame, separator: int = END_OF_DOCUMENT, dtype: str = "<u2") -> DataFrame:
    """(file, block, ended, n, ends): tokens of a block and where separators are in it."""

    @F.pandas_udf("struct<n:bigint,ends:array<int>>")
    def search(tokens: pd.Series) -> pd.DataFrame:
        flat = [np.frombuffer(t, dtype) for t in tokens]
        return pd.DataFrame({
            "n": [len(t) for t in flat],
            "ends": [np.flatnonzero(t == separator).astype(np.int32) for t in flat],
        })

    return blocks.select("file", "block", "ended", search("tokens").alias("s")).select(
        "file", "block", "ended", "s.n", "s.ends"
    )


def token_counts(found: DataFrame, section_blocks: int = SECTION_BLOCKS) -> DataFrame:
    """Documents of scanned blocks (``separators``, as a written table: it is read twice).

    Returns ``file``, ``ordinal`` (from 0 in the file), ``doc_id`` (null if the files have no
    names), ``first`` (place of the first token in the file), ``n_tokens`` (without the
    separator) and ``closed``: false for tokens after a file's last separator. Two separators in
    a row enclose a document without tokens. An empty file has no documents."""
    before = (Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    cut = found.withColumn("section", F.expr(f"block div {section_blocks}"))
    inside = Window.partitionBy("file", "section").orderBy("block").rowsBetween(*before)
    local = cut.withColumn("near", F.coalesce(F.sum("n").over(inside), zero)).withColumn(
        "docs_near", F.coalesce(F.sum(F.size("ends")).over(inside), zero)
    )
    local = local.withColumn("last", F.col("near") + F.try_element_at("ends", F.lit(-1)))
    local = local.withColumn("last_near", F.max("last").over(inside))
    sections = local.groupBy("file", "section").agg(
        F.sum("n").alias("n"), F.sum(F.size("ends")).alias("docs"), F.max("last").alias("last")
    )
    over = Window.partitionBy("file").orderBy("section").rowsBetween(*before)
    sections = sections.withColumn("far", F.coalesce(F.sum("n").over(over), zero)).withColumn(
        "docs_far", F.coalesce(F.sum("docs").over(over), zero)
    )
    sections = sections.withColumn("last_far", F.max(F.col("far") + F.col("last")).over(over))
    placed = local.join(sections.select("file", "section", "far", "docs_far", "last_far"), ["file", "section"])
    placed = placed.select(
        "file", "ended", "ends", (F.col("far") + F.col("near")).alias("base"),
        (F.col("docs_far") + F.col("docs_near")).alias("docs"),
        F.coalesce(F.col("far") + F.col("last_near"), "last_far", F.lit(-1)).alias("previous"),
    )
    each = F.expr(
        "transform(ends, (e, i) -> named_struct('ordinal', docs + i, 'doc_id', get(ended, i), "
        "'first', if(i = 0, previous, base + ends[i - 1]) + 1, 'end', base + e))"
    )
    closed = placed.select("file", F.inline(each)).select(
        "file", "ordinal", "doc_id", "first",
        (F.col("end") - F.col("first")).alias("n_tokens"), F.lit(True).alias("closed"),
    )
    files = sections.groupBy("file").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"),
        F.coalesce(F.max(F.col("far") + F.col("last")), F.lit(-1)).alias("last"),
    ).where("n > last + 1")
    names = dict(closed.dtypes)["doc_id"]
    tails = files.select(
        "file", F.col("docs").alias("ordinal"), F.lit(None).cast(names).alias("doc_id"),
        (F.col("last") + 1).alias("first"), (F.col("n") - F.col("last") - 1).alias("n_tokens"),
        F.lit(False).alias("closed"),
    )
    return closed.unionByName(tails)


def document_token_counts(docs: DataFrame, path: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Write all documents to flat token files and count the tokens of each by a scan.

    Returns one row per input row: ``doc_id``, ``n_tokens``, and where the tokens are (``file``,
    ``ordinal``, ``first``). Null and empty texts have no tokens. Rows with equal or null ids
    are documents of their own. Extra columns are ignored; an empty table gives an empty result."""
    # Token ids of prose need some eleven of sixteen bits.
    files = stored(token_blocks(docs, path, block_tokens), "token-files", "zstd")
    counted = token_counts(stored(separators(files), "separators"))
    return counted.select("doc_id", "n_tokens", "file", "ordinal", "first")


def op3_token_counts(spark, sf_dir):
    return document_token_counts(documents(spark, sf_dir))
