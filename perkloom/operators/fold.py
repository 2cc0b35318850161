"""Sequential decisions over long ordered histories, in balanced pieces.

Some decisions depend on the last *accepted* row, which no window function can
express. Rows are range-partitioned on (keys, order), so partitions are balanced
even when one key holds most of the rows: a long key is cut into consecutive
pieces, and a partition is walked as a stream with constant memory.

A piece in the middle of a key needs the state its predecessor ended with. So pieces are read
twice. The first reading sums each one up as a function from the state it is given to the
state it leaves; the driver, which sees one small row per piece, composes these along a key. The
second reading decides. Where a summary cannot tell, the piece is walked with the state that
is known by then, the first such piece of every key at once.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from perkloom.session import ensure_checkpoint_dir

PIECE_ROWS = 500_000

# step(rows of one key in order, state or None) -> (one value per row, state)
Step = Callable[[pd.DataFrame, list | None], tuple[list, list | None]]


class Summary(Protocol):
    """What a piece of a key's history does to the state, whatever state it is given."""

    def add(self, rows: pd.DataFrame) -> None:
        """Take in the next rows."""

    def done(self) -> list:
        """The summary, of values that JSON can hold."""

    @staticmethod
    def follow(summary: list, state: list | None) -> list | None:
        """The state after the piece, or ``UNKNOWN``."""


UNKNOWN = object()


def _runs(batch: pd.DataFrame) -> Iterator[tuple[str, pd.DataFrame]]:
    """Consecutive rows of the same key within one Arrow batch."""
    for _, run in batch.groupby((batch["_key"] != batch["_key"].shift()).cumsum(), sort=False):
        yield run["_key"].iloc[0], run


def _walk(batches, step, incoming):
    """Yield (chunk, key, rows, outputs, state) along one partition."""
    state, at = None, None
    for batch in batches:
        if not len(batch):
            continue
        chunk = int(batch["_chunk"].iloc[0])
        for key, rows in _runs(batch):
            if at is None:
                state = incoming.get(chunk)
            elif key != at:
                state = None
            at = key
            out, state = step(rows, state)
            yield chunk, key, rows, out, state


def ordered_fold(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    step: Step,
    output: StructField,
    summary: type[Summary],
    pieces: int | None = None,
) -> DataFrame:
    """``df`` plus one column computed by ``step`` along each key's history."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = pieces or max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // PIECE_ROWS)
    )
    # Written to the shared checkpoint folder: the pieces must be the same rows in
    # every pass, also after an executor was lost. The key is written out here, where a
    # null cannot change how the other keys look.
    chunks = (
        df.withColumn("_key", F.to_json(F.struct(*keys)))
        .repartitionByRange(n, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_chunk", F.spark_partition_id())
        .checkpoint()
    )

    def ends(incoming: dict, only: set) -> dict:
        def scan(batches):
            chunk, state = None, None
            for chunk, _, _, _, state in _walk(batches, step, incoming):
                if chunk not in only:
                    return
            if chunk is not None:
                yield pd.DataFrame({"chunk": [chunk], "state": [json.dumps(state)]})

        return {r.chunk: json.loads(r.state) for r in chunks.mapInPandas(scan, "chunk int, state string").collect()}

    def sums() -> dict:
        def scan(batches):
            first = last = chunk = state = None
            made = summary()
            for batch in batches:
                if not len(batch):
                    continue
                chunk = int(batch["_chunk"].iloc[0])
                for key, rows in _runs(batch):
                    first = first or key
                    if key == first:
                        made.add(rows)
                    else:  # a key that starts here is simply walked
                        state = step(rows, state if key == last else None)[1]
                    last = key
            if chunk is not None:
                yield pd.DataFrame({
                    "chunk": [chunk], "first": [first], "last": [last],
                    "state": [json.dumps(made.done() if first == last else state)],
                })

        rows = chunks.mapInPandas(scan, "chunk int, first string, last string, state string").collect()  # one per piece
        return {r.chunk: (r.first, r.last, json.loads(r.state)) for r in rows}

    incoming, walked, found = {}, {}, sorted(sums().items())
    while True:
        unsure, at, state = set(), None, None
        for chunk, (first, last, left) in found:
            state = state if at == first else None
            at = last
            if state is UNKNOWN:  # waits for a piece before it
                state = left if first != last else UNKNOWN
                continue
            incoming[chunk] = state
            if first != last:
                state = left
            elif chunk in walked:
                state = walked[chunk]
            else:
                state = summary.follow(left, state)
                if state is UNKNOWN:
                    unsure.add(chunk)
        if not unsure:
            break
        walked.update(ends(incoming, unsure))

    def decide(batches):
        for _, _, rows, out, _ in _walk(batches, step, incoming):
            yield rows.drop(columns=["_chunk", "_key"]).assign(**{output.name: out})

    return chunks.mapInPandas(decide, StructType([*df.schema.fields, output]))
