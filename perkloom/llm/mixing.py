"""Mixing sources to target weights.

Each source's words are packed into blocks of fixed length. Every output shard draws how
many blocks it takes from each source, multinomially (whole parts of the expectation are
given, the remainders are drawn). The slots a source got are numbered and mapped through
pseudorandom permutations of its block numbers, one per pass over the source, and blocks
are joined by number. Nothing random is kept: all draws are hashes of names and numbers,
so reruns agree.

Main path: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perkloom.llm.common import WORD, documents, prefix_sum, stored, whole_text

BLOCK_WORDS = 64
SHARD_SLOTS = 4096
MAX_REPEATS = 3
SEED = 17
ROUNDS = 24


def targets(sources: DataFrame) -> DataFrame:
    """Adds ``sid`` (rank by code points, null last), ``weight`` (1, 2, 3, repeating) and
    ``target`` to (source, source_size), one row per source.

    Targets share the total by weight and stop at ``MAX_REPEATS`` times the source's size;
    what is left goes to the others by weight until none is above. Sources fill up in the
    order of cap per weight, so running sums find the level at which sharing ends."""
    one_task = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    ranked = sources.withColumn("sid", F.row_number().over(one_task) - 1).withColumn(
        "weight", F.col("sid") % 3 + 1
    )
    ranked = ranked.withColumn("_cap", F.col("source_size") * MAX_REPEATS).withColumn(
        "_full_at", F.col("_cap") / F.col("weight")
    )
    fill = Window.orderBy("_full_at", "sid")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    leveled = ranked.withColumn("_total", F.sum("source_size").over(everything)).withColumn(
        "_level",
        (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("weight").over(rest),
    )
    leveled = leveled.withColumn(
        "_level", F.min(F.when(F.col("_full_at") >= F.col("_level"), F.struct("_full_at", "sid", "_level")))
        .over(everything)["_level"],
    )
    share = F.col("weight") * F.col("_level")
    return leveled.withColumn(
        "target", F.coalesce(F.least(share, F.col("_cap")), F.col("_cap")).cast("double")
    ).select("source", "source_size", "sid", "weight", "target")


def shard_counts(sources: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """How many blocks each output shard draws from each source: (shard, sid, blocks, draws).

    A shard expects ``e`` blocks of a source. It gets floor(e); the blocks still missing in
    the shard are drawn one by one among the sources in proportion to what floor left."""
    blocks = F.ceil(F.col("source_size") / BLOCK_WORDS)
    wanted = sources.where("source_size > 0").select(
        "sid", blocks.alias("blocks"), (F.col("target") * blocks / F.col("source_size")).alias("_slots")
    )
    everything = Window.partitionBy(F.lit(1))  # one row per source
    shards = F.greatest(F.ceil(F.sum("_slots").over(everything) / shard_slots), F.lit(1))
    each = (
        wanted.withColumn("_shards", shards)
        .withColumn("shard", F.explode(F.expr("sequence(0L, _shards - 1)")))
        .withColumn("_expected", F.col("_slots") / F.col("_shards"))
        .withColumn("_whole", F.floor("_expected"))
        .withColumn("_left", F.col("_expected") - F.col("_whole"))
    )
    in_shard = Window.partitionBy("shard")
    upto = in_shard.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("_all", F.sum("_left").over(in_shard)).withColumn(
        "_hi", F.sum("_left").over(upto)
    )
    uniform = f"((xxhash64({seed}, shard, d) & 1073741823) / 1073741824D)"
    drawn = F.expr(
        "size(filter(if(round(_all) > 0, sequence(1, cast(round(_all) as int)), array()), "
        f"d -> {uniform} * _all >= _hi - _left and {uniform} * _all < _hi))"
    )
    return each.select("shard", "sid", "blocks", (F.col("_whole") + drawn).cast("bigint").alias("draws"))


def permuted(index: str, size: str, key: str) -> str:
    """SQL of a keyed permutation of 0 .. size-1, by swapping or not swapping each index with
    its mirror at a random centre; every round is its own inverse, whatever the size."""
    centre = f"pmod(xxhash64({key}, r), {size})"
    mirror = f"pmod({centre} - x, {size})"
    return (
        f"aggregate(sequence(1, {ROUNDS}), {index}, (x, r) -> "
        f"if((xxhash64({key}, r, greatest(x, {mirror})) & 1) = 1, {mirror}, x))"
    )


def takes(draws: DataFrame, seed: int = SEED) -> DataFrame:
    """How often each block is taken: (sid, block, times), a written table."""
    draws = stored(draws, "draws")
    # A few rows turn into many slots each: dealt out by their number, not by their size.
    tasks = max(draws.sparkSession.sparkContext.defaultParallelism, draws.count() // 64)
    slots = (
        prefix_sum(draws, "sid", ["shard"], "draws", "_first")
        .where("draws > 0")
        .repartition(tasks, "sid", "shard")
        .withColumn("_slot", F.explode(F.expr("sequence(_first, _first + draws - 1)")))
        # A draw beyond the allowed passes over a source finds no block.
        .where(F.col("_slot") < F.col("blocks") * MAX_REPEATS)
        .withColumn("_pass", F.expr("_slot div blocks"))
        .withColumn("_index", F.expr("_slot % blocks"))
    )
    taken = slots.withColumn(
        "block", F.expr(permuted("_index", "blocks", f"{seed}, sid, _pass"))
    ).groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"))
    # Written, so that joins go by its size and not by that of the draws.
    return stored(taken, "takes")


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """What the mix takes of each document.

    Returns one row per input row: ``doc_id``, ``size`` (words; null text 0), ``source_size``,
    ``target`` (words its source should give), ``taken`` (words taken, repeats counted, at most
    ``MAX_REPEATS`` times the size). A null source is a source of its own, last in order.
    Documents without words, and all documents of a corpus without words, take nothing. Rows
    that are alike in id, source and size may swap their takes. Other columns are ignored."""
    sized = stored(
        docs.select("doc_id", "source", F.regexp_count(whole_text(), F.lit(WORD)).cast("bigint").alias("size")),
        "sizes",
    )
    sources = stored(
        targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "sources"
    )
    placed = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).select(
        "doc_id", "size", "source_size", "target", "sid"
    )
    rows = stored(
        prefix_sum(stored(placed, "placed"), "sid", ["doc_id", "size"], "size", "start"), "packed"
    )
    first, last = F.col("start"), F.col("start") + F.col("size")
    pieces = (
        rows.where("size > 0")
        .withColumn("block", F.explode(F.expr(
            f"sequence(start div {BLOCK_WORDS}, (start + size - 1) div {BLOCK_WORDS})")))
        .select(
            "sid", "start", "block",
            (F.least(last, (F.col("block") + 1) * BLOCK_WORDS) - F.greatest(first, F.col("block") * BLOCK_WORDS))
            .alias("words"),
        )
    )
    taken = (
        pieces.join(takes(shard_counts(sources, seed=seed), seed), ["sid", "block"])
        .groupBy("sid", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
        .withColumn("size_above", F.lit(0))
    )
    # The start tells the documents of a source apart, apart from those without words.
    return rows.join(
        taken, (rows["sid"] == taken["sid"]) & (rows["start"] == taken["start"])
        & (rows["size"] > taken["size_above"]), "left",
    ).select(
        rows["doc_id"], "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken")
    )


def op7_mixing(spark, sf_dir):
    return mix(documents(spark, sf_dir))
