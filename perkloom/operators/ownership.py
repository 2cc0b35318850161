"""Which programs a user holds, and which are worth offering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perkloom.functions import fixed_values as V
from perkloom.session import written


def program_ancestors(programs: DataFrame) -> DataFrame:
    """(program_id, ancestor_id), every program being its own ancestor.

    A round doubles the levels covered: the ancestors a jump of 2^n levels leads to lend theirs, and
    jumps are joined with themselves. A program has one jump (one per parent path), so a round makes
    hardly more pairs than it finds. A chain of any length takes the logarithm of it in rounds, until no
    new pair appears; a parent cycle in hand-edited data adds no pair twice. Works on programs only."""
    ids = F.col("id")
    up = written(
        programs.where("parent_id IS NOT NULL AND parent_id <> id")
        .select(ids.alias("program_id"), F.col("parent_id").alias("ancestor_id")).distinct(),
        "ancestors",
    )
    jump, size, before = up, up.count(), 0
    while size != before:
        further = _onwards(jump, up)
        up = written(up.unionByName(further).distinct(), "ancestors")
        size, before = up.count(), size
        if size != before:
            jump = written(_onwards(jump, jump).distinct(), "jumps")
    return programs.select(ids.alias("program_id"), ids.alias("ancestor_id")).unionByName(up).distinct()


def _onwards(jump: DataFrame, up: DataFrame) -> DataFrame:
    """Where ``up`` leads from where ``jump`` leads, but for ways back to the start."""
    above = up.select(F.col("program_id").alias("ancestor_id"), F.col("ancestor_id").alias("_above"))
    further = jump.join(above, "ancestor_id").select("program_id", F.col("_above").alias("ancestor_id"))
    return further.where("program_id <> ancestor_id")


def owned_programs(declared: DataFrame, programs: DataFrame) -> DataFrame:
    """Distinct (user_id, program_id) with every issuer of a declared program.

    ``declared`` is (user_id, program_id); an id no program table knows is kept.
    """
    return (
        declared.join(program_ancestors(programs), "program_id", "left")
        .select("user_id", F.coalesce("ancestor_id", "program_id").alias("program_id"))
        .distinct()
    )


def offered_programs(programs: DataFrame, benefits: DataFrame) -> DataFrame:
    """Programs with a benefit of their own or of their parent, with the position
    of their category in the fixed display order."""
    paying = benefits.select(F.col("program_id").alias("_pays")).distinct()
    own = programs.join(paying, programs.id == F.col("_pays"), "left_semi")
    by_parent = programs.join(paying, programs.parent_id == F.col("_pays"), "left_semi")
    order = F.array_position(F.array(*[F.lit(c) for c in V.PROGRAM_CATEGORIES]), F.col("category"))
    return own.unionByName(by_parent).distinct().withColumn("section", order.cast("int"))


def toggled(log: DataFrame, keys: list[str]) -> DataFrame:
    """Current membership from a log of taps: present after an odd number."""
    return log.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n % 2 = 1").drop("_n")
