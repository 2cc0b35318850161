"""Strict catalog reading: a malformed catalog fails the load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from perkloom.operators import quality
from perkloom.schemas import BENEFIT, MERCHANT, PROGRAM, VENUE
from perkloom.session import written


class CatalogError(ValueError):
    """The catalog breaks its own rules."""


def unknown_fields(found: DataType, known: DataType, at: str = "") -> list[str]:
    """Paths in ``found`` that ``known`` does not have, at every level."""
    if isinstance(found, ArrayType) and isinstance(known, ArrayType):
        return unknown_fields(found.elementType, known.elementType, f"{at}[]")
    if not (isinstance(found, StructType) and isinstance(known, StructType)):
        return []
    out = []
    for field in found.fields:
        path = f"{at}.{field.name}".lstrip(".")
        if field.name not in known.names:
            out.append(path)
        else:
            out += unknown_fields(field.dataType, known[field.name].dataType, path)
    return out


def read_strict(spark: SparkSession, path: str, schema: StructType, lines: bool = False) -> DataFrame:
    """JSON under a fixed schema; wrong types and unknown fields, nested ones too, are errors.
    ``lines``: one object a line, which Spark reads in parallel; else one array a file."""
    reader = spark.read.option("multiLine", not lines)
    unknown = unknown_fields(reader.json(path).schema, schema)
    if unknown:
        raise CatalogError(f"{path}: unknown fields {sorted(unknown)}")
    return reader.schema(schema).option("mode", "FAILFAST").json(path)


def with_sequence(df: DataFrame) -> DataFrame:
    """``seq``: the position of a row in its file, which breaks ranking ties."""
    return df.withColumn("seq", F.monotonically_increasing_id())


def read_catalog(spark: SparkSession, folder: str, lines: bool = False) -> dict[str, DataFrame]:
    """The four tables, checked row by row before anyone uses them. All faults are written to a
    table, which the error names."""
    tables = {
        name: with_sequence(read_strict(spark, f"{folder}/{name}.json", schema, lines))
        for name, schema in (
            ("programs", PROGRAM), ("merchants", MERCHANT), ("venues", VENUE), ("benefits", BENEFIT),
        )
    }
    tables["benefits"] = tables["benefits"].withColumn(
        "reviewed_by_human", F.coalesce("reviewed_by_human", F.lit(False))
    )
    broken = written(quality.load_rules(**tables), "catalog-faults")
    count = broken.count()
    if count:
        worst = broken.groupBy("table", "rule").count().orderBy("table", "rule").collect()  # a row a rule
        kinds = ", ".join(f"{r['table']}.{r['rule']}: {r['count']}" for r in worst)
        raise CatalogError(f"{count} faults ({kinds}); all of them in {broken.inputFiles()[0].rsplit('/', 1)[0]}")
    return tables


def branches_of(merchants: DataFrame) -> DataFrame:
    return merchants.select(
        F.col("id").alias("merchant_id"), F.posexplode("branches").alias("branch_no", "b")
    ).select("merchant_id", "branch_no", "b.lat", "b.lng")


def members_of(merchants: DataFrame) -> DataFrame:
    return merchants.select(F.col("id").alias("merchant_id"), F.explode("venue_ids").alias("venue_id"))


def domains_of(merchants: DataFrame) -> DataFrame:
    return merchants.select(
        F.col("id").alias("merchant_id"), "seq", F.explode("domains").alias("domain")
    )
