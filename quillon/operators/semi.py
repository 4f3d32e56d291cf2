"""Semi-structured columns: JSON parsed once into VARIANT, with its key set beside it, by which files can be skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Different key sets that a filter may name one by one; with more of them it looks into each row's set.
SETS = 10_000
_BETWEEN = "\x1f"


def key_set(json: Column) -> Column:
    """The keys of a JSON object, in order, as one string: a column that file statistics and dictionaries work on. Null where there is no object."""
    return F.array_join(F.array_sort(F.json_object_keys(json)), _BETWEEN)


def store(df: DataFrame, json: str, path: str) -> None:
    """Writes rows with `json` parsed (null where it isn't JSON) and `keys`, near rows of the same key set, and the list of sets."""
    rows = df.withColumn("keys", key_set(F.col(json))).withColumn(json, F.try_parse_json(json))
    rows.sortWithinPartitions("keys").write.mode("overwrite").parquet(f"{path}/rows")
    df.sparkSession.read.parquet(f"{path}/rows").groupBy("keys").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/sets")


def having_any(spark: SparkSession, path: str, asked: list[str]) -> DataFrame:
    """The stored rows whose object has one of the asked keys. The sets that do are found first, and their names are pushed down to the files."""
    sets = spark.read.parquet(f"{path}/sets").where(F.arrays_overlap(F.split("keys", _BETWEEN), F.array(*map(F.lit, asked)))).select("keys")
    named = [r[0] for r in sets.limit(SETS + 1).collect()]
    rows = spark.read.parquet(f"{path}/rows")
    if len(named) > SETS:
        return rows.where(F.arrays_overlap(F.split("keys", _BETWEEN), F.array(*map(F.lit, asked))))
    return rows.where(F.col("keys").isin(named))


def field(variant: str, path: str, kind: str) -> Column:
    """A typed field of a VARIANT column; null where it is missing or of another kind."""
    return F.try_variant_get(F.col(variant), path, kind)
