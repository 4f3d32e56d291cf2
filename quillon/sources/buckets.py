"""A stored table bucketed by a hash of its key, and merges that rewrite only the buckets that changed rows touch.

A merge stages its buckets in a folder of its own, names it in a file `pending`, and overwrites these partitions from there. Where
it dies before that file, nothing has changed. From then on readers take these buckets from the stage, and the next merge
first finishes the overwriting, however far it had come: it may be repeated. One writer works at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon.sources import snapshots
from quillon.sources.files import exists

BUCKETS = 64


def bucket_of(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("bucket")


def create(df: DataFrame, path: str, key: str, n: int = BUCKETS) -> None:
    """Stores rows (one for each key) below path/rows, a folder for each bucket, and the key, n and columns beside them."""
    rows = df.withColumn("bucket", bucket_of(key, n))
    _write(rows.repartition("bucket"), path)
    snapshots.write_text(df.sparkSession, f"{path}/layout", json.dumps({"key": key, "n": n, "schema": rows.schema.json()}))


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/rows")


def _layout(spark: SparkSession, path: str) -> tuple[str, int]:
    layout = json.loads(snapshots.read_text(spark, f"{path}/layout"))
    return layout["key"], layout["n"]


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """What is in place; the schema is given, since a table may have no rows."""
    schema = StructType.fromJson(json.loads(json.loads(snapshots.read_text(spark, f"{path}/layout"))["schema"]))
    return spark.read.schema(schema).parquet(f"{path}/rows")


def _pending(spark: SparkSession, path: str) -> dict | None:
    """The stage of a merge that isn't in place yet, and the buckets that it holds."""
    return json.loads(snapshots.read_text(spark, f"{path}/pending")) if exists(spark, f"{path}/pending") else None


def recover(spark: SparkSession, path: str) -> None:
    """Puts the buckets of a pending merge in place: those of its stage overwrite, those without rows there are removed."""
    if work := _pending(spark, path):
        staged = spark.read.parquet(work["stage"])
        _write(staged, path)
        full = {r[0] for r in staged.select("bucket").distinct().collect()}
        for b in set(work["buckets"]) - full:
            snapshots.remove(spark, f"{path}/rows/bucket={b}")
        snapshots.remove(spark, f"{path}/pending")
        snapshots.remove(spark, work["stage"])


def read(spark: SparkSession, path: str) -> DataFrame:
    rows = _rows(spark, path)
    if work := _pending(spark, path):
        rows = rows.where(~F.col("bucket").isin(work["buckets"])).unionByName(spark.read.parquet(work["stage"]))
    return rows


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The rows of the given keys. Only their buckets are read: the bucket is part of the join, and a partition."""
    key, n = _layout(spark, path)
    return keys.select(key).distinct().withColumn("bucket", bucket_of(key, n)).join(read(spark, path), ["bucket", key]).drop("bucket")


def merge(spark: SparkSession, path: str, changes: DataFrame, update: Column | None = None, delete: Column | None = None, insert: bool = True) -> list[int]:
    """Merges changes (the table's columns, one row for each key) and returns the buckets rewritten.

    A stored row is replaced where `update` holds (default: always), removed where `delete` holds, and else stays; rows
    of new keys are added unless insert is False, or `delete` holds. Conditions may use columns old.<name> and new.<name>.
    """
    recover(spark, path)
    key, n = _layout(spark, path)
    table = _rows(spark, path)
    columns = [c for c in table.columns if c != "bucket"]
    new = changes.select(*columns).withColumn("bucket", bucket_of(key, n))
    touched = sorted(r[0] for r in new.select("bucket").distinct().collect())  # at most n numbers
    if not touched:
        return []
    old = table.where(F.col("bucket").isin(touched))  # a partition filter
    both = old.alias("old").join(new.alias("new"), (F.col("old.bucket") == F.col("new.bucket")) & (F.col(f"old.{key}") == F.col(f"new.{key}")), "full")
    there, asked = F.col("old.bucket").isNotNull(), F.col("new.bucket").isNotNull()
    gone = asked & F.coalesce(delete, F.lit(False)) if delete is not None else F.lit(False)
    taken = asked & (~there & F.lit(insert) | there & (F.coalesce(update, F.lit(False)) if update is not None else F.lit(True)))
    kept = both.where(~gone & (there | taken))
    row = F.when(taken, F.struct(*[F.col(f"new.{c}").alias(c) for c in columns])).otherwise(F.struct(*[F.col(f"old.{c}").alias(c) for c in columns]))
    out = kept.select(row.alias("row"), F.coalesce("old.bucket", "new.bucket").alias("bucket")).select("row.*", "bucket")
    stage = f"{path}/stage-{uuid.uuid4().hex}"
    out.repartition("bucket").write.parquet(stage)
    draft = f"{path}/pending-{uuid.uuid4().hex}"
    snapshots.write_text(spark, draft, json.dumps({"stage": stage, "buckets": touched}))
    snapshots.move(spark, draft, f"{path}/pending")  # from here on the merge counts
    recover(spark, path)
    return touched
