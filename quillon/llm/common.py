"""What the training-data operators share: shared scratch tables, Arrow batches, global ranks, components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.scratch import drop_scratch, materialize, scratch_dir, scratch_path  # noqa: F401

#: Bytes in one Arrow batch sent to a Python worker, and rows at most.
ARROW_BYTES = 4 << 20
ARROW_ROWS = 1000


def tune(spark: SparkSession) -> None:
    """Bounds the Arrow batches, so that long texts cannot fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def release() -> None:
    """Gives back what a Python worker holds from tasks before: workers are used again, and allocators keep what is freed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def squeezed(rows: DataFrame) -> DataFrame:
    """Compresses the column text, which then moves through shuffles at a third of its size."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        deflate = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            i = batch.schema.get_field_index("text")
            yield batch.set_column(i, "text", pa.array([deflate((t or "").encode()) for t in batch["text"].to_pylist()], pa.binary()))

    fields = ", ".join(f"`{f.name}` {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(squeeze, fields)


def hash_sample(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """At most n rows, those of the smallest hash of the keys; of n or fewer rows, all.

    The count comes first, and rows far above the hash that n rows reach are left out before sorting, so
    that what tasks send to the driver is about n rows in all, however many tasks there are.
    """
    total = rows.count()
    hashed = rows.withColumn("_h", F.xxhash64(*keys))
    if total > 2 * n:
        share = (n + 6 * n**0.5 + 20) / total
        hashed = hashed.where(F.col("_h") < int(-(2**63) + share * 2**64))
    return hashed.orderBy("_h", *keys).limit(n).drop("_h")


def global_rank(df: DataFrame, order: list[Column], rank: str, name: str) -> DataFrame:
    """Adds `rank`, a gapless number from 0 in the given order, without gathering rows in one task.

    Rows are range-partitioned and sorted, numbered within their partition, and shifted by the row counts
    of the partitions before. Only one row per partition meets in a task. The order must be total.
    """
    mid = f"_{rank}_mid"
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(mid, F.monotonically_increasing_id())
    stored = materialize(sorted_rows, name)
    part = F.shiftrightunsigned(mid, 33)
    sizes = stored.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    row = F.col(mid).bitwiseAND(F.lit((1 << 33) - 1))
    return (
        stored.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")  # one row per partition
        .withColumn(rank, F.col("_before") + row)
        .drop(mid, "_part", "_before")
    )


def components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of `edges` (a, b: long) as (id, component): component is the smallest id reachable.

    Alternates the large-star and small-star steps until the edge set stays the same. Each round writes its
    edges to the shared folder. Stars are made by joining each node with its smallest neighbour, so a hub's
    neighbours need not meet in one row; written tables on both sides of the join let Spark split a hub's rows over
    tasks. Nodes without edges are absent. Raises if max_rounds do not suffice (the rounds needed grow with the
    logarithm of the longest path).
    """
    spark = edges.sparkSession
    pairs = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    current = materialize(pairs.distinct(), f"{name}-edges")
    if current.isEmpty():
        return spark.createDataFrame([], "id long, component long")
    last = None
    for k in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-least")
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u != v").distinct(), f"{name}-large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-low")
        small = large.join(low.hint("merge"), "u").where("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        current = materialize(small, f"{name}-round")
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            roots = current.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component"))
            return current.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
        last = state
    raise RuntimeError(f"components: {max_rounds} rounds did not suffice")
