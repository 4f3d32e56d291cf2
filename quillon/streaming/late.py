"""Event time between streams: interval joins whose state is bounded, and late rows kept in a table of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.sources.snapshots import names


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, then: str, within: str, late: str, kind: str = "inner") -> DataFrame:
    """Rows of two streams that share keys, the right one after the left one by at most `within`.

    at, then: their event times. Both are watermarked by `late`, so that a row's state goes when no partner of it can come; with
    kind `left_outer`, rows without a partner come out then.
    """
    a, b = left.withWatermark(at, late).alias("a"), right.withWatermark(then, late).alias("b")
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.join(b, same & (F.col(f"b.{then}") > F.col(f"a.{at}")) & (F.col(f"b.{then}") <= F.col(f"a.{at}") + F.expr(f"INTERVAL {within}")), kind)


def split_late(rows: DataFrame, at: str, late_by: Column, root: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that deals a stream's rows to `on_time` and `late` below root, a folder for each micro-batch.

    A row is late where its event time plus `late_by` (a duration) lies before the largest event time of all earlier batches, which
    is what a watermark drops. That time is kept with each batch, so that a batch that is run again, after a failure, falls out the
    same and replaces what it wrote.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        marks = [n for n in names(spark, f"{root}/marks") if int(n.split("=")[1]) < number]
        before = spark.read.parquet(*[f"{root}/marks/{n}" for n in marks]).agg(F.max("top")).first()[0] if marks else None
        is_late = F.lit(False) if before is None else F.coalesce(F.col(at) + late_by < F.lit(before), F.lit(False))
        batch.persist()
        batch.where(~is_late).write.mode("overwrite").parquet(f"{root}/on_time/batch={number}")
        batch.where(is_late).withColumn("watermark", F.lit(before).cast("timestamp") - late_by).write.mode("overwrite").parquet(f"{root}/late/batch={number}")
        batch.agg(F.max(at).alias("top")).where("top is not null").write.mode("overwrite").parquet(f"{root}/marks/batch={number}")
        batch.unpersist()

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
