"""Registered queries that run streams over the events table to their end, and read what they wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans.catalog import query
from quillon.scratch import scratch_path
from quillon.streaming import late, limits
from quillon.tables import events as load_events

PARTS = 4
_STORE = "spark.sql.streaming.stateStore.providerClass"


def fed(spark: SparkSession, rows: DataFrame, part: str) -> DataFrame:
    """A stream of rows, a micro-batch for each value 0 .. PARTS - 1 of column `part`: one after the other is written as files, as they would arrive."""
    path, files = scratch_path(spark, "feed"), 2
    for k in range(PARTS):
        rows.where(F.col(part) == k).drop(part).repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.drop(part).schema).option("maxFilesPerTrigger", files).parquet(path)


def in_order(rows: DataFrame) -> DataFrame:
    """Adds `part`, quarters of the rows by their time."""
    cuts = rows.agg(F.percentile_approx(F.unix_micros("ts"), [k / PARTS for k in range(1, PARTS)])).first()[0] or []
    at = F.unix_micros("ts")
    return rows.withColumn("part", sum([(at > c).cast("int") for c in cuts], F.lit(0)))


def drained(stream: DataFrame) -> DataFrame:
    """Runs a stream over all that its source holds, into a table."""
    spark, path = stream.sparkSession, scratch_path(stream.sparkSession, "drained")
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, limits.ROCKS)
    try:
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch_path(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_STORE, before)
    return spark.read.schema(stream.schema).parquet(path)


@query("""WITH RECURSIVE e AS (SELECT user_id AS client, epoch_us(ts) / 1e6 AS at_s, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) / 1e6, event_id) AS n FROM events),
f AS (SELECT client, 0::BIGINT AS n, NULL::DOUBLE AS at_s, NULL::BIGINT AS id, -1e18::DOUBLE AS a, -1e18::DOUBLE AS b, true AS ok, 0::DOUBLE AS wait FROM e WHERE n = 1
UNION ALL SELECT e.client, e.n, e.at_s, e.id, CASE WHEN f.a <= e.at_s - 86400 THEN f.b ELSE f.a END, CASE WHEN f.a <= e.at_s - 86400 THEN e.at_s ELSE f.b END, f.a <= e.at_s - 86400, CASE WHEN f.a <= e.at_s - 86400 THEN 0 ELSE f.a + 86400 - e.at_s END
FROM f JOIN e ON e.client = f.client AND e.n = f.n + 1)
SELECT client, at_s AS "at", id, 1::DOUBLE AS cost, ok AS admitted, wait AS retry_after FROM f WHERE n > 0""")
def rate_limit_stream(spark: SparkSession, base: str) -> DataFrame:
    """Two calls a day and client, in four micro-batches: what the batch form gives."""
    e = in_order(load_events(spark, base)).select("part", F.col("user_id").alias("client"), (F.unix_micros("ts") / 1e6).alias("at"), F.col("event_id").alias("id"), F.lit(1.0).alias("cost"))
    return drained(limits.limited_stream(fed(spark, e, "part"), 2, 86_400.0))


@query("""SELECT event_type AS model, event_id AS id, round(coalesce(sum(value) OVER w, 0), 4) AS before, coalesce(sum(value) OVER w, 0) < 500 AS open FROM events
WINDOW w AS (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def ledger_admission_stream(spark: SparkSession, base: str) -> DataFrame:
    """Calls of a model within its daily budget, in four micro-batches."""
    e = in_order(load_events(spark, base)).select("part", F.col("event_type").alias("model"), F.col("event_id").alias("id"), "ts", F.col("value").alias("tokens"))
    return drained(limits.admitted_stream(fed(spark, e, "part"), 500.0)).select("model", "id", F.round("before", 4).alias("before"), "open")


@query("""SELECT a.user_id, count(*) AS pairs, min(b.event_id - a.event_id) AS nearest FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR GROUP BY a.user_id""")
def interval_join_stream(spark: SparkSession, base: str) -> DataFrame:
    """Purchases within an hour after each event of the same user: two streams, joined by time."""
    e = in_order(load_events(spark, base)).select("part", "user_id", "event_id", "event_type", "ts")
    bought = e.where("event_type = 'purchase'").select("part", "user_id", F.col("event_id").alias("then_id"), F.col("ts").alias("then"))
    pairs = late.interval_join(fed(spark, e, "part"), fed(spark, bought, "part"), ["user_id"], "ts", "then", "1 HOUR", "1 hour")
    rows = drained(pairs.select("a.user_id", "event_id", "then_id"))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("pairs"), F.min(F.col("then_id") - F.col("event_id")).alias("nearest"))


@query("""WITH e AS (SELECT *, (event_id * 7919) % 4 AS part FROM events), t AS (SELECT part, max(ts) AS top FROM e WHERE ts < (SELECT min(ts) FROM events) + (part + 1) * INTERVAL 7 DAY GROUP BY part),
f AS (SELECT e.*, (SELECT max(top) FROM t WHERE t.part < e.part) AS before FROM e WHERE ts < (SELECT min(ts) FROM events) + (part + 1) * INTERVAL 7 DAY)
SELECT part, count(*) AS n, count(*) FILTER (coalesce(ts + INTERVAL 2 DAY < before, false)) AS late FROM f GROUP BY part""")
def late_rows_apart(spark: SparkSession, base: str) -> DataFrame:
    """Four batches, each of which reaches a week further and holds old events too: rows of more than two days behind go to a table of their own."""
    e = load_events(spark, base).select("event_id", "ts", ((F.col("event_id") * 7919) % PARTS).cast("int").alias("part"))
    first = e.agg(F.min("ts")).first()[0]
    e = e.where(F.col("ts") < F.lit(first) + F.make_dt_interval((F.col("part") + 1) * 7))
    root = scratch_path(spark, "split")
    late.split_late(fed(spark, e, "part"), "ts", F.make_dt_interval(F.lit(2)), root, scratch_path(spark, "checkpoint")).awaitTermination()
    both = spark.read.parquet(f"{root}/on_time").select("batch", F.lit(0).alias("late")).unionByName(spark.read.parquet(f"{root}/late").select("batch", F.lit(1).alias("late")))
    return both.groupBy(F.col("batch").cast("long").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("late").alias("late"))
