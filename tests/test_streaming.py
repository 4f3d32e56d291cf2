"""Streams give what the batch forms give."""

from pyspark.sql import functions as F

from quillon.operators import events
from quillon.streaming import late, limits
from quillon.tables import events as load_events

BASE = "/root/testdata/sf0.001"


STORE = "spark.sql.streaming.stateStore.providerClass"


def drain(stream, name, mode):
    spark = stream.sparkSession
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, limits.ROCKS)
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    spark.conf.set(STORE, before)


def batches(spark, path, frames):
    """A stream with a micro-batch for each frame, as they arrive one by one."""
    for df in frames:
        df.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def finish(stream, path, checkpoint):
    spark = stream.sparkSession
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, limits.ROCKS)
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark.conf.set(STORE, before)
    return spark.read.parquet(path)


def state(spark, checkpoint, name):
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()


ASKS = "client string, at double, id int, cost double"


def test_limiter_state_expires(spark, tmp_path):
    """Over four micro-batches; once event time has passed their windows, only the last client is known."""
    asks = [[("a", 100.0, 1, 1.0), ("a", 105.0, 2, 1.0), ("b", 106.0, 3, 1.0)], [("a", 108.0, 4, 1.0), ("a", 110.5, 5, 1.0)], [("b", 400.0, 6, 1.0)], [("z", 9000.0, 7, 1.0)]]
    stream = limits.limited_stream(batches(spark, f"{tmp_path}/in", [spark.createDataFrame(x, ASKS) for x in asks]), 2, 10.0)
    got = {r["id"]: (r["admitted"], r["retry_after"]) for r in finish(stream, f"{tmp_path}/out", f"{tmp_path}/check").collect()}
    assert got == {1: (True, 0.0), 2: (True, 0.0), 3: (True, 0.0), 4: (False, 2.0), 5: (True, 0.0), 6: (True, 0.0), 7: (True, 0.0)}
    assert {r["key"][0] for r in state(spark, f"{tmp_path}/check", "admitted").collect()} == {"z"}


def test_limiter_with_tokens(spark, tmp_path):
    """A call of any size passes an empty window when lenient, and uses its tokens up."""
    asks = [[("a", 100.0, 1, 90.0), ("a", 101.0, 2, 1.0)], [("a", 111.0, 3, 4.0), ("a", 112.0, 4, 2.0), ("a", 113.0, 5, 1.0)]]
    frames = [spark.createDataFrame(x, ASKS) for x in asks]
    for lenient in (True, False):
        out = finish(limits.limited_stream(batches(spark, f"{tmp_path}/in{lenient}", frames), 9, 10.0, 5.0, lenient), f"{tmp_path}/out{lenient}", f"{tmp_path}/check{lenient}")
        want = {r["id"]: r["admitted"] for r in events.rate_limited(frames[0].union(frames[1]), 9, 10.0, 5.0, lenient).collect()}
        assert {r["id"]: r["admitted"] for r in out.collect()} == want and want[1] == lenient


def test_ledger_admission(spark, tmp_path):
    """A late call counts to its own day; a day that no call can reach any more leaves the state."""
    calls = [[("m", 1, "2024-01-01 10:00:00", 6.0), ("m", 2, "2024-01-01 11:00:00", 6.0)], [("m", 3, "2024-01-02 01:00:00", 4.0), ("n", 4, "2024-01-02 02:00:00", 4.0)], [("m", 5, "2024-01-01 23:00:00", 1.0), ("m", 6, "2024-01-02 03:00:00", None)], [("m", 7, "2024-01-09 00:00:00", 1.0)]]
    frames = [spark.createDataFrame(x, "model string, id int, ts string, tokens double").withColumn("ts", F.col("ts").cast("timestamp")) for x in calls]
    out = finish(limits.admitted_stream(batches(spark, f"{tmp_path}/in", frames), 10.0, "1 day"), f"{tmp_path}/out", f"{tmp_path}/check")
    assert {r["id"]: (r["before"], r["open"]) for r in out.collect()} == {1: (0, True), 2: (6, True), 3: (0, True), 4: (0, True), 5: (12, False), 6: (4, True), 7: (0, True)}
    assert state(spark, f"{tmp_path}/check", "used").count() == 1


def test_interval_join(spark, tmp_path):
    t = lambda s: F.timestamp_seconds(F.lit(s))
    left = [spark.range(1).select(F.lit(k).alias("k"), F.lit(n).alias("n"), t(s).alias("ts")) for k, n, s in [("a", 1, 100), ("a", 2, 150), ("b", 3, 160), ("a", 4, 9000)]]
    right = [spark.range(1).select(F.lit(k).alias("k"), F.lit(m).alias("m"), t(s).alias("then")) for k, m, s in [("a", 1, 155), ("a", 2, 150), ("b", 3, 230), ("a", 4, 9000)]]
    streams = batches(spark, f"{tmp_path}/l", left), batches(spark, f"{tmp_path}/r", right)
    inner = finish(late.interval_join(*streams, ["k"], "ts", "then", "1 MINUTE", "1 minute").select("n", "m"), f"{tmp_path}/out", f"{tmp_path}/check")
    assert {tuple(r) for r in inner.collect()} == {(1, 1), (1, 2), (2, 1)}
    outer = finish(late.interval_join(*streams, ["k"], "ts", "then", "1 MINUTE", "1 minute", "left_outer").select("n", "m"), f"{tmp_path}/out2", f"{tmp_path}/check2")
    assert (3, None) in {tuple(r) for r in outer.collect()}


def test_late_rows_go_apart(spark, tmp_path):
    row = lambda n, s: spark.range(1).select(F.lit(n).alias("n"), F.timestamp_seconds(F.lit(s)).alias("ts"))
    frames = [row(1, 1000).union(row(2, 10)), row(3, 800).union(row(4, 950)), row(5, None), row(6, 899)]
    stream = batches(spark, f"{tmp_path}/in", frames)
    split = lambda: late.split_late(stream, "ts", F.make_dt_interval(secs=F.lit(100)), str(tmp_path), f"{tmp_path}/check").awaitTermination()
    split()
    row(7, 5).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    split()  # goes on with what it knew
    assert {r["n"] for r in spark.read.parquet(f"{tmp_path}/late").collect()} == {3, 6, 7}
    assert {r["n"] for r in spark.read.parquet(f"{tmp_path}/on_time").collect()} == {1, 2, 4, 5}


def source(spark, tmp_path, df):
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")


def test_windows(spark, tmp_path):
    e = load_events(spark, BASE).select("ts", "event_type", "value")
    drain(limits.windowed_counts(source(spark, tmp_path, e), "1 hour", "15 minutes", "1 day", "event_type"), "windows", "complete")
    got = {(r["window"]["start"], r["event_type"]): r["n"] for r in spark.sql("select * from windows").collect()}
    want = {(r["window"]["start"], r["event_type"]): r["n"] for r in e.groupBy(F.window("ts", "1 hour", "15 minutes"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got == want and want


def test_rate_limit(spark, tmp_path):
    e = load_events(spark, BASE).select(F.col("user_id").alias("client"), (F.unix_micros("ts") / 1e6).alias("at"), F.col("event_id").alias("id"))
    drain(limits.limited_stream(source(spark, tmp_path, e), 2, 86_400.0), "limited", "append")
    got = {r["id"]: r["admitted"] for r in spark.sql("select * from limited").collect()}
    want = {r["id"]: r["admitted"] for r in events.rate_limited(e.withColumn("cost", F.lit(1.0)), 2, 86_400.0).collect()}
    assert got == want and len(set(want.values())) == 2


def test_ledger(spark, tmp_path):
    e = load_events(spark, BASE).select("ts", F.col("event_type").alias("model"), F.lit(2.0).alias("tokens"))
    drain(limits.ledger_stream(source(spark, tmp_path, e)), "ledger", "update")
    got = {(str(r["day"]["start"])[:10], r["model"]): r["tokens"] for r in spark.sql("select * from ledger").collect()}
    want = {(r["day"], r["model"]): r["tokens"] for r in events.ledger(e).collect()}
    assert got == want


def test_nearest_and_fragments(spark):
    rows = spark.createDataFrame([("k", 1, "a", True), ("k", 5, "b", False), ("k", 8, "c", True), ("k", 40, "d", False)], "k string, x int, v string, t boolean")
    near = {r["v"]: r["near"] for r in events.nearest(rows, "k", "x", F.col("t"), "v", 12).collect()}
    assert near == {"a": "a", "b": "c", "c": "c", "d": None}
    lines = spark.createDataFrame([(0, 1, 10.0, 5.0, "a"), (0, 2, 11.0, 50.0, "b"), (0, 3, 30.0, 5.0, "c")], "doc_id int, line_index int, y0 double, x0 double, text string")
    assert sorted(r["text"] for r in events.merge_fragments(lines).collect()) == ["a b", "c"]
