"""Structured Streaming forms: a sliding rate limit and a ledger with state that expires, windows with watermarks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from quillon.operators.events import SlidingLimit


#: The store that state with timers and lists needs.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


class _Limiter(StatefulProcessor):
    """A client's admitted calls within the window, in a list; a timer at the end of the last one's window empties it."""

    def __init__(self, limit: int, window: float, tokens: float | None, lenient: bool) -> None:
        self.rule = limit, window, tokens, lenient

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.admitted = handle, handle.getListState("admitted", "at double, cost double")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        rule = SlidingLimit(*self.rule)
        for at, cost in self.admitted.get() if self.admitted.exists() else ():
            rule.admitted.append((at, cost))
            rule.used += cost
        for r in sorted(rows, key=lambda r: (r["at"], r["id"])):  # a client's calls of one micro-batch
            wait = rule.ask(r["at"], r["cost"])
            yield Row(client=key[0], at=r["at"], id=r["id"], cost=r["cost"], admitted=wait == 0, retry_after=float(wait))
        for t in [*self.handle.listTimers()]:
            self.handle.deleteTimer(t)
        if rule.admitted:
            self.admitted.put([*rule.admitted])
            self.handle.registerTimer(int((rule.admitted[-1][0] + rule.window) * 1000) + 1)
        elif self.admitted.exists():
            self.admitted.clear()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.admitted.clear()
        return iter(())

    def close(self) -> None:
        pass


def limited_stream(asks: DataFrame, limit: int, window: float = 3600.0, tokens: float | None = None, lenient: bool = False, late: str = "1 second") -> DataFrame:
    """Asks (client, at in seconds, id, cost) with admitted and retry_after, as in `rate_limited` where no call is late.

    With `tokens`, the costs admitted in a window are bounded too; lenient: an empty window admits a call of any cost.
    Calls are judged as they arrive, sorted within a micro-batch; a call that is `late` or more behind the latest of earlier batches is dropped. State is what was
    admitted within the window, and goes when event time has passed it. The session's state store has to be ROCKS.
    """
    rows = asks if "cost" in asks.columns else asks.withColumn("cost", F.lit(0.0))
    kinds = dict(rows.dtypes)
    rows = rows.select("client", F.col("at").cast("double").alias("at"), "id", F.col("cost").cast("double").alias("cost"), F.timestamp_micros((F.col("at") * 1_000_000).cast("long")).alias("ts"))
    out = f"client {kinds['client']}, at double, id {kinds['id']}, cost double, admitted boolean, retry_after double"
    return rows.withWatermark("ts", late).groupBy("client").transformWithState(_Limiter(limit, window, tokens, lenient), out, "append", "EventTime")


class _Ledger(StatefulProcessor):
    """Tokens used by day, of one model; a timer at the end of a day, when no call of it can come any more, removes it."""

    def __init__(self, budget: float) -> None:
        self.budget = budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.used = handle, handle.getMapState("used", "day long", "tokens double")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        days: dict[int, float] = {}
        for r in sorted(rows, key=lambda r: (r["ts"], r["id"])):
            day = r["day"]
            if day not in days:
                known = self.used.getValue((day,)) if self.used.containsKey((day,)) else None
                days[day] = known[0] if known else 0.0
                if not known:
                    self.handle.registerTimer((day + 1) * DAY_MS)
            yield Row(model=key[0], id=r["id"], ts=r["ts"], tokens=r["tokens"], before=days[day], open=days[day] < self.budget)
            days[day] += r["tokens"]
        for day, used in days.items():
            self.used.updateValue((day,), (used,))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        day = expiredTimerInfo.getExpiryTimeInMs() // DAY_MS - 1
        if self.used.containsKey((day,)):
            self.used.removeKey((day,))
        return iter(())

    def close(self) -> None:
        pass


def admitted_stream(calls: DataFrame, budget: float, late: str = "1 day") -> DataFrame:
    """Calls (model, id, ts, tokens) with the tokens of their own day (UTC) before them, and `open`: whether these are below the budget.

    As `within_ledger`, where calls come in order. A call that is late by up to `late` still counts to its day, after what has
    arrived before; a day leaves the state when no call of it can come. The session's state store has to be ROCKS.
    """
    kinds = dict(calls.dtypes)
    rows = calls.select("model", "id", "ts", F.coalesce(F.col("tokens").cast("double"), F.lit(0.0)).alias("tokens"), F.floor(F.unix_seconds("ts") / 86_400).alias("day"))
    out = f"model {kinds['model']}, id {kinds['id']}, ts timestamp, tokens double, before double, open boolean"
    return rows.withWatermark("ts", late).groupBy("model").transformWithState(_Ledger(budget), out, "append", "EventTime")


def write_events(steps: DataFrame, path: str, checkpoint: str):
    """Starts a query that writes each micro-batch of progress events (qid, n, node, detail) as server-sent event text, batch by batch."""

    def put(batch: DataFrame, number: int) -> None:
        line = F.concat(F.lit("event: "), "node", F.lit("\ndata: "), "detail", F.lit("\n"))
        batch.select(line.alias("value")).write.mode("overwrite").text(f"{path}/batch={number}")

    return steps.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, size: str, slide: str | None, late: str, *keys: str) -> DataFrame:
    """Counts and sums of `value` by window and keys of events (ts, ...); rows later than `late` are dropped in a stream."""
    frame = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(frame, *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str, key: str) -> DataFrame:
    return events.groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n"))


def ledger_stream(calls: DataFrame, late: str = "1 day") -> DataFrame:
    """Tokens per day and model, for output mode update."""
    return calls.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("day"), "model").agg(F.sum("tokens").alias("tokens"))
