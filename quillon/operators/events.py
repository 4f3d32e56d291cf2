"""Operators on ordered rows of a key: as-of and nearest joins, line fragments, rate limits and ledgers."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.scratch import materialize


def asof_next(rows: DataFrame, key: str | list[str], order: Column, is_target: Column, value: Column, out: str) -> DataFrame:
    """Adds to each row the value of the next target row of its key, strictly later in order; ties aren't later, and of equal later targets any one counts.

    One sort by key instead of a range join. Rows are read from the last one back, and a frame that only grows
    keeps the last target seen: the work grows with the rows of a key, not with their square.
    """
    keys = [key] if isinstance(key, str) else key
    back = Window.partitionBy(*keys).orderBy(F.desc("_at"))
    seen = F.last(F.when(is_target, F.struct(value.alias("v"))), ignorenulls=True).over(back.rangeBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_at", order).withColumn(out, seen["v"]).drop("_at")


def nearest(rows: DataFrame, key: str | list[str], place: str, is_target: Column, value: str, most: float | None = None) -> DataFrame:
    """Adds the value and distance of the nearest target row of the key by place; of equal distances the earlier one.

    Two sorts of a key's rows, each with a frame that only grows.
    """
    keys = [key] if isinstance(key, str) else key
    target = F.when(is_target, F.struct(F.col(place).alias("at"), F.col(value).alias("v")))
    so_far = lambda order: F.last(target, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    out = rows.withColumn("_b", so_far(F.asc(place))).withColumn("_a", so_far(F.desc(place)))
    gap_b, gap_a = F.col(place) - F.col("_b.at"), F.col("_a.at") - F.col(place)
    first = F.col("_b").isNotNull() & (F.col("_a").isNull() | (gap_b <= gap_a))
    out = out.withColumn("near", F.when(first, F.col("_b.v")).otherwise(F.col("_a.v"))).withColumn("gap", F.when(first, gap_b).otherwise(gap_a)).drop("_a", "_b")
    if most is not None:
        out = out.withColumn("near", F.when(F.col("gap") <= most, F.col("near")))
    return out


def successors(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds `next`: the smallest later value of `order` among rows of the same keys (distinct values), null for the last.

    Rows are range-partitioned by keys and order, so a hot key lies in several tasks; what a partition lacks, the first row
    of the one after it, is carried over: one row for each partition.
    """
    placed = rows.select(*keys, order).repartitionByRange(*keys, order).sortWithinPartitions(*keys, order)
    placed = materialize(placed.withColumn("_mid", F.monotonically_increasing_id()), "successors")
    part = F.shiftrightunsigned("_mid", 33)
    placed = placed.withColumn("_part", part)
    within = Window.partitionBy("_part").orderBy("_mid")
    here = placed.withColumn("_then", F.lead(F.struct(*keys, order)).over(within))
    heads = placed.groupBy("_part").agg(F.min_by(F.struct(*keys, order), "_mid").alias("_head"))
    after = heads.select("_part", F.lead("_head").over(Window.orderBy("_part")).alias("_over"))  # one row for each partition
    both = here.join(F.broadcast(after), "_part").withColumn("_n", F.coalesce("_then", "_over"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"_n.{k}").eqNullSafe(F.col(k))
    return both.select(*keys, order, F.when(F.col("_n").isNotNull() & same, F.col(f"_n.{order}")).alias("next"))


def group_runs(rows: DataFrame, key: str, order: list[str], starts: Column) -> DataFrame:
    """Numbers runs of rows: a row where `starts` holds begins a new one. starts may use lag over the same order."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("run", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def merge_fragments(lines: DataFrame, most: float = 2.5, back: bool = False) -> DataFrame:
    """Joins fragments (doc_id, line_index, y0, x0, text) of one visual line: next to each other in height, and to the right.

    back: a step back in height, however far, begins no new line. Fragments without a height or place stand alone.
    """
    w = Window.partitionBy("doc_id").orderBy("line_index")
    step = F.col("y0") - F.lag("y0").over(w)
    starts = F.coalesce(((step if back else F.abs(step)) >= most) | (F.col("x0") <= F.lag("x0").over(w)), F.lit(True))
    runs = group_runs(lines.withColumn("_s", starts), "doc_id", ["line_index"], F.col("_s"))
    parts = runs.groupBy("doc_id", "run").agg(F.min("line_index").alias("line_index"), F.array_sort(F.collect_list(F.struct("line_index", "text"))).alias("p"), F.count("text").alias("n"))
    return parts.select("doc_id", "line_index", F.when(F.col("n") > 0, F.array_join(F.transform("p", lambda x: x["text"]), " ")).alias("text"))


def forward_fill(rows: DataFrame, key: str, order: str, col: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(col, F.last(col, ignorenulls=True).over(w))


class SlidingLimit:
    """At most `limit` (and `tokens`) admitted in any window; what is rejected uses no quota.

    lenient: an empty window admits a call of any size.
    """

    def __init__(self, limit: int, window: float, tokens: float | None = None, lenient: bool = False):
        self.limit, self.window, self.tokens, self.lenient = limit, window, tokens, lenient
        self.admitted: deque[tuple[float, float]] = deque()
        self.used = 0.0

    def ask(self, at: float, cost: float = 0.0) -> float:
        """0 if admitted, else the seconds until it could be."""
        while self.admitted and self.admitted[0][0] <= at - self.window:
            self.used -= self.admitted.popleft()[1]
        fits = len(self.admitted) < self.limit and (self.tokens is None or self.used + cost <= self.tokens)
        if fits or (self.lenient and not self.admitted):
            self.admitted.append((at, cost))
            self.used += cost
            return 0.0
        return max(0.0, self.admitted[0][0] + self.window - at) if self.admitted else self.window


def rate_limited(asks: DataFrame, limit: int, window: float = 3600.0, tokens: float | None = None, lenient: bool = False) -> DataFrame:
    """Adds admitted and retry_after to rows (client, at in seconds, id, cost).

    Rows are dealt by client and sorted by time; a task folds them in one pass and holds one client's window,
    never a client's rows.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, state = object(), None
        for df in batches:
            waits = []
            for c, at, cost in zip(df["client"], df["at"], df["cost"], strict=True):
                if c != client:
                    client, state = c, SlidingLimit(limit, window, tokens, lenient)
                waits.append(state.ask(at, cost))
            yield df.assign(admitted=[w == 0 for w in waits], retry_after=waits)

    rows = asks.select("client", F.col("at").cast("double").alias("at"), "id", F.col("cost").cast("double").alias("cost"))
    kinds = dict(rows.dtypes)
    ordered = rows.repartition("client").sortWithinPartitions("client", "at", "id")
    return ordered.mapInPandas(fold, f"client {kinds['client']}, at double, id {kinds['id']}, cost double, admitted boolean, retry_after double")


def ledger(rows: DataFrame) -> DataFrame:
    """Tokens by day (UTC) and model."""
    return rows.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "model").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("calls"))


def within_ledger(rows: DataFrame, budget: float) -> DataFrame:
    """Adds `open`: whether the day's tokens of the model before this row are below the budget."""
    w = Window.partitionBy(F.date_format("ts", "yyyy-MM-dd"), "model").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum("tokens").over(w), F.lit(0.0))).withColumn("open", F.col("before") < budget)
