"""Operators on ranked lists: fusion, merging, packing. A list is rows (qid, rank from 1, id, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_C = 60


def ranked(rows: DataFrame, by: list[Column], k: int | None = None, key: str = "qid") -> DataFrame:
    """Numbers the rows of each query from 1 in the given order, and keeps k of them."""
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*by)))
    return out.where(F.col("rank") <= k) if k else out


def rrf(lists: DataFrame, k: int, c: int = RRF_C) -> DataFrame:
    """Weighted reciprocal rank fusion of rows (qid, list_id, weight, rank, id): score is the sum of weight / (c + rank).

    Ordered by score, then id; an id keeps the list that names it first. The score is rounded after ordering.
    """
    first = F.min("list_id").alias("first_list")
    fused = lists.groupBy("qid", "id").agg(F.sum(F.col("weight") / (F.lit(c) + F.col("rank"))).alias("score"), first)
    return ranked(fused, [F.round("score", 12).desc(), F.col("id")], k).withColumn("score", F.round("score", 6))


def slot_merge(base: DataFrame, extra: DataFrame, keep: int, slots: int, k: int) -> DataFrame:
    """The first `keep` of base, then up to `slots` of extra that aren't among these, then the rest of base; each id once."""
    head = base.where(F.col("rank") <= keep).select("qid", "id", F.lit(0).alias("band"), "rank")
    fresh = extra.join(head.select("qid", "id"), ["qid", "id"], "left_anti")
    fresh = ranked(fresh.groupBy("qid", "id").agg(F.min("rank").alias("at")), [F.col("at"), F.col("id")], slots)
    fresh = fresh.select("qid", "id", F.lit(1).alias("band"), "rank")
    rest = base.where(F.col("rank") > keep).select("qid", "id", F.lit(2).alias("band"), "rank")
    rest = rest.join(fresh.select("qid", "id"), ["qid", "id"], "left_anti")
    merged = head.unionByName(fresh).unionByName(rest)
    return ranked(merged.withColumnRenamed("rank", "place"), [F.col("band"), F.col("place"), F.col("id")], k).select("qid", "rank", "id", "band")


def front_merge(base: DataFrame, front: DataFrame, k: int) -> DataFrame:
    """All of front before base, cut to k."""
    return slot_merge(base, front, 0, k, k)


def pack(hits: DataFrame, budget: int, tokens: str = "tokens", key: str = "qid") -> DataFrame:
    """Greedy packing in rank order: a hit that does not fit is skipped, and later ones may still fit.

    A query's list is folded in one row: it is as long as its retriever's k, which bounds it.
    """
    rows = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(tokens).alias("t"), "id"))).alias("hits"))
    kind = dict(hits.dtypes)["id"]
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<struct<rank:int,id:{kind},used:bigint>>").alias("taken"))

    def take(state: Column, hit: Column) -> Column:
        used = state["used"] + hit["t"]
        item = F.struct(hit["rank"].cast("int").alias("rank"), hit["id"].alias("id"), used.cast("long").alias("used"))
        return F.when(used <= budget, F.struct(used.cast("long").alias("used"), F.concat(state["taken"], F.array(item)).alias("taken"))).otherwise(state)

    taken = rows.select(key, F.explode(F.aggregate("hits", start, take, lambda s: s["taken"])).alias("x"))
    return taken.select(key, "x.rank", "x.id", "x.used")
