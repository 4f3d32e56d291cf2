"""Embedding and answering providers behind keyed caches. The providers here are deterministic stand-ins that need no network."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import schemas
from quillon.functions.text import cache_key
from quillon.sources.files import exists

Embed = Callable[[list[str]], np.ndarray]


def hashing_embedder(dim: int = 64) -> Embed:
    """Counts of words hashed to `dim` signed places, scaled to length 1: a stand-in for a model."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % dim] += 1 if h >> 63 else -1
            row /= np.linalg.norm(row) or 1
        return out

    return embed


class Cache:
    """A keyed table of Parquet files: look up by join, put by append. The first row of a key counts."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def read(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path).dropDuplicates(["key"])

    def missing(self, keys: DataFrame) -> DataFrame:
        return keys.dropDuplicates(["key"]).join(self.read().select("key"), "key", "left_anti")

    def put(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)

    def stats(self) -> DataFrame:
        return self.read().agg(F.count(F.lit(1)).alias("n"))


def embed(texts: DataFrame, cache: Cache, model: str, task: str, provider: Embed) -> DataFrame:
    """Adds the vectors of rows (id, text): distinct texts that the cache lacks go to the provider in batches, once."""
    keyed = texts.withColumn("key", cache_key(F.lit(model), F.lit(task), F.coalesce("text", F.lit(""))))
    todo = cache.missing(keyed.select("key", F.coalesce("text", F.lit("")).alias("text")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            v = retrying(lambda t=df["text"].tolist(): provider(t))
            yield pd.DataFrame({"key": df["key"], "model": model, "task": task, "dim": v.shape[1], "vec": list(v)})

    cache.put(todo.mapInPandas(run, schemas.EMBEDDING_CACHE))
    return keyed.join(cache.read().select("key", F.col("vec").alias("vector")), "key", "left").drop("key")


def answer(prompts: DataFrame, cache: Cache, model: str, reply: Callable[[str], str]) -> DataFrame:
    """Replies to rows (qid, request), by the hash of the request; cached replies are used again."""
    keyed = prompts.withColumn("key", F.sha2(F.to_json(F.struct(F.lit(model).alias("model"), "request")), 256))
    todo = cache.missing(keyed.select("key", "request"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield pd.DataFrame({"key": df["key"], "model": model, "request": df["request"], "response": [retrying(lambda r=r: reply(r)) for r in df["request"]], "created": ""})

    cache.put(todo.mapInPandas(run, schemas.MODEL_CACHE))
    return keyed.join(cache.read().select("key", "response"), "key", "left").drop("key")


def word_overlap(query: str, texts: list[str]) -> list[float]:
    """The share of the query's words that each text has: a stand-in for a reranking model."""
    words = set(query.lower().split())
    return [len(words & set(t.lower().split())) / max(len(words), 1) for t in texts]


def rerank(query_hits: DataFrame, top: int, cache: Cache, model: str = "overlap", provider: Callable[[str, list[str]], list[float]] = word_overlap) -> DataFrame:
    """The `top` hits (qid, id, query, text) of each query by a provider's scores. Queries with the same hits are asked once, and kept.

    A key is the query with its hits in order; one query's hits go to the provider in one call, and are `pool` many at most.
    """
    from quillon.operators.rank import ranked

    lists = query_hits.groupBy("qid", "query").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("docs"))
    keyed = lists.withColumn("key", F.sha2(F.to_json(F.struct(F.lit(model).alias("model"), "query", F.col("docs.text").alias("texts"))), 256))
    todo = cache.missing(keyed.select("key", "query", F.col("docs.text").alias("texts")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            scores = [[{"index": k, "score": float(x)} for k, x in enumerate(retrying(lambda q=q, t=t: provider(q, list(t))))] for q, t in zip(df["query"], df["texts"], strict=True)]
            yield pd.DataFrame({"key": df["key"], "model": model, "result": scores})

    cache.put(todo.mapInPandas(run, schemas.RERANK_CACHE))
    found = keyed.join(cache.read().select("key", "result"), "key").select("qid", F.explode(F.arrays_zip("docs", "result")).alias("x"))
    scored = found.select("qid", "x.docs.id", F.col("x.result.score").alias("score"))
    return ranked(scored, [F.desc("score"), F.col("id")], top)


class Refused(Exception):
    """A provider's refusal that is worth another try."""


def retrying(call: Callable, attempts: int = 6, first_wait: float = 1.0, longest: float = 60.0, sleep: Callable[[float], None] = time.sleep):
    """call(), tried again after Refused with doubling waits; the last refusal is raised."""
    for k in range(attempts):
        try:
            return call()
        except Refused:
            if k == attempts - 1:
                raise
            sleep(min(first_wait * 2**k, longest))
    raise ValueError("attempts must be positive")
