"""A stored inverted index: postings in buckets of terms, cut into blocks of documents with their maxima.

A segment is what one build or append wrote: `postings`, a row for each term and block of documents (ids and term frequencies
in arrays, and the largest frequency), in a folder for each bucket of terms, and `lengths`, a row for each document. The
segments that count are named by a snapshot, so an append is seen as a whole. Blocks cut the documents of a segment, as
their tasks read them, into DOCS each at most, so that no row, and no task, holds all postings of a frequent term.

A search reads the buckets of its terms, and of these first only the maxima. A block's documents score at most the sum of its terms'
maxima, and in each block some document reaches the largest of them. So the k-th best of these, over blocks, is a score that k
documents reach; blocks that cannot reach it are never opened.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import query_terms
from quillon.operators.rank import ranked
from quillon.scratch import materialize
from quillon.sources import snapshots

BUCKETS = 64
#: Documents in a block, at most.
DOCS = 128
#: Documents whose words a task counts where they have to be dealt out, and documents whose postings of a bucket it sorts.
COUNTED, SORTED = 20_000, 200_000
#: Search terms that are sent to every task; more meet the postings in a shuffle.
TERM_BLOCK = 100_000
WEIGHT = 0.1


def _bucket(term: str = "term") -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def append(spark: SparkSession, root: str, texts: DataFrame) -> int:
    """Adds texts (id, text) in a segment of their own, and returns how many. Ids that the index holds are left out, so an append may be repeated.

    Words are counted block by block in the tasks that read the texts; only postings are shuffled. A task that is
    repeated has to read its texts in the same order, as those of files are.
    """
    pointer = snapshots.current(spark, root)
    rows = texts.select("id", F.coalesce("text", F.lit("")).alias("text"))
    if pointer:
        rows = materialize(rows.join(snapshots.read(spark, root, "lengths", pointer).select("id"), "id", "left_anti"), "index-texts")
    total, said = rows.select("id").groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if total == 0 and pointer:
        return 0
    if said > total:
        rows = materialize(rows.dropDuplicates(["id"]), "index-texts")
    folder = f"segments/{uuid.uuid4().hex}"
    lower, kind = ["id", F.lower("text").alias("text")], dict(rows.dtypes)["id"]
    blocks = _spread(rows, total).select(*lower).mapInArrow(_counted, _schema(kind)).withColumn("bucket", _bucket())
    parts = -(-total // SORTED) or 1
    dealt = blocks.repartition(BUCKETS * parts, "bucket", F.pmod("block", F.lit(parts))).sortWithinPartitions("bucket", "term", "block")
    dealt.select("term", "block", "docs", "most", F.size("docs").alias("n"), "bucket").write.partitionBy("bucket").parquet(f"{root}/{folder}/postings")
    rows.select(*lower).mapInArrow(_lengths, f"id {kind}, n_words int").write.parquet(f"{root}/{folder}/lengths")
    before = pointer or {"number": 0, "tables": {}, "counts": {}}
    placed = {t: [*before["tables"].get(t, []), f"{folder}/{t}"] for t in ("postings", "lengths")}
    snapshots.publish(spark, root, placed, {"lengths": before["counts"].get("lengths", 0) + total}, before["number"])
    return total


def _spread(rows: DataFrame, total: int) -> DataFrame:
    """Rows where they lie, if that is in enough tasks, which their ids alone tell; else dealt out by id, and in its order."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    most = rows.select("id").groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    return rows if most <= max(2 * total // cores, DOCS) else rows.repartition(max(2 * cores, -(-total // COUNTED)), "id").sortWithinPartitions("id")


def _schema(kind: str) -> str:
    return f"term string, block long, docs array<struct<id:{kind},tf:int>>, most int"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of a task's documents (id, text in lower case), in blocks of DOCS as they come."""
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        for at in range(0, batch.num_rows, DOCS):
            piece = batch.slice(at, DOCS)
            words = pc.split_pattern_regex(piece["text"], "[^a-z0-9]+")
            flat, doc = words.flatten(), np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
            some = pc.not_equal(flat, "")  # before a first mark and after a last one
            flat, doc = flat.filter(some).dictionary_encode(), doc[some.to_numpy(zero_copy_only=False)]
            if len(flat):
                places, tf = np.unique(flat.indices.to_numpy().astype(np.int64) * DOCS + doc, return_counts=True)
                start = np.searchsorted(places, np.arange(len(flat.dictionary) + 1) * DOCS)
                docs = pa.StructArray.from_arrays([piece["id"].take(pa.array(places % DOCS)), pa.array(tf, pa.int32())], ["id", "tf"])
                cols = [flat.dictionary, pa.array(np.full(len(start) - 1, block)), pa.ListArray.from_arrays(pa.array(start, pa.int32()), docs), pa.array(np.maximum.reduceat(tf, start[:-1]), pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, ["term", "block", "docs", "most"])
            block += 1


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["id"], pc.count_substring_regex(batch["text"], "[a-z0-9]+")], ["id", "n_words"])


def merge(spark: SparkSession, root: str) -> None:
    """Puts all segments together in one. Postings are cut into blocks anew. Searches under way go on with the old segments, which stay."""
    pointer = snapshots.current(spark, root)
    if pointer is None or len(pointer["tables"]["lengths"]) < 2:
        return
    total, folder = pointer["counts"]["lengths"], f"segments/{uuid.uuid4().hex}"
    block = F.pmod(F.xxhash64("d.id"), F.lit(max(1, -(-total // DOCS)))).alias("block")
    flat = _postings(spark, root, pointer).select("term", "bucket", F.explode("docs").alias("d")).select("term", "bucket", block, "d")
    blocks = flat.groupBy("bucket", "term", "block").agg(F.array_sort(F.collect_list("d")).alias("docs"), F.max("d.tf").alias("most"))
    out = blocks.select("term", "block", "docs", "most", F.size("docs").alias("n"), "bucket")
    out.repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{root}/{folder}/postings")
    snapshots.read(spark, root, "lengths", pointer).write.parquet(f"{root}/{folder}/lengths")
    snapshots.publish(spark, root, {t: [f"{folder}/{t}"] for t in ("postings", "lengths")}, pointer["counts"], pointer["number"])


def _postings(spark: SparkSession, root: str, pointer: dict) -> DataFrame:
    """All segments' postings with their bucket (a partition) and the number of their segment."""
    kind = snapshots.read(spark, root, "lengths", pointer).schema["id"].dataType.simpleString()
    schema = f"{_schema(kind)}, n int, bucket int"
    out = None
    for k, folder in enumerate(pointer["tables"]["postings"]):
        part = spark.read.schema(schema).parquet(f"{root}/{folder}").withColumn("segment", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("qid", F.explode(query_terms(F.col("text"))).alias("term")).withColumn("bucket", _bucket())


def bounds(asked: DataFrame, stored: DataFrame, k: int) -> DataFrame:
    """(qid, segment, block, upper, opened): every block that holds a term of a query, its bound, and whether a search for k opens it."""
    found = asked.join(stored.select("bucket", "term", "segment", "block", "most"), ["bucket", "term"])
    found = materialize(found.groupBy("qid", "segment", "block").agg(F.sum("most").alias("upper"), F.max("most").alias("lower")), "bounds")
    sure = ranked(found, [F.desc("lower"), F.col("segment"), F.col("block")], k).where(F.col("rank") == k).select("qid", F.col("lower").alias("sure"))
    return found.join(sure, "qid", "left").select("qid", "segment", "block", "upper", (F.col("upper") >= F.coalesce("sure", F.lit(0))).alias("opened"))


def search(spark: SparkSession, root: str, queries: DataFrame, k: int) -> DataFrame:
    """(qid, rank, id, score) of queries (qid, text): any of their terms may occur; each occurrence weighs WEIGHT; of equal scores the smaller id first."""
    asked = materialize(_asked(queries), "asked")
    buckets = [r[0] for r in asked.select("bucket").distinct().collect()]  # BUCKETS numbers at most
    stored = _postings(spark, root, snapshots.current(spark, root)).where(F.col("bucket").isin(buckets))  # a partition filter
    # maxima only: the arrays of blocks that stay closed are never read
    opened = bounds(asked, stored, k).where("opened").select("qid", "segment", "block")
    terms = asked.select("bucket", "term").distinct()
    if terms.count() <= TERM_BLOCK:  # other terms of the buckets are left out before a shuffle
        terms = F.broadcast(terms)
    found = stored.select("bucket", "term", "segment", "block", "docs").join(terms, ["bucket", "term"], "left_semi")
    hits = asked.join(opened, "qid").join(found, ["bucket", "term", "segment", "block"])
    scored = hits.select("qid", F.explode("docs").alias("d")).groupBy("qid", "d.id").agg(F.round(WEIGHT * F.sum("d.tf"), 6).alias("score"))
    return ranked(scored, [F.desc("score"), F.col("id")], k).select("qid", "rank", "id", "score")


def opened_share(spark: SparkSession, root: str, queries: DataFrame, k: int) -> DataFrame:
    """(qid, blocks, opened): how many blocks hold a term of each query, and how many a search for k opens."""
    found = bounds(_asked(queries), _postings(spark, root, snapshots.current(spark, root)), k)
    return found.groupBy("qid").agg(F.count(F.lit(1)).alias("blocks"), F.count_if("opened").alias("opened"))
