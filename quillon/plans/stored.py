"""Registered queries over stored tables: the inverted index, loads of several tables at once, merges into buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import textindex
from quillon.plans.catalog import _FTS, _benchmark, _texts, query
from quillon.scratch import scratch_path
from quillon.sources import buckets, snapshots
from quillon.tables import load


@query(f"WITH {_FTS} SELECT qid, rank, id, score FROM ftsr WHERE rank <= 10")
def index_append_search(spark: SparkSession, base: str) -> DataFrame:
    """An index of the even documents, to which the odd ones are added, twice, then merged and searched."""
    root, docs = scratch_path(spark, "text-index"), _texts(spark, base)
    textindex.append(spark, root, docs.where("id % 2 = 0"))
    textindex.append(spark, root, docs.where("id % 2 = 1"))
    textindex.append(spark, root, docs)  # nothing is left to add
    return textindex.search(spark, root, _benchmark(spark, base), 10)


@query("""WITH l AS (SELECT * FROM labels WHERE doc_id % 3 <> 0) SELECT 'documents' AS name, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents UNION ALL SELECT 'labels', count(*), sum(doc_id)::BIGINT FROM l
UNION ALL SELECT 'pages', 2 * count(*), (2 * sum(page_id))::BIGINT FROM pages UNION ALL SELECT 'labelled', count(*), sum(doc_id)::BIGINT FROM documents JOIN l USING (doc_id)""")
def snapshot_loads(spark: SparkSession, base: str) -> DataFrame:
    """Three tables loaded at once, one replaced by part of itself, one added to, and all read through one pointer."""
    root = scratch_path(spark, "corpus")
    tables = {t: load(spark, base, t) for t in ("documents", "labels", "pages")}
    snapshots.load(spark, root, tables)
    snapshots.load(spark, root, {"labels": snapshots.read(spark, root, "labels").where("doc_id % 3 <> 0")})
    snapshots.load(spark, root, {"pages": tables["pages"]}, append=True)
    pointer = snapshots.current(spark, root)
    rows = {t: snapshots.read(spark, root, t, pointer) for t in tables}
    rows["labelled"] = rows["documents"].join(rows["labels"], "doc_id")
    parts = [df.agg(F.count(F.lit(1)).alias("n"), F.sum("page_id" if t == "pages" else "doc_id").alias("ids")).select(F.lit(t).alias("name"), "n", "ids") for t, df in rows.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("""WITH fresh AS (SELECT doc_id, 9 AS quality, 0 AS toxic FROM documents WHERE n_chars > 2000), gone AS (SELECT doc_id FROM fresh WHERE doc_id % 10 = 0)
SELECT doc_id, quality, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM gone) AND (toxic = 1 OR doc_id NOT IN (SELECT doc_id FROM fresh))
UNION ALL SELECT doc_id, quality, toxic FROM fresh WHERE doc_id NOT IN (SELECT doc_id FROM gone) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def merge_stored(spark: SparkSession, base: str) -> DataFrame:
    """Labels in buckets, merged with rows of long documents: toxic ones stay, ids that end in 0 are removed, new ones come in."""
    path = scratch_path(spark, "labels")
    buckets.create(load(spark, base, "labels").select("doc_id", "quality", "toxic"), path, "doc_id")
    fresh = load(spark, base, "documents").where("n_chars > 2000").select("doc_id", F.lit(9).alias("quality"), F.lit(0).alias("toxic"))
    buckets.merge(spark, path, fresh, update=F.col("old.toxic") != 1, delete=F.col("new.doc_id") % 10 == 0)
    return buckets.read(spark, path).drop("bucket")


@query("SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE source = 'src7')")
def bucket_lookup(spark: SparkSession, base: str) -> DataFrame:
    """Labels of one source's documents, looked up in the buckets of their ids."""
    path = scratch_path(spark, "labels")
    buckets.create(load(spark, base, "labels"), path, "doc_id")
    return buckets.lookup(spark, path, load(spark, base, "documents").where("source = 'src7'")).select("doc_id", "quality")
