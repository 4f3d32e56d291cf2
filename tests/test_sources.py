"""Files, caches, evaluation and lookups."""

from pyspark.sql import functions as F

from quillon import schemas
from quillon.operators import evals, hierarchy, lookups
from quillon.sources import files, providers


def test_jsonl_and_builds(spark, tmp_path):
    base = str(tmp_path)
    assert files.read_jsonl(spark, f"{base}/none", "a int").count() == 0
    files.write_jsonl(spark.createDataFrame([(1,), (2,)], "a int"), f"{base}/rows")
    assert files.read_jsonl(spark, f"{base}/rows", "a int").count() == 2
    digest = files.source_digest(spark, f"{base}/rows/*.json")
    out = files.build_once(spark, base, digest, {"t": spark.range(3)})
    again = files.build_once(spark, base, digest, {"t": spark.range(9)})
    assert out == again and spark.read.parquet(f"{out}/t").count() == 3
    assert files.build_once(spark, base, digest, {"t": spark.range(9)}, force=True) == out and spark.read.parquet(f"{out}/t").count() == 9


def test_versions_and_log(spark, tmp_path):
    path = f"{tmp_path}/chunks"
    files.replace_version(spark.createDataFrame([("a", "v1"), ("b", "v2")], "id string, version string"), path)
    files.replace_version(spark.createDataFrame([("c", "v1")], "id string, version string"), path)
    assert {(r["id"], r["version"]) for r in spark.read.parquet(path).collect()} == {("c", "v1"), ("b", "v2")}
    old = spark.createDataFrame([(1, "x", "y")], "id int, a string, b string")
    files.append_log(old, old.withColumn("b", F.lit("z")), "id", f"{tmp_path}/log")
    assert [(r["field"], r["old"], r["new"]) for r in spark.read.option("header", True).csv(f"{tmp_path}/log").collect()] == [("b", "y", "z")]


def test_embeddings_are_cached(spark, tmp_path):
    cache = providers.Cache(spark, f"{tmp_path}/cache", schemas.EMBEDDING_CACHE)
    texts = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "id int, text string")
    out = providers.embed(texts, cache, "m", "t", providers.hashing_embedder(8)).collect()
    assert len(out) == 3 and all(len(r["vector"]) == 8 for r in out) and cache.stats().first()["n"] == 2

    def fails(_):
        raise AssertionError("asked again")

    assert providers.embed(texts, cache, "m", "t", fails).count() == 3


def test_keys(spark):
    import pytest

    rows = spark.createDataFrame([(1, "a"), (1, "b")], "id int, parent string")
    with pytest.raises(ValueError):
        schemas.assert_unique(rows, "id")
    with pytest.raises(ValueError):
        schemas.assert_fk(rows, "parent", spark.createDataFrame([("a",)], "k string"), "k")


def test_aggregates(spark):
    records = spark.createDataFrame([("lookup", 1.0, True, True), ("lookup", 0.0, True, False), ("table", None, False, True), ("table", 0.5, False, False)], "type string, fact_recall double, refused boolean, should boolean")
    by = {r["type"]: (r["n"], r["fact_recall"]) for r in evals.by_type(records, ["fact_recall"]).collect()}
    assert by == {None: (4, 0.5), "lookup": (2, 0.5), "table": (2, 0.5)}
    r = evals.precision_recall(records, "refused", "should").first()
    assert (r["precision"], r["recall"]) == (0.5, 0.5)


def test_trees_and_citations(spark):
    nodes = spark.createDataFrame([("s2", None, 0, "section", "two"), ("s2(1)", "s2", 1, "clause", "one"), ("s2(1)(a)", "s2(1)", 2, "clause", "a")], "id string, parent string, ord int, kind string, name string")
    tree = hierarchy.closure(nodes.select("id", "parent"))
    assert {(r["id"], r["ancestor"], r["depth"]) for r in tree.collect()} == {(r["pid"], r["ancestor"], r["depth"]) for r in hierarchy.id_closure(nodes, "id").collect()}
    assert {r["id"]: r["enclosing"] for r in hierarchy.enclosing(tree, nodes, ["section"]).collect()}["s2(1)(a)"] == "s2"
    assert {r["id"]: r["breadcrumb"] for r in hierarchy.breadcrumb(tree, nodes).collect()}["s2(1)(a)"] == "two · one · a"
    c = spark.createDataFrame([("s2(5)@3",), ("sch:XI:A",)], "id string").select(lookups.short_citation(F.col("id")).alias("c"))
    assert [r["c"] for r in c.collect()] == ["s. 2(5)", "Sch. XI:A"]
    rows = spark.createDataFrame([("r1", "t", "11", "x"), ("r2", "t", "2", "y"), ("r3", "t", "a", "z")], "row_id string, table_id string, sl_no string, row_heading string")
    assert [r["row_id"] for r in lookups.table_rows(rows, "t").collect()] == ["r2", "r1", "r3"]
    assert [r["id"] for r in hierarchy.suffix_duplicates(spark.createDataFrame([("a", 1), ("a", 2)], "id string, o int"), "id", "o").collect()] == ["a", "a~2"]
