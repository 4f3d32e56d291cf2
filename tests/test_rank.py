import math
import random

from pyspark.sql import functions as F

from quillon.operators import rank, retrieve


def lists(spark, *named):
    rows = [(0, n, float(w), r, i) for n, (w, ids) in enumerate(named) for r, i in enumerate(ids, 1)]
    return spark.createDataFrame(rows, "qid int, list_id int, weight double, rank int, id string")


def ids(df):
    return [r["id"] for r in df.orderBy("rank").collect()]


def pool(spark, text):
    return spark.createDataFrame([(0, r, i) for r, i in enumerate(text.split(), 1)], "qid int, rank int, id string")


def test_rrf(spark):
    assert ids(rank.rrf(lists(spark, (1, "xy"), (1, "yz")), 10)) == ["y", "x", "z"]
    assert ids(rank.rrf(lists(spark, (1, "x"), (5, "y")), 10)) == ["y", "x"]
    top = rank.rrf(lists(spark, (1, "abc")), 2).orderBy("rank").collect()
    assert len(top) == 2 and abs(top[0]["score"] - 1 / 61) < 1e-6


def test_slot_merge(spark):
    merged = rank.slot_merge(pool(spark, "a b c d e f"), pool(spark, "x y z"), 2, 2, 10)
    assert ids(merged) == list("abxycdef")
    assert ids(rank.slot_merge(pool(spark, "a b c"), pool(spark, "a x"), 2, 1, 10)) == list("abxc")
    assert ids(rank.front_merge(pool(spark, "a b c"), pool(spark, "c x"), 3)) == list("cxa")


def test_pack_skips_what_does_not_fit(spark):
    hits = spark.createDataFrame([(0, 1, "a", 50), (0, 2, "b", 80), (0, 3, "c", 40), (0, 4, "d", 20)], "qid int, rank int, id string, tokens int")
    out = rank.pack(hits, 100).orderBy("rank").collect()
    assert [(r["id"], r["used"]) for r in out] == [("a", 50), ("c", 90)]


def test_containers(spark):
    cover = spark.createDataFrame([("c1", "s393(1)"), ("c2", "s483")], "chunk string, pid string")
    tree = spark.createDataFrame([("s393(1)", "s393"), ("s393(1)", "s393(1)"), ("s483", "s483")], "pid string, ancestor string")
    refs = spark.createDataFrame([("s393",), ("s483",)], "ref string")
    assert [r["ref"] for r in retrieve.containers(refs, cover, tree).collect()] == ["s393"]


def test_joins_are_not_nested_loops(spark):
    cover = spark.createDataFrame([("c1", "s393(1)")], "chunk string, pid string")
    tree = spark.createDataFrame([("s393(1)", "s393")], "pid string, ancestor string")
    asked = spark.createDataFrame([(0, "s393", 1)], "qid int, ref string, ref_rank int")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid int, vector array<double>")
    c = spark.createDataFrame([("c1", [1.0, 0.0])], "id string, vector array<double>")
    plan = retrieve.under_ids(asked, cover, tree, q, c, 5)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_unknown_retriever(spark):
    import pytest

    with pytest.raises(ValueError):
        retrieve.hybrid({"magic": pool(spark, "a")}, {}, 3)


def test_knn_is_exact(spark):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(200, 8))
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vector array<double>")
    q = c.where("id < 5").select(F.col("id").alias("qid"), "vector")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for r in retrieve.knn(q, c, 3).collect():
        assert np.argsort(-(u[r["qid"]] @ u.T), kind="stable")[r["rank"] - 1] == r["id"]


def test_knn_ships_only_the_best_of_each_task(spark, monkeypatch):
    """Blocks of rows and queries in tasks, ties by id across blocks, k of each group, ids that are strings, vectors of another length, and no shuffle of pairs."""
    rng = random.Random(4)
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 5)
    monkeypatch.setattr(retrieve, "ROWS", 7)
    monkeypatch.setattr(retrieve, "ASKED", 2)
    vectors = [[float(rng.randint(-2, 2)) for _ in range(3)] for _ in range(240)]
    rows = [(f"d{i}", v, "abc"[i % 3] if i % 11 else None) for i, v in enumerate(vectors)] + [("long", [1.0, 2.0, 3.0, 4.0], "a"), ("none", None, "a")]
    corpus = spark.createDataFrame(rows, "id string, vector array<float>, g string")
    asked = [(f"q{i}", v) for i, v in enumerate(vectors[:13])]
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)), 9)
    known = [(i, v, g) for i, v, g in rows if v and len(v) == 3 and any(v)]
    for per in (None, "g"):
        found = retrieve.knn(spark.createDataFrame(asked, "qid string, vector array<float>"), corpus, 4, per=per)
        got = sorted((r["qid"], (r["g"] or "") if per else "", r["rank"], r["id"], round(r["score"], 7)) for r in found.collect())
        want = []
        for q, u in asked:
            for g in ["a", "b", "c", None] if per else [""]:
                best = sorted((-cos(u, v), i) for i, v, h in known if not per or h == g)[:4] if any(u) else []
                want += [(q, g or "", n, i, round(-s, 7)) for n, (s, i) in enumerate(best, 1)]
        assert got == sorted(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
