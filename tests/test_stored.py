"""Stored tables: loads that die, merges that die, and the inverted index against a scan."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import retrieve, textindex
from quillon.sources import buckets, snapshots


def rows(spark, n, m=0):
    return spark.createDataFrame([(k, f"v{k + m}") for k in range(n)], "k long, v string")


def failing(spark):
    return rows(spark, 5).withColumn("v", F.when(F.col("k") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))


def test_load_that_dies_changes_no_table(spark, tmp_path):
    root = str(tmp_path)
    assert snapshots.current(spark, root) is None
    assert snapshots.load(spark, root, {"a": rows(spark, 3), "b": rows(spark, 4)}) == {"a": 3, "b": 4}
    with pytest.raises(Exception, match="lost"):
        snapshots.load(spark, root, {"a": rows(spark, 9), "b": failing(spark)})
    assert snapshots.read(spark, root, "a").count() == 3 and snapshots.read(spark, root, "b").count() == 4
    # readers that resolved the pointer before a load go on with what it named
    before = snapshots.current(spark, root)
    snapshots.load(spark, root, {"a": snapshots.read(spark, root, "a").where("k > 0"), "c": rows(spark, 1)})
    assert snapshots.read(spark, root, "a").count() == 2 and snapshots.read(spark, root, "a", before).count() == 3
    assert snapshots.load(spark, root, {"a": rows(spark, 1)}, append=True) == {"a": 3}
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, root, "d")


def test_two_loads_from_one_state(spark, tmp_path):
    root = str(tmp_path)
    snapshots.load(spark, root, {"a": rows(spark, 3)})
    snapshots.publish(spark, root, {"a": ["loads/x/a"]}, {}, 1)
    with pytest.raises(RuntimeError, match="moved on"):
        snapshots.publish(spark, root, {"a": ["loads/y/a"]}, {}, 1)
    assert snapshots.current(spark, root)["tables"] == {"a": ["loads/x/a"]}


def test_vacuum(spark, tmp_path):
    root = str(tmp_path)
    snapshots.load(spark, root, {"a": rows(spark, 3), "b": rows(spark, 2)})
    for _ in range(2):
        snapshots.load(spark, root, {"a": rows(spark, 4)})
    assert len(snapshots.vacuum(spark, root)) == 1  # the first load still holds b
    assert snapshots.numbers(spark, root) == [3] and snapshots.read(spark, root, "b").count() == 2 and snapshots.read(spark, root, "a").count() == 4


def files(path):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(f"{path}/rows") for f in names if "bucket=" in d and f.endswith(".parquet")}


def stored(spark, path):
    return {r["k"]: r["v"] for r in buckets.read(spark, path).collect()}


def test_merge_leaves_other_buckets_alone(spark, tmp_path):
    path = f"{tmp_path}/t"
    buckets.create(rows(spark, 200), path, "k", 16)
    before = files(path)
    changes = spark.createDataFrame([(7, "new"), (500, "added")], "k long, v string")
    touched = buckets.merge(spark, path, changes)
    after = files(path)
    assert 1 <= len(touched) <= 2
    changed = {f.split("bucket=")[1].split("/")[0] for f, _ in set(before.items()) ^ set(after.items())}
    assert changed == {str(b) for b in touched}
    assert stored(spark, path) == {k: f"v{k}" for k in range(200)} | {7: "new", 500: "added"}
    assert buckets.merge(spark, path, changes.where("k < 0")) == []


def test_merge_conditions(spark, tmp_path):
    path = f"{tmp_path}/t"
    buckets.create(rows(spark, 6), path, "k", 4)
    changes = spark.createDataFrame([(0, "keep"), (1, "new"), (2, None), (9, "nine"), (10, None)], "k long, v string")
    buckets.merge(spark, path, changes, update=F.col("old.v") != "v0", delete=F.col("new.v").isNull())
    assert stored(spark, path) == {0: "v0", 1: "new", 3: "v3", 4: "v4", 5: "v5", 9: "nine"}
    buckets.merge(spark, path, spark.createDataFrame([(3, "x"), (77, "y")], "k long, v string"), insert=False)
    assert stored(spark, path)[3] == "x" and 77 not in stored(spark, path)
    buckets.merge(spark, path, buckets.read(spark, path), delete=F.lit(True))  # buckets without a row are removed
    assert stored(spark, path) == {} or not files(path)


@pytest.mark.parametrize("overwritten", [False, True])
def test_merge_that_dies_in_place_is_finished(spark, tmp_path, monkeypatch, overwritten):
    path = f"{tmp_path}/t"
    buckets.create(rows(spark, 50), path, "k", 8)

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(snapshots if overwritten else buckets, "remove" if overwritten else "_write", dies)
        with pytest.raises(KeyboardInterrupt):
            buckets.merge(spark, path, rows(spark, 3, 100))
    want = {k: f"v{k}" for k in range(50)} | {k: f"v{k + 100}" for k in range(3)}
    assert stored(spark, path) == want  # readers already see it
    buckets.recover(spark, path)
    assert stored(spark, path) == want and not os.path.exists(f"{path}/pending")


def test_merge_that_dies_early_changes_nothing(spark, tmp_path):
    path = f"{tmp_path}/t"
    buckets.create(rows(spark, 20), path, "k", 8)
    with pytest.raises(Exception, match="lost"):
        buckets.merge(spark, path, failing(spark))
    assert stored(spark, path) == {k: f"v{k}" for k in range(20)}


def test_lookup_reads_only_its_buckets(spark, tmp_path):
    path = f"{tmp_path}/t"
    buckets.create(rows(spark, 100), path, "k", 16)
    found = buckets.lookup(spark, path, spark.createDataFrame([(3,), (3,), (99,), (1000,)], "k long"))
    assert {r["k"] for r in found.collect()} == {3, 99}


# ---------------------------------------------------------------------- the inverted index


def texts(spark, n, seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    return spark.createDataFrame([(k, None if k % 50 == 7 else " ".join(r.choices(vocabulary[: 1 + r.randrange(200)], k=r.randrange(40))) + (" rare" * 9 if k % 97 == 0 else "")) for k in range(n)], "id long, text string")


QUERIES = [(1, "rare waa"), (2, "wab wac"), (3, "nothing there"), (4, ""), (5, "Wba, wca; WDA")]


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_index_against_a_scan(spark, tmp_path):
    root, docs, q = f"{tmp_path}/i", texts(spark, 1500), spark.createDataFrame(QUERIES, "qid int, text string")
    assert textindex.append(spark, root, docs.where("id < 900")) == 900
    assert textindex.append(spark, root, docs) == 600 and textindex.append(spark, root, docs) == 0
    want = found(retrieve.full_text(q, docs, 7))
    assert want and found(textindex.search(spark, root, q, 7)) == want
    opened = {r["qid"]: (r["blocks"], r["opened"]) for r in textindex.opened_share(spark, root, q, 3).collect()}
    assert opened[1][1] < opened[1][0]  # blocks that can't reach the third best stay closed
    textindex.merge(spark, root)
    assert len(snapshots.current(spark, root)["tables"]["postings"]) == 1 and found(textindex.search(spark, root, q, 7)) == want
    assert snapshots.read(spark, root, "lengths").count() == 1500


def test_index_reads_buckets_of_its_terms(spark, tmp_path):
    root = f"{tmp_path}/i"
    textindex.append(spark, root, texts(spark, 100))
    plan = textindex.search(spark, root, spark.createDataFrame([(1, "waa")], "qid int, text string"), 3)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters: [")[-1].split("]")[0]


def test_append_that_dies_adds_nothing(spark, tmp_path):
    root = f"{tmp_path}/i"
    textindex.append(spark, root, texts(spark, 50))
    bad = texts(spark, 60).withColumn("text", F.when(F.col("id") == 55, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        textindex.append(spark, root, bad)
    assert snapshots.read(spark, root, "lengths").count() == 50
    empty = f"{tmp_path}/e"
    assert textindex.append(spark, empty, texts(spark, 0)) == 0
    assert textindex.search(spark, empty, spark.createDataFrame([(1, "waa")], "qid int, text string"), 3).collect() == []
