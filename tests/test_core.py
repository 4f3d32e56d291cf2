"""Grids, closures that change, resumable runs, aggregates of one's own, VARIANT: against plain loops."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from quillon.functions.aggregates import PairedMeans, aggregate
from quillon.operators import evalrun, hierarchy, semi, spatial
from quillon.sources import snapshots


def points(n, seed, crowd=0):
    r = random.Random(seed)
    rows = [(r.randrange(2), k, r.uniform(-9, 9), r.uniform(-9, 9)) for k in range(n)]
    rows += [(0, n + k, 3.0 + r.random() / 1000, -3.0) for k in range(crowd)]  # a crowd, and equal places
    return rows + [(1, n + crowd + k, 0.5, 0.5) for k in range(3)] + [(0, 9999, None, 1.0)]


def dist(a, b):
    return (a[2] - b[2]) * (a[2] - b[2]) + (a[3] - b[3]) * (a[3] - b[3])


def test_nearest_in_plane(spark):
    rows = points(150, 1, 200)
    frame = spark.createDataFrame(rows, "k int, id int, x double, y double")
    got = {r["id"]: (r["near"], r["d2"]) for r in spatial.nearest_within(frame, frame, 1.5, ["k"], apart=True).collect()}
    want = {}
    for a in rows:
        near = [(dist(a, b), b[1]) for b in rows if a[2] is not None and b[2] is not None and a[0] == b[0] and a[1] != b[1] and dist(a, b) <= 2.25]
        if near:
            want[a[1]] = min(near)[::-1]
    assert got == want and len(got) > 200
    other = spark.createDataFrame(points(40, 2), "k int, id int, x double, y double")
    near = {r["id"]: r["near"] for r in spatial.nearest_within(frame, other, 0.7).collect()}
    assert near == {a[1]: min((dist(a, b), b[1]) for b in points(40, 2) if b[2] is not None)[1] for a in rows if a[2] is not None and min(dist(a, b) for b in points(40, 2) if b[2] is not None) <= 0.49}


def test_pairs_in_plane_is_an_equi_join(spark):
    rows = points(120, 3)
    frame = spark.createDataFrame(rows, "k int, id int, x double, y double")
    found = spatial.pairs_within(frame, frame, 1.0)
    assert {(r["id"], r["other"]) for r in found.collect()} == {(a[1], b[1]) for a in rows for b in rows if None not in (a[2], b[2]) and dist(a, b) <= 1}
    assert "NestedLoop" not in found._jdf.queryExecution().toString()


def plain_closure(parents):
    out = set()
    for n in parents:
        a, d = n, 0
        while a is not None:
            out.add((n, a, d))
            a, d = parents.get(a), d + 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_moves(spark, seed):
    """Random trees and moves that hold together, roots below roots and new roots among them."""
    r = random.Random(seed)
    parents = {k: (None if k < 2 else r.randrange(k)) for k in range(60)}
    moves = {}
    after = dict(parents)
    for k in r.sample(range(60), 12):
        target = r.choice([None, *range(60)])
        up, a = [], target
        while a is not None:
            up.append(a)
            a = after[a]
        if k not in up:
            after[k] = moves[k] = target
    tree = hierarchy.closure(spark.createDataFrame(list(parents.items()), "id int, parent int"))
    got = hierarchy.moved(tree, spark.createDataFrame(list(moves.items()), "id int, parent int"))
    assert sorted(tuple(x) for x in got.collect()) == sorted(plain_closure(after))


def test_move_below_itself(spark):
    tree = hierarchy.closure(spark.createDataFrame([(1, None), (2, 1), (3, 2)], "id int, parent int"))
    with pytest.raises(ValueError, match="cycle"):
        hierarchy.moved(tree, spark.createDataFrame([(2, 3)], "id int, parent int")).collect()
    assert hierarchy.moved(tree, spark.createDataFrame([], "id int, parent int")).count() == 6


def test_misread_numeral_and_all_below_it(spark):
    ids = ["s1", "s1(g)", "s1(h)", "s1(i)", "s1(i)(A)", "s1(ii)", "s1(iii)", "s1(j)", "s2", "s2(h)", "s2(i)", "s2(j)"]
    parent = lambda p: p[: p.rindex("(")] if "(" in p else None
    rows = [(p, parent(p), p[p.rindex("(") :] if "(" in p else p[1:], k) for k, p in enumerate(ids)]
    nodes = spark.createDataFrame(rows, "id string, parent string, number string, ord int")
    moves = hierarchy.misread_numerals(nodes)
    assert {tuple(r) for r in moves.collect()} == {("s1(i)", "s1(h)"), ("s1(ii)", "s1(h)"), ("s1(iii)", "s1(h)")}
    names = hierarchy.renamed(hierarchy.closure(nodes.select("id", "parent")), moves, F.regexp_extract("id", r"(\([^()]*\)|^[^(]*)$", 1))
    assert {tuple(r) for r in names.collect()} == {("s1(i)", "s1(h)(i)"), ("s1(i)(A)", "s1(h)(i)(A)"), ("s1(ii)", "s1(h)(ii)"), ("s1(iii)", "s1(h)(iii)")}


def test_run_goes_on_where_it_stopped(spark, tmp_path):
    root, asked = str(tmp_path), []
    questions = spark.createDataFrame([(k, f"q{k}") for k in range(20)], "id int, text string")

    def first(df):
        asked.append(sorted(r["id"] for r in df.collect()))
        if len(asked) == 2:
            raise RuntimeError("killed")
        return df.withColumn("a", F.length("text"))

    versions = {"v": {"one": first, "two": lambda df: df.withColumn("b", F.col("a") * 2)}}
    with pytest.raises(RuntimeError, match="killed"):
        evalrun.run(spark, root, questions, versions, 3)
    done = {r["stage"]: r["done"] for r in evalrun.progress(spark, root, questions, versions).collect()}
    assert 0 < done["one"] == done["two"] < 20
    assert evalrun.run(spark, root, questions, versions, 3) == {"v": None}
    assert {tuple(r) for r in evalrun.records(spark, root, questions, versions).select("id", "a", "b", "version").collect()} == {(k, len(f"q{k}"), 2 * len(f"q{k}"), "v") for k in range(20)}
    assert not set(asked[0]) & {i for a in asked[2:] for i in a}  # what was committed isn't asked again
    evalrun.run(spark, root, questions.union(spark.createDataFrame([(50, "new")], "id int, text string")), versions, 3)
    assert asked[-1] == [50]


def test_run_out_of_quota(spark, tmp_path):
    def none_left(df):
        raise evalrun.QuotaExhausted("tomorrow")

    versions = {"a": {"s": none_left}, "b": {"s": lambda df: df.withColumn("x", F.lit(1))}}
    questions = spark.createDataFrame([(1,)], "id int")
    assert evalrun.run(spark, str(tmp_path), questions, versions) == {"a": "tomorrow", "b": None}
    assert [r["version"] for r in evalrun.records(spark, str(tmp_path), questions, versions).collect()] == ["b"]
    assert list(snapshots.current(spark, str(tmp_path))["tables"]) == ["b-s"]


def test_aggregate_of_ones_own(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), r.randrange(40), r.choice([None, math.nan, 1e300, 0.1, r.random()]), r.choice([None, 0.5, 3.0]), k) for k in range(600)]
    frame = spark.createDataFrame(rows, "g string, h int, m double, c double, id long").repartition(7)
    for keys in (["g"], ["g", "h"]):
        got = {tuple(x)[: len(keys)]: tuple(x)[len(keys) :] for x in aggregate(frame, keys, PairedMeans("m", "c", "id"), at_once=5).collect()}
        groups = {}
        for row in rows:
            groups.setdefault(row[: len(keys)], []).append(row)
        assert set(got) == set(groups)
        for key, own in groups.items():
            own = [x for x in own if x[2] is not None and not math.isnan(x[2])]
            assert got[key][0] == len(own)
            if own:
                worst = min((x[2], x[4]) for x in own)
                assert got[key][1] == pytest.approx(statistics.fmean(x[2] for x in own)) and got[key][4:] == worst
                assert got[key][2] == math.fsum(x[3] or 0.0 for x in own) / len(own)
    assert aggregate(frame.where("false"), ["g"], PairedMeans("m", "c", "id")).collect() == []


def test_variant(spark, tmp_path):
    rows = [(1, '{"a": 1, "b": "x"}'), (2, '{"b": [1, 2]}'), (3, '{"c": {"d": 2.5}}'), (4, "not json"), (5, None), (6, "{}"), (7, '{"a": "text"}')]
    semi.store(spark.createDataFrame(rows, "id int, j string"), "j", str(tmp_path))
    found = semi.having_any(spark, str(tmp_path), ["a", "c"])
    assert {r["id"]: r["a"] for r in found.select("id", semi.field("j", "$.a", "int").alias("a")).collect()} == {1: 1, 3: None, 7: None}
    assert [r[0] for r in found.select(semi.field("j", "$.c.d", "double").alias("d")).where("d is not null").collect()] == [2.5]
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters: [In(keys" in plan or "PushedFilters: [IsNotNull(keys), In(keys" in plan or "Or(EqualTo(keys" in plan
    assert semi.having_any(spark, str(tmp_path), ["z"]).count() == 0
