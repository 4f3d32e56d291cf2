"""Loads, indexes, caches, retries, configuration, streams of replies and limits, and closures of any depth."""

import json

import pytest
from pyspark.sql import functions as F

from quillon import schemas, scratch
from quillon.operators import chunk, events, hierarchy
from quillon.sources import files, providers, snapshots
from quillon.streaming import decode, limits
from tests.fixture import frame


def test_corpus_is_reloaded(spark, tmp_path):
    p = frame(spark, "prov").withColumn("is_amended", F.col("text_marked").isNotNull() & (F.col("id") != "s5(1)(b)"))
    refs = spark.createDataFrame([("s5", "section 2", "section", "s2", "exact")], schemas.CROSS_REFS)
    for _ in range(2):  # again: replaced, not added
        counts = files.load_corpus(p, frame(spark, "tab"), frame(spark, "trow"), frame(spark, "amend"), refs, str(tmp_path))
    assert counts == {"provisions": 16, "tables": 1, "table_rows": 4, "amendments": 4, "amendment_links": 4, "cross_refs": 1}
    marked = snapshots.read(spark, str(tmp_path), "provisions").where("text_marked is not null")
    assert [r["id"] for r in marked.collect()] == ["s5(1)(a)"]
    files.bulk_insert(refs.select(*reversed(refs.columns)), f"{tmp_path}/more_refs")
    files.bulk_insert(refs, f"{tmp_path}/more_refs")
    assert spark.read.parquet(f"{tmp_path}/more_refs").where("to_id = 's2'").count() == 2


def test_index_is_built_per_version(spark, tmp_path):
    corpus = {"nodes": frame(spark, "prov"), "table_rows": frame(spark, "trow"), "tables": frame(spark, "tab"), "pages_raw": spark.createDataFrame([(0, 1, "a b c")], "doc_id int, page int, text string")}
    corpus["pages_clean"] = corpus["pages_raw"]
    cost = spark.createDataFrame([(3, 500)], "texts long, tokens long")
    embed = lambda df: df.withColumn("vector", F.array(F.lit(1.0)))
    path = f"{tmp_path}/chunks"
    assert files.build_index(chunk.build("v0", corpus), "v0", embed, cost, path, 1000, dry_run=True) == {"to_embed": 3, "est_tokens": 500}
    assert files.build_index(chunk.build("v0", corpus), "v0", embed, cost, path, 1000)["stored"] == 1
    with pytest.raises(ValueError, match="confirm"):
        files.build_index(chunk.build("v2", corpus), "v2", embed, cost, path, 100)
    stored = files.build_index(chunk.build("v2", corpus), "v2", embed, cost, path, 100, sure=True)["stored"]
    assert stored == chunk.build("v2", corpus).count() > 8 and spark.read.parquet(path).where("version = 'v0'").count() == 1
    with pytest.raises(ValueError):
        chunk.build("v9", corpus)


def test_results_are_written(spark, tmp_path):
    records = spark.createDataFrame([("q1", 1.0)], "id string, mrr double")
    files.write_results(records, spark.createDataFrame([(None, "mrr", 1.0)], "type string, metric string, value double"), {"version": "v2"}, str(tmp_path))
    assert files.read_jsonl(spark, f"{tmp_path}/outputs", "id string, mrr double").collect() == records.collect()
    assert spark.read.json(f"{tmp_path}/run").first()["value"] == "v2"


def test_configuration(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("port: ${PORT:5432}\nname: x-${NAME:none}\nlist: ['${A}', 3]\nempty: ${GONE}\n")
    assert files.load_config(str(path), {"A": "true"}) == {"port": 5432, "name": "x-none", "list": [True, 3], "empty": ""}
    assert files.load_config(str(path), {"PORT": "7", "NAME": "n"})["port"] == 7


def test_reranking_asks_once(spark, tmp_path):
    hits = spark.createDataFrame([(1, "a", "red fish", "blue bird"), (1, "b", "red fish", "red fish"), (1, "c", "red fish", "a fish"), (2, "a", "red fish", "blue bird")], "qid int, id string, query string, text string")
    cache = providers.Cache(spark, f"{tmp_path}/rerank", schemas.RERANK_CACHE)
    out = [(r["qid"], r["rank"], r["id"]) for r in providers.rerank(hits, 2, cache).orderBy("qid", "rank").collect()]
    assert out == [(1, 1, "b"), (1, 2, "c"), (2, 1, "a")]

    def fails(query, texts):
        raise AssertionError("asked again")

    assert providers.rerank(hits, 2, cache, provider=fails).count() == 3 and cache.stats().first()["n"] == 2


def test_refusals_are_tried_again():
    calls, waits = [], []

    def call():
        calls.append(1)
        if len(calls) < 4:
            raise providers.Refused
        return "done"

    assert providers.retrying(call, first_wait=2, longest=5, sleep=waits.append) == "done" and waits == [2, 4, 5]
    with pytest.raises(providers.Refused):
        providers.retrying(lambda: (_ for _ in ()).throw(providers.Refused()), attempts=2, sleep=lambda _: None)


REPLIES = ['{"answer": "plain"}', '{"x": 1, "answer" : "q\\"uo\\\\te\\/ \\u20b95 \\n\\ud83d end", "y": "answer"}', "no json", '{"answer": ""}', '{"answer":"cut \\u00', '{"answer": "a\\']


@pytest.mark.parametrize("size", [1, 2, 5, 100])
def test_pieces_decode_like_the_whole(size):
    for reply in REPLIES[:4]:
        phase, rest, got = decode.BEFORE, "", ""
        for k in range(0, len(reply), size):
            phase, rest, text = decode.advance(phase, rest, reply[k : k + size], "answer")
            got += text
        want = json.loads(reply)["answer"] if reply.startswith("{") else ""
        assert got == want and (phase == decode.AFTER) == reply.startswith("{")
    for reply, want in zip(REPLIES[4:], ["cut ", "a"], strict=True):
        assert decode.advance(decode.BEFORE, "", reply, "answer") == (decode.WITHIN, reply[len(reply) - (4 if "u" in want else 1) :], want)


def test_reply_and_limit_streams(spark, tmp_path):
    frame(spark, "piece").where("seq < 3").coalesce(1).write.json(f"{tmp_path}/in/a")
    source = spark.readStream.schema("reply string, seq long, piece string").json(f"{tmp_path}/in/*")

    def run():
        q = decode.decode_stream(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination(120)

    run()
    frame(spark, "piece").where("seq >= 3").coalesce(1).write.json(f"{tmp_path}/in/b")
    run()
    rows = spark.read.parquet(f"{tmp_path}/out").where("reply = 'r1'").orderBy("seq").collect()
    assert "".join(r["text"] for r in rows) == 'A "levy" of ₹5\ndue' and [r["done"] for r in rows] == [False] * 4 + [True] * 2

    asks = [("u", 0.0, 1, 60.0), ("u", 1.0, 2, 50.0), ("u", 2.0, 3, 40.0), ("u", 70.0, 4, 500.0), ("u", 71.0, 5, 1.0)]
    batch = spark.createDataFrame(asks, "client string, at double, id long, cost double")
    # 60 and 40 fit into 100, 50 doesn't; an empty window lets a call of any size in
    assert {r["id"]: r["admitted"] for r in events.rate_limited(batch, 10, 60.0, 100.0, True).collect()} == {1: True, 2: False, 3: True, 4: True, 5: False}


def test_progress_events_are_written(spark, tmp_path):
    spark.createDataFrame([(1, 1, "classify", '{"route":"table"}')], "qid int, n int, node string, detail string").write.json(f"{tmp_path}/steps")
    stream = spark.readStream.schema("qid int, n int, node string, detail string").json(f"{tmp_path}/steps")
    limits.write_events(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    assert {r["value"] for r in spark.read.text(f"{tmp_path}/out").collect()} >= {"event: classify", 'data: {"route":"table"}'}


def test_closures_of_any_depth(spark):
    chain = spark.createDataFrame([(k, k - 1 if k else None) for k in range(100)], "id long, parent long")
    out = hierarchy.closure(chain)
    assert out.count() == 5050 and out.agg(F.max("depth")).first()[0] == 99
    with pytest.raises(ValueError, match="cycle"):
        hierarchy.closure(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id long, parent long"))


def test_ordered_windows_only_grow(spark):
    rows = spark.range(10).selectExpr("1 as k", "id as at", "id % 3 = 0 as hit")
    nxt = events.asof_next(rows, "k", F.col("at"), F.col("hit"), F.col("at"), "next")
    assert [r["next"] for r in nxt.orderBy("at").collect()] == [3, 3, 3, 6, 6, 6, 9, 9, 9, None]
    near = events.nearest(rows.where("at <> 4 or true"), "k", "at", F.col("hit"), "at")
    assert [r["near"] for r in near.orderBy("at").collect()] == [0, 0, 3, 3, 3, 6, 6, 6, 9, 9]
    for df in (nxt, near):
        assert "unboundedfollowing" not in df._jdf.queryExecution().toString().lower()


def test_scratch_of_a_cluster_has_to_be_named(spark, monkeypatch):
    assert scratch.scratch_dir(spark)

    class Context:
        master = "yarn"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="checkpoint"):
        scratch.scratch_dir(Session())
