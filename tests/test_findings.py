"""Cases that a review found: each differed from the query's SQL, did less than the whole job, or grew faster than its input."""

import datetime
import random

import duckdb
from pyspark.sql import functions as F

from quillon.functions import amounts
from quillon.operators import answers, evals, hierarchy, parser, retrieve, scoring, textindex
from quillon.plans import catalog, corpus, derived, parsing, statute
from quillon.plans.registry import ORACLES, QUERIES

BASE = "/root/testdata/sf0.001"


def rows(spark, name, base, **tables):
    """A query's rows and those of its SQL over the given tables, sorted."""
    con = duckdb.connect()
    for t, path in tables.items():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    got = QUERIES[name](spark, str(base))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
    return sorted(map(repr, map(tuple, got.collect()))), sorted(map(repr, want))


def saved(spark, tmp_path, name, data, schema):
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return f"{tmp_path}/{name}.parquet/*.parquet"


def test_fragments_go_back_in_time(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    data = [(1, at(90_000), 7, "click"), (2, at(0), 7, "view"), (3, at(3599.6), 7, "zoom"), (4, at(3600), 7, None), (5, at(0), 8, "click"), (6, at(3599.4), 8, "view")]
    path = saved(spark, tmp_path, "events", data, "event_id long, ts timestamp_ntz, user_id long, event_type string")
    got, want = rows(spark, "merged_fragments", tmp_path, events=path)
    assert got == want and "(7, 1, 'click view')" in got and "(8, 5, 'click view')" in got and "(7, 4, None)" in got


def test_numbers_at_line_ends(spark, tmp_path):
    texts = ["it is 12\nand 12 and 5\n% of it", "# Example\n77,777 of it [C12]", "10 % 10% 3.5", ""]
    path = saved(spark, tmp_path, "documents", list(enumerate(texts)), "doc_id long, text string")
    got, want = rows(spark, "numbers_in_text", tmp_path, documents=path)
    assert got == want == ["(0, 1)", "(1, 2)", "(2, 3)", "(3, 0)"]


def test_filters_return_questions(spark):
    """Not their number: every question of each filter, and those with both wordings of a substitution."""
    got, want = rows(spark, "question_filters", BASE, **{t: f"{BASE}/{t}.parquet" for t in ("nation", "customer", "orders", "lineitem")})
    assert got == want and len(got) > 6000 and any("substitution" in r for r in got)


def test_the_statute_is_read_without_a_shuffle(spark):
    """Its closure was made by joins of ids and written; both now follow from numbered lines and orders. Scores of answers need none either."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    up = statute.tree(spark, BASE)
    assert "Exchange hash" not in plan(up) and "Exchange hash" not in plan(QUERIES["answer_scores"](spark, BASE))
    joined = hierarchy.closure(statute.provisions(spark, BASE).select("id", "parent"))
    assert up.exceptAll(joined).isEmpty() and joined.exceptAll(up).isEmpty()


def test_paths_tell_what_a_tree_tells(spark):
    """Metrics by ids alone are those by a closure: of passages cited twice, ids outside the tree, gold rows, and questions to refuse."""
    change = "struct<type:string,prior_text:string,effective_date:string,footnote:string>"
    kind = f"id long, type string, answer string, refused boolean, should_refuse boolean, gold_facts array<string>, gold_provisions array<string>, gold_table_rows array<string>, gold_amendment {change}, cited array<struct<provisions:array<string>,text:string>>"
    cites = [(["s1(2)(a)", "s1(2)(b)"], "at 5%"), (["s9(9)"], "none"), (["s1(2)"], "at 6%"), ([], "")]
    data = [
        (1, "lookup", "It is 5%.", False, False, ["5%"], ["s1(2)", "s1(2)(a)", "s7"], [], None, cites), (2, "table", "Rs. 77", False, False, ["Rs. 77"], ["s1"], ["row5"], None, [(["row5"], "Rs. 77")]),
        (3, "refusal", "No.", True, True, [], ["s1"], [], None, cites), (4, "lookup", None, False, False, None, [], [], None, None),
    ]
    records = spark.createDataFrame(data, kind)
    nodes = spark.createDataFrame([("s1", None), ("s1(2)", "s1"), ("s1(2)(a)", "s1(2)"), ("s1(2)(b)", "s1(2)"), ("s7", None)], "id string, parent string")
    pairs = spark.range(0).select("id", F.lit("").alias("old"), F.lit("").alias("new"))
    shown = lambda df: sorted(map(repr, map(tuple, df.collect())))
    assert shown(scoring.answer_metrics(records, None, pairs)) == shown(scoring.answer_metrics(records, hierarchy.closure(nodes), pairs))
    gold = spark.createDataFrame([("a", "s1(2)"), ("a", "s7"), ("b", "row5"), ("c", "s1")], "qid string, gold string")
    ranked = spark.createDataFrame([("a", 1, "s7"), ("a", 6, "s1(2)(b)"), ("b", 2, "row5"), ("d", 1, "s1")], "qid string, rank int, pid string")
    assert shown(evals.retrieval_metrics(gold, ranked, paths=True)) == shown(evals.retrieval_metrics(gold, ranked, hierarchy.closure(nodes)))


def test_lines_are_printed_and_read_once(spark):
    """Orders and their lines were joined anew for each kind of printed line, and every line's labels went to Python with all their places."""
    lines = parsing.printed(spark, BASE)
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 3  # orders to customers, for clauses and for parts, and parts to these
    assert not [f.name for f in parser.line_events(lines).schema if f.dataType.typeName() in ("array", "struct")]
    texts = ["CHAPTER I", "1. One.", "(1)(a) both", "(b) next", "(99999999999) no number", "[(2) of an amendment", "(iv) no list"]
    rows = [(1, n, 1, 20.0 if n > 1 else 0.0, t, n < 2) for n, t in enumerate(texts)]
    got = parser.parsed(spark.createDataFrame(rows, "doc_id int, line_index long, page int, x double, text string, bold boolean")).where("opens").collect()
    assert [r["id"] for r in got] == ["ch:I", "s1", "s1(1)", "s1(1)(a)", "s1(1)(b)", "s1(2)"]


def test_vectors_are_scaled_in_the_search(spark):
    """By expressions over each component they were, and a filter by their length went to the few tasks that read the files."""
    plan = QUERIES["knn_cosine_topk"](spark, BASE)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
    vectors = [[3.0, 4.0], [0.0, 0.0], [1.0, None], None, [float("nan"), 1.0], [1.0, 2.0, 2.0], [], [0.0, 5.0]]
    rows = spark.createDataFrame(list(enumerate(vectors)), "id long, vector array<float>")
    found = retrieve.knn(rows.select(F.col("id").alias("qid"), "vector"), rows, 2).where("not isnan(score)")
    assert {(r["qid"], r["id"], r["score"]) for r in found.collect()} == {(0, 0, 1.0), (7, 7, 1.0), (5, 5, 1.0)}


def test_gold_is_counted(spark):
    """Gold of a class was listed pair by pair, with the square of the vectors. Counts and ranks of hits tell the same."""
    gold = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1), ("c", 9)], "qid string, gold long")
    ranked = spark.createDataFrame([("a", 1, 7), ("a", 4, 2), ("a", 9, 3), ("b", 2, 1), ("d", 1, 1)], "qid string, rank int, pid long")
    hits = ranked.join(gold.withColumnRenamed("gold", "pid"), ["qid", "pid"]).select("qid", "rank")
    shown = lambda df: sorted(map(repr, map(tuple, df.collect())))
    assert shown(evals.counted_metrics(gold.groupBy("qid").agg(F.count("*").alias("n")), hits)) == shown(evals.retrieval_metrics(gold, ranked))


def test_halves_are_rounded_as_the_sql_does(spark):
    values = [0.1260835, 0.0000005, 0.1234565, -0.1260835, 1.0, float("nan")]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "score double").select(catalog._six("score")).collect()]
    want = [r[0] for r in duckdb.connect().execute("SELECT round(unnest($1), 6)", [values]).fetchall()]
    assert repr(got) == repr(want) and got[0] == 0.126083


def test_tasks_grow_with_the_table(spark, monkeypatch):
    """Lines and orders were sorted in as many tasks as the session has, whatever their number, and spilled."""
    shown = lambda df: sorted(map(repr, map(tuple, df.collect())))
    want = shown(statute._lines(spark, BASE)), shown(statute._orders(spark, BASE))
    monkeypatch.setattr(derived, "TASK_BYTES", 1000)
    for df, kept in zip((statute._lines(spark, BASE), statute._orders(spark, BASE)), want, strict=True):
        assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString() and shown(df) == kept


def test_tasks_are_not_put_together(spark, monkeypatch):
    """With more partitions in the session than tasks were asked for, Spark put these together by compressed bytes, and each spilled what it sorted."""
    shown = lambda df: sorted(map(repr, map(tuple, df.collect())))
    plain = statute._lines(spark, BASE)
    want, before = shown(plain), spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(derived, "TASK_BYTES", 30_000)
    spark.conf.set("spark.sql.shuffle.partitions", 50)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = statute._lines(spark, BASE)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert shown(df) == want
        assert plan.count("REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in plan.split("SortMergeJoin")[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_first_nodes_are_not_looked_for_everywhere(spark, tmp_path, monkeypatch):
    """All nodes were sorted for the first six of each section. Those of sections with many clauses, and of clauses with none or many items, are as the SQL has them."""
    counts, subtree = [], hierarchy.subtree
    monkeypatch.setattr(corpus.hierarchy, "subtree", lambda tree, *more: counts.append(tree.count()) or subtree(tree, *more))
    day = datetime.datetime(2024, 1, 1)
    orders = [(10 * c + n, c, day) for c in range(4) for n in range(0 if c == 3 else 3 * c + 1)]  # one, four and seven clauses, and none
    lines = [(o, i, i, i, 1.0, 10.0, 0.05, "N", day) for o, _, _ in orders for i in range({0: 0, 1: 9, 2: 3}[o % 3])]
    made = {
        "nation": ([(0, "A")], "n_nationkey int, n_name string"), "customer": ([(c, f"c{c}", 0, "M") for c in range(4)], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"),
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"),
        "lineitem": ([(*x[:7], 0.0, x[7], "O", x[8]) for x in lines], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
    }
    got, want = rows(spark, "subtree_lookup", tmp_path, **{t: saved(spark, tmp_path, t, *x) for t, x in made.items()})
    assert got == want and "('s3', 's3', 0)" in got
    assert counts[0] < 4 + len(orders) + len(lines) and counts[0] <= 4 * (1 + 5 + 10)


def test_few_hits_are_written_before_they_meet_all_chunks(spark):
    """Chunks were shuffled for their tokens as soon as there were too many to send, though only a few hits need them."""
    assert "Window" not in QUERIES["budget_verdicts"](spark, BASE)._jdf.queryExecution().optimizedPlan().toString()


def test_references_are_not_left_in_memory(spark):
    """They were cached for good, with the executors' memory or disk; they are written, and read as columns that each step needs."""
    spark.catalog.clearCache()
    assert QUERIES["cross_references"](spark, BASE).count() > 0 and spark._jsparkSession.sharedState().cacheManager().isEmpty()


def test_amounts_by_replacement(spark):
    """Every text was read token by token, with what each token and its neighbours are asked anew. Where nothing is odd, replacements say the same."""
    words = "rs Rs. ₹ . , % per cent percent rupees rsx 5 50,000 5.00 5.05 .5 1,2 - — “ ` ( _ é ² ৫ lakh fifty 1.2,3 1.2.3 [C1] cents \x01".split(" ")
    pick = random.Random(7)
    texts = ["Rs. 5,000.50 per cent", "5 rupees percent", "rs 5.00 rupees", "", None] + ["".join(pick.choice(words) + pick.choice(["", " ", " ", "\n"]) for _ in range(pick.randint(1, 9))) for _ in range(4000)]
    lower = F.replace(F.lower("t"), F.lit("₹"), F.lit(" rs "))
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", amounts.one_form(F.col("t")).alias("x"), amounts.by_tokens(lower).alias("y"), lower.rlike(amounts._ODD).alias("odd")).collect()
    assert [r for r in got if r["x"] != r["y"]] == [] and sum(r["odd"] is False for r in got) > 1500
    plan = spark.range(1).select(amounts.one_form(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN RLIKE" in plan


def test_passages_are_read_once(spark):
    """The passages' form was made anew for each number of an answer, and that of each fact twice; questions to refuse were read too."""
    plan = QUERIES["answer_scores"](spark, BASE)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?U)lakh") == 4  # an answer, a fact, the passages, a number
    assert "CASE WHEN NOT" in plan


def test_means_are_taken_in_one_pass(spark):
    """Each figure of each record was a row of its own, three times over."""
    data = [("a", 1.0, 0.0, 1.0, None), ("a", 0.0, 0.0, 0.0, None), ("b", None, 1.0, 1.0, None), (None, 0.5, 1.0, 1.0, None), ("c", None, 0.0, None, None)]
    m = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "id int, type string, found double, refused double, should_refuse double, none double")
    out = scoring.aggregate(m)
    assert "Generate explode" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, [
        ("a", "found", 0.5), (None, "found", 0.5), (None, "found", 0.5), ("a", "n", 2.0), ("b", "n", 1.0), ("c", "n", 1.0), (None, "n", 1.0), (None, "n", 5.0),
        (None, "refusal_precision", 1.0), (None, "refusal_recall", 0.6667),
    ]))


def test_an_index_shuffles_postings_only(spark, tmp_path, monkeypatch):
    """Texts were shuffled to find ids that come twice, their words written, and each document's counts shuffled twice more; a search shuffled all postings of its terms' buckets."""
    written, stated = [], []
    keep, search = textindex.materialize, textindex.search
    monkeypatch.setattr(textindex, "materialize", lambda df, name: written.append(name) or keep(df, name))
    odd = ["İstanbul K\u212aS ſet", "", None, " - ", "...one,TWO two--2 2\n", "ß one_two ০৫ 5", "A" * 3, "two"]
    data = [(i, odd[i % len(odd)] if i % 3 else f"one w{i} two w{i % 7}") for i in range(600)]
    bad = spark.sql("SELECT 600L AS id, cast(X'74776FFF6F6E65C3' AS string) AS text")  # no UTF-8
    docs = spark.createDataFrame(data, "id long, text string").union(bad)
    asked = spark.createDataFrame([(1, "one 2 two"), (2, "istanbul kks stanbul set"), (3, "w0 w3 aaa 5")], "qid int, text string")
    shown = lambda df: sorted(map(repr, map(tuple, df.collect())))
    want = shown(retrieve.full_text(asked, docs, 9))
    for n, laid in enumerate((docs.coalesce(1), docs.repartition(9))):
        assert textindex.append(spark, f"{tmp_path}/{n}", laid) == 601 and written == []
        found = search(spark, f"{tmp_path}/{n}", asked, 9)
        assert shown(found) == want and "Join LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
        written.clear()
    planned = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in planned(textindex._spread(docs.coalesce(1), 601)) and "Exchange" not in planned(textindex._spread(spark.read.parquet(keep(docs.repartition(9), "spread").inputFiles()[0].rsplit("/", 1)[0]), 601))
    assert textindex.append(spark, f"{tmp_path}/twice", docs.union(docs)) == 601 and shown(search(spark, f"{tmp_path}/twice", asked, 9)) == want
    monkeypatch.setattr(textindex, "search", lambda *more: stated.extend(r["qid"] for r in more[2].collect()) or search(*more))
    QUERIES["hybrid_search"](spark, BASE)
    assert stated and all(q % 50 == 0 for q in stated)  # all questions were searched for, though only these have a vector that is asked


def test_the_first_quantity_is_found_by_one_pattern(spark):
    """An answer was cut into parts, and each number in it asked for the parts around it six times over: 350 microseconds an answer."""
    told = {
        "Under section 12 in 2026 pay 5,000, on item 3": "Under section 12 in 2026 pay 15001, on item 3", "sections 4 and 5 of 7": "sections 4 and 16 of 7", "Sl. No. 3, serial\nNumber 4, number 5": "Sl. No. 3, serial\nNumber 4, number 16",
        "a) or 5 and 6": "a) or 5 and 19", "(b), 7 or 8": "(b), 7 or 25", "no.9 No 10 piano 11 -part 12 subpart 13": "no.9 No 10 piano 11 -part 12 subpart 40", "1,950 01950 2100 0,2,0,2,6 2101": "1,950 01950 2100 0,2,0,2,6 6304", "C2 4(3) x-5 .6 7x 8": "C2 4(3) x-5 .6 7x 25",
        "9" * 31 + " " + "9" * 30: "9" * 31 + " 2" + "9" * 29 + "8", "5": "16", "      7%": "      22%", "serial5number 7": None, "x)5or 7": None, "": None, None: None,
    }
    df = spark.createDataFrame([(t,) for t in told], "t string").select("t", answers.mutate(F.col("t")).alias("m"))
    assert {r["t"]: r["m"] for r in df.collect()} == told
    long = "a) " * 30_000 + "or " * 30_000 + "5" + " section 5" * 30_000
    assert spark.createDataFrame([(long,)], "t string").select(answers.mutate(F.col("t"))).first()[0] == long.replace("or 5", "or 16")
    plan = QUERIES["mutated_answers"](spark, BASE)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract(" in plan and "regexp_extract_all" not in plan and "filter(" not in plan
