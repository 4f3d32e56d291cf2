"""The line parser: one path per document, against the trees that its lines show."""

import random

from pyspark.sql import functions as F

from quillon.operators import parser
from tests.test_outline import LINES, table


def tree(spark, text, **kw):
    rows = parser.nodes(parser.parsed(table(spark, text), **kw)).collect()
    return {r["id"]: r for r in rows}


def test_places(spark):
    labels = ["5", "5A", "a", "z", "za", "zz", "zza", "ab", "i", "iv", "c", "B", "XI", "*"]
    rows = spark.createDataFrame([(v,) for v in labels], "v string").select("v", parser.label_places(F.col("v")).alias("p")).collect()
    got = {r["v"]: {(p["kind"], p["pos"], p["sub"]) for p in r["p"]} for r in rows}
    assert got["5"] == {("num", 5, 0)} and got["5A"] == {("num", 5, 1)} and got["a"] == {("alpha", 1, 0)} and got["z"] == {("alpha", 26, 0)}
    assert got["za"] == {("alpha", 27, 0)} and got["zz"] == {("alpha", 52, 0)} and got["zza"] == {("alpha", 53, 0)} and got["ab"] == {("alpha", 1, 2)}
    assert got["i"] == {("alpha", 9, 0), ("roman", 1, 0)} and got["iv"] == {("roman", 4, 0)} and got["c"] == {("alpha", 3, 0), ("roman", 100, 0)}
    assert got["B"] == {("ALPHA", 2, 0)} and got["XI"] == {("ROMAN", 11, 0)} and got["*"] == set()


def test_tree(spark):
    text = LINES.replace("0|2. Def", "0|1. Title.|1\n0|2. Def").replace("4. Funds.", "1. Funds.").replace("(f) a fund", "(a) a fund")
    nodes = tree(spark, text)
    assert {k: r["parent"] for k, r in nodes.items()} == {
        "ch:I": None, "s1": "ch:I", "s2": "ch:I", "s2(1)": "s2", "s2(2)": "s2", "s2(2)(a)": "s2(2)", "s2(2)(b)": "s2(2)", "s2(2)(b)(i)": "s2(2)(b)", "s2(2)(b)(ii)": "s2(2)(b)", "s2(2)(c)": "s2(2)",
        "s2(3)": "s2", "s2(3)(a)": "s2(3)", "s2(3)(b)": "s2(3)", "s3": "ch:I", "s3(1)": "s3", "sch:XI": None, "sch:XI:A": "sch:XI", "sch:XI:A:1": "sch:XI:A", "sch:XI:A:1(a)": "sch:XI:A:1",
    }
    assert nodes["s2(2)(b)(ii)"]["text"] == "of buildings;" and nodes["s2(3)(a)"]["text"] == "first of three" and nodes["s2"]["text"] == "Definitions. In this Act,"
    assert nodes["sch:XI:A:1"]["kind"] == "paragraph" and nodes["sch:XI:A:1(a)"]["schedule"] == "XI" and nodes["s3"]["chapter"] == "I"


def test_units_go_on(spark):
    nodes = tree(spark, "0|2. Two.|1\n0|5. Five, after a gap of three.|1\n0|9. Too far.|1\n0|4. Back.|1\n0|6A. Inserted.|1\n0|SCHEDULE I|1\n0|2. No first one.|1\n0|1. First.|1\n0|3. Skips.|1\n0|2. Second.|1")
    assert {k: r["skipped"] for k, r in nodes.items()} == {"s2": 1, "s5": 2, "s6A": 0, "sch:I": None, "sch:I:1": 0, "sch:I:2": 0}
    assert nodes["s5"]["text"] == "Five, after a gap of three. 9. Too far. 4. Back." and nodes["sch:I:1"]["text"] == "First. 3. Skips."


def test_references_are_text(spark):
    nodes = tree(spark, "0|1. One.|1\n20|(1) tax under sub-section|0\n40|(3) is due;|0\n5|(2) left of the list|0\n20|(2)(b) of another.|0\n20|(3) last, as in clause|0\n40|(c) there.|0\n0|Tail of one.|0\n40|(b) lost.|0")
    assert {k: r["text"] for k, r in nodes.items()} == {
        "s1": "One. (2) left of the list Tail of one. (b) lost.", "s1(1)": "tax under sub-section (3) is due;", "s1(2)": "(b) of another.", "s1(3)": "last, as in clause (c) there.",
    }


def test_tables_and_notes(spark):
    nodes = tree(spark, "0|1. One.|1\n20|(1) as in the|0\n30|Table|0\n0|1.|0\n35|(a) Rent|0\n0|2. Two.|1\n30|Table|0\n30|Table|0\n0|x|0\n0|Notes|0\n0|1. Ins. by Act.|0\n0|Table of notes|0\n0|3. Three.|1\n0|Endnotes:|0\n0|2. Sub.|0")
    assert {k: (r["kind"], r["parent"], r["text"]) for k, r in nodes.items() if r["kind"] in ("table", "endnotes")} == {
        "s1:tbl1": ("table", "s1(1)", "1. (a) Rent"), "s2:tbl1": ("table", "s2", ""), "s2:tbl2": ("table", "s2", "x"),
        "doc:notes1": ("endnotes", None, "1. Ins. by Act. Table of notes"), "doc:notes2": ("endnotes", None, "2. Sub."),
    }
    assert "s3" in nodes and "s1(1)(a)" not in nodes


def test_odd_lines(spark):
    assert parser.parsed(table(spark, "0|x|0").limit(0)).count() == 0
    rows = [(0, 1, 1, 0.0, "1. A.", True), (None, 1, 1, 0.0, "1. N.", True), (0, 2, None, None, None, None), (0, 3, 1, 20.0, "(1) b", False), (None, 2, 1, 5.0, "more", False), (7, 1, 1, 0.0, "before any heading", False)]
    got = parser.parsed(spark.createDataFrame(rows, "doc_id int, line_index long, page int, x double, text string, bold boolean").withColumn("id", F.lit("clash")))
    assert {(r["doc_id"], r["id"], r["text"]) for r in parser.nodes(got).collect()} == {(0, "s1", "A."), (0, "s1(1)", "b"), (None, "s1", "N. more")}
    twice = tree(spark, "0|CHAPTER I|1\n0|CHAPTER I|1\n0|1. A.|1")
    assert set(twice) == {"ch:I", "ch:I~2", "s1"}


def test_printed_trees(spark):
    """Random trees, printed with indents, come back whatever the batches are."""
    r, want, rows = random.Random(5), {}, []
    for doc in range(6):
        lines = []
        for s in range(1, 12):
            want[doc, f"s{s}"] = None
            lines.append((0.0, f"{s}. Unit {s}.", True))
            for n in range(1, r.randrange(1, 9)):
                want[doc, f"s{s}({n})"] = f"s{s}"
                lines.append((20.0, f"({n}) sub-section {n} has", False))
                for a in range(r.randrange(0, 31)):
                    name = chr(97 + a) if a < 26 else "z" + chr(71 + a)
                    want[doc, f"s{s}({n})({name})"] = f"s{s}({n})"
                    lines.append((40.0, f"({name}) item {a}", False))
                    lines += [(r.choice([5.0, 40.0, 60.0]), "goes on", False)] * r.randrange(3)
                    for i, numeral in enumerate(["i", "ii", "iii", "iv", "v", "vi"][: r.choice([0, 0, 3, 6])]):
                        want[doc, f"s{s}({n})({name})({numeral})"] = f"s{s}({n})({name})"
                        lines.append((60.0, f"({numeral}) point {i};", False))
        rows += [(doc, k, 1, *line) for k, line in enumerate(lines)]
    r.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id int, line_index long, page int, x double, text string, bold boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = {(v["doc_id"], v["id"]): v["parent"] for v in parser.nodes(parser.parsed(frame)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want
