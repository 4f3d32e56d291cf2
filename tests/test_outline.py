from quillon.operators import outline

LINES = """0|CHAPTER I|1
0|2. Definitions.|1
0|In this Act,|0
20|(1) "accountant" has a meaning;|0
20|(2) income includes|0
40|(a) profits;|0
40|(b) rent,|0
60|(i) of land; and|0
60|(ii) of|0
5|buildings;|0
40|(c) dividends.|0
20|(3)(a) first of three|0
24|(b) second of three|0
0|3. Charge.|1
20|(1) tax is due.|0
0|SCHEDULE XI|1
0|Part A|1
0|4. Funds.|1
20|(f) a fund.|0"""


def table(spark, text):
    rows = [(0, k, 1 + k // 10, float(x), t, b == "1") for k, (x, t, b) in enumerate(line.split("|") for line in text.split("\n"))]
    return spark.createDataFrame(rows, "doc_id int, line_index long, page int, x double, text string, bold boolean")


def test_outline(spark):
    nodes = {r["id"]: r for r in outline.outline(table(spark, LINES)).collect()}
    parents = {k: r["parent"] for k, r in nodes.items()}
    assert parents == {
        "ch:I": None, "s2": "ch:I", "s2(1)": "s2", "s2(2)": "s2", "s2(2)(a)": "s2(2)", "s2(2)(b)": "s2(2)", "s2(2)(b)(i)": "s2(2)(b)", "s2(2)(b)(ii)": "s2(2)(b)", "s2(2)(c)": "s2(2)",
        "s2(3)": "s2", "s2(3)(a)": "s2(3)", "s2(3)(b)": "s2(3)", "s3": "ch:I", "s3(1)": "s3", "sch:XI": None, "sch:XI:A": "sch:XI", "sch:XI:A:4": "sch:XI:A", "sch:XI:A:4(f)": "sch:XI:A:4",
    }
    assert nodes["s2(2)(b)(ii)"]["text"] == "of buildings;" and nodes["s2(3)(a)"]["text"] == "first of three"
    assert nodes["s2"]["text"] == "Definitions. In this Act," and nodes["s2"]["heading"] == "Definitions." and nodes["s2"]["chapter"] == "I"
    assert nodes["sch:XI:A:4(f)"]["schedule"] == "XI" and nodes["s2(2)(b)(ii)"]["page_end"] == 1
    order = [r["id"] for r in sorted(nodes.values(), key=lambda r: r["ord"])]
    assert order.index("s2(2)(b)(i)") < order.index("s2(2)(c)") < order.index("s2(3)") < order.index("s2(3)(a)")


def test_repeated_ids(spark):
    twice = "0|7. One.|1\n20|(1) a.|0\n0|7. Two.|1\n20|(1) b.|0"
    assert sorted(r["id"] for r in outline.outline(table(spark, twice)).collect()) == ["s7", "s7(1)", "s7(1)~2", "s7~2"]


def test_tables(spark):
    text = "0|Table|0\n0|Sl.|0\n30|Nature of|0\n32|payment|0\n80|Rate|0\n2|A|0\n35|B|0\n82|C|0\n0|1.|0\n33|Commission or|0\n80|10%|0\n33|brokerage|0\n0|2.|0\n33|Rent|0\n80|2%|0\n0|394. Next section.|1\n0|5.|0"
    lines = table(spark, text)
    cells = {(r["row"], r["col"]): r["text"] for r in outline.tables(lines).collect()}
    assert cells == {(1, 0): "1.", (1, 1): "Commission or brokerage", (1, 2): "10%", (2, 0): "2.", (2, 1): "Rent", (2, 2): "2%"}
    assert {r["col"]: r["heading"] for r in outline.headers(lines).collect()} == {0: "Sl.", 1: "Nature of payment", 2: "Rate"}


def test_formulas(spark):
    lines = spark.createDataFrame([(0, 1, 1, 10.0, "tax is"), (0, 1, 2, 30.0, "where")], "doc_id int, page int, line_index long, y double, text string")
    out = outline.inject_formulas(lines, spark.createDataFrame([(0, 1, 20.0, "A - B")], "doc_id int, page int, y double, formula string"))
    assert {r["line_index"]: r["text"] for r in out.collect()} == {1: "tax is A - B", 2: "where"}
