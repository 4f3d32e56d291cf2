from pyspark.sql import functions as F

from quillon.operators import amend, answers, chunk, events, hierarchy, references, structure


def test_notes_and_links(spark):
    lines = [(0, 10, 5, '1. Sub. for "thirty" by Act No. 4 of 2026, w.e.f. 1-4-2026.'), (0, 11, 5, "more of it"), (0, 12, 6, "2. Clause (f) omitted by Act No. 4 of 2026. Prior to its omission, clause (f) read as under :"), (0, 13, 6, "'(f) old words;'")]
    found = structure.notes(spark.createDataFrame(lines, "doc_id int, line_index long, page int, text string"))
    rows = {r["label"]: r for r in found.collect()}
    assert rows["1"]["type"] == "substituted" and rows["1"]["effective_date"] == "1-4-2026" and rows["1"]["amending_act"] == "Act No. 4 of 2026"
    assert rows["2"]["type"] == "omitted" and rows["2"]["prior_text"] == "(f) old words;" and rows["2"]["target_desc"] == "clause (f)"
    markers = spark.createDataFrame([(0, "1", 3, "s2(32)"), (0, "1", 20, "s9"), (0, "2", 4, "s2(40)(f)")], "doc_id int, label string, line_index long, node string")
    links, open_markers = structure.link_notes(markers, found)
    assert {(r["key"], r["provision_id"]) for r in links.collect()} == {("1@10", "s2(32)"), ("2@12", "s2(40)(f)")}
    assert [r["node"] for r in open_markers.collect()] == ["s9"]


def kinds(text):
    return [(r["kind"], r["base"], "".join(r["labels"]), r["target"], tuple(r["rows"]), r["external"]) for r in references.Reader(text).read()]


def test_reading_references():
    assert kinds("assigned in section 515(3)(b); sections 263(1) or (4), and section 70(zd)") == [
        ("section", "s515", "(3)(b)", None, (), False), ("section", "s263", "(1)", None, (), False), ("section", "s263", "(4)", None, (), False), ("section", "s70", "(zd)", None, (), False),
    ]
    assert [k[2] for k in kinds("section 9(2)(a) and (b), or (3)")] == ["(2)(a)", "(2)(b)", "(3)"]
    assert [k[5] for k in kinds("section 2 of the Companies Act, 2013; section 3 of this Act; section 4 of the said Act; section 5 of the Act")] == [True, False, True, False]
    assert kinds("section 80-IA of old") == [] and kinds("the sections of it") == [] and kinds("") == []
    assert kinds("clause (a) of sub-section (1), items (i) and (ii)") == [("relative", None, "(1)(a)", None, (), False), ("relative", None, "(i)", None, (), False), ("relative", None, "(ii)", None, (), False)]
    assert kinds("Part C of Chapter XIX, Part A of this Chapter, Chapter IV-B, Schedule XI [Table: Sl. No. 2]") == [
        ("part", None, "", "XIX:C", (), False), ("part", None, "", ":A", (), False), ("part", None, "", "IV:B", (), False), ("schedule", None, "", "XI", ("2",), False),
    ]
    assert kinds("section 393(1) [Table: Sl. Nos. 1(i), 3] and so on")[0][4] == ("1(i)", "3")
    assert kinds("section 393(1) [Table: Sl. No. 1(i), 3]")[0][4] == ("1(i)", "3") and kinds("Schedule II to the Customs Act")[0][5]


def test_cross_refs(spark):
    ids = ["ch:XIX", "ch:XIX:C", "s5", "s5(1)", "s5(1)(a)", "s5(1)(b)", "s5(2)", "s393", "s393(1)", "s393:tbl1", "s70", "s70(1)", "s70(1)(zd)", "sch:XI"]
    nodes = spark.createDataFrame([(i, "XIX" if i.startswith("s5") else None) for i in ids], "id string, chapter string")
    tree = hierarchy.id_closure(nodes, "id").unionByName(spark.createDataFrame([("s393:tbl1", "s393(1)", 1)], "pid string, ancestor string, depth int"))
    rows = spark.createDataFrame([("s393:tbl1#1(i)", "s393:tbl1"), ("s393:tbl1#2", "s393:tbl1")], "row_id string, table_id string")
    text = "see clause (b), sub-section (2), section 70(zd), section 393(1) [Table: Sl. No. 1(i), 2(ii), 7], Part C of this Chapter, Schedule XI, Chapter V, section 9 and section 3 of the Companies Act"
    texts = spark.createDataFrame([("s5(1)(a)", text), ("s5", None)], "id string, text string")
    got = {(r["raw"], r["ref_type"], r["to_id"], r["resolution"]) for r in references.cross_refs(texts, nodes, tree, rows).collect()}
    assert got == {
        ("clause (b)", "provision", "s5(1)(b)", "exact"), ("sub-section (2)", "provision", "s5(2)", "exact"), ("section 70(zd)", "provision", "s70(1)(zd)", "inferred"), ("section 393(1)", "provision", "s393(1)", "exact"),
        ("s393(1) Table Sl. No. 1(i)", "table_row", "s393:tbl1#1(i)", "exact"), ("s393(1) Table Sl. No. 2(ii)", "table_row", "s393:tbl1#2", "partial"), ("s393(1) Table Sl. No. 7", "table_row", None, "unresolved"),
        ("Part :C", "part", "ch:XIX:C", "exact"), ("Schedule XI", "schedule", "sch:XI", "exact"), ("Chapter V", "chapter", None, "unresolved"), ("section 9", "section", None, "unresolved"), ("section 3", "external", None, "external"),
    }


def test_relative_refs(spark):
    nodes = spark.createDataFrame([(i,) for i in ("s5", "s5(1)", "s5(1)(a)", "s5(1)(b)", "s5(2)")], "id string")
    refs = spark.createDataFrame([("k1", "s5(1)(a)", ["(b)"]), ("k2", "s5(1)(a)", ["(2)"]), ("k3", "s5(1)(a)", ["(9)"])], "ref_key string, from_id string, labels array<string>")
    out = {r["ref_key"]: r["to_id"] for r in structure.relative(refs, nodes, hierarchy.id_closure(nodes, "id")).collect()}
    assert out == {"k1": "s5(1)(b)", "k2": "s5(2)", "k3": None}


def test_table_rows_by_serial_number(spark):
    rows = spark.createDataFrame([("t#1(i)",), ("t#2",)], "row_id string")
    asked = spark.createDataFrame([("a", "t", "1", "(i)"), ("b", "t", "2", "(ii)"), ("c", "t", "7", None)], "ref_key string, table_id string, number string, sub string")
    assert {r["ref_key"]: r["resolution"] for r in structure.table_row_refs(asked, rows).collect()} == {"a": "exact", "b": "partial", "c": "unresolved"}


def before(spark, marked, notes):
    df = spark.createDataFrame([(marked, notes)], "m string, n array<struct<label:string,type:string,prior_text:string,header:string>>")
    return df.select(amend.before(F.col("m"), F.col("n"))).first()[0]


def test_before(spark):
    note = ("11", "substituted", None, 'Sub. for "sub-section (1)(a)(i) or (b)" by Act No. 4 of 2026')
    assert before(spark, "under {{fn:11}}[sub-section (1)(a)(ii) or (b)], only", [note]) == "under sub-section (1)(a)(i) or (b), only"
    assert before(spark, "x {{fn:2}}[new] y", [("2", "substituted", None, "Sub. by Act")]) is None
    assert before(spark, "{{fn:2}}[all of it is new]", [("2", "inserted", None, "Ins. by Act")]) == ""
    assert before(spark, "a {{fn:3}}[b] c", [("3", "omitted", "the old whole", "Omtt.")]) == "the old whole"


def test_endnotes_attach(spark):
    a = spark.createDataFrame([("2@9", "2", "Ins. by Act", None, "inserted", "Act No. 4 of 2026", "1-4-2026"), ("11@5", "11", "Sub. by Act", None, "substituted", None, None)], "key string, label string, header string, prior_text string, type string, amending_act string, effective_date string")
    links = spark.createDataFrame([("11@5", "s2"), ("2@9", "s2")], "key string, provision_id string")
    p = spark.createDataFrame([("s2", "2", None, None)], "id string, number string, schedule string, text_marked string")
    hits = spark.createDataFrame([(0, 1, "c", "body text", ["s2"], 2)], "qid int, rank int, id string, text string, provisions array<string>, tokens int")
    out = amend.attach(hits, amend.endnotes(a, links, p, "structured")).first()
    assert out["text"].split("\n")[1].startswith("Endnote 2 [applies to section 2; amendment type: inserted; by Act No. 4 of 2026") and out["text"].split("\n")[2].startswith("Endnote 11")
    assert out["tokens"] == len(out["text"].split())


def test_windows(spark):
    pages = [(0, p, " ".join(f"w{p}_{i}" for i in range(300))) for p in range(1, 5)]
    whole = " ".join(t for _, _, t in pages).split()
    out = {r["start"]: r for r in chunk.page_windows(spark.createDataFrame(pages, "doc_id int, page int, text string")).collect()}
    starts = list(range(0, max(len(whole) - 64, 1), 448))
    assert sorted(out) == starts
    for s in starts:
        assert out[s]["text"].split() == whole[s : s + 512]
        assert out[s]["page_start"] == s // 300 + 1 and out[s]["page_end"] == (min(s + 512, len(whole)) - 1) // 300 + 1


def test_structural(spark):
    nodes = spark.createDataFrame([("r", None, 0, "root words"), ("a", "r", 1, "x " * 900), ("b", "r", 2, "y " * 10), ("b1", "b", 3, "z z")], "id string, parent string, ord int, text string")
    tree = hierarchy.closure(nodes.select("id", "parent"))
    cut = {r["id"]: (r["whole"], r["tokens"]) for r in chunk.structural(nodes, tree, hierarchy.subtree_tokens(tree, nodes)).collect()}
    assert cut == {"r": (False, 2), "a": (True, 900), "b": (True, 12)}


def test_rate_limit(spark):
    asks = spark.createDataFrame([("u", float(t), t, 1.0) for t in (0, 1, 2, 3600, 3601, 3602)] + [("v", 5.0, 9, 1.0)], "client string, at double, id int, cost double")
    out = {(r["client"], r["id"]): (r["admitted"], r["retry_after"]) for r in events.rate_limited(asks, 2).collect()}
    assert out[("u", 0)][0] and out[("u", 1)][0] and out[("u", 2)] == (False, 3598.0) and out[("u", 3600)][0] and out[("u", 3601)][0] and not out[("u", 3602)][0] and out[("v", 9)][0]


def test_answers(spark):
    row = spark.createDataFrame([("What is the rate under section 393?", ["see section 54 of it now", "See   Section 54 of it now", "x"], 'Ans [C2] and [ C 1 ]', ["p1", "p2"])], "q string, rw array<string>, a string, ev array<string>")
    got = row.select(answers.route(F.col("q"), F.lit(False)).alias("r"), answers.clean_rewrites(F.col("rw")).alias("w"), answers.cited(F.array(F.lit("[C1]")), F.col("a"), F.col("ev"), True).alias("c")).first()
    assert got["r"] == "table" and got["w"] == ["see of it now"] and got["c"] == ["p1", "p2"]
    m = spark.createDataFrame([("Under section 12 in 2026 pay 30% of it",), ("nothing here",)], "a string").select(answers.mutate(F.col("a")).alias("m")).collect()
    assert [r["m"] for r in m] == ["Under section 12 in 2026 pay 91% of it", None]
    t = spark.createDataFrame([("Body\n### Key terms\n- **Company** is one\n- **Ghost** is none\n### Follow-ups\n1. Why?\n", ['"company" means a body'])], "a string, ev array<string>")
    out = t.select(answers.tidy(F.col("a"), F.col("ev")).alias("t")).first()["t"]
    assert out["answer"] == "Body\n### Key terms\n- **Company** is one" and out["follow_ups"] == ["Why?"]


def test_definitions(spark):
    p = spark.createDataFrame([("s2(109)", '"transfer" means a sale'), ("s2(82)", '"principal commissioner" means one'), ("s2(9)", '"commissioner" means one')], "id string, text string")
    d = answers.definitions(p)
    q = spark.createDataFrame([(1, 'What is "transfer"?'), (2, "definition of a Principal Commissioner of Income-tax")], "qid int, text string")
    assert {(r["qid"], r["term"], r["pid"]) for r in answers.find_definitions(q, d).collect()} == {(1, "transfer", "s2(109)"), (2, "principal commissioner", "s2(82)")}
