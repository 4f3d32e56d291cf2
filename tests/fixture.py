"""A small invented statute as literal tables, for the operators whose input the driver's tables don't have; the same rows as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark types by SQL types, for the literals below.
SQL_TYPES = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "array<double>": "DOUBLE[]", "map<string,string>": "MAP(VARCHAR, VARCHAR)"}

TABLES: dict[str, tuple[str, list[tuple]]] = {
    "prov": (
        "id string, kind string, number string, label string, heading string, text string, text_marked string, parent string, chapter string, schedule string, page_start int, page_end int, ord int",
        [
            ("ch:I", "chapter", "I", "I", "Preliminary", "", None, None, "I", None, 1, 1, 0),
            ("s2", "section", "2", "2", "Definitions", "In this Act,", None, "ch:I", "I", None, 1, 1, 1),
            ("s2(1)", "clause", "2(1)", "(1)", None, '"accountant" means a person whom section 5(1)(b) names;', None, "s2", "I", None, 1, 1, 2),
            ("s2(2)", "clause", "2(2)", "(2)", None, '"late levy" includes a levy that is paid after thirty days from notice;', None, "s2", "I", None, 1, 2, 3),
            ("s2(3)", "clause", "2(3)", "(3)", None, '"levy" means—', None, "s2", "I", None, 2, 2, 4),
            ("s2(3)(a)", "clause", "2(3)(a)", "(a)", None, "a charge that Schedule III lays upon every holder;", None, "s2(3)", "I", None, 2, 2, 5),
            ("ch:II", "chapter", "II", "II", "Charge", "", None, None, "II", None, 3, 3, 6),
            ("s5", "section", "5", "5", "Charge of levy", "A levy is due.", None, "ch:II", "II", None, 3, 3, 7),
            ("s5(1)", "sub-section", "5(1)", "(1)", None, "Every holder shall pay within thirty days—", None, "s5", "II", None, 3, 3, 8),
            ("s5(1)(a)", "clause", "5(1)(a)", "(a)", None, "a levy of 2% of Rs. 50,000;", "{{fn:1}}[a levy of 2% of Rs. 50,000;]", "s5(1)", "II", None, 3, 3, 9),
            ("s5(1)(b)", "clause", "5(1)(b)", "(b)", None, "the costs of an accountant of the holder, as clause (a) has them.", "the costs of an accountant of {{fn:2}}[the holder], as clause (a) has them.", "s5(1)", "II", None, 3, 4, 10),
            ("s5(2)", "sub-section", "5(2)", "(2)", None, "Sub-section (1) does not touch section 2(1) of the Companies Act, 2013, nor section 9 or Chapter I.", None, "s5", "II", None, 4, 4, 11),
            ("s5(3)", "sub-section", "5(3)", "(3)", None, "Section 5(2) [Table: Sl. No. 1(i), 2] and section 2(a) stand.", None, "s5", "II", None, 4, 5, 12),
            ("s5:tbl1", "table", "5 (Table)", None, None, "", None, "s5(2)", "II", None, 5, 5, 13),
            ("sch:III", "schedule", "Schedule III", "III", "Charges", "Rates of charge", None, None, None, "sch:III", 6, 6, 14),
            ("sch:III:4", "paragraph", "Schedule III, paragraph 4", "4", "Holders", "Part A of this Chapter is no matter here; section 5 applies.", None, "sch:III", None, "sch:III", 6, 7, 15),
        ],
    ),
    "trow": (
        "row_id string, table_id string, sl_no string, subrow string, sl_label string, row_heading string, cells map<string,string>, rate string, threshold string, page_start int, page_end int",
        [
            ("s5:tbl1#1(i)", "s5:tbl1", "1", "(i)", "1(i)", "Rent", {"Sl. No.": "1", "Nature of payment": "(i) Rent of land.", "Payer": "Any person."}, "10%", "Rs. 5,00,000.", 5, 5),
            ("s5:tbl1#1(ii)", "s5:tbl1", "1", "(ii)", "1(ii)", "Rent", {"Sl. No.": "1", "Nature of payment": "(ii) Rent of plant.", "Payer": ""}, "2%", "nil", 5, 5),
            ("s5:tbl1#2", "s5:tbl1", "2", None, "2", None, {"Sl. No.": "2", "Nature of payment": "Commission", "Payer": "A company."}, "Rates in force.", None, 5, 5),
            ("s5:tbl1#11", "s5:tbl1", "11", None, "11", None, {"Sl. No.": "11", "Nature of payment": "Other"}, None, None, 5, 6),
        ],
    ),
    "tab": ("table_id string, title string, notes array<string>", [("s5:tbl1", "Payments", ["First note.", "Second note."])]),
    "amend": (
        "key string, label string, page int, line_index long, header string, prior_text string, type string, amending_act string, effective_date string, linked_nodes array<string>",
        [
            ("1@40", "1", 9, 40, "Ins. by Act No. 4 of 2026, w.e.f. 1-4-2026.", None, "inserted", "Act No. 4 of 2026", "1-4-2026", ["s5(1)(a)"]),
            ("2@41", "2", 9, 41, 'Sub. for "the owner" by Act No. 4 of 2026, w.e.f. 1-4-2026.', None, "substituted", "Act No. 4 of 2026", "1-4-2026", ["s5(1)(b)", "s5(1)(b)"]),
            ("11@44", "11", 9, 44, "Clause (c) omitted by Act No. 4 of 2026. Prior to its omission, clause (c) read as under:", "(c) a fee of the clerk.", "omitted", "Act No. 4 of 2026", None, ["s5(1)", "s5"]),
            ("12@46", "12", 9, 46, "See the notes.", None, "other", None, None, []),
        ],
    ),
    "q": (
        "id string, type string, question string, gold_facts array<string>, gold_provisions array<string>, gold_table_rows array<string>, am_type string, am_prior string, am_note string, should_refuse boolean, style string, person string, pair_of string, status string",
        [
            ("q1", "lookup", "What does one pay within thirty days?", ["2%", "Rs. 50,000"], ["s5(1)"], [], None, None, None, False, None, None, None, "accepted"),
            ("q2", "table", "What is the rate on rent of land?", ["10%"], ["s5:tbl1"], ["s5:tbl1#1(i)"], None, None, None, False, None, None, None, "accepted"),
            ("q3", "amendment", "How was section 5(1)(b) amended?", ["substituted", "the owner"], ["s5(1)(b)"], [], "substituted", None, "2@41", False, None, None, None, "unverified"),
            ("q4", "refusal", "Which form do I file?", [], [], [], None, None, None, True, None, None, None, "accepted"),
            ("q5", "multi_hop", "Who is an accountant, and what are the costs?", ["accountant"], ["s2(1)"], ["s5:tbl1#2"], None, None, None, False, None, None, None, "accepted"),
            ("q6", "amendment", "What did section 5(1) say before?", ["omitted", "a fee of the clerk"], ["s5(1)"], [], "omitted", "(c) a fee of the clerk.", "11@44", False, None, None, None, "accepted"),
            ("l1", "lookup", "How soon do I have to pay what I owe?", ["2%"], ["s5(1)"], [], None, None, None, False, "paraphrase", "first", "q1", "unverified"),
            ("l2", "lookup", 'Under section 5, is "levy" the costs accountant holder clause (a) has them?', ["17%"], ["s5(1)", "s99"], [], None, None, None, False, "situation", "third", None, "unverified"),
            ("l3", "refusal", "Will they fine me?", [], ["s5"], [], None, None, None, True, "situation", "first", None, "unverified"),
        ],
    ),
    "ans": (
        "id string, answer string, refused boolean, latency_s double, llm_tokens long, evidence_tokens long",
        [
            ("q1", "A levy of 2 per cent of fifty thousand rupees, that is Rs 50,000 [C1], within 30 days.", False, 1.5, 100, 40),
            ("q2", "The rate is 12%.", False, 0.5, 50, 30),
            ("q3", 'The words were replaced: from "the owner" to "the holder".', False, 2.5, 70, 20),
            ("q4", "That is not covered.", True, 0.25, 10, 0),
            ("q5", None, True, 0.75, 20, 10),
            ("q6", "It was inserted. Clause (c) said a fee of the clerk.", False, 3.5, 90, 25),
        ],
    ),
    "cit": (
        "id string, n int, provisions array<string>, text string",
        [
            ("q1", 1, ["s5(1)", "s5(1)(a)"], "Every holder shall pay within 30 days a levy of 2% of Rs. 50,000;"),
            ("q1", 2, ["s2(2)"], "late levy"),
            ("q2", 1, ["s5:tbl1#1(ii)", "s5:tbl1"], "Rent of plant: 2%"),
            ("q3", 1, ["s5(1)(b)"], "the costs of an accountant of the holder"),
            ("q6", 1, ["s2"], "In this Act,"),
        ],
    ),
    "chunk": (
        "id string, provisions array<string>, text string, tokens int, vector array<double>",
        [
            ("c:s2", ["s2", "s2(1)", "s2(2)", "s2(3)", "s2(3)(a)"], "definitions of accountant and levy", 80, [1.0, 0.0, 0.0]),
            ("c:s5", ["s5"], "charge of levy", 5, [0.8, 0.6, 0.0]),
            ("c:s5(1)", ["s5(1)", "s5(1)(a)", "s5(1)(b)"], "holder shall pay a levy", 90, [0.0, 1.0, 0.0]),
            ("c:s5(2)", ["s5(2)"], "does not touch", 70, [0.0, 0.6, 0.8]),
            ("c:row1", ["s5:tbl1#1(i)", "s5:tbl1"], "rent of land", 60, [0.0, 0.0, 1.0]),
            ("c:sch", ["sch:III", "sch:III:4"], "rates of charge", 65, [0.6, 0.0, 0.8]),
        ],
    ),
    "ask": (
        "qid int, text string, vector array<double>",
        [
            (1, "What does section 5(1)(b) say of section 2(1)?", [0.0, 1.0, 0.0]),
            (2, 'What is the meaning of "levy"?', [1.0, 0.0, 0.0]),
            (3, "definition of a late levy under section 2", [0.9, 0.1, 0.0]),
            (4, "the rate and threshold for rent", [0.0, 0.0, 1.0]),
            (5, "How was section 5 amended by Schedule III, Part A?", [0.6, 0.0, 0.8]),
            (6, "nothing of the kind", [0.5, 0.5, 0.5]),
        ],
    ),
    "note_line": (
        "doc_id int, line_index long, page int, text string",
        [
            (0, 40, 9, "1. Ins. by Act No. 4 of 2026, w.e.f. 1-4-2026."),
            (0, 41, 9, '2. Sub. for "the owner" by Act No. 4 of 2026,'),
            (0, 42, 9, "w.e.f. 1-4-2026."),
            (0, 44, 9, "11. Clause (c) omitted by Act No. 4 of 2026. Prior to its omission, clause (c) read as under :"),
            (0, 45, 10, "'(c) a fee of the clerk.'"),
            (0, 46, 10, "12. Section 9 renumbered as section 10 and ins. by Act No. 5 of 2026."),
        ],
    ),
    "marker": ("doc_id int, label string, line_index long, node string", [(0, "1", 9, "s5(1)(a)"), (0, "2", 10, "s5(1)(b)"), (0, "1", 41, "s9"), (0, "11", 8, "s5(1)"), (0, "2", 40, "s5")]),
    "line": (
        "doc_id int, line_index long, page int, x double, y double, text string, bold boolean",
        [
            (0, 0, 1, 0.0, 10.0, "CHAPTER I", True), (0, 1, 1, 0.0, 20.0, "2. Definitions.", True), (0, 2, 1, 0.0, 30.0, "In this Act,", False), (0, 3, 1, 20.0, 40.0, '(1) "levy" is', False), (0, 4, 1, 5.0, 50.0, "a charge;", False),
            (0, 5, 1, 20.0, 60.0, "(2) dues are", False), (0, 6, 1, 40.0, 70.0, "(a) rents;", False), (0, 7, 2, 40.0, 10.0, "(b) fees.", False), (0, 8, 2, 0.0, 20.0, "3. Charge.", True), (0, 9, 2, 20.0, 30.0, "(1)(a) one and", False),
            (0, 10, 2, 24.0, 40.0, "(b) two.", False), (0, 11, 2, 0.0, 50.0, "Table", False), (0, 12, 2, 0.0, 60.0, "Sl.", False), (0, 13, 2, 30.0, 60.0, "Nature of", False), (0, 14, 2, 80.0, 60.0, "Rate", False), (0, 15, 2, 31.0, 70.0, "payment", False),
            (0, 16, 2, 2.0, 80.0, "A", False), (0, 17, 2, 32.0, 80.0, "B", False), (0, 18, 2, 82.0, 80.0, "C", False), (0, 19, 3, 0.0, 10.0, "1.", False), (0, 20, 3, 33.0, 10.0, "Rent of", False), (0, 21, 3, 80.0, 10.0, "Rate: 10%", False), (0, 22, 3, 33.0, 20.0, "land", False),
            (0, 23, 3, 0.0, 30.0, "2.", False), (0, 24, 3, 33.0, 30.0, "Fees", False), (0, 25, 3, 80.0, 30.0, "2%", False), (0, 26, 3, 0.0, 40.0, "4. Next.", True), (0, 27, 3, 0.0, 50.0, "SCHEDULE III", True), (0, 28, 3, 0.0, 60.0, "Part A", True), (0, 29, 3, 0.0, 70.0, "4. Funds.", True), (0, 30, 3, 20.0, 80.0, "(f) a fund.", False),
        ],
    ),
    "piece": (
        "reply string, seq long, piece string",
        [("r1", 0, '{"citations": ["C1"], "answ'), ("r1", 1, 'er" : "A \\'), ("r1", 2, '"levy\\" of \\u20'), ("r1", 3, 'b95\\n'), ("r1", 4, 'due", "refused": false}'), ("r1", 5, "after"), ("r2", 0, '{"answer":""}'), ("r3", 0, "no field at all")],
    ),
    "screen": (
        "qid int, question string, reply string",
        [
            (1, "What is the rate of levy?", '{"category": "act", "reason": "in it", "kind": "table", "queries": ["rate of levy under section 54", "rate of levy"]}'),
            (2, "Which form do I file?", 'Sure: {"category": "forms", "reason": "asks for a form", "kind": "general"}'),
            (3, "Is tax deducted at source on fees?", '{"category": "other_law", "kind": "oops"}'),
            (4, "What does the Finance Bill, 2027 propose?", '{"category": "act", "kind": "general"}'),
            (5, "Did the 2026 budget raise it?", '{"category": "act", "kind": "table"}'),
            (6, "What is the penalty under the Black Money Act for it?", '{"category": "act"}'),
            (7, "Will it fail?", None),
            (8, "Is it JSON?", "no"),
            (9, "Odd?", '{"category": "strange", "in_scope": false}'),
        ],
    ),
}


def frame(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = TABLES[name]
    # dictionaries would lose their order on the way
    maps = [n for n, kind in _fields(schema) if kind.startswith("map")]
    flat = [tuple(list(v.items()) if isinstance(v, dict) else v for v in row) for row in rows]
    out = spark.createDataFrame(flat, schema.replace("map<string,string>", "array<struct<key:string,value:string>>"))
    return out.withColumns({n: F.map_from_entries(n) for n in maps}) if maps else out


def _fields(schema: str) -> list[tuple[str, str]]:
    """(name, type) of a schema; commas within types don't count."""
    out, depth, part = [], 0, ""
    for c in schema + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = part.strip().split(" ", 1)
            out.append((name, kind))
            part = ""
        else:
            part += c
    return out


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, list):
        return "[" + ", ".join(map(_literal, value)) + "]"
    if isinstance(value, dict):
        return "MAP {" + ", ".join(f"{_literal(k)}: {_literal(v)}" for k, v in value.items()) + "}"
    return str(value)


def ctes(*names: str) -> str:
    """The named tables as SQL common table expressions, without WITH."""
    parts = []
    for name in names:
        schema, rows = TABLES[name]
        fields = _fields(schema)
        cast = ", ".join(f"CAST({n} AS {SQL_TYPES[t]}) AS {n}" for n, t in fields)
        values = ", ".join("(" + ", ".join(map(_literal, row)) + ")" for row in rows)
        parts.append(f"{name} AS (SELECT {cast} FROM (VALUES {values}) v({', '.join(n for n, _ in fields)}))")
    return ",\n".join(parts)
