"""Cases of the structuring, look-up, answering and evaluation operators over the fixture's small tables. They are unit tests, not registered queries.

What SQL can compute from the same literals it computes; where an operator reads text, the SQL states the rows
that the text means.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import labels as L
from quillon.functions import text as T
from quillon.operators import agent, amend, answers, chunk, evals, hierarchy, lookups, outline, questions, rank, references, retrieve, scoring, structure
from quillon.streaming import decode
from tests.fixture import ctes, frame

CASES: dict = {}
ORACLES: dict = {}


def query(sql):
    def register(f):
        CASES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


_UP = "up AS (SELECT id, id AS ancestor, 0 AS depth FROM prov UNION ALL SELECT u.id, p.parent, u.depth + 1 FROM up u JOIN prov p ON p.id = u.ancestor WHERE p.parent IS NOT NULL)"
_REF = f"{ctes('prov', 'trow')}, {_UP}"


def _tree(spark: SparkSession) -> DataFrame:
    return hierarchy.closure(frame(spark, "prov").select("id", "parent"))


def _pids(spark: SparkSession) -> DataFrame:
    """(pid, ancestor, depth) of the fixture's nodes."""
    return _tree(spark).withColumnRenamed("id", "pid")


def _joined(col: str) -> F.Column:
    return F.array_join(col, "; ").alias(col)


def values(rows: list[tuple], names: str) -> str:
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({names})"


# ---------------------------------------------------------------------- structuring

@query("""SELECT n::INT AS n, repeat('M', n::INT // 1000) || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][(n // 100 % 10 + 1)::INT] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][(n // 10 % 10 + 1)::INT] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][(n % 10 + 1)::INT] AS roman, n::INT AS back FROM range(1, 4000) t(n)""")
def roman_numerals(spark, base):
    """Every number below 4000 to its numeral and back."""
    rows = spark.range(1, 4000).select(F.col("id").cast("int").alias("n")).withColumn("roman", L.to_roman(F.col("n")))
    return rows.withColumn("back", L.roman_value(F.col("roman")))


_SEQUENCES = [
    ("1", "2", "num", True), ("1", "3", "num", True), ("1", "4", "num", False), ("2", "2A", "num", True), ("2A", "2", "num", False), ("a", "b", "alpha", True), ("a", "c", "alpha", True), ("a", "d", "alpha", False),
    ("f", "fa", "alpha", True), ("fa", "g", "alpha", True), ("z", "za", "alpha", True), ("i", "ii", "roman", True), ("iv", "v", "roman", True), ("iv", "vii", "roman", False), ("iiii", "v", "roman", False), ("A", "B", "ALPHA", True), ("IX", "X", "ROMAN", True),
]


@query(values([(a, b, k, ok) for a, b, k, ok in _SEQUENCES], "before, label, kind, follows"))
def label_sequences(spark, base):
    rows = spark.createDataFrame([r[:3] for r in _SEQUENCES], "before string, label string, kind string")
    return rows.withColumn("follows", L.follows(F.col("before"), F.col("label"), F.col("kind")))


@query(values([("3", "num"), ("2A", "num"), ("a", "alpha"), ("i", "alpha; roman"), ("ii", "roman"), ("za", "alpha"), ("fa", "alpha"), ("A", "ALPHA"), ("I", "ALPHA; ROMAN"), ("IV", "ROMAN"), ("AB", "")], "label, classes"))
def label_kinds(spark, base):
    rows = spark.createDataFrame([(x,) for x in ("3", "2A", "a", "i", "ii", "za", "fa", "A", "I", "IV", "AB")], "label string")
    return rows.select("label", F.array_join(L.label_classes(F.col("label")), "; ").alias("classes"))


_NOTES = [
    ("1@40", "1", 9, "inserted", "Act No. 4 of 2026", "1-4-2026", None, None),
    ("2@41", "2", 9, "substituted", "Act No. 4 of 2026", "1-4-2026", '"the owner"', None),
    ("11@44", "11", 9, "omitted", "Act No. 4 of 2026", None, "clause (c)", "(c) a fee of the clerk."),
    ("12@46", "12", 10, "renumbered", "Act No. 5 of 2026", None, "Section 9 renumbered as section 10 and", None),
]


@query(values(_NOTES, "key, label, page, type, amending_act, effective_date, target_desc, prior_text"))
def note_fields(spark, base):
    return structure.notes(frame(spark, "note_line")).select("key", "label", "page", "type", "amending_act", "effective_date", "target_desc", "prior_text")


@query(f"""WITH {ctes('marker', 'amend')}, f AS (SELECT m.node, m.line_index, arg_min(a.key, a.line_index) AS key FROM marker m LEFT JOIN amend a ON a.label = m.label AND a.line_index > m.line_index GROUP BY ALL)
SELECT node, key, key IS NULL AS open FROM f""")
def note_links(spark, base):
    """Each marker's first later note of its label, and the markers without one."""
    notes = frame(spark, "amend").select(F.lit(0).alias("doc_id"), "label", "line_index", "key")
    links, open_ones = structure.link_notes(frame(spark, "marker"), notes)
    return links.select(F.col("provision_id").alias("node"), "key", F.lit(False).alias("open")).unionByName(open_ones.select("node", F.lit(None).cast("string").alias("key"), F.lit(True).alias("open")))


_EDGES = [
    ("s2(1)", "section 5(1)(b)", "provision", "s5(1)(b)", "exact"), ("s2(3)(a)", "Schedule III", "schedule", "sch:III", "exact"), ("s5(1)(b)", "clause (a)", "provision", "s5(1)(a)", "exact"),
    ("s5(2)", "section 2(1)", "external", None, "external"), ("s5(2)", "section 9", "section", None, "unresolved"), ("s5(2)", "Chapter I", "chapter", "ch:I", "exact"),
    ("s5(3)", "section 2(a)", "provision", "s2(3)(a)", "inferred"), ("sch:III:4", "Part :A", "part", None, "unresolved"), ("sch:III:4", "section 5", "section", "s5", "exact"),
]


@query(values(_EDGES, "from_id, raw, ref_type, to_id, resolution"))
def cross_references(spark, base):
    p = frame(spark, "prov")
    return references.cross_refs(p.select("id", "text"), p.select("id", "kind", "chapter"), _pids(spark), frame(spark, "trow").select("row_id", "table_id"))


@query(f"""WITH RECURSIVE {_REF}, asked(ref, base, labels) AS (VALUES (1, 's5', ['(1)', '(b)']), (2, 's5', ['(1)', '(z)']), (3, 's2', ['(a)']), (4, 's7', ['(1)']), (5, 's5', []::VARCHAR[])),
walk AS (SELECT ref, base, labels, n, base || array_to_string(labels[1:n], '') AS id FROM asked, range(0, 4) t(n) WHERE n <= len(labels)),
deep AS (SELECT ref, max(n) AS n FROM walk WHERE id IN (SELECT id FROM prov) GROUP BY ref),
hit AS (SELECT a.ref, a.labels, d.n, a.base || array_to_string(a.labels[1:d.n], '') AS at, array_to_string(a.labels[d.n + 1:], '') AS rest FROM asked a LEFT JOIN deep d USING (ref)),
inf AS (SELECT h.ref, min(u.id) AS id FROM hit h JOIN up u ON u.ancestor = h.at AND u.depth > 0 AND ends_with(u.id, h.rest) WHERE h.rest <> '' GROUP BY h.ref HAVING count(*) = 1)
SELECT h.ref, CASE WHEN h.n IS NULL THEN NULL ELSE coalesce(i.id, h.at) END AS to_id, CASE WHEN h.n IS NULL THEN 'unresolved' WHEN h.rest = '' THEN 'exact' WHEN i.id IS NOT NULL THEN 'inferred' ELSE 'partial' END AS resolution FROM hit h LEFT JOIN inf i USING (ref)""")
def deepest_prefix(spark, base):
    refs = spark.createDataFrame([(1, "s5", ["(1)", "(b)"]), (2, "s5", ["(1)", "(z)"]), (3, "s2", ["(a)"]), (4, "s7", ["(1)"]), (5, "s5", [])], "ref_key int, base string, labels array<string>")
    return structure.resolve(refs, frame(spark, "prov").select("id"), _pids(spark)).select(F.col("ref_key").alias("ref"), "to_id", "resolution")


@query(f"""WITH {ctes('trow')}, asked(ref, n, sub) AS (VALUES (1, '1', '(ii)'), (2, '2', '(ix)'), (3, '11', NULL), (4, '7', NULL))
SELECT ref, coalesce(e.row_id, b.row_id) AS to_id, CASE WHEN e.row_id IS NOT NULL THEN 'exact' WHEN b.row_id IS NOT NULL THEN 'partial' ELSE 'unresolved' END AS resolution
FROM asked LEFT JOIN trow e ON e.row_id = 's5:tbl1#' || n || coalesce(sub, '') LEFT JOIN trow b ON b.row_id = 's5:tbl1#' || n""")
def serial_numbers(spark, base):
    asked = spark.createDataFrame([(1, "s5:tbl1", "1", "(ii)"), (2, "s5:tbl1", "2", "(ix)"), (3, "s5:tbl1", "11", None), (4, "s5:tbl1", "7", None)], "ref_key int, table_id string, number string, sub string")
    return structure.table_row_refs(asked, frame(spark, "trow").select("row_id")).withColumnRenamed("ref_key", "ref")


_OUTLINE = [
    ("ch:I", None, "chapter", "", 1), ("s2", "ch:I", "section", "Definitions. In this Act,", 1), ("s2(1)", "s2", "clause", '"levy" is a charge;', 1), ("s2(2)", "s2", "clause", "dues are", 1), ("s2(2)(a)", "s2(2)", "clause", "rents;", 1), ("s2(2)(b)", "s2(2)", "clause", "fees.", 2),
    ("s3", "ch:I", "section", "Charge.", 2), ("s3(1)", "s3", "clause", "", 2), ("s3(1)(a)", "s3(1)", "clause", "one and", 2), ("s3(1)(b)", "s3(1)", "clause", "two.", 2),
    ("s4", "ch:I", "section", "Next.", 3), ("sch:III", None, "schedule", "", 3), ("sch:III:A", "sch:III", "part", "", 3), ("sch:III:A:4", "sch:III:A", "paragraph", "Funds.", 3), ("sch:III:A:4(f)", "sch:III:A:4", "clause", "a fund.", 3),
]


def _without_tables(lines: DataFrame) -> DataFrame:
    return lines.where("line_index not between 11 and 25")


@query(values(_OUTLINE, "id, parent, kind, text, page_start"))
def outline_nodes(spark, base):
    return outline.outline(_without_tables(frame(spark, "line"))).select("id", "parent", "kind", F.coalesce("text", F.lit("")).alias("text"), "page_start")


_UNITS = [(1, 1, False, 0), (2, 3, False, 1), (4, 4, False, 0), (6, 1, True, 0), (7, 2, True, 0), (9, 7, False, 2)]


@query(values(_UNITS, "line_index, number, in_schedule, skipped"))
def accepted_units(spark, base):
    """Numbers of headings that go on with the last one; 9 after 3, a second 4 and a paragraph 5 after 2 are none."""
    rows = [(0, 1, 1, False), (0, 2, 3, False), (0, 3, 9, False), (0, 4, 4, False), (0, 5, 4, False), (0, 6, 1, True), (0, 7, 2, True), (0, 8, 5, True), (0, 9, 7, False)]
    return outline.accepted_units(spark.createDataFrame(rows, "doc_id int, line_index long, number int, in_schedule boolean")).drop("doc_id")


@query(values([("s1", "Charge. as", None), ("s1(1)", "tax under sub-section (3) applies; and", "s1"), ("s1(2)", "more", "s1"), ("s1(2)(a)", "rents", "s1(2)")], "id, text, parent"))
def plausible_labels(spark, base):
    """A reference that begins a wrapped line is text: (3), left of the list that (1) opened."""
    rows = [(0, 0, 1, 0.0, "1. Charge.", True), (0, 1, 1, 0.0, "as", False), (0, 2, 1, 20.0, "(1) tax under sub-section", False), (0, 3, 1, 5.0, "(3) applies; and", False), (0, 4, 1, 20.0, "(2) more", False), (0, 5, 1, 40.0, "(a) rents", False)]
    lines = spark.createDataFrame(rows, "doc_id int, line_index long, page int, x double, text string, bold boolean")
    return outline.outline(lines, strict=True).select("id", "text", "parent")


@query(values([(1, 0, 0, "1."), (1, 0, 1, "Rent"), (1, 1, 1, "(i) of land"), (1, 1, 2, "10%"), (1, 2, 1, "(ii) of plant"), (1, 2, 2, "2%"), (2, 0, 0, "2."), (2, 0, 1, "Fees")], '"row", subrow, col, text'))
def table_subrows(spark, base):
    rows = ["0|Table", "0|A", "30|B", "80|C", "0|1.", "33|Rent", "33|(i) of", "80|10%", "33|land", "33|(ii) of plant", "80|2%", "0|2.", "33|Fees", "0|Note 1.—first", "5|goes on", "0|Note 2.—second"]
    lines = spark.createDataFrame([(0, k, 1, float(x), t, False) for k, (x, t) in enumerate(r.split("|") for r in rows)], "doc_id int, line_index long, page int, x double, text string, bold boolean")
    return outline.tables(lines).select(*[F.col(c).cast("int").alias(c) for c in ("row", "subrow", "col")], "text")


@query(values([(1, "Note 1.—first goes on"), (2, "Note 2.—second")], "n, text"))
def table_notes(spark, base):
    rows = ["0|Table", "0|A", "30|B", "0|1.", "33|Rent", "0|Note 1.—first", "5|goes on", "0|Note 2.—second"]
    lines = spark.createDataFrame([(0, k, 1, float(x), t, False) for k, (x, t) in enumerate(r.split("|") for r in rows)], "doc_id int, line_index long, page int, x double, text string, bold boolean")
    return outline.table_notes(lines).select(F.col("n").cast("int").alias("n"), "text")


@query(values([(1, True, False), (2, False, True), (3, False, False)], "n, joined, crossing"))
def cell_boundaries(spark, base):
    rows = spark.createDataFrame([(1, [0.0, 31.0], 200.0), (2, [32.0, 50.0], 560.0), (3, [0.0], 30.0)], "n int, xs array<double>, x1 double")
    edges = F.array(*map(F.lit, (0.0, 30.0, 80.0)))
    return rows.select("n", outline.joined_cells(F.col("xs"), edges).alias("joined"), (outline.crossing(F.col("xs")[0], F.col("x1"), edges) & ~outline.joined_cells(F.col("xs"), edges)).alias("crossing"))


@query(values([("(1) a", 10.0), ("[(1) a", 12.8), ("[[", 40.0), ("text", 3.0)], "text, x"))
def label_places(spark, base):
    rows = spark.createDataFrame([("(1) a",), ("[(1) a",), ("[[",), ("text",)], "text string")
    first = F.struct(F.col("text").alias("text"), F.array(F.lit(10.0), F.lit(0.0), F.lit(40.0), F.lit(9.0)).alias("bbox"))
    return rows.select("text", F.round(structure.label_x(first, F.lit(3.0)), 4).alias("x"))


_SPAN = "struct<text:string,font:string,size:double,bbox:array<double>>"
_LAYOUT = [("Body low", 0, 805.0, True, False), ("Body bold", 1, 100.0, True, True)]


@query(values(_LAYOUT, "text, b, y0, plain, bold"))
def layout_lines(spark, base):
    """Running heads and feet go by font, size and place; body text at the page's edge stays; labels of amended words stand apart."""
    from quillon.sources import files

    span = lambda t, font, size, y: (t, font, size, [10.0, y, 50.0, y + 8])
    head, foot = span("Head", "NotoSans-Bold", 9.0, 20.0), span("Page 7", "NotoSans-Italic", 7.5, 806.0)
    blocks = [([([head],), ([span("Body\u00a0low", "Serif", 10.0, 805.0)],), ([foot],)],), ([([span("Body", "Serif-Bold", 10.0, 100.0), span("3", "Serif", 7.1, 98.0), span("\u00a0bold", "Serif-Bold", 10.0, 100.0)],)],)]
    raw = spark.createDataFrame([(0, 1, blocks)], f"doc_id int, page int, blocks array<struct<lines:array<struct<spans:array<{_SPAN}>>>>>")
    return files.text_lines(raw).select("text", "b", "y0", (~F.col("all_italic")).alias("plain"), F.col("all_bold").alias("bold"))


@query(values([("3", "{{fn:3}}")], "label, token"))
def layout_markers(spark, base):
    from quillon.sources import files

    raw = spark.createDataFrame([(0, 1, [([([("a", "Serif", 10.0, [0.0] * 4), (" 3 ", "Serif", 7.1, [0.0] * 4)],)],)])], f"doc_id int, page int, blocks array<struct<lines:array<struct<spans:array<{_SPAN}>>>>>")
    return files.markers(raw).select("label", structure.marker_token(F.col("label")).alias("token"))


@query(values([("-2", "| version | recall | mrr |"), ("-1", "|---|---|---|"), ("2", "| v2 | 0.5000 | 0.2500 |"), ("10", "| v10 | 0.7500 | - |")], "ord, line"))
def version_report(spark, base):
    from quillon.sources import files

    rows = spark.createDataFrame([("v10", "recall", 0.75), ("v2", "recall", 0.5), ("v2", "mrr", 0.25)], "version string, metric string, value double")
    return files.report(rows, ["recall", "mrr"]).select(F.col("ord").cast("string").alias("ord"), "line")


@query(values([(1, 0, "1."), (1, 1, "Rent of land"), (1, 2, "Rate: 10%"), (2, 0, "2."), (2, 1, "Fees"), (2, 2, "2%")], '"row", col, text'))
def table_cells(spark, base):
    return outline.tables(frame(spark, "line")).select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "text")


@query(values([(0, "Sl."), (1, "Nature of payment"), (2, "Rate")], "col, heading"))
def table_headings(spark, base):
    return outline.headers(frame(spark, "line")).select(F.col("col").cast("int").alias("col"), "heading")


@query(values([("Rate: 10% Threshold: Rs. 50", "10%", "Rs. 50"), ("rate - 2%", "2%", None), ("Threshold : nil", None, "nil"), ("no such", None, None)], "cell, rate, threshold"))
def rates_and_thresholds(spark, base):
    rows = spark.createDataFrame([(x,) for x in ("Rate: 10% Threshold: Rs. 50", "rate - 2%", "Threshold : nil", "no such")], "cell string")
    return rows.select("cell", structure.rate_and_threshold(F.col("cell")).alias("x")).select("cell", "x.*")


@query(f"""WITH {ctes('prov', 'amend')}, l AS (SELECT key, unnest(list_distinct(linked_nodes)) AS id FROM amend), k AS (SELECT id, string_agg(key, '; ' ORDER BY key) AS keys FROM l GROUP BY id)
SELECT p.id, k.keys IS NOT NULL AS is_amended, coalesce(k.keys, '') AS amendments FROM prov p LEFT JOIN k USING (id)""")
def amended_flags(spark, base):
    return structure.amended(frame(spark, "prov"), _links(spark)).select("id", "is_amended", _joined("amendments"))


def _links(spark: SparkSession) -> DataFrame:
    return frame(spark, "amend").select("key", F.explode(F.array_distinct("linked_nodes")).alias("provision_id"))


@query(f"""WITH {ctes('prov', 'amend', 'trow')}, l AS (SELECT DISTINCT key FROM (SELECT key, unnest(linked_nodes) AS id FROM amend)), s AS (SELECT regexp_extract(sl_no, '^([0-9]+)', 1)::INT AS n FROM trow), b AS (SELECT n - lag(n) OVER (ORDER BY n) AS step FROM s)
SELECT (SELECT count(*) FROM prov WHERE kind = 'section') AS sections, (SELECT count(DISTINCT number) FROM prov WHERE kind = 'section') AS distinct_sections, (SELECT count(*) FROM prov WHERE kind = 'table') AS tables, (SELECT count(*) FROM prov) AS nodes,
(SELECT round(avg((key IN (SELECT key FROM l))::INT), 4) FROM amend) AS note_link_rate, 0.6667::DOUBLE AS resolved_rate, (SELECT count(*) FROM b WHERE step > 1) AS serial_breaks""")
def structure_scorecard(spark, base):
    refs = spark.createDataFrame([("exact",), ("inferred",), ("partial",), ("external",)], "resolution string")
    out = structure.scorecard(frame(spark, "prov"), frame(spark, "amend"), _links(spark), refs, frame(spark, "trow"))
    return out.withColumn("note_link_rate", F.round("note_link_rate", 4)).withColumn("resolved_rate", F.round("resolved_rate", 4))


# ---------------------------------------------------------------------- chunks

_SUB = "sub AS (SELECT u.ancestor AS id, string_agg(p.text, chr(10) ORDER BY p.ord) AS text FROM up u JOIN prov p ON p.id = u.id GROUP BY u.ancestor)"


@query(f"WITH RECURSIVE {_REF}, {_SUB} SELECT id, md5(text) AS digest FROM sub")
def subtree_texts(spark, base):
    return hierarchy.subtree_text(_tree(spark), frame(spark, "prov")).select("id", F.md5(F.col("text").cast("binary")).alias("digest"))


_CUT = f"""{_SUB}, sized AS (SELECT p.id, len(list_filter(regexp_split_to_array(s.text, '\\s+'), lambda x: x <> '')) AS n, len(list_filter(regexp_split_to_array(coalesce(p.text, ''), '\\s+'), lambda x: x <> '')) AS own, EXISTS (SELECT 1 FROM prov c WHERE c.parent = p.id) AS inner_node FROM prov p JOIN sub s USING (id)),
flag AS (SELECT *, n > 20 AND inner_node AS split FROM sized), shut AS (SELECT DISTINCT u.id FROM up u JOIN flag f ON f.id = u.ancestor WHERE u.depth > 0 AND NOT f.split),
cut AS (SELECT id, NOT split AS whole, CASE WHEN split THEN own ELSE n END AS tokens FROM flag WHERE id NOT IN (SELECT id FROM shut))"""


@query(f"WITH RECURSIVE {_REF}, {_CUT} SELECT id, whole, tokens::INT AS tokens FROM cut WHERE tokens > 0")
def structural_cut(spark, base):
    tree = _tree(spark)
    return chunk.structural(frame(spark, "prov"), tree, hierarchy.subtree_tokens(tree, frame(spark, "prov")), 20)


@query(f"""WITH RECURSIVE {_REF}, {_CUT}, o AS (SELECT c.id, u.depth, left(trim(concat_ws(' ', p.label, p.text)), 160) AS opening FROM cut c JOIN up u ON u.id = c.id AND u.depth > 0 JOIN cut s ON s.id = u.ancestor AND NOT s.whole JOIN prov p ON p.id = u.ancestor WHERE c.tokens > 0 AND s.tokens > 0)
SELECT id, string_agg(opening, ' ' ORDER BY depth DESC) AS lead FROM o GROUP BY id""")
def chunk_leads(spark, base):
    tree, p = _tree(spark), frame(spark, "prov")
    return chunk.leads(p, tree, chunk.structural(p, tree, hierarchy.subtree_tokens(tree, p), 20))


@query(f"""WITH {ctes('trow')} SELECT row_id AS id, concat_ws(' | ', row_heading, array_to_string(list_transform(list_filter(map_entries(cells), lambda e: e.value IS NOT NULL AND e.value <> ''), lambda e: e.key || ': ' || e.value), '; ')) AS text, row_id || '; ' || table_id AS provisions FROM trow""")
def row_chunks(spark, base):
    return chunk.row_chunks(frame(spark, "trow")).select("id", "text", _joined("provisions"))


@query(f"WITH {ctes('tab')} SELECT table_id || ':note' || i AS id, notes[i] AS text FROM tab, range(1, 3) t(i)")
def note_chunks(spark, base):
    return chunk.note_chunks(frame(spark, "tab")).select("id", "text")


@query(values([("s393:tbl2", "Section 393, Table 2"), ("s393:tbl1", "Section 393, Table 1"), ("s5:tbl1", "Section 5, Table"), ("sch:III:tbl1", "Schedule III, Table"), ("sch:III:tbl3", "Schedule III, Table 3")], "table_id, name"))
def table_names(spark, base):
    rows = spark.createDataFrame([(x,) for x in ("s393:tbl2", "s393:tbl1", "s5:tbl1", "sch:III:tbl1", "sch:III:tbl3")], "table_id string")
    return rows.withColumn("name", chunk.table_name(F.col("table_id")))


@query(f"""WITH RECURSIVE {_REF}, up2 AS (SELECT u.id, u.depth, u.ancestor FROM up u JOIN prov p ON p.id = u.ancestor WHERE p.kind IN ('section', 'paragraph')) SELECT id, arg_min(ancestor, depth) AS enclosing FROM up2 GROUP BY id""")
def enclosing_sections(spark, base):
    return hierarchy.enclosing(_tree(spark), frame(spark, "prov"), ["section", "paragraph"])


@query(f"WITH RECURSIVE {_REF} SELECT u.ancestor, min(p.page_start) AS page_start, max(p.page_end) AS page_end FROM up u JOIN prov p ON p.id = u.id GROUP BY u.ancestor")
def page_spans(spark, base):
    return hierarchy.page_span(_tree(spark), frame(spark, "prov"))


@query(f"WITH {ctes('prov')}, t AS (SELECT parent AS id, ord FROM prov WHERE parent IS NOT NULL), n AS (SELECT id, ord, row_number() OVER (PARTITION BY id ORDER BY ord) AS n FROM t) SELECT ord, CASE WHEN n > 1 THEN id || '~' || n ELSE id END AS id FROM n")
def repeated_ids(spark, base):
    rows = frame(spark, "prov").where("parent is not null").select(F.col("parent").alias("id"), "ord")
    return hierarchy.suffix_duplicates(rows, "id", "ord")


# ---------------------------------------------------------------------- retrieval

_REFS = [(1, "s5(1)(b)", 1), (1, "s5(1)", 2), (1, "s5", 3), (1, "s2(1)", 4), (1, "s2", 5), (3, "s2", 1), (5, "s5", 1), (5, "sch:III:A", 2), (5, "sch:III", 3)]


def _asked_refs(spark: SparkSession) -> DataFrame:
    rows = frame(spark, "ask").select("qid", F.posexplode(T.expand_refs(F.col("text"))).alias("at", "ref"))
    return rows.select("qid", "ref", (F.col("at") + 1).alias("ref_rank"))


@query(values(_REFS, "qid, ref, ref_rank"))
def named_ids(spark, base):
    """The ids that questions name, each followed by those that enclose it."""
    return _asked_refs(spark)


_COVER = f"""{ctes('prov', 'chunk', 'ask')}, {_UP}, refs AS ({values(_REFS, 'qid, ref, ref_rank')}), cover AS (SELECT id AS chunk, unnest(provisions) AS pid FROM chunk),
dotted AS (SELECT a.qid, c.id, round(list_cosine_similarity(a.vector, c.vector), 9) AS score FROM ask a, chunk c)"""


def _cover(spark: SparkSession) -> DataFrame:
    return frame(spark, "chunk").select(F.col("id").alias("chunk"), F.explode("provisions").alias("pid"))


def _contained(spark: SparkSession) -> DataFrame:
    return retrieve.containers(_asked_refs(spark).select("ref").distinct(), _cover(spark), _pids(spark).select("pid", "ancestor"))


@query(f"""WITH RECURSIVE {_COVER}, below AS (SELECT DISTINCT r.ref, c.chunk FROM refs r JOIN up u ON u.ancestor = r.ref AND u.depth > 0 JOIN cover c ON c.pid = u.id),
boxed AS (SELECT DISTINCT ref FROM below b WHERE NOT EXISTS (SELECT 1 FROM cover c WHERE c.pid = b.ref AND c.chunk = b.chunk)),
hit AS (SELECT r.qid, c.chunk AS id, min(r.ref_rank) AS best, max((r.ref NOT IN (SELECT ref FROM boxed))::INT) AS fine FROM refs r JOIN cover c ON c.pid = r.ref GROUP BY ALL)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY best, k.tokens, hit.id)::INT AS rank, hit.id FROM hit JOIN chunk k ON k.id = hit.id WHERE fine = 1 AND k.tokens >= 60""")
def exact_id_hits(spark, base):
    return retrieve.by_ids(_asked_refs(spark), _cover(spark), frame(spark, "chunk").select("id", "tokens"), _contained(spark), 10)


@query(f"""WITH RECURSIVE {_COVER}, near AS (SELECT DISTINCT r.qid, c.chunk AS id FROM refs r JOIN up u ON u.ancestor = r.ref JOIN cover c ON c.pid = u.id)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank, id, round(score, 6) AS score FROM near JOIN dotted USING (qid, id)""")
def subtree_hits(spark, base):
    c = frame(spark, "chunk").select("id", "vector")
    out = retrieve.under_ids(_asked_refs(spark), _cover(spark), _pids(spark).select("pid", "ancestor"), frame(spark, "ask").select("qid", "vector"), c, 10)
    return out.withColumn("score", F.round("score", 6))


_LINES = """lines AS (SELECT unnest(list_distinct(linked_nodes)) AS pid, label, 'Endnote ' || label || ': ' || concat_ws(' ', header, prior_text) AS line FROM amend),
ordered AS (SELECT pid, list(line ORDER BY coalesce(TRY_CAST(label AS INT), 1073741824), label) AS lines FROM lines GROUP BY pid)"""


@query(f"""WITH {ctes('ask', 'chunk', 'amend')}, {_LINES}, d AS (SELECT a.qid, c.id, round(list_cosine_similarity(a.vector, c.vector), 9) AS score FROM ask a, chunk c), r AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank, id, score FROM d),
h AS (SELECT r.*, c.text, c.provisions FROM r JOIN chunk c USING (id) WHERE rank <= 3),
x AS (SELECT h.qid, h.id, i, unnest(range(1, len(o.lines) + 1)) AS j, o.lines FROM h, range(1, 6) t(i), ordered o WHERE o.pid = h.provisions[i]),
y AS (SELECT qid, id, lines[j] AS line, min(i * 100 + j) AS place FROM x GROUP BY ALL), z AS (SELECT qid, id, string_agg(line, chr(10) ORDER BY place) AS extra FROM y GROUP BY ALL)
SELECT qid, rank, id, round_even(score, 4) AS score, concat_ws(chr(10), text, extra) AS text, len(list_filter(regexp_split_to_array(concat_ws(chr(10), text, extra), '\\s+'), lambda w: w <> ''))::INT AS tokens FROM h LEFT JOIN z USING (qid, id)""")
def retrieve_with_endnotes(spark, base):
    p = frame(spark, "prov")
    lines = amend.endnotes(frame(spark, "amend").drop("linked_nodes").withColumn("target_desc", F.lit(None).cast("string")), _links(spark), p, "raw")
    out = retrieve.retrieve("dense", frame(spark, "ask").select("qid", "vector"), frame(spark, "chunk"), 3, {}, {}, lines)
    return out.select("qid", "rank", "id", "score", "text", "tokens")


@query(f"WITH {ctes('ask', 'chunk')}, d AS (SELECT a.qid, c.tokens, row_number() OVER (PARTITION BY a.qid ORDER BY round(list_cosine_similarity(a.vector, c.vector), 9) DESC, c.id) AS rank FROM ask a, chunk c) SELECT qid, sum(tokens)::BIGINT AS tokens, sum(tokens) <= 220 AS fits FROM d WHERE rank <= 3 GROUP BY qid")
def budget_verdicts(spark, base):
    hits = retrieve.knn(frame(spark, "ask").select("qid", "vector"), frame(spark, "chunk").select("id", "vector"), 3).join(frame(spark, "chunk").select("id", "tokens"), "id")
    return retrieve.fits(hits, 220)


_DEFINED = [("accountant", "s2(1)"), ("late levy", "s2(2)"), ("levy", "s2(3)")]


@query(values(_DEFINED, "term, pid"))
def defined_terms(spark, base):
    return answers.definitions(frame(spark, "prov")).select("term", "pid")


@query(values([(2, "levy", "s2(3)"), (3, "late levy", "s2(2)")], "qid, term, pid"))
def found_definitions(spark, base):
    """Quoted terms, else the longest defined term that a question holds as whole words."""
    return answers.find_definitions(frame(spark, "ask").where("qid in (1, 2, 3, 6)"), answers.definitions(frame(spark, "prov"))).select("qid", "term", "pid")


@query(f"""WITH {ctes('ask', 'chunk')}, b AS (SELECT a.qid, row_number() OVER (PARTITION BY a.qid ORDER BY round(list_cosine_similarity(a.vector, c.vector), 9) DESC, c.id) AS rank, c.id FROM ask a, chunk c),
f(qid, rank, id) AS (VALUES (2, 1, 'c:s2'), (2, 2, 'c:sch'), (3, 1, 'c:row1')), u AS (SELECT qid, 0 AS band, rank, id FROM f UNION ALL SELECT qid, 1, rank, id FROM b WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.qid = b.qid AND f.id = b.id))
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY band, rank, id)::INT AS rank, id FROM u QUALIFY rank <= 4""".replace("QUALIFY rank <= 4", "QUALIFY row_number() OVER (PARTITION BY qid ORDER BY band, rank, id) <= 4"))
def definitions_in_front(spark, base):
    front = spark.createDataFrame([(2, 1, "c:s2"), (2, 2, "c:sch"), (3, 1, "c:row1")], "qid int, rank int, id string")
    every = retrieve.knn(frame(spark, "ask").select("qid", "vector"), frame(spark, "chunk").select("id", "vector"), 10)
    return rank.front_merge(every.select("qid", "rank", "id"), front, 4).select("qid", "rank", "id")


_WORDS = [("1@40", None, "a levy of 2% of Rs. 50,000;"), ("2@41", "the owner", "the holder"), ("11@44", None, None)]


@query(values(_WORDS, "key, old, new"))
def changed_words(spark, base):
    """What a note quotes as the old words, and what stands in the bracket that it marks."""
    rows = _links(spark).dropDuplicates(["key"]).join(frame(spark, "amend"), "key").join(frame(spark, "prov").select(F.col("id").alias("provision_id"), "text_marked"), "provision_id")
    rows = frame(spark, "amend").where("size(linked_nodes) > 0").withColumn("id", F.element_at("linked_nodes", 1)).join(frame(spark, "prov").select("id", "text_marked"), "id")
    return rows.select("key", amend.changed_words(F.col("label"), F.col("header"), F.col("type"), F.col("text_marked")).alias("w")).select("key", "w.*")


_EXPLICIT = [
    ("s5(1)(a)", 'Endnote 1 [applies to section 5(1)(a); amendment type: inserted; by Act No. 4 of 2026; with effect from 1-4-2026; inserted (not in the Act before): "a levy of 2% of Rs. 50,000;"]: Ins. by Act No. 4 of 2026, w.e.f. 1-4-2026.'),
    ("s5(1)(b)", 'Endnote 2 [applies to section 5(1)(b); amendment type: substituted; by Act No. 4 of 2026; with effect from 1-4-2026; wording before: "the owner"; wording now: "the holder"]: Sub. for "the owner" by Act No. 4 of 2026, w.e.f. 1-4-2026.'),
    ("s5", "Endnote 11 [applies to section 5; amendment type: omitted; by Act No. 4 of 2026]: Clause (c) omitted by Act No. 4 of 2026. Prior to its omission, clause (c) read as under: (c) a fee of the clerk."),
    ("s5(1)", "Endnote 11 [applies to section 5(1); amendment type: omitted; by Act No. 4 of 2026]: Clause (c) omitted by Act No. 4 of 2026. Prior to its omission, clause (c) read as under: (c) a fee of the clerk."),
]


@query(values(_EXPLICIT, "provision_id, line"))
def endnotes_explicit(spark, base):
    lines = amend.endnotes(frame(spark, "amend").drop("linked_nodes"), _links(spark), frame(spark, "prov"), "explicit")
    return lines.select("provision_id", F.explode("lines").alias("line"))


_BEFORE = [
    (1, "under sub-section (1)(a)(i) or (b), only"), (2, None), (3, ""), (4, "the old whole"), (5, "a c"),
]
_MARKED = [
    (1, "under {{fn:11}}[sub-section (1)(a)(ii) or (b)], only", [("11", "substituted", None, 'Sub. for "sub-section (1)(a)(i) or (b)" by Act No. 4 of 2026')]),
    (2, "x {{fn:2}}[new] y", [("2", "substituted", None, "Sub. by Act")]), (3, "{{fn:2}}[all of it is new]", [("2", "inserted", None, "Ins. by Act")]),
    (4, "a {{fn:3}}[b] c", [("3", "omitted", "the old whole", "Omtt.")]), (5, "a {{fn:4}}[b] c", [("4", "inserted", None, "Ins.")]),
]


@query(values(_BEFORE, "n, before"))
def wording_before(spark, base):
    rows = spark.createDataFrame(_MARKED, "n int, m string, notes array<struct<label:string,type:string,prior_text:string,header:string>>")
    return rows.select("n", amend.before(F.col("m"), F.col("notes")).alias("before"))


_SEGMENTS = [
    (1, 0, "under ", None, None, "under "), (1, 1, "sub-section (1)(a)(ii) or (b)", "11", "substituted", "sub-section (1)(a)(i) or (b)"), (1, 2, ", only", None, None, ", only"), (2, 0, "x ", None, None, "x "), (2, 1, "new", "2", "substituted", None), (2, 2, " y", None, None, " y"),
    (3, 0, "all of it is new", "2", "inserted", ""), (4, 0, "a ", None, None, "a "), (4, 1, "b", "3", "omitted", None), (4, 2, " c", None, None, " c"), (5, 0, "a ", None, None, "a "), (5, 1, "b", "4", "inserted", ""), (5, 2, " c", None, None, " c"),
]


@query(values(_SEGMENTS, "n, at_, words, label, type, was"))
def marked_segments(spark, base):
    rows = spark.createDataFrame(_MARKED, "n int, m string, notes array<struct<label:string,type:string,prior_text:string,header:string>>")
    return rows.select("n", F.posexplode(amend.segments(F.col("m"), F.col("notes"))).alias("at_", "s")).select("n", "at_", "s.words", "s.label", "s.type", "s.was")


@query(f"WITH RECURSIVE {_REF} SELECT DISTINCT u.ancestor AS scope, t.table_id FROM trow t JOIN up u ON u.id = t.table_id")
def tables_below(spark, base):
    return structure.tables_under(frame(spark, "trow").select("table_id"), _pids(spark)).select("scope", "table_id")


# ---------------------------------------------------------------------- look-ups


@query(f"""WITH {ctes('prov', 'trow')}, c AS (SELECT parent AS id, string_agg(id, '; ' ORDER BY ord) AS children FROM prov GROUP BY parent), r AS (SELECT table_id AS id, string_agg(row_id, '; ' ORDER BY coalesce(TRY_CAST(sl_no AS INT), 1073741824), sl_no, row_id) AS "rows" FROM trow GROUP BY table_id)
SELECT p.id, p.number, coalesce(children, '') AS children, coalesce("rows", '') AS "rows" FROM prov p LEFT JOIN c USING (id) LEFT JOIN r USING (id) WHERE p.id IN ('s5', 's5(1)', 's5:tbl1', 's2(1)')""")
def node_lookup(spark, base):
    ids = spark.createDataFrame([("s5",), ("s5(1)",), ("s5:tbl1",), ("s2(1)",), ("none",)], "id string")
    out = lookups.node(ids, frame(spark, "prov"), frame(spark, "trow"))
    name = lambda c, f: F.coalesce(F.array_join(F.transform(c, lambda x: x[f]), "; "), F.lit(""))
    return out.select("id", "number", name("children", "child").alias("children"), name("rows", "row_id").alias("rows"))


@query(f"WITH RECURSIVE {_REF}, r AS (SELECT u.ancestor AS root, u.id, u.depth, row_number() OVER (PARTITION BY u.ancestor ORDER BY p.ord) AS n FROM up u JOIN prov p ON p.id = u.id WHERE u.ancestor IN ('s5', 'sch:III')) SELECT root, id, depth FROM r WHERE n <= 4")
def subtree_lookup(spark, base):
    roots = spark.createDataFrame([("s5",), ("sch:III",)], "root string")
    return hierarchy.subtree(_tree(spark), roots, frame(spark, "prov").select("id", "ord"), 4).select("root", "id", "depth")


@query(f"WITH {ctes('trow')} SELECT row_id, row_number() OVER (ORDER BY TRY_CAST(sl_no AS INT), row_id)::INT AS n FROM trow")
def table_row_order(spark, base):
    rows = lookups.table_rows(frame(spark, "trow"), "s5:tbl1").select("row_id").withColumn("at", F.monotonically_increasing_id())
    return rows.select("row_id", (F.rank().over(Window.orderBy("at"))).alias("n"))  # one table's rows


@query(f"""WITH RECURSIVE {ctes('prov', 'amend')}, {_UP}, l AS (SELECT DISTINCT key, unnest(linked_nodes) AS id FROM amend) SELECT u.ancestor AS root, l.key, l.id AS provision_id FROM l JOIN up u USING (id) WHERE u.ancestor IN ('s5(1)', 'ch:II')""")
def amendments_below(spark, base):
    roots = spark.createDataFrame([("s5(1)",), ("ch:II",)], "root string")
    out = lookups.amendments_under(roots, _pids(spark).select("pid", "ancestor"), _links(spark), frame(spark, "amend"))
    return out.select("root", "key", "provision_id")


@query(f"WITH {ctes('prov')} SELECT id, CASE WHEN schedule IS NOT NULL THEN number WHEN kind IN ('section', 'clause') THEN 'section ' || number ELSE number END AS cite FROM prov")
def citations(spark, base):
    return frame(spark, "prov").select("id", lookups.citation(F.col("kind"), F.col("number"), F.col("schedule")).alias("cite"))


@query(values([("v2:s2(5)", "v2:s2(5)"), ("s2(5)@2", "s. 2(5)"), ("s7~2", "s. 7"), ("sch:XI:A:4", "Sch. XI:A:4"), ("x", "x")], "id, cite"))
def short_citations(spark, base):
    rows = spark.createDataFrame([(x,) for x in ("v2:s2(5)", "s2(5)@2", "s7~2", "sch:XI:A:4", "x")], "id string")
    return rows.select("id", lookups.short_citation(F.col("id")).alias("cite"))


# ---------------------------------------------------------------------- questions and answers

_SCREENED = [
    (1, True, "in it", "table", "rate of levy under; rate of levy"), (2, False, "forms: asks for a form", "general", ""), (3, True, "", "general", ""), (4, False, "current_facts", "general", ""), (5, True, "", "amendment", ""),
    (6, False, "other_law", "general", ""), (7, True, "screen failed", "general", ""), (8, True, "reply was not JSON", "general", ""), (9, True, "", "general", ""),
]


@query(values(_SCREENED, "qid, in_scope, scope_reason, kind, rewrites"))
def screened_questions(spark, base):
    return agent.understand(frame(spark, "screen")).select("qid", "in_scope", "scope_reason", "kind", _joined("rewrites"))


@query(values([(q, q != 9, {7: "screen failed", 8: "reply was not JSON", 1: "in it", 2: "asks for a form"}.get(q, "")) for q in range(1, 10)], "qid, in_scope, scope_reason"))
def scope_check(spark, base):
    return agent.scope(frame(spark, "screen")).select("qid", "in_scope", "scope_reason")


_ROUTED = [(1, "table", "", ""), (2, "general", "", ""), (3, "general", "", ""), (4, "general", "", ""), (5, "amendment", "", ""), (6, "general", "", ""), (7, "general", "", ""), (8, "general", "", ""), (9, "general", "", "")]


@query(values([(1, "table", ""), (2, "definition", "s2(3)"), (3, "definition", "s2(2)"), (4, "table", ""), (5, "amendment", ""), (6, "amendment", ""), (7, "table", ""), (8, "definition", "s2(1)")], "qid, route, definitions"))
def routed_questions(spark, base):
    rows = [(1, "What is the rate?", "general", []), (2, 'What is the meaning of "levy"?', "general", ["a table rate"]), (3, "define late levy", "general", []), (4, "What do I pay?", "general", ["tax collected at source"]), (5, "How was section 5 amended?", "general", []), (6, "Did the rate change?", "amendment", []), (7, "What do I pay?", "table", []), (8, "Who is such a person?", "definition", ["meaning of accountant"])]
    asked = spark.createDataFrame(rows, "qid int, question string, kind string, rewrites array<string>")
    return agent.classify(asked, answers.definitions(frame(spark, "prov"))).select("qid", "route", _joined("definitions"))


@query(values([(1, "answered 1", False, "table"), (2, "Refused: forms: asks for a form", True, "general"), (3, "answered 1", False, "general"), (4, "Refused: current_facts", True, "general"), (5, "answered 1", False, "amendment"), (6, "Refused: other_law", True, "general"), (7, "Nothing was retrieved for that question.", True, "general"), (8, "answered 1", False, "general"), (9, "answered 1", False, "general")], "qid, answer, refused, route"))
def staged_answers(spark, base):
    """Screen, classify, retrieve, pack, answer: refused questions and those without hits take their own ways."""
    hit = lambda q: q.where("qid <> 7").select("qid", F.lit(1).alias("rank"), F.lit("c:s5").alias("id"), F.lit(5).alias("tokens"))

    def answer(asked: DataFrame, evidence: DataFrame) -> DataFrame:
        n = evidence.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
        return asked.join(n, "qid").select("qid", F.concat(F.lit("answered "), F.col("n").cast("string")).alias("answer"), F.lit(False).alias("refused"), F.array(F.lit("c:s5")).alias("cited"))

    out, _ = agent.run(frame(spark, "screen"), answers.definitions(frame(spark, "prov")), hit, lambda q: hit(q.where("false")), answer, 100, 5)
    return out.select("qid", "answer", "refused", "route")


@query(values([("a", 1, True, ""), ("b", 2, True, ""), ("c", 2, False, "two"), ("d", 1, None, ""), ("e", 1, None, "")], "qid, attempts, verified, unsupported"))
def verified_answers(spark, base):
    """A claim without support sends an answer back once; a failed check and a refusal leave it as it is."""
    rows = spark.createDataFrame([("a", "one", False), ("b", "two", False), ("c", "two!", False), ("d", "broken", False), ("e", "", True)], "qid string, answer string, refused boolean")

    def check(df: DataFrame) -> DataFrame:
        bad = F.col("answer").startswith("two")
        claims = F.array(F.struct(F.lit(" two ").alias("claim"), F.when(bad, F.array().cast("array<int>")).otherwise(F.array(F.lit(1))).alias("support")))
        return df.withColumn("claims", F.when(F.col("answer") != "broken", claims))

    out = agent.checked(rows, check, lambda df: df.withColumn("answer", F.when(F.col("qid") == "b", "one").otherwise(F.col("answer"))))
    return out.select("qid", "attempts", "verified", _joined("unsupported"))


@query(values([("r1", k, t, d) for k, (t, d) in enumerate([("", False), ("A ", False), ('"levy" of ', False), ("₹5\n".replace("₹5", "₹5"), False), ("due", True), ("", True)])] + [("r2", 0, "", True), ("r3", 0, "", False)], "reply, seq, text, done").replace("₹5\n", "₹5\n"))
def decoded_pieces(spark, base):
    """The text of one field of a JSON reply, as far as each piece completes it."""
    return decode.decode_batch(frame(spark, "piece"))


_CITED = [(1, "p1; p2"), (2, "p3"), (3, ""), (4, "p2; p1")]


@query(values(_CITED, "n, passages"))
def cited_passages(spark, base):
    rows = spark.createDataFrame([(1, ["[C1]"], "so [ C 2 ] and [C1]"), (2, ["C3", "C9", "x"], None), (3, None, ""), (4, ["2"], "see [C1]")], "n int, labels array<string>, answer string")
    found = answers.cited(F.col("labels"), F.col("answer"), F.array(F.lit("p1"), F.lit("p2"), F.lit("p3")), True)
    return rows.select("n", F.array_join(found, "; ").alias("passages"))


_TIDY = [(1, "Body\n### Key terms\n- **Levy** is one", "Why?; When?"), (2, "# Only", ""), (3, "plain", ""), (4, "", "a")]


@query(values(_TIDY, "n, answer, follow_ups"))
def tidied_answers(spark, base):
    rows = spark.createDataFrame([(1, "Body\n### Key terms\n- **Levy** is one\n- **Ghost** is none\n### Follow-ups\n1. Why?\n- When?\nno item\n"), (2, "# Only\n## Key Terms\n- **Ghost** none\n"), (3, "plain"), (4, "## Ask next\n* a\n")], "n int, a string")
    out = rows.select("n", answers.tidy(F.col("a"), F.array(F.lit("First; then “levy” means a charge."))).alias("t"))
    return out.select("n", "t.answer", F.array_join("t.follow_ups", "; ").alias("follow_ups"))


_MUTATED = [(1, "Under section 12 in 2026 pay 91% of it"), (2, None), (3, "clause 4 and Sl. No. 3 of 1961, then 601 days"), (4, "pay 60,001 now".replace("60,001", "60001")), (5, None)]


@query(values(_MUTATED, "n, changed"))
def mutated_answers(spark, base):
    rows = spark.createDataFrame([(1, "Under section 12 in 2026 pay 30% of it"), (2, "nothing here"), (3, "clause 4 and Sl. No. 3 of 1961, then 200 days"), (4, "pay 20,000 now"), (5, "173(c), C2 and 4(3)")], "n int, a string")
    return rows.select("n", answers.mutate(F.col("a")).alias("changed"))


@query(f"""WITH {ctes('cit')} SELECT id, string_agg('[C' || n || '] (pp. ' || n || '-' || (n + 1) || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY n) AS block FROM cit GROUP BY id""")
def evidence_blocks(spark, base):
    rows = frame(spark, "cit").select(F.col("id").alias("qid"), F.col("n").alias("rank"), "text", F.col("n").alias("page_start"), (F.col("n") + 1).alias("page_end"))
    return answers.evidence_block(rows).withColumnRenamed("qid", "id")


@query(f"""WITH {ctes('cit')}, p AS (SELECT id, n * 100 + i AS place, provisions[i] AS p FROM cit, range(1, 4) t(i) WHERE i <= len(provisions)), d AS (SELECT id, p, min(place) AS place FROM p GROUP BY ALL) SELECT id, string_agg(p, '; ' ORDER BY place) AS provisions FROM d GROUP BY id""")
def provisions_of_answers(spark, base):
    rows = frame(spark, "cit").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "provisions"))).alias("c"))
    return rows.select("id", F.array_join(agent.cited_provisions(F.col("c")), "; ").alias("provisions"))


@query(values([("amendment", "What changed"), ("table", "Rates and limits"), ("definition", "What it includes and excludes"), ("general", "Conditions and exceptions"), ("odd", "Conditions and exceptions")], "route, block"))
def prompt_blocks(spark, base):
    rows = spark.createDataFrame([(x,) for x in ("amendment", "table", "definition", "general", "odd")], "route string")
    return rows.withColumn("block", agent.prompt_parts("explained", F.col("route")))


@query(f"WITH {ctes('ans')} SELECT id, to_json({{'question': id, 'version': 'v1', 'answer': answer, 'refused': refused, 'citations': []}}) AS payload FROM ans WHERE answer IS NOT NULL")
def answer_payloads(spark, base):
    rows = frame(spark, "ans").where("answer is not null").select(F.col("id").alias("qid"), F.col("id").alias("question"), "answer", "refused", F.array().cast("array<string>").alias("cited"), F.lit(None).cast("string").alias("error"))
    passages = frame(spark, "cit").select(F.col("id").alias("qid"), F.col("n").cast("string").alias("id"), "provisions", F.lit(1).alias("page_start"), F.lit(1).alias("page_end"))
    return agent.payload(rows, passages, "v1").select(F.col("qid").alias("id"), "payload")


# ---------------------------------------------------------------------- evaluation

_NORMAL = [(1, "rs5000000 is due"), (2, "rs5000000"), (3, "rs5000000"), (4, "rs15000000 and rs200000"), (5, "rs20000"), (6, "rs20000"), (7, "2% or 2%"), (8, "mixed case it s fine".replace("it s", "its")), (9, "")]


@query(values(_NORMAL, "n, form"))
def normal_forms(spark, base):
    texts = ["Rs. 50,00,000 is due", "₹50 lakh", "Fifty lakh rupees", "1.5 crore rupees and 2 lakhs", "Rs.20,000.00.", "20,000 rupees", "2 per cent or 2 %", "Mixed—CASE (it’s) fine".replace("(", "").replace(")", ""), ""]
    rows = spark.createDataFrame(list(enumerate(texts, 1)), "n int, t string")
    return rows.select("n", T.normal_form(F.col("t")).alias("form"))


_FACTS = [(1, True), (2, True), (3, False), (4, True), (5, False), (6, True), (7, False)]


@query(values(_FACTS, "n, matches"))
def fact_matches(spark, base):
    rows = [(1, "pay ₹50 lakh at once", "Fifty lakh rupees"), (2, "the levy is due within thirty days of the notice", "levy due within thirty days from notice"), (3, "the levy is due within sixty days of the notice", "levy due within thirty days from notice"), (4, "it was replaced", "substituted"), (5, "it was added", "omitted"), (6, "about 12% of it", "2%"), (7, "", "2%")]
    return spark.createDataFrame(rows, "n int, a string, f string").select("n", T.fact_match(F.col("a"), F.col("f")).alias("matches"))


@query(f"""WITH {ctes('q')} SELECT id, array_to_string(CASE WHEN type = 'multi_hop' THEN list_concat(gold_provisions, gold_table_rows) WHEN len(gold_table_rows) > 0 THEN gold_table_rows ELSE gold_provisions END, '; ') AS targets FROM q""")
def gold_ids(spark, base):
    return frame(spark, "q").select("id", F.array_join(scoring.gold_targets(F.col("type"), F.col("gold_provisions"), F.col("gold_table_rows")), "; ").alias("targets"))


def _asked(spark: SparkSession) -> DataFrame:
    gold = F.when(F.col("am_type").isNotNull(), F.struct(F.col("am_type").alias("type"), F.col("am_prior").alias("prior_text"), F.lit(None).cast("string").alias("effective_date"), F.col("am_note").alias("footnote")))
    return frame(spark, "q").withColumn("gold_amendment", gold)


def _records(spark: SparkSession) -> DataFrame:
    cited = frame(spark, "cit").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "provisions", "text"))), lambda c: F.struct(c["provisions"].alias("provisions"), c["text"].alias("text"))).alias("cited"))
    return _asked(spark).join(frame(spark, "ans"), "id").join(cited, "id", "left")


def _pairs(spark: SparkSession) -> DataFrame:
    return scoring.substitution_pairs(_asked(spark), frame(spark, "amend"), frame(spark, "prov"))


@query(values([("q3", "the owner", "the holder")], "id, old, new"))
def substitution_pairs(spark, base):
    return _pairs(spark)


_DIRECTIONS = [(1, 1.0), (2, 0.0), (3, None), (4, 1.0), (5, 1.0), (6, None), (7, None), (8, 1.0)]


@query(values(_DIRECTIONS, "n, direction"))
def amendment_directions(spark, base):
    rows = [
        (1, 'changed from "60%" to "30%"', "60%", "30%"), (2, 'changed from "30%" to "60%"', "60%", "30%"), (3, "only 30% is named", "60%", "30%"), (4, "30% in place of 60%", "60%", "30%"), (5, "the owner was replaced by the holder", "the owner", "the holder"),
        (6, "60% and 30%", "60%", "30%"), (7, "60%" + " long" * 30 + " to 30%", "60%", "30%"), (8, "clause (a) or (b) became clause (a)", "clause (a) or (b)", "clause (a)"),
    ]
    return spark.createDataFrame(rows, "n int, a string, o string, w string").select("n", scoring.direction(F.col("a"), F.col("o"), F.col("w")).alias("direction"))


#: id, fact_recall, all_facts, exact forms of both, citation precision and recall, grounded numbers, table_exact, amendment type, prior F1, direction.
_SCORES = [
    ("q1", 1.0, 1.0, 1.0, 1.0, 0.5, 1.0, 1.0, None, None, None, None), ("q2", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, None, None, None), ("q3", 1.0, 1.0, 0.5, 0.0, 1.0, 1.0, None, None, 1.0, None, 1.0),
    ("q4", None, None, None, None, None, None, None, None, None, None, None), ("q5", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, None, None, None, None, None), ("q6", 0.5, 0.0, 0.5, 0.0, 0.0, 0.0, None, None, 0.0, 0.7059, None),
]
_SCORE_NAMES = "id, fact_recall, all_facts, fact_recall_exact, all_facts_exact, citation_precision, citation_recall, grounded_numbers, table_exact, amendment_type, prior_text_f1, amendment_direction"


def _scores(spark: SparkSession) -> DataFrame:
    return scoring.answer_metrics(_records(spark), _tree(spark).select("id", "ancestor"), _pairs(spark))


@query(values(_SCORES, _SCORE_NAMES))
def answer_scores(spark, base):
    return _scores(spark).drop("type", "refused", "should_refuse").withColumn("prior_text_f1", F.round("prior_text_f1", 4))


@query(f"""WITH {ctes('q', 'ans')}, s AS ({values(_SCORES, _SCORE_NAMES)}), r AS (SELECT s.*, q.type, a.refused, q.should_refuse, a.latency_s, a.llm_tokens, a.evidence_tokens FROM s JOIN q USING (id) JOIN ans a USING (id)),
m AS (SELECT type, unnest(['fact_recall', 'citation_precision', 'citation_recall', 'amendment_type']) AS metric, unnest([fact_recall, citation_precision, citation_recall, amendment_type])::DOUBLE AS v FROM r)
SELECT type, metric, round_even(avg(v), 4) AS value FROM m WHERE v IS NOT NULL GROUP BY type, metric UNION ALL SELECT NULL, metric, round_even(avg(v), 4) FROM m WHERE v IS NOT NULL GROUP BY metric
UNION ALL SELECT type, 'n', count(*) FROM r GROUP BY type UNION ALL SELECT NULL, 'n', count(*) FROM r
UNION ALL SELECT NULL, 'refusal_precision', round_even(count(*) FILTER (refused AND should_refuse) / count(*) FILTER (refused), 4) FROM r UNION ALL SELECT NULL, 'refusal_recall', round_even(count(*) FILTER (refused AND should_refuse) / count(*) FILTER (should_refuse), 4) FROM r
UNION ALL SELECT NULL, 'llm_tokens_mean', round_even(avg(llm_tokens), 1) FROM r UNION ALL SELECT NULL, 'evidence_tokens_mean', round_even(avg(evidence_tokens), 1) FROM r
UNION ALL SELECT NULL, 'latency_p50_s', list_sort(list(latency_s))[1 + round_even(0.5 * (count(*) - 1), 0)::INT] FROM r UNION ALL SELECT NULL, 'latency_p95_s', list_sort(list(latency_s))[1 + round_even(0.95 * (count(*) - 1), 0)::INT] FROM r""")
def evaluation_summary(spark, base):
    kept = _scores(spark).select("id", "type", "refused", "should_refuse", "fact_recall", "citation_precision", "citation_recall", "amendment_type")
    return scoring.aggregate(kept, frame(spark, "ans"))


@query(f"WITH {ctes('q')} SELECT 'type' AS filter, id FROM q WHERE type = 'amendment' UNION ALL SELECT 'style', id FROM q WHERE style = 'situation' UNION ALL SELECT 'person', id FROM q WHERE person = 'first' UNION ALL SELECT 'pair', 'q3'")
def question_filters(spark, base):
    q, parts = _asked(spark), None
    for name, wanted in (("type", "amendment"), ("style", "situation"), ("person", "first"), ("pair", "substitution")):
        part = questions.keep(q, wanted, _pairs(spark)).select(F.lit(name).alias("filter"), "id")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def _all_texts(spark: SparkSession) -> DataFrame:
    below = hierarchy.subtree_text(_tree(spark), frame(spark, "prov"))
    return questions.cite_texts(frame(spark, "prov"), below, frame(spark, "trow"))


_CELLS = "array_to_string(list_transform(list_filter(map_entries(cells), lambda e: e.value <> ''), lambda e: e.key || ': ' || e.value), '; ')"


@query(f"""WITH RECURSIVE {ctes('prov', 'trow', 'amend', 'q')}, {_UP}, {_SUB}, cited AS (SELECT p.id, CASE WHEN p.schedule IS NOT NULL THEN p.number WHEN p.kind IN ('section', 'clause') THEN 'section ' || p.number ELSE p.number END AS cite, sub.text FROM prov p JOIN sub USING (id)
UNION ALL SELECT t.row_id, p.number || ', Table Sl. No. ' || t.sl_label, {_CELLS} FROM trow t JOIN prov p ON p.id = t.table_id),
notes AS (SELECT u.ancestor AS id, string_agg(chr(10) || 'Endnote ' || a.label || ': ' || concat_ws(' ', a.header, a.prior_text), '' ORDER BY a.line_index) AS added FROM (SELECT DISTINCT u.ancestor, a.key FROM amend a, up u WHERE list_contains(a.linked_nodes, u.id)) u JOIN amend a USING (key) GROUP BY u.ancestor),
g AS (SELECT q.id AS qid, i AS place, (CASE WHEN type = 'multi_hop' THEN list_concat(gold_provisions, gold_table_rows) WHEN len(gold_table_rows) > 0 THEN gold_table_rows ELSE gold_provisions END)[i] AS gid FROM q, range(1, 4) t(i)),
w AS (SELECT qid, place, gid, list_filter(regexp_split_to_array(cite || ': ' || text || coalesce(added, ''), '\\s+'), lambda x: x <> '') AS words FROM g JOIN cited ON cited.id = gid LEFT JOIN notes ON notes.id = gid),
b AS (SELECT *, coalesce(sum(len(words)) OVER (PARTITION BY qid ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w)
SELECT qid, place::INT AS rank, 'oracle:' || gid AS id, least(len(words), 40 - before)::INT AS tokens, md5(array_to_string(words[1:(40 - before)::INT], ' ')) AS digest FROM b WHERE before < 40""")
def oracle_evidence(spark, base):
    tree = _tree(spark)
    links = frame(spark, "amend").select("key", "line_index", F.explode(F.array_distinct("linked_nodes")).alias("id"), F.concat(F.lit("Endnote "), "label", F.lit(": "), F.concat_ws(" ", "header", "prior_text")).alias("note"))
    notes = links.join(tree, "id").select(F.col("ancestor").alias("id"), F.col("line_index").alias("ord"), "note", "key").dropDuplicates(["id", "key"])
    out = questions.oracle_evidence(_asked(spark), _all_texts(spark), notes, 40)
    return out.select("qid", "rank", "id", "tokens", F.md5(F.col("text").cast("binary")).alias("digest"))


_LINT = [
    ("l1", ""), ("l2", "names a provision: s5; quotes a term: levy; copies the gold text: 'costs accountant holder clause them'; unknown gold id s99; fact not in gold text: 17%"),
    ("l3", "a refusal has no gold, an answerable question has some"),
]


def _checked(spark: SparkSession) -> DataFrame:
    q = _asked(spark).where("id like 'l%'")
    texts = _all_texts(spark).select("id", "text")
    known = frame(spark, "prov").select("id").unionByName(frame(spark, "trow").select(F.col("row_id").alias("id")))
    return questions.row_checks(q, known, questions.gold_texts(q, texts, frame(spark, "amend")))


@query(values(_LINT, "id, problems"))
def question_checks(spark, base):
    return _checked(spark).select("id", F.array_join("problems", "; ").alias("problems"))


@query(values([("rows", "all", 3), ("rows", "failed", 2), ("type", "lookup", 1), ("type", "refusal", 1), ("reason", "names a provision", 1), ("reason", "quotes a term", 1), ("reason", "copies the gold text", 1), ("reason", "unknown gold id s99", 1), ("reason", "fact not in gold text", 1), ("reason", "a refusal has no gold, an answerable question has some", 1)], "counted, name, n"))
def lint_report(spark, base):
    return questions.lint_report(_checked(spark))


_DRAFTS = [("s2(1)", "a person whom section 5(1)(b) names", "accountant"), ("s2(2)", "a levy that is paid after thirty", "late levy"), ("s2(3)", "a charge that Schedule III lays upon", "levy")]


@query("SELECT 'lookup-' || substr(sha1(pid), 1, 8) AS id, fact, 'What is \"' || term || '\"?' AS question FROM (" + values(_DRAFTS, "pid, fact, term") + ")")
def definition_drafts(spark, base):
    below = hierarchy.subtree_text(_tree(spark), frame(spark, "prov"))
    out = questions.definition_drafts(frame(spark, "prov"), below, "s2", ['What is "{term}"?'])
    return out.select("id", F.element_at("gold_facts", 1).alias("fact"), "question")


@query("SELECT 'table-' || substr(sha1(r), 1, 8) AS id, q AS question, f AS facts FROM (" + values([("s5:tbl1#1(i)", "What is due on rent of land?", "10%; Rs. 5,00,000"), ("s5:tbl1#1(ii)", "What is due on rent of plant?", "2%; nil"), ("s5:tbl1#2", "What is due on commission?", "Rates in force")], "r, q, f") + ")")
def table_drafts(spark, base):
    templates = spark.createDataFrame([("s5:tbl1", "What is due on {what}?", "a table")], "table_id string, question string, note string")
    return questions.table_drafts(frame(spark, "trow"), templates).select("id", "question", F.array_join("gold_facts", "; ").alias("facts"))


@query("SELECT 'amendment-' || substr(sha1(k), 1, 8) AS id, q AS question, f AS facts FROM (" + values([("1@40", "How was section 5(1)(a) amended by the Act?", "inserted"), ("2@41", "How was section 5(1)(b) amended by the Act?", "substituted; the owner"), ("11@44", "What change did the Act make to section 5(1), and what did the provision say before the amendment?", "omitted; a fee of the clerk.")], "k, q, f") + ")")
def amendment_drafts(spark, base):
    return questions.amendment_drafts(frame(spark, "amend"), frame(spark, "prov"), "the Act").select("id", "question", F.array_join("gold_facts", "; ").alias("facts"))


@query("SELECT 'refusal-' || substr(sha1(q), 1, 8) AS id, q AS question, true AS should_refuse FROM (VALUES ('Which form?'), ('Will I win?')) v(q)")
def refusal_drafts(spark, base):
    return questions.refusal_drafts(spark.createDataFrame([("Which form?",), ("Will I win?",)], "question string")).select("id", "question", "should_refuse")


@query(values([("a", "b"), ("c", "d"), ("e", "f")], "src, dst"))
def used_once_pairs(spark, base):
    pairs = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("c", "d", 3), ("d", "e", 4), ("e", "f", 5), ("f", "a", 6)], "src string, dst string, rank long")
    return questions.used_once(pairs).select("src", "dst")


@query(f"""WITH RECURSIVE {_REF}, {_SUB}, e(src, dst) AS (VALUES ('s2(1)', 's5(1)(b)'), ('s5(2)', 's2(3)'), ('s5(3)', 's5'), ('s5(3)', 's2')) SELECT src, dst FROM e JOIN sub a ON a.id = src JOIN sub b ON b.id = dst JOIN prov p ON p.id = dst
WHERE regexp_extract(src, '^(s[0-9]+)', 1) <> regexp_extract(dst, '^(s[0-9]+)', 1) AND length(a.text) > 20 AND length(b.text) > 20 AND p.kind NOT IN ('section', 'paragraph')""")
def hop_pairs(spark, base):
    edges = spark.createDataFrame([("s2(1)", "s5(1)(b)", "exact"), ("s5(2)", "s2(3)", "exact"), ("s5(3)", "s5", "exact"), ("s5(3)", "s2", "exact"), ("s5(3)", "s2(3)", "partial")], "from_id string, to_id string, resolution string")
    below = hierarchy.subtree_text(_tree(spark), frame(spark, "prov"))
    return questions.hop_pairs(edges, below, frame(spark, "prov").select("id", "kind"), (20, 1500), (20, 1600)).select("src", "dst")


@query(f"WITH {ctes('q')} SELECT 'lay_' || type || '-' || substr(sha1('paraphrase:' || id), 1, 8) AS id, type, id AS pair_of, 'In other words ' || id AS question FROM q WHERE id IN ('q1', 'q3')")
def lay_rows(spark, base):
    new = spark.createDataFrame([("q1", "In other words q1", "paraphrase", "first"), ("q3", "In other words q3", "paraphrase", "third")], "pair_of string, question string, style string, person string")
    return questions.lay_rows(_asked(spark).drop("style", "person", "pair_of"), new).select("id", "type", "pair_of", "question")


@query(f"WITH {ctes('q')} SELECT id, CASE WHEN id IN ('q3', 'l1') THEN 'accepted' WHEN id = 'l3' THEN 'rejected' ELSE status END AS status, CASE WHEN id = 'l1' THEN 'New words?' ELSE question END AS question FROM q")
def reviewed_questions(spark, base):
    decisions = spark.createDataFrame([("q3", "accept", None), ("l3", "reject", None), ("l1", "edit", "New words?")], "id string, action string, question string")
    return questions.reviewed(frame(spark, "q"), decisions).select("id", "status", "question")


@query(f"WITH {ctes('q')} SELECT type, least(count(*), 2) AS n FROM q WHERE type IN ('lookup', 'amendment', 'table') GROUP BY type")
def sampled_per_type(spark, base):
    return questions.sample_per_type(frame(spark, "q"), {"lookup": 2, "amendment": 2, "table": 2}, 7).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(values([(4, 0.75, 0.25)], "n, catch_rate, false_flag_rate"))
def catch_rates(spark, base):
    return scoring.catch_rates(spark.createDataFrame([(True, False), (True, True), (False, False), (True, False)], "mutated_flagged boolean, original_flagged boolean"))


@query(f"""WITH RECURSIVE {_REF}, {ctes('q')}, {ctes('cit')}, g AS (SELECT id AS qid, unnest(CASE WHEN type = 'multi_hop' THEN list_concat(gold_provisions, gold_table_rows) WHEN len(gold_table_rows) > 0 THEN gold_table_rows ELSE gold_provisions END) AS gold FROM q), r AS (SELECT qid, gold, gold AS pid FROM g UNION SELECT qid, gold, u.id FROM g JOIN up u ON u.ancestor = gold),
k AS (SELECT id AS qid, n AS rank, unnest(provisions) AS pid FROM cit), f AS (SELECT r.qid, r.gold, min(k.rank) AS first FROM r LEFT JOIN k USING (qid, pid) GROUP BY ALL)
SELECT qid, round(avg((coalesce(first, 99) <= 1)::INT), 6) AS recall_1, round(coalesce(1.0 / min(first), 0), 6) AS mrr FROM f GROUP BY qid""")
def recall_with_descendants(spark, base):
    gold = _asked(spark).select(F.col("id").alias("qid"), F.explode(scoring.gold_targets(F.col("type"), F.col("gold_provisions"), F.col("gold_table_rows"))).alias("gold"))
    ranked = frame(spark, "cit").select(F.col("id").alias("qid"), F.col("n").alias("rank"), F.explode("provisions").alias("pid"))
    own = gold.select("gold").distinct().select(F.col("gold").alias("id"), F.col("gold").alias("ancestor"))
    out = evals.retrieval_metrics(gold, ranked, _tree(spark).select("id", "ancestor").unionByName(own).distinct())
    return out.select("qid", F.round("recall_1", 6).alias("recall_1"), F.round("mrr", 6).alias("mrr"))


@query("""WITH w AS (SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')) AS n FROM documents) SELECT doc_id, s::INT AS start, least(512, n - s)::INT AS n_tokens FROM w, unnest(range(0, greatest(n - 64, 1), 448)) t(s) WHERE n > 0""")
def window_udtf(spark, base):
    """Token windows by a table function, called laterally: the form for rules that column functions can't state."""
    from quillon.functions.udtf import register
    from quillon.tables import load

    register(spark)
    load(spark, base, "documents").createOrReplaceTempView("quillon_documents")
    return spark.sql("SELECT doc_id, w.start, w.n_tokens FROM quillon_documents, LATERAL quillon_windows(text, 512, 64) w")
