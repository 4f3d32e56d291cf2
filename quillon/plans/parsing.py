"""Registered queries of the line parser: statutes printed from the relational tables, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.labels import to_roman
from quillon.operators import parser
from quillon.plans.catalog import query
from quillon.plans.derived import derived
from quillon.tables import load

#: How many customers one printed document has, and how many one chapter.
CUSTOMERS = 50
CHAPTERS = 10


def printed(spark: SparkSession, base: str) -> DataFrame:
    """Lines of documents of 50 customers: customers are sections in chapters, orders clauses, their lines items.

    Items of some parts go on in a wrapped line that begins like a label or, in bold, like a section. Sections may end with a
    line of their own and with a table; each full chapter ends with notes.
    """
    c = load(spark, base, "customer").select("c_custkey", "c_name", "c_nationkey", F.floor(F.col("c_custkey") / CUSTOMERS).alias("doc_id"))
    c = c.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("c_custkey")))
    o = load(spark, base, "orders").select("o_orderkey", "o_custkey").withColumn("k", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    items = load(spark, base, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").withColumn("a", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")))
    o = c.join(o, c["c_custkey"] == o["o_custkey"])
    items = items.join(o, items["l_orderkey"] == o["o_orderkey"])

    def line(place: int, k, a, sub: int, x, text, bold=False, when=None) -> Column:
        lit = lambda v: v if isinstance(v, Column) else F.lit(v)
        fields = {"place": place, "k": lit(k).cast("int"), "a": lit(a).cast("int"), "sub": sub, "x": lit(x).cast("double"), "text": text, "bold": bold}
        row = F.struct(*[lit(v).alias(name) for name, v in fields.items()])
        return row if when is None else F.when(when, row)

    def of(rows: DataFrame, *lines: Column) -> DataFrame:
        """The lines that each row prints, made where the row stands."""
        return rows.select("doc_id", "n", F.explode(F.array_compact(F.array(*lines))).alias("line")).select("doc_id", "n", "line.*")

    text = lambda *v: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in v])
    wrapped, false_unit = F.coalesce(F.col("l_partkey") % 7 == 0, F.lit(False)), F.coalesce(F.col("l_partkey") % 13 == 0, F.lit(False))
    tabled, noted = F.col("c_custkey") % 3 == 0, F.col("n") % CHAPTERS == 0
    sections = of(
        c,
        line(0, 0, 0, 0, 30, text("CHAPTER ", to_roman(F.floor((F.col("n") - 1) / CHAPTERS) + 1)), True, (F.col("n") - 1) % CHAPTERS == 0),
        line(1, 0, 0, 0, 0, text(F.col("n"), ". ", F.col("c_name"), "."), True),
        line(3, 0, 0, 0, 0, text("So ends ", F.col("c_custkey"), "."), when=F.col("c_custkey") % 2 == 0),
        line(4, 0, 0, 0, 30, text("Table"), when=tabled),
        line(4, 0, 0, 1, 35, text("(1) nation ", F.col("c_nationkey")), when=tabled),
        line(5, 0, 0, 0, 30, text("Notes"), when=noted),
        line(5, 0, 0, 1, 0, text("1. Ins. by Act No. ", F.col("c_nationkey"), "."), when=noted),
    )
    clauses = of(o, line(2, F.col("k"), 0, 0, 20, text("(", F.col("k"), ") order ", F.col("o_orderkey"), " holds:")))
    parts = of(
        items,
        line(2, F.col("k"), F.col("a"), 0, 40, text("(", F.char(F.col("a") + 96), ") part ", F.col("l_partkey"), F.when(wrapped | false_unit, "").otherwise(";"))),
        line(2, F.col("k"), F.col("a"), 1, F.when(F.col("l_partkey") % 2 == 0, 40).otherwise(5), text("(9) of supplier ", F.col("l_suppkey"), ";"), when=wrapped),
        line(2, F.col("k"), F.col("a"), 1, 5, text("999. of supplier ", F.col("l_suppkey"), ";"), True, false_unit & ~wrapped),
    )
    rows = sections.unionByName(clauses).unionByName(parts)
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("n", "place", "k", "a", "sub"))
    rows = rows.withColumn("line_index", at.cast("bigint"))
    return rows.select("doc_id", "line_index", F.ceil(F.col("line_index") / 40).cast("int").alias("page"), "x", "text", "bold")


def _rows(spark: SparkSession, base: str) -> DataFrame:
    return derived(spark, base, ["customer", "orders", "lineitem"], "parsed_statutes", lambda: parser.parsed(printed(spark, base)))


_TREE = f"""c AS (SELECT c_custkey, c_name, c_nationkey, c_custkey // {CUSTOMERS} AS doc_id, row_number() OVER (PARTITION BY c_custkey // {CUSTOMERS} ORDER BY c_custkey) AS n FROM customer),
o AS (SELECT c.*, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders JOIN c ON c_custkey = o_custkey),
i AS (SELECT o.*, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS a FROM lineitem JOIN o ON o_orderkey = l_orderkey),
named AS (SELECT *, 's' || n || '(' || k || ')(' || chr((96 + a)::INTEGER) || ')' AS item FROM i),
latest AS (SELECT o.c_custkey, arg_max(coalesce(item, 's' || o.n || '(' || o.k || ')'), (o.k, coalesce(a, 0))) AS id FROM o LEFT JOIN named ON named.o_orderkey = o.o_orderkey GROUP BY o.c_custkey),
chapters AS (SELECT *, ['I', 'II', 'III', 'IV', 'V'][(n - 1) // {CHAPTERS} + 1] AS ch FROM c),
tree AS (
SELECT doc_id, 'ch:' || ch AS id, 'chapter' AS kind, ch AS number, NULL AS parent, '' AS text, ch FROM chapters WHERE (n - 1) % {CHAPTERS} = 0
UNION ALL SELECT doc_id, 's' || n, 'section', n::VARCHAR, 'ch:' || ch, c_name || '.' || CASE WHEN c_custkey % 2 = 0 THEN ' So ends ' || c_custkey || '.' ELSE '' END, ch FROM chapters
UNION ALL SELECT o.doc_id, 's' || o.n || '(' || k || ')', 'clause', '(' || k || ')', 's' || o.n, 'order ' || o_orderkey || ' holds:', ch FROM o JOIN chapters USING (c_custkey)
UNION ALL SELECT named.doc_id, item, 'clause', '(' || chr((96 + a)::INTEGER) || ')', 's' || named.n || '(' || k || ')', 'part ' || l_partkey || CASE WHEN l_partkey % 7 = 0 THEN ' (9) of supplier ' || l_suppkey WHEN l_partkey % 13 = 0 THEN ' 999. of supplier ' || l_suppkey ELSE '' END || ';', ch FROM named JOIN chapters USING (c_custkey)
UNION ALL SELECT doc_id, 's' || n || ':tbl1', 'table', NULL, CASE WHEN c_custkey % 2 = 0 OR latest.id IS NULL THEN 's' || n ELSE latest.id END, '(1) nation ' || c_nationkey, ch FROM chapters LEFT JOIN latest USING (c_custkey) WHERE c_custkey % 3 = 0
UNION ALL SELECT doc_id, 'ch:' || ch || ':notes' || (n // {CHAPTERS}), 'endnotes', NULL, 'ch:' || ch, '1. Ins. by Act No. ' || c_nationkey || '.', ch FROM chapters WHERE n % {CHAPTERS} = 0)"""


@query(f"WITH {_TREE} SELECT doc_id, id, kind, number, parent, text, ch AS chapter FROM tree")
def parsed_statutes(spark: SparkSession, base: str) -> DataFrame:
    """The nodes of printed statutes are those that they were printed from."""
    return parser.nodes(_rows(spark, base)).select("doc_id", "id", "kind", "number", "parent", "text", "chapter")


@query(f"""WITH {_TREE}, w AS (SELECT ch, count(*) FILTER (l_partkey % 7 = 0) AS labels, count(*) FILTER (l_partkey % 13 = 0 AND l_partkey % 7 <> 0) AS numbers FROM named JOIN chapters USING (c_custkey) GROUP BY ch)
SELECT ch AS chapter, count(*) FILTER (kind = 'section') AS sections, count(*) FILTER (kind = 'clause') AS clauses, count(*) FILTER (kind = 'table') AS tables, count(*) FILTER (kind = 'endnotes') AS notes, coalesce(any_value(labels), 0) AS wrapped_labels, coalesce(any_value(numbers), 0) AS wrapped_numbers FROM tree LEFT JOIN w USING (ch) GROUP BY ch""")
def parser_events(spark: SparkSession, base: str) -> DataFrame:
    """What the parser opened by chapter, and which lines that look like labels or sections it took for text."""
    rows = _rows(spark, base)
    opened = lambda kind: F.count_if(F.col("opens") & (F.col("kind") == kind))
    kept = lambda form: F.count_if(~F.col("opens") & F.col("text").rlike(form) & (F.col("at_level") >= 0))
    return rows.groupBy("chapter").agg(
        opened("section").alias("sections"), opened("clause").alias("clauses"), opened("table").alias("tables"), opened("endnotes").alias("notes"),
        kept(r"^\(9\) of").alias("wrapped_labels"), kept(r"^999\. of").alias("wrapped_numbers"),
    )
