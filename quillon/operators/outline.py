"""From lines to a tree and to tables: headings, numbered units, labelled clauses by indentation, ruled columns.

Lines are rows (doc_id, line_index, page, x, text, bold). What a line continues is found by forward fills; the
only fold is over the labels of one unit, whose parents depend on the indents before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.labels import follows, label_classes
from quillon.operators.hierarchy import suffix_duplicates
from quillon.operators.structure import LABEL, column_of

# Forms of headings and labels (fixed values).
CHAPTER = r"^CHAPTER\s+([IVXL]+)\b"
PART = r"^(?:PART|Part)\s+([A-H])\b"
SCHEDULE = r"^SCHEDULE\s+([IVXL]+)\b"
UNIT = r"^(\d+[A-Z]{0,2})\.\s*(.*)$"
LABELLED = rf"^\[?((?:{LABEL})+)\s*(.*)$"
INDENT = 2.0


def _filled(c: Column, *reset: Column) -> Column:
    w = Window.partitionBy("doc_id").orderBy("line_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.last(c, ignorenulls=True).over(w)


def accepted_units(rows: DataFrame, gap: int = 3) -> DataFrame:
    """The numbered lines (doc_id, line_index, number, in_schedule) that are units, with `skipped`: how many numbers are missing before.

    Sections go on from the last one, with at most `gap` steps at once; a schedule's paragraphs begin at 1 and go on one by
    one. Other numbers, such as those of wrapped references, are no units. A fold over a document's numbered lines.
    """
    marks = F.array_sort(F.collect_list(F.struct("line_index", "number", "in_schedule")))
    item = "struct<line_index:bigint,number:int,in_schedule:boolean,skipped:int>"
    start = F.struct(F.lit(0).alias("section"), F.lit(0).alias("para"), F.array().cast(f"array<{item}>").alias("out"))

    def read(s: Column, m: Column) -> Column:
        last = F.when(m["in_schedule"], s["para"]).otherwise(s["section"])
        step = m["number"] - last
        fine = F.when(m["in_schedule"], step == 1).otherwise((step >= 1) & (step <= gap))
        kept = F.struct(m["line_index"].cast("bigint").alias("line_index"), m["number"].cast("int").alias("number"), m["in_schedule"].alias("in_schedule"), (step - 1).cast("int").alias("skipped"))
        return F.struct(
            F.when(fine & ~m["in_schedule"], m["number"]).otherwise(s["section"]).cast("int").alias("section"), F.when(fine & m["in_schedule"], m["number"]).when(~m["in_schedule"], 0).otherwise(s["para"]).cast("int").alias("para"),
            F.when(fine, F.concat(s["out"], F.array(kept))).otherwise(s["out"]).cast(f"array<{item}>").alias("out"),
        )

    folded = rows.groupBy("doc_id").agg(marks.alias("m")).select("doc_id", F.explode(F.aggregate("m", start, read, lambda s: s["out"])).alias("x"))
    return folded.select("doc_id", "x.*")


#: The first label of each kind (fixed values), how far labels of one list may stand apart, and how far a bracket may push one to the right.
FIRST = {"num": "1", "alpha": "a", "roman": "i", "ALPHA": "A", "ROMAN": "I"}
ALIGN = 6.0
PUSHED = 12.0


def plausible(label: Column, x: Column, siblings: Column) -> Column:
    """Whether a label (with brackets) at x can open a node: as the first of a kind, where no list of it is open there, or as what follows an open sibling (x, label) that it stands below.

    A label left of a list doesn't go on with it, whatever its number: it is a reference that begins a wrapped line.
    """
    bare = lambda c: F.regexp_replace(c, "[()]", "")
    near = F.filter(siblings, lambda e: F.abs(e["x"] - x) <= ALIGN)
    in_line = F.filter(siblings, lambda e: (x - e["x"]).between(-ALIGN, PUSHED))

    def fits(kind: str, first: str) -> Column:
        same = F.exists(near, lambda e: F.array_contains(label_classes(bare(e["label"])), kind))
        after = F.exists(in_line, lambda e: follows(bare(e["label"]), bare(label), F.lit(kind)))
        return F.array_contains(label_classes(bare(label)), kind) & F.when(bare(label) == first, ~same).otherwise(after)

    ok = F.lit(False)
    for kind, first in FIRST.items():
        ok = ok | fits(kind, first)
    return ok


def outline(lines: DataFrame, strict: bool = False) -> DataFrame:
    """Nodes (doc_id, id, kind, number, heading, parent, chapter, part, schedule, text, page_start, page_end, ord).

    Units are sections, or below a schedule its paragraphs; a labelled line is below the nearest line before it
    in its unit with a smaller indent; several labels on one line are one below the other; other lines continue
    the node before them. Repeated ids get ~2, ~3. strict: a label that neither begins a list nor goes on with an open
    one is text, such as a reference that begins a wrapped line.
    """
    found = lambda p, i=1: F.nullif(F.regexp_extract("text", p, i), F.lit(""))
    rows = lines.select("*", found(CHAPTER).alias("ch"), found(SCHEDULE).alias("sch"), F.when(F.col("bold"), found(PART)).alias("pt"))
    big = F.when(F.col("sch").isNotNull(), F.concat(F.lit("sch:"), "sch")).when(F.col("ch").isNotNull(), F.concat(F.lit("ch:"), "ch"))
    rows = rows.withColumn("top", _filled(big)).withColumn("is_top", big.isNotNull())
    in_top = Window.partitionBy("doc_id", "top").orderBy("line_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("part", F.last("pt", ignorenulls=True).over(in_top))
    number = F.when(F.col("bold") & ~F.col("is_top") & F.col("pt").isNull(), found(UNIT))
    below = F.when(F.col("top").startswith("sch:"), F.concat_ws(":", "top", "part", number)).otherwise(F.concat(F.lit("s"), number))
    outer = F.when(F.col("is_top"), F.col("top")).when(F.col("pt").isNotNull(), F.concat_ws(":", "top", "pt"))
    rows = rows.withColumn("number", number).withColumn("unit", _filled(F.coalesce(outer, F.when(number.isNotNull(), below))))
    rows = rows.withColumn("opens", F.coalesce(outer.isNotNull(), F.lit(False)) | number.isNotNull())
    body = F.when(F.col("number").isNotNull(), F.regexp_extract("text", UNIT, 2)).when(F.col("is_top") | F.col("pt").isNotNull(), F.lit("")).otherwise(F.col("text"))
    labelled = ~F.col("is_top") & F.col("pt").isNull() & body.rlike(LABELLED)
    rows = rows.withColumn("body", body).withColumn("labels", F.when(labelled, F.regexp_extract_all(F.regexp_extract(body, LABELLED, 1), F.lit(LABEL), F.lit(0))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("rest", F.when(labelled, F.regexp_extract("body", LABELLED, 2)).otherwise(F.col("body")))
    run = F.sum(F.col("opens").cast("int")).over(Window.partitionBy("doc_id").orderBy("line_index").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("run", run).where("unit is not null")
    placed = _labelled_ids(rows, strict)
    rows = rows.join(placed, ["doc_id", "line_index"], "left")
    rows = rows.withColumn("rest", F.when((F.size("labels") > 0) & (F.coalesce(F.size("ids"), F.lit(0)) <= 0), F.col("body")).otherwise(F.col("rest")))
    in_unit = Window.partitionBy("doc_id", "run").orderBy("line_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("node", F.coalesce(F.last("last_id", ignorenulls=True).over(in_unit), "unit"))
    chains = rows.where("size(ids) > 0").select("doc_id", "line_index", "run", "unit", "page", F.posexplode("ids").alias("level", "x"))
    nodes = chains.select("doc_id", "run", "line_index", "level", F.col("x.id").alias("id"), F.col("x.parent").alias("parent"), F.regexp_extract("x.id", LABEL + "$", 0).alias("number"), F.lit("clause").alias("kind"), F.lit(None).cast("string").alias("heading"))
    kind = F.when(F.col("is_top"), F.when(F.col("unit").startswith("sch:"), "schedule").otherwise("chapter")).when(F.col("pt").isNotNull(), "part").when(F.col("unit").startswith("sch:"), "paragraph").otherwise("section")
    over = F.when(F.col("is_top"), None).when(F.col("pt").isNotNull(), F.col("top")).otherwise(F.concat_ws(":", "top", "part"))
    units = rows.where("opens").select("doc_id", "run", "line_index", F.lit(-1).alias("level"), F.col("unit").alias("id"), F.nullif(over, F.lit("")).alias("parent"), F.coalesce("number", "pt", F.regexp_replace("top", "^.*:", "")).alias("number"), kind.alias("kind"), F.when(F.col("number").isNotNull(), F.nullif(F.trim("rest"), F.lit(""))).alias("heading"))
    nodes = nodes.unionByName(units)
    text = rows.where("rest <> ''").groupBy("doc_id", "run", F.col("node").alias("id")).agg(F.array_sort(F.collect_list(F.struct("line_index", "rest"))).alias("p"), F.max("page").alias("last_page"))
    context = rows.where("opens").select("doc_id", "run", F.when(F.col("top").startswith("ch:"), F.substring("top", F.lit(4), F.length("top"))).alias("chapter"), "part", F.when(F.col("top").startswith("sch:"), F.substring("top", F.lit(5), F.length("top"))).alias("schedule"))
    pages = rows.select("doc_id", "line_index", F.col("page").alias("page_start"))
    out = nodes.join(text, ["doc_id", "run", "id"], "left").join(context, ["doc_id", "run"], "left").join(pages, ["doc_id", "line_index"], "left")
    out = out.withColumn("text", F.array_join(F.transform("p", lambda x: x["rest"]), " ")).withColumn("page_end", F.greatest("page_start", "last_page"))
    out = out.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_index", "level")) - 1)
    keyed = suffix_duplicates(out.withColumn("_k", F.concat_ws("\u0001", F.col("doc_id").cast("string"), "id")), "_k", "ord")
    return keyed.withColumn("id", F.substring_index("_k", "\u0001", -1)).select("doc_id", "id", "kind", "number", "heading", "parent", "chapter", "part", "schedule", "text", "page_start", "page_end", "ord")


def _labelled_ids(rows: DataFrame, strict: bool) -> DataFrame:
    """(doc_id, line_index, ids, last_id): the nodes that each labelled line opens, with their parents; a stack of indents is folded over a unit's labels."""
    marks = F.array_sort(F.collect_list(F.struct("line_index", "x", "labels")))
    units = rows.where("size(labels) > 0").groupBy("doc_id", "run", "unit").agg(marks.alias("marks"))
    item, entry = "struct<line_index:bigint,ids:array<struct<id:string,parent:string>>>", "struct<x:double,id:string,label:string>"
    start = F.struct(F.array().cast(f"array<{entry}>").alias("stack"), F.array().cast(f"array<{item}>").alias("out"))

    def place(s: Column, m: Column) -> Column:
        stack = F.filter(s["stack"], lambda e: e["x"] < m["x"] - INDENT)
        parent = F.coalesce(F.try_element_at(stack, F.lit(-1))["id"], F.col("unit"))
        name = lambda k: F.concat(parent, F.array_join(F.slice(m["labels"], F.lit(1), k), ""))
        ids = F.transform(F.sequence(F.lit(1), F.size(m["labels"])), lambda k: F.struct(name(k).alias("id"), name(k - 1).alias("parent")))
        # labels after the first one stand to its right: a later line at their indent is their sibling
        fresh = F.transform(ids, lambda x, k: F.struct((m["x"].cast("double") + k * 2 * INDENT).alias("x"), x["id"].alias("id"), F.get(m["labels"], k).alias("label")))
        taken = F.struct(F.concat(stack, fresh).cast(f"array<{entry}>").alias("stack"), F.concat(s["out"], F.array(F.struct(m["line_index"].cast("bigint").alias("line_index"), ids.alias("ids")))).cast(f"array<{item}>").alias("out"))
        return F.when(plausible(F.element_at(m["labels"], 1), m["x"].cast("double"), s["stack"]), taken).otherwise(s) if strict else taken

    folded = units.select("doc_id", F.explode(F.aggregate("marks", start, place, lambda s: s["out"])).alias("o"))
    return folded.select("doc_id", "o.line_index", "o.ids", F.element_at("o.ids", -1)["id"].alias("last_id")).where("size(ids) > 0")


NOTE = r"^\s*\[?Note\b"


def _table_lines(lines: DataFrame) -> DataFrame:
    """Lines below a table's letter row, with table, col, and `noted` once its notes have begun."""
    w = Window.partitionBy("doc_id").orderBy("line_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = F.col("text").rlike(r"^\s*\[?Table\b")
    closes = F.col("bold") & F.col("text").rlike(UNIT)
    rows = lines.withColumn("table", F.sum(opens.cast("int")).over(w)).withColumn("state", F.last(F.when(opens, 1).when(closes, 0), ignorenulls=True).over(w)).where("state = 1")
    letter = F.col("text").rlike(r"^\s*\(?[A-H]\)?\s*$")
    edges = rows.where(letter).groupBy("doc_id", "table").agg(F.array_sort(F.collect_list(F.col("x").cast("double"))).alias("edges"), F.max("line_index").alias("from"))
    body = rows.join(edges, ["doc_id", "table"]).where(F.col("line_index") > F.col("from"))
    body = body.withColumn("col", column_of(F.col("x") + INDENT, F.col("edges")))
    in_table = Window.partitionBy("doc_id", "table").orderBy("line_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    serial = (F.col("col") == 0) & F.col("text").rlike(r"^\s*\d+[A-Z]?\b")
    note = (F.col("col") == 0) & F.col("text").rlike(NOTE)
    noted = F.coalesce(F.last(F.when(note, True).when(serial, False), ignorenulls=True).over(in_table), F.lit(False))
    return body.withColumn("serial", serial).withColumn("note", note).withColumn("noted", noted)


def tables(lines: DataFrame) -> DataFrame:
    """Cells (doc_id, table, row, subrow, col, text) of tables in a line stream.

    A table begins at a heading `Table`, its columns at a row of the letters A, B, C ... whose places are the
    edges; it ends at the next bold numbered unit. A number in the first column opens a row; in the second column
    a small Roman label opens a sub-row (0: what stands before the first); fragments of a row
    and column are joined in order. Notes are not cells.
    """
    in_table = Window.partitionBy("doc_id", "table").orderBy("line_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    body = _table_lines(lines).where(~F.col("noted")).withColumn("row", F.sum(F.col("serial").cast("int")).over(in_table)).where("row > 0")
    in_row = Window.partitionBy("doc_id", "table", "row").orderBy("line_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sub = (F.col("col") == 1) & F.col("text").rlike(r"^\s*\([ivx]+\)")
    body = body.withColumn("subrow", F.sum(sub.cast("int")).over(in_row))
    parts = body.groupBy("doc_id", "table", "row", "subrow", "col").agg(F.array_sort(F.collect_list(F.struct("line_index", F.trim("text").alias("t")))).alias("p"))
    return parts.select("doc_id", "table", "row", "subrow", "col", F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("text"))


def table_notes(lines: DataFrame) -> DataFrame:
    """(doc_id, table, n, text): the notes of each table, each with the lines that go on with it."""
    in_table = Window.partitionBy("doc_id", "table").orderBy("line_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = _table_lines(lines).where("noted").withColumn("n", F.sum(F.col("note").cast("int")).over(in_table))
    parts = rows.groupBy("doc_id", "table", "n").agg(F.array_sort(F.collect_list(F.struct("line_index", F.trim("text").alias("t")))).alias("p"))
    return parts.select("doc_id", "table", "n", F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("text"))


def joined_cells(xs: Column, edges: Column, near: float = 3.0) -> Column:
    """Whether a later span of a line (xs: where its spans that aren't blank begin) begins at another column's edge: two cells read as one line."""
    inner = F.slice(edges, F.lit(2), F.greatest(F.size(edges), F.lit(1)))
    return F.exists(F.slice(xs, F.lit(2), F.greatest(F.size(xs), F.lit(1))), lambda x: F.exists(inner, lambda e: F.abs(x - e) < near))


def crossing(x0: Column, x1: Column, edges: Column, margin: float = 540.0, over: float = 8.0) -> Column:
    """Whether a line that begins in one column runs over the next one's edge up to the right margin: text, not a cell."""
    nxt = F.get(edges, column_of(x0, edges) + 1)
    return F.coalesce((x1 > nxt + over) & (x1 > margin), F.lit(False))


def headers(lines: DataFrame) -> DataFrame:
    """(doc_id, table, col, heading): the lines between a table's title and its letter row, joined by the nearest column."""
    w = Window.partitionBy("doc_id").orderBy("line_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = F.col("text").rlike(r"^\s*\[?Table\b")
    rows = lines.withColumn("table", F.sum(opens.cast("int")).over(w)).where("table > 0")
    letters = rows.where(F.col("text").rlike(r"^\s*\(?[A-H]\)?\s*$"))
    first = letters.groupBy("doc_id", "table").agg(F.min("line_index").alias("letters_at"))
    order = Window.partitionBy("doc_id", "table").orderBy("x")
    centres = letters.select("doc_id", "table", (F.row_number().over(order) - 1).alias("col"), F.col("x").alias("centre"))
    above = rows.where(~opens).join(first, ["doc_id", "table"]).where(F.col("line_index") < F.col("letters_at")).join(centres, ["doc_id", "table"])
    near = above.groupBy("doc_id", "table", "line_index", "text").agg(F.min_by("col", F.struct(F.abs(F.col("x") - F.col("centre")), F.col("col"))).alias("col"))
    parts = near.groupBy("doc_id", "table", "col").agg(F.array_sort(F.collect_list(F.struct("line_index", "text"))).alias("p"))
    return parts.select("doc_id", "table", "col", F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("heading"))


def inject_formulas(lines: DataFrame, formulas: DataFrame) -> DataFrame:
    """Appends each formula (doc_id, page, y, formula) to the text of the nearest line at or above it on its page."""
    both = lines.select("doc_id", "page", "line_index", "y", F.lit(None).cast("string").alias("formula")).unionByName(formulas.select("doc_id", "page", F.lit(None).cast("long").alias("line_index"), "y", "formula"))
    w = Window.partitionBy("doc_id", "page").orderBy("y", F.col("formula").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = both.withColumn("to", F.last("line_index", ignorenulls=True).over(w)).where("formula is not null and to is not null")
    extra = at.groupBy("doc_id", F.col("to").alias("line_index")).agg(F.array_sort(F.collect_list(F.struct("y", "formula"))).alias("f"))
    out = lines.join(extra, ["doc_id", "line_index"], "left")
    return out.withColumn("text", F.concat_ws(" ", "text", F.array_join(F.transform("f", lambda v: v["formula"]), " "))).drop("f")
