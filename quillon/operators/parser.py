"""One pass over the sorted lines of documents: a machine whose state is the open path, from lines to nodes, tables and endnotes.

Spark reads the lines' forms and the labels that they begin with; the task that a document's lines are sorted into carries the path
only, and finds each run of labels' places in their sequences once. It takes and gives columns of a batch, so its memory is that of
the deepest path, however long a document is.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from quillon.functions.labels import HUNDREDS, ONES, TENS, VALUES
from quillon.operators.outline import ALIGN, CHAPTER, INDENT, LABELLED, PART, PUSHED, SCHEDULE, UNIT
from quillon.operators.structure import LABEL

#: Headings of a table and of a block of endnotes (fixed forms).
TABLE = r"^\s*\[?Table\b"
ENDNOTES = r"^\s*(?:Foot|End)?[Nn]otes\s*:?\s*$"

_OUT = "line_index bigint, page int, level int, opens boolean, kind string, id string, parent string, number string, skipped int, chapter string, part string, schedule string, at bigint, at_level int, text string"


def _roman(label: str) -> int | None:
    """The number of a canonical Roman numeral in capitals."""
    if not label or set(label) - set(VALUES):
        return None
    digits = [VALUES[c] for c in label]
    n = sum(-v if v < after else v for v, after in zip(digits, [*digits[1:], 0]))
    digit = lambda of, by: of[n // by % 10]
    return n if "M" * (n // 1000) + digit(HUNDREDS, 100) + digit(TENS, 10) + digit(ONES, 1) == label else None


@lru_cache(1 << 16)
def places(label: str) -> dict[str, tuple[int, int]]:
    """The places kind: (pos, sub) that a bare label may have: 5A is 1 after 5, zb is 28, ab is 2 after a, iv is 4 or none."""
    low, order = label.lower(), lambda c: ord(c) - 96
    if number := re.match("[0-9]+", label):
        inserted = re.fullmatch("[0-9]+([A-Z]*)", label)
        sub = reduce(lambda s, c: s * 27 + order(c), inserted[1].lower() if inserted else "", 0)
        return {"num": (int(number[0]), sub)} if int(number[0]) < 1 << 31 else {}
    found, roman = {}, _roman(label.upper())
    small = label.islower()
    if small and (len(label) == 1 or (label[0] == "z" and len(label) <= 4) or (len(label) == 2 and roman is None)):
        after_z = re.fullmatch("z+[a-z]", low)
        found["alpha"] = ((len(low) - 1) * 26 + order(low[-1]), 0) if after_z else (order(low[0]), order(low[1]) if len(low) > 1 else 0)
    if label.isupper() and len(label) == 1:
        found["ALPHA"] = (order(low), 0)
    if roman is not None and (small or label.isupper()):
        found["roman" if small else "ROMAN"] = (roman, 0)
    return found


def label_places(label: Column) -> Column:
    """`places` of a column of labels, as an array of (kind, pos, sub)."""
    return F.udf(lambda v: [(kind, *place) for kind, place in places(v or "").items()], "array<struct<kind:string,pos:int,sub:int>>")(label)


@lru_cache(1 << 16)
def _labelled(run: str) -> list[tuple[str, dict[str, tuple[int, int]]]]:
    """The labels of a run such as (2)(a), each with its places: few runs, which many lines begin with."""
    return [(label, places(label[1:-1])) for label in re.findall(LABEL, run)]


def line_events(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, line_index, page, x, text, bold) with what each may be: event, key, n, body (of units), run (the labels that it begins with)."""
    text, bold = F.coalesce("text", F.lit("")), F.coalesce("bold", F.lit(False))
    found = lambda p, i=1: F.regexp_extract("text", p, i)
    event = (
        F.when(text.rlike(SCHEDULE), "schedule").when(text.rlike(CHAPTER), "chapter").when(bold & text.rlike(PART), "part").when(bold & text.rlike(UNIT), "unit")
        .when(text.rlike(TABLE), "table").when(text.rlike(ENDNOTES), "endnotes").otherwise("text")
    )
    forms = {"schedule": SCHEDULE, "chapter": CHAPTER, "part": PART, "unit": UNIT}
    key = F.lit(None).cast("string")
    for name, pattern in forms.items():
        key = F.when(F.col("event") == name, found(pattern)).otherwise(key)
    rows = lines.select("doc_id", F.col("line_index").cast("bigint").alias("line_index"), F.col("page").cast("int").alias("page"), F.coalesce(F.col("x").cast("double"), F.lit(0.0)).alias("x"), text.alias("text"), event.alias("event"))
    rows = rows.withColumns({"key": key, "body": F.when(F.col("event") == "unit", found(UNIT, 2))}).withColumn("n", F.coalesce(F.regexp_extract("key", r"^(\d+)", 1).try_cast("int"), F.lit(-1)))
    return rows.withColumn("run", F.when(F.col("event").isin("unit", "text"), F.regexp_extract(F.coalesce("body", "text"), LABELLED, 1)).otherwise(""))


@dataclass(slots=True)
class _Entry:
    x: float
    id: str
    at: tuple[int, int]
    places: dict = field(default_factory=dict)


class _Machine:
    """The state of one document: where its numbers stand, the open unit, the labels open below it, a table or endnotes that take all lines."""

    def __init__(self, gap: int):
        self.gap, self.section, self.paragraph = gap, 0, 0
        self.top: str | None = None
        self.part: str | None = None
        self.unit: _Entry | None = None
        self.path: list[_Entry] = []
        self.depth = 0  # how much of the path text and new lists may go on with; a list beyond it can still go on itself
        self.block: _Entry | None = None  # a table or endnotes
        self.tables, self.blocks, self.ended = 0, 0, True
        self.within: tuple = (None, None, None)  # chapter, part, schedule

    def _deepest(self) -> _Entry | None:
        return self.path[self.depth - 1] if self.depth else self.unit

    def _base(self) -> str | None:
        return ":".join(v for v in (self.top, self.part) if v) or None

    def _open_unit(self, id: str, line: int) -> None:
        self.unit, self.path, self.depth, self.block = _Entry(0.0, id, (line, -1)), [], 0, None
        self.tables, self.ended = 0, True
        name = self.top.split(":")[1] if self.top else None
        self.within = (None, self.part, name) if self._in_schedule() else (name, self.part, None)

    def _accepts(self, n: int) -> int | None:
        """How many numbers are missing before a unit's, or None if it is none. A number that can't be read is -1."""
        step = n - (self.paragraph if self._in_schedule() else self.section)
        return step - 1 if (step == 1 if self._in_schedule() else 1 <= step <= self.gap) else None

    def _in_schedule(self) -> bool:
        return bool(self.top) and self.top.startswith("sch:")

    def _place(self, places: dict[str, tuple[int, int]], x: float) -> tuple[int, float, dict] | None:
        """Where a label at x belongs: how much of the path stays open, at which indent it stands, and which of its places hold."""
        for depth in range(len(self.path) - 1, -1, -1):  # it goes on with an open list, the innermost first
            e = self.path[depth]
            if -ALIGN <= x - e.x <= PUSHED:
                on = _goes_on(e.places, places)
                if on:
                    return depth, e.x, on
        first = [kind for kind, place in places.items() if place == (1, 0)]
        if first:
            near = {k for e in self.path[: self.depth] if abs(e.x - x) <= ALIGN for k in e.places}
            first = [kind for kind in first if kind not in near]
        if not first:
            return None
        depth = self.depth
        while depth and self.path[depth - 1].x > x + INDENT:
            depth -= 1
        return depth, x, dict.fromkeys(first, (1, 0))

    def _target(self, x: float) -> _Entry | None:
        """What a line without a label goes on with: the deepest node while its sentence is open, else what stands at or left of x."""
        if self.ended:
            while self.depth and self.path[self.depth - 1].x > x + INDENT:
                self.depth -= 1
        return self._deepest()

    def read(self, i: int, event: str, line: int, at_x: float, key: str | None, n: int, body: str | None, run: str, text: str, out: list) -> None:
        """Reads line i of a batch, and appends the rows it gives."""
        skipped = None
        if event == "text":
            if self.unit is None:
                return  # before the first heading
        elif event in ("chapter", "schedule"):
            self.top, self.part = f"{'ch' if event == 'chapter' else 'sch'}:{key}", None
            if event == "schedule":
                self.paragraph = 0
            self._open_unit(self.top, line)
            out.append(self._opened(i, self.unit, event, None, key))
            return
        elif event == "part" and self.top:
            self.part = key
            if self._in_schedule():
                self.paragraph = 0
            self._open_unit(self._base(), line)
            out.append(self._opened(i, self.unit, event, self.top, key))
            return
        elif event == "unit":
            skipped = self._accepts(n)
        if skipped is not None:
            if self._in_schedule():
                self.paragraph = n
            else:
                self.section = n
            self._open_unit(f"{self._base()}:{key}" if self._in_schedule() else f"s{key}", line)
            out.append(self._opened(i, self.unit, "paragraph" if self._in_schedule() else "section", self._base(), key, skipped))
            text = body
        else:
            if self.unit is None:
                return
            if event == "endnotes" or (event == "table" and not (self.block and ":notes" in self.block.id)):
                owner = self._deepest().id
                if event == "table":
                    self.tables += 1
                    self.block = _Entry(at_x, f"{self.unit.id}:tbl{self.tables}", (line, -1))
                else:
                    self.blocks += 1
                    self.block, owner = _Entry(at_x, f"{self._base() or 'doc'}:notes{self.blocks}", (line, -1)), self._base()
                out.append(self._opened(i, self.block, event, owner, None))
                return
            if self.block:
                out.append(self._said(i, self.block, text))
                return
        taken = 0
        if run and (skipped is not None or event == "text"):
            for k, (label, may_be) in enumerate(_labelled(run)):
                found = self._place(may_be, at_x + k * 2 * INDENT)
                if found is None:
                    break
                depth, at, kinds = found
                del self.path[depth:]
                above = self.path[-1] if self.path else self.unit
                self.path.append(_Entry(at, f"{above.id}{label}", (line, k), kinds))
                self.depth = len(self.path)
                out.append(self._opened(i, self.path[-1], "clause", above.id, label))
                taken += len(label)
        if taken:
            text = text[text.index("(") + taken :]  # a bracket of an amendment may stand before the first label
        text = text.strip()
        if text:
            to = self._deepest() if taken or skipped is not None else self._target(at_x)
            self.ended = text[-1] in ".;:,—-"
            out.append(self._said(i, to, text))
        elif taken:
            self.ended = False

    def _opened(self, i: int, e: _Entry, kind: str, parent: str | None, number: str | None, skipped: int | None = None) -> tuple:
        return (i, e.at[1], True, kind, e.id, parent, number, skipped, *self.within, *e.at, None)

    def _said(self, i: int, e: _Entry, text: str) -> tuple:
        return (i, None, False, None, e.id, None, None, None, *self.within, *e.at, text)


def _goes_on(open: dict[str, tuple[int, int]], places: dict[str, tuple[int, int]]) -> dict[str, tuple[int, int]]:
    """The places that follow an open one of their kind: the next place, the one after that, or one inserted behind the same."""
    on = {}
    for kind, after in places.items():
        before = open.get(kind)
        if before and (1 <= after[0] - before[0] <= 2 or (after[0] == before[0] and after[1] > before[1])):
            on[kind] = after
    return on


def _values(column: pa.Array) -> list:
    whole = column.null_count == 0 or pa.types.is_string(column.type)  # by way of numpy, where that keeps the values
    return column.to_numpy(zero_copy_only=False).tolist() if whole else column.to_pylist()


def parsed(lines: DataFrame, gap: int = 3) -> DataFrame:
    """A row for each node that a line opens, and one for each piece of text with the node (at, at_level: its line and level) it belongs to.

    Chapters, schedules and parts set where units stand. A bold number opens a section if it goes on from the last one with at most
    `gap` steps, or a paragraph of a schedule if it is the next one; other numbers are text. A label opens a clause as the first of
    a list, or as what follows an open one that it stands below; other labels are text, as in a wrapped reference. A heading of a
    table, or of endnotes, takes all lines up to the next unit, part, chapter or schedule. Lines before the first heading, and blank
    ones, give no row. A document without lines has none; null texts are blank; lines of equal index come in the order of x and text.

    A document is read in one task, as what a line is depends on all before it; the task holds one path and one Arrow batch.
    """
    schema = StructType([StructField("doc_id", lines.schema["doc_id"].dataType), *StructType.fromDDL(_OUT)])
    arrow = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, doc, begun = _Machine(gap), None, False
        gc.disable()  # nothing here is cyclic, and looking for cycles among a batch's rows takes a fourth of the time
        try:
            for batch in batches:
                out: list[tuple] = []
                columns = [_values(batch[c]) for c in ("doc_id", "event", "line_index", "x", "key", "n", "body", "run", "text")]
                for i, (of, event, line, x, key, n, body, run, text) in enumerate(zip(*columns)):
                    if not begun or of != doc:
                        machine, doc, begun = _Machine(gap), of, True
                    machine.read(i, event, line, x, key, n, body, run, text, out)
                if out:
                    rows, *made = zip(*out)
                    kept = [batch[c].take(pa.array(rows)) for c in ("doc_id", "line_index", "page")]
                    yield pa.RecordBatch.from_arrays([*kept, *(pa.array(v, f.type) for v, f in zip(made, list(arrow)[3:]))], schema=arrow)
        finally:
            gc.enable()

    ordered = line_events(lines).repartition("doc_id").sortWithinPartitions("doc_id", "line_index", "x", "text")
    return ordered.mapInArrow(read, schema)


def nodes(rows: DataFrame) -> DataFrame:
    """Nodes (doc_id, id, kind, number, parent, skipped, chapter, part, schedule, text, page_start, page_end, ord) of parsed rows; repeated ids get ~2, ~3."""
    key = ["doc_id", "at", "at_level"]
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("line_index", "text")))), lambda p: p["text"])
    opened = lambda c: F.max(F.when(F.col("opens"), F.col(c))).alias(c)
    out = rows.groupBy(*key).agg(
        F.max("id").alias("id"), *[opened(c) for c in ("kind", "number", "parent", "skipped", "chapter", "part", "schedule")],
        F.array_join(parts, " ").alias("text"), F.min("page").alias("page_start"), F.max("page").alias("page_end"),
    )
    order = [F.col("at"), F.col("at_level")]
    again = F.row_number().over(Window.partitionBy("doc_id", "id").orderBy(*order))
    out = out.withColumn("_n", again).withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1)
    return out.withColumn("id", F.when(F.col("_n") > 1, F.concat_ws("~", "id", F.col("_n").cast("string"))).otherwise(F.col("id"))).drop("_n", "at", "at_level")
