"""Repair of conversations whose turns break the grammar (s?(ua)+)?, at least cost, by layers of reachable states.

Edits of a turn: Keep (0), Rerole to user or assistant (2), Delete (3; blank and duplicate turns must go); anywhere, Insert an empty
user or assistant turn (2). A truncated turn that stays costs 1 more. Among the cheapest edits those whose initials,
in order, are the least in ASCII are taken.

Method. For each place between turns and each cost there is a bitset: the states of the grammar from which the rest of the
conversation can be finished for that cost or less. A place's bitsets are the nibbles of one integer, cheapest first, so one
shift or mask acts on all costs at once. Turns are read from the last to the first; every edit shifts the layers of the
place after a turn by its cost. The first layer at the front that holds the start state gives the cost, and the trace reads turns forwards:
it takes the first of D, I, K and R whose next state has a bit in the layer that is left. States never differ by more than SPREAD - 1
in cost, so a place is stored as its cheapest cost and SPREAD layers, and both passes stream: what a task holds of a
conversation is one integer and its audit, however long it is. The rows of a conversation do meet in one task, in order, since a
SHA-256 runs over them in order; they are sorted on disk where they don't fit.

Defined cases: null role and text count as one space (such a turn is blank); null ids are one conversation, null turns come first;
turns of one number are ordered by role and text; roles are known by their initial, and one that isn't s, u or a cannot be
kept; a conversation without rows, or an empty table, needs no edit; columns other than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import tune

#: States of the grammar, one bit each, and the costs of edits.
START, AFTER_S, AFTER_U, AFTER_A = 1, 2, 4, 8
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
SPREAD = 8
#: Layers while a turn is worked in, and masks that pick a state out of every layer.
_WIDE = 16
_ALL = (1 << 4 * _WIDE) - 1
_EACH = sum(1 << 4 * d for d in range(_WIDE))
_STORED = (1 << 4 * SPREAD) - 1
_NAMES = {"u": "user", "a": "assistant"}
_NEXT = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}

Layers = tuple[int, int]  # cheapest cost of a place, and its bitsets from there


def _before(layers: int, initial: str) -> int:
    """In every layer, the states that `initial` leads into the layer's states."""
    if initial == "u":
        to = layers & _EACH * AFTER_U
        return to >> 2 | to >> 1 | to << 1
    if initial == "a":
        return (layers & _EACH * AFTER_A) >> 1
    return (layers & _EACH * AFTER_S) >> 1 if initial == "s" else 0


def _closed(layers: int) -> tuple[int, int]:
    """Layers with what insertions add, each holding the cheaper ones: how many are empty, and SPREAD layers from there."""
    for _ in range(3):  # more insertions in a row lead nowhere new
        layers |= (_before(layers, "u") | _before(layers, "a")) << 4 * INSERT
    for k in (4, 8, 16, 32):
        layers |= layers << k
    layers &= _ALL
    empty = ((layers & -layers).bit_length() - 1) // 4
    return empty, layers >> 4 * empty & _STORED


@functools.lru_cache(None)  # few integers arise: the relative costs of four states
def _worked(layers: int, initial: str, bad: bool, cut: bool) -> tuple[int, int]:
    """Layers before a turn from those after it: how many are empty, and the rest."""
    out = layers << 4 * DELETE
    if not bad:
        out |= _before(layers, initial) << 4 * (TRUNCATED * cut)
        out |= (_before(layers, "u") | _before(layers, "a")) << 4 * (REROLE + TRUNCATED * cut)
    return _closed(out)


END: Layers = _closed(START | AFTER_A)


def before_turn(after: Layers, initial: str, bad: bool, cut: bool) -> Layers:
    empty, layers = _worked(after[1], initial, bad, cut)
    return after[0] + empty, layers


def _holds(place: Layers, cost: int, state: int | None) -> bool:
    """Can the rest be finished from the state for `cost`? Beyond the stored layers from any state."""
    d = cost - place[0]
    return state is not None and d >= 0 and (d >= SPREAD or bool(place[1] >> 4 * d & state))


def least_cost(place: Layers, state: int = START) -> int:
    return next(place[0] + d for d in range(SPREAD) if place[1] >> 4 * d & state)


class Trace:
    """The forward pass over one conversation: `turn` and `end` give (letter, role, text) of the edits in order."""

    def __init__(self, first: Layers) -> None:
        self.state, self.left = START, least_cost(first)

    def _insert(self) -> tuple[str, str, str]:
        name = "a" if self.state == AFTER_U else "u"
        self.state, self.left = _NEXT[self.state, name], self.left - INSERT
        return "I", _NAMES[name], ""

    def turn(self, here: Layers, after: Layers, role: str, text: str, bad: bool, cut: bool) -> Iterator[tuple[str, str, str]]:
        while True:
            name = "a" if self.state == AFTER_U else "u"
            then, kept = _NEXT[self.state, name], _NEXT.get((self.state, role[:1]))
            more = TRUNCATED * cut
            if _holds(after, self.left - DELETE, self.state):
                self.left -= DELETE
                yield "D", role, text
            elif _holds(here, self.left - INSERT, then):
                yield self._insert()
                continue
            elif not bad and _holds(after, self.left - more, kept):
                self.state, self.left = kept, self.left - more
                yield "K", role, text
            else:
                self.state, self.left = then, self.left - REROLE - more
                yield "R", _NAMES[name], text
            return

    def end(self) -> Iterator[tuple[str, str, str]]:
        while self.state not in (START, AFTER_A):
            yield self._insert()


# ---------------------------------------------------------------------- rows


def _spaced(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present) of a table of turns, damaged by the CRC-32 of `conv_id:turn` modulo 20.

    0: present is false, the turn is lost; 1: its text; 2: its stops; 3: it comes twice; 4: it becomes the user's.
    """
    fault = F.crc32(F.concat_ws(":", _spaced("conv_id"), _spaced("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(_spaced("text"), ".!?", "")).otherwise(_spaced("text"))
    role = F.when(fault == 4, "user").otherwise(_spaced("role"))
    copies = F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    out = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (fault != 0).alias("present"), F.explode(copies).alias("_copy"))
    gone = lambda c: F.when(F.col("present"), F.col(c)).otherwise("").alias(c)
    return out.select("conv_id", "turn", gone("role"), gone("text"), "present")


def turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present) of a table of turns as it is."""
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), _spaced("role").alias("role"), _spaced("text").alias("text"), F.lit(True).alias("present"))


_FIELDS = "turn long, role string, text string, present boolean, nth int, blank boolean, cut boolean"
_PLACES = "here long, here_layers long, after long, after_layers long"


def _backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the layers before and after each turn. Turns come from the last to the first of each conversation."""
    known: object = batches  # no conversation yet
    place = END
    for batch in batches:
        out: list[tuple[int, int, int, int]] = []
        columns = [batch[c].to_pylist() for c in ("conv_id", "role", "present", "nth", "blank", "cut")]
        for conv, role, present, nth, blank, cut in zip(*columns, strict=True):
            if conv != known:
                known, place = conv, END
            after = place
            if present:
                place = before_turn(after, role[:1], blank or nth > 1, cut)
            out.append((*place, *after))
        arrays = [pa.array(x, pa.int64()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 4
        yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, "here", "here_layers", "after", "after_layers"])


def _placed(rows: DataFrame) -> DataFrame:
    """Turns in order within their conversation, all of it in one partition, with faults and layers.

    One shuffle: the later sorts and the window need no other dealing, and all of them spill.
    """
    tune(rows.sparkSession)
    # an equal turn that came earlier: the window's key begins with the key of the shuffle, which so serves it too
    earlier = Window.partitionBy("conv_id", "present", "role", "text").orderBy(F.asc_nulls_first("turn"))
    rows = rows.repartition("conv_id").withColumn("nth", F.row_number().over(earlier))
    solid = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    rows = rows.withColumn("blank", solid == "").withColumn("cut", (solid != "") & ~F.right(solid, F.lit(1)).isin(".", "!", "?"))
    fields = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {_FIELDS}"
    backwards = rows.sortWithinPartitions("conv_id", F.desc_nulls_last("turn"), F.desc("role"), F.desc("text"), F.desc("nth"))
    placed = backwards.mapInArrow(_backwards, f"{fields}, {_PLACES}")
    return placed.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "nth")


_COLUMNS = ["conv_id", "turn", "role", "text", "present", "nth", "blank", "cut", "here", "here_layers", "after", "after_layers"]


class _Report:
    """What is told of one conversation, turn by turn."""

    def __init__(self, conv: object) -> None:
        self.conv, self.trace, self.least, self.last, self.different = conv, None, None, None, 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.before: str | None = None
        self.audit, self.digest, self.written = bytearray(), hashlib.sha256(), False

    def _write(self, edits: Iterator[tuple[str, str, str]]) -> None:
        for letter, role, text in edits:
            self.audit += letter.encode()
            if letter != "D":
                self.digest.update((f"\n{role}:{text}" if self.written else f"{role}:{text}").encode())
                self.written = True

    def turn(self, turn: int | None, role: str, text: str, nth: int, blank: bool, cut: bool, here: Layers, after: Layers) -> None:
        if self.trace is None:
            self.trace, self.cost = Trace(here), least_cost(here)
        if turn is not None and turn != self.last:
            self.least = turn if self.least is None else self.least
            self.last, self.different = turn, self.different + 1
        self.blank += blank
        self.duplicate += not blank and nth > 1
        self.truncated += not blank and nth == 1 and cut
        if self.before is not None:
            self.illegal += self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        # a repeated turn must go, so what it would cost as a truncated one is not asked
        self._write(self.trace.turn(here, after, role, text, blank or nth > 1, cut))

    def row(self) -> tuple:
        if self.trace is not None:
            self._write(self.trace.end())
        gaps = self.last - self.least + 1 - self.different if self.least is not None else 0
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, self.audit.decode(), self.digest.hexdigest()


_TOLD = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _streamed(rows: DataFrame, more: str, each: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """Runs `each` over a partition's rows in order; its tuples become rows of conv_id and `more`, in bounded batches."""
    names = ["conv_id", *[f.split()[0] for f in more.split(", ")]]
    kind = rows.schema["conv_id"].dataType
    schema = rows.sparkSession.createDataFrame([], f"conv_id {kind.simpleString()}, {more}").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fields = to_arrow_schema(schema)

        def read() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*[batch[c].to_pylist() for c in _COLUMNS], strict=True)

        def batch(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), fields, strict=True)], names)

        held, size = [], 0
        for row in each(read()):
            held.append(row)
            size += sum(len(v) for v in row if isinstance(v, str))
            if len(held) >= 1000 or size > 4 << 20:
                yield batch(held)
                held, size = [], 0
        if held:
            yield batch(held)

    return rows.mapInArrow(run, schema)


def _reports(rows: Iterator[tuple]) -> Iterator[tuple]:
    report: _Report | None = None
    for conv, turn, role, text, present, nth, blank, cut, here, here_layers, after, after_layers in rows:
        if report is None or report.conv != conv:
            if report is not None:
                yield report.row()
            report = _Report(conv)
        if present:
            report.turn(turn, role, text, nth, blank, cut, (here, here_layers), (after, after_layers))
    if report is not None:
        yield report.row()


def reports(rows: DataFrame) -> DataFrame:
    """A row for each conversation of `turns` or `damaged`: gaps, faults, illegal neighbours, cost, audit, digest of the repaired turns."""
    return _streamed(_placed(rows), _TOLD, _reports)


def _edits(rows: Iterator[tuple]) -> Iterator[tuple]:
    known: object = rows
    trace: Trace | None = None
    place = 0
    for conv, turn, role, text, present, nth, blank, cut, here, here_layers, after, after_layers in rows:
        if conv != known:
            for letter, name, said in trace.end() if trace else ():
                yield known, place, letter, name, said, None
                place += 1
            known, trace, place = conv, None, 0
        if present:
            trace = trace or Trace((here, here_layers))
            for letter, name, said in trace.turn((here, here_layers), (after, after_layers), role, text, blank or nth > 1, cut):
                yield conv, place, letter, name, said, turn if letter != "I" else None
                place += 1
    for letter, name, said in trace.end() if trace else ():
        yield known, place, letter, name, said, None
        place += 1


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations, a row for each turn (conv_id, place, edit, role, text, turn), and the deleted turns with edit D."""
    return _streamed(_placed(rows), "place long, edit string, role string, text string, turn long", _edits)
