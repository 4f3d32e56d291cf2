"""Aggregates of one's own with partial and merge steps, over Arrow batches: no group meets in a row or a task as a whole.

Each task folds its rows into one state for each key (and sends the states on when it holds many); states of a key meet after one
shuffle, sorted by key, and are merged one by one.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Iterator
from fractions import Fraction
from typing import Generic, TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame

S = TypeVar("S")
#: States that a task holds before it sends them on.
STATES = 50_000


class Aggregate(Generic[S]):
    """A rule: its input columns, the fields of its result, and the steps. States are turned into bytes between tasks."""

    inputs: list[str]
    result: str

    def zero(self) -> S:
        raise NotImplementedError

    def add(self, state: S, *values: object) -> S:
        raise NotImplementedError

    def merge(self, a: S, b: S) -> S:
        raise NotImplementedError

    def dump(self, state: S) -> bytes:
        raise NotImplementedError

    def load(self, raw: bytes) -> S:
        raise NotImplementedError

    def finish(self, state: S) -> tuple:
        raise NotImplementedError


def aggregate(rows: DataFrame, keys: list[str], rule: Aggregate, at_once: int = STATES) -> DataFrame:
    """(keys, the rule's result) of each group."""
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    n = len(keys)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, object] = {}
        types: list[pa.DataType] = []

        def told() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in states], types[i]) for i in range(n)]
            out = pa.RecordBatch.from_arrays([*columns, pa.array([rule.dump(s) for s in states.values()], pa.binary())], [*keys, "state"])
            states.clear()
            return out

        for batch in batches:
            types = [batch.schema.field(i).type for i in range(n)]
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                key = row[:n]
                states[key] = rule.add(states[key] if key in states else rule.zero(), *row[n:])
            if len(states) > at_once:
                yield told()
        if states:
            yield told()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple | None = None
        state = None
        held: list[tuple] = []
        fields: list[pa.Field] = []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), fields, strict=True)], [f.name for f in fields])
            held.clear()
            return out

        for part in batches:
            fields = [*[part.schema.field(i) for i in range(n)], *_fields(rule)]
            for *key, raw in zip(*[c.to_pylist() for c in part.columns], strict=True):
                if tuple(key) != known:
                    if known is not None:
                        held.append((*known, *rule.finish(state)))
                        if len(held) >= 1000:
                            yield batch()
                    known, state = tuple(key), rule.load(raw)
                else:
                    state = rule.merge(state, rule.load(raw))
        if known is not None:
            held.append((*known, *rule.finish(state)))
            yield batch()

    states = rows.select(*keys, *rule.inputs).mapInArrow(partial, f"{kinds}, state binary")
    return states.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merged, f"{kinds}, {rule.result}")


def _fields(rule: Aggregate) -> list[pa.Field]:
    types = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    return [pa.field(name, types[kind]) for name, kind in (f.split() for f in rule.result.split(", "))]


class PairedMeans(Aggregate[tuple]):
    """Means of a metric and of its cost over the records that have a finite metric, the cost of a point, and the record with the least metric.

    Sums are exact whole numbers of 2**-1074, so a result doesn't depend on how rows are dealt over tasks. The record is
    evidence for a reader: of several least ones that of the smallest id.
    """

    SCALE = 1074

    def __init__(self, metric: str, cost: str, key: str) -> None:
        self.inputs = [metric, cost, key]
        self.result = "n long, mean double, cost double, per_point double, worst double, worst_id long"

    def zero(self) -> tuple:
        return 0, 0, 0, None

    def _whole(self, x: float) -> int:
        a, b = x.as_integer_ratio()
        return (a << self.SCALE) // b

    def add(self, state: tuple, metric: float | None, cost: float | None, key: int) -> tuple:
        if metric is None or not math.isfinite(metric):
            return state
        n, total, costs, worst = state
        return n + 1, total + self._whole(metric), costs + self._whole(cost if cost and math.isfinite(cost) else 0.0), min(worst, (metric, key)) if worst else (metric, key)

    def merge(self, a: tuple, b: tuple) -> tuple:
        worst = min((w for w in (a[3], b[3]) if w), default=None)
        return a[0] + b[0], a[1] + b[1], a[2] + b[2], worst

    def dump(self, state: tuple) -> bytes:
        return repr(state).encode()

    def load(self, raw: bytes) -> tuple:
        return ast.literal_eval(raw.decode())

    def finish(self, state: tuple) -> tuple:
        n, total, costs, worst = state
        if not n:
            return 0, None, None, None, None, None
        of = lambda x, y: float(Fraction(x, y))
        return n, of(total, n << self.SCALE), of(costs, n << self.SCALE), of(costs, total) if total else None, worst[0], worst[1]
