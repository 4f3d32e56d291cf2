"""Replies that arrive in pieces: the text of one JSON string field, decoded as far as it has come."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Short escapes of JSON (fixed values).
ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
#: A whole unit of a JSON string: a run of plain characters, or one escape. What matches none is not whole yet, or the end.
UNIT = re.compile(r'[^"\\]+|\\u[0-9a-fA-F]{4}|\\u(?=.{4})....|\\[^u]', re.S)
BEFORE, WITHIN, AFTER = 0, 1, 2


def decoded(unit: str) -> str:
    if unit[0] != "\\":
        return unit
    if unit[1] == "u":
        return chr(int(unit[2:], 16)) if re.fullmatch(r"[0-9a-fA-F]{4}", unit[2:]) else unit[2:]
    return ESCAPES.get(unit[1], unit[1])


def advance(phase: int, rest: str, piece: str, field: str) -> tuple[int, str, str]:
    """(phase, what is kept for later, text gained) after a further piece. Only what can't be decoded yet is kept."""
    rest += piece
    if phase == BEFORE:
        opened = re.search(rf'"{re.escape(field)}"\s*:\s*"', rest)
        if not opened:
            return BEFORE, rest, ""
        phase, rest = WITHIN, rest[opened.end() :]
    if phase == AFTER:
        return AFTER, "", ""
    out, at = [], 0
    while unit := UNIT.match(rest, at):
        out.append(decoded(unit[0]))
        at = unit.end()
    if rest[at : at + 1] == '"':
        return AFTER, "", "".join(out)
    return WITHIN, rest[at:], "".join(out)


def decode_stream(pieces: DataFrame, field: str = "answer") -> DataFrame:
    """(reply, seq, text, done) of pieces (reply, seq, piece): the text each piece adds to the field of its reply.

    The state of a reply is its phase and the few characters that are not whole yet. Pieces of a reply have to
    arrive in the order of seq; within one batch they are sorted.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        phase, rest = state.get if state.exists else (BEFORE, "")
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, piece in zip(rows["seq"], rows["piece"], strict=True):
            phase, rest, text = advance(phase, rest, piece or "", field)
            out.append((key[0], seq, text, phase == AFTER))
        state.update((phase, rest))
        yield pd.DataFrame(out, columns=["reply", "seq", "text", "done"])

    kinds = dict(pieces.dtypes)
    return pieces.groupBy("reply").applyInPandasWithState(step, f"reply {kinds['reply']}, seq long, text string, done boolean", "phase int, rest string", "append", GroupStateTimeout.NoTimeout)


def decode_batch(pieces: DataFrame, field: str = "answer") -> DataFrame:
    """The same over a finished table: pieces are dealt by reply and sorted, and a task holds one reply's state."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reply, phase, rest = object(), BEFORE, ""
        for df in batches:
            out = []
            for r, seq, piece in zip(df["reply"], df["seq"], df["piece"], strict=True):
                if r != reply:
                    reply, phase, rest = r, BEFORE, ""
                phase, rest, text = advance(phase, rest, piece or "", field)
                out.append((r, seq, text, phase == AFTER))
            yield pd.DataFrame(out, columns=["reply", "seq", "text", "done"])

    rows = pieces.select("reply", "seq", "piece").repartition("reply").sortWithinPartitions("reply", "seq")
    return rows.mapInPandas(fold, f"reply {dict(pieces.dtypes)['reply']}, seq long, text string, done boolean")
