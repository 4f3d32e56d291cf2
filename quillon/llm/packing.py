"""Packing documents into sequences of a fixed length by cutting-stock column generation.

Token lengths are rounded up to a grid of `capacity / GRID` steps. A linear program over the histogram of
rounded lengths finds how often each pattern (a set of lengths that fit one sequence) is used; patterns are
generated by a knapsack dynamic program that prices them with the program's duals. Patterns are used a whole
number of times, rounded down; what that leaves is packed first-fit decreasing. Documents are ranked by length
and handed to the patterns' places by rank. Only the histogram, of at most GRID rows, comes to the driver.

Documents longer than a sequence are cut: full sequences first, the rest is packed like a short document.

Defined cases: null text counts as empty; every document has at least the end id, so no document is lost;
repeated rows are packed each; columns other than doc_id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm import bpe
from quillon.llm.common import global_rank, materialize, release, tune

GRID = 256
END_ID = 2
MAX_COLUMNS = 4000
GAP = 1e-3


def tokenized_pieces(docs: DataFrame, vocabulary: str, capacity: int) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's ids and end id, cut at multiples of capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        tables = bpe.load(vocabulary)
        for batch in batches:
            ids, at = tables.encode(["" if t is None else t for t in batch["text"].to_pylist()])
            rows: list[tuple[int, int, int, int, int]] = []
            for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                own = np.append(ids[a:b], np.uint32(END_ID)).astype("<u4", copy=False)
                rows += [(k, s, min(capacity, len(own) - s), zlib.crc32(own[s : s + capacity].tobytes()), len(own)) for s in range(0, len(own), capacity)]
            cols = np.array(rows, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(cols[:, 0])), *(pa.array(cols[:, c]) for c in range(1, 5))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    tune(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def price(duals: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The pattern of the highest dual value that fits `room`: an unbounded knapsack by dynamic programming."""
    best, taken = np.zeros(room + 1), np.full(room + 1, -1)
    fits = np.searchsorted(sizes, np.arange(room + 1), "right")  # sizes ascend
    for c in range(int(sizes[0]), room + 1):
        k = fits[c]
        value = best[c - sizes[:k]] + duals[:k]
        i = value.argmax()
        if value[i] > best[c - 1] + 1e-12:
            best[c], taken[c] = value[i], i
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            pattern[taken[c]] += 1
            c -= sizes[taken[c]]
    return best[room], pattern


def column_generation(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often each is used in the optimum of the linear program: cover the demand with fewest sequences.

    Revised simplex: starts from one pattern per size, keeps the inverse of the basis, and lets in the
    pattern that pricing finds. If the best pattern is worth v sequences, the optimum is at least 1/v of the
    present value, so it ends within GAP of the optimum.
    """
    m = len(sizes)
    basis = np.diag(room // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(basis))
    used = inverse @ demand
    for _ in range(MAX_COLUMNS):
        value, column = price(inverse.sum(0), sizes, room)
        if value <= 1 + GAP:
            break
        step = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, used / step, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        used = np.maximum(used - ratio[out] * step, 0)
        used[out] = ratio[out]
        basis[:, out] = column
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
    return basis.astype(np.int64), used


def plan(sizes: list[int], demand: list[int], room: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (size, first, count, sequence, copies, place) that deal `demand` pieces of each size to sequences.

    Of a size, the pieces ranked first .. first + count - 1 go to sequences from `sequence` on, `copies` in each,
    at places from `place` on within their sequence.
    """
    s, d = np.array(sizes, np.int64), np.array(demand, np.int64)
    patterns, used = column_generation(s, d.astype(float), room)
    left, runs, sequence, given = d.copy(), [], 0, np.zeros(len(s), np.int64)

    def use(pattern: np.ndarray, times: int) -> None:
        nonlocal sequence
        place = 0
        for i in np.flatnonzero(pattern)[::-1]:
            count = int(min(times * pattern[i], left[i]))
            if count:
                runs.append((int(s[i]), int(given[i]), count, sequence, int(pattern[i]), place))
                given[i] += count
                left[i] -= count
            place += int(pattern[i])
        sequence += times

    for p in np.argsort(-used):
        if times := int(used[p] + 1e-6):
            use(patterns[:, p], times)
    # first-fit decreasing for the rest: bounded by the patterns, not by the documents
    open_room: list[int] = []
    open_pattern: list[np.ndarray] = []
    for i in np.argsort(-s):
        for _ in range(int(left[i])):
            for k, r in enumerate(open_room):
                if r >= s[i]:
                    break
            else:
                open_room.append(room)
                open_pattern.append(np.zeros(len(s), np.int64))
                k = len(open_room) - 1
            open_room[k] -= int(s[i])
            open_pattern[k][i] += 1
    for pattern in open_pattern:
        use(pattern, 1)
    return runs


def pack(pieces: DataFrame, capacity: int, grid: int = GRID) -> DataFrame:
    """Adds sequence_id and offset to pieces with a `length` of 1 .. capacity."""
    spark = pieces.sparkSession
    unit = -(-capacity // grid)
    sized = pieces.withColumn("_size", F.ceil(F.col("length") / unit).cast("int"))
    ranked = global_rank(sized, [F.col(c) for c in ("_size", "doc_id", "start", "ids_crc32")], "_rank", "packing")
    histogram = sorted((r["_size"], r["count"]) for r in ranked.groupBy("_size").count().collect())  # at most `grid` rows
    runs = plan([s for s, _ in histogram], [n for _, n in histogram], capacity // unit) if histogram else []
    first, at = {}, 0
    for size, n in histogram:
        first[size], at = at, at + n
    rows = [(size, first[size] + begin, first[size] + begin + count, seq, copies, place) for size, begin, count, seq, copies, place in runs]
    dealt = spark.createDataFrame(rows, "_run_size int, _from long, _to long, _seq long, _copies long, _place long")
    here = (F.col("_size") == F.col("_run_size")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    placed = ranked.join(F.broadcast(dealt), here)  # patterns times sizes at most
    nth = F.col("_rank") - F.col("_from")
    placed = placed.withColumn("sequence_id", F.col("_seq") + F.floor(nth / F.col("_copies"))).withColumn("_at", F.col("_place") + nth % F.col("_copies"))
    before = Window.partitionBy("sequence_id").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    return placed.drop("_size", "_rank", "_run_size", "_from", "_to", "_seq", "_copies", "_place", "_at")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 4096) -> DataFrame:
    pieces = materialize(tokenized_pieces(docs, vocabulary, capacity), "pieces")
    return pack(pieces, capacity).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
