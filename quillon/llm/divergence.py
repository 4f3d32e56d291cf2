"""Audit of how sources diverge in their use of words, in exact integers.

Each language keeps the terms that LEAST_DOCS or more of its documents hold. A (language, source) group, and each language,
gives a kept term the smoothed share p = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)). Two reports:

* `pair`: how far the sources of a language are apart, the sum of |p - p'| over all kept terms. Most counts are 0, and such a term
  has one share in all of a group, its baseline. So V times the difference of two baselines is corrected by the terms that
  one of the two does use; what neither uses is never visited. Sources meet in blocks, terms in buckets, and a task adds up
  one block against another before it sends anything.
* `term`: the terms by which a group exceeds its language most, to rank TOP. Radix selection: histograms over the bits of
  the values, from the highest, find the value at each group's last rank; where it is tied, histograms over the UTF-8 bytes of the
  terms find the last term. Only the rows up to there are sorted.

Terms are runs of ASCII letters (A-Z lowered) and of all characters beyond ASCII. Defined cases: null text, lang and source count as
''; a language without kept terms has pairs of value 0 and no terms; repeated rows count each; an empty table gives no rows;
columns other than text, lang and source are ignored, and lang or source may be missing (then '').
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import global_rank, materialize, tune

LEAST_DOCS = 30
SCALE = 1_000_000_000
PRIOR = 5
TOP = 50
#: Entries that a task counts before it sends them on.
ENTRIES = 200_000
#: Sources in a block, terms in a bucket; bits and bytes of one step of selection.
SOURCES = 128
TERMS = 64
BITS = 10
BYTES = 2

_BLANK = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode().translate(_BLANK).split(b" ")


def counted(docs: DataFrame, at_once: int = ENTRIES) -> DataFrame:
    """(lang, source, term, n, docs): occurrences in a group and documents that hold the term; term is null in a row that every group has."""
    tune(docs.sparkSession)
    name = lambda c: (F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")).alias(c)
    rows = docs.select(name("lang"), name("source"), name("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, held) in groups.items():
                keys = [*n]
                size = len(keys) + 1
                names = pa.array([None, *keys], pa.binary()).cast(pa.string())
                sums = [pa.array([0, *c.values()], pa.int64()) for c in (n, Counter({k: held[k] for k in keys}))]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * size), pa.array([source] * size), names, *sums], ["lang", "source", "term", "n", "docs"])
            groups.clear()

        entries = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, held = groups.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                own = Counter(terms(text))
                own.pop(b"", None)
                n.update(own)
                held.update(own.keys())
                entries += len(n) - before
            if entries > at_once:
                yield from told()
                entries = 0
        yield from told()

    parts = rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, v: str) -> Column:
    """p of a count: exact for any count, as decimals."""
    whole = lambda x: f"CAST({x} AS DECIMAL(20, 0))"
    return F.expr(f"CASE WHEN {v} = 0 THEN 0L ELSE 1L + CAST({SCALE} AS DECIMAL(10, 0)) * {whole(f'{n} + {PRIOR}')} DIV {whole(f'{total} + {PRIOR} * {v}')} END")


def shares(docs: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """Groups (lang, source, v, place, b: baseline) and postings (lang, source, term, v, place, b, p, q) of kept terms with a count above 0.

    `place` numbers the sources of a language from 0 in order. Both are written tables.
    """
    counts = materialize(counted(docs), "counts")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("d"), F.sum("n").alias("all_n")).where(F.col("d") >= least_docs)
    kept = materialize(kept.drop("d"), "kept")
    # one row for each language, and for each group
    langs = materialize(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all_n").alias("lang_n")), "langs")
    used = materialize(counts.where("term is not null").drop("docs").join(kept, ["lang", "term"]), "used")
    sums = used.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = counts.where("term is null").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["group_n", "v", "lang_n"])
    ranked = global_rank(groups, [F.col("lang"), F.col("source")], "_rank", "groups")
    first = ranked.groupBy("lang").agg(F.min("_rank").alias("_first"))
    groups = ranked.join(first, "lang").withColumn("place", F.col("_rank") - F.col("_first")).drop("_rank", "_first")
    groups = materialize(groups.withColumn("b", share("0", "group_n", "v")), "groups")
    postings = used.join(groups, ["lang", "source"]).withColumns({"p": share("n", "group_n", "v"), "q": share("all_n", "lang_n", "v")})
    return groups.select("lang", "source", "v", "place", "b"), materialize(postings.select("lang", "source", "term", "v", "place", "b", "p", "q"), "postings")


# ---------------------------------------------------------------------- top ranks by radix selection


def _chosen(histogram: DataFrame, group: list[str], step: Column) -> DataFrame:
    """Of each group's steps, with k rows each, the one that holds the last rank in need: with what is in need of it."""
    w = Window.partitionBy(*group).orderBy(step)
    cum = histogram.withColumn("up_to", F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("ends", F.lead("k").over(w).isNull())
    here = (F.col("up_to") >= F.col("need")) | F.col("ends")  # the last step, where the group has fewer rows than asked for
    found = cum.where(here).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return found.withColumn("need", F.col("need") - F.col("up_to") + F.col("k")).drop("up_to", "ends", "_n")


def top_ranks(rows: DataFrame, group: list[str], value: str, item: str, k: int, name: str) -> DataFrame:
    """The first k rows of each group by value (long, from 0 up), descending, then by the UTF-8 bytes of `item`, with `rank` from 1.

    `rows` should be a written table: each step reads it again, and sends a histogram of at most 2**BITS, or 256**BYTES, entries
    for each group. No group's rows meet in one task, but for the k that are ranked. Rows equal in group, value and item
    are ranked in any order among each other.
    """
    top = rows.agg(F.max(value)).first()[0]
    if top is None:
        return rows.withColumn("rank", F.lit(0))
    steps = max(1, -(-top.bit_length() // BITS))
    state = None
    for s in reversed(range(steps)):
        here = rows if state is None else rows.join(state, group).where(F.shiftright(value, BITS * (s + 1)) == F.col("bound"))
        digit = F.shiftright(value, BITS * s).bitwiseAND(F.lit((1 << BITS) - 1)).alias("digit")
        held = [F.lit(0).cast("long").alias("bound"), F.lit(k).cast("long").alias("need")] if state is None else [F.col("bound"), F.col("need")]
        counts = here.select(*group, digit, *held).groupBy(*group, "digit", "bound", "need").agg(F.count(F.lit(1)).alias("k"))
        picked = _chosen(counts, group, F.desc("digit"))
        state = materialize(picked.select(*group, F.shiftleft("bound", BITS).bitwiseOR(F.col("digit")).alias("bound"), "need", "k"), f"{name}-bits")
        state = state if s == 0 else state.drop("k")
    # groups whose ties at the bound are more than are in need: bytes decide, a few at a time
    empty = F.lit(b"").cast("binary")
    done = state.where("k <= need").select(*group, "bound", empty.alias("prefix"), F.lit(False).alias("whole"))
    tied, at = state.where("k > need").withColumn("prefix", empty), 1
    raw = F.col(item).cast("binary")
    while not tied.isEmpty():
        here = rows.join(tied.drop("k"), group).where((F.col(value) == F.col("bound")) & (F.substring(raw, 1, at - 1) == F.col("prefix")))
        counts = here.groupBy(*group, "bound", "need", "prefix", F.substring(raw, at, BYTES).alias("piece")).agg(F.count(F.lit(1)).alias("k"))
        picked = _chosen(counts, group, F.asc("piece"))
        state = materialize(picked.select(*group, "bound", "need", "k", F.concat("prefix", "piece").alias("prefix"), (F.length("piece") < BYTES).alias("whole")), f"{name}-bytes")
        over = (F.col("k") <= F.col("need")) | F.col("whole")
        done = done.unionByName(state.where(over).select(*done.columns))
        tied, at = state.where(~over).drop("whole"), at + BYTES
    ends = materialize(done, f"{name}-ends")
    kept = rows.join(ends, group)
    tie = F.col("whole") & (raw <= F.col("prefix")) | ~F.col("whole") & ((F.length("prefix") == 0) | (F.substring(raw, F.lit(1), F.length("prefix")) <= F.col("prefix")))
    kept = kept.where((F.col(value) > F.col("bound")) | (F.col(value) == F.col("bound")) & tie).select(*rows.columns)
    place = Window.partitionBy(*group).orderBy(F.desc(value), item)  # k rows in a group
    return kept.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


# ---------------------------------------------------------------------- pairs


def _corrected(sums: np.ndarray, apart: np.ndarray, bases: list[np.ndarray], used: list[tuple[int, int]], met: list[tuple[int, int]]) -> None:
    """Adds one term: sources that use it (place, share) against all columns, the other rows against columns that use it, each less what the baselines give."""
    row, column = bases[0].copy(), bases[1].copy()
    i, p = np.array(used, np.int64).reshape(-1, 2).T
    j, q = np.array(met, np.int64).reshape(-1, 2).T
    row[i], column[j] = p, q
    sums[i] += np.abs(row[i, None] - column) - apart[i]
    rest = np.delete(np.arange(len(row)), i)
    sums[np.ix_(rest, j)] += np.abs(row[rest, None] - column[j]) - apart[np.ix_(rest, j)]


def _block_sums(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up blocks of `size` sources against each other, over rows sorted by the blocks, bucket, kind and term.

    A bucket opens with a row for each of its blocks: the baselines of its sources. In bucket 0 these count, V times.
    """
    names = ["lang", "bi", "bj", "bucket", "kind", "term", "place", "p", "v", "bases"]
    key = term = None
    bases: list[np.ndarray] = []
    used: list[tuple[int, int]] = []
    met: list[tuple[int, int]] = []
    first = False

    def told() -> pa.RecordBatch:
        lang, bi, bj = key
        i, j = np.nonzero(np.ones_like(sums) if first else sums)
        if bi == bj:
            i, j = i[i < j], j[i < j]
        columns = [pa.array([lang] * len(i), pa.string()), pa.array(i + bi * size), pa.array(j + bj * size), pa.array(sums[i, j])]
        return pa.RecordBatch.from_arrays(columns, ["lang", "i", "j", "value"])

    for batch in batches:
        for lang, bi, bj, bucket, kind, name, place, p, v, opened in zip(*(batch[c].to_pylist() for c in names), strict=True):
            if term is not None and name != term:
                _corrected(sums, apart, bases, used, met)
                term, used, met = None, [], []
            if (lang, bi, bj) != key:
                if key is not None:
                    yield told()
                key, bases, first = (lang, bi, bj), [], False
            if kind == 0:
                if len(bases) < 2:
                    bases += [np.array(opened, np.int64)] * (1 + (bi == bj))
                    if len(bases) == 2:
                        apart = np.abs(bases[0][:, None] - bases[1])
                        sums = np.zeros_like(apart)
                if bucket == 0 and place == bj:
                    sums += v * apart
                    first = True
                continue
            term = name
            if place // size == bi:
                used.append((place % size, p))
            if place // size == bj:
                met.append((place % size, p))
    if term is not None:
        _corrected(sums, apart, bases, used, met)
    if key is not None:
        yield told()


def pairs(groups: DataFrame, postings: DataFrame, size: int = SOURCES, terms_each: int = TERMS) -> DataFrame:
    """(lang, source, item, value) of every two sources of a language, in both directions."""
    block = lambda c: F.floor(F.col(c) / size).cast("long")
    buckets = lambda v: F.greatest(F.ceil(v / terms_each), F.lit(1)).cast("long")
    # baselines of a block, in order of place: at most `size` of them
    blocks = groups.groupBy("lang", "v", block("place").alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "b"))), lambda x: x["b"]).alias("bases"))
    blocks = materialize(blocks, "blocks")
    n_blocks = materialize(blocks.groupBy("lang").agg((F.max("block") + 1).alias("n_blocks")), "n-blocks")
    other = lambda df: df.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1))).withColumns({"bi": F.least("block", "_o"), "bj": F.greatest("block", "_o")})
    none = F.lit(None)
    opening = other(blocks.join(n_blocks, "lang")).withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), buckets(F.col("v")) - 1)))
    opening = opening.select("lang", "bi", "bj", "bucket", F.lit(0).alias("kind"), none.cast("string").alias("term"), F.col("block").alias("place"), none.cast("long").alias("p"), "v", "bases")
    used = other(postings.withColumn("block", block("place")).join(n_blocks, "lang")).withColumn("bucket", F.pmod(F.xxhash64("term"), buckets(F.col("v"))))
    used = used.select("lang", "bi", "bj", "bucket", F.lit(1).alias("kind"), "term", "place", "p", "v", none.cast("array<bigint>").alias("bases"))
    order = ["lang", "bi", "bj", "bucket"]
    dealt = materialize(opening.unionByName(used), "met").repartitionByRange(*order).sortWithinPartitions(*order, "kind", "term", "place")
    parts = dealt.mapInArrow(functools.partial(_block_sums, size), "lang string, i long, j long, value long")
    total = parts.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    both = total.select("lang", "value", F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("e")).select("lang", "value", "e.i", "e.j")
    name = lambda c, to: groups.select("lang", F.col("place").alias(c), F.col("source").alias(to))
    return both.join(name("i", "source"), ["lang", "i"]).join(name("j", "item"), ["lang", "j"]).select("lang", "source", "item", "value")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """Both reports: lang, source, part, item, value, rank."""
    groups, postings = shares(docs, least_docs)
    over = materialize(postings.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")), "over")
    best = top_ranks(over, ["lang", "source"], "value", "item", top, "terms")
    # all ranks: rows sorted over all groups, numbered from each group's first
    ranked = global_rank(pairs(groups, postings), [F.col("lang"), F.col("source"), F.desc("value"), F.col("item")], "_rank", "pairs")
    ranked = materialize(ranked, "ranked-pairs")
    first = materialize(ranked.groupBy("lang", "source").agg(F.min("_rank").alias("_first")), "first-pairs")
    ranked = ranked.join(first, ["lang", "source"]).withColumn("rank", F.col("_rank") - F.col("_first") + 1)
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return columns(ranked, "pair").unionByName(columns(best, "term"))
