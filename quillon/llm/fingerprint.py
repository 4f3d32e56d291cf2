"""Document fingerprints: bottom-k sketches of word-shingle hashes, in DataFrame functions only.

A sketch is the ascending array of the k smallest distinct hashes of a text's shingles. Sketches of parts
merge into the sketch of the whole (`merge`), and estimate resemblance, containment and the number of
distinct shingles.

Defined cases: null text counts as empty; a text without words has the empty sketch; a text of fewer words
than a shingle has one shingle, the whole sequence; two empty sketches are alike (1.0), an empty and a
non-empty one are not (0.0). Repeated rows, and rows of one id, are separate documents, which follow each other in the
order of their texts; rows without an id come before the smallest one (where all are without, the
first is followed by itself). Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import partitions

SHINGLE = 5
K = 128
#: Hashes are cut to this many bits, so that they print as 12 hexadecimal digits.
BITS = 48
SPACES = r"[\x20\t\n\x0B\f\r]+"


def _once(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACES), lambda w: w != "")


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """The bottom-k sketch of a text column: array<bigint>, ascending."""

    def hashes(w: Column) -> Column:
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.greatest(F.size(w) - (shingle - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, F.lit(shingle))).bitwiseAND(F.lit((1 << BITS) - 1)))

    return bottom(_once(words(text), hashes), k)


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together (shingles across the cut excepted)."""
    return bottom(F.concat(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: of the k smallest hashes of the union, the share found in both."""
    union = merge(a, b, k)
    both = F.array_intersect(a, b)
    share = _once(union, lambda u: F.size(F.array_intersect(u, both)) / F.size(u))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(share)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * float(1 << BITS) / F.element_at(a, k))


def containment(a: Column, b: Column, j: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too, from their resemblance j."""
    whole = distinct_shingles(a, k)
    shared = j / (1 + j) * (whole + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / whole))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), BITS // 4, "0")), "")


#: Equal steps of ids for each range: a row is compared with the ranges that touch its step.
STEPS = 16


def id_ranges(ids: DataFrame, n: int) -> tuple[DataFrame, Callable[[Column], Column]]:
    """(r, low, high, step), and the step of an id, of about n ranges of equal counts: r holds the ids above low (null: none below) up to high, and has a row for each step it touches.

    What the driver sees of the ids is n cuts; the table has at most n * (STEPS + 2) rows. Null ids belong to the first range.
    """
    spark = ids.sparkSession
    shares = [(i + 1) / n for i in range(n - 1)]
    found = ids.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.percentile_approx("doc_id", shares, 100 * n).alias("cuts")).first()
    if found["high"] is None:
        return spark.createDataFrame([(0, None, None, -1)], "r int, low long, high long, step long"), lambda _: F.lit(-1).cast("long")
    highs = sorted({*(found["cuts"] or []), found["high"]})
    rows = [(r, highs[r - 1] if r else None, high) for r, high in enumerate(highs)]
    width = max(1.0, (float(found["high"]) - float(found["low"])) / (n * STEPS))
    low = F.coalesce("low", F.lit(found["low"]))
    at = lambda c: F.floor((c.cast("double") - F.lit(float(found["low"]))) / F.lit(width)).cast("long")
    ranges = spark.createDataFrame(rows, "r int, low long, high long").withColumn("step", F.explode(F.sequence(at(low), at(F.col("high")))))
    return ranges, at


def edited_fingerprints(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprints of every text and of its edited form, with their likeness and that to the next document.

    The edited text has its last floor(n/2) code points replaced by the first as many of the next document
    in descending doc_id (the largest smaller id; the smallest is followed by the largest). Rows of equal
    doc_id follow in the order of their texts. Texts move once: rows are dealt by id range, found by a broadcast join on
    steps of ids, and the last document of a range is dealt to the next range too, where it only serves as neighbour.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    ranges, step = id_ranges(ids, 4 * partitions(spark))
    placed = F.broadcast(ranges)  # at most 4 * partitions * (STEPS + 2) rows
    inside = (step(F.col("doc_id")) == F.col("step")) & F.coalesce(F.col("doc_id") > F.col("low"), F.lit(True)) & (F.col("doc_id") <= F.col("high"))
    in_range = lambda df: df.join(placed, inside, "left").withColumn("r", F.coalesce("r", F.lit(0))).drop("low", "high", "step")
    # one row per range that holds any id: its last id serves the next such range, and the largest id of all serves the first
    last = in_range(ids).groupBy("r").agg(F.max("doc_id").alias("lend_id")).where("lend_id is not null")
    lends = last.withColumn("lend_r", F.coalesce(F.lead("r").over(Window.orderBy("r")), F.first("r").over(Window.orderBy("r")))).drop("r")
    own = F.struct(F.col("r"), F.lit(False).alias("lent"))
    rows = in_range(rows).join(F.broadcast(lends), F.col("doc_id") == F.col("lend_id"), "left")  # at most one row per range
    lent = F.when(F.col("lend_r").isNotNull(), F.array(own, F.struct(F.col("lend_r").alias("r"), F.lit(True).alias("lent")))).otherwise(F.array(own))
    rows = rows.select("doc_id", "text", F.explode(lent).alias("at")).select("doc_id", "text", "at.r", "at.lent")
    order = Window.partitionBy("r").orderBy(F.desc("lent"), "doc_id", "text")
    rows = rows.select("*", F.coalesce(F.lag("text").over(order), F.col("text")).alias("next_text"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", "r", "lent", "text", n.cast("long").alias("n_chars"), edited.alias("edited"))
    rows = rows.select(
        "doc_id", "r", "lent", "text", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        sketch(F.col("text"), k, shingle).alias("own"), sketch(F.col("edited"), k, shingle).alias("other"),
    )
    rows = rows.select("*", F.coalesce(F.lag("own").over(order), F.col("own")).alias("next")).where(~F.col("lent"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("other"), k).alias("near_edited"), resemblance(F.col("own"), F.col("next"), k).alias("near_next"),
        distinct_shingles(F.col("own"), k).alias("distinct_shingles"),
    )
