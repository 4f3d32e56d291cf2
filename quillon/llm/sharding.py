"""Sharding along a Hilbert curve, in DataFrame functions only.

Metadata dimensions (language, size, source) are quantised to the same number of bits and folded into one curve
index. Rows sorted by it are near each other in every dimension, so a run of them has narrow ranges of each, and
readers can skip files by their column statistics.

Law: `rows`. The sorted rows are cut into runs whose counts differ by at most one. Equal texts are a group: all its rows
take the language and source of its row of the smallest doc_id, so that they stand next to each other, and a
group spans more shards than one only where a cut falls into it.

Defined cases: a null text counts as empty; repeated rows are separate; null ids come first in their group; a table
without lang or source has null there; an empty table gives no rows; other columns are ignored, and
kept by `write_shards`, but for columns of its own names shard and slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import global_rank, materialize

BITS = 10
OVERHEAD = 16


def _bits_set(x: Column, mask: Column) -> Column:
    return x.bitwiseAND(mask) != 0


def hilbert_index(dims: list[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve of the point whose coordinates are `dims`, each in 0 .. 2**bits - 1.

    The rotations and reflections of the curve are undone bit by bit from the highest, in a fold whose state
    is the array of coordinates; the Gray code of what is left, interleaved, is the index.
    """
    n = len(dims)
    point = F.array(*[d.cast("long") for d in dims])
    # one step for each bit above the lowest, from the highest, and for each dimension
    steps = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def undo(x: Column, step: Column) -> Column:
        low = step["q"] - 1
        first, here = F.element_at(x, 1), F.element_at(x, step["i"] + 1)
        swap = F.when(_bits_set(here, step["q"]), F.lit(0).cast("long")).otherwise(first.bitwiseXOR(here).bitwiseAND(low))
        flip = F.when(_bits_set(here, step["q"]), low).otherwise(swap)
        return F.transform(x, lambda v, j: F.when((j == 0) & (step["i"] == 0), v.bitwiseXOR(flip)).when(j == 0, v.bitwiseXOR(flip)).when(j == step["i"], v.bitwiseXOR(swap)).otherwise(v))

    turned = F.aggregate(steps, point, undo) if bits > 1 else point
    # Gray code: each coordinate takes in the one before it
    zero = F.array().cast("array<bigint>")
    gray = F.aggregate(turned, zero, lambda done, v: F.concat(done, F.array(v.bitwiseXOR(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0).cast("long"))))))

    def finish(x: Column) -> Column:
        tail = F.aggregate(
            F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)]) if bits > 1 else zero,
            F.lit(0).cast("long"),
            lambda t, q: F.when(_bits_set(F.element_at(x, n), q), t.bitwiseXOR(q - 1)).otherwise(t),
        )
        places = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i + 1).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
        return F.aggregate(
            places,
            F.struct(F.lit(0).cast("long").alias("h"), tail.alias("t")),
            lambda s, p: F.struct(
                (s["h"] * 2 + F.when(_bits_set(F.element_at(x, p["i"]).bitwiseXOR(s["t"]), F.pow(F.lit(2), p["b"]).cast("long")), 1).otherwise(0)).cast("long").alias("h"),
                s["t"].alias("t"),
            ),
            lambda s: s["h"],
        )

    return F.element_at(F.transform(F.array(gray), finish), 1)


def log_bucket(x: Column, bits: int = BITS, per_doubling: int = 32) -> Column:
    """Quantises a positive number on a logarithmic scale, `per_doubling` steps for each doubling."""
    return F.least(F.floor(F.log2(F.greatest(x, F.lit(1))) * per_doubling), F.lit((1 << bits) - 1)).cast("int")


def name_bucket(x: Column, bits: int = BITS) -> Column:
    """A place for a name that needs no statistics: the high bits of its CRC."""
    return F.shiftright(F.crc32(F.coalesce(x, F.lit("")).cast("binary")), 32 - bits).cast("int")


def _placed(docs: DataFrame, n_shards: int, bits: int, carried: list[Column]) -> DataFrame:
    """Rows with size, text_crc32, curve, shard and slot, and with `carried`."""
    raw = F.coalesce("text", F.lit("")).cast("binary")
    name = lambda c: (F.col(c) if c in docs.columns else F.lit(None)).cast("string").alias(c)
    rows = docs.select("doc_id", name("lang"), name("source"), (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("u"), *carried)
    rows = materialize(rows, "sized")
    first = F.min(F.struct("doc_id", "lang", "source"))
    # written tables on both sides of the join: Spark can split a hot group's rows
    groups = materialize(rows.groupBy("u").agg(first.alias("m")), "equal-texts")
    total = rows.count()
    rows = rows.join(groups.hint("merge"), "u")
    dims = [name_bucket(F.col("m.lang"), bits), log_bucket(F.col("size"), bits), name_bucket(F.col("m.source"), bits)]
    rows = rows.withColumn("curve", hilbert_index(dims, bits)).drop("m")
    order = [F.col(c) for c in ("curve", "text_crc32", "u", "size", "doc_id")]
    ranked = global_rank(rows, order, "rank", "shards")
    # shard s holds the ranks from ceil(s * total / n_shards) on
    shard = F.expr(f"(rank * {n_shards}L) div {max(total, 1)}L").cast("int")
    first = F.expr(f"(shard * {max(total, 1)}L + {n_shards - 1}L) div {n_shards}L")
    return ranked.withColumn("shard", shard).withColumn("slot", (F.col("rank") - first).cast("long")).drop("rank", "u")


def shards(docs: DataFrame, n_shards: int, bits: int = BITS) -> DataFrame:
    """Deals all rows to shards 0 .. n_shards - 1 in runs along the curve over language, size and source."""
    placed = _placed(docs, n_shards, bits, [])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, n_shards: int, path: str, bits: int = BITS) -> None:
    """Writes all rows and columns of `docs` in one folder per shard, in slot order. Rows are carried along, so ids may be null or repeat."""
    placed = _placed(docs, n_shards, bits, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")])
    dealt = placed.select("shard", "slot", "row").repartition(n_shards, "shard").sortWithinPartitions("shard", "slot")
    columns = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("shard", "slot")]
    dealt.select("shard", "slot", *columns).write.partitionBy("shard").parquet(path)
