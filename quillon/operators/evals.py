"""The evaluation algebra: retrieval and answer metrics per question, and their aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import ancestors, hash_bucket

CUTS = (1, 5, 10)
#: Of the percentiles that bracket a rank.
ACCURACY = 1000


def retrieval_metrics(gold: DataFrame, ranked: DataFrame, tree: DataFrame | None = None, paths: bool = False) -> DataFrame:
    """Per question recall@k, hit@k and reciprocal rank. gold: (qid, gold); ranked: (qid, rank, pid).

    A gold id is found where it, or with a tree (id, ancestor) one below it, is covered; with paths, ids tell themselves what
    encloses them. Questions without gold have no row.
    """
    if paths:  # gold and all that a ranked id lies in meet in one shuffle by question
        covered = ranked.select("qid", F.explode(ancestors(F.col("pid"))).alias("gold"), "rank", F.lit(False).alias("asked"))
        both = gold.select("qid", "gold", F.lit(None).cast(dict(ranked.dtypes)["rank"]).alias("rank"), F.lit(True).alias("asked")).unionByName(covered)
        found = both.repartition("qid").groupBy("qid", "gold").agg(F.min("rank").alias("first"), F.bool_or("asked").alias("asked")).where("asked")
        return _recalls(found)
    reach = gold.select("qid", "gold", F.col("gold").alias("pid"))
    if tree is not None:
        below = gold.join(tree.select(F.col("id").alias("pid"), F.col("ancestor").alias("gold")), "gold").select("qid", "gold", "pid")
        reach = reach.unionByName(below).distinct()  # ids outside the tree, such as rows, find themselves
    found = reach.join(ranked, ["qid", "pid"], "left").groupBy("qid", "gold").agg(F.min("rank").alias("first"))
    return _recalls(found)


def _recalls(found: DataFrame) -> DataFrame:
    aggs = [F.avg((F.coalesce(F.col("first"), F.lit(1 << 30)) <= k).cast("double")).alias(f"recall_{k}") for k in CUTS]
    aggs += [F.max((F.coalesce(F.col("first"), F.lit(1 << 30)) <= k).cast("double")).alias(f"hit_{k}") for k in CUTS]
    return found.groupBy("qid").agg(*aggs, F.coalesce(1.0 / F.min("first"), F.lit(0.0)).alias("mrr"))


def counted_metrics(asked: DataFrame, found: DataFrame) -> DataFrame:
    """What `retrieval_metrics` gives, where gold ids need only be counted: asked (qid, n) says how many, found (qid, rank) which ranks hold one each."""
    at = [F.count_if(F.col("rank") <= k).alias(f"at_{k}") for k in CUTS]
    rows = asked.where("n > 0").join(found.groupBy("qid").agg(F.min("rank").alias("first"), *at), "qid", "left")
    some = lambda k: F.coalesce(F.col(f"at_{k}"), F.lit(0))
    recalls = [(some(k) / F.col("n")).alias(f"recall_{k}") for k in CUTS]
    return rows.select("qid", *recalls, *[(some(k) > 0).cast("double").alias(f"hit_{k}") for k in CUTS], F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"))


def nearest_rank(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, one column per share p): the value at rank round(p * (n - 1)), half to even, of a group's non-null values.

    Approximate percentiles bracket each wanted rank first; the rows below a bracket are counted, and only those
    within it are sorted. So no group is sorted or collected as a whole.
    """
    known = rows.select(*keys, F.col(value).alias("v")).where("v is not null")
    error = 1 / ACCURACY
    sides = [x for p in shares.values() for x in (max(0.0, p - 2 * error), min(1.0, p + 2 * error))]
    bounds = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", sides, ACCURACY).alias("sides"))
    out = bounds.select(*keys)
    for i, (name, p) in enumerate(shares.items()):
        lo, hi = F.element_at("sides", 2 * i + 1), F.element_at("sides", 2 * i + 2)
        wide = 1 / (2 * ACCURACY)  # so small a group is taken whole
        own = bounds.select(*keys, F.bround(F.lit(p) * (F.col("n") - 1)).alias("rank"), F.when(F.col("n") * wide > 1, lo).alias("lo"), F.when(F.col("n") * wide > 1, hi).alias("hi"))
        joined = known.join(own, keys)
        low = F.coalesce(F.col("v") < F.col("lo"), F.lit(False))
        below = joined.groupBy(*keys).agg(F.count_if(low).alias("below"))
        within = joined.where(~low & F.coalesce(F.col("v") <= F.col("hi"), F.lit(True)))
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("v")) - 1
        found = within.withColumn("place", place).join(below, keys).where(F.col("place") + F.col("below") == F.col("rank"))
        out = out.join(found.select(*keys, F.col("v").alias(name)), keys, "left")
    return out


def by_type(records: DataFrame, metrics: list[str]) -> DataFrame:
    """Number and means (4 digits, half to even) of the metrics over all records (type null) and by type; nulls don't count."""
    means = [F.bround(F.avg(m), 4).alias(m) for m in metrics]
    return records.rollup("type").agg(F.count(F.lit(1)).alias("n"), *means)


def precision_recall(records: DataFrame, said: str, true: str) -> DataFrame:
    """tp, fp, fn, precision and recall of a flag; null where nothing is in the denominator."""
    flag = lambda c: F.count_if(c)
    counts = records.agg(flag(F.col(said) & F.col(true)).alias("tp"), flag(F.col(said) & ~F.col(true)).alias("fp"), flag(~F.col(said) & F.col(true)).alias("fn"))
    share = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.bround(F.col(a) / (F.col(a) + F.col(b)), 4))
    return counts.select("*", share("tp", "fp").alias("precision"), share("tp", "fn").alias("recall"))


def split_of(key: Column, test_below: int = 40) -> Column:
    return F.when(hash_bucket(key) < test_below, "test").otherwise("dev")


def mini(rows: DataFrame, per_type: int = 6) -> DataFrame:
    """The rows of the lowest buckets, `per_type` of each type."""
    order = Window.partitionBy("type").orderBy("bucket", "id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_type)


def freeze_digest(ids: DataFrame) -> DataFrame:
    """One digest of a set of ids: SHA-256 over the sorted digests of ranges, each over its sorted ids, so that no task holds all ids."""
    ranges = ids.select(F.col("id").cast("string").alias("id")).withColumn("part", F.substring(F.sha2("id", 256), 1, 2))
    parts = ranges.groupBy("part").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("id")), "\n"), 256).alias("d"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "d"))), lambda x: x["d"]), "\n"), 256).alias("digest"))


def insert_if_absent(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return table.unionByName(rows.join(table.select(key), key, "left_anti"))


def upsert_where(table: DataFrame, rows: DataFrame, key: str, replaceable: Column) -> DataFrame:
    """Rows replace those of the table that may be replaced; rows of new keys are added."""
    fixed = table.where(~replaceable)
    kept = table.where(replaceable).join(rows.select(key), key, "left_anti")
    return fixed.unionByName(kept).unionByName(rows.join(fixed.select(key), key, "left_anti"))


def paired(records: DataFrame, metric: str) -> DataFrame:
    """Means of a metric over records with a partner (pair_of) and over these partners, and of their difference."""
    a, b = records.where("pair_of is not null").alias("a"), records.alias("b")
    both = a.join(b, F.col("a.pair_of") == F.col("b.id")).select(F.col(f"a.{metric}").alias("lay"), F.col(f"b.{metric}").alias("original"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg("lay").alias("lay"), F.avg("original").alias("original"), F.avg(F.col("lay") - F.col("original")).alias("gain"))


def compare_versions(records: DataFrame, metric: str) -> DataFrame:
    """One row per type, one column per version with the metric's mean."""
    return records.groupBy("type").pivot("version").agg(F.bround(F.avg(metric), 4))
