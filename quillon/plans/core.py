"""Registered queries of operators that keep their own data structures: grids, closures that change, resumable runs, aggregates, VARIANT."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions.aggregates import PairedMeans, aggregate
from quillon.operators import evalrun, hierarchy, semi, spatial
from quillon.plans.catalog import _tree, query
from quillon.scratch import scratch_path
from quillon.tables import load

RADIUS = 0.05


def _points(spark: SparkSession, base: str) -> DataFrame:
    return load(spark, base, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


_FLAT = f"""p AS (SELECT label, vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
d AS (SELECT a.label, a.id, b.id AS other, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM p a JOIN p b ON a.label = b.label AND a.id <> b.id WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {RADIUS} * {RADIUS})"""


@query(f"WITH {_FLAT}, r AS (SELECT *, row_number() OVER (PARTITION BY label, id ORDER BY d2, other) AS n FROM d) SELECT label, id, other AS near, round(d2, 12) AS d2 FROM r WHERE n = 1")
def nearest_in_plane(spark: SparkSession, base: str) -> DataFrame:
    """Each point's nearest other point of its label in two dimensions, within a radius."""
    p = _points(spark, base)
    return spatial.nearest_within(p, p, RADIUS, ["label"], apart=True).withColumn("d2", F.round("d2", 12))


@query(f"WITH {_FLAT} SELECT label, count(*) AS pairs, round(max(d2), 12) AS farthest FROM d GROUP BY label")
def pairs_in_plane(spark: SparkSession, base: str) -> DataFrame:
    p = _points(spark, base)
    found = spatial.pairs_within(p, p, RADIUS, ["label"]).where("id <> other")
    return found.groupBy("label").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.max("d2"), 12).alias("farthest"))


# ---------------------------------------------------------------------- subtrees that move

_MOVED = """edges AS (SELECT 'r' || r_regionkey AS id, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'n' || (n_nationkey + 1) ELSE 'r' || n_regionkey END FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || CASE WHEN c_custkey % 7 = 0 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END FROM customer),
closure AS (SELECT id, id AS ancestor, 0 AS depth FROM edges UNION ALL SELECT c.id, e.parent, c.depth + 1 FROM closure c JOIN edges e ON e.id = c.ancestor WHERE e.parent IS NOT NULL)"""


def _moves(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """The tree of regions, nations and customers, and its moves: every seventh customer to the next nation, every fifth nation below the next one."""
    tree = hierarchy.closure(_tree(spark, base).where("id not like 'o%'"))
    c = load(spark, base, "customer").where("c_custkey % 7 = 0")
    n = load(spark, base, "nation").where("n_nationkey % 5 = 0")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    moves = c.select(name("c", F.col("c_custkey")).alias("id"), name("n", (F.col("c_nationkey") + 1) % 25).alias("parent"))
    return tree, moves.unionByName(n.select(name("n", F.col("n_nationkey")).alias("id"), name("n", F.col("n_nationkey") + 1).alias("parent")))


@query(f"WITH RECURSIVE {_MOVED} SELECT id, ancestor, depth FROM closure")
def subtree_move(spark: SparkSession, base: str) -> DataFrame:
    """The closure after customers and whole nations moved."""
    tree, moves = _moves(spark, base)
    return hierarchy.moved(tree, moves)


@query(f"""WITH RECURSIVE {_MOVED}, touched AS (SELECT 'n' || n_nationkey AS id FROM nation WHERE n_nationkey % 5 = 0 UNION SELECT 'c' || c_custkey FROM customer WHERE c_custkey % 7 = 0 OR c_nationkey % 5 = 0)
SELECT id, string_agg(ancestor, '/' ORDER BY depth DESC) AS new_id FROM closure WHERE id IN (SELECT id FROM touched) GROUP BY id""")
def renamed_paths(spark: SparkSession, base: str) -> DataFrame:
    """Path names of all that moved."""
    tree, moves = _moves(spark, base)
    return hierarchy.renamed(tree, moves, F.col("id"), "/")


# ---------------------------------------------------------------------- a resumable evaluation run

_RUN = f"""t AS (SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL), q AS (SELECT a.conv_id || ':' || a.turn AS id, CASE WHEN a.turn = 0 THEN 'first' ELSE 'later' END AS type, a.text AS question, b.text AS gold FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
a AS (SELECT *, 'echo' AS version, question AS answer FROM q UNION ALL SELECT *, 'opening', string_split(question, '.')[1] FROM q),
w AS (SELECT version, type, id, list_filter(string_split(trim(regexp_replace(lower(answer), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS p, list_filter(string_split(trim(regexp_replace(lower(gold), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS g FROM a),
f AS (SELECT version, type, CASE WHEN len(p) = 0 OR len(g) = 0 THEN 0 ELSE 2.0 * list_sum(list_transform(list_distinct(g), lambda t: least(len(list_filter(p, lambda x: x = t)), len(list_filter(g, lambda x: x = t))))) / (len(p) + len(g)) END AS f1 FROM w)"""


@query(f"WITH {_RUN} SELECT version, type, count(*) AS n, round(avg(f1), 6) AS f1 FROM f GROUP BY ROLLUP (version, type) HAVING version IS NOT NULL")
def evaluation_run(spark: SparkSession, base: str) -> DataFrame:
    """Two answerers over the turns that have a reply, each scored against it: a run that is stopped by a quota in its second portion, and gone on with."""
    t = load(spark, base, "conversations").where("text is not null").select("conv_id", "turn", "text")
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("gold"))
    name = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    questions = t.join(nxt, ["conv_id", "turn"]).select(name.alias("id"), F.when(F.col("turn") == 0, "first").otherwise("later").alias("type"), F.col("text").alias("question"), "gold")
    calls: list[int] = []

    def score(df: DataFrame) -> DataFrame:
        return df.withColumn("f1", T.token_f1(T.plain(F.col("answer")), T.plain(F.col("gold"))))

    def opening(df: DataFrame) -> DataFrame:
        calls.append(1)
        if len(calls) == 2:
            raise evalrun.QuotaExhausted("no more calls today")
        return df.withColumn("answer", F.split("question", r"\.")[0])

    versions = {"opening": {"answer": opening, "score": score}, "echo": {"answer": lambda df: df.withColumn("answer", F.col("question")), "score": score}}
    root = scratch_path(spark, "run")
    evalrun.run(spark, root, questions, versions, portions=3)
    evalrun.run(spark, root, questions, versions, portions=3)
    done = evalrun.records(spark, root, questions, versions)
    return done.rollup("version", "type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("f1"), 6).alias("f1")).where("version is not null")


# ---------------------------------------------------------------------- aggregates, VARIANT


@query("""WITH w AS (SELECT event_type, value, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS r FROM events WHERE value IS NOT NULL)
SELECT event_type, count(*) AS n, round(fsum(value) / count(*), 6) AS mean, round(fsum(event_id % 50) / count(*), 6) AS cost, round(fsum(event_id % 50) / fsum(value), 6) AS per_point, min(value) AS worst, min(event_id) FILTER (r = 1) AS worst_id FROM w GROUP BY event_type""")
def paired_means(spark: SparkSession, base: str) -> DataFrame:
    """Means of a value and its cost by type, with the record of the least value."""
    e = load(spark, base, "events").select("event_type", F.col("value").cast("double").alias("value"), (F.col("event_id") % 50).cast("double").alias("spent"), "event_id")
    out = aggregate(e, ["event_type"], PairedMeans("value", "spent", "event_id"))
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "cost", "per_point")], "worst", "worst_id")


@query("""WITH e AS (SELECT event_type, props, (props::JSON ->> '$.k')::BIGINT AS k FROM events WHERE list_has_any(json_keys(props), ['k', 'page'])) SELECT event_type, count(*) AS n, sum(k)::BIGINT AS k, count(*) FILTER (k > 50) AS high FROM e GROUP BY event_type""")
def variant_fields(spark: SparkSession, base: str) -> DataFrame:
    """Events that have one of two properties, read from VARIANT by their key sets."""
    path = scratch_path(spark, "variants")
    semi.store(load(spark, base, "events").select("event_type", "props"), "props", path)
    found = semi.having_any(spark, path, ["k", "page"]).withColumn("k", semi.field("props", "$.k", "bigint"))
    return found.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"), F.count_if(F.col("k") > 50).alias("high"))
