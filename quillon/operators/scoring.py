"""Metrics of answers: facts, citations, grounding, refusals, amendments; a metric that does not apply is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import CHANGE_STEMS, ancestors, normal_form, read_answer, read_matches, stated_numbers, strings, token_f1
from quillon.functions.tokens import once
from quillon.operators.amend import changed_words
from quillon.operators.evals import nearest_rank, precision_recall
from quillon.scratch import materialize

#: Words right before the second wording that tell which of the two is the old one (fixed values).
OLD_IS_SECOND = ["for", "in place of", "instead of"]
OLD_IS_FIRST = ["to", "with", "by", "became", "becomes", "into", "now read", "now reads"]
#: Characters between two wordings beyond which what connects them is not read.
CONNECTED = 60
COSTS = ["llm_tokens", "classify_tokens", "verify_tokens", "embed_tokens", "evidence_tokens"]


def gold_targets(kind: Column, provisions: Column, rows: Column) -> Column:
    """The ids retrieval must surface: both kinds for a multi-hop question, else table rows where there are some, else provisions."""
    none = F.array().cast("array<string>")
    provisions, rows = F.coalesce(provisions, none), F.coalesce(rows, none)
    return F.when(kind == "multi_hop", F.concat(provisions, rows)).when(F.size(rows) > 0, rows).otherwise(provisions)


def gold_rows(questions: DataFrame) -> DataFrame:
    """(id, gold): each question's gold ids, each once."""
    return questions.select("id", F.explode(F.array_distinct(gold_targets(F.col("type"), F.col("gold_provisions"), F.col("gold_table_rows")))).alias("gold"))


def reach(questions: DataFrame, tree: DataFrame) -> DataFrame:
    """(id, gold, pid): each question's gold ids with all that counts as finding them; tree: (id, ancestor). Rows find themselves only."""
    gold = gold_rows(questions)
    below = gold.join(tree.select(F.col("id").alias("pid"), F.col("ancestor").alias("gold")), "gold").select("id", "gold", "pid")
    return gold.select("id", "gold", F.col("gold").alias("pid")).unionByName(below).distinct()


def _share(flags: Column) -> Column:
    return F.aggregate(flags, F.lit(0.0), lambda n, x: n + F.when(x, 1.0).otherwise(0.0)) / F.size(flags)


def substitution_pairs(questions: DataFrame, amendments: DataFrame, provisions: DataFrame) -> DataFrame:
    """(id, old, new): the wordings of substitutions whose endnote quotes the old one and whose marked text has the new one."""
    asked = questions.where("gold_amendment.type = 'substituted' and gold_amendment.footnote is not null")
    gold = asked.select("id", F.col("gold_amendment.footnote").alias("key"), F.posexplode(gold_targets(F.col("type"), F.col("gold_provisions"), F.col("gold_table_rows"))).alias("at", "pid"))
    rows = gold.join(amendments.select("key", "label", "header"), "key").join(provisions.select(F.col("id").alias("pid"), "text_marked"), "pid", "left")
    rows = rows.select("id", "at", changed_words(F.col("label"), F.col("header"), F.lit("substituted"), F.col("text_marked")).alias("w")).where("w.old is not null and w.new is not null")
    return rows.groupBy("id").agg(F.min_by("w", "at").alias("w")).select("id", F.trim("w.old").alias("old"), F.trim("w.new").alias("new"))


def direction(answer: Column, old: Column, new: Column) -> Column:
    """1.0 if the answer names the old wording as the old one, 0.0 if it has the change backwards, null if it can't be told."""
    a, o, n = normal_form(answer), normal_form(old), normal_form(new)

    def place(text: Column, part: Column, other: Column) -> Column:
        """First place of part outside other, where other holds it too."""
        masked = F.when(F.contains(other, part), F.replace(text, other, F.repeat(F.lit("\u0000"), F.length(other)))).otherwise(text)
        return F.position(part, masked)

    at_old, at_new = place(a, o, n), place(a, n, o)
    first_end = F.when(at_old < at_new, at_old + F.length(o)).otherwise(at_new + F.length(n))
    between = F.rtrim(F.substring(a, first_end, F.greatest(at_old, at_new) - first_end))
    near = F.greatest(at_old, at_new) - first_end <= CONNECTED
    ends = lambda words: between.rlike(rf"\b(?:{'|'.join(words)})$")
    old_first = F.when(ends(OLD_IS_SECOND), False).when(ends(OLD_IS_FIRST), True)
    told = (o != "") & (n != "") & (o != n) & (at_old > 0) & (at_new > 0) & near
    return F.when(told, (old_first == (at_old < at_new)).cast("double"))


def answer_metrics(records: DataFrame, tree: DataFrame | None, pairs: DataFrame) -> DataFrame:
    """One row per record (id, type, answer, refused, should_refuse, gold_*, cited: array of (provisions, text)).

    tree: (id, ancestor), or None where ids are paths that tell what encloses them: then a record is scored where it stands.
    pairs: as of `substitution_pairs`. Questions that should be refused have the two flags only.
    """
    rows = records.withColumn("answer", F.coalesce("answer", F.lit(""))).withColumn("cited", F.coalesce("cited", F.array().cast(records.schema["cited"].dataType)))
    if tree is None:
        gold = F.array_distinct(gold_targets(F.col("type"), F.col("gold_provisions"), F.col("gold_table_rows")))
        within = lambda c: F.flatten(F.transform(F.coalesce(c["provisions"], F.array().cast("array<string>")), ancestors))
        scored = {c: F.when(~F.col("should_refuse"), F.col(c)) for c in ("answer", "cited", "gold_facts")}  # what is to be refused isn't read
        asked = rows.withColumns(scored).withColumn("_gold", gold).withColumn("_within", F.transform("cited", within))
        asked = asked.withColumn("good", F.size(F.filter("_within", lambda w: F.coalesce(F.arrays_overlap(w, F.col("_gold")), F.lit(False)))))
        asked = asked.withColumn("found", F.size(F.array_intersect("_gold", F.flatten("_within")))).join(pairs, "id", "left")
    else:
        asked = rows.where("not should_refuse")
        cited = asked.select("id", F.posexplode("cited").alias("n", "c")).select("id", "n", F.explode("c.provisions").alias("pid"))
        hits = reach(asked, tree).join(cited, ["id", "pid"]).groupBy("id").agg(F.count_distinct("n").alias("good"), F.count_distinct("gold").alias("found"))
        asked = asked.join(hits, "id", "left").join(pairs, "id", "left").na.fill(0, ["good", "found"])
    # each answer and its passages are brought into their form once, each fact once
    asked = asked.withColumn("_read", read_answer(F.col("answer"))).withColumn("_facts", F.transform("gold_facts", lambda f: read_matches(F.col("_read"), f)))
    said = normal_form(F.array_join(F.transform("cited", lambda c: c["text"]), " "))
    asked = asked.withColumn("_numbers", once(said, lambda form: F.transform(stated_numbers(F.col("answer")), lambda x: F.contains(form, normal_form(x)))))
    facts = F.col("_facts")
    exact, soft = F.transform(facts, lambda f: f["exact"]), F.transform(facts, lambda f: f["soft"])
    some, n_gold = F.size(F.coalesce(facts, F.array())) > 0, F.size(F.array_distinct(gold_targets(F.col("type"), F.col("gold_provisions"), F.col("gold_table_rows"))))
    change = F.lower("gold_amendment.type")
    stems = F.coalesce(*[F.when(change == kind, F.exists(strings(values), lambda s: F.contains(F.lower("answer"), s))) for kind, values in CHANGE_STEMS.items()])
    amended = (F.col("type") == "amendment") & F.col("gold_amendment").isNotNull()
    whole = lambda flags: F.forall(flags, lambda x: x).cast("double")
    figures = [
        F.when(some, _share(soft)).alias("fact_recall"), F.when(some, whole(soft)).alias("all_facts"),
        F.when(some, _share(exact)).alias("fact_recall_exact"), F.when(some, whole(exact)).alias("all_facts_exact"),
        F.when(F.size("cited") > 0, F.col("good") / F.size("cited")).otherwise(0.0).alias("citation_precision"),
        F.when(n_gold > 0, F.col("found") / n_gold).otherwise(0.0).alias("citation_recall"),
        F.when(F.size("_numbers") > 0, _share(F.col("_numbers"))).alias("grounded_numbers"),
        F.when(F.col("type") == "table", F.when(some, whole(exact)).otherwise(0.0)).alias("table_exact"),
        F.when(amended, F.coalesce(stems, F.lit(False)).cast("double")).alias("amendment_type"),
        F.when(amended & (F.col("gold_amendment.prior_text") != ""), token_f1(F.col("answer"), F.col("gold_amendment.prior_text"))).alias("prior_text_f1"),
        F.when(amended & F.col("old").isNotNull(), direction(F.col("answer"), F.col("old"), F.col("new"))).alias("amendment_direction"),
    ]
    names = "fact_recall all_facts fact_recall_exact all_facts_exact citation_precision citation_recall grounded_numbers table_exact amendment_type prior_text_f1 amendment_direction".split()
    flags = ["id", "type", F.col("refused").cast("double").alias("refused"), F.col("should_refuse").cast("double").alias("should_refuse")]
    if tree is None:
        return asked.select(*flags, *[F.when(~F.col("should_refuse"), c).alias(n) for n, c in zip(names, figures, strict=True)])
    return rows.select(*flags).join(asked.select("id", *figures), "id", "left")


def aggregate(metrics: DataFrame, costs: DataFrame | None = None) -> DataFrame:
    """(type, metric, value): means by type and over all (type null), 4 digits half to even; over all also refusals, costs (1 digit) and latencies (3 digits)."""
    metrics = materialize(metrics.drop("id"), "metrics")  # read once for each kind of figure below
    flags = ["refused", "should_refuse", "scope_refused"]
    names = [c for c in metrics.columns if c not in ("id", "type", *flags)]
    figures = [F.bround(F.avg(F.col(c).cast("double")), 4).alias(c) for c in names] + [F.count(F.lit(1)).cast("double").alias("n")]
    out = metrics.rollup("type").agg(*figures).unpivot("type", [*names, "n"], "metric", "value")  # a row holds all means of a type, or over all
    over_all = lambda df, name: df.select(F.lit(None).cast("string").alias("type"), F.lit(name).alias("metric"), F.col("value").cast("double").alias("value"))
    refusals = precision_recall(metrics.where("refused is not null").select((F.col("refused") == 1).alias("said"), (F.col("should_refuse") == 1).alias("true")), "said", "true")
    for name in ("precision", "recall"):
        out = out.unionByName(over_all(refusals.withColumnRenamed(name, "value"), f"refusal_{name}"))
    if "scope_refused" in metrics.columns:
        scope = precision_recall(metrics.where("scope_refused is not null").select((F.col("scope_refused") == 1).alias("said"), (F.col("type") == "refusal").alias("true")), "said", "true")
        for name in ("precision", "recall"):
            out = out.unionByName(over_all(scope.withColumnRenamed(name, "value"), f"scope_{name}"))
    if costs is not None:
        for c in [c for c in COSTS if c in costs.columns]:
            out = out.unionByName(over_all(costs.agg(F.bround(F.avg(c), 1).alias("value")), f"{c}_mean"))
        if "latency_s" in costs.columns:
            ranks = nearest_rank(costs.withColumn("_all", F.lit(0)), ["_all"], "latency_s", {"latency_p50_s": 0.5, "latency_p95_s": 0.95})
            for name in ("latency_p50_s", "latency_p95_s"):
                out = out.unionByName(over_all(ranks.select(F.bround(name, 3).alias("value")), name))
    return out.where("value is not null")


def catch_rates(checks: DataFrame) -> DataFrame:
    """Shares of changed answers and of original ones that a checker flagged (checks: mutated_flagged, original_flagged), 4 digits."""
    rate = lambda c: F.bround(F.avg(F.col(c).cast("int")), 4)
    return checks.agg(F.count(F.lit(1)).alias("n"), rate("mutated_flagged").alias("catch_rate"), rate("original_flagged").alias("false_flag_rate"))
