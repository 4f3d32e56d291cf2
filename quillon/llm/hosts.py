"""Quality rules with host-level verdicts, in DataFrame functions only.

Every text is measured by rules. Failures are counted for each host (column source), and a host's failure rate is
shrunk towards the rate of all documents by a beta prior that is fitted to the spread of the hosts' rates. A document goes

* if it fails a base rule itself,
* if its host's shrunk rate of base failures is REJECT or more, or
* if it fails one of the softer rules and its host's shrunk rate of that rule is SOFT or more: where a host is known
  for a fault, one more page with it is no accident, elsewhere it stays.

Defined cases: a null text has no words, and fails; a row with a null source belongs to no host, counts in no rate and is
judged by itself alone; an empty source is a host like any other; repeated rows, and rows without an id, count each;
an empty table gives no rows; columns other than doc_id, text and source are ignored, and a table without source
has no hosts. Texts of any length are measured whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize

#: A text fails with fewer words, or with a larger percentage of its words in repeated windows.
LEAST_WORDS = 20
REPEATED_PERCENT = 30
#: Words in a window.
WINDOW = 8
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
#: Shrunk rates from which a host is rejected as a whole, or is no longer trusted with a softer rule.
REJECT = 0.5
SOFT = 0.2
#: Bounds of the prior's weight, in documents: hosts that differ no more than by chance share one rate.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1e6

BASE_RULE = "base"
SOFT_RULES = ["symbols", "lines", "word_length"]
RULES = [BASE_RULE, *SOFT_RULES]


def _once(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\t-\r]+"), lambda w: w != "")


def _windows(words: Column) -> Column:
    """Hashes of all windows of WINDOW words, in order."""
    starts = lambda w: F.when(F.size(w) >= WINDOW, F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    return _once(F.transform(words, lambda w: F.xxhash64(w)), lambda w: F.transform(starts(w), lambda i: F.xxhash64(F.slice(w, i, F.lit(WINDOW)))))


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more: equal hashes are neighbours once sorted, and the windows' places then add up."""

    def places(s: Column) -> Column:
        same = lambda x, k: x["h"].eqNullSafe(F.get(s, k - 1)["h"]) | x["h"].eqNullSafe(F.get(s, k + 1)["h"])
        return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).cast("long").alias("n"), p.alias("last"))
    found = F.aggregate(_once(ordered, places), start, step, lambda a: a["n"])
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(found)


def measured(docs: DataFrame, *carried: Column) -> DataFrame:
    """doc_id, source, the measures of each text (n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words), and `carried`."""
    source = F.col("source") if "source" in docs.columns else F.lit(None)
    more = docs.select(*carried).columns
    rows = docs.select("doc_id", source.cast("string").alias("source"), F.coalesce("text", F.lit("")).alias("text"), *carried)
    rows = rows.select("doc_id", "source", "text", *more, F.filter(F.split("text", "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0).alias("lines"), _words(F.col("text")).alias("words"))
    long = lambda c: c.cast("long")
    return rows.select(
        "doc_id", "source", long(F.size("words")).alias("n_words"),
        long(F.char_length(F.translate("text", SPACES, ""))).alias("word_chars"),
        long(F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
        long(F.size("lines")).alias("n_lines"), long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        _once(_windows(F.col("words")), _covered).alias("n_repeat_words"), *more,
    )


def failures() -> dict[str, Column]:
    """Each rule's failure, of measured rows. Softer rules look only at texts that have words."""
    n = F.col("n_words")
    return {
        BASE_RULE: (n < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * n),
        "symbols": 10 * F.col("n_symbols") > n,
        "lines": 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
        "word_length": (n > 0) & ((F.col("word_chars") < 3 * n) | (F.col("word_chars") > 10 * n)),
    }


def priors(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """(a, b) of each rule's beta prior, from the hosts' counts n and f_<rule>: one row of sums reaches the driver.

    The weight a + b comes from the hosts' intraclass correlation, the share of the spread of their rates that counts alone don't explain.
    """
    n = F.col("n").cast("double")
    sums = [F.count(F.lit(1)).alias("k"), F.sum(n).alias("n"), F.sum(n * n).alias("n2")]
    for r in RULES:
        f = F.col(f"f_{r}").cast("double")
        sums += [F.sum(f).alias(f"f_{r}"), F.sum(f * f / n).alias(f"s_{r}")]
    s = hosts.agg(*sums).first()
    out = {}
    for r in RULES:
        if not s["k"]:
            out[r] = (0.0, 0.0)
            continue
        p = s[f"f_{r}"] / s["n"]
        chance = p * (1 - p)
        size = s["n"] - s["n2"] / s["n"] - (s["k"] - 1)
        rho = (s[f"s_{r}"] - s[f"f_{r}"] * s[f"f_{r}"] / s["n"] - (s["k"] - 1) * chance) / (chance * size) if chance > 0 and size > 0 else 0.0
        weight = min(max(1 / rho - 1, LEAST_WEIGHT), MOST_WEIGHT) if rho > 0 else MOST_WEIGHT
        out[r] = (p * weight, (1 - p) * weight)
    return out


def host_rates(rows: DataFrame) -> DataFrame:
    """Of measured rows with fails_<rule>: a row for each host with its count n, its failures f_<rule> and its shrunk rates rate_<rule>."""
    counts = [F.count_if(f"fails_{r}").alias(f"f_{r}") for r in RULES]
    hosts = materialize(rows.where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"), *counts), "hosts")
    rates = [((F.col(f"f_{r}") + a) / (F.col("n") + (a + b))).alias(f"rate_{r}") for r, (a, b) in priors(hosts).items()]
    return hosts.select("*", *rates)


def judged(docs: DataFrame, *carried: Column) -> DataFrame:
    """Measures, failures and verdicts of all documents: kept, with the host's count and its shrunk rates (null without a host), and `carried`.

    Measures are taken once and written without texts; hosts meet them in a join of two written tables, which Spark turns into a
    broadcast where the hosts are few, and whose hot hosts it splits where they are not.
    """
    base = measured(docs, *carried)
    rows = materialize(base.select("*", *[c.alias(f"fails_{r}") for r, c in failures().items()]), "measures")
    hosts = materialize(host_rates(rows).drop(*[f"f_{r}" for r in RULES]).withColumnRenamed("n", "host_docs"), "host-rates")
    both = rows.join(hosts, "source", "left")
    rejected = F.coalesce(F.col(f"rate_{BASE_RULE}") >= REJECT, F.lit(False))
    soft = [F.col(f"fails_{r}") & F.coalesce(F.col(f"rate_{r}") >= SOFT, F.lit(False)) for r in SOFT_RULES]
    bad = F.col(f"fails_{BASE_RULE}") | rejected
    for c in soft:
        bad = bad | c
    return both.select("*", F.col(f"fails_{BASE_RULE}").alias("base_failed"), (~bad).alias("kept"))


def host_verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed, kept, and the host's count of documents and shrunk rate of base failures."""
    return judged(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "host_docs", F.round(f"rate_{BASE_RULE}", 6).alias("host_rate"),
    )



def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return judged(docs, whole).where("kept").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
