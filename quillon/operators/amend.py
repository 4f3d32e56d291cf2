"""Endnotes as evidence: rendering, attaching to hits, changed words, and wording before and after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import label_key, once, token_count

STYLES = ("raw", "structured", "explicit")
SUB_FOR = r"[Ss]ubs?\.\s+for\s+[\"“](.+?)[\"”]"
MARK = r"\{\{fn:([^}]+)\}\}\[([^\]]*)\]?"


def _or_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def changed_words(label: Column, header: Column, kind: Column, marked: Column) -> Column:
    """Struct of the old words, quoted in a substitution's note, and of the new ones, in the bracket that the note tags."""
    tags = F.transform(F.regexp_extract_all(F.coalesce(marked, F.lit("")), F.lit(MARK), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, MARK, 1).alias("l"), F.regexp_extract(m, MARK, 2).alias("w")))
    new = F.try_element_at(F.filter(tags, lambda t: t["l"] == label), F.lit(1))
    return F.struct(F.when(kind == "substituted", F.nullif(F.regexp_extract(header, SUB_FOR, 1), F.lit(""))).alias("old"), _or_null(new["w"]).alias("new"))


def endnote_line(style: str, label: Column, header: Column, prior: Column, kind: Column, act: Column, date: Column, target: Column, words: Column | None = None) -> Column:
    if style not in STYLES:
        raise ValueError(f"style must be one of {STYLES}")
    note = F.concat_ws(" ", header, prior)
    raw = F.concat(F.lit("Endnote "), label, F.lit(": "), note)
    if style == "raw":
        return raw
    facts = [F.concat(F.lit("applies to "), target), F.concat(F.lit("amendment type: "), kind), F.concat(F.lit("by "), act), F.concat(F.lit("with effect from "), date)]
    if style == "explicit":
        both = F.concat(F.lit('wording before: "'), words["old"], F.lit('"; wording now: "'), words["new"], F.lit('"'))
        facts.append(F.coalesce(both, F.when(kind == "inserted", F.concat(F.lit('inserted (not in the Act before): "'), words["new"], F.lit('"')))))
    return F.when(kind.isNull(), raw).otherwise(F.concat(F.lit("Endnote "), label, F.lit(" ["), F.concat_ws("; ", *facts), F.lit("]: "), note))


def endnotes(amendments: DataFrame, links: DataFrame, provisions: DataFrame, style: str = "raw") -> DataFrame:
    """(provision_id, lines): each provision's endnote lines, by label, numbers first."""
    rows = links.join(amendments, "key").join(provisions.select(F.col("id").alias("provision_id"), "number", "schedule", "text_marked"), "provision_id", "left")
    target = F.when(F.col("number").isNull(), F.col("provision_id")).when(F.col("schedule").isNotNull(), F.col("number")).otherwise(F.concat(F.lit("section "), "number"))
    words = changed_words(F.col("label"), F.col("header"), F.col("type"), F.col("text_marked"))
    line = endnote_line(style, F.col("label"), F.col("header"), F.col("prior_text"), F.col("type"), F.col("amending_act"), F.col("effective_date"), target, words)
    sorted_rows = rows.select("provision_id", F.struct(label_key(F.col("label")).alias("k"), line.alias("line")).alias("x")).groupBy("provision_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return sorted_rows.select("provision_id", F.transform("x", lambda v: v["line"]).alias("lines"))


def attach(hits: DataFrame, lines: DataFrame) -> DataFrame:
    """Appends to each hit (qid, rank, id, text, provisions) the endnotes of its provisions, each once, and counts its tokens again."""
    exploded = hits.select("qid", "id", F.posexplode("provisions").alias("at", "provision_id")).join(lines, "provision_id")
    found = exploded.groupBy("qid", "id").agg(F.array_sort(F.collect_list(F.struct("at", "lines"))).alias("x"))
    found = found.select("qid", "id", F.array_distinct(F.flatten(F.transform("x", lambda v: v["lines"]))).alias("extra"))
    out = hits.join(found, ["qid", "id"], "left")
    text = F.when(F.col("extra").isNotNull(), F.concat("text", F.lit("\n"), F.array_join("extra", "\n"))).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("tokens", token_count(F.col("text"))).drop("extra")


def segments(marked: Column, notes: Column) -> Column:
    """The plain and the marked pieces of a text, in order: array of (words, label, type, was, whole, inserted).

    notes: array of (label, type, prior_text, header). was: the wording before, as far as the piece's own note tells: all of
    a plain piece, nothing for inserted words, what a substitution's note quotes; whole: the earlier wording of the
    whole provision, where a note has that instead.
    """
    parts = F.split(F.regexp_replace(F.regexp_replace(marked, MARK, "\u0001\u0002$1\u0003$2\u0001"), "^\u0001|\u0001$", ""), "\u0001")

    def read(p: Column) -> Column:
        label = F.regexp_extract(p, "^\u0002([^\u0003]*)\u0003", 1)
        words = F.regexp_replace(p, "^\u0002[^\u0003]*\u0003", "")
        note = F.try_element_at(F.filter(notes, lambda n: n["label"] == label), F.lit(1))
        quoted = F.nullif(F.regexp_extract(F.coalesce(note["header"], F.lit("")), SUB_FOR, 1), F.lit(""))
        inserted, substituted = F.coalesce(note["type"] == "inserted", F.lit(False)), F.coalesce(note["type"] == "substituted", F.lit(False))
        tagged = p.startswith("\u0002")
        was = F.when(~tagged, words).when(inserted, "").when(substituted, quoted)
        whole = F.when(tagged & was.isNull() & note["type"].isin("substituted", "omitted"), note["prior_text"])
        return F.struct(words.alias("words"), F.when(tagged, label).alias("label"), F.when(tagged, note["type"]).alias("type"), was.alias("was"), whole.alias("whole"), (tagged & inserted).alias("inserted"))

    return F.transform(parts, read)


def before(marked: Column, notes: Column) -> Column:
    """The wording before the amendments, or null where the notes do not give it; notes as for `segments`.

    A whole earlier wording in a note wins; text nearly all inserted did not exist.
    """

    def decide(x: Column) -> Column:
        length = lambda a: F.aggregate(a, F.lit(0), lambda n, s: n + F.length(s["words"]))
        whole = F.try_element_at(F.filter(F.transform(x, lambda s: s["whole"]), lambda w: w.isNotNull()), F.lit(-1))
        joined = F.array_join(F.transform(x, lambda s: F.coalesce(s["was"], F.lit(""))), "")
        tidy = F.trim(F.regexp_replace(F.regexp_replace(joined, r"\s{2,}", " "), r"\s+([;,.:])", "$1"))
        known = F.forall(x, lambda s: s["was"].isNotNull())
        fresh = length(F.filter(x, lambda s: s["inserted"])) >= 0.8 * length(x)
        return F.coalesce(whole, F.when(fresh, "").when(known, tidy))

    return once(segments(marked, notes), decide)
