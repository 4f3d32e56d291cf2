"""Cross-references in running text, by a grammar over tokens, and their resolution by joins.

A text is read token by token: numbers, labels such as (2) or (za), words, and single other characters. An
opening word (WORDS) begins a reference, which takes the numbers, labels and joining words that follow; what
stands after it decides whether it points into another instrument. So no two references overlap.
Numbers with a hyphen and a tail, as of an older Act's sections, are no sections of this one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.structure import relative, resolve, table_row_refs, tables_under
from quillon.scratch import materialize

# What opens a reference, and what it is (fixed values).
WORDS = {
    "section": "section", "sections": "section", "sub-section": "relative", "sub-sections": "relative", "clause": "relative",
    "clauses": "relative", "sub-clause": "relative", "sub-clauses": "relative", "item": "relative", "items": "relative",
    "sub-item": "relative", "sub-items": "relative", "Chapter": "chapter", "Part": "part", "Schedule": "schedule",
}
#: Words that join the items of a list (fixed values).
JOINTS = {",", "and", "or", "to"}
#: Names of instruments, and words that may stand in such a name (fixed values).
INSTRUMENTS = {"Act", "Code", "Rules", "Regulations", "Constitution"}
WITHIN = {"the", "of", "and", "for", "on", "in", "to"}
REACH = 25

TOKEN = re.compile(r"\d+-\w+|\((?:\d+[A-Z]*|[a-z]{1,4}|[A-Z]{1,5})\)|\d+[A-Z]*|[A-Za-z][\w‑-]*|\S")
LABEL = re.compile(r"\((?:\d+[A-Z]*|[a-z]{1,4}|[A-Z]{1,5})\)$")
ROMAN = re.compile(r"[IVXL]+$")
REF = "struct<kind:string,word:string,base:string,labels:array<string>,target:string,rows:array<string>,external:boolean>"


def style(label: str) -> str:
    """A label's style: number, Roman numeral of two letters or more, small or capital letters."""
    bare = label.strip("()")
    if bare[0].isdigit():
        return "number"
    return "capital" if bare.isupper() else "roman" if len(bare) > 1 and set(bare) <= set("ivxl") else "small"


def continued(before: list[str], labels: list[str]) -> list[str]:
    """Labels of a list's later item, led by those levels of the item before that lie above its own style."""
    styles = [style(x) for x in before]
    at = styles.index(style(labels[0])) if labels and style(labels[0]) in styles else 0
    return before[:at] + labels


class Reader:
    """Reads the references of one text."""

    def __init__(self, text: str):
        self.tokens = TOKEN.findall(text)
        self.at = 0

    def peek(self, ahead: int = 0) -> str:
        k = self.at + ahead
        return self.tokens[k] if k < len(self.tokens) else ""

    def labels(self) -> list[str]:
        found = []
        while LABEL.match(self.peek()):
            found.append(self.peek())
            self.at += 1
        return found

    def joint(self) -> int:
        """Number of joining tokens here: `,`, `and`, or `, and`."""
        if self.peek() not in JOINTS:
            return 0
        return 2 if self.peek() == "," and self.peek(1) in ("and", "or") else 1

    def elsewhere(self) -> bool:
        """Whether what follows names another instrument: of/under, then capitalised words up to Act, Code and the like."""
        k = self.at
        k += self.peek() == ","
        if (t := self.tokens[k : k + 1]) and t[0] == "[":
            k = next((j + 1 for j in range(k, min(k + REACH, len(self.tokens))) if self.tokens[j] == "]"), k)
        words = self.tokens[k : k + REACH]
        if not words or words[0] not in ("of", "under"):
            return False
        named = False
        for w in words[1:]:
            if w in INSTRUMENTS:
                return named or w == "Constitution"
            if w in ("said", "that") or (w[0].isupper() and w not in WORDS):
                named = True
            elif not (w in WITHIN or (named and w in "().,'")) and not (named and (w[0].isdigit() or LABEL.match(w))):
                return False
        return False

    def rows(self) -> list[str]:
        """Serial numbers of a bracket `[Table: Sl. No. 1(i), 2]` that follows."""
        if self.peek() not in ("[", "(") or self.tokens[self.at + 1 : self.at + 3] != ["Table", ":"]:
            return []
        k, found = self.at + 3, []
        while k < len(self.tokens) and self.tokens[k] not in ("]", ")"):
            if self.tokens[k][0].isdigit():
                found.append(self.tokens[k])
            elif found and LABEL.match(self.tokens[k]) and self.tokens[k - 1] == found[-1]:
                found[-1] += self.tokens[k]
            k += 1
        self.at = k + 1
        return found

    def items(self, numbered: bool) -> list[tuple[str | None, list[str]]]:
        """Items (number, labels) of a list; an item without a number continues the one before."""
        found: list[tuple[str | None, list[str]]] = []
        while True:
            start = self.at
            self.at += self.joint() if found else 0
            number = None
            if numbered and re.match(r"\d+[A-Z]*$", self.peek()):
                number = self.peek()
                self.at += 1
            labels = self.labels()
            if number is None and (not labels or (numbered and not found)):
                self.at = start
                return found
            if number is None and found:
                number, labels = found[-1][0], continued(found[-1][1], labels)
            found.append((number, labels))

    def read(self) -> Iterator[dict]:
        while self.at < len(self.tokens):
            word = self.peek()
            self.at += 1
            kind = WORDS.get(word)
            if kind == "section" and (items := self.items(True)):
                rows = self.rows()
                outside = self.elsewhere()
                for k, (number, labels) in enumerate(items):
                    yield self.ref("section", word, f"s{number}", labels, rows=rows if k == len(items) - 1 and not outside else [], external=outside)
            elif kind == "relative" and (items := self.items(False)):
                outside, over = self.elsewhere(), []
                if not outside and self.peek() == "of" and WORDS.get(self.peek(1)) == "relative":
                    self.at += 2
                    over = self.labels()
                for _, labels in items:
                    yield self.ref("relative", word, None, over + labels, external=outside)
            elif kind == "part" and re.match("[A-H]$", self.peek()) and self.peek(1) == "of" and self.peek(2 + (self.peek(2) == "this")) == "Chapter":
                part, this = self.peek(), self.peek(2) == "this"
                chapter = None if this else self.peek(3)
                if this or ROMAN.match(chapter):
                    self.at += 4
                    yield self.ref("part", word, target=f"{'' if this else chapter}:{part}")
            elif kind in ("chapter", "schedule") and (m := re.match(r"([IVXL]+)(?:[-‑]([A-H]))?$", self.peek())):
                self.at += 1
                number = m[1] + (f":{m[2]}" if m[2] and kind == "chapter" else "")
                outside = self.elsewhere() if kind == "chapter" else self.peek() in ("to", "of") and self.peek(1) == "the" and self.peek(2)[:1].isupper()
                yield self.ref("part" if ":" in number else kind, word, target=number, rows=self.rows() if kind == "schedule" and not outside else [], external=outside)

    @staticmethod
    def ref(kind, word, base=None, labels=(), target=None, rows=(), external=False) -> dict:
        return {"kind": kind, "word": word, "base": base, "labels": list(labels), "target": target, "rows": list(rows), "external": bool(external)}


def references(texts: DataFrame) -> DataFrame:
    """(from_id, ref_key, kind, word, base, labels, target, rows, external): every reference of texts (id, text), in order."""

    def read(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(Reader(t).read()) if t else [])

    found_in = F.pandas_udf(read, f"array<{REF}>")
    rows = texts.select(F.col("id").alias("from_id"), F.posexplode(found_in("text")).alias("pos", "ref"))
    return rows.select("from_id", F.concat_ws("#", "from_id", F.col("pos").cast("string")).alias("ref_key"), "ref.*")


def cross_refs(texts: DataFrame, nodes: DataFrame, closure: DataFrame, table_rows: DataFrame) -> DataFrame:
    """Edges (from_id, raw, ref_type, to_id, resolution) of texts (id, text).

    nodes: (id, kind, chapter) with chapters as labels; closure: (pid, ancestor, depth); table_rows: (row_id, table_id).
    References into other instruments are external. Sections resolve to their deepest known node, relative
    references to the nearest node upwards that has their labels, the rest by name. Serial numbers after a
    section or schedule are edges of their own, to rows of the tables below it.
    """
    refs = materialize(references(texts), "found-references")  # read once for each kind below
    ids, labels = nodes.select("id"), F.array_join("labels", "")
    # kinds of references that no text has need no joins: one row of flags
    has = refs.agg(*[F.coalesce(F.bool_or(c & ~F.col("external")), F.lit(False)).alias(k) for k, c in {"near": F.col("kind") == "relative", "named": F.col("target").isNotNull(), "rows": F.size("rows") > 0}.items()]).first()
    out = refs.where("external").select("from_id", _raw(labels).alias("raw"), F.lit("external").alias("ref_type"), F.lit(None).cast("string").alias("to_id"), F.lit("external").alias("resolution"))
    sections = resolve(refs.where("kind = 'section' and not external"), ids, closure)
    kind = F.when(F.size("labels") > 0, "provision").otherwise("section")
    out = out.unionByName(sections.select("from_id", _raw(labels).alias("raw"), kind.alias("ref_type"), "to_id", "resolution"))
    if has["near"]:
        near = relative(refs.where("kind = 'relative' and not external"), ids, closure)
        out = out.unionByName(near.select("from_id", _raw(labels).alias("raw"), F.lit("provision").alias("ref_type"), "to_id", "resolution"))
    scopes = sections.select("ref_key", "from_id", "rows", F.coalesce("to_id", "base").alias("scope"))
    if has["named"]:
        named, hit = _named(refs, nodes)
        out = out.unionByName(named.select("from_id", F.concat_ws(" ", "word", "target").alias("raw"), F.col("kind").alias("ref_type"), F.when(hit, F.col("path")).alias("to_id"), F.when(hit, "exact").otherwise("unresolved").alias("resolution")))
        scopes = scopes.unionByName(named.where(hit).select("ref_key", "from_id", "rows", F.col("path").alias("scope")))
    return out.unionByName(_row_edges(scopes, closure, table_rows)) if has["rows"] else out


def _named(refs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, Column]:
    """References by name with the id (path) that the name stands for, and whether there is such a node."""
    own = nodes.select(F.col("id").alias("from_id"), F.col("chapter").alias("own_chapter"))
    named = refs.where("target is not null and not external").join(own, "from_id", "left")
    chapter = F.coalesce(F.nullif(F.substring_index("target", ":", 1), F.lit("")), "own_chapter")
    path = F.when(F.col("kind") == "schedule", F.concat(F.lit("sch:"), "target")).when(F.col("kind") == "part", F.concat(F.lit("ch:"), chapter, F.lit(":"), F.substring_index("target", ":", -1))).otherwise(F.concat(F.lit("ch:"), "target"))
    named = named.withColumn("path", path).join(nodes.select(F.col("id").alias("path"), F.lit(True).alias("known")), "path", "left")
    return named, F.coalesce("known", F.lit(False))


def _raw(labels: Column) -> Column:
    return F.concat(F.regexp_replace("word", "s$", ""), F.lit(" "), F.regexp_replace(F.coalesce("base", F.lit("")), "^s", ""), F.coalesce(F.nullif(labels, F.lit("")), F.coalesce("target", F.lit(""))))


def _row_edges(scopes: DataFrame, closure: DataFrame, table_rows: DataFrame) -> DataFrame:
    asked = scopes.select("ref_key", "from_id", "scope", F.posexplode("rows").alias("nth", "serial"))
    tables = tables_under(table_rows.select("table_id"), closure)
    tried = asked.join(tables, "scope", "left").withColumn("row_key", F.concat_ws("#", "ref_key", F.col("nth").cast("string"), F.coalesce("table_id", F.lit(""))))
    parts = tried.select("*", F.regexp_extract("serial", r"^\d+[A-Z]?", 0).alias("number"), F.nullif(F.regexp_extract("serial", r"\(.*$", 0), F.lit("")).alias("sub"))
    hits = table_row_refs(parts.select(F.col("row_key").alias("ref_key"), "table_id", "number", "sub"), table_rows).withColumnRenamed("ref_key", "row_key")
    order = F.struct(F.when(F.col("resolution") == "exact", 0).when(F.col("resolution") == "partial", 1).otherwise(2), "row_key")
    best = parts.join(hits, "row_key").groupBy("ref_key", "nth", "from_id", "scope", "serial").agg(F.min_by(F.struct("to_id", "resolution"), order).alias("x"))
    return best.select("from_id", F.concat("scope", F.lit(" Table Sl. No. "), "serial").alias("raw"), F.lit("table_row").alias("ref_type"), "x.to_id", "x.resolution")
