"""Texts as arrays of tokens, and tests on a token and those around it: what rules over words are written in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number with its grouping and fraction, a run of letters, or one other character; each with the white space before it.
PARTS = r"(?U)\s*(?:\d+(?:,\d+)*(?:\.\d+)?|[^\W\d_]+|\S)"
#: Words with their inner hyphens and digits, bracketed labels, numbers with a hyphen and a tail, and other single characters.
WORDS = r"(?U)\d+-\d+|\(\w{1,4}\)|\w+(?:[-‑]\w+)*|\S"
LABEL = r"^\(\w{1,4}\)$"


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def parts(text: Column) -> Column:
    """array of (t: token, far: whether white space stands before it)."""
    found = F.regexp_extract_all(text, F.lit(PARTS), F.lit(0))
    return F.transform(found, lambda p: F.struct(F.regexp_replace(p, r"(?U)^\s+", "").alias("t"), p.rlike(r"(?U)^\s").alias("far")))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def at(w: Column, i: Column) -> Column:
    """The token at place i from 0; an empty string outside."""
    return F.coalesce(F.get(w, i), F.lit(""))


def places(w: Column, test: Callable[[Column], Column]) -> Column:
    """The places from 0 where test(place) holds."""
    return F.filter(F.transform(w, lambda _, i: i), test)


def labels_from(w: Column, i: Column, most: int = 12) -> Column:
    """The labels in a row from place i on."""
    rest = F.slice(w, i + 1, F.lit(most))
    stop = F.array_position(F.transform(rest, lambda x: x.rlike(LABEL)), F.lit(False))
    return F.when(i >= F.size(w), F.array().cast("array<string>")).otherwise(F.slice(rest, F.lit(1), F.when(stop > 0, stop - 1).otherwise(F.size(rest)).cast("int")))


def plain_words(text: Column) -> Column:
    """A text's words in lower case with a blank around each: phrases are looked up in it by containment."""
    return F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0)), " "), F.lit(" "))


def says_any(plain: Column, phrases: list[str]) -> Column:
    """Whether one of the phrases stands in a text of `plain_words`, as whole words; a phrase that ends in * is the beginning of a word."""
    forms = [f" {p[:-1]}" if p.endswith("*") else f" {p} " for p in phrases]
    return F.exists(F.array(*map(F.lit, forms)), lambda f: F.contains(plain, f))
