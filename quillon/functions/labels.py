"""Labels of provisions: Roman numerals, classes of labels, and what may follow a label, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import once, strings

#: Numerals by decimal place (fixed values).
ONES = ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]
TENS = ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"]
HUNDREDS = ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"]
VALUES = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def to_roman(n: Column) -> Column:
    place = lambda digits, by: F.element_at(strings(digits), (F.floor(n / by) % 10 + 1).cast("int"))
    return F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), place(HUNDREDS, 100), place(TENS, 10), place(ONES, 1))


def roman_value(label: Column) -> Column:
    """The number of a canonical Roman numeral in either case, else null."""
    numeral = F.upper(label)
    values = F.create_map(*[F.lit(x) for kv in VALUES.items() for x in kv])
    digits = F.transform(F.filter(F.split(numeral, ""), lambda c: c != ""), lambda c: F.coalesce(F.try_element_at(values, c), F.lit(0)))
    # read from the left: a smaller digit before a larger one had been added, and is taken off twice
    total = F.aggregate(digits, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), lambda s, v: F.struct((s["sum"] + v - F.when(s["last"] < v, 2 * s["last"]).otherwise(0)).alias("sum"), v.alias("last")), lambda s: s["sum"])
    good = numeral.rlike("^[IVXLCDM]+$")
    return F.when(good, once(total, lambda t: F.when(to_roman(t) == numeral, t)))


def is_alpha_label(label: Column) -> Column:
    n = F.length(label)
    return (n == 1) | (label.startswith("z") & (n <= 4)) | ((n == 2) & roman_value(label).isNull())


def label_classes(label: Column) -> Column:
    """Which of num, alpha, roman, ALPHA, ROMAN a label may be."""
    low, high = label.rlike(r"^\P{Lu}*\p{Ll}\P{Lu}*$"), label.rlike(r"^\P{Ll}*\p{Lu}\P{Ll}*$")
    roman = roman_value(label).isNotNull()
    some = F.array(F.when(low & is_alpha_label(label), "alpha"), F.when(low & roman, "roman"), F.when(high & (F.length(label) == 1), "ALPHA"), F.when(high & roman, "ROMAN"))
    return F.when(label.rlike("^[0-9]"), F.array(F.lit("num"))).otherwise(F.array_compact(some))


def alpha_next(label: Column) -> Column:
    """a, b, ... z, za, zb, ..."""
    last = F.substring(label, -1, 1)
    return F.when(last == "z", F.concat(label, F.lit("a"))).otherwise(F.concat(F.substring(label, F.lit(1), F.length(label) - 1), F.char(F.ascii(last) + 1)))


def follows(before: Column, label: Column, kind: Column) -> Column:
    """Whether a label continues the sequence of its kind: the next one, the one after that, or an inserted one."""
    number = lambda c: F.regexp_extract(c, r"^(\d+)", 1).try_cast("int")
    letters = lambda c: F.regexp_extract(c, r"^\d+([A-Z]*)", 1)
    step = number(label) - number(before)
    num = step.between(1, 2) | ((step == 0) & (letters(label) > letters(before)))
    p, q = F.lower(before), F.lower(label)
    inserted = q.startswith(p) & (F.length(q) == F.length(p) + 1)
    resumed = (F.length(p) == 2) & ~p.startswith("z") & (q == alpha_next(F.substring(p, 1, 1)))
    alpha = (q == alpha_next(p)) | (q == alpha_next(alpha_next(p))) | inserted | resumed
    roman = (roman_value(label) - roman_value(before)).between(1, 2)
    return F.coalesce(F.when(kind == "num", num).when(F.lower(kind) == "alpha", alpha).otherwise(roman), F.lit(False))
