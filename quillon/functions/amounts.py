"""Texts in one form, token by token: amounts of rupees, shares and grouped numbers read alike however they are written.

`Rs. 50,00,000`, `50 lakh` after a rupee sign and `fifty lakh rupees` all read rs5000000. What a token becomes depends on the tokens around
it: a number is an amount after the rupee mark, before `rupees`, or before a scale, where number words count too. Texts without scales and
odd numbers, which are most, are read by replacements that say the same.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.tokens import once, parts

#: Number words by value (fixed values).
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
TENS = "thirty forty fifty sixty seventy eighty ninety hundred".split()
VALUES = {w: n for n, w in enumerate(UNITS)} | {w: 10 * n for n, w in enumerate(TENS, 3)}
#: Scales by value (fixed values).
SCALES = {"lakh": 100_000, "lakhs": 100_000, "crore": 10_000_000, "crores": 10_000_000}
#: Marks that go, that part words, and that stay (fixed values).
DROPPED, PARTED, KEPT = "“”‘’'`\"", "—–‑-", "%.,/()_"


def _among(t: Column, values: dict[str, int]) -> Column:
    return F.try_element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))]), t)


#: What only the tokens tell: scales, points and commas after a fraction, digits of other scripts, and the signs that stand for parts of amounts.
_ODD = r"(?U)lakh|crore|[0-9]\.[0-9]+[.,][0-9]|[\d&&[^0-9]]|[\x01\x02]"
_RUN = r"[^\W\d_]"  # what a token of letters is made of
_VALUE = r"([0-9]++)(?:\.0+(?![0-9]))?(\.[0-9]+)?"  # paise that aren't nought stand apart


def one_form(text: Column) -> Column:
    """A text in lower case, with its amounts in one form and without what only style decides."""
    return once(F.replace(F.lower(text), F.lit("₹"), F.lit(" rs ")), lambda s: F.when(s.rlike(_ODD), by_tokens(s)).otherwise(_replaced(s)))


def by_tokens(text: Column) -> Column:
    """The same of any text in lower case, from each token and those around it."""
    return _tidy(once(parts(text), lambda p: once(F.transform(p, lambda x, i: _amount(p, x, i)), lambda a: _written(p, a))))


def _replaced(text: Column) -> Column:
    """The same where nothing is odd. Amounts are signed for the steps in between: their mark, and the place of their paise."""
    rules = [
        (r"(?<=[0-9]),(?=[0-9])", ""),
        (rf"(?U)([0-9])\s*(?:%|per(?:\s+)?cent(?!{_RUN}))", "$1%"),
        (rf"(?U)(?<!{_RUN})rs\s*(?:\.\s*)?{_VALUE}", " \x01$1 \x02$2 "),
        (rf"(?U)(?<![0-9\x01])(?<!\x02\.){_VALUE}\s+rupees(?!{_RUN})", " \x01$1 \x02$2 "),
        (f"[{DROPPED}\x02]", ""),
        (r"(?U)[^\w%.,/()\x01]+", " "),
    ]
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by)
    return _tidy(F.replace(text, F.lit("\x01"), F.lit("rs")))


def _tidy(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^[ .,;]+|[ .,;]+$", "")


def _token(p: Column, i: Column) -> Column:
    return F.coalesce(F.get(p, i)["t"], F.lit(""))


def _is_number(t: Column) -> Column:
    return t.rlike("^[0-9]")


def _mark_before(p: Column, i: Column) -> Column:
    """How many tokens before place i are the rupee mark: rs, or rs with a stop."""
    return F.when(_token(p, i - 1) == "rs", 1).when((_token(p, i - 1) == ".") & (_token(p, i - 2) == "rs"), 2).otherwise(0)


def _amount(p: Column, x: Column, i: Column) -> Column:
    """Of the token at place i: what it reads as an amount, how many tokens before it are its mark, and how many after it belong to it; null where it is none."""
    t, number = x["t"], _is_number(x["t"])
    value = F.when(number, F.replace(t, F.lit(","), F.lit("")).try_cast("double")).otherwise(_among(t, VALUES))
    scale = F.when(F.get(p, i + 1)["far"], _among(_token(p, i + 1), SCALES))
    mark = _mark_before(p, i)
    whole = F.replace(F.regexp_extract(t, r"^[\d,]+", 0), F.lit(","), F.lit(""))
    rest = F.regexp_replace(F.regexp_extract(t, r"\.\d+$", 0), r"^\.0+$", "")  # paise that aren't nought stand apart
    told = F.get(p, i + 1)["far"] & (_token(p, i + 1) == "rupees")
    scaled = F.bround(value * scale).cast("decimal(38,0)").cast("string")
    after = F.when(scale.isNotNull(), F.when(_token(p, i + 2) == "rupees", 2).otherwise(1)).when((mark == 0) & told, 1).otherwise(0)
    reads = F.when(value.isNotNull() & scale.isNotNull(), scaled).when(number & ((mark > 0) | told), F.concat_ws(" ", whole, F.nullif(rest, F.lit(""))))
    return F.when(reads.isNotNull(), F.struct(F.concat(F.lit(" rs"), reads, F.lit(" ")).alias("reads"), mark.alias("mark"), after.alias("after")))


def _written(p: Column, a: Column) -> Column:
    """The tokens joined again: amounts as they read, their marks and what belongs to them gone, other tokens by the marks' lists."""
    of = lambda i, field: F.coalesce(F.get(a, i)[field], F.lit(0))

    def word(x: Column, i: Column) -> Column:
        t, before = x["t"], _token(p, i - 1)
        taken = (of(i + 1, "mark") >= 1) | (of(i + 2, "mark") >= 2) | (of(i - 1, "after") >= 1) | (of(i - 2, "after") >= 2)
        share = (t == "%") | (t == "percent") | ((t == "per") & (_token(p, i + 1) == "cent"))
        cent = (t == "cent") & (before == "per") & _is_number(_token(p, i - 2))
        far = F.when(x["far"], " ").otherwise("")
        kept = F.when(_is_number(t), F.replace(t, F.lit(","), F.lit(""))).otherwise(t)
        plain = t.rlike(r"(?U)^[\w]") | F.contains(F.lit(KEPT), t)
        out = F.when(share & _is_number(before), "%").when(F.contains(F.lit(DROPPED), t), far).when(F.contains(F.lit(PARTED), t), " ").when(plain, F.concat(far, kept)).otherwise(" ")
        return F.when(F.get(a, i).isNotNull(), F.get(a, i)["reads"]).when(taken | cent, "").otherwise(out)

    return F.array_join(F.transform(p, word), "")
