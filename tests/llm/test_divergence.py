"""The audit of sources against plain loops, and radix selection against sorting."""

import random
import re
from collections import Counter, defaultdict

import pytest

from quillon.llm import divergence as D
from quillon.llm.common import materialize


def p(count, total, v):
    return 1 + D.SCALE * (count + 5) // (total + 5 * v)


def plain(rows, least, top=D.TOP):
    """The audit of (text, lang, source), group by group."""
    n, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = set()
    for lang in {g[0] for g in n}:
        kept = [t for t, d in docs[lang].items() if d >= least]
        sources = [s for g, s in n if g == lang]
        total = {s: sum(n[lang, s][t] for t in kept) for s in sources}
        whole = sum(total.values())
        for s in sources:
            own = lambda t, s=s: p(n[lang, s][t], total[s], len(kept))
            apart = [(-sum(abs(own(t) - p(n[lang, o][t], total[o], len(kept))) for t in kept), o.encode()) for o in sources if o != s]
            over = [(own(t) - p(sum(n[lang, o][t] for o in sources), whole, len(kept)), t) for t in kept if n[lang, s][t]]
            out |= {(lang, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(sorted(apart), 1)}
            out |= {(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(sorted((-v, t.encode()) for v, t in over if v > 0)[:top], 1)}
    return out


def check(spark, rows, least=3, top=D.TOP, schema="text string, lang string, source string"):
    frame = spark.createDataFrame(rows, schema)
    got = [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in D.audit(frame, least, top).collect()]
    assert len(got) == len(set(got)) and set(got) == plain([r[:3] for r in rows], least, top)
    return got


def made(n, sources, seed=3, words=60):
    r = random.Random(seed)
    vocabulary = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(words)] + ["Été", "中文", "naïve", "ÉTÉ"]
    return [(" ".join(r.choices(vocabulary, k=r.randrange(30))) + r.choice(["", ".", " 12x!"]), r.choice(["en", "fr"]), f"s{r.randrange(sources)}") for _ in range(n)]


def test_against_plain_loops(spark):
    odd = [(None, "en", "s0"), ("", None, None), ("words of no lang", None, None), ("text", "en", None), ("x" * 100_000 + " way", "en", "s1"), ("1 2 3", "it", "a"), ("", "it", "b")]
    got = check(spark, made(150, 4) + odd * 2)
    assert any(g[:4] == ("it", "a", "pair", "b") and g[4] == 0 for g in got)


@pytest.mark.parametrize(("sources", "terms"), [(3, 4), (1, 1), (64, 64)])
def test_blocks_and_buckets(spark, sources, terms):
    groups, postings = D.shares(spark.createDataFrame(made(120, 7), "text string, lang string, source string"), 3)
    got = {(r["lang"], r["source"], r["item"]): r["value"] for r in D.pairs(groups, postings, sources, terms).collect()}
    assert got == {g[:2] + g[3:4]: g[4] for g in plain(made(120, 7), 3) if g[2] == "pair"}


def test_no_kept_terms_and_one_source(spark):
    check(spark, made(20, 3), least=1000)
    check(spark, made(20, 1))


def test_tied_terms_are_cut_by_bytes(spark):
    """All terms of a source have one value, and more of them than ranks share first letters."""
    names = [a + b + c for a in "ab" for b in "abé" for c in ["", "b", "bb", "中", "bbb"]]
    rows = [(" ".join(names), "en", "s0")] * 3 + [("other words here", "en", "s1")] * 3
    got = check(spark, rows, top=11)
    assert sum(g[2] == "term" and g[1] == "s0" for g in got) == 11


def test_few_entries_at_a_time(spark):
    frame = spark.createDataFrame(made(80, 3), "text string, lang string, source string")
    few, many = ({tuple(r) for r in D.counted(frame, n).collect()} for n in (5, D.ENTRIES))
    assert few == many and len(many) > 100


def test_odd_tables(spark):
    assert D.audit(spark.createDataFrame([], "text string, lang string, source string")).collect() == []
    assert [tuple(r) for r in D.audit(spark.createDataFrame([("a",)], "text string")).collect()] == []
    extra = "text string, lang string, source string, term string, n int, place string, value double, item int, v int, b int"
    check(spark, [(*r, "t", 1, "p", 0.5, 2, 3, 4) for r in made(40, 3)], schema=extra)


@pytest.mark.parametrize("most", [0, 3, 5000, 2**40])
def test_top_ranks(spark, most):
    r = random.Random(most)
    rows = [("g" if k % 3 else "hot", r.randrange(most + 1), "".join(r.choices("abé", k=r.randrange(6)))) for k in range(400)] + [("small", 1, "x")]
    frame = materialize(spark.createDataFrame(rows, "g string, value long, item string"), "rows")
    got = sorted(tuple(x) for x in D.top_ranks(frame, ["g"], "value", "item", 20, "test").collect())
    want = []
    for g in {x[0] for x in rows}:
        best = sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2].encode()))[:20]
        want += [(*x, k) for k, x in enumerate(best, 1)]
    assert got == sorted(want)


def test_counts_beyond_64_bits(spark):
    row = spark.createDataFrame([(10**12, 10**13, 10**6)], "n long, total long, v long").select(D.share("n", "total", "v")).first()
    assert row[0] == p(10**12, 10**13, 10**6)
