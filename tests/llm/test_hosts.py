"""Host-level quality rules against plain loops, and their verdicts on made-up hosts."""

import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import hosts

SCHEMA = "doc_id long, text string, source string"


def plain(text):
    """The measures of one text, word by word."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def prose(k, n=40):
    return " ".join(f"word{k}x{i}" for i in range(n))


def verdicts(spark, rows, schema=SCHEMA):
    return {r["doc_id"]: r for r in hosts.host_verdicts(spark.createDataFrame(rows, schema)).collect()}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n\x0b\x85 ab#é👩", max_size=120), min_size=1, max_size=20))
def test_measures_of_any_text(spark, texts):
    got = {r["doc_id"]: tuple(r)[1:] for r in hosts.measured(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).drop("source", "n_lines").collect()}
    for k, t in enumerate(texts):
        n, chars, symbols, dup, covered = plain(t)
        assert got[k] == (n, chars, symbols, dup, covered), t


def test_long_and_odd_texts(spark):
    texts = [None, "", "\n\n", " ".join(["again"] * 30), prose(0, 20000) + " " + prose(0, 9), " ".join(f"w{i % 5}" for i in range(500)), "a\na \na\n\na", "one line\n" * 3]
    got = verdicts(spark, [(k, t, "h") for k, t in enumerate(texts)])
    for k, t in enumerate(texts):
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain(t)
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_host_verdicts(spark):
    rows = [(k, "too short" if k < 95 else prose(k), "bad") for k in range(100)]
    rows += [(1000 + k, "too short" if k < 5 else prose(k), "good") for k in range(100)]
    rows += [(2000 + k, prose(k) + " ##" * 9, "symbols") for k in range(50)] + [(3000, prose(1) + " ##" * 9, "good"), (4000, prose(2), None), (4001, "short", None), (5000, prose(3), "")]
    got = verdicts(spark, rows)
    assert not any(got[k]["kept"] for k in range(100))  # the whole host goes
    assert [got[1000 + k]["kept"] for k in range(100)] == [False] * 5 + [True] * 95
    assert not any(got[2000 + k]["kept"] for k in range(50)) and got[3000]["kept"]  # one fault, two hosts
    assert got[4000]["kept"] and got[4000]["host_docs"] is None and not got[4001]["kept"] and got[5000]["host_docs"] == 1


def test_small_hosts_are_shrunk(spark):
    """One failure out of one page says little of a host where hosts hardly differ."""
    rows = [(100 * h + k, "short" if k < 10 else prose(k), f"h{h}") for h in range(20) for k in range(100)] + [(9000, "short", "tiny"), (9001, prose(7), "tiny")]
    got = verdicts(spark, rows)
    assert got[9000]["host_rate"] < 0.2 and got[9001]["kept"] and not got[9000]["kept"]


def test_prior_of_one_host_and_of_equal_hosts(spark):
    counts = lambda rows: spark.createDataFrame(rows, "n long, " + ", ".join(f"f_{r} long" for r in hosts.RULES))
    a, b = hosts.priors(counts([(10, 5, 0, 0, 10)]))["base"]
    assert a / (a + b) == pytest.approx(0.5)
    assert sum(hosts.priors(counts([(100, 10, 0, 0, 0)] * 5))["base"]) == hosts.MOST_WEIGHT  # no more spread than chance gives
    assert sum(hosts.priors(counts([(100, 0, 0, 0, 0), (100, 100, 0, 0, 0)]))["base"]) < 2
    assert hosts.priors(counts([]))["base"] == (0.0, 0.0)


def test_odd_tables(spark):
    assert verdicts(spark, []) == {}
    assert hosts.host_verdicts(spark.createDataFrame([(1, prose(1))], "doc_id long, text string")).first()["kept"]
    extra = "doc_id long, text string, source string, n long, kept int, words string, lines string, f_base int, row string, host_docs string"
    rows = [(None, prose(1), "a", 1, 2, "x", "y", 3, "z", "h")] * 2 + [(3, None, "a", 1, 2, "x", "y", 3, "z", "h")]
    df = spark.createDataFrame(rows, extra)
    out = hosts.host_verdicts(df).collect()
    assert len(out) == 3 and sum(r["kept"] for r in out) == 2
    good = hosts.keep_good(df)
    assert good.columns == df.columns and [tuple(r) for r in good.collect()] == rows[:2]


def test_no_python_in_the_plan(spark):
    plan = hosts.judged(spark.createDataFrame([(1, prose(1), "a")], SCHEMA))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
