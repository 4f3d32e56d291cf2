"""Repair of conversations against a search over all edits, and against the layers' own costs."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import dialogue as D

SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(k, 1)
    return out


def cheapest(turns):
    """Cost, audit and repaired lines: a search through (cost, audit) with roles written out, and the grammar as a pattern."""
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, roles, lines = heapq.heappop(queue)
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, lines
        key = i, ("" if not roles else "s" if roles == "s" else roles[-1])
        if key in done:
            continue
        done.add(key)
        steps = [("I", c, 2, i, f"{n}:") for c, n in (("u", "user"), ("a", "assistant"))]
        if i < len(turns):
            role, text, must, cut = turns[i]
            steps.append(("D", "", 3, i + 1, None))
            if not must:
                steps += [("R", c, 2 + cut, i + 1, f"{n}:{text}") for c, n in (("u", "user"), ("a", "assistant"))]
                if role[:1]:
                    steps.append(("K", role[:1], cut, i + 1, f"{role}:{text}"))
        for letter, c, price, j, line in steps:
            if re.fullmatch("(s?(ua)*u?)?", roles + c) and len(roles) <= 2 * len(turns) + 4:
                heapq.heappush(queue, (cost + price, audit + letter, j, roles + c, lines if line is None else (*lines, line)))


def expected(rows):
    """The report of one conversation's damaged rows."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, turns, n = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            n[fault] += 1
        turns.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    at = [t for _, t, _, _ in rows if t is not None]
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit, lines = cheapest(turns)
    return (max(at) - min(at) + 1 - len(set(at)) if at else 0, *n.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def check(spark, rows, frame=None):
    got = {r[0]: tuple(r)[1:] for r in D.reports(D.damaged(frame or spark.createDataFrame(rows, SCHEMA))).collect()}
    after = damage(rows)
    assert got == {c: expected([r for r in after if r[0] == c]) for c in {r[0] for r in rows}}
    return got


def made(n, seed):
    r = random.Random(seed)
    texts = ["Fine.", "Well!", "cut off", " ", "", "\x0b\n", "Why?", "x", "é.", "ends \n", "A? b"]
    return [(r.randrange(n), r.choice([*range(8), None, -3]), r.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool", "umpire"]), r.choice([*texts, None])) for _ in range(4 * n)]


def test_against_a_search_over_all_edits(spark):
    check(spark, made(150, 1) + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Yes.")])


def test_given_conversations(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    got = check(spark, [tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()], frame)
    assert sum(r[5] for r in got.values()) > 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suatx"), st.booleans(), st.booleans()), max_size=9))
def test_layers_and_trace(turns):
    """The passes alone, against the search."""
    rows = [(c, str(k), bad, cut and not bad) for k, (c, bad, cut) in enumerate(turns)]
    places = [D.END]
    for c, _, bad, cut in reversed(rows):
        places.insert(0, D.before_turn(places[0], c, bad, cut))
    assert all(p[1] & 15 and p[1] >> 4 * (D.SPREAD - 1) == 15 for p in places)
    trace, audit, lines = D.Trace(places[0]), "", []
    edits = [e for k, (c, text, bad, cut) in enumerate(rows) for e in trace.turn(places[k], places[k + 1], c, text, bad, cut)]
    for letter, role, text in [*edits, *trace.end()]:
        audit += letter
        lines += [f"{role}:{text}"] if letter != "D" else []
    assert (D.least_cost(places[0]), audit, tuple(lines)) == cheapest(rows) and trace.left == 0


@pytest.mark.parametrize("turns", [[("s", False, False)] * 200, [("a", False, True)] * 200, [("u", False, False), ("x", True, False)] * 100])
def test_layers_suffice_for_any_tail(turns):
    place = D.END
    for c, bad, cut in turns:
        place = D.before_turn(place, c, bad, cut)
        assert place[1] & 15 and place[1] >> 4 * (D.SPREAD - 1) == 15


def test_every_turn_lost_and_empty_tables(spark):
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = check(spark, [(lost, 0, "user", "Gone.")])
    assert got[lost] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert D.reports(D.damaged(spark.createDataFrame([], SCHEMA))).collect() == []


def test_long_conversation_and_long_text(spark):
    rows = [(1, k, "user" if k % 3 else "system", f"Turn {k % 700}{'.' * (k % 2)}") for k in range(3000)] + [(2, 0, "user", "long text " * 50000), (2, 1, "assistant", "Yes.")]
    got = {r["conv_id"]: r for r in D.reports(D.damaged(spark.createDataFrame(rows, SCHEMA))).collect()}
    audit = got[1]["audit"]
    after = [r for r in damage(rows) if r[0] == 1]
    assert len(audit) - audit.count("I") == len(after) and got[1]["duplicate"] > 0
    # what the edits cost adds up, the truncated turns that stay included
    kept, k, price = 0, 0, {"I": 2, "D": 3, "R": 2, "K": 0}
    for letter in audit:
        if letter != "I":
            kept += letter in "KR" and not after[k][3].endswith((".", "!", "?"))
            k += 1
    assert got[1]["cost"] == sum(price[c] for c in audit) + kept


def test_clashing_columns_and_text_ids(spark):
    rows = [("a", 0, "user", "Hi.", 1, "x", True, "y"), ("a", 1, "assistant", "Yes.", 2, "x", False, "y")] * 2
    frame = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string, nth int, blank string, present boolean, here string")
    row = D.reports(D.turns(frame)).first()
    assert (row["conv_id"], row["duplicate"], row["cost"], row["audit"]) == ("a", 2, 6, "KDKD")


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Well?"), (1, 3, "user", " ")]
    frame = spark.createDataFrame(rows, SCHEMA)
    report, edits = D.reports(D.turns(frame)).first(), sorted(D.repaired(D.turns(frame)).collect(), key=lambda r: r["place"])
    assert "".join(e["edit"] for e in edits) == report["audit"]
    text = "\n".join(f"{e['role']}:{e['text']}" for e in edits if e["edit"] != "D")
    assert hashlib.sha256(text.encode()).hexdigest() == report["repaired_sha256"]
    assert re.fullmatch("(s?(ua)+)?", "".join(e["role"][0] for e in edits if e["edit"] != "D"))


def test_one_shuffle(spark):
    plan = D.reports(D.damaged(spark.createDataFrame([(1, 0, "user", "Hi.")], SCHEMA)))._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("Exchange hashpartitioning") == 1
