"""Near-duplicate vectors and documents, and repeated text, against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from quillon.llm import common, minhash, suffix, vectors


def components(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return [root(i) for i in range(n)]


def test_components(spark):
    rng = np.random.default_rng(0)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(k, k + 1) for k in range(200, 260)]
    out = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(links, "a long, b long"), "test").collect()}
    want = components(261, links)
    assert all(out.get(i, i) == want[i] for i in range(261))
    assert common.components(spark.createDataFrame([], "a long, b long"), "none").count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(1)
    x = [rng.normal(size=16) for _ in range(120)]
    x += [v + rng.normal(size=16) * 0.06 for v in x[:80]] + [v * 3 for v in x[:10]] + [x[0]] * 5
    rows = [(k, [float(f) for f in v], int(k % 2)) for k, v in enumerate(x)]
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [None] * 16, 1), (1004, rows[0][1], None), (1005, [], 1), (1006, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as id", "'x' as cell")
    out = {r["vec_id"]: r for r in vectors.near_vectors(df, 0.98).collect()}
    assert len(out) == len(rows)
    m = np.array([np.float32(v) for v in x], np.float64)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    label = np.arange(len(x)) % 2
    near = (u @ u.T >= 0.98) & (label[:, None] == label[None]) & ~np.eye(len(x), dtype=bool)
    want = components(len(x), zip(*np.nonzero(near), strict=True))
    for k in range(len(x)):
        assert out[k]["n_links"] == near[k].sum() and out[k]["component_id"] == want[k] and out[k]["kept"] == (want[k] == k)
    for k in range(1000, 1007):
        assert out[k]["n_links"] == 0 and out[k]["component_id"] == k and out[k]["kept"]
    assert vectors.near_vectors(df.where("false")).count() == 0


def shingles(text, n):
    w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


@pytest.mark.parametrize("block", [512, 20])
def test_documents(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = np.random.default_rng(2)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 3000, n)]
    base = word(150)
    texts = [None, "", " \t\n", "one", "ONE", "one two", "É x y", "é x y"]
    for _ in range(60):
        t = list(base)
        for at in rng.integers(0, 150, rng.integers(0, 8)):
            t[at] = "edit%d" % rng.integers(1 << 30)
        texts.append(" ".join(t))
    for _ in range(20):
        t = word(int(rng.integers(3, 60)))
        texts += [" ".join(t), " ".join([*t[:-1], "end"]), " ".join(t).upper()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as component", "2 as name")
    out = {r["doc_id"]: r for r in minhash.near_documents(df, 3, 85).collect()}
    s = [shingles(t, 3) for t in texts]
    links = [(i, j) for i in range(len(s)) for j in range(i) if s[i] and 100 * len(s[i] & s[j]) >= 85 * len(s[i] | s[j])]
    want = components(len(s), links)
    for k in range(len(s)):
        assert out[k]["n_shingles"] == len(s[k]) and out[k]["component_id"] == want[k] and out[k]["kept"] == (want[k] == k), texts[k]
    kept = minhash.one_of_each(df, 3, 85)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want)) and kept.columns == df.columns
    assert minhash.near_documents(df.where("false"), 3, 85).count() == 0


def test_repeated_rows_share_a_component(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in minhash.near_documents(df, 3, 85).collect()) == [(1, 1), (1, 1), (2, 1)]


def test_rows_of_one_id_and_rows_without(spark):
    a, b = " ".join(f"w{k}" for k in range(40)), " ".join(f"v{k}" for k in range(40))
    near = a.replace("w39", "x")
    rows = [(5, a), (5, b), (5, b), (3, near), (7, near), (7, near), (None, a), (9, "alone in it"), (9, "alone in it"), (2, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as k", "2 as _doc")
    out = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_documents(df, 3, 85).collect()), key=repr)
    assert out == sorted([(5, 3, False), (5, 5, True), (5, 5, True), (3, 3, True), (7, 3, False), (7, 3, False), (None, 3, True), (9, 9, True), (9, 9, True), (2, 2, True), (2, 2, True)], key=repr)
    kept = minhash.one_of_each(df, 3, 85)
    assert kept.columns == df.columns
    left = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    assert [x for x in left if x[0] != 2] == sorted([(5, b), (3, near), (None, a), (9, "alone in it")], key=repr) and len(left) == 6


def test_estimate_is_corrected():
    rng = np.random.default_rng(4)
    a, b = (np.unique(rng.integers(0, 2**63, 4000).astype(np.uint64)) for _ in range(2))
    shared = a[:2000]
    c = np.unique(np.concatenate([shared, b[:2000]]))
    r = minhash.registers([a, b, c])
    n = np.array([4000.0])
    none, _ = minhash.estimate(r[0:1], r[1:2], n, n)
    third, _ = minhash.estimate(r[0:1], r[2:3], n, n)
    assert abs(none[0]) < 0.03 and abs(third[0] - 1 / 3) < 0.12


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        cover = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                cover[i : i + length] = True
        spans = int(np.diff(np.concatenate([[0], cover.astype(int)])).clip(0).sum())
        out.append((len(r), int(cover.sum()), spans, hashlib.sha256(np.frombuffer(r, np.uint8)[~cover].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("limit", [4000, 1])
def test_repeats(spark, monkeypatch, limit):
    monkeypatch.setattr(suffix, "LIMIT", limit)
    rng = np.random.default_rng(6)
    word = lambda n: "".join(rng.choice(list("abcdefghijé \n"), n))
    passage = word(90)
    texts = [None, "", "short", "z" * 300, word(400), passage, "ab" * 100, word(39)]
    texts += [word(int(rng.integers(0, 60))) + passage[int(rng.integers(0, 30)) :] + word(int(rng.integers(0, 60))) for _ in range(25)]
    texts += [texts[4], texts[4][:200] + "X" + texts[4][200:]]
    df = spark.createDataFrame([(None if k == 3 else k, t) for k, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 as k", "2 as doc", "3 as p")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.removal_report(df, 40).collect()}
    want = brute(texts, 40)
    for k in range(len(texts)):
        assert got[None if k == 3 else k] == want[k], k
    cut = suffix.without_repeats(df, 40)
    rows = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert cut.columns == df.columns and rows[0] is None and rows[2] == "short"
    assert all(passage not in (t or "") for t in rows.values())
    assert suffix.removal_report(df.where("false"), 40).count() == 0


def test_repeated_windows():
    rng = np.random.default_rng(7)
    text = rng.integers(97, 99, 3000).astype(np.uint8)
    start, windows, length = np.array([0, 500, 1200]), np.array([401, 600, 900]), 24
    raw = text.tobytes()
    at = [s + i for s, w in zip(start, windows, strict=True) for i in range(w)]
    seen = Counter(raw[a : a + length] for a in at)
    assert suffix.repeated_windows(text, start, windows, length).tolist() == [seen[raw[a : a + length]] > 1 for a in at]


@pytest.mark.parametrize("dim, n", [(3, 1500), (8, 1500), (64, 1200)])
def test_links_across_list_borders_count_at_both_ends(spark, dim, n):
    """The shipped settings against brute force, where many links cross borders; each vector's twin of another length is a world of its own."""
    rng = np.random.default_rng(4)
    low = min(dim, 6)
    x = rng.normal(size=(n, low)) @ rng.normal(size=(low, dim))
    x = np.concatenate([x, x[: n // 4] + rng.normal(size=(n // 4, dim)) * 0.01, x[:50]])
    rows = [(k, "a", v.tolist()) for k, v in enumerate(x)] + [(100_000 + k, "a", [*v.tolist(), 0.0, 0.0]) for k, v in enumerate(x[:300])]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & ~np.eye(len(x), dtype=bool)
    assert near.sum() > 500
    out = {r["vec_id"]: r for r in vectors.near_vectors(df, 0.98).collect()}
    assert [out[k]["n_links"] for k in range(len(x))] == near.sum(1).tolist()
    assert [out[k]["component_id"] for k in range(len(x))] == components(len(x), zip(*np.nonzero(near), strict=True))
    assert [out[100_000 + k]["n_links"] for k in range(300)] == near[:300, :300].sum(1).tolist()


@pytest.mark.parametrize("limit", [4000, 1])
def test_repeated_passages_of_words(spark, monkeypatch, limit):
    monkeypatch.setattr(suffix, "LIMIT", limit)
    rng = np.random.default_rng(16)
    words = lambda n: [str(w) for w in rng.choice(["a", "bb", "été", "D,", "e.", "longer"], n)]
    passage = words(30)
    texts = [None, "", " \t\n", " ".join(words(11)), " ".join(passage), "x " * 40]
    texts += ["  ".join(words(int(rng.integers(0, 20))) + passage[int(rng.integers(0, 10)) :] + words(int(rng.integers(0, 20)))) + "\n" for _ in range(25)]
    texts.append(" ".join(passage).upper().replace("É", "é"))
    n = 12
    split = [[w.translate({c: c + 32 for c in range(65, 91)}) for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for t in texts]
    seen = Counter(tuple(w[i : i + n]) for w in split for i in range(len(w) - n + 1))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffix.removal_report(df, 400, n).collect()}
    kept = {r["doc_id"]: r["text"] for r in suffix.without_repeats(df, n, suffix.WORDS).collect()}
    for k, w in enumerate(split):
        cover = np.zeros(len(w), bool)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                cover[i : i + n] = True
        runs = int(np.diff(np.concatenate([[0], cover.astype(int)])).clip(0).sum())
        assert (got[k]["n_passages"], got[k]["passage_words"], got[k]["n_removed"]) == (runs, int(cover.sum()), 0), k
        left = [x for x, c in zip([x for x in re.split(r"[\x20\x09-\x0D]+", texts[k] or "") if x], cover, strict=True) if not c]
        assert (kept[k] is None) == (texts[k] is None) and [x for x in re.split(r"[\x20\x09-\x0D]+", kept[k] or "") if x] == left, k
