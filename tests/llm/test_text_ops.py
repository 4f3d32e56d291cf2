"""BPE, packing and fingerprints against the tokenizers library and brute force."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillon.llm import bpe, fingerprint, packing

VOCABULARIES = ["byte_bpe_50k", "word_bpe_49k"]
ODD = ["", " ", "\n", "'", "don't we'll 're 's 'S he's'' ''s", "x" * 500, "ab" * 2000, "<|endoftext|>", "a<|endoftext|>b <|startoftext|>c", "  a  b\n\n c \n d\t\te ", "ẛ̣ é ﬁ ΑΣ İ", "1234 ½ ²x", "👩‍👩‍👧 中文 ไทย", "\x1c\x85　z"]


@pytest.fixture(scope="module", params=VOCABULARIES)
def both(request):
    path = public_tokenizers.path(f"{request.param}.json")
    return bpe.load(path), Tokenizer.from_file(path)


def check(both, texts):
    ours, theirs = both
    ids, at = ours.encode(texts)
    for k, e in enumerate(theirs.encode_batch(texts, add_special_tokens=False)):
        own = ids[at[k] : at[k + 1]]
        assert own.tolist() == e.ids, texts[k]
        if not ours.mark:
            assert ours.decode(own) == theirs.decode(e.ids, skip_special_tokens=False)


def test_odd_texts(both):
    check(both, ODD)


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.one_of(st.sampled_from(" 'etaoinshrdlu\n.!1é<|"), st.characters(exclude_categories=["Cs", "Cn", "Co"])), max_size=60), max_size=8))
def test_any_text(both, texts):
    check(both, texts)


def test_long_text_is_cut_between_words(both, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 50)
    check(both, ["words and more words, don't stop " * 30, "x" * 400])


def docs(spark, *texts, extra=""):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 as score", "'s' as source")


def test_round_trip(spark):
    out = bpe.round_trip(docs(spark, None, "", "some text", "some text"), public_tokenizers.path("byte_bpe_50k.json")).collect()
    rows = {r["doc_id"]: r for r in out}
    assert rows[0]["n_tokens"] == rows[1]["n_tokens"] == 0
    assert rows[2]["decoded_sha256"] == hashlib.sha256(b"some text").hexdigest() and rows[2]["ids_sha256"] == rows[3]["ids_sha256"]


def test_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = np.random.default_rng(3)
    texts = [None, "", *(" ".join(rng.choice(["the", "quick", "brown", "fox"], n)) for n in [*rng.integers(1, 90, 120), 700, 64, 63])]
    rows = packing.pack_documents(docs(spark, *texts), path, 64).toPandas()
    theirs = Tokenizer.from_file(path)
    for doc, pieces in rows.groupby("doc_id"):
        ids = np.array([*theirs.encode(texts[doc] or "", add_special_tokens=False).ids, 2], "<u4")
        assert pieces.length.sum() == len(ids) == pieces.doc_tokens.iloc[0]
        for r in pieces.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert set(rows.doc_id) == set(range(len(texts)))
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 64 and (s.offset == s.length.cumsum() - s.length).all()
    assert rows.length.sum() / (64 * rows.sequence_id.nunique()) > 0.97


def test_packing_nothing(spark):
    assert packing.pack_documents(docs(spark).where("false"), public_tokenizers.path("word_bpe_49k.json"), 64).count() == 0


def test_linear_program_reaches_the_bound():
    sizes, demand = [3, 5, 7], [40, 30, 20]
    runs = packing.plan(sizes, demand, 10)
    given = {s: sum(r[2] for r in runs if r[0] == s) for s in sizes}
    assert given == dict(zip(sizes, demand, strict=True))
    used = max(r[3] + -(-r[2] // r[4]) for r in runs)
    assert used <= 45  # 40 * 3 + 30 * 5 + 20 * 7 = 410, so 41 at least


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_fingerprints(spark):
    rng = np.random.default_rng(5)
    word = lambda n: " ".join(rng.choice(list("abcdefgh"), n))
    texts = [None, "", "one two", word(300), word(40), "é🙂" * 30, word(900)]
    texts.append(texts[3])
    out = {r["doc_id"]: r for r in fingerprint.edited_fingerprints(docs(spark, *texts)).collect()}
    order = sorted(range(len(texts)), reverse=True)
    for at, k in enumerate(order):
        own, nxt = texts[k] or "", texts[order[(at + 1) % len(order)]] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + nxt[:half]
        r = out[k]
        assert r["n_chars"] == len(own) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for got, other in ((r["near_edited"], edited), (r["near_next"], nxt)):
            a, b = shingles(own), shingles(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(got - true) < (0.2 if len(a | b) > fingerprint.K else 1e-9)
        assert abs(r["distinct_shingles"] - len(shingles(own))) <= max(0.4 * len(shingles(own)), 0)
    assert out[3]["fingerprint"] == out[7]["fingerprint"]
    assert fingerprint.edited_fingerprints(docs(spark).where("false")).count() == 0


def test_next_documents_by_uneven_null_and_repeated_ids(spark):
    rng = np.random.default_rng(6)
    ids = [None, None, -(2**62), 2**62, 5, 5, 5, *(int(x) for x in rng.integers(0, 60, 40)), *(10**15 + int(x) for x in rng.integers(0, 10**6, 40))]
    rows = [(d, f"t{k:03d} " + "abcdefgh"[k % 8] * (k % 17)) for k, d in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as r", "2 as low", "3 as step")
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1]), reverse=True)
    want = []
    for at, (d, own) in enumerate(order):
        half = len(own) // 2
        want.append((d, hashlib.sha256((own[: len(own) - half] + order[(at + 1) % len(order)][1][:half]).encode()).hexdigest()))
    got = [(r["doc_id"], r["edited_sha256"]) for r in fingerprint.edited_fingerprints(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_sketches_merge(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(list(range(0, 400, 2)), list(range(0, 400, 3)))], "a array<long>, b array<long>")
    a, b = fingerprint.bottom(F.col("a"), 50), fingerprint.bottom(F.col("b"), 50)
    row = df.select(fingerprint.merge(a, b, 50).alias("m"), fingerprint.bottom(F.concat("a", "b"), 50).alias("w"), fingerprint.containment(a, b, fingerprint.resemblance(a, b, 50), 50).alias("c")).first()
    assert row["m"] == row["w"] and 0 <= row["c"] <= 1
