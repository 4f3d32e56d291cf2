"""Every stage of the pipeline on small tables, against what it must keep and cut."""

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline

from .test_dedup_ops import components, shingles
from .test_other_ops import language_rows, toxic_rows


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    rng = np.random.default_rng(9)
    rows, labels = toxic_rows(300)
    passage = " ".join("".join(rng.choice(["pa", "ssa", "ge"], 2)) for _ in range(60))
    docs = [(k, t, "en", "s", len(t)) for k, t in rows]
    word = lambda n: " ".join("".join(rng.choice(["ta", "ri", "so", "ne", "lu"], 3)) for _ in range(n))
    copy = word(120)
    docs += [(k, t, "en", "s", len(t)) for k, t in ((1000, copy), (1001, copy), (1002, copy + " end"), (1003, word(50) + " " + passage + " " + word(50)), (1004, word(50) + " " + passage + " " + word(50)), (1005, "123 456"), (1006, None and ""))  if t is not None]
    docs.append((1007, None, None, None, None))
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), passage


def test_stages(spark, base):
    path, passage = base
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path).cache()
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert not any(k % 4 == 0 for k in seen["toxicity"] if k < 1000) and 1001 in seen["toxicity"]
    assert {1005, 1007} & set(seen["language"]) == set() and {1000, 1003} <= set(seen["language"])
    assert {1001, 1002} & set(seen["near_dedup"]) == set() and {1000, 1003, 1004} <= set(seen["near_dedup"])
    cut = seen["suffix_dedup"]
    assert passage not in cut[1003]["text"] and passage not in cut[1004]["text"] and cut[1003]["n_chars"] == len(cut[1003]["text"])
    assert cut[1000]["text"] == seen["near_dedup"][1000]["text"] and set(cut) == set(seen["near_dedup"])
    assert set(seen["packing"]) == set(cut)


def test_run(spark, base):
    out = corpus_pipeline.run(spark, base[0])
    assert out.count() > 0 and "sequence_id" in out.columns


def test_language_stage_rejects_what_was_not_learned(spark):
    rng = np.random.default_rng(2)
    other = [(5000 + k, " ".join("".join(rng.choice(["жи", "вы", "ро", "ща"], 3)) for _ in range(80)), None) for k in range(10)]
    docs = spark.createDataFrame(language_rows(300) + other, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in corpus_pipeline.language_stage(spark, docs, "").collect()}
    assert not any(k >= 5000 for k in kept) and len(kept) > 280


def test_language_stage_keeps_an_unlabelled_corpus(spark):
    rows = [(1, "some words", None), (2, "12 34", None), (3, None, None), (4, "слова", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in corpus_pipeline.language_stage(spark, docs, "").collect()} == {1, 4}


def test_stages_take_odd_rows(spark, tmp_path):
    """Empty, missing and very long texts, repeated rows, columns with clashing names, and empty tables."""
    rows, labels = toxic_rows(60)
    long = " ".join(f"tari{chr(97 + k % 26)}" for k in range(30_000))
    docs = [(k, t, "en") for k, t in rows] + [(900, None, None), (901, "", "en"), (902, long, "en"), (903, "riso tane lusa", None), (903, "riso tane lusa", None), (None, "sone rita lulu", "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", *(f"{k} as {c}" for k, c in enumerate(("score", "row", "k", "component", "name", "n_chars", "_k", "u"))))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (df, df.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, str(tmp_path))
            if name != "packing":
                assert out.columns == df.columns, name
            got = out.collect()
            if table is not df:
                assert got == [], name
            elif name in ("near_dedup", "suffix_dedup", "packing"):
                ids = [r["doc_id"] for r in got]
                assert {900, 901, 902, 903, None} <= set(ids), name
                assert ids.count(903) == (1 if name == "near_dedup" else 2), name


def test_dedup_stages_against_brute_force(spark):
    """One of each group at five words and 0.8, then no passage of over 50 words that occurs twice, over a whole small table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    sets = {d: shingles(t, 5) for d, t in rows.items()}
    ids = sorted(rows)
    links = [(a, b) for a in range(len(ids)) for b in range(a) if sets[ids[a]] and 100 * len(sets[ids[a]] & sets[ids[b]]) >= 80 * len(sets[ids[a]] | sets[ids[b]])]
    want = {ids[k] for k in set(components(len(ids), links))}
    near = corpus_pipeline.near_stage(spark, docs, "").cache()
    assert {r["doc_id"] for r in near.collect()} == want
    split = {d: [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.split(r"[\x20\x09-\x0D]+", rows[d] or "") if w] for d in want}
    seen = Counter(tuple(w[i : i + 51]) for w in split.values() for i in range(len(w) - 50))
    for r in corpus_pipeline.suffix_stage(spark, near, "").collect():
        w = split[r["doc_id"]]
        cover = np.zeros(len(w), bool)
        for i in range(len(w) - 50):
            if seen[tuple(w[i : i + 51])] > 1:
                cover[i : i + 51] = True
        left = [x for x in re.split(r"[\x20\x09-\x0D]+", r["text"] or "") if x]
        assert [x.translate({c: c + 32 for c in range(65, 91)}) for x in left] == [x for x, c in zip(w, cover, strict=True) if not c]
