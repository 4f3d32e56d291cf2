"""WARC, sharding, language and toxicity: round trips, laws, held-out accuracy, exactness."""

import gzip
import io
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import langid, sharding, toxicity, warc


def test_archives(spark):
    rows = [(5, "http://a", "<p>é</p>"), (3, "http://b\nc", "<p>é</p>"), (9, None, None), (7, "u", ""), (None, "n", "lone"), (3, "again", "<p>é</p>"), (11, "big", "x\r\n\r\n" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as record_type")
    out = warc.archive_round_trip(pages).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["page_id"], []).append(r)
    payload = "<p>é</p>".encode()
    assert sorted(r["record_type"] for r in by[3]) == ["response", "revisit"]
    five = by[5][0]
    assert (five["record_type"], five["refers_to"], five["payload_bytes"], five["payload_digest"]) == ("revisit", 3, len(payload), warc.digest_of(payload))
    assert by[7][0]["record_type"] == "response" and by[9][0]["refers_to"] == 7 and by[9][0]["payload_bytes"] == 0
    assert by[11][0]["payload_bytes"] == 25000 and by[None][0]["record_type"] == "response"
    assert {r["record_type"] for r in warc.archive_round_trip(pages, 1 << 20).collect()} == {"response"}
    assert warc.archive_round_trip(pages.where("false")).count() == 0


def test_predicates_and_other_writers(spark, tmp_path):
    block = b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: %s\r\nWARC-Target-URI: u\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(block % (b"warcinfo", b"<i>")) + gzip.compress(block % (b"metadata", b"<m>")))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(warc.WarcDataSource)
    df = spark.read.format("warc").load(str(tmp_path)).where("record_type = 'metadata'")
    assert [(r["record_id"], r["headers"]["WARC-Target-URI"], r["payload"]) for r in df.collect()] == [("<m>", "u", None)]
    reader = warc.WarcReader(str(tmp_path), ["record_id"], 1 << 20)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "x"), GreaterThan(("payload_bytes",), 3)]))
    assert len(left) == 1 and reader.tests == [("WARC-Type", frozenset(["x"]))]


def test_files_of_lost_attempts_are_not_read(spark, tmp_path):
    spark.dataSource.register(warc.WarcDataSource)
    pages = spark.createDataFrame([(k, "u", f"page {k}") for k in range(5)], "page_id long, url string, html string")
    warc.write_pages(pages, str(tmp_path))
    whole = next(tmp_path.glob("[!.]*.warc.gz")).read_bytes()
    (tmp_path / ".0a.warc.gz").write_bytes(whole)
    (tmp_path / ".0b.warc.gz").write_bytes(whole[:-9])
    assert sorted(r["page_id"] for r in warc.page_records(spark, str(tmp_path)).collect()) == [0, 1, 2, 3, 4]


def test_responses_do_not_depend_on_the_order_of_rows(spark):
    rows = [(None, "u", "a"), (4, "u", "a"), (4, "u", "a"), (4, None, "a"), (9, "v", "a"), (None, "w", "b"), (None, "w", "b"), (None, "x", "b"), (1, None, None), (2, None, "")]
    rng, seen = np.random.default_rng(3), set()
    for _ in range(3):
        pages = spark.createDataFrame([rows[k] for k in rng.permutation(len(rows))], "page_id long, url string, html string").repartition(3, "url")
        out = warc.archive_round_trip(pages).collect()
        seen.add(tuple(sorted(map(repr, ((r["page_id"], r["record_type"], r["refers_to"]) for r in out)))))
        assert sum(r["record_type"] == "response" for r in out) == 3 and len(out) == len(rows)
        assert [r["refers_to"] for r in out if r["page_id"] == 9] == [4] and [r["refers_to"] for r in out if r["page_id"] == 2] == [1]
    assert len(seen) == 1


@pytest.mark.parametrize("piece", [1, 7, 1 << 18])
def test_archives_are_read_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(warc, "PIECE", piece)
    rng = np.random.default_rng(1)
    bodies = [rng.integers(0, 256, int(n)).astype(np.uint8).tobytes() for n in (0, 1, 300, 9000, 40)]
    blocks = [warc.record({"WARC-Type": "response", "WARC-Record-ID": f"<{k}>"}, len(b), b) for k, b in enumerate(bodies)]
    for wrap in (lambda x: warc.member(x, 1), gzip.compress):  # with the member's length, and without
        data = b"".join(map(wrap, blocks))
        got = list(warc.read_records(io.BytesIO(data), [], True))
        assert [g[2] for g in got] == bodies and [g[1] for g in got] == [len(b) for b in bodies]
        some = list(warc.read_records(io.BytesIO(data), [("WARC-Record-ID", frozenset(["<3>"]))], True))
        assert [g[2] for g in some] == [bodies[3]]
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(data[:-9]), [], True))


def test_a_commit_removes_what_lost_attempts_left(tmp_path):
    writer = warc.WarcWriter(str(tmp_path), 1, 1 << 20)
    row = {"record_id": "r", "record_type": "response", "target_uri": "u", "payload_digest": None, "refers_to": None, "payload_bytes": 1, "payload": b"x"}
    done, lost = (writer.write(iter([pa.RecordBatch.from_pylist([row])])) for _ in range(2))
    (tmp_path / ".other-job.warc.gz").write_bytes(b"")
    writer.commit([done])
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted([".other-job.warc.gz", *done.names])


def test_a_failing_task_removes_its_files(tmp_path):
    row = {"record_id": "r", "record_type": "response", "target_uri": "u", "payload_digest": None, "refers_to": None, "payload_bytes": 1, "payload": b"x"}

    def batches():
        yield pa.RecordBatch.from_pylist([row] * 3)
        raise RuntimeError("stopped")

    for roll in (1, 1 << 20):
        with pytest.raises(RuntimeError):
            warc.WarcWriter(str(tmp_path), 1, roll).write(batches())
    assert not list(tmp_path.iterdir())


def test_damaged_payload_is_found():
    record = warc.member(warc.record({"WARC-Type": "response", "WARC-Payload-Digest": "sha1:AAAA"}, 3, b"abc"), 1)
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(record), [], True))
    assert len(list(warc.read_records(io.BytesIO(record), [], False))) == 1


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 1)])
def test_hilbert_curve(spark, dims, bits):
    names = [f"d{i}" for i in range(dims)]
    cells = spark.range(2 ** (dims * bits)).select(*[((F.col("id") / 2 ** (bits * i)).cast("long") % 2**bits).cast("int").alias(n) for i, n in enumerate(names)])
    walk = cells.select("*", sharding.hilbert_index([F.col(n) for n in names], bits).alias("h")).orderBy("h").collect()
    assert [r["h"] for r in walk] == list(range(len(walk)))
    assert all(sum(abs(a[n] - b[n]) for n in names) == 1 for a, b in zip(walk, walk[1:], strict=False))


def test_readers_can_skip_shards(spark):
    """Every single predicate on language, source or size finds its rows in a part of the shards only."""
    rng = np.random.default_rng(5)
    rows = [(k, f"{k:05d}" + "x" * int(2 ** rng.uniform(2, 12)), str(rng.choice(["de", "en", "es", "fr"])), f"src{rng.integers(8)}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = sharding.shards(docs, 40).join(docs.select("doc_id", "lang", "source"), "doc_id").toPandas()
    hit = lambda rows: rows["shard"].nunique()
    assert max(hit(r) for _, r in out.groupby("lang")) <= 20
    assert max(hit(r) for _, r in out.groupby("source")) <= 24
    assert max(hit(r) for _, r in out.groupby(np.log2(out["size"]).astype(int))) <= 32
    assert max(hit(r) for _, r in out.groupby(["lang", "source"])) <= 8


def test_equal_texts_stand_together_and_shards_are_written_whole(spark, tmp_path):
    rows = [(None, "same", "en", "a"), (7, "same", None, "b"), (7, "same", "de", "c"), (7, "same", "de", "c"), (1, None, "en", "z"), (2, "", "fr", "y"), *((100 + k, f"text {k}", "en", f"s{k % 3}") for k in range(60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as u", "2 as m", "3 as row")
    out = sharding.shards(docs, 6).orderBy("shard", "slot").toPandas()
    assert len(out) == len(rows) and out.groupby("shard").size().tolist() == [11] * 6
    for crc, n in ((zlib.crc32(b"same"), 4), (0, 2)):
        at = np.flatnonzero(out["text_crc32"] == crc)
        assert len(at) == n and at[-1] - at[0] == n - 1
    sharding.write_shards(docs, 6, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert set(back.columns) == {*docs.columns, "shard", "slot"}
    got = [tuple(r) for r in back.select("doc_id", "text", "lang", "source").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, rows)) and back.groupBy("shard").agg(F.max("slot")).count() == 6


def test_shards(spark):
    rows = [(k, None if k % 9 == 0 else "text %d" % (k % 40), "en" if k % 3 else None) for k in range(333)] + [(5, "text 5", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as rank", "2 as shard")
    out = sharding.shards(docs, 40).toPandas()
    assert len(out) == len(rows) and set(out["shard"]) == set(range(40))
    sizes = out.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1
    for _, s in out.groupby("shard"):
        assert sorted(s["slot"]) == list(range(len(s)))
    one = out[out.doc_id == 1].iloc[0]
    assert one["size"] == len(b"text 1") + 16 and one["text_crc32"] == zlib.crc32(b"text 1") and one["law"] == "rows"
    assert (out[out.doc_id == 9]["size"] == 16).all()
    assert sharding.shards(docs.where("false"), 40).count() == 0
    few = sharding.shards(docs.limit(3), 40).toPandas()
    assert few["shard"].is_unique and (few["slot"] == 0).all()


def language_rows(n, seed=0):
    rng = np.random.default_rng(seed)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ver", "ung", "lich"], "cc": ["ção", "nh", "éu", "ra"]}
    return [(k, " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(int(rng.integers(5, 200)))), lang) for k in range(n) for lang in [list(parts)[k % 3]]]


def test_languages(spark):
    rows = language_rows(300) + [(900, None, "aa"), (901, "", "bb"), (902, "123 !? 456", "cc"), (903, "kalomi tulomi kamitu", None), (904, "A" * 200_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "'x' as lang_pred")
    out = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    held = [k for k, r in out.items() if r["held_out"] and k < 900]
    assert len(held) > 50 and np.mean([out[k]["lang_pred"] == rows[k][2] for k in held]) > 0.95
    assert all(out[k]["lang_pred"] == "und" for k in (900, 901, 902)) and out[903]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in out.values())
    kept = langid.keep_known(docs, langid.fit(docs), 0.0)
    assert kept.columns == docs.columns and kept.where("doc_id in (900, 901, 902)").isEmpty()
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(unlabelled).collect()} == {"und"}
    assert langid.identify(docs.where("false")).count() == 0


def test_pair_tables_agree_with_the_filters():
    net = langid.ByteCnn(["a", "b"])
    x, _ = langid.windows_of([langid.normal_bytes("Some text, çà et là; " * 40)])
    net.ready()
    assert np.allclose(net.features(x), net.pooled(x)[0], atol=1e-4)


def test_the_network_against_plain_loops():
    """Convolution, pooling and softmax by loops over places and bytes, for the trained form's look-ups and for the training form."""
    rng = np.random.default_rng(4)
    net = langid.ByteCnn(["a", "b", "c"])
    x, _ = langid.windows_of([langid.normal_bytes("one éü two three " * k) for k in (1, 9, 40)] + [langid.normal_bytes("")])
    for b in net.bias:
        b[:] = rng.normal(0, 0.2, b.shape)
    want = []
    for row in x:
        best = []
        for w, table, bias in zip(langid.WIDTHS, net.tables, net.bias, strict=True):
            best += [max(0.0, max(sum(float(table[k, row[at + k], f]) for k in range(w)) for at in range(len(row) - w + 1)) + float(bias[f])) for f in range(langid.FILTERS)]
        z = np.array(best) @ net.out.astype(float) + net.out_bias
        want.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
    assert np.allclose(net.predict(x), want, atol=1e-5) and np.allclose(net.softmax(net.pooled(x)[0]), want, atol=1e-5)


def test_gradients_against_differences():
    net = langid.ByteCnn(["a", "b", "c"])
    params = [*net.tables, *net.bias, net.out, net.out_bias]
    net.tables, net.bias = [t.astype(float) for t in net.tables], [b.astype(float) for b in net.bias]
    net.out, net.out_bias = net.out.astype(float), net.out_bias.astype(float)
    params = [*net.tables, *net.bias, net.out, net.out_bias]
    x, _ = langid.windows_of([langid.normal_bytes(t * 30) for t in ("abc de ", "fgh ij ", "klm no ")])
    y = np.arange(len(x)) % 3
    _, grads = net.gradients(x, y)
    rng = np.random.default_rng(2)
    for p, g in zip(params, grads, strict=True):
        # where a gradient is, and anywhere
        places = [tuple(i) for i in np.argwhere(np.abs(g) > 1e-6)[:3]] + [tuple(int(rng.integers(n)) for n in p.shape) for _ in range(3)]
        for at in places:
            kept, losses = p[at], []
            for move in (1e-6, -1e-6):
                p[at] = kept + move
                losses.append(net.gradients(x, y)[0])
            p[at] = kept
            assert abs((losses[0] - losses[1]) / 2e-6 - g[at]) < 1e-4


def toxic_rows(n=400, seed=1):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(["ta", "ri", "so", "ne", "lu"], 3))
    docs, labels = [], []
    for k in range(n):
        bad = k % 4 == 0
        words = [word() for _ in range(40)]
        if bad:
            words[3], words[9] = rng.choice(["vilefoo", "vilebar", "nastyzed"], 2)
        docs.append((k, " ".join(words)))
        labels.append((k, 1, int(bad)))
    return docs, labels


def test_toxicity(spark):
    rows, labels = toxic_rows()
    extra = [(900, None), (901, ""), (902, "vilefoo " * 30_000)]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string").selectExpr("*", "1 as score", "2 as terms")
    marks = spark.createDataFrame(labels + [(5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in toxicity.scored(docs, marks).collect()}
    assert len(out) == len(rows) + 3
    held = [k for k, r in out.items() if r["held_out"] and k < 900]
    assert all(out[k]["predicted"] == (k % 4 == 0) for k in held) and len(held) > 80
    assert out[900]["score"] == out[901]["score"] < 0.3 and out[902]["predicted"] == 1
    some = next(k for k in held if k % 4 == 0)
    assert out[some]["nearest"] is not None and out[some]["terms"]
    kept = toxicity.keep_clean(docs, toxicity.fit(docs, marks))
    assert kept.columns == docs.columns and not any(r["doc_id"] % 4 == 0 for r in kept.where("doc_id < 900").collect())
    assert {r["score"] for r in toxicity.scored(docs, marks.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.scored(docs.where("false"), marks).count() == 0
    few = toxicity.scored(docs, marks.where("doc_id in (0, 1, 2, 3, 4, 5, 6, 7, 8)")).collect()  # too few for any term
    assert len(few) == len(rows) + 3 and len({r["score"] for r in few}) == 1


def test_block_max_search_is_exact():
    rng = np.random.default_rng(8)
    names = [f"{i:05d}".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(60)]
    texts = [" ".join(rng.choice(names, int(rng.integers(1, 12)), p=(w := 1.0 / np.arange(1, 61)) / w.sum())) for _ in range(500)]
    owner, h, *_ = toxicity.term_hashes([" ".join(names)])
    voc = toxicity.Vocabulary(h, np.zeros(len(names), bool), names)
    index = toxicity.BlockMaxIndex(voc, rng.uniform(0.5, 3, len(names)), list(range(500)), np.zeros(500), texts)
    assert 0 < index.dense.shape[1] < len(names)
    w = rng.uniform(0.1, 1, (40, 5))
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    terms = np.stack([np.sort(rng.choice(len(names), 5, replace=False)) for _ in range(40)])
    found = index.nearest(np.repeat(np.arange(40), 5), terms.ravel(), w.ravel(), 40, 15)
    for t, v, (near, cosine) in zip(terms, w, found, strict=True):
        every = index.vectors[:, t] @ v
        assert np.allclose(cosine, np.sort(every)[::-1][: len(cosine)], atol=1e-6) and np.allclose(every[near], cosine, atol=1e-6)


def test_neighbours_equal_an_independent_tf_idf(spark):
    """Every word's first five letters, counted by the standard library alone; all examples are compared with all texts."""
    rows, labels = toxic_rows(160)
    known = {d: x for d, _, x in labels if zlib.crc32(str(d).encode()) % 3 != 1}

    def terms(text):
        n = Counter(w[:5] for w in re.findall("[a-z]+", text.lower()))
        return dict(n) | {(t, 2): k for t, k in n.items() if k > 1}

    counts = {d: terms(t) for d, t in rows}
    df = Counter(t for c in counts.values() for t in c)
    bad, good = (Counter(t for d, x in known.items() if x == c for t in counts[d]) for c in (1, 0))
    n_bad, n = sum(known.values()), len(known)

    def contrast(t):
        table = [(bad[t], n_bad), (good[t], n - n_bad), (n_bad - bad[t], n_bad), (n - n_bad - good[t], n - n_bad)]
        there = bad[t] + good[t]
        return math.sqrt(max(0, 2 * sum(x * math.log(x * n / (size * (there if k < 2 else n - there))) for k, (x, size) in enumerate(table) if x)))

    weight = {t: math.log((len(rows) + 1) / (df[t] + 1)) * contrast(t) for t in set(bad) | set(good)}
    vector = lambda c: {t: (1 + math.log(k)) * weight[t] for t, k in c.items() if t in weight}
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    examples = {d: vector(counts[d]) for d in known}
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, marks)).collect()
    for r in out:
        v = vector(counts[r["doc_id"]])
        cosine = {d: sum(x * e.get(t, 0) for t, x in v.items()) / (length(v) * length(e)) for d, e in examples.items() if length(e)}
        best = max(cosine.values())
        assert abs(r["nearest_cosine"] - best) < 1e-5 and cosine[r["nearest"]] > best - 1e-5
    assert len(out) == len(rows)


def test_all_terms_of_the_examples_vote(spark):
    rows, labels = toxic_rows(90)  # too few for any term to stand out
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    index = toxicity.fit(docs, marks)
    used = [t for k, t in rows if zlib.crc32(str(k).encode()) % 3 != 1]
    assert len(index.ids) == len(used) and 0 in index.toxic
    assert {w[: toxicity.STEM] for t in used for w in t.split()} <= {index.vocabulary.name(i) for i in range(len(index.weights))}
    out = toxicity.scored(docs, marks).collect()
    assert len({r["score"] for r in out}) > 1 and any(r["predicted"] for r in out if r["held_out"])


def test_examples_come_as_counts(spark):
    assert toxicity.SAMPLE == 2500
    docs, labels = (spark.createDataFrame(x, s) for x, s in zip(toxic_rows(60), ("doc_id long, text string", "doc_id long, quality int, toxic int"), strict=True))
    sampled = docs.join(labels.select("doc_id", "toxic"), "doc_id")
    vocabulary, contrast = toxicity.all_terms(sampled)
    ids, toxic, rows = toxicity.example_counts(sampled, spark.sparkContext.broadcast(vocabulary))
    assert ids == list(range(60)) and toxic.sum() == 15 and len(contrast) == len(vocabulary.names)
    owner, term, n = vocabulary.counts([r["text"] for r in docs.orderBy("doc_id").collect()])
    assert all((t == term[owner == k]).all() and (c == n[owner == k]).all() for k, (t, c) in enumerate(rows))


def test_search_of_rare_and_common_terms_is_exact():
    rng = np.random.default_rng(3)
    names = ["".join("abcdefghij"[int(d)] for d in str(i)) for i in range(100, 500)]
    chance = 1 / np.arange(1, 401)
    texts = [" ".join(rng.choice(names, int(rng.integers(5, 60)), p=chance / chance.sum())) for _ in range(900)]
    _, h, *_ = toxicity.term_hashes([" ".join(names)])
    h, at = np.unique(h, return_index=True)
    voc = toxicity.Vocabulary(h, np.zeros(len(h), bool), ["t"] * len(h))
    index = toxicity.BlockMaxIndex(voc, rng.uniform(0.1, 5, len(h)), list(range(900)), np.zeros(900), texts)
    assert 0 < (index.column >= 0).sum() < len(h)
    every = index.vectors
    assert np.allclose(np.linalg.norm(every, axis=1), 1, atol=1e-5)
    owner, term, n = voc.counts(texts[:50])
    for k, (near, cosine, _) in enumerate(index.neighbours(texts[:50], 15)):
        t = term[owner == k]
        w = index.weight(t, n[owner == k])
        w /= np.linalg.norm(w)
        assert np.allclose(cosine, np.sort(every[:, t] @ w)[::-1][:15], atol=1e-5) and np.allclose(every[near][:, t] @ w, cosine, atol=1e-5)


def test_levels_of_rejection_come_from_all_held_out_texts(spark, monkeypatch):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("aa").alias("lang"), (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003).cast("string").alias("text"))
    monkeypatch.setattr(langid, "predict", lambda df, model: df.withColumns({"score": F.col("text").cast("double"), "lang_pred": F.col("lang")}))
    scores = sorted(float(r["text"]) for r in docs.where(langid.fold(F.col("doc_id")) == 1).collect())
    least = langid.least_scores(docs, object())["aa"]
    below = lambda level: sum(s < level for s in scores) / len(scores)
    assert len(scores) > 2 * langid.SAMPLE and below(least) <= langid.DOUBTFUL < below(least + 1 / langid.LEVELS)
