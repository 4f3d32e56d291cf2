"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

A term is a word's beginning (STEM bytes, whole characters), so that inflected forms share it, and the same again
where it comes twice or more in a text. The examples are a bounded sample of labelled rows (SAMPLE toxic
and twice as many others, a documented bound); every term of theirs is in the index, whatever its class or
frequency. A term weighs its inverse document frequency, counted over all documents, times the root of twice its
log-likelihood ratio between the classes: terms as common in both add nothing to a cosine, none is left out.

The terms of few examples are sparse postings and are added up exactly. For the others (COMMON), each block of
examples knows each term's largest weight, and its longest example's length over these terms. What these bounds let a
block still reach decides for each text whether the block is scored; texts are scored together, block by block. No
example that could be among the NEIGHBOURS is passed over: the result is exact. Of equal cosines the smaller id is nearer.

The neighbours' votes, weighted by cosine, and a prior of fixed weight give the raw score; a logistic curve
fitted to the examples' own leave-one-out scores, weighted back to the classes' true shares, calibrates it.
Neighbours and the text's heaviest terms are returned as evidence. Only the text goes into a score.

Defined cases: null text, empty text and text that shares no term with an example have no neighbour and get the
calibrated prior, as all texts do where there are fewer than NEIGHBOURS examples; without labelled rows of both
classes every score is 0; repeated rows are scored each; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import hash_sample, materialize, release, tune
from quillon.llm.langid import fold
from quillon.llm.words import mix, powers

SAMPLE = 2500
STEM = 5
NEIGHBOURS = 15
#: Terms of more than this share of the examples are common.
COMMON = 1 / 16
BLOCK = 64
#: Texts that are scored together.
TEXTS = 64
#: Single precision errs by less.
SLACK = 1e-5
PRIOR_WEIGHT = 0.5
THRESHOLD = 0.7
PIECE = 1 << 20


def term_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, first byte, past the last, buffer) of every word's beginning."""
    parts = [t.lower().encode() if t else b"" for t in texts]
    raw = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    letter = (raw >= 0x80) | ((raw >= 0x61) & (raw <= 0x7A))
    edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    edge = np.concatenate([[0], edge]) if letter[0] else edge
    begin, last = edge[::2], edge[1::2]
    end = np.minimum(last, begin + STEM)
    for _ in range(3):  # up to the end of a character
        end = end + ((end < last) & (raw[end] & 0xC0 == 0x80))
    up, down = powers(1 << int(len(raw)).bit_length())
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
        hashes = mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * np.uint64(131))
    owner = np.repeat(np.arange(len(parts)), np.diff(np.searchsorted(begin, np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])]))))
    return owner, hashes, begin, end, raw


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """Consecutive texts of about PIECE characters; a longer text stands alone."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size > PIECE:
            yield at, texts[at : k + 1]
            at, size = k + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def text_counts(texts: list[str | None], among: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """For each chunk of texts: (text, hash, number) of its terms, of those in the ascending array `among` if given; else with their names."""
    for at, part in chunks(texts):
        owner, h, b, e, raw = term_hashes(part)
        if among is not None:
            i = np.minimum(np.searchsorted(among, h), len(among) - 1)
            hit = among[i] == h
            owner, h = owner[hit], h[hit]
        order = np.lexsort((h, owner))
        o, k = owner[order], h[order]
        first = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (k[1:] != k[:-1])])) if len(o) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(o)))
        names = [] if among is not None else [raw[b[j] : e[j]].tobytes() for j in order[first].tolist()]
        yield o[first] + at, k[first], n, names


class Vocabulary:
    """Terms of the examples. A term is a hash, plain or in its second form: two or more occurrences in a text."""

    def __init__(self, hashes: np.ndarray, twice: np.ndarray, names: list[str] | pa.Array):
        self.twice, self.names = twice, pa.array(names)  # an array takes a fraction of a list's memory
        self.hashes = np.unique(hashes)
        self.plain, self.second = np.full(len(self.hashes), -1), np.full(len(self.hashes), -1)
        at = np.searchsorted(self.hashes, hashes)
        self.plain[at[~twice]] = np.flatnonzero(~twice)
        self.second[at[twice]] = np.flatnonzero(twice)

    def name(self, term: int) -> str:
        text = self.names[term].as_py()
        text = text.decode("utf-8", "replace") if isinstance(text, bytes) else text
        return f"{text} (2+)" if self.twice[term] else text

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, number of occurrences), in the order of texts."""
        out = [(np.zeros(0, np.int64),) * 3]
        for owner, h, n, _ in text_counts(texts, self.hashes) if len(self.hashes) else ():
            i = np.searchsorted(self.hashes, h)
            both = [(owner, self.plain[i], n), (owner[n > 1], self.second[i[n > 1]], n[n > 1])]
            o, t, n = (np.concatenate(x) for x in zip(*both, strict=True))
            o, t, n = o[t >= 0], t[t >= 0], n[t >= 0]
            order = np.argsort(o, kind="stable")
            out.append((o[order], t[order], n[order]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def all_terms(sample: DataFrame) -> tuple[Vocabulary, np.ndarray]:
    """The terms of rows (text, toxic), and of each the root of twice its log-likelihood ratio, by the number of texts of each class with it and without."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            toxic = np.asarray(batch["toxic"].to_pylist(), float)
            for owner, h, n, names in text_counts(batch["text"].to_pylist()):
                terms, one, back = np.unique(h, return_index=True, return_inverse=True)
                sums = [np.bincount(back, weights=w * (n >= least), minlength=len(terms)) for least in (1, 2) for w in (toxic[owner], 1 - toxic[owner])]
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array([names[i] for i in one.tolist()], pa.binary()), *(pa.array(x) for x in sums)], ["term", "name", "bad1", "good1", "bad2", "good2"])

    total = sample.agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).first()
    counted = sample.select("text", "toxic").mapInArrow(count, "term long, name binary, bad1 double, good1 double, bad2 double, good2 double")
    counted = counted.groupBy("term").agg(F.min("name").alias("name"), *[F.sum(c).cast("int").alias(c) for c in ("bad1", "good1", "bad2", "good2")])
    forms = F.array(*[F.struct(F.lit(twice).alias("twice"), F.col(b).alias("bad"), F.col(g).alias("good")) for twice, b, g in ((False, "bad1", "good1"), (True, "bad2", "good2"))])
    rows = counted.select("term", "name", F.explode(forms).alias("f")).select("term", "name", "f.*").where("bad + good > 0").toArrow()
    hashes, twice = (rows[c].to_numpy() for c in ("term", "twice"))
    order = np.lexsort((twice, hashes))
    bad, good = (rows[c].to_numpy()[order].astype(float) for c in ("bad", "good"))
    share = total["bad"] / (total["bad"] + total["good"])
    part = lambda x, e: x * np.log(np.maximum(x, 1e-9) / np.maximum(e, 1e-9))
    there, absent = bad + good, total["bad"] + total["good"] - bad - good
    llr = part(bad, there * share) + part(good, there * (1 - share)) + part(total["bad"] - bad, absent * share) + part(total["good"] - good, absent * (1 - share))
    names = rows["name"].combine_chunks().take(pa.array(order))
    return Vocabulary(hashes[order].view(np.uint64), twice[order], names), np.sqrt(2 * np.maximum(llr, 0))


class BlockMaxIndex:
    """Examples as unit vectors, sorted so that examples of like terms share blocks: postings of rare terms, rows and block maxima of common ones."""

    def __init__(self, vocabulary: Vocabulary, weights: np.ndarray, ids: list[int], toxic: np.ndarray, texts: list[str] | None = None, rows: list[tuple[np.ndarray, np.ndarray]] | None = None):
        """weights: of each term; rows: (terms, numbers of occurrences) of each example, counted in texts if not given."""
        self.vocabulary, self.weights = vocabulary, weights
        if rows is None:
            owner, term, n = vocabulary.counts(texts)
            at = np.searchsorted(owner, np.arange(len(texts) + 1))
            rows = [(term[a:b], n[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        norm = np.array([np.linalg.norm(self.weight(t, n)) for t, n in rows])
        some = np.flatnonzero(norm > 0)  # examples without any weight are no one's neighbours
        heaviest = [t[np.argmax(self.weight(t, n))] for t, n in (rows[k] for k in some)]
        some = some[np.argsort(heaviest, kind="stable")]
        self.ids, self.toxic = np.array(ids, np.int64)[some], toxic[some]
        df = np.zeros(len(weights), np.int64)
        for k in some:
            df[rows[k][0]] += 1
        common = np.flatnonzero(df > len(some) * COMMON)
        self.column = np.full(len(weights), -1, np.int32)
        self.column[common] = np.arange(len(common))
        self.dense = np.zeros((len(some), len(common)), np.float32)
        df[common] = 0
        self.at = np.concatenate([[0], np.cumsum(df)])
        self.example = np.zeros(self.at[-1], np.min_scalar_type(len(some)))
        self.value = np.zeros(self.at[-1], np.float32)
        free = self.at[:-1].copy()
        for x, k in enumerate(some):
            t, n = rows[k]
            w = self.weight(t, n) / norm[k]
            c = self.column[t]
            self.dense[x, c[c >= 0]] = w[c >= 0]
            t, w = t[c < 0], w[c < 0]
            self.example[free[t]], self.value[free[t]] = x, w
            free[t] += 1
        self.cuts = np.arange(0, len(some), BLOCK)
        if len(some):
            self.most = np.maximum.reduceat(self.dense, self.cuts, 0)
            self.longest = np.maximum.reduceat(np.linalg.norm(self.dense, axis=1), self.cuts)
        self.share = 0.0
        self.curve = (1.0, 0.0)

    @property
    def vectors(self) -> np.ndarray:
        """All examples' vectors, dense: for small indexes only."""
        out = np.zeros((len(self.ids), len(self.weights)))
        out[:, self.column >= 0] = self.dense
        out[self.example, np.repeat(np.arange(len(self.weights)), np.diff(self.at))] = self.value
        return out

    def weight(self, term: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (1 + np.log(n)) * self.weights[term]

    def nearest(self, owner: np.ndarray, term: np.ndarray, w: np.ndarray, texts: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The k nearest examples of unit vectors and their cosines, exactly; the vectors are (text, term, weight) in the order of texts."""
        n, width = self.dense.shape
        column = self.column[term]
        rare, full = np.zeros((texts, n)), np.zeros((texts, width), np.float32)
        full[owner[column >= 0], column[column >= 0]] = w[column >= 0]
        at = np.searchsorted(owner, np.arange(texts + 1))
        for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
            own = column[a:b] < 0
            t, value = term[a:b][own], w[a:b][own]
            first, size = self.at[t], self.at[t + 1] - self.at[t]
            posting = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
            rare[i] = np.bincount(self.example[posting], weights=self.value[posting] * np.repeat(value, size), minlength=n)
        reach = np.minimum(full @ self.most.T, np.linalg.norm(full, axis=1)[:, None] * self.longest) + np.maximum.reduceat(rare, self.cuts, 1)
        score, open_blocks, least = np.full((texts, n), -1.0, np.float32), np.ones(reach.shape, bool), np.full(texts, -1.0)

        def scan(j: int, rows: np.ndarray) -> np.ndarray:
            cut = slice(self.cuts[j], min(self.cuts[j] + BLOCK, n))
            found = full[rows] @ self.dense[cut].T + rare[rows, cut]
            score[rows, cut], open_blocks[rows, j] = found, False
            return found

        best = reach.argmax(1)
        for j in np.unique(best).tolist():  # each text's best block first: what it finds is the least to reach
            rows = np.flatnonzero(best == j)
            found = scan(j, rows)
            if found.shape[1] >= k:
                least[rows] = np.partition(found, -k, axis=1)[:, -k]
        for j in range(len(self.cuts)):
            if len(rows := np.flatnonzero(open_blocks[:, j] & (reach[:, j] >= least - SLACK))):
                scan(j, rows)
        kth = np.partition(score, -k, axis=1)[:, -k] if n > k else np.full(texts, -1.0)
        out = []
        for i in range(texts):
            near = np.flatnonzero(score[i] >= max(kth[i] - SLACK, 0))
            cosine = rare[i, near] + (self.dense[near].astype(float) * full[i]).sum(1)
            top = np.lexsort((self.ids[near], -cosine))[:k]
            top = top[cosine[top] > 0]
            out.append((near[top], cosine[top]))
        return out

    def raw(self, near: np.ndarray, cosine: np.ndarray) -> float:
        return float((cosine @ self.toxic[near] + PRIOR_WEIGHT * self.share) / (cosine.sum() + PRIOR_WEIGHT))

    def calibrated(self, raw: float) -> float:
        a, b = self.curve
        return float(1 / (1 + np.exp(-(a * raw + b))))

    def neighbours(self, texts: list[str | None], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(neighbours, cosines, terms from the heaviest on) of each text."""
        owner, term, n = self.vocabulary.counts(texts)
        w = self.weight(term, n)
        norm = np.sqrt(np.bincount(owner, weights=w * w, minlength=len(texts)))
        w = w / np.maximum(norm, 1e-300)[owner]
        at = np.searchsorted(owner, np.arange(len(texts) + 1))
        for k0 in range(0, len(texts), TEXTS):
            k1 = min(k0 + TEXTS, len(texts))
            own = slice(at[k0], at[k1])
            found = self.nearest(owner[own] - k0, term[own], w[own], k1 - k0, k) if len(self.ids) else [(np.zeros(0, np.int64),) * 2] * (k1 - k0)
            for i, (near, cosine) in zip(range(k0, k1), found, strict=True):
                yield near, cosine, term[at[i] : at[i + 1]][np.argsort(-w[at[i] : at[i + 1]], kind="stable")]

    def texts(self, texts: list[str | None]) -> Iterator[tuple[float, np.ndarray, np.ndarray, np.ndarray]]:
        """(score, neighbours, cosines, terms) of each text."""
        for near, cosine, terms in self.neighbours(texts, NEIGHBOURS):
            yield self.calibrated(self.raw(near, cosine)), near, cosine, terms

    def left_out(self, texts: list[str | None]) -> list[float]:
        """The raw score of each example without itself and its copies."""
        out = []
        for near, cosine, _ in self.neighbours(texts, NEIGHBOURS + 1):
            other = cosine < 1 - 1e-6
            out.append(self.raw(near[other][:NEIGHBOURS], cosine[other][:NEIGHBOURS]))
        return out

    def calibrate(self, x: np.ndarray, toxic: np.ndarray) -> None:
        """Fits the logistic curve to the examples' scores without themselves."""
        true, share = toxic.mean(), self.share
        weight = np.where(toxic == 1, share / true, (1 - share) / (1 - true))
        a, b = 4.0, -2.0
        for _ in range(50):  # Newton steps with a little weight decay
            p = 1 / (1 + np.exp(-(a * x + b)))
            g, h = weight * (p - toxic), weight * np.maximum(p * (1 - p), 1e-9)
            grad = np.array([(g * x).sum() + 0.5 * (a - 8), g.sum() + 0.5 * (b + 4)])
            hess = np.array([[(h * x * x).sum() + 0.5, (h * x).sum()], [(h * x).sum(), h.sum() + 0.5]])
            da, db = np.linalg.solve(hess, grad)
            a, b = a - np.clip(da, -4, 4), b - np.clip(db, -4, 4)
        self.curve = (float(a), float(b))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> BlockMaxIndex | None:
    """The index of at most `sample` toxic and twice as many other labelled rows outside fold 1, with frequencies counted over all docs."""
    spark = docs.sparkSession
    tune(spark)
    known = labels.where(F.col("toxic").isin(0, 1) & F.coalesce(fold(F.col("doc_id")) != 1, F.lit(False))).select("doc_id", "toxic")
    share = known.agg(F.avg("toxic")).first()[0]
    if not share or share == 1:
        return None
    picked = hash_sample(known.where("toxic = 1"), sample, "doc_id").unionByName(hash_sample(known.where("toxic = 0"), 2 * sample, "doc_id"))
    sampled = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # 3 * sample ids at most
    sampled = materialize(sampled, "toxicity-sample")
    if sampled.select("toxic").distinct().count() < 2:
        return None
    vocabulary, contrast = all_terms(sampled)
    shared = spark.sparkContext.broadcast(vocabulary)  # terms of 3 * sample rows at most
    total, df = frequencies(docs, shared)
    ids, toxic, rows = example_counts(sampled, shared)
    shared.unpersist()
    if len(rows) < NEIGHBOURS:
        rows = [(t[:0], n[:0]) for t, n in rows]
    index = BlockMaxIndex(vocabulary, np.log((total + 1) / (df + 1)) * contrast, ids, toxic, rows=rows)
    index.share = share
    del rows
    index.calibrate(*example_scores(sampled, index))
    return index


def example_counts(sampled: DataFrame, shared: Broadcast) -> tuple[list[int], np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(id, toxic, (terms, numbers of occurrences)) of the sampled rows, counted in tasks; no text comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        deflate = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            owner, term, n = shared.value.counts(batch["text"].to_pylist())
            at = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            packed = [pa.array([deflate(x[a:b].astype(np.int32).tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()) for x in (term, n)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["toxic"], *packed], ["doc_id", "toxic", "terms", "n"])

    found = sampled.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"), "text").mapInArrow(count, "doc_id long, toxic int, terms binary, n binary").toArrow()
    found = found.sort_by([(c, "ascending") for c in ("doc_id", "toxic", "terms", "n")])
    inflate = zstandard.ZstdDecompressor().decompress
    rows = [tuple(np.frombuffer(inflate(x.as_py()), np.int32) for x in pair) for pair in zip(found["terms"], found["n"], strict=True)]
    return found["doc_id"].to_pylist(), found["toxic"].to_numpy().astype(float), rows


def example_scores(sampled: DataFrame, index: BlockMaxIndex) -> tuple[np.ndarray, np.ndarray]:
    """(raw score without itself, toxic) of each sampled row, in ascending order."""
    shared = sampled.sparkSession.sparkContext.broadcast(index)  # terms of 3 * sample rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(shared.value.left_out(batch["text"].to_pylist()), pa.float64())], ["toxic", "raw"])

    found = sampled.select(F.col("toxic").cast("int"), "text").mapInArrow(run, "toxic int, raw double").toArrow()
    shared.unpersist()
    x, toxic = found["raw"].to_numpy(), found["toxic"].to_numpy().astype(float)
    order = np.lexsort((toxic, x))
    return x[order], toxic[order]


def frequencies(docs: DataFrame, shared: Broadcast) -> tuple[int, np.ndarray]:
    """The number of all documents, and in how many of them each term occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        voc = shared.value
        total, df = 0, np.zeros(len(voc.names), np.int64)
        for batch in batches:
            total += batch.num_rows
            _, term, _ = voc.counts(batch["text"].to_pylist())
            df += np.bincount(term, minlength=len(df))
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, hit), pa.int32()), pa.array(np.append(total, df[hit]))], ["term", "n"])

    rows = docs.select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = rows["term"].to_numpy(), rows["n"].to_numpy()
    df = np.zeros(len(shared.value.names))
    df[term[term >= 0]] = n[term >= 0]
    return int(n[term < 0].sum()), df


def score(docs: DataFrame, index: BlockMaxIndex | None, evidence: bool = True) -> DataFrame:
    """Adds score, and as evidence the nearest example, its cosine and the text's terms, to all columns of docs."""
    spark = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(index)  # terms of 3 * SAMPLE rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        known = shared.value
        for batch in batches:
            scores, near, cosine, terms = [], [], [], []
            texts = batch["text"].to_pylist()
            for s, n, c, t in known.texts(texts) if known else ((0.0, (), (), np.zeros(0, np.int64)) for _ in texts):
                scores.append(s)
                near.append(int(known.ids[n[0]]) if len(n) else None)
                cosine.append(float(c[0]) if len(c) else None)
                terms.append([known.vocabulary.name(i) for i in t[:8].tolist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(near, pa.int64()), pa.array(cosine, pa.float64()), pa.array(terms, pa.list_(pa.string()))], [*batch.schema.names, "score", "nearest", "nearest_cosine", "terms"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, score double, nearest long, nearest_cosine double, terms array<string>")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, and evidence) of every text."""
    rows = score(docs.select("doc_id", "text"), fit(docs, labels))
    return rows.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "nearest", "nearest_cosine", "terms")


def keep_clean(docs: DataFrame, index: BlockMaxIndex | None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, columns as they are, with a score below the threshold."""
    names = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text"))
    return score(inner, index).where(F.col("score") < threshold).select(*[F.col("row").getField(c).alias(c) for c in names])
