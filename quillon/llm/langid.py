"""Language identification with a byte convolutional network: filters of several widths, max pooling, softmax.

The network is trained here in numpy, on PIECES pieces of each of at most SAMPLE labelled texts (documented bounds), which
a hash draws from the whole text, and
applied to every window of every text, in batches of fixed-length windows. A text's scores are the means of
its windows' probabilities. Only the text goes into a prediction.

Letters are lower-cased, and runs of other ASCII bytes become one blank, before windows are cut.

Defined cases: texts that are null or have no letter are `und` with score 1.0; without any labelled row
all texts are `und` with score 0.0; rows without a language are not learned from; repeated rows are predicted
each; columns other than doc_id, text and, to learn from, lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import hash_sample, release, tune

SAMPLE = 4000
#: Pieces drawn from each sampled text, from anywhere in it, and their characters. A text of no more than all of them is taken whole.
PIECES = 3
PIECE = 200
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EPOCHS = 8
BATCH = 64
UNKNOWN = "und"
#: Share of correctly classified held-out texts that may score below the level of rejection.
DOUBTFUL = 0.01
#: Levels of rejection between 0 and 1.
LEVELS = 10_000
BLANK = 0x20


def normal_bytes(text: str) -> np.ndarray:
    """Lower-case UTF-8 bytes; runs of ASCII bytes that aren't letters are one blank."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    keep = (raw >= 0x80) | ((raw >= 0x61) & (raw <= 0x7A))
    out = np.where(keep, raw, np.uint8(BLANK))
    if len(out):
        out = out[keep | np.concatenate([[True], keep[:-1]])]
    return out


def windows_of(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all rows, padded with blanks, and the row of each."""
    n = np.array([max(1, -(-len(r) // WINDOW)) for r in rows])
    out = np.full(n.sum() * WINDOW, BLANK, np.uint8)
    at = np.concatenate([[0], np.cumsum(n)]) * WINDOW
    for r, a in zip(rows, at, strict=False):
        out[a : a + len(r)] = r
    return out.reshape(-1, WINDOW), np.repeat(np.arange(len(rows)), n)


class ByteCnn:
    """Filters are tables [offset, byte, filter] for each width: a one-hot convolution is a sum of table rows."""

    def __init__(self, labels: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)
        self.pairs: list | None = None

    def pooled(self, x: np.ndarray, places: bool = False):
        """Largest response of each filter in each window, and where it is."""
        best, where = [], []
        for w, table, bias in zip(WIDTHS, self.tables, self.bias, strict=True):
            m = WINDOW - w + 1
            y = table[0][x[:, :m]]
            for k in range(1, w):
                y += table[k][x[:, k : k + m]]
            if places:
                at = y.argmax(1)
                where.append(at)
                best.append(np.take_along_axis(y, at[:, None], 1)[:, 0] + bias)
            else:
                best.append(y.max(1) + bias)
        return np.maximum(np.concatenate(best, 1), 0), where

    def ready(self) -> None:
        """Tables of byte pairs, so that a filter of width 4 takes two look-ups. Bytes are renumbered to those that occur in UTF-8 letters."""
        used = [BLANK, *range(0x61, 0x7B), *range(0x80, 0xF5)]
        self.code = np.zeros(256, np.uint16)
        self.code[used] = np.arange(len(used))
        n = len(used)
        self.n = n
        self.pairs = []
        for w, t in zip(WIDTHS, self.tables, strict=True):
            u = t[:, used]
            part = [(u[k][:, None] + u[k + 1][None]).reshape(n * n, FILTERS) for k in range(0, w - 1, 2)]
            self.pairs.append((part, u[w - 1] if w % 2 else None))

    def features(self, x: np.ndarray) -> np.ndarray:
        codes = self.code[x].astype(np.int32)
        two = codes[:, :-1] * self.n + codes[:, 1:]
        best = []
        for w, (parts, last), bias in zip(WIDTHS, self.pairs, self.bias, strict=True):
            m = WINDOW - w + 1
            y = parts[0].take(two[:, :m], 0)
            for k, part in enumerate(parts[1:], 1):
                y += part.take(two[:, 2 * k : 2 * k + m], 0)
            if last is not None:
                y += last.take(codes[:, w - 1 :], 0)
            best.append(y.max(1) + bias)
        return np.maximum(np.concatenate(best, 1), 0)

    def softmax(self, features: np.ndarray) -> np.ndarray:
        z = features @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.pairs is None:
            self.ready()
        return np.concatenate([np.zeros((0, len(self.labels)), np.float32), *(self.softmax(self.features(x[k : k + 128])) for k in range(0, len(x), 128))])

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The mean cross entropy of windows x of classes y, and its gradient by tables, biases, output weights and output bias; through max pooling only the winning places get one."""
        h, where = self.pooled(x, places=True)
        p = self.softmax(h)
        loss = float(-np.log(np.maximum(p[np.arange(len(x)), y], 1e-30)).mean())
        p[np.arange(len(x)), y] -= 1
        p /= len(x)
        dh = (p @ self.out.T) * (h > 0)
        tables, biases = [], []
        for i, w in enumerate(WIDTHS):
            d = dh[:, i * FILTERS : (i + 1) * FILTERS]
            g = np.zeros_like(self.tables[i])
            for k in range(w):
                np.add.at(g[k], (np.take_along_axis(x, where[i] + k, 1), np.arange(FILTERS)[None]), d)
            tables.append(g)
            biases.append(d.sum(0))
        return loss, [*tables, *biases, h.T @ p, p.sum(0)]

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 5) -> None:
        """Adam on the cross entropy."""
        rng = np.random.default_rng(seed)
        params = [*self.tables, *self.bias, self.out, self.out_bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for epoch in range(EPOCHS):
            rate = 0.01 * (1 - epoch / EPOCHS)
            order = rng.permutation(len(x))
            for a in range(0, len(order), BATCH):
                part = order[a : a + BATCH]
                _, grads = self.gradients(x[part], y[part])
                step += 1
                for q, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.pairs = None


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def fit(docs: DataFrame, sample: int = SAMPLE) -> ByteCnn | None:
    """Trains on pieces of at most `sample` labelled documents outside fold 1, taken by the order of a hash."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(fold(F.col("doc_id")) != 1, F.lit(False)))
    n = F.char_length("text")
    start = lambda k: (F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(n - (PIECE - 1), F.lit(1))) + 1).cast("int")
    drawn = F.array(*[F.substring("text", start(k), F.lit(PIECE)) for k in range(PIECES)])
    pieces = F.when(n <= PIECES * PIECE, F.array("text")).otherwise(drawn)
    found = hash_sample(known.select("lang", pieces.alias("pieces"), "doc_id"), sample, "doc_id", "lang", "pieces").collect()
    rows = [(r["lang"], t) for r in found for t in r["pieces"]]
    labels = sorted({lang for lang, _ in rows})
    if not labels:
        return None
    x, owner = windows_of([normal_bytes(t) for _, t in rows])
    y = np.array([labels.index(lang) for lang, _ in rows])[owner]
    model = ByteCnn(labels)
    if len(labels) > 1:
        model.train(x, y)
    return model


def predict(docs: DataFrame, model: ByteCnn | None) -> DataFrame:
    """Adds lang_pred and score to all columns of docs."""
    spark = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(model)  # some 100 kB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        net = shared.value
        for batch in batches:
            texts = batch["text"].to_pylist()
            lang = [UNKNOWN] * len(texts)
            score = [0.0 if net is None else 1.0] * len(texts)
            # a letter: what changes by case, or any other alphabetic character
            rows = [k for k, t in enumerate(texts) if t and net is not None and any(map(str.isalpha, t))]
            part: list[int] = []
            size = 0
            for k in [*rows, None]:
                if k is not None:
                    part.append(k)
                    size += len(texts[k])
                if part and (k is None or size > 1 << 20):
                    x, owner = windows_of([normal_bytes(texts[i]) for i in part])
                    p = net.predict(x)
                    total = np.zeros((len(part), p.shape[1]))
                    np.add.at(total, owner, p)
                    mean = total / np.bincount(owner, minlength=len(part))[:, None]
                    for i, m in zip(part, mean, strict=True):
                        lang[i], score[i] = net.labels[int(m.argmax())], float(min(1.0, m.max()))
                    part, size = [], 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every text, with a network trained on the labelled documents outside fold 1."""
    rows = predict(docs.select("doc_id", "text"), fit(docs))
    return rows.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score")


def least_scores(docs: DataFrame, model: ByteCnn | None) -> dict[str, float]:
    """For each language the highest level, of LEVELS even ones, that no more than a share DOUBTFUL of its correctly classified held-out texts miss.

    All labelled documents of fold 1 count; what reaches the driver is at most one count for each language and level.
    """
    if model is None:
        return {}
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) == 1)).select("lang", "text")
    at = F.floor(F.col("score") * LEVELS).cast("int").alias("at")
    counts = predict(known, model).where("lang_pred = lang").groupBy("lang", at).agg(F.count(F.lit(1)).alias("n")).collect()
    total: dict[str, int] = {}
    for r in counts:
        total[r["lang"]] = total.get(r["lang"], 0) + r["n"]
    least, below = {}, dict.fromkeys(total, 0)
    for r in sorted(counts, key=lambda r: r["at"]):
        if below[r["lang"]] <= DOUBTFUL * total[r["lang"]]:
            least[r["lang"]] = r["at"] / LEVELS
        below[r["lang"]] += r["n"]
    return least


def keep_known(docs: DataFrame, model: ByteCnn | None, least: float | dict[str, float] = 0.0) -> DataFrame:
    """The documents, columns as they are, whose language is known with a score of at least `least`, one for all or for each; without a model, all that have a letter."""
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    names = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text"))
    floor = F.lit(0.0 if isinstance(least, dict) else least)
    for lang, score in least.items() if isinstance(least, dict) else ():
        floor = F.when(F.col("lang_pred") == lang, score).otherwise(floor)
    kept = predict(inner, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= floor))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in names])
