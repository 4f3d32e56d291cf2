"""MinHash near-duplicates with HyperMinHash registers.

A document's shingle set is spread over BANDS * ROWS buckets. A bucket's register keeps the smallest hash in
compressed form: its leading-zero count and the MANTISSA bits after them. Bands of ROWS registers are hashed
into keys; documents that share a key are candidates. For the keys alone, an empty bucket borrows the register
of another one, in an order fixed for each bucket, so that short documents' bands say as much as long ones'. Of candidate documents, and of no others, the full sets
are built again; pairs are screened by the Jaccard similarity estimated from their registers, corrected for
chance collisions of compressed values, and links are confirmed on the full sets.

Documents of equal sets are one class from the start, a node of the graph. Candidates that hang together form a
cluster; a cluster's members meet in one task, or if it is large in a task for each pair of blocks: first their
registers alone, whose estimates tell which members can have a link in which task, and then the full sets of these.
There, documents that can't link
because too many of their shingles occur nowhere else in the cluster are set aside first. Tasks return the
edges of spanning forests, not all pairs; pairs already connected need no confirmation.

Two documents of similarity s share a key with probability 1 - (1 - s**ROWS)**BANDS: all but 3 in a million at
0.8, all but 3 in a billion at 0.85.

Defined cases: null text and text without words have the empty set and link with nothing; fewer words than a
shingle are one shingle; repeated rows are documents of equal sets; rows of one doc_id with different texts are
documents each, which link by their own texts; rows without an id are kept, and are no one's component; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import components, materialize, release, squeezed, tune
from quillon.llm.words import mix, shingle_sets

BANDS, ROWS = 42, 6
REGISTERS = BANDS * ROWS
MANTISSA = 10
EMPTY = 0xFFFF
BLOCK = 512


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers of each set: uint16 of leading-zero count and mantissa, EMPTY where no hash fell."""
    n = len(sets)
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    bucket = ((flat >> np.uint64(32)) % np.uint64(REGISTERS)).astype(np.int64)
    value = mix(flat + np.uint64(0x5851F42D4C957F2D))
    low = np.full(n * REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(low, owner * REGISTERS + bucket, value)
    hit = np.bincount(owner * REGISTERS + bucket, minlength=n * REGISTERS) > 0
    length = np.frexp(low.astype(np.float64))[1].clip(1, 64)  # bits up to the leading one; rounding up moves a value to the next power alike everywhere
    zeros = 64 - length
    shift = np.maximum(length - 1 - MANTISSA, 0).astype(np.uint64)
    packed = (zeros.astype(np.uint64) << np.uint64(MANTISSA)) | ((low >> shift) & np.uint64((1 << MANTISSA) - 1))
    return np.where(hit, packed, EMPTY).astype(np.uint16).reshape(n, REGISTERS)


@lru_cache(1)
def lenders() -> np.ndarray:
    """For each bucket, the buckets it borrows from, in order."""
    rng = np.random.default_rng(2017)
    return np.stack([rng.permutation(REGISTERS) for _ in range(REGISTERS)], 1)


def filled(regs: np.ndarray) -> np.ndarray:
    """Registers with the empty ones borrowed, of rows that have any."""
    out = regs.copy()
    rows = np.flatnonzero((regs == EMPTY).any(1) & (regs != EMPTY).any(1))
    for order in lenders():
        if not len(rows):
            break
        lent = np.where(out[rows] == EMPTY, regs[rows][:, order], out[rows])
        out[rows] = lent
        rows = rows[(lent == EMPTY).any(1)]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """Hash of each band of filled registers (signed)."""
    parts = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key ^ (parts[:, :, r] + np.uint64(0x9E3779B97F4A7C15)))
    return key.view(np.int64)


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that registers of independent sets of n and m hashes are equal by chance.

    A register of a set with c hashes in its bucket has leading-zero count z with probability
    (1 - 2**-(z+1))**c - (1 - 2**-z)**c, and its mantissa is nearly uniform.
    """
    z = np.arange(40)
    out = np.zeros(len(n))
    high, low = -np.expm1(-(z + 1.0) * math.log(2)), -np.expm1(-z * math.log(2))
    x, y = n[:, None] / REGISTERS, m[:, None] / REGISTERS
    out = ((high**x - low**x) * (high**y - low**y)).sum(1) / (1 << MANTISSA)
    return out


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of register rows a[i], b[i] of sets of n[i], m[i]; and the registers used."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(1)
    same = ((a == b) & (a != EMPTY)).sum(1)
    c = chance(n, m)
    return (same / np.maximum(used, 1) - c) / (1 - c), used


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def estimated_pairs(regs: np.ndarray, size: np.ndarray, left: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, estimate) of the pairs whose registers allow a link.

    left is all true, or marks the first of two blocks, between which links are looked for.
    """
    t = percent / 100
    every = left.all()
    later = np.flatnonzero(~left)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for x in np.flatnonzero(left).tolist():
        y = np.arange(x + 1, len(size)) if every else later
        y = y[np.minimum(size[x], size[y]) >= t * np.maximum(size[x], size[y]) - 1e-9]
        if not len(y):
            continue
        est, used = estimate(np.broadcast_to(regs[x], (len(y), REGISTERS)), regs[y], np.full(len(y), size[x]), size[y])
        ok = est >= t - 5 * np.sqrt(t * (1 - t) / np.maximum(used, 1)) - 0.01
        out.append((np.full(int(ok.sum()), x), y[ok], est[ok]))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def links_among(ids: np.ndarray, sets: list[np.ndarray], left: np.ndarray, percent: int) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of all links within the documents; left as in `estimated_pairs`."""
    n = len(ids)
    size = np.array([len(s) for s in sets], float)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size.astype(int))
    _, back, count = np.unique(flat, return_inverse=True, return_counts=True)
    alone = np.bincount(owner, weights=count[back] == 1, minlength=n)
    can = np.flatnonzero(100 * (size - alone) >= percent * size)  # the others' shingles are too rare here
    if not left.all() and (left[can].all() or not left[can].any()):
        return [], []
    a, b, s = estimated_pairs(registers([sets[i] for i in can]), size[can], left[can], percent)
    order = np.argsort(-s, kind="stable")
    f, out_a, out_b = Forest(n), [], []
    for x, y in zip(can[a[order]].tolist(), can[b[order]].tolist(), strict=True):
        p, q = f.root(x), f.root(y)
        if p != q and linked(sets[x], sets[y], percent):
            f.up[max(p, q)] = min(p, q)
            out_a.append(int(ids[x]))
            out_b.append(int(ids[y]))
    return out_a, out_b


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text").alias("k")


def _rows(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(doc_id, k, n_shingles, component) of every row; k tells rows of different ids or texts apart."""
    tune(docs.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            sets = shingle_sets([(t or "").encode() for t in batch["text"].to_pylist()], shingle)
            keys = band_keys(filled(registers(sets)))
            # the set's name: two sums over its hashes and its size, as good as 128 random bits
            names = []
            for s in sets:
                with np.errstate(over="ignore"):
                    names.append(f"{int(mix(s).sum()):016x}{int(mix(s ^ np.uint64(0xD6E8FEB86659FD93)).sum()):016x}{len(s):x}" if len(s) else None)
            bands = [k if len(s) else k[:0] for k, s in zip(keys, sets, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), batch["k"], pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.string()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "k", "n_shingles", "name", "bands"])

    sketched = docs.select("doc_id", "text", _row_key()).mapInArrow(sketch, "doc_id long, k long, n_shingles long, name string, bands array<long>")
    sketched = materialize(sketched, "sketches")
    # a class is named by its smallest id; one of its rows stands for it
    classes = sketched.where("name is not null").groupBy("name").agg(F.min("doc_id").alias("rep"), F.min("k").alias("k"))
    classes = materialize(classes.withColumn("id", F.xxhash64("name")), "classes")
    reps = sketched.select("name", "k", "bands").join(classes.select("name", "k", "id"), ["name", "k"]).dropDuplicates(["name", "k"])
    bands = reps.select("id", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").select("key", "hub")
    # a merge join at every size: its hot keys can be split, and its cost grows in proportion
    candidates = bands.join(shared.hint("merge"), "key").where("id != hub").select(F.col("id").alias("a"), F.col("hub").alias("b"))
    clusters = materialize(components(candidates, "clusters"), "clusters")
    edges = _confirm(docs, classes.select("id", "k"), clusters, shingle, percent)
    groups = classes.join(components(edges, "near"), "id", "left").select("name", "rep", F.coalesce("component", "id").alias("group"))
    least = groups.groupBy("group").agg(F.min("rep").alias("component"))
    named = groups.join(least, "group").select("name", "component")
    return sketched.select("doc_id", "k", "n_shingles", "name").join(named, "name", "left").select("doc_id", "k", "n_shingles", F.coalesce("component", "doc_id").alias("component"))


def near_documents(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: links join documents with 100 * shared >= percent * united shingles."""
    rows = _rows(docs, shingle, percent)
    kept = F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True))
    return rows.select("doc_id", "n_shingles", F.col("component").alias("component_id"), kept.alias("kept"))


def one_of_each(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The documents, columns as they are: of each group of near-duplicates one row of the smallest id. Rows without an id or without words stay."""
    rows = _rows(docs, shingle, percent).where("doc_id is not null").groupBy("doc_id", "k", "component", (F.col("n_shingles") == 0).alias("bare")).agg(F.count(F.lit(1)).alias("n"))
    rows = materialize(rows, "groups")
    best = rows.where("doc_id = component and not bare").groupBy("component").agg(F.min(F.struct("k", "n")).alias("best")).select("best.k", F.col("component").alias("doc_id"), "best.n")
    # rows without words are in no group
    best = best.unionByName(rows.where("bare").select("k", "doc_id", F.lit(1).cast("long").alias("n")))
    best = materialize(best, "kept")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id"), _row_key())
    kept = keyed.join(best.where("n = 1").select("doc_id", "k"), ["doc_id", "k"], "left_semi")
    # equal rows stand for each other: one of them stays
    again = keyed.join(best.where("n > 1").select("doc_id", "k"), ["doc_id", "k"], "left_semi").dropDuplicates(["doc_id", "k"])
    out = kept.unionByName(again).unionByName(keyed.where("doc_id is null"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def _confirm(docs: DataFrame, reps: DataFrame, clusters: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Edges (a, b) of spanning forests of the confirmed links within each cluster; reps: (id, k) of the row that stands for a class."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        inflate = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            sets = shingle_sets([inflate(t) for t in batch["text"].to_pylist()], shingle)
            packed = (pa.array([x.tobytes() for x in part], pa.binary()) for part in (registers(sets), sets))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([len(s) for s in sets], pa.int64()), *packed], ["id", "n_shingles", "regs", "shingles"])

    wanted = clusters.select("id").join(reps, "id")
    texts = squeezed(docs.select(_row_key(), "text")).join(wanted.hint("merge"), "k").dropDuplicates(["k"])
    members = materialize(texts.select("id", "text").mapInArrow(build, "id long, n_shingles long, regs binary, shingles binary"), "members")
    sizes = clusters.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    block = F.when(F.col("blocks") == 1, 0).otherwise(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    placed = clusters.join(sizes, "component").select("id", "component", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = placed.select("id", "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block")
    known = placed.join(members.select("id", "regs", "n_shingles"), "id")

    def first_block(group: pa.Table) -> np.ndarray:
        i = group["i"][0].as_py()
        return np.ones(group.num_rows, bool) if i == group["j"][0].as_py() else group["block"].to_numpy() == i

    def screen(group: pa.Table) -> pa.Table:
        regs = np.frombuffer(b"".join(group["regs"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
        a, b, _ = estimated_pairs(regs, group["n_shingles"].to_numpy().astype(float), first_block(group), percent)
        return group.take(pa.array(np.unique(np.concatenate([a, b])))).select(["id", "component", "i", "j", "block"])

    able = known.groupBy("component", "i", "j").applyInArrow(screen, "id long, component long, i int, j int, block int")
    dealt = materialize(able, "screened").join(members.select("id", "shingles"), "id")

    def confirm(group: pa.Table) -> pa.Table:
        sets = [np.frombuffer(s, np.uint64) for s in group["shingles"].to_pylist()]
        a, b = links_among(group["id"].to_numpy(), sets, first_block(group), percent)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return materialize(dealt.groupBy("component", "i", "j").applyInArrow(confirm, "a long, b long"), "links")
