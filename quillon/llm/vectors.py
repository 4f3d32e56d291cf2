"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, table lookups, exact rerank.

A coarse quantiser and one codebook per subspace are fitted on a bounded sample (SAMPLE rows); every row is
indexed. Rows of one label, length and list form a cell. Of two vectors within the search radius of each other
and in different lists, one at least is within half the radius of the border between these; so a vector searches
each list whose border is that near. In a cell, distances to codes come from lookup tables, and
since each code's own error is known, no pair within the radius is passed over; what is left is decided by
the exact cosine in double precision. A link counts at both ends: for the end that did not search the other's
list, where the other found it.

Equal vectors of a label are searched once, with their number as weight. Cells are dealt in blocks of
bounded size, so a hot cell is searched by many tasks; a block returns link counts and the edges of a
spanning forest, not its pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and those without a
label, link with nothing and keep themselves; vectors of different lengths don't link, whatever the lengths;
repeated rows are vectors each; columns other than vec_id, embedding and label are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import components, hash_sample, materialize, tune

SAMPLE = 16_384
SUBSPACES = 8
CODEWORDS = 256
MEMBER_BLOCK = 2048
QUERY_BLOCK = 4096


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        count = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(count > 0, total / np.maximum(count, 1), centres).astype(x.dtype)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    half = (centres**2).sum(1) / 2
    for k in range(0, len(x), 4096):
        out[k : k + 4096] = (half - x[k : k + 4096] @ centres.T).argmin(1)
    return out


class Quantiser:
    """Centres of the inverted lists, and a codebook for each subspace of the residuals."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.dim = sample.shape[1]
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.centres = k_means(unit, lists)
        residual = unit - self.centres[nearest(unit, self.centres)]
        self.cuts = [c for c in np.array_split(np.arange(self.dim), min(SUBSPACES, self.dim))]
        self.books = [k_means(residual[:, c], CODEWORDS, 6) for c in self.cuts]
        apart = ((self.centres[:, None] - self.centres[None]) ** 2).sum(2)
        self.apart = np.sqrt(apart) + np.eye(len(self.centres))

    def fitted(self, unit: np.ndarray) -> np.ndarray:
        """Rows cut or padded with zeros to the quantiser's length: distances between rows can only shrink, so none within the radius is lost."""
        have = unit.shape[1]
        return unit[:, : self.dim] if have >= self.dim else np.pad(unit, ((0, 0), (0, self.dim - have)))

    def index(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and code error of each row."""
        cell = nearest(unit, self.centres)
        residual = unit - self.centres[cell]
        codes = np.stack([nearest(residual[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)], 1)
        made = np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], 1)
        return cell, codes.astype(np.uint8), np.sqrt(((residual - made) ** 2).sum(1))

    def probes(self, unit: np.ndarray, cell: np.ndarray, margin: float) -> list[np.ndarray]:
        """The lists whose border with the row's own list is within margin of the row."""
        square = (self.centres**2).sum(1) - 2 * unit @ self.centres.T
        border = (square - square[np.arange(len(unit)), cell][:, None]) / (2 * self.apart[cell])
        return [np.flatnonzero(b <= margin) for b in border]

    def lookup(self, unit: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared distance of each query to each member's code, from tables of subspace distances."""
        residual = unit - self.centres[cell]
        out = np.zeros((len(unit), len(codes)), np.float32)
        for m, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            part = residual[:, c]
            tables = (part**2).sum(1)[:, None] - 2 * part @ b.T + (b**2).sum(1)
            out += tables.astype(np.float32)[:, codes[:, m]]
        return out


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) of a spanning forest of the graph with edges a - b, root the smallest node."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, u, low)
        np.minimum.at(root, v, low)
        np.minimum.at(root, before, root)  # a root takes along all that hangs on it
        root = root[root]
        if (root == before).all():
            break
    hang = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[hang], nodes[root[hang]]


def near_vectors(vectors: DataFrame, threshold: float = 0.98, margin: float | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; links join rows of equal label and cosine of at least threshold.

    A margin below half the search radius, its default, saves probes and misses links.
    """
    spark = vectors.sparkSession
    tune(spark)
    fine = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.col("label").isNotNull()
    fine &= F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.when(fine, F.col("embedding").cast("array<double>")).alias("v"))
    # equal vectors of a label are one class, named by its smallest id
    classes = rows.where(F.col("v").isNotNull()).groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight"))
    classes = materialize(classes, "vectors")
    found = _search(spark, classes, threshold, margin)
    edges = found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))
    groups = components(edges, "vectors")
    counts = found.where("other is null").groupBy("id").agg(F.sum("n").alias("n"))
    known = classes.join(counts, "id", "left").join(groups, "id", "left")
    known = known.select("label", "v", F.coalesce("n", F.lit(0)).alias("n"), F.col("weight"), F.coalesce("component", "id").alias("component"))
    out = rows.join(known, ["label", "v"], "left")
    links = F.coalesce(F.col("n") + F.col("weight") - 1, F.lit(0)).cast("long")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", links.alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def _search(spark: SparkSession, classes: DataFrame, threshold: float, margin: float | None) -> DataFrame:
    """(id, n, other): the weight of the links of a class found in one block, or an edge of a block's forest."""
    radius = math.sqrt(2 - 2 * threshold) + 1e-6
    margin = radius / 2 if margin is None else margin
    total = classes.count()
    sample = hash_sample(classes.select("id", "v"), SAMPLE, "id").toPandas()["v"]
    if not total:
        return spark.createDataFrame([], "id long, n long, other long")
    dim = Counter(map(len, sample)).most_common(1)[0][0]
    lists = max(4, min(1024, math.isqrt(total) // 2))
    model = spark.sparkContext.broadcast(Quantiser(np.array([v for v in sample if len(v) == dim], np.float64), lists))  # bounded by SAMPLE

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = model.value
        for batch in batches:
            rows = [np.asarray(x, np.float64) for x in batch["v"].to_numpy(zero_copy_only=False)]
            unit = np.concatenate([np.zeros((0, q.dim)), *(q.fitted((r / np.linalg.norm(r))[None]) for r in rows)])
            cell, codes, error = q.index(unit)
            # single precision where it holds the components exactly
            packed = [(np.float32(r) if (np.float32(r) == r).all() else r).tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["label"], batch["weight"], pa.array(packed, pa.binary()), pa.array([len(r) for r in rows], pa.int32()), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error, pa.float64()), pa.array([p.astype(np.int32) for p in q.probes(unit, cell, margin)], pa.list_(pa.int32()))],
                ["id", "label", "weight", "v", "size", "cell", "codes", "error", "probes"],
            )

    indexed = classes.select("id", F.concat_ws(":", F.size("v").cast("string"), "label").alias("label"), "weight", "v")
    indexed = materialize(indexed.mapInArrow(index, "id long, label string, weight long, v binary, size int, cell int, codes binary, error double, probes array<int>"), "indexed")
    members = indexed.select("id", "label", "weight", "v", "size", "cell", "codes", "error", "probes")
    queries = indexed.select("id", "label", "weight", "v", "size", F.col("cell").alias("home"), F.explode("probes").alias("cell"))
    sizes = members.groupBy("label", "cell").agg(F.ceil(F.count(F.lit(1)) / MEMBER_BLOCK).cast("int").alias("m_blocks"))
    asked = queries.groupBy("label", "cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("q_blocks"))
    blocks = sizes.join(asked, ["label", "cell"])
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("codes", "binary"), ("error", "double"), ("probes", "array<int>"))]
    left = members.join(blocks, ["label", "cell"]).select("id", "label", "cell", own("m_blocks").alias("mb"), every("q_blocks").alias("qb"), "weight", "v", "size", F.col("cell").alias("home"), "codes", "error", "probes")
    right = queries.join(blocks, ["label", "cell"]).select("id", "label", "cell", every("m_blocks").alias("mb"), own("q_blocks").alias("qb"), "weight", "v", "size", "home", *nothing)

    def search(table: pa.Table) -> pa.Table:
        q = model.value
        is_member = np.asarray(table["codes"].is_valid())
        ids, weight, home = (table[c].to_numpy() for c in ("id", "weight", "home"))
        width = table["size"][0].as_py()
        v = np.stack([np.frombuffer(x, np.float64 if len(x) == 8 * width else np.float32).astype(np.float64) for x in table["v"].to_pylist()])
        norm = np.linalg.norm(v, axis=1)
        m, s = np.flatnonzero(is_member), np.flatnonzero(~is_member)
        count = np.zeros(len(ids), np.int64)
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        if len(m) and len(s):
            picked = table.take(pa.array(m))
            codes = np.frombuffer(b"".join(picked["codes"].to_pylist()), np.uint8).reshape(len(m), -1)
            reach = (radius + picked["error"].to_numpy()) ** 2 + 1e-5
            cell = table["cell"][0].as_py()
            probes = picked["probes"].combine_chunks()
            searches = np.zeros((len(m), len(q.centres)), bool)  # which lists a member searches itself
            searches[np.repeat(np.arange(len(m)), np.diff(probes.offsets.to_numpy())), probes.flatten().to_numpy()] = True
            for k in range(0, len(s), 256):
                part = s[k : k + 256]
                i, j = np.nonzero(q.lookup(q.fitted(v[part] / norm[part, None]), cell, codes) <= reach)
                keep = np.zeros(len(i), bool)
                for b in range(0, len(i), 1 << 16):
                    x, y = part[i[b : b + (1 << 16)]], m[j[b : b + (1 << 16)]]
                    keep[b : b + (1 << 16)] = (np.einsum("ij,ij->i", v[x], v[y]) / (norm[x] * norm[y]) >= threshold) & (ids[x] != ids[y])
                i, j = i[keep], j[keep]
                if len(i):
                    x, y = part[i], m[j]
                    np.add.at(count, x, weight[y])
                    unseen = ~searches[j, home[x]]
                    np.add.at(count, y[unseen], weight[x[unseen]])
                    ends.append(forest(ids[x], ids[y]))
        hit = np.flatnonzero(count)
        a, b = (np.concatenate([np.zeros(0, np.int64), *e]) for e in zip(*ends, strict=True)) if ends else (np.zeros(0, np.int64),) * 2
        other = pa.concat_arrays([pa.nulls(len(hit), pa.int64()), pa.array(b, pa.int64())])
        return pa.table({"id": np.concatenate([ids[hit], a]), "n": np.concatenate([count[hit], np.zeros(len(a), np.int64)]), "other": other})

    # without this, the rows would stay where the joins by cell had put them, a hot cell's blocks in one task
    dealt = left.unionByName(right).repartition("label", "cell", "mb", "qb")
    found = dealt.groupBy("label", "cell", "mb", "qb").applyInArrow(search, "id long, n long, other long")
    return materialize(found, "vector-links")
