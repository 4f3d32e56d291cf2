"""Retrievers over many questions at once: vectors, full text, exact ids, subtrees, one-hop references, and their fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import query_terms
from quillon.operators.rank import ranked, rrf, slot_merge
from quillon.scratch import materialize

#: Queries that are sent to every task at once; more go in blocks.
QUERY_BLOCK = 4096
#: Search terms that are sent to every task; more meet the texts in a shuffle.
TERM_BLOCK = 100_000
#: Rows and queries that are multiplied at once in a task.
ROWS, ASKED = 4096, 512
POOL = 30


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def with_unit(df: DataFrame, vector: str, out: str) -> DataFrame:
    """Adds a vector scaled to length 1 in double precision; null for vectors without a direction."""
    length = norm(F.col(vector))
    return df.withColumn("_n", length).withColumn(out, F.when(F.col("_n") > 0, F.transform(vector, lambda x: x.cast("double") / F.col("_n")))).drop("_n")


def knn(queries: DataFrame, corpus: DataFrame, k: int, same: str | None = None, per: str | None = None) -> DataFrame:
    """Exact nearest neighbours by cosine: (qid, rank, id, score) for queries (qid, vector) against corpus (id, vector); with `per`, k for each value of that column of the corpus.

    same: a column both sides share, whose values must be equal; it makes the search an equi-join. Otherwise
    the stated query set is searched against all rows in blocks of QUERY_BLOCK, each small enough to broadcast.
    """
    if same:
        return _best(_units(queries, "qu").join(_units(corpus, "cu"), same), k)
    # few bytes hold much work: as many tasks as cores, whatever the files; vectors are scaled there, as a filter by their length would go to the few tasks that read them
    q, c = queries.where("vector is not null"), corpus.where("vector is not null").repartition(2 * corpus.sparkSession.sparkContext.defaultParallelism)
    blocks = -(-q.count() // QUERY_BLOCK)
    out = None
    for b in range(max(blocks, 1)):
        block = q.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b) if blocks > 1 else q
        part = _top(_nearest(block.select("qid", "vector"), c, k, per), k, per)  # at most about QUERY_BLOCK rows
        out = part if out is None else out.unionByName(part)
    return out


def _units(df: DataFrame, out: str) -> DataFrame:
    return with_unit(df, "vector", out).where(F.col(out).isNotNull()).drop("vector")


def _scaled(vectors: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and rows of vectors scaled to length 1, by their number of components; those without a direction, or with a null, are left out."""
    flat, ends = vectors.flatten(), np.diff(vectors.offsets.to_numpy())
    fine = np.ones(len(ends), bool)
    if flat.null_count:
        fine[np.repeat(np.arange(len(ends)), ends)[flat.is_null().to_numpy(zero_copy_only=False)]] = False
    flat = flat.to_numpy(zero_copy_only=False).astype(float)
    out = {}
    for size in np.unique(ends[fine]):
        places = np.flatnonzero(fine & (ends == size))
        rows = flat[np.repeat(fine & (ends == size), ends)].reshape(len(places), size)
        length = np.sqrt(np.einsum("ij,ij->i", rows, rows))
        some = (length > 0) | np.isnan(length)
        with np.errstate(invalid="ignore"):  # infinite components have no cosine: NaN
            out[int(size)] = places[some], rows[some] / length[some, None]
    return out


def _nearest(queries: DataFrame, corpus: DataFrame, k: int, per: str | None) -> DataFrame:
    """(qid, per, id, score) with each query's k best rows of each task, and of each value of `per`; only these are shuffled.

    A task multiplies blocks of its rows with blocks of the queries and keeps k scores and ids of each query. With `per` it reads its
    rows sorted by that column, and holds the best of one value at a time.
    """
    spark = corpus.sparkSession
    asked = queries.toArrow()  # a block of stated queries
    shared = spark.sparkContext.broadcast((asked["qid"].combine_chunks(), asked["vector"].combine_chunks()))
    rows = corpus.select("id", "vector", *([per] if per else []))
    if per:
        rows = rows.sortWithinPartitions(per)
    kinds = dict(corpus.dtypes) | {"qid": dict(queries.dtypes)["qid"]}
    more = f", `{per}` {kinds[per]}" if per else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, wanted = shared.value
        asked = [(of[j : j + ASKED], units[j : j + ASKED]) for of, units in _scaled(wanted).values() for j in range(0, len(of), ASKED)]
        best: list = [None] * len(asked)
        value, types = None, None

        def found() -> Iterator[pa.RecordBatch]:
            for j, (part, _) in enumerate(asked):
                if best[j] is not None and len(best[j][0]):
                    at, ids, score, _ = best[j]
                    cols = [qids.take(pa.array(part[at])), *([pa.array([value] * len(at), types[1])] if per else []), pa.array(ids.tolist(), types[0]), pa.array(score)]
                    yield pa.RecordBatch.from_arrays(cols, ["qid", *([per] if per else []), "id", "score"])
                best[j] = None

        for batch in batches:
            types = (batch["id"].type, batch[per].type if per else None)
            groups = batch[per].to_pylist() if per else [None] * batch.num_rows
            cuts = [0, *[i for i in range(1, len(groups)) if groups[i] != groups[i - 1]], len(groups)]
            for a, b in zip(cuts, cuts[1:]):
                if per and a < b and groups[a] != value:
                    yield from found()
                    value = groups[a]
                for at in range(a, b, ROWS):
                    piece = batch.slice(at, min(ROWS, b - at))
                    ids, rows = np.array(piece["id"].to_pylist()), _scaled(piece["vector"])
                    for j, (_, u) in enumerate(asked):
                        fit, units = rows.get(u.shape[1], ((), None))  # vectors of other lengths have no cosine with these
                        if len(fit):
                            best[j] = _merged(best[j], u @ units.T, ids[fit], k)
        yield from found()

    return rows.mapInArrow(run, f"qid {kinds['qid']}{more}, id {kinds['id']}, score double")


def _merged(best: tuple | None, cosines: np.ndarray, ids: np.ndarray, k: int) -> tuple:
    """The best k (query, id, score) of those so far and of a block [query, row], and each query's least score if it has k; of equal scores the smaller ids, NaN first."""
    score = np.round(cosines, 9)
    order = np.where(np.isnan(score), np.inf, score)
    n, m = order.shape
    least = best[3] if best else np.full(n, -np.inf)
    if m >= k:
        new = np.isneginf(least)
        if new.any():
            least = least.copy()
            least[new] = np.partition(order[new], m - k, axis=1)[:, m - k]
    at, row = np.nonzero(order >= least[:, None])
    score, ids = score[at, row], ids[row]
    if best:
        at, ids, score = np.concatenate([best[0], at]), np.concatenate([best[1], ids]), np.concatenate([best[2], score])
    key = np.where(np.isnan(score), np.inf, score)
    by = np.lexsort((ids, -key, at))
    at, ids, score, key = at[by], ids[by], score[by], key[by]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    kept = place < k
    least = np.full(n, -np.inf)
    least[at[place == k - 1]] = key[place == k - 1]
    return at[kept], ids[kept], score[kept], least


def _best(pairs: DataFrame, k: int, per: str | None = None) -> DataFrame:
    more = [per] if per else []
    return _top(pairs.select("qid", *more, "id", F.round(dot(F.col("qu"), F.col("cu")), 9).alias("score")), k, per)


def _top(scored: DataFrame, k: int, per: str | None = None) -> DataFrame:
    more = [per] if per else []
    rank = F.row_number().over(Window.partitionBy("qid", *more).orderBy(F.desc("score"), F.col("id")))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", *more, "rank", "id", "score")


def dense_text(questions: DataFrame, corpus: DataFrame, k: int, embed) -> DataFrame:
    """Nearest neighbours of questions (qid, text), with an embedder: a function that adds `vector` to rows (id, text)."""
    asked = embed(questions.select(F.col("qid").alias("id"), "text")).select(F.col("id").alias("qid"), "vector")
    return knn(asked, corpus, k)


def retrieve(mode: str, questions: DataFrame, corpus: DataFrame, k: int, pools: dict[str, DataFrame], weights: dict[str, float], lines: DataFrame | None = None, expansion=None, pool: int = POOL) -> DataFrame:
    """Hits (qid, rank, id, text, provisions, tokens, score) in a mode: `dense` or `hybrid`; with lines, endnotes are attached.

    questions: (qid, vector); corpus: (id, vector, text, provisions, tokens); pools: further ranked lists of the
    hybrid mode by retriever; lines: (provision_id, lines) of endnotes in the wanted style.
    """
    from quillon.operators.amend import attach

    if mode == "dense":
        hits = knn(questions, corpus.select("id", "vector"), k)
    elif mode == "hybrid":
        hits = hybrid({"dense": knn(questions, corpus.select("id", "vector"), pool)} | pools, weights, k, expansion, pool)
    else:
        raise ValueError(f"unknown retrieval mode: {mode}")
    full = hits.join(corpus.select("id", "text", "provisions", "tokens"), "id").withColumn("score", F.bround("score", 4))
    return attach(full, lines) if lines is not None else full


def fits(hits: DataFrame, budget: int) -> DataFrame:
    """(qid, tokens, fits): whether a query's hits (qid, tokens) fit the evidence budget together."""
    return hits.groupBy("qid").agg(F.sum("tokens").alias("tokens")).withColumn("fits", F.col("tokens") <= budget)


def postings(texts: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(term, id, tf) of rows (id, text): all terms, stop words too, or those wanted (term), which are selected before any shuffle."""
    found = texts.select("id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("term"))
    if wanted is not None:
        found = found.join(wanted, "term", "left_semi")
    return found.groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))


def full_text(queries: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """OR query over terms: each occurrence of a query term is a cover of its own and weighs 0.1; ordered by weight, then id."""
    asked = queries.select("qid", F.explode(query_terms(F.col("text"))).alias("term"))
    wanted = asked.select("term").distinct()
    if wanted.count() <= TERM_BLOCK:
        wanted = F.broadcast(wanted)
    hits = asked.join(postings(texts, wanted), "term").groupBy("qid", "id").agg(F.round(0.1 * F.sum("tf"), 6).alias("score"))
    return ranked(hits, [F.desc("score"), F.col("id")], k).select("qid", "rank", "id", "score")


def containers(refs: DataFrame, cover: DataFrame, closure: DataFrame) -> DataFrame:
    """The refs (ref) that only contain: some chunk covers an id below ref and does not itself cover ref.

    cover: (chunk, pid); closure: (pid, ancestor) with each id below its proper ancestors.
    """
    refs = materialize(refs, "refs")  # a written table of few rows is sent to the tasks, and the rest needs no shuffle
    under = materialize(closure.select("pid", F.col("ancestor").alias("ref")).where("pid != ref").join(refs, "ref", "left_semi"), "below")
    below = materialize(cover.join(under, "pid").select("ref", "chunk").distinct(), "covered")
    own = cover.select(F.col("pid").alias("ref"), "chunk").join(refs, "ref", "left_semi").join(below, ["ref", "chunk"], "left_semi")
    return refs.join(below.join(own, ["ref", "chunk"], "left_anti").select("ref").distinct(), "ref", "left_semi")


def by_ids(asked: DataFrame, cover: DataFrame, chunks: DataFrame, contained: DataFrame, k: int, least: int = 60) -> DataFrame:
    """Chunks that cover an asked id: (qid, rank, id). asked: (qid, ref, ref_rank); chunks: (id, tokens).

    Ordered by the best asked rank of all refs that match, then fewer tokens, then id; chunks of less than
    `least` tokens and chunks that match only containers are left out.
    """
    match = cover.select(F.col("pid").alias("ref"), F.col("chunk").alias("id")).join(materialize(asked, "asked"), "ref")
    match = match.join(contained.select("ref", F.lit(True).alias("is_container")), "ref", "left")
    best = match.groupBy("qid", "id").agg(F.min("ref_rank").alias("best"), F.max(F.col("is_container").isNull().cast("int")).alias("fine"))
    kept = chunks.select("id", "tokens").where(F.col("tokens") >= least).join(materialize(best.where("fine = 1"), "matched"), "id")
    return ranked(kept, [F.col("best"), F.col("tokens"), F.col("id")], k).select("qid", "rank", "id")


def under_ids(asked: DataFrame, cover: DataFrame, closure: DataFrame, queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Chunks in the subtree of an asked id, nearest first. An equi-join on the ancestor closure, not a prefix comparison."""
    asked = materialize(asked.select("qid", "ref").distinct(), "asked")
    tree = closure.select("pid", F.col("ancestor").alias("ref")).join(asked.select("ref").distinct(), "ref", "left_semi")
    chunks = materialize(cover.join(materialize(tree, "below"), "pid").select("ref", F.col("chunk").alias("id")).distinct(), "covered")
    return _best(_with_vectors(chunks.join(asked, "ref").select("qid", "id").distinct(), queries, corpus), k)


def _with_vectors(near: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Pairs (qid, id) with unit vectors of both; of the corpus only the rows that pairs name are moved."""
    near = materialize(near, "near")
    named = materialize(near.select("id").distinct(), "named")
    c = with_unit(corpus.join(named, "id", "left_semi"), "vector", "cu").drop("vector")
    return near.join(with_unit(queries, "vector", "qu").drop("vector"), "qid").join(c, "id")


def one_hop(seeds: DataFrame, edges: DataFrame, cover: DataFrame, queries: DataFrame, corpus: DataFrame, k: int, both_ways: bool = True) -> DataFrame:
    """Chunks that cover a neighbour of what the seed chunks (qid, id) cover, the seeds themselves excluded, nearest first.

    edges: (src, dst), dst may be null. Neighbours are the targets of edges out and, both ways, the sources of edges in.
    """
    seeds = materialize(seeds.select("qid", "id"), "seeds")
    named = materialize(cover.select(F.col("chunk").alias("id"), "pid").join(seeds, "id").select("qid", "pid").distinct(), "named")
    out = named.join(edges.where("dst is not null").select(F.col("src").alias("pid"), F.col("dst").alias("near")), "pid").select("qid", "near")
    if both_ways:
        out = out.unionByName(named.join(edges.select(F.col("dst").alias("pid"), F.col("src").alias("near")), "pid").select("qid", "near"))
    found = materialize(out.distinct(), "neighbours").join(cover.select(F.col("pid").alias("near"), F.col("chunk").alias("id")), "near").select("qid", "id").distinct()
    found = found.join(seeds.select("qid", "id"), ["qid", "id"], "left_anti")
    return _best(_with_vectors(found, queries, corpus), k)


RETRIEVERS = ("dense", "fts", "ids", "under")


def hybrid(pools: dict[str, DataFrame], weights: dict[str, float], k: int, expansion=None, pool: int = POOL, seeds: int = 3, keep: int = 3, slots: int = 2) -> DataFrame:
    """Fuses the retrievers' pools (qid, rank, id), and with an expansion lets its hits into the slots after the first ones.

    expansion: called with the seed chunks (qid, id), it returns a ranked list. A retriever without a name in
    RETRIEVERS is an error; rewrites of a question are pools named rewrite1, rewrite2.
    """
    for name in pools:
        if name not in RETRIEVERS and not name.startswith("rewrite"):
            raise ValueError(f"unknown retriever: {name}")
    lists = None
    for n, (name, df) in enumerate(pools.items()):
        part = df.where(F.col("rank") <= pool).select("qid", F.lit(n).alias("list_id"), F.lit(float(weights.get(name, 1.0))).alias("weight"), "rank", "id")
        lists = part if lists is None else lists.unionByName(part)
    fused = rrf(lists, pool if expansion else k)
    if expansion is None:
        return fused.select("qid", "rank", "id", "score")
    found = expansion(fused.where(F.col("rank") <= seeds).select("qid", "id"))
    merged = slot_merge(fused, found, keep, slots, k)
    return merged.join(fused.select("qid", "id", "score"), ["qid", "id"], "left").select("qid", "rank", "id", "score")
