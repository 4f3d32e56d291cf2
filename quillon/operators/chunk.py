"""Chunking: token windows, their coverage of passages, and structural chunks of a tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import n_grams, plain, token_count, tokens
from quillon.scratch import materialize

WINDOW, OVERLAP, MOST, SPLIT, LEAD = 512, 64, 700, 1500, 160


def starts(n: Column, window: int = WINDOW, overlap: int = OVERLAP, to_end: bool = False) -> Column:
    """First tokens of the windows over n tokens. Windows stop where only the overlap would be new; to_end: they run to the end."""
    last = n - 1 if to_end else F.greatest(n - overlap, F.lit(1)) - 1
    return F.when(n > 0, F.sequence(F.lit(0), last, F.lit(window - overlap))).otherwise(F.array().cast("array<int>"))


def windows(texts: DataFrame, window: int = WINDOW, overlap: int = OVERLAP, to_end: bool = False) -> DataFrame:
    """(id, start, n_tokens, text): each text's windows of whole tokens."""
    split = texts.select("id", tokens(F.col("text")).alias("t"))
    out = split.select("id", "t", F.explode(starts(F.size("t"), window, overlap, to_end)).alias("start"))
    piece = F.slice("t", F.col("start") + 1, F.lit(window))
    return out.select("id", "start", F.size(piece).alias("n_tokens"), F.array_join(piece, " ").alias("text"))


def page_windows(pages: DataFrame, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """Windows over all pages of a document in a row: (doc_id, start, n_tokens, text, page_start, page_end).

    pages: (doc_id, page, text). Tokens are numbered by adding the counts of the pages before, and each is
    dealt to the one or two windows that hold it, so that no document has to fit one row.
    """
    from pyspark.sql import Window as W

    sized = pages.select("doc_id", "page", tokens(F.col("text")).alias("t"))
    order = W.partitionBy("doc_id").orderBy("page")
    sized = sized.withColumn("_at", F.coalesce(F.sum(F.size("t")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    sized = sized.withColumn("_total", F.sum(F.size("t")).over(W.partitionBy("doc_id")))
    words = sized.select("doc_id", "page", "_at", "_total", F.posexplode("t").alias("i", "w")).withColumn("g", F.col("_at") + F.col("i"))
    step = window - overlap
    last = F.floor((F.greatest(F.col("_total") - overlap, F.lit(1)) - 1) / step)
    low = F.greatest(F.lit(0), F.ceil((F.col("g") - window + 1) / step))
    high = F.least(F.floor(F.col("g") / step), last)
    dealt = words.where(low <= high).select("doc_id", "page", "g", "w", F.explode(F.sequence(low, high)).alias("k"))
    parts = dealt.groupBy("doc_id", "k").agg(F.array_sort(F.collect_list(F.struct("g", "w"))).alias("x"), F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    return parts.select("doc_id", (F.col("k") * step).cast("long").alias("start"), F.size("x").alias("n_tokens"), F.array_join(F.transform("x", lambda p: p["w"]), " ").alias("text"), "page_start", "page_end")


def coverage(chunks: DataFrame, probes: DataFrame, length: int = 60, least: int = 25, anchor: int = 5, pages: bool = False) -> DataFrame:
    """(chunk, probe_id): chunks whose plain text contains the first `length` characters of a probe's.

    A probe's inner words, up to `anchor` of them before its last, lead to the chunks that hold them: an equi-join on
    hashes without any text. Texts are fetched for what that leaves, and containment decides. The first and last word
    may be parts of longer ones, so they aren't asked for; a probe without inner words is compared with every chunk.
    Probes shorter than `least` characters cover nothing. With pages, chunks (page_start, page_end) and probes (page)
    have to lie within one page of each other.
    """
    place = ["page"] if pages else []
    wanted = probes.select("probe_id", *place, F.rtrim(F.substring(plain(F.col("text")), 1, length)).alias("p")).where(F.length("p") >= least)
    whole = F.filter(F.split("p", " "), lambda w: w != "")
    n = F.least(F.greatest(F.size(whole) - 2, F.lit(0)), F.lit(anchor))
    keyed = wanted.withColumn("n", n).withColumn("key", F.xxhash64("n", F.array_join(F.slice(whole, F.greatest(F.size(whole) - n, F.lit(1)), n), " ")))
    # as bounded as the anchor: which lengths probes ask for
    lengths = [r["n"] for r in keyed.select("n").distinct().collect()]
    have = chunks.select("chunk", plain(F.col("text")).alias("c"))
    keys = lambda n: F.transform(n_grams(F.split("c", " "), n), lambda g: F.xxhash64(F.lit(n), g)) if n else F.array(F.xxhash64(F.lit(0), F.lit("")))
    runs = have.select("chunk", F.explode(F.array_distinct(F.flatten(F.array(*[keys(n) for n in lengths])))).alias("key")) if lengths else have.where("false").select("chunk", F.lit(0).cast("long").alias("key"))
    pairs = runs.join(keyed.select("key", "probe_id"), "key").select("chunk", "probe_id").distinct()
    texts = have if not pages else chunks.select("chunk", plain(F.col("text")).alias("c"), "page_start", "page_end")
    found = pairs.join(wanted, "probe_id").join(texts, "chunk").where(F.contains("c", F.col("p")))
    if pages:
        found = found.where(F.col("page").between(F.col("page_start") - 1, F.col("page_end") + 1))
    return found.select("chunk", "probe_id")


def structural(nodes: DataFrame, tree: DataFrame, counts: DataFrame, most: int = MOST) -> DataFrame:
    """The cut through a tree: (id, whole, tokens) of the nodes that become chunks.

    A node is one chunk with all below it if that has at most `most` tokens or no child; otherwise its own
    text is a chunk and its children are cut likewise. tree: (id, ancestor, depth); counts: (id, all_tokens) of subtrees.
    """
    sized = counts.select("id", F.col("all_tokens").cast("int").alias("all_tokens"))
    parents = nodes.where("parent is not null").select(F.col("parent").alias("id")).distinct().withColumn("inner", F.lit(True))
    sized = materialize(sized.join(parents, "id", "left").where(F.col("inner") | (F.col("all_tokens") > 0)), "sized")
    # a node holds no fewer tokens than any below it: where one above is whole, the parent is
    shut = sized.where((F.col("all_tokens") <= most) & F.col("inner")).select(F.col("id").alias("parent"))
    own = nodes.select("id", "parent", F.coalesce(token_count(F.col("text")), F.lit(0)).alias("own"))
    free = own.join(shut, "parent", "left_anti").select("id", "own")
    split = (F.col("all_tokens") > most) & F.coalesce("inner", F.lit(False))
    out = free.join(sized, "id").select("id", (~split).alias("whole"), F.when(split, F.col("own")).otherwise(F.col("all_tokens")).alias("tokens"))
    return out.where("tokens > 0")


def leads(nodes: DataFrame, tree: DataFrame, cut: DataFrame, longest: int = LEAD) -> DataFrame:
    """(id, lead): the opening words of all split nodes above a chunk, from the top, each the first `longest` characters of its first line.

    cut: of `structural`; nodes: (id, text, label). A clause cut off from the words that introduce it keeps them so.
    """
    split = cut.where("not whole").select(F.col("id").alias("ancestor"))
    first = F.substring(F.substring_index(F.trim(F.concat_ws(" ", "label", "text")), "\n", 1), 1, longest)
    above = tree.where("depth > 0").join(split, "ancestor").join(nodes.select(F.col("id").alias("ancestor"), first.alias("opening")), "ancestor")
    parts = above.join(cut.select("id"), "id", "left_semi").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("depth", "opening")), asc=False).alias("x"))
    return parts.select("id", F.trim(F.array_join(F.transform("x", lambda v: v["opening"]), " ")).alias("lead"))


def embed_text(breadcrumb: Column, lead: Column, cite: Column, text: Column) -> Column:
    """What is embedded of a structural chunk: its breadcrumb, the words that lead to it, its citation, and its text."""
    return F.concat_ws("\n", F.nullif(breadcrumb, F.lit("")), F.concat(F.nullif(lead, F.lit("")), F.lit(" ...")), F.concat(cite, F.lit(":")), text)


def table_name(table_id: Column) -> Column:
    """s393:tbl2 is Section 393, Table 2; the only table of a schedule has no number."""
    owner, nth = F.regexp_extract(table_id, r"^(.*):tbl(\d+)$", 1), F.regexp_extract(table_id, r":tbl(\d+)$", 1)
    section = F.regexp_extract(owner, r"^s(\d+)", 1)
    base = F.when(section != "", F.concat(F.lit("Section "), section)).otherwise(F.concat(F.lit("Schedule "), F.split(owner, ":")[1]))
    return F.concat(base, F.lit(", Table"), F.when((nth != "1") | (section == "393"), F.concat(F.lit(" "), nth)).otherwise(""))


def build(version: str, corpus: dict[str, DataFrame]) -> DataFrame:
    """(id, text) of a version's chunks: v0 windows over raw pages, v1 over clean pages, v2 the cut through the tree with rows and notes.

    corpus: pages_raw, pages_clean (doc_id, page, text); nodes (id, parent, ord, text), table_rows, tables.
    """
    if version in ("v0", "v1"):
        pages = page_windows(corpus["pages_raw" if version == "v0" else "pages_clean"])
        return pages.select(F.concat_ws(":", F.lit(version), F.col("doc_id").cast("string"), F.col("start").cast("string")).alias("id"), "text")
    if version != "v2":
        raise ValueError(f"no chunker for {version}")
    from quillon.operators.hierarchy import closure, subtree_text, subtree_tokens

    nodes = corpus["nodes"]
    tree = closure(nodes.select("id", "parent"))
    cut = structural(nodes, tree, subtree_tokens(tree, nodes))
    below = subtree_text(tree, nodes, only=cut.where("whole"))  # texts of chunks only
    own = cut.where("not whole").join(nodes, "id").select("id", "text")
    parts = cut.where("whole").join(below, "id").select("id", "text").unionByName(own).unionByName(row_chunks(corpus["table_rows"]).select("id", "text")).unionByName(note_chunks(corpus["tables"]).select("id", "text"))
    return split_oversize(parts.withColumn("id", F.concat(F.lit("v2:"), "id")))


def split_oversize(chunks: DataFrame, most: int = SPLIT) -> DataFrame:
    """Chunks of more than `most` tokens in windows that run to the end, with @k after their id; others as they are."""
    sized = chunks.withColumn("_n", token_count(F.col("text")))
    small = sized.where(F.col("_n") <= most).select("id", "text")
    parts = windows(sized.where(F.col("_n") > most).select("id", "text"), to_end=True)
    named = F.concat("id", F.lit("@"), (F.col("start") / (WINDOW - OVERLAP) + 1).cast("int").cast("string"))
    return small.unionByName(parts.select(named.alias("id"), "text"))


def row_chunks(rows: DataFrame) -> DataFrame:
    """One chunk per table row: (id, text, provisions) with each filled cell as `heading: value`."""
    filled = F.map_filter("cells", lambda _, v: v.isNotNull() & (v != ""))
    text = F.array_join(F.transform(F.map_entries(filled), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
    return rows.select(F.col("row_id").alias("id"), F.concat_ws(" | ", "row_heading", text).alias("text"), F.array("row_id", "table_id").alias("provisions"))


def note_chunks(tables: DataFrame) -> DataFrame:
    return tables.select("table_id", F.posexplode("notes").alias("i", "text")).select(F.concat("table_id", F.lit(":note"), F.col("i") + 1).alias("id"), "text", F.array("table_id").alias("provisions"))


def estimate(chunks: DataFrame, cached: DataFrame, key: Column) -> DataFrame:
    """What an embedding run would cost: distinct texts that the cache lacks, and their tokens."""
    keyed = chunks.select(key.alias("key"), token_count(F.col("text")).alias("t")).dropDuplicates(["key"])
    return keyed.join(cached.select("key"), "key", "left_anti").agg(F.count(F.lit(1)).alias("texts"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"))
