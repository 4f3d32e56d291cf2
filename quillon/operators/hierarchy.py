"""Trees as adjacency lists and as closure tables: ancestors, subtrees, roll-ups, nearest enclosing nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.labels import roman_value
from quillon.functions.text import ancestors, token_count
from quillon.scratch import materialize


def id_closure(ids: DataFrame, col: str = "pid") -> DataFrame:
    """(pid, ancestor, depth) from path-encoded ids alone: each id with itself (depth 0) and all that enclose it."""
    return ids.select(F.col(col).alias("pid"), F.posexplode(ancestors(F.col(col))).alias("depth", "ancestor")).select("pid", "ancestor", "depth")


def closure(nodes: DataFrame) -> DataFrame:
    """(id, ancestor, depth) of an adjacency list (id, parent), of any depth: paths double their length in each step.

    Each step joins only the paths of full length with all paths known, and writes what is new to the shared
    folder, so that plans stay small. A cycle raises.
    """
    known = nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth"))
    edges = nodes.where("parent is not null").select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    reach = newest = materialize(edges, "closure")
    span = 1
    while True:
        step = reach.select(F.col("id").alias("mid"), F.col("ancestor").alias("top"), F.col("depth").alias("more"))
        full = newest.where(F.col("depth") == span)
        longer = full.join(step, F.col("ancestor") == F.col("mid")).select("id", F.col("top").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        newest = materialize(longer, "closure")
        if newest.isEmpty():
            return known.unionByName(reach)
        if not newest.where("id = ancestor").isEmpty():
            raise ValueError("the nodes' parents form a cycle")
        reach = reach.unionByName(newest)
        span *= 2


def subtree(tree: DataFrame, roots: DataFrame | None, nodes: DataFrame | None, limit: int | None = None) -> DataFrame:
    """Nodes below and at each root (root), in document order (ord), with their depth; tree: (id, ancestor, depth).

    Without roots every ancestor of the tree is one; without nodes the tree has its nodes' ord. Neither needs a join then.
    """
    found = tree.withColumn("root", F.col("ancestor")) if roots is None else roots.join(tree, F.col("ancestor") == F.col("root"))
    found = (found if nodes is None else found.join(nodes, "id")).select("root", "id", "ord", "depth")
    if limit:
        found = found.withColumn("_n", F.row_number().over(Window.partitionBy("root").orderBy("ord"))).where(F.col("_n") <= limit).drop("_n")
    return found


def subtree_text(tree: DataFrame, nodes: DataFrame, separator: str = "\n", only: DataFrame | None = None) -> DataFrame:
    """(id, text): a node's own text and that of all below it, in document order; of all nodes, or of those in `only` (id).

    A text is copied to every asked node above it: ask for chunks, not for all that encloses them.
    """
    if only is not None:
        tree = tree.join(only.select(F.col("id").alias("ancestor")), "ancestor", "left_semi")
    rows = tree.join(nodes.select("id", "ord", "text"), "id").where("text is not null")
    parts = rows.groupBy("ancestor").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("parts"))
    return parts.select(F.col("ancestor").alias("id"), F.array_join(F.transform("parts", lambda p: p["text"]), separator).alias("text"))


def subtree_tokens(tree: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, all_tokens): how many tokens a node's text and all below it have: counts are added up, no text is moved.

    Without nodes, rows of the tree have their node's number of tokens n.
    """
    if nodes is None:
        return tree.groupBy(F.col("ancestor").alias("id")).agg(F.sum("n").alias("all_tokens"))
    counts = nodes.where("text is not null").select("id", token_count(F.col("text")).alias("n"))
    return tree.join(counts, "id").groupBy(F.col("ancestor").alias("id")).agg(F.sum("n").alias("all_tokens"))


def rollup(tree: DataFrame, values: DataFrame, *aggs) -> DataFrame:
    """Aggregates values (id, ...) of each node's subtree."""
    return tree.join(values, "id").groupBy("ancestor").agg(*aggs)


def enclosing(tree: DataFrame, nodes: DataFrame, kinds: list[str]) -> DataFrame:
    """(id, enclosing): the nearest node at or above of one of the kinds."""
    up = tree.join(nodes.where(F.col("kind").isin(kinds)).select(F.col("id").alias("ancestor")), "ancestor")
    return up.groupBy("id").agg(F.min_by("ancestor", "depth").alias("enclosing"))


def page_span(tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """First and last page of each node's subtree."""
    return tree.join(nodes.select("id", "page_start", "page_end"), "id").groupBy("ancestor").agg(F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"))


def suffix_duplicates(rows: DataFrame, col: str, order: str) -> DataFrame:
    """Repeated ids get ~2, ~3 in their order."""
    n = F.row_number().over(Window.partitionBy(col).orderBy(order))
    return rows.withColumn("_n", n).withColumn(col, F.when(F.col("_n") > 1, F.concat(F.col(col), F.lit("~"), F.col("_n").cast("string"))).otherwise(F.col(col))).drop("_n")


def breadcrumb(tree: DataFrame, nodes: DataFrame, separator: str = " · ") -> DataFrame:
    """(id, breadcrumb): names of what encloses a node, from the top, the node itself last."""
    named = tree.join(nodes.select(F.col("id").alias("ancestor"), "name"), "ancestor")
    parts = named.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("depth", "name")), asc=False).alias("parts"))
    return parts.select("id", F.array_join(F.transform("parts", lambda p: p["name"]), separator).alias("breadcrumb"))


def subtree_depth(pid):
    """How many brackets and segments an id has."""
    return F.length(F.regexp_replace(pid, "[^(:]", ""))


# ---------------------------------------------------------------------- moving subtrees


def moved(tree: DataFrame, moves: DataFrame) -> DataFrame:
    """The closure (id, ancestor, depth) after subtrees move: moves has (id, parent), each root with its new parent (null: none).

    Moves hold together, also where one root lies below another or goes below one. The tree is cut above every root; paths within a
    piece stay as they are, and only paths across a cut are made anew: from a node up to its piece's root, over the new edge to
    the parent, up within the parent's piece, and so on. A move below itself raises.
    """
    roots = materialize(moves.select("id", "parent"), "moves")
    cut = roots.select(F.col("id").alias("ancestor"))
    # a node's piece is named by the nearest root at or above it; null is what no cut lies above
    at = tree.join(cut, "ancestor").groupBy("id").agg(F.min(F.struct("depth", "ancestor")).alias("m")).select("id", F.col("m.ancestor").alias("piece"), F.col("m.depth").alias("down"))
    at = materialize(at, "pieces")
    piece = lambda df, c, to: df.join(at.select(F.col("id").alias(c), F.col("piece").alias(to)), c, "left")
    both = piece(piece(tree, "id", "_p"), "ancestor", "_q")
    inside = materialize(both.where(F.col("_p").eqNullSafe(F.col("_q"))).select("id", "ancestor", "depth"), "inside")
    # each root's edge up: into which piece it leads, and how far below that piece's root it ends
    up = roots.where("parent is not null").join(at.select(F.col("id").alias("parent"), F.col("piece").alias("over"), F.col("down").alias("deep")), "parent", "left")
    up = materialize(up, "new-edges")
    chain = closure(up.select("id", F.col("over").alias("parent")).unionByName(roots.where("parent is null").select("id", F.lit(None).cast(dict(tree.dtypes)["id"]).alias("parent"))))
    # along a chain of roots: the steps from its first root to the place where its k-th root's new edge ends
    ends = chain.select(F.col("id").alias("root"), F.col("ancestor").alias("id"), F.col("depth").alias("hop")).join(up, "id")
    w = Window.partitionBy("root").orderBy("hop").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("steps", F.lit(1) + F.coalesce(F.sum(F.col("deep") + 1).over(w), F.lit(0))).select("root", F.col("parent").alias("mid"), "steps")
    below = at.select("id", F.col("piece").alias("root"), "down")
    across = below.join(ends, "root").join(inside.select(F.col("id").alias("mid"), "ancestor", F.col("depth").alias("more")), "mid")
    return inside.unionByName(across.select("id", "ancestor", (F.col("down") + F.col("steps") + F.col("more")).cast("int").alias("depth")))


def renamed(tree: DataFrame, moves: DataFrame, label: Column, separator: str = "") -> DataFrame:
    """(id, new_id) of every node at or below a moved root, where ids are paths: the names of all that encloses a node after the move, from the top, joined.

    label: a node's own part of its id, of column id.
    """
    after = moved(tree, moves)
    touched = tree.join(moves.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("id").distinct()
    parts = after.join(touched, "id").select("id", "depth", F.col("ancestor").alias("node"))
    own = tree.select("id").distinct().select(F.col("id").alias("node"), label.alias("name"))
    path = parts.join(own, "node").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("depth", "name")), asc=False).alias("p"))
    return path.select("id", F.array_join(F.transform("p", lambda x: x["name"]), separator).alias("new_id"))


def misread_numerals(nodes: DataFrame) -> DataFrame:
    """(id, parent) of the moves that right a list of numerals (i), (ii), ... read as siblings after the clause (h): all of them belong below it.

    nodes: (id, parent, number, ord). Where (ii) follows, (i) was no letter; the run ends where the numerals do.
    """
    w = Window.partitionBy("parent").orderBy("ord")
    bare = F.lower(F.regexp_replace("number", "[()]", ""))
    rows = nodes.select("id", "parent", "ord", bare.alias("n")).withColumns({"before": F.lag("n").over(w), "after": F.lead("n").over(w), "letter": F.lag("id").over(w)})
    starts = (F.col("n") == "i") & (F.col("before") == "h") & (F.col("after") == "ii")
    value = roman_value(F.col("n"))
    rows = rows.withColumns({"starts": starts, "value": value})
    rows = rows.withColumn("run", F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("run > 0")
    in_run = Window.partitionBy("parent", "run").orderBy("ord")
    rows = rows.withColumn("goes_on", F.col("value") == F.row_number().over(in_run)).withColumn("under", F.first("letter").over(in_run))
    broken = F.max((~F.coalesce("goes_on", F.lit(False))).cast("int")).over(in_run.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_b", broken).where("_b = 0").select("id", F.col("under").alias("parent"))
