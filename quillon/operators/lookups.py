"""Read-only lookups over the stored corpus: nodes with their children and rows, subtrees, table rows, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import label_key


def node(ids: DataFrame, provisions: DataFrame, rows: DataFrame) -> DataFrame:
    """Each asked node (id) with its children in document order and its table's rows."""
    children = provisions.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ord", F.col("id").alias("child"), "heading"))).alias("children"))
    own = rows.groupBy(F.col("table_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(label_key(F.col("sl_no")).alias("k"), "row_id", "row_heading"))).alias("rows"))
    return provisions.join(ids.select("id"), "id", "left_semi").join(children, "id", "left").join(own, "id", "left")


def table_rows(rows: DataFrame, table_id: str, sl_no: str | None = None) -> DataFrame:
    """Rows of a table in numeric order of their serial numbers."""
    found = rows.where(F.col("table_id") == table_id)
    found = found.where(F.col("sl_no") == sl_no) if sl_no else found
    return found.orderBy(label_key(F.col("sl_no")), "row_id")


def amendments_under(roots: DataFrame, closure: DataFrame, links: DataFrame, amendments: DataFrame) -> DataFrame:
    """(root, key, ...) of the amendments of a node or anything below it; closure: (pid, ancestor)."""
    below = roots.join(closure, F.col("root") == F.col("ancestor")).select("root", F.col("pid").alias("provision_id"))
    return below.join(links, "provision_id").join(amendments, "key").dropDuplicates(["root", "key", "provision_id"])


def citation(kind: Column, number: Column, schedule: Column) -> Column:
    return F.when(schedule.isNotNull(), number).when(kind.isin("section", "clause"), F.concat(F.lit("section "), number)).otherwise(number)


def short_citation(chunk_id: Column) -> Column:
    """What a chunk's id says of its provision: s2(5) is s. 2(5), sch:XI:A:4 is Sch. XI:A:4; parts of windows lose their suffix."""
    bare = F.regexp_replace(chunk_id, r"[@~].*$", "")
    return F.when(bare.startswith("sch:"), F.concat(F.lit("Sch. "), F.substring(bare, F.lit(5), F.length(bare)))).when(bare.rlike(r"^s\d"), F.concat(F.lit("s. "), F.substring(bare, F.lit(2), F.length(bare)))).otherwise(bare)


def summary(results: DataFrame, keys: list[str]) -> DataFrame:
    """The wanted metrics of each version's results (version, metrics map), in the versions' numeric order."""
    order = F.regexp_extract("version", r"(\d+)", 1).try_cast("int")
    return results.select("version", F.map_filter("metrics", lambda k, _: k.isin(keys)).alias("metrics")).orderBy(order.asc_nulls_last(), "version")
