"""Files: JSON lines, versioned build folders with manifests, text archives, append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources import snapshots


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines in a declared schema; a missing file is an empty table."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def source_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 over the digests of the source's files, in the order of their paths."""
    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("d"))
    return files.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "d"))), lambda x: x["d"]), ""), 256)).first()[0]


def build_once(spark: SparkSession, root: str, digest: str, tables: dict[str, DataFrame], force: bool = False) -> str:
    """Writes the tables to a folder named by the source's digest, and its manifest last; a folder with a manifest is done."""
    out = f"{root}/{digest[:16]}"
    if force or not exists(spark, f"{out}/manifest"):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{out}/{name}")
        rows = [(name, spark.read.parquet(f"{out}/{name}").count()) for name in tables]
        spark.createDataFrame(rows, "name string, n long").coalesce(1).write.mode("overwrite").json(f"{out}/manifest")
    return out


def clean_pages(lines: DataFrame, note_lines: DataFrame) -> DataFrame:
    """(doc_id, page, text): the lines of each page without those of endnotes, in stream order."""
    kept = lines.join(note_lines, ["doc_id", "line_index"], "left_anti")
    return kept.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_index", "text"))), lambda x: x["text"]), "\n").alias("text"))


def replace_version(df: DataFrame, path: str) -> None:
    """Replaces the versions that df holds, and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def append_log(before: DataFrame, after: DataFrame, key: str, path: str) -> None:
    """Appends one row per changed column and key to a CSV log."""
    names = [c for c in before.columns if c != key]
    cells = lambda df: df.select(key, F.explode(F.create_map(*[x for c in names for x in (F.lit(c), F.col(c).cast("string"))])).alias("field", "value"))
    old, new = cells(before).withColumnRenamed("value", "old"), cells(after).withColumnRenamed("value", "new")
    changed = old.join(new, [key, "field"], "full").where(~F.col("old").eqNullSafe(F.col("new")))
    changed.write.mode("append").option("header", True).csv(path)


#: Where the print keeps its running head and foot: font, bounds of height, and of size (fixed values).
HEAD = {"font": "NotoSans", "below": 40.0, "size": 8.9}
FOOT = {"font": "NotoSans-Italic", "from": 800.0, "size": 7.5}
#: Size of the small raised labels that mark amended words (fixed value).
MARKER_SIZE = 7.1
#: Blanks and hyphens of the print, each read as the plain one (fixed values).
BLANKS, HYPHENS = "\u00a0\u2002\u2003\u2009\u202f", "\u2010\u2011"


def is_running_line(span: Column) -> Column:
    """A span of the running head or foot: only of its font and size, and only at its place."""
    head = span["font"].startswith(HEAD["font"]) & (span["bbox"][3] <= HEAD["below"]) & (span["size"] >= HEAD["size"])
    return head | (span["font"].startswith(FOOT["font"]) & (span["bbox"][1] >= FOOT["from"]) & (F.round(span["size"], 1) == FOOT["size"]))


def is_marker(span: Column) -> Column:
    return F.round(span["size"], 1) == MARKER_SIZE


def normal_span(text: Column) -> Column:
    return F.translate(text, BLANKS + HYPHENS, " " * len(BLANKS) + "-" * len(HYPHENS))


def bold(span: Column) -> Column:
    return F.contains(span["font"], F.lit("Bold"))


def italic(span: Column) -> Column:
    return F.contains(span["font"], F.lit("Italic"))


def _line_spans(raw: DataFrame) -> DataFrame:
    rows = raw.select("doc_id", "page", F.posexplode("blocks").alias("b", "block")).select("doc_id", "page", "b", F.posexplode("block.lines").alias("l", "line"))
    return rows.select("doc_id", "page", "b", "l", F.filter("line.spans", lambda s: ~is_running_line(s)).alias("spans"))


def text_lines(raw: DataFrame) -> DataFrame:
    """Lines (doc_id, page, b, l, bbox, text, size, all_bold, all_italic, x0, y0, first) of page layouts (doc_id, page, blocks: nested spans).

    Running heads and feet, and the labels of amended words, go; a box is the union of its spans' boxes; first is the first span that isn't blank.
    """
    rows = _line_spans(raw).withColumn("spans", F.filter("spans", lambda s: ~is_marker(s))).where(F.size("spans") > 0)
    edge = lambda i, f: f(F.transform("spans", lambda s: s["bbox"][i]))
    text = normal_span(F.array_join(F.transform("spans", lambda s: s["text"]), ""))
    inked = F.filter("spans", lambda s: F.trim(s["text"]) != "")
    out = rows.select("doc_id", "page", "b", "l", F.array(edge(0, F.array_min), edge(1, F.array_min), edge(2, F.array_max), edge(3, F.array_max)).alias("bbox"), text.alias("text"), F.array_max(F.transform("spans", lambda s: s["size"])).alias("size"), F.forall(inked, bold).alias("all_bold"), F.forall(inked, italic).alias("all_italic"), F.try_element_at(inked, F.lit(1)).alias("first"))
    return out.withColumn("x0", F.col("bbox")[0]).withColumn("y0", F.col("bbox")[1])


def markers(raw: DataFrame) -> DataFrame:
    """(doc_id, page, label, bbox): the small labels of amended words, apart from the lines they stand in."""
    spans = _line_spans(raw).select("doc_id", "page", F.explode("spans").alias("s")).where(is_marker(F.col("s")))
    return spans.select("doc_id", "page", F.trim("s.text").alias("label"), "s.bbox").where("label <> ''")


# ---------------------------------------------------------------------- loads and results


def reload(tables: dict[str, DataFrame], root: str) -> dict[str, int]:
    """Replaces every table of a snapshot by the given rows, all at once, and returns their numbers. Read them with `snapshots.read`."""
    return snapshots.load(next(iter(tables.values())).sparkSession, root, tables) if tables else {}


def bulk_insert(df: DataFrame, path: str) -> None:
    """Appends rows, their columns in the table's order."""
    spark = df.sparkSession
    have = spark.read.parquet(path).columns if exists(spark, path) else df.columns
    df.select(*have).write.mode("append").parquet(path)


def load_corpus(provisions: DataFrame, tables: DataFrame, rows: DataFrame, amendments: DataFrame, refs: DataFrame, root: str) -> dict[str, int]:
    """Reloads the corpus: provisions in document order (ord), marked text of amended ones only, and the links of amendments, each once."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_start", "ord")) - 1 if "doc_id" in provisions.columns else F.col("ord")
    nodes = provisions.withColumn("ord", place).withColumn("text_marked", F.when(F.col("is_amended"), F.col("text_marked")))
    links = amendments.select("key", F.explode(F.array_distinct("linked_nodes")).alias("provision_id"))
    return reload({"provisions": nodes, "tables": tables, "table_rows": rows, "amendments": amendments.drop("linked_nodes"), "amendment_links": links, "cross_refs": refs}, root)


def build_index(chunks: DataFrame, version: str, embed, estimate: DataFrame, path: str, confirm_above: int, sure: bool = False, dry_run: bool = False) -> dict[str, int]:
    """Embeds a version's chunks and stores them in place of its earlier ones; returns the estimate, and the number stored.

    estimate: one row (texts, tokens) of what the cache lacks. More than `confirm_above` tokens ask for sure=True.
    """
    cost = estimate.first()
    out = {"to_embed": cost["texts"], "est_tokens": cost["tokens"]}
    if dry_run:
        return out
    if cost["tokens"] > confirm_above and not sure:
        raise ValueError(f"{version}: {cost['tokens']} tokens to embed, above {confirm_above}: confirm with sure=True")
    replace_version(embed(chunks).withColumn("version", F.lit(version)), path)
    return out | {"stored": chunks.sparkSession.read.parquet(path).where(F.col("version") == version).count()}


def write_results(records: DataFrame, metrics: DataFrame, run: dict[str, str], path: str) -> None:
    """The records of an evaluation run, its metrics (type, metric, value) and its facts, as JSON lines in three folders."""
    records.write.mode("overwrite").json(f"{path}/outputs")
    metrics.coalesce(1).write.mode("overwrite").json(f"{path}/metrics")
    records.sparkSession.createDataFrame(list(run.items()), "name string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/run")


def report(versions: DataFrame, metrics: list[str]) -> DataFrame:
    """(ord, line): a Markdown table of results (version, metric, value), one line per version in their numeric order."""
    wide = versions.groupBy("version").pivot("metric", metrics).agg(F.first("value"))
    cells = [F.coalesce(F.format_number(m, 4), F.lit("-")) for m in metrics]
    number = F.regexp_extract("version", r"(\d+)", 1).try_cast("int")
    body = wide.select(F.coalesce(number, F.lit(1 << 30)).alias("ord"), F.concat(F.lit("| "), F.concat_ws(" | ", F.col("version"), *cells), F.lit(" |")).alias("line"))
    head = [(-2, f"| version | {' | '.join(metrics)} |"), (-1, "|---" * (len(metrics) + 1) + "|")]
    return versions.sparkSession.createDataFrame(head, "ord int, line string").unionByName(body)


# ---------------------------------------------------------------------- configuration


def expanded(value, env: dict[str, str]):
    """${NAME} and ${NAME:default} in all strings of a configuration; a string that is nothing else takes the type of what it stands for."""
    import re

    import yaml

    if isinstance(value, dict):
        return {k: expanded(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [expanded(v, env) for v in value]
    if not isinstance(value, str):
        return value
    fill = lambda m: env.get(m[1], m[2] or "")
    text = re.sub(r"\$\{([A-Z0-9_]+)(?::([^}]*))?\}", fill, value)
    alone = re.fullmatch(r"\$\{[A-Z0-9_]+(?::[^}]*)?\}", value)
    return yaml.safe_load(text) if alone and text else text


def load_config(path: str, env: dict[str, str]) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return expanded(yaml.safe_load(f) or {}, env)
