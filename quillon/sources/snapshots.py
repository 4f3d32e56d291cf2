"""Loads of many tables as one: all of them appear at once, or none does.

Each load writes its tables in a folder of its own, and is put in place by one rename: a pointer file that names each table's
folder gets the next number below `pointers`. The largest number holds. A reader resolves it once, and so reads one load
of all tables; a load that dies before its rename has changed nothing; of two loads from one state the second one's rename fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def move(spark: SparkSession, source: str, target: str) -> None:
    """Renames a file in one step; a target that is there is an error."""
    sc = spark.sparkContext
    jvm = sc._jvm
    src, dst = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(src.toUri(), sc._jsc.hadoopConfiguration())
    none = sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context.rename(src, dst, none)


def names(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def numbers(spark: SparkSession, root: str) -> list[int]:
    return [int(n) for n in names(spark, f"{root}/pointers") if n.isdigit()]


def current(spark: SparkSession, root: str) -> dict | None:
    """The pointer that holds: its number, the folder of each table and its count of rows. None before the first load."""
    found = numbers(spark, root)
    return json.loads(read_text(spark, f"{root}/pointers/{max(found):012d}")) if found else None


def publish(spark: SparkSession, root: str, tables: dict[str, list[str]], counts: dict[str, int], after: int) -> int:
    """Puts folders in place as the tables that follow pointer `after` (0: the first). Another load in between is an error."""
    fs, p = _fs(spark, f"{root}/pointers")
    fs.mkdirs(p)
    number = after + 1
    if numbers(spark, root)[-1:] not in ([], [after]):
        raise RuntimeError(f"{root} has moved on since {after}")
    draft = f"{root}/pointers/draft-{uuid.uuid4().hex}"
    write_text(spark, draft, json.dumps({"number": number, "tables": tables, "counts": counts}))
    try:
        move(spark, draft, f"{root}/pointers/{number:012d}")
    except Exception:
        remove(spark, draft)
        raise
    return number


def read(spark: SparkSession, root: str, table: str, pointer: dict | None = None) -> DataFrame:
    """A table of the load that holds, or of one that was resolved before."""
    pointer = pointer or current(spark, root)
    if pointer is None or table not in pointer["tables"]:
        raise FileNotFoundError(f"no table {table} in {root}")
    return spark.read.parquet(*[f"{root}/{f}" for f in pointer["tables"][table]])


def load(spark: SparkSession, root: str, tables: dict[str, DataFrame], append: bool = False) -> dict[str, int]:
    """Replaces the tables named, or adds rows to them, all at once; others stay. Returns the number of rows of each.

    New rows may be read from the tables they replace: nothing is overwritten.
    """
    before = current(spark, root) or {"number": 0, "tables": {}, "counts": {}}
    folder = f"loads/{uuid.uuid4().hex}"
    placed, counts = dict(before["tables"]), dict(before["counts"])
    for name, df in tables.items():
        df.write.parquet(f"{root}/{folder}/{name}")
        old = before["tables"].get(name, []) if append else []
        placed[name] = [*old, f"{folder}/{name}"]
        counts[name] = spark.read.parquet(f"{root}/{folder}/{name}").count() + (before["counts"].get(name, 0) if append else 0)
    publish(spark, root, placed, counts, before["number"])
    return {name: counts[name] for name in tables}


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Removes all but the last `keep` pointers, and the folders of loads that none of these names. No load may be under way."""
    kept = numbers(spark, root)[-keep:]
    named = {f.split("/")[1] for n in kept for folders in json.loads(read_text(spark, f"{root}/pointers/{n:012d}"))["tables"].values() for f in folders}
    for name in names(spark, f"{root}/pointers"):
        if not name.isdigit() or int(name) not in kept:
            remove(spark, f"{root}/pointers/{name}")
    gone = [n for n in names(spark, f"{root}/loads") if n not in named]
    for n in gone:
        remove(spark, f"{root}/loads/{n}")
    return gone
