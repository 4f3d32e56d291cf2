"""Evaluation runs that can be stopped and gone on with: cells of a question and a version, worked on stage by stage.

Every stage of every version has a table of its own in a snapshot; a stage's rows for a portion of the questions are added in one step.
What a table holds isn't computed again: a run that died, or ran out of quota, goes on with the open cells, and
two runs give what one would have given.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.scratch import materialize
from quillon.sources import snapshots

#: A stage takes open cells, with all columns of the stages before, and adds its own.
Stage = Callable[[DataFrame], DataFrame]


class QuotaExhausted(Exception):
    """A stage raises it when its provider grants no more calls today: what is done stays, the rest is open."""


def _table(version: str, stage: str) -> str:
    return f"{version}-{stage}"


def run(spark: SparkSession, root: str, questions: DataFrame, versions: dict[str, dict[str, Stage]], portions: int = 1) -> dict[str, str | None]:
    """Works on the open cells of questions (id, ...) in each version's stages, in order. Returns for each version why it is incomplete, or None.

    Questions go in `portions` by a hash of their ids: that is how often a run commits, and what it loses at most. Of a
    version that runs out of quota the other stages and portions wait for the next run; other versions go on.
    """
    told: dict[str, str | None] = {}
    for version, stages in versions.items():
        told[version] = None
        try:
            for part in range(portions):
                cells = questions.where(F.pmod(F.xxhash64("id"), F.lit(portions)) == part)
                for stage, work in stages.items():
                    cells = _advance(spark, root, _table(version, stage), cells, work)
        except QuotaExhausted as e:
            told[version] = str(e)
    return told


def _advance(spark: SparkSession, root: str, name: str, cells: DataFrame, work: Stage) -> DataFrame:
    """Adds what `name` lacks of these cells, and returns the cells with all that it holds of them."""
    pointer = snapshots.current(spark, root)
    known = snapshots.read(spark, root, name, pointer) if pointer and name in pointer["tables"] else None
    todo = cells if known is None else cells.join(known.select("id"), "id", "left_anti")
    todo = materialize(todo, "open-cells")
    if not todo.isEmpty():
        fresh = work(todo)
        snapshots.load(spark, root, {name: fresh.select("id", *[c for c in fresh.columns if c not in todo.columns])}, append=True)
        known = snapshots.read(spark, root, name)
    return cells if known is None else cells.join(known, "id")


def records(spark: SparkSession, root: str, questions: DataFrame, versions: dict[str, dict[str, Stage]]) -> DataFrame:
    """The cells that have passed all stages, with their version and all columns."""
    pointer = snapshots.current(spark, root) or {"tables": {}}
    parts = []
    for version, stages in versions.items():
        if all(_table(version, s) in pointer["tables"] for s in stages):
            done = reduce(lambda df, s: df.join(snapshots.read(spark, root, _table(version, s), pointer), "id"), stages, questions)  # noqa: B023
            parts.append(done.withColumn("version", F.lit(version)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else questions.where("false").withColumn("version", F.lit(""))


def progress(spark: SparkSession, root: str, questions: DataFrame, versions: dict[str, dict[str, Stage]]) -> DataFrame:
    """(version, stage, done, open): how many cells each stage has, and how many it lacks."""
    pointer = snapshots.current(spark, root) or {"tables": {}, "counts": {}}
    total = questions.select("id").distinct().count()
    rows = [(v, s, pointer["counts"].get(_table(v, s), 0)) for v, stages in versions.items() for s in stages]
    return spark.createDataFrame([(*r, total - r[2]) for r in rows], "version string, stage string, done long, open long")
