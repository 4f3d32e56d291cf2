"""Nearest neighbours in the plane by grids of cells: equi-joins on neighbouring cells, then exact distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.scratch import materialize

#: How often the first grid's cells are halved below the radius.
LEVELS = 5


def _cell(c: str, size: float) -> Column:
    return F.floor(F.col(c) / F.lit(size)).cast("long")


def _around(points: DataFrame, size: float) -> DataFrame:
    """Each point once for its own cell and the eight around it: whatever is within `size` of it lies in one of them."""
    steps = F.array(*[F.lit(k).cast("long") for k in (-1, 0, 1)])
    rows = points.withColumns({"cx": _cell("x", size), "cy": _cell("y", size)}).withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
    return rows.withColumns({"cx": F.col("cx") + F.col("_i"), "cy": F.col("cy") + F.col("_j")}).drop("_i", "_j")


def pairs_within(left: DataFrame, right: DataFrame, radius: float, keys: list[str] | None = None) -> DataFrame:
    """(keys, id, other, d2) of all points (keys, id, x, y) of two tables that are at most `radius` apart; d2 is the squared distance."""
    keys = keys or []
    found = _around(left, radius).join(
        right.select(*keys, F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), _cell("x", radius).alias("cx"), _cell("y", radius).alias("cy")), [*keys, "cx", "cy"]
    )
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    return found.withColumn("d2", dx * dx + dy * dy).where(F.col("d2") <= radius * radius).select(*keys, "id", "other", "d2")


def nearest_within(left: DataFrame, right: DataFrame, radius: float, keys: list[str] | None = None, apart: bool = False, levels: int = LEVELS) -> DataFrame:
    """(keys, id, near, d2): for each left point (keys, id, x, y) its nearest right one within `radius`, of equally near ones the smaller id; points without one are left out.

    apart: a point is not its own neighbour (equal ids). Grids begin with small cells and double: a point that finds a neighbour
    no farther than a cell's size is done, since its nine cells hold all that is as near. So in a crowd points meet only their
    surroundings; only those that found nothing go on. Equal places of right points are kept once, by their smallest ids.
    """
    keys = keys or []
    places = right.where("x is not null and y is not null").groupBy(*keys, "x", "y").agg(F.min("id").alias("first"))
    if apart:  # the second smallest id of a place serves the point whose own id is the smallest
        more = right.join(places, [*keys, "x", "y"]).where(F.col("id") != F.col("first")).groupBy(*keys, "x", "y").agg(F.min("id").alias("second"))
        places = places.join(more, [*keys, "x", "y"], "left")
    else:
        places = places.withColumn("second", F.lit(None).cast(dict(right.dtypes)["id"]))
    places = materialize(places.select(*keys, F.col("x").alias("ox"), F.col("y").alias("oy"), "first", "second"), "places")
    todo, out = left.where("x is not null and y is not null").select(*keys, "id", "x", "y"), None
    for level in range(levels, -1, -1):
        size = radius / 2**level
        cells = places.withColumns({"cx": _cell("ox", size), "cy": _cell("oy", size)})
        dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
        met = _around(todo, size).join(cells, [*keys, "cx", "cy"]).withColumn("d2", dx * dx + dy * dy).where(F.col("d2") <= size * size)
        other = F.when(F.col("first") == F.col("id"), F.col("second")).otherwise(F.col("first")) if apart else F.col("first")
        met = met.withColumn("near", other).where("near is not null")
        best = materialize(met.groupBy(*keys, "id", "x", "y").agg(F.min(F.struct("d2", "near")).alias("m")), "nearest")
        done = best.select(*keys, "id", "m.near", "m.d2")
        out = done if out is None else out.unionByName(done)
        if level:
            todo = materialize(todo.join(best.select(*keys, "id"), [*keys, "id"], "left_anti"), "unmet")
    return out
