"""Table functions for SQL: rows in, any number of rows out."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class Windows:
    """Token windows of a text: (start, n_tokens) every size - overlap tokens, up to where only the overlap would be new."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
        n = len((text or "").split())
        for start in range(0, max(n - overlap, 1), size - overlap):
            if n:
                yield start, min(size, n - start)


def register(spark: SparkSession) -> None:
    spark.udtf.register("quillon_windows", udtf(Windows, returnType="start int, n_tokens int"))
