"""Bounded samples of labelled rows, and sums of fixed-size vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(labels: DataFrame, column: str, most: int, id: str = "doc_id") -> tuple[dict, dict[int, int]]:
    """Ids and 0/1 labels of ``most`` rows of each class at most, those of least hash, and how many rows each class has.

    Null ids and labels are left out; of rows that repeat an id the least label counts.
    """
    own = labels.where(F.col(id).isNotNull() & F.col(column).isNotNull()).groupBy(id).agg(F.min(column).cast("int").alias("y"))
    sizes = {r["y"]: r["count"] for r in own.groupBy("y").count().collect()}
    picked = {}
    for y in sorted(sizes):
        for r in own.where(F.col("y") == y).orderBy(F.xxhash64(id), id).limit(most).collect():
            picked[r[id]] = int(y > 0)
    return picked, {int(y > 0): sum(n for k, n in sizes.items() if (k > 0) == (y > 0)) for y in sizes}


def summed(partials: DataFrame, column: str, size: int) -> np.ndarray:
    """The sum of fixed-size long arrays over all rows."""
    out = np.zeros(size)
    for r in partials.select(F.posexplode(column)).groupBy("pos").agg(F.sum("col").alias("s")).collect():
        out[r["pos"]] = r["s"]
    return out
