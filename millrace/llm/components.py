"""Connected components of a link table, as stars around their least nodes.

Links (u, v), u > v, are replaced by fewer and lower ones that connect the same
nodes, until each node has one link, to a node that has none:

1. Tasks of about ``CHUNK`` links replace each ``CHUNK`` of them by stars around
   the least nodes. A node of any number of links then has one link from a chunk
   at most.
2. What is left of a node's links is brought together: the lowest is the node's
   own, the others' ends are linked to its end instead.
3. If a node has two links still, or is linked to one that has links, each link
   to a node is replaced by one to that node's own end, so long ways halve. Both
   sides of this join are stored, so that Spark can split a node that very many
   are linked to, and a node has one own link, so no rows are multiplied.

A round writes two tables; links that are stars after the second step take one. Ends after O(log^2) rounds, as in each the
nodes that are linked to only get lower. Links never leave Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import drop, stored

#: Links that a task joins at once, and has where there are fewer.
CHUNK = 1 << 16


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of every node but the least ones."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    linked = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[linked], nodes[root[linked]]


def _joined(links: DataFrame, tasks: int) -> DataFrame:
    """(u, v) of each chunk's stars, by so many tasks at most."""
    most = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def stars() -> pa.RecordBatch:
            u, v = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v"))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(u, v)], ["u", "v"])

        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= most:
                yield stars()
        if held:
            yield stars()

    return links.coalesce(tasks).mapInArrow(run, "u long, v long")


def _are_stars(links: DataFrame) -> bool:
    """Whether each node has one link, to a node that has none."""
    ends = links.select(F.col("u").alias("x"), "v").unionByName(links.select(F.col("v").alias("x"), F.lit(None).cast("long").alias("v")))
    each = ends.groupBy("x").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.max(F.col("v").isNull()).alias("end"))
    return not each.where("low < high OR low IS NOT NULL AND end").agg(F.count(F.lit(1))).first()[0]


def stars(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with a link to another but the least of each component. Nodes are longs; nulls are no nodes."""
    spark = links.sparkSession
    links, spent = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"u > v AND `{a}` IS NOT NULL AND `{b}` IS NOT NULL"), []
    while True:
        tasks = max(1, -(-links.count() // CHUNK))
        met = _joined(links, tasks).groupBy("u").agg(F.collect_set("v").alias("vs")).select("u", "vs", F.array_min("vs").alias("m"))
        rows = F.expr("explode(concat(array(struct(u, m AS v, true AS own)), transform(filter(vs, x -> x > m), x -> struct(x AS u, m AS v, false AS own))))")
        low = stored(met.select(rows.alias("s")).select("s.*"), "links")
        drop(spark, *spent)
        if tasks == 1 or _are_stars(low):  # one chunk's stars are whole
            found = low.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return found if tasks == 1 else found.distinct()
        own = low.where("own").select(F.col("u").alias("x"), F.col("v").alias("y"))
        links = stored(low.join(own, F.col("v") == F.col("x"), "left").select("u", F.coalesce("y", "v").alias("v")), "jumped")
        drop(spark, low)
        spent = [links]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with a link to another; the component is its least node. Nulls are no nodes."""
    found = stars(links, a, b)
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
