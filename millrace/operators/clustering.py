"""Clusters of columns that determine each other.

For every value of a determining column the distinct and non-null counts of
the others are summed: one unpivot and two aggregates. The sums, at most the
number of columns squared, are merged on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def correlation(df: DataFrame, columns1: list[str], columns2: list[str], least2: int = 0, least1: int = 0) -> DataFrame:
    """(column1, column2, distinct1, distinct2, observations): summed over the values of column1 with more than ``least2`` values of column2; pairs under ``least1`` observations are left out."""
    first = F.explode(F.array(*(F.struct(F.lit(c).alias("column1"), F.col(c).cast("string").alias("v1")) for c in columns1)))
    second = F.explode(F.array(*(F.struct(F.lit(c).alias("column2"), F.col(c).cast("string").alias("v2")) for c in columns2)))
    long = df.select("*", first.alias("a")).where("a.v1 IS NOT NULL").select("a.*", second.alias("b")).select("column1", "v1", "b.*").where("column1 <> column2")
    counts = long.groupBy("column1", "v1", "column2").agg(F.count_distinct("v2").alias("d"), F.count("v2").alias("n")).where(F.col("n") > least2)
    sums = counts.groupBy("column1", "column2").agg(F.count(F.lit(1)).alias("distinct1"), F.sum("d").alias("distinct2"), F.sum("n").alias("observations"))
    return sums.where(F.col("observations") >= least1)


def merge_edges(edges: list[tuple[str, str, int, int]], transitive: set[str], tagged: set[str] = frozenset()) -> list[list[str]]:
    """The clusters, each a list of its columns. Edges (column1, column2, distinct2, observations) are taken from the strongest.

    Column 2 joins the cluster of column 1. If it is transitive and has a
    cluster of its own, the two become one, unless that would use up the last
    cluster without a tagged column; then the structure is complete. The first
    tenth of the edges always merge. A column that isn't transitive can be in
    several clusters.
    """
    clusters: list[list[str]] = []
    home = lambda c: next((m for m in clusters if c in m), None)
    plain = lambda m: tagged.isdisjoint(m)
    strongest = sorted(edges, key=lambda e: (e[2] / e[3] if e[3] else 1.0, e[0], e[1]))
    for k, (a, b, _, _) in enumerate(strongest):
        own = home(a) or [a]
        clusters = [m for m in clusters if m is not own]
        other = home(b) if b in transitive else None
        if other is None:
            own += [b] if b not in own else []
        else:
            spare = plain(own) == plain(other) or any(plain(m) for m in clusters if m is not other)
            if 10 * k >= len(strongest) and not spare:
                return [*clusters, own]
            own += [c for c in other if c not in own]
            clusters = [m for m in clusters if m is not other]
        clusters.append(own)
    return clusters


def clustering(df: DataFrame, classification: dict[str, str], determining: set[str], transitive: set[str], tags: tuple[str, ...] = (), solo: tuple[str, ...] = (), least2: int = 0, least1: int = 0, most_ratio: float = 1.0) -> DataFrame:
    """(cluster_id, column_name, status, data_subclassification) of every column in a cluster.

    ``determining``, ``transitive``, ``tags`` and ``solo`` are classifications:
    of columns that may determine others, through which clusters join, that
    name a cluster, and that name a cluster of one column. ``most_ratio`` of
    distinct values to observations still counts as determined.
    """
    columns = sorted(classification)
    found = correlation(df, [c for c in columns if classification[c] in determining], columns, least2, least1)
    edges = [(r["column1"], r["column2"], r["distinct2"], r["observations"]) for r in found.collect() if r["distinct2"] <= most_ratio * r["observations"]]
    clusters = merge_edges(edges, {c for c in columns if classification[c] in transitive}, {c for c in columns if classification[c] in tags})
    status = "valid" if any(len(m) > 1 for m in clusters) else "invalid"
    rows = []
    for k, members in enumerate(clusters):
        named = [classification[c] for c in sorted(members) if classification[c] in (solo if len(members) == 1 else tags)]
        sub = named[0] if named and status == "valid" else ("__SOLO__" if len(members) == 1 else "")
        rows += [(f"cluster{k}", c, status, sub) for c in members]
    return df.sparkSession.createDataFrame(rows, "cluster_id string, column_name string, status string, data_subclassification string")
