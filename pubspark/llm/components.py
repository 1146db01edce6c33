"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

MOST = 60  # rounds; stars need about log(longest path), so this is never met


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """node and component (its smallest node) of each node of the edges (a, b).

    Large stars link each node's larger neighbours to its smallest neighbour,
    small stars do so with the smaller ones and itself. Hot nodes are no
    trouble: the least neighbour is a partial aggregate and the rest a join.
    Each round's edges are written to the shared folder, in files as their number asks for (``rows``, if about that is known).
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), rows)
    n = e.count()
    for _ in range(MOST):
        large = _star(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))), keep_larger=True)
        small = written(_star(large, keep_larger=False), n)
        same = small.join(e, ["a", "b"], "left_anti").isEmpty() and e.join(small, ["a", "b"], "left_anti").isEmpty()
        e = small
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def _star(e: DataFrame, keep_larger: bool) -> DataFrame:
    """Edges (a > b) from each node's neighbours to the least of them and itself."""
    least = e.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    out = e.join(least, "a")
    if keep_larger:
        rows = out.where("b > a").select(F.col("b").alias("x"), "m")
    else:
        rows = out.select(F.col("b").alias("x"), "m").unionByName(least.select(F.col("a").alias("x"), "m"))
    return rows.where("x <> m").select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b")).distinct()
