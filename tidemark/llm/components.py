"""Connected components by star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import saved


def _towards_least(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over ``edges`` (a, b): neighbours are linked to the least one around.

    Large: for each a, its larger neighbours are linked to the least of a and its neighbours.
    Small: for each a, its smaller neighbours and itself are linked to the least of them.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
    near = both.filter("b > a") if large else both
    linked = near.join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    if not large:
        linked = linked.unionByName(least.select("a", F.col("_m").alias("b")))
    return linked.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, root): the least vertex of its component for each vertex of ``edges`` (a, b) that is not it.

    Each round is stored; the driver sees a count and a checksum. The least values combine before
    their shuffle, and the join leaves a vertex with many neighbours to Spark's skew handling.
    """
    edges = saved(edges.filter("a <> b").distinct(), "edges")
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return edges.select("a", F.col("b").alias("root"))
        seen = mark
        edges = saved(_towards_least(_towards_least(edges, True), False), "edges")
