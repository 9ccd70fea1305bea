"""Connected components by alternating large and small stars, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelis.llm._util import dropped, written


def _state(edges: DataFrame) -> tuple[int, int]:
    got = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return got[0], got[1]


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of long ids, any direction. Returns (id, component): the smallest id of each vertex's
    component, for every vertex of an edge between two different vertices.

    Only minima are gathered for a vertex, never its neighbours; rounds grow with the logarithm of the
    longest chain. Each round is written to the shared folder."""
    now = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = written(now, "edges")
    seen = _state(now)
    while seen[0]:
        # large star: neighbours above a vertex move to its smallest neighbour (or itself)
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: a vertex and its neighbours below move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("a"), "m").unionByName(low.select(F.col("u").alias("a"), "m"))
        small = small.where("a != m").select(F.col("a").alias("u"), F.col("m").alias("v")).distinct()
        after = written(small, "edges")
        state = _state(after)
        dropped(now)
        now = after
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
