"""Graphs of edges (a, b): components, reachability and elementary cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(v, root) for each value in the links (a, b): root is the smallest value of its component.

    Alternating large-star and small-star: every value that is not its component's smallest ends beside
    it, in a number of rounds that grows with the logarithm of the longest path.
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b"), F.col("a")))
    edges = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    before = None
    while True:
        # large star: each neighbour greater than u is linked to the least of u and its neighbours
        near = both(edges)
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small star: u and its smaller neighbours are linked to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a != b").distinct()
        edges = written(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).collect()[0]
        if now == before:
            return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
        before = now


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component: the smallest id that can be reached."""
    found = stars(edges.select("a", "b")).withColumnRenamed("v", "id")
    return nodes.join(found, "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def reachable(edges: DataFrame, start: int = 0) -> DataFrame:
    """id, steps from start: breadth first, a join of the frontier in every step."""
    spark = edges.sparkSession
    near = written(both_ways(edges), "edges")
    frontier = written(spark.range(start, start + 1).select("id", F.lit(0).alias("steps")), "frontier")
    seen, steps = frontier, 0
    while not frontier.isEmpty():
        steps += 1
        # what is reached again can only be in the last two frontiers or the frontier to come, as edges go both ways
        further = near.join(frontier, near["a"] == frontier["id"]).select(F.col("b").alias("id")).distinct()
        before = frontier.select("id") if steps == 1 else frontier.select("id").union(last)
        last = frontier.select("id")
        frontier = written(further.join(before, "id", "left_anti").select("id", F.lit(steps).alias("steps")), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def square_residuals(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """row, column, residual of each elementary square: top + right - bottom - left, of edges (row, column, kind, v).

    kind is `across` (to the cell on the right) or `down`; squares that lack an edge have no row.
    """
    across = edges.where("kind = 'across'").select("row", "column", F.col("v").alias("top"))
    down = edges.where("kind = 'down'").select("row", "column", F.col("v").alias("left"))
    bottom = across.select((F.col("row") - 1).alias("row"), "column", F.col("top").alias("bottom"))
    right = down.select("row", (F.col("column") - 1).alias("column"), F.col("left").alias("right"))
    at = ["row", "column"]
    return cells.select(*at).join(across, at).join(down, at).join(bottom, at).join(right, at).select(*at, (F.col("top") + F.col("right") - F.col("bottom") - F.col("left")).alias("residual"))
