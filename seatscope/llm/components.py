"""Connected components of an undirected graph given as pairs, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatscope.llm.frames import discard, staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Link the larger neighbours of each node to the smallest of its neighbourhood."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v")))


def _are_stars(edges: DataFrame) -> bool:
    """Whether no node that is linked to a smaller one has a further link."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"))
    ends = ends.unionAll(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    links = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("links"))
    return links.filter("up > 0 AND links > 1").count() == 0


def _forest(edges: DataFrame) -> DataFrame:
    """The edge of each node to the smallest of its neighbours: as many as there are nodes, at most."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    nearest = both.groupBy("u").agg(F.min("v").alias("v"))
    return nearest.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _between(edges: DataFrame, stars: DataFrame) -> DataFrame:
    """One edge between the centres of any two stars that are linked."""
    of_u = stars.select(F.col("u").alias("end_u"), F.col("v").alias("root_u"))
    of_v = stars.select(F.col("u").alias("end_v"), F.col("v").alias("root_v"))
    named = edges.join(of_u, F.col("u") == F.col("end_u"), "left").join(of_v, F.col("v") == F.col("end_v"), "left")
    named = named.select(F.coalesce("root_u", "u").alias("a"), F.coalesce("root_v", "v").alias("b"))
    return named.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _to_stars(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Alternate the two star steps until all components are stars."""
    while not _are_stars(edges):
        last, edges = edges, staged(spark, _small_star(_large_star(edges).distinct()).distinct())
        discard(spark, last)
    return edges


def component_roots(spark: SparkSession, pairs: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, for all nodes but the roots themselves.

    ``pairs`` has two columns of one ordered type; order and repeats do not matter. First a forest of one edge
    a node is made into stars, then those that other edges link, so the rounds carry nodes, not all edges.
    Each round is written to the shared folder, so a lost executor costs a re-read. The rounds needed grow with
    the logarithm of the longest chain; stars need none, so what was found for some pairs is well given back
    together with further pairs.
    """
    a, b = pairs.columns
    edges = pairs.filter(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    )
    edges = staged(spark, edges.distinct())
    if not _are_stars(edges):
        stars = _to_stars(spark, staged(spark, _forest(edges)))
        whole = staged(spark, stars.unionAll(_between(edges, stars)))
        discard(spark, edges, stars)
        edges = _to_stars(spark, whole)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
