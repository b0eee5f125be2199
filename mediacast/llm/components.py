"""Connected components of a distributed list of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacast.session import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them. Edges run from larger to smaller here."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the links ``(u, v)``; the component is its smallest node.

    Links with a null end are ignored; loops and repeats change nothing. Every contraction is a written table, so
    a lost executor costs one step. The number of steps grows with the logarithm of the longest chain, and only the
    number of links and a checksum come to the driver.
    """
    clean = edges.where("u is not null and v is not null")
    loops = clean.where("u = v").select(F.col("u").alias("node"))
    links = clean.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links, before = stage(links, "links"), None
    while (now := _state(links)) != before:
        before = now
        links = stage(_small_star(_large_star(links)), "links")
    members = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("node")).unionByName(loops).distinct()
    alone = roots.join(members, "node", "left_anti").select("node", F.col("node").alias("component"))
    return members.unionByName(alone)
