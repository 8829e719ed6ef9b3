"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is a few shuffles over the remaining links, each round's links are written to the shared folder, and the
number of rounds grows with the logarithm of the graph. Nothing but one count and one checksum a round reaches the
driver. Node ids may be of any type that can be ordered.

The smallest neighbours are counted up before the shuffle and written out, so what meets links in a join is a table of
one row a node: where very many links share a node, adaptive execution splits them, or sends the table whole if it is
small by its measured size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korbwerk.llm.common import Scratch


def _with_least(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """`links` with m, the smallest v that their u is linked to."""
    least = scratch.keep(links.groupBy("u").agg(F.min("v").alias("m")), name)
    return links.join(least, "u")


def _large_star(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    found = _with_least(both, scratch, name).where(F.col("v") > F.col("u"))
    return found.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where(F.col("u") != F.col("v")).distinct()


def _small_star(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Links are (larger, smaller)."""
    found = _with_least(links, scratch, name)
    moved = F.when(F.col("v") != F.col("m"), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
    own = F.struct("u", F.col("m").alias("v"))
    return found.select(F.explode(F.array_compact(F.array(own, moved))).alias("l")).select("l.u", "l.v").distinct()


def components(links: DataFrame, scratch: Scratch, name: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `links` (u, v); the component is its smallest node. Links to oneself count as none; with no links the result is empty."""
    links = scratch.keep(links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    before = None
    for i in range(1, max_rounds + 1):
        large = scratch.keep(_large_star(links, scratch, f"{name}-most-{i}"), f"{name}-large-{i}")
        links = scratch.keep(_small_star(large, scratch, f"{name}-least-{i}"), f"{name}-{i}")
        for done in (f"{name}-{i - 1}", f"{name}-most-{i}", f"{name}-large-{i}", f"{name}-least-{i}"):
            scratch.drop(done)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 2147483647)).first()
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError(f"links did not settle in {max_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
