"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is a grouped minimum (partial aggregation) and a join; the table is written to the shared folder after each
round, so lineage stays short. Rounds grow with the logarithm of the longest chain. Nothing is collected but a count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialise


def _step(links: DataFrame, large: bool) -> DataFrame:
    """Large: hang each node's larger neighbours on its smallest one. Small: the same for the node and its smaller ones."""
    if large:
        near = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    near = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    hung = near.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """links (u, v) of comparable ids -> (u, v): each node but the smallest of its component, with the smallest."""
    now = materialise(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    state = lambda t: tuple(t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before, after = None, state(now)
    while after[0] and after != before:
        last, now = now, materialise(_step(_step(now, True), False), label)
        before, after = after, state(now)
        forget(last)
    return now
