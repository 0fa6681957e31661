"""Connected components of a table of links, by alternating large-star and small-star steps.

A step is a grouped minimum and a join. Lineage is cut after each round by checkpoint() into the shared folder, so a lost
executor costs no earlier round. Rounds grow with the logarithm of the longest chain; a count and a sum reach the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session, whose tasks are this machine's, has a default."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (shared or "file:///tmp/checkpoints").rstrip("/")


def with_checkpoints(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def _hang(near: DataFrame) -> DataFrame:
    """Each node's neighbours (node, other), hung on the least of them and itself."""
    least = near.groupBy("node").agg(F.min("other").alias("root")).withColumn("root", F.least("node", "root"))
    return near.join(least, "node")


def components(links: DataFrame) -> DataFrame:
    """links (node, other) of comparable ids, nulls apart -> (node, root): every linked node with the least of its component."""
    with_checkpoints(links.sparkSession)
    known = links.where(F.col("node").isNotNull() & F.col("other").isNotNull()).select("node", "other")
    both = lambda df: df.unionByName(df.select(F.col("other").alias("node"), F.col("node").alias("other")))
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "other").cast("decimal(38,0)"))).first())
    now = known.where("node <> other").select(F.greatest("node", "other").alias("node"), F.least("node", "other").alias("other")).distinct().checkpoint()
    before, after = None, state(now)
    while after != before:
        # the larger neighbours of a node move to its least one, then the smaller ones do
        large = _hang(both(now)).where("other > node").select(F.col("other").alias("node"), F.col("root").alias("other")).where("node <> other").distinct()
        small = _hang(large)
        moved = small.where("other <> root").select(F.col("other").alias("node"), F.col("root").alias("other"))
        now = moved.unionByName(small.select("node", F.col("root").alias("other"))).distinct().checkpoint()
        before, after = after, state(now)
    roots = now.select(F.col("other").alias("node")).distinct()
    return now.select("node", F.col("other").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
