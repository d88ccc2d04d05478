"""Connected components of links between whole numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.llm.setup import stored
from voxelloom.operators.blocks import never_broadcast


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node of the component of every node that has a link.

    Large-star and small-star steps in turn: each moves links to smaller nodes by grouped minima and one join, so a
    node with very many links is only a hot join key (split at run time).  Each round is written to the shared folder.
    It ends when a round changes nothing; the number of rounds grows with the logarithm of the longest chain.  Links are
    known to Spark by the size of their compressed files only, so no join may broadcast them.
    """
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    links = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(never_broadcast(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(never_broadcast(least), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = stored(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
        mark = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return roots.unionByName(links.select(F.col("a").alias("node"), F.col("b").alias("root")))
