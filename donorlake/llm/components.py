"""Connected components of a table of links, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from donorlake.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``a, b`` (BIGINT); a component is named by its smallest node.

    Each round ties all larger neighbours of a node to the smallest node next to it, then all smaller ones; a table of
    links never grows, and the number of rounds is about the logarithm of a component's diameter. Rounds are written
    to the shared folder, so a lost executor costs one round. Sums of the rows tell when nothing changes any more.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).filter("high <> low").distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("low").alias("high"), F.col("high").alias("low"))).toDF("node", "other")
        least = both.groupBy("node").agg(F.least("node", F.min("other")).alias("least"))
        large = both.filter("other > node").join(least, "node").select(F.col("other").alias("high"), F.col("least").alias("low"))
        large = large.filter("high <> low").distinct()
        least = large.groupBy("high").agg(F.min("low").alias("least"))
        small = large.join(least, "high")
        small = small.select("high", F.col("least").alias("low")).union(small.filter("low <> least").select("low", "least"))
        edges = cut(small.distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return edges.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(roots)
