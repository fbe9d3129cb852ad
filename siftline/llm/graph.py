"""Connected components of a table of links, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import forget, materialize


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """links (a, b) of whole numbers to (node, root): root is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until all links are stars: no node has two links up, and none
    that has one is a root. The number of rounds grows with the logarithm of the longest path. Each round's links are written to the shared
    folder. Links to oneself and repeated links are ignored; nodes without links do not appear.
    """
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = materialize(links, name)
    while not _stars(links):
        # large-star: all larger neighbours of u are hung on the smallest of u and its neighbours
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # (stored, so that the join shuffles for itself and can split a node with very many neighbours)
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), name)
        large = both.filter("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, name)
        # small-star: u and its smaller neighbours are hung on the smallest of them
        lower = materialize(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.join(lower.hint("merge"), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        done = materialize(small.unionAll(lower.select("u", F.col("m").alias("v"))).distinct(), name)
        forget(links, least, large, lower)
        links = done
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _stars(links: DataFrame) -> bool:
    """Whether each node of links (u, v), u > v, is either a root or has one link, to a root."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionAll(links.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root")).filter("up > 1 OR up = 1 AND root = 1").isEmpty()
