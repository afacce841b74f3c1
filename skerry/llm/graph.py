"""Groups of items that links hold together, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import checkpoint, tidy


def components(links: DataFrame) -> DataFrame:
    """links(a, b) of longs as (node, root): root is the least node of its component.

    Alternating stars (Kiveris et al. 2014): every node hands its greater neighbours, then its lesser ones, to its least
    neighbour, until each component is a star around its least node. A round is two aggregations and two joins, and ends in a checkpoint;
    only a count and a sum of hashes go to the driver. Null ends and links of a node to itself count for nothing.
    """
    down = lambda df, x, y: df.filter(F.col(x) != F.col(y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()
    stars, before = checkpoint(down(links, "a", "b")), None
    while (now := tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())) != before:
        before = now
        both = stars.unionAll(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")).withColumnRenamed("a", "u")
        large = both.filter("b > a").join(least, F.col("a") == F.col("u")).select("b", "m")
        large = down(large, "b", "m")
        lower = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(lower, F.col("a") == F.col("u")).select("a", "b", "m")
        stars = checkpoint(down(small.select(F.explode(F.array("a", "b")).alias("x"), "m"), "x", "m"))
    tidy(links.sparkSession)
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
