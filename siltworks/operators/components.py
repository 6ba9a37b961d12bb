"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.storage import settle


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """(id, root) for every id that occurs in a link; root is the least id of its component.

    Large-star joins every larger neighbour of a node to the least of its neighbourhood, small-star does so for the
    smaller ones; the number of rounds is logarithmic in the longest chain. Each round is two aggregations with map-side
    minimum, its links are written to the shared folder. Self links and nulls are ignored, no links give no rows. Not
    converging within `rounds` raises.
    """
    e = settle(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    if e.isEmpty():
        return e.select(F.col("u").alias("id"), F.col("v").alias("root"))
    for _ in range(rounds):
        both = e.union(e.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e = settle(small)
        # done when every link leads to a root: none that is a larger end is a smaller one too, or has two of them
        ends = e.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        open_ = ends.where("n > 1").select("u").union(ends.select("u").intersect(e.select("v")))
        if open_.isEmpty():
            return e.select(F.col("u").alias("id"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
    raise RuntimeError(f"components did not converge in {rounds} rounds")
