"""Pairs within groups of any size, without collecting a group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_groups(df: DataFrame, keys: list[str], member: str, block: int = 64, weight: str | None = None) -> DataFrame:
    """Splits every group of two or more members into blocks of about `block` and pairs the blocks.

    Input: distinct (keys..., member). Output: the input's columns, `own` (the row's block) and `bi <= bj`: the rows of one (keys,
    bi, bj) are about 2*block, and any two members of a group meet in (bi, bj), the blocks they are in. Groups are counted
    with map-side sums and joined with their counts, blocks are chosen by a hash of the member: no step orders or holds a
    group in one task, and a hot key's rows are split by the adaptive join. Groups up to `block` cost one copy of each row, one
    of n members n*n/block rows over as many tasks as there are block pairs. Rows with a null member or key are dropped.
    With `weight`, a column, `block` is the sum of weights in a block instead of the number of members.
    """
    some = df.where(F.col(member).isNotNull())
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = some.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), size.alias("_s")).where("_n > 1").drop("_n")
    numbered = some.join(counts, keys).withColumn("_m", F.greatest(F.lit(1), F.ceil(F.col("_s") / F.lit(block))).cast("int"))
    numbered = numbered.withColumn("own", F.pmod(F.xxhash64(member), F.col("_m")).cast("int"))
    return (
        numbered.select("*", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias("_o"))
        .withColumn("bi", F.least("own", "_o"))
        .withColumn("bj", F.greatest("own", "_o"))
        .drop("_s", "_m", "_o")
    )


def candidate_pairs(df: DataFrame, keys: list[str], member: str, block: int = 64, group: str | None = None) -> DataFrame:
    """Distinct pairs (a < b) of members that share a key, whatever the size of the groups. With `group`, a column of that name has a
    hash of one (keys, bi, bj) in which the pair met, the same for pairs of one block as far as may be."""
    met = (
        block_groups(df, keys, member, block)
        .groupBy(*keys, "bi", "bj")
        .agg(F.collect_list(F.struct("own", F.col(member).alias("m"))).alias("ms"))
        .select(F.xxhash64(*keys, "bi", "bj").alias("_g"), F.explode(F.expr(
            "flatten(transform(ms, x -> transform(filter(ms, y -> y.m > x.m AND (bi = bj OR y.own <> x.own)), y -> struct(x.m AS a, y.m AS b))))"
        )).alias("p"))
        .select("p.a", "p.b", "_g")
    )
    return met.select("a", "b").distinct() if group is None else met.groupBy("a", "b").agg(F.min("_g").alias(group))
