"""Running totals in order of a column, without one task per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltworks.storage import settle


def running_total(df: DataFrame, keys: list[str], order: str, value: str, name: str = "before", parts: int | None = None) -> DataFrame:
    """df with `name`: the sum of `value` over the rows of the same keys whose `order` (of any type, unique within the keys) is less.

    Rows are cut into ranges of (keys, order) of about equal numbers, whatever the values are like, by Spark's sampled range
    partitioning; a key of any size spreads over many of them. Sums of ranges are accumulated, at most one row for each range and
    key, then rows within their range. df is written once in between, so leave out what isn't needed. Null values count as 0, a
    null order comes first. `parts`: the number of ranges, else that of the session's shuffles.
    """
    by = [*keys, order]
    ranged = df.repartitionByRange(*by) if parts is None else df.repartitionByRange(parts, *by)
    b = settle(ranged.withColumn("_p", F.spark_partition_id()))
    v = F.coalesce(F.col(value), F.lit(0))
    sums = b.groupBy(*keys, "_p").agg(F.sum(v).alias("_s"))
    w = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_p").alias("_kp"), F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = b.withColumn("_local", F.coalesce(F.sum(v).over(inside), F.lit(0)))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_p") == F.col("_kp")]
    return local.join(starts, on).withColumn(name, F.col("_start") + F.col("_local")).drop("_p", "_local", "_start", "_kp", *[f"_k{i}" for i in range(len(keys))])
