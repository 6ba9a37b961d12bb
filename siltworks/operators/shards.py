"""Deterministic shuffling into bounded shards, and splits by shard and by record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.storage import settle


def portable_hash(*parts: Column) -> Column:
    """28 bits of the md5 of the parts joined by ':', as any engine can compute it."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 7), 16, 10).cast("long")


def shard_count(total_bytes: int | float, target_bytes: int | float) -> int:
    """max(1, total / target rounded half to even)."""
    return max(1, round(total_bytes / target_bytes))


def assign_shards(df: DataFrame, key: str, shards: int | Column, seed: int = 42) -> DataFrame:
    """df with shard (uniform by hash of key and seed) and place (the random order within the shard); the same on every run."""
    n = F.lit(shards) if isinstance(shards, int) else shards
    return df.withColumn("shard", F.pmod(portable_hash(F.lit(seed), F.col(key)), n).cast("int")).withColumn("place", F.md5(F.concat_ws(":", F.lit(seed + 1).cast("string"), F.col(key).cast("string"))))


def numbered_shards(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., shard, task, number, of) of the shards of df that have rows: task counts all of them from 0, number those of one `by`, without
    gaps, and of is how many that has. Few rows, one for each shard."""
    keys = by or []
    w = Window.partitionBy(*keys)
    some = df.select(*keys, "shard").distinct()
    return some.select(
        *keys, "shard", (F.row_number().over(Window.orderBy(*keys, "shard")) - 1).alias("task"), (F.row_number().over(w.orderBy("shard")) - 1).alias("number"), F.count(F.lit(1)).over(w).alias("of")
    )


def write_shards(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """One file for each shard with rows, shuffled within, under by=.../part=00003-of-00012, numbered without gaps. Each shard is a task of
    its own, none waits for another. What Spark commits is complete or absent."""
    keys = by or []
    names = settle(numbered_shards(df, by))
    n = max(1, names.count())
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, "shard"]]
    named = df.join(F.broadcast(names.select(*[F.col(k).alias(f"_{k}") for k in [*keys, "shard"]], "task", F.format_string("%05d-of-%05d", "number", "of").alias("part"))), on) if n <= 1_000_000 else None
    if named is None:
        raise ValueError("more than a million shards")
    rows = named.repartitionById(n, F.col("task").cast("int")).sortWithinPartitions("place").select(*keys, "part", *[c for c in df.columns if c not in (*keys, "shard", "place")])
    rows.write.option("parquet.enable.dictionary", "false").partitionBy(*keys, "part").mode("overwrite").parquet(path)


def is_complete(spark, path: str) -> bool:
    """Whether a dataset was committed; partial output of a broken run was not."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def completed_rows(spark, path: str) -> int | None:
    """The rows of a committed dataset, from its files' footers; None where none was committed."""
    return spark.read.parquet(path).count() if is_complete(spark, path) else None


def split_by_shard(shards: DataFrame, val_shards: int, by: str = "lang") -> DataFrame:
    """shards(by, shard) with split: of n shards the first min(val_shards, max(1, n div 10)) in order are val."""
    w = Window.partitionBy(by)
    n = F.count(F.lit(1)).over(w)
    quota = F.least(F.lit(val_shards), F.greatest(F.lit(1), F.floor(n / F.lit(10))))
    return shards.withColumn("split", F.when(F.row_number().over(w.orderBy("shard")) <= quota, "val").otherwise("train"))


def split_by_record(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """df with split: the max(1, floor(n * fraction)) records of the least hash are val. The threshold is the hash at that rank,
    found on a histogram of hash prefixes, so that no global sort is needed."""
    h = df.withColumn("_h", portable_hash(F.lit(seed), F.col(key)))
    total = h.count()
    want = max(1, int(total * fraction)) if total else 0
    upper = h.groupBy(F.shiftright("_h", 14).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    acc = upper.withColumn("upto", F.sum("n").over(Window.orderBy("p"))).where(F.col("upto") >= want).orderBy("p").first()
    if acc is None:
        return h.withColumn("split", F.lit("train")).drop("_h")
    edge, before = acc["p"], acc["upto"] - acc["n"]
    last = h.where(F.shiftright("_h", 14) == edge).withColumn("_r", F.row_number().over(Window.orderBy("_h", key))).where(F.col("_r") <= want - before).select(F.col(key).alias("_v"))
    marked = h.join(last, F.col(key) == F.col("_v"), "left")
    return marked.withColumn("split", F.when((F.shiftright("_h", 14) < edge) | F.col("_v").isNotNull(), "val").otherwise("train")).drop("_h", "_v")
