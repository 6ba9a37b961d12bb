"""Tables between stages: written to the folder all executors share, so that a lost executor costs no lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What was written, with the session that can delete it.
_made: dict[str, SparkSession] = {}
#: Inputs that are estimated smaller, in bytes, are dealt out over all cores: one shuffle of at most so much, on any cluster.
SMALL = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own; on a cluster, whose executors
    would each write to a disk of their own, it is refused."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    at = "file://" + tempfile.mkdtemp(prefix="siltworks-")
    _made[at] = spark
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def settle(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Writes df as parquet in the shared folder and reads it back: cuts lineage, computes it once. The table is deleted by
    release(), or when Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    _made[path] = spark
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> int:
    """Deletes the tables that settle() has written so far, on whatever file system; their number. For between two queries: results that
    read them must have been used."""
    gone = 0
    for path, spark in list(_made.items()):
        if "/settled-" in path:
            _delete(spark, path)
            del _made[path]
            gone += 1
    return gone


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for path, spark in reversed(list(_made.items())):
        try:
            _delete(spark, path)
        except Exception:  # the session is gone; its folder is the cluster's to clear
            return


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{folder}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out over all cores if the planner's estimate of its size is below SMALL, as for a file that is one split and would be one
    task of Python work. Larger inputs have splits enough and stay where they are, whatever the number of cores."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SMALL else df


__all__ = ["SMALL", "load", "release", "settle", "shared_dir", "spread"]
