"""Training histories and new documents as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltworks.operators.dedup import MinhashConfig, band_keys, duplicate_links, signatures
from siltworks.operators.semijoin import having
from siltworks.storage import settle

HISTORY = "run_id long, iter long, train_loss double, val_loss double, lr double, tokens_seen long, elapsed_s double, logged_at timestamp, arrived_at timestamp"


def history_stream(spark: SparkSession, path: str, late: str = "7 days") -> DataFrame:
    """Evaluations as their files arrive, each (run_id, iter) once; those more than `late` behind the latest are dropped with their
    state, so that the state doesn't grow with the stream."""
    raw = spark.readStream.schema(HISTORY).parquet(path).where("run_id IS NOT NULL AND iter IS NOT NULL")
    return raw.withWatermark("logged_at", late).dropDuplicatesWithinWatermark(["run_id", "iter"])


def hourly_loss(history: DataFrame) -> DataFrame:
    """Mean losses of all runs by hour of logged_at, written when the watermark has passed the hour."""
    t = history.groupBy(F.window("logged_at", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("evaluations"), F.avg(F.nanvl("train_loss", F.lit(None))).alias("train_loss"))
    return t.select(F.col("w.start").alias("hour"), "evaluations", "train_loss")


def write_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Takes what is there, appends it to parquet and stops; a later call goes on where this one ended."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_increment(batch: DataFrame, known: DataFrame, c: MinhashConfig = MinhashConfig()) -> DataFrame:
    """The records of a batch without a duplicate among the known bands(doc_id, lang, h), as of dedup.band_keys, or among those of lesser
    doc_id in the batch; for foreachBatch, which appends band_keys(signatures(result)) to the known ones. Whatever is known
    comes first, whichever ids it has: ids decide within the batch only. Of what is known only bands that the batch may have are shuffled."""
    new = settle(signatures(batch, c))
    own = settle(band_keys(new, c))
    seen = having(known, "h", own.select("h").distinct()).select(F.col("lang").alias("l"), F.col("h").alias("k")).distinct()
    again = own.join(seen, (F.col("h") == F.col("k")) & F.col("lang").eqNullSafe(F.col("l")), "left_semi").select("doc_id")
    gone = again.union(duplicate_links(new, c).select("b")).distinct()
    return batch.join(gone, "doc_id", "left_anti")
