"""Reading corpora: one reader for each source, projected before they are chained."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.operators.prefix import running_total
from siltworks.storage import settle


@dataclass(frozen=True)
class Source:
    """A row of the source registry."""

    row: str
    lang: str
    pattern: str
    text_key: str = "text"
    id_key: str = "id"


def registry(specs: DataFrame, most: int = 10_000) -> list[Source]:
    """The registry, ordered by language and row, from a table like source_specs; refused beyond `most` rows."""
    rows = specs.orderBy("lang", "row_name").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many sources")
    return [Source(r["row_name"], r["lang"], r["pattern"], r["text_key"], r["id_key"]) for r in rows]


def read_source(spark: SparkSession, folder: str, source: Source, rank: int = 0, with_metadata: bool = False) -> DataFrame:
    """(text, id, source_rank[, metadata]) of one source: text and id renamed, other columns never read, or folded into one structure.
    Columns of other types in other sources make no difference, since each is projected by itself."""
    df = spark.read.parquet(f"{folder}/{source.row}/{source.pattern}")
    extra = [c for c in df.columns if c not in (source.text_key, source.id_key)]
    columns = [F.col(source.text_key).alias("text"), F.col(source.id_key).cast("string").alias("id"), F.lit(rank).alias("source_rank")]
    if with_metadata:
        columns.append(F.struct(*extra).alias("metadata"))
    return df.select(*columns)


def chain(parts: list[DataFrame]) -> DataFrame:
    """All parts, in order by their own columns; refuses an empty list."""
    if not parts:
        raise ValueError("nothing to read")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_language(spark: SparkSession, folder: str, sources: list[Source], lang: str) -> DataFrame:
    """All sources of a language, chained; metadata only if the language has a single source."""
    own = [s for s in sources if s.lang == lang]
    return chain([read_source(spark, folder, s, i, len(own) == 1) for i, s in enumerate(own)])


def limited(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows by order (unique, null first); n of -1 takes all. The n-th value is found on the order column alone, then the rows up
    to it are read."""
    if n < 0:
        return df
    ranks = running_total(df.select(order).withColumn("_one", F.lit(1)), [], order, "_one", "_i").where(F.col("_i") < n)
    last = ranks.agg(F.max(order).alias("m"), F.count(F.lit(1)).alias("n")).first()
    if not last["n"]:
        return df.where("false")
    c = F.col(order)
    return df.where(c.isNull() if last["m"] is None else c.isNull() | (c <= F.lit(last["m"])))


def nonempty(df: DataFrame) -> DataFrame:
    """Rows whose text is neither null nor empty; blank text stays."""
    return df.where("text IS NOT NULL AND text <> ''")


def read_processed(spark: SparkSession, folder: str, limit_per_lang: int = -1) -> DataFrame:
    """(lang, id, text) of a corpus partitioned by lang; limited before empty texts are dropped, as rows are counted when read."""
    df = spark.read.parquet(folder).select("lang", "id", "text")
    if df.isEmpty():
        raise ValueError(f"{folder} has no rows")
    if limit_per_lang >= 0:
        ranks = running_total(df.select("lang", "id").withColumn("_one", F.lit(1)), ["lang"], "id", "_one", "_i").where(F.col("_i") < limit_per_lang)
        # the last id of each language, one row for each
        last = settle(ranks.groupBy(F.col("lang").alias("_l")).agg(F.max("id").alias("_last")))
        df = df.join(last, F.col("lang").eqNullSafe(F.col("_l")) & (F.col("id") <= F.col("_last"))).drop("_l", "_last")
    return nonempty(df)


def list_shards(spark: SparkSession, folder: str, lang: str) -> list[str]:
    """The files of a language of a corpus partitioned by lang, in order; refused if there are none."""
    files = [f for f in spark.read.parquet(folder).where(F.col("lang") == lang).inputFiles() if f"/lang={lang}/" in f]
    if not files:
        raise FileNotFoundError(f"no files of {lang} in {folder}")
    return sorted(files)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV with header, read with the given types; a header that differs is refused."""
    head = spark.read.option("header", True).csv(path)
    if head.columns != schema.names:
        raise ValueError(f"{path} has columns {head.columns}, wanted {schema.names}")
    return spark.read.option("header", True).schema(schema).csv(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """A training history of one JSON object a line."""
    return spark.read.schema("run_id long, iter long, train_loss double, val_loss double, lr double, tokens_seen long, elapsed_s double").json(path)


def read_packed(spark: SparkSession, path: str, most: int = 1 << 20) -> DataFrame:
    """(file, start, n, tokens) of files of unsigned 16-bit tokens, in ranges of at most `most` tokens from token `start`; Integer holds
    them, Short would not. Files of any length: only their sizes are listed, each task reads its ranges. Empty files have no rows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path).select(F.col("path").alias("file"), F.expr("length div 2").alias("size")).where("size > 0")
    ranges = files.select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(most).cast("long"))).alias("start"))
    ranges = ranges.select("file", "start", F.least(F.lit(most).cast("long"), F.col("size") - F.col("start")).alias("n"))

    def run(it):
        from pyarrow import fs

        for b in it:
            for file, start, n in zip(*(b.column(c).to_pylist() for c in ("file", "start", "n"))):
                system, at = fs.FileSystem.from_uri(file)
                with system.open_input_file(at) as f:
                    data = np.frombuffer(f.read_at(2 * n, 2 * start), dtype="<u2").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([start]), pa.array([n]), pa.array([data], pa.list_(pa.int32()))], names=["file", "start", "n", "tokens"])

    return ranges.repartition("file", "start").mapInArrow(run, "file string, start long, n long, tokens array<int>")
