"""Writing results: survivors and removed records, reports, token streams, appended rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.storage import settle

# The columns of a finished run, in order.
_RUN = (
    ("flops_budget", T.DoubleType()), ("width", T.IntegerType()), ("seed", T.IntegerType()), ("n_layer", T.IntegerType()), ("n_head", T.IntegerType()), ("n_embd", T.IntegerType()), ("n_params", T.LongType()),
    ("n_params_non_embedding", T.LongType()), ("tokens", T.LongType()), ("max_iters", T.IntegerType()), ("final_train_loss", T.DoubleType()), ("final_val_loss", T.DoubleType()), ("elapsed_s", T.DoubleType()),
)
RUN_SCHEMA = T.StructType([T.StructField(name, kind) for name, kind in _RUN])


def write_split(kept: DataFrame, removed: DataFrame, path: str, by: str = "lang") -> None:
    """Survivors under kept/, removed records under removed/, each partitioned by language."""
    for df, name in ((kept, "kept"), (removed, "removed")):
        df.write.mode("overwrite").partitionBy(by).parquet(f"{path}/{name}")


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV with header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def append_runs(df: DataFrame, path: str) -> None:
    """Appends finished runs; a table of other columns than RUN_SCHEMA is refused. What Spark commits is whole."""
    if [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in RUN_SCHEMA]:
        raise ValueError(f"columns {df.columns}, wanted {RUN_SCHEMA.names}")
    df.write.mode("append").parquet(path)


def append_new_runs(spark: SparkSession, df: DataFrame, path: str, keys: tuple[str, ...] = ("flops_budget", "width", "seed")) -> None:
    """append_runs of the runs whose keys the table doesn't have yet, so that a repeated call adds nothing."""
    try:
        df = df.join(spark.read.schema(RUN_SCHEMA).parquet(path).select(*keys), list(keys), "left_anti").select(*RUN_SCHEMA.names)
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    append_runs(df, path)


def write_tokens(encoded: DataFrame, path: str, end: int, vocabulary: int) -> None:
    """encoded(doc_id, ids) as a stream: each record's ids with the end-of-text token, in order of doc_id within files. Ids must fit
    16 bits, as those of the packed format."""
    if vocabulary > 1 << 16:
        raise ValueError("a vocabulary of more than 65,536 ids doesn't fit 16 bits")
    encoded.select("doc_id", F.concat("ids", F.array(F.lit(end))).alias("tokens")).sortWithinPartitions("doc_id").write.mode("overwrite").parquet(path)


def write_packed(encoded: DataFrame, path: str, end: int, vocabulary: int, by: str = "split") -> DataFrame:
    """encoded(doc_id, ids, split) as files of unsigned 16-bit tokens, path/split=.../part-N.bin, one for each task and split: each record's
    ids with the end-of-text token, in order of doc_id. Returns (split, file, docs, tokens) of what was written, which stream_metadata
    sums up. A file appears whole under its name, so that a repeated task changes nothing; write the result once (it is settled)."""
    if vocabulary > 1 << 16:
        raise ValueError("a vocabulary of more than 65,536 ids doesn't fit 16 bits")

    def run(it):
        import uuid

        from pyarrow import fs
        from pyspark import TaskContext

        system, root = fs.FileSystem.from_uri(path)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        files: dict[str, list] = {}
        for b in it:
            for split, ids in zip(b.column(by).to_pylist(), b.column("ids").to_pylist()):
                if split not in files:
                    folder = f"{root}/{by}={split}"
                    system.create_dir(folder)
                    files[split] = [system.open_output_stream(f"{folder}/.part-{part:05d}-{attempt}"), f"{folder}/part-{part:05d}.bin", 0, 0]
                f = files[split]
                f[0].write(np.array([*(ids or ()), end], dtype="<u2").tobytes())
                f[2] += 1
                f[3] += len(ids or ()) + 1
        for split, (f, name, docs, tokens) in files.items():
            f.close()
            system.move(f"{name.rpartition('/')[0]}/.part-{part:05d}-{attempt}", name)
            yield pa.RecordBatch.from_pydict({by: [split], "file": [name], "docs": [docs], "tokens": [tokens]})

    ordered = encoded.select("doc_id", "ids", by).repartitionByRange(by, "doc_id").sortWithinPartitions(by, "doc_id")
    return settle(ordered.mapInArrow(run, f"{by} string, file string, docs long, tokens long"))


def stream_metadata(tokens: DataFrame, vocabulary: int, end: int) -> DataFrame:
    """One row: vocab_size, eos_token_id, docs and tokens of a written stream, as JSON too; of records with an array `tokens`, or of
    what write_packed returns."""
    rows = tokens if "docs" in tokens.columns else tokens.select(F.lit(1).alias("docs"), F.size("tokens").alias("tokens"))
    t = rows.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    r = t.select(F.lit(vocabulary).alias("vocab_size"), F.lit(end).alias("eos_token_id"), "docs", "tokens")
    return r.select("*", F.to_json(F.struct("vocab_size", "eos_token_id", "docs", "tokens")).alias("json"))


def dataset_card(counts: DataFrame, title: str, most: int = 10_000) -> str:
    """A Markdown card with the rows of each configuration; counts(lang, n) is refused beyond `most` rows."""
    rows = counts.orderBy("lang").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many configurations")
    lines = [f"| `{r['lang']}` | {r['n']:,} |" for r in rows]
    return "\n".join([f"# {title}", "", "| config | rows |", "| --- | --- |", *lines, f"| all | {sum(r['n'] for r in rows):,} |", ""])
