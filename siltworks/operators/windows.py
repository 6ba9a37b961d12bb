"""A packed token stream as intervals: every document with its end-of-text token occupies [start, start + length + 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.operators.prefix import running_total


def stream_offsets(docs: DataFrame, by: list[str], order: str = "doc_id", tokens: str = "n_tokens") -> DataFrame:
    """docs with start, the place of its first token in the stream of its group, and size, its tokens with the end-of-text token."""
    return running_total(docs.withColumn("size", F.col(tokens) + 1), by, order, "size", "start")


def window_segments(placed: DataFrame, by: list[str], block: int, order: str = "doc_id") -> DataFrame:
    """(by, window, doc, t, n, position): the piece of each document in each window of `block` tokens: t is where it begins in the window,
    n its tokens, position the place of its first token within the document, doc its number within the window. Windows are never
    expanded to tokens; a document gives as many rows as windows it touches."""
    first = F.floor(F.col("start") / F.lit(block))
    last = F.floor((F.col("start") + F.col("size") - 1) / F.lit(block))
    rows = placed.select(*by, order, "start", "size", F.explode(F.sequence(first, last)).alias("window"))
    begin = F.greatest(F.col("start"), F.col("window") * block)
    end = F.least(F.col("start") + F.col("size"), (F.col("window") + 1) * block)
    parts = rows.select(*by, order, "window", (begin - F.col("window") * block).alias("t"), (end - begin).alias("n"), (begin - F.col("start")).alias("position"))
    return parts.withColumn("doc", F.expr(f"row_number() OVER (PARTITION BY {', '.join([*by, 'window'])} ORDER BY t) - 1"))


def shifted_windows(encoded: DataFrame, by: list[str], block: int, end: int) -> DataFrame:
    """(by, window, x, y) of encoded(by, doc_id, ids): the whole windows of `block` tokens of each group's stream, in which every record ends
    with the end-of-text token, and the same shifted by one, what each token is to predict. Windows follow each other by `block`
    tokens; one that isn't full, or that nothing follows, is left out. A record's tokens are sent to the windows they are in, slice by slice."""
    docs = encoded.where("doc_id IS NOT NULL").select(*by, "doc_id", F.concat(F.coalesce("ids", F.array().cast("array<int>")), F.array(F.lit(end).cast("int"))).alias("ids"))
    sizes = stream_offsets(docs.select(*by, "doc_id", (F.size("ids") - 1).cast("long").alias("n_tokens")), by).select("doc_id", "start", "size")
    placed = docs.join(sizes, "doc_id")
    # a window takes one token more than it is long
    first = F.greatest(F.lit(0), F.floor((F.col("start") - 1) / F.lit(block)))
    rows = placed.select("*", F.explode(F.sequence(first, F.floor((F.col("start") + F.col("size") - 1) / F.lit(block)))).alias("window"))
    begin = F.greatest(F.col("start"), F.col("window") * block)
    stop = F.least(F.col("start") + F.col("size"), (F.col("window") + 1) * block + 1)
    cut = rows.select(*by, "window", F.struct(begin.alias("t"), F.slice("ids", (begin - F.col("start") + 1).cast("int"), F.greatest(stop - begin, F.lit(0)).cast("int")).alias("part")).alias("s"))
    whole = cut.groupBy(*by, "window").agg(F.flatten(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["part"])).alias("t")).where(F.size("t") == block + 1)
    return whole.select(*by, "window", F.slice("t", 1, block).alias("x"), F.slice("t", 2, block).alias("y"))


def causal_pairs(segments: DataFrame, by: list[str]) -> DataFrame:
    """(by, window, tokens, documents, pairs): pairs of tokens (q >= k) of one document, which is what a document mask leaves."""
    return segments.groupBy(*by, "window").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.sum(F.col("n") * (F.col("n") + 1) / 2).cast("long").alias("pairs"))
