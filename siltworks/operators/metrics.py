"""Tokenizer metrics: ratios of sums, never means of ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions.text import utf8_bytes, word_count


def report(docs: DataFrame, tokenizers: dict[str, Column], by: str = "lang") -> DataFrame:
    """(tokenizer, by, tokens, fertility, compression_ratio) for each language and 'overall'. tokenizers: for each name a column that
    counts the tokens of `text`, be it built-in functions or a vectorized UDF. One pass over the texts computes all; ratios
    without words or tokens are NaN."""
    counts = docs.select(by, word_count(F.col("text")).alias("w"), utf8_bytes(F.col("text")).alias("b"), *[c.alias(f"t_{k}") for k, c in tokenizers.items()])
    return report_of_counts(counts, list(tokenizers), by)


def report_of_counts(counts: DataFrame, tokenizers: list[str], by: str = "lang") -> DataFrame:
    """As report, of counts(by, w, b, t_NAME...): each text's words, bytes and tokens, for tokenizers that are no Column."""
    sums = counts.groupBy(by).agg(F.sum("w").alias("w"), F.sum("b").alias("b"), *[F.sum(f"t_{k}").alias(f"t_{k}") for k in tokenizers])
    stack = ", ".join(f"'{k}', `t_{k}`" for k in tokenizers)
    rows = sums.select(by, "w", "b", F.expr(f"stack({len(tokenizers)}, {stack}) AS (tokenizer, t)"))
    out = rows.rollup("tokenizer", by).agg(F.grouping_id().alias("g"), F.sum("t").alias("tokens"), F.sum("w").alias("w"), F.sum("b").alias("b")).where("g < 2")
    ratio = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.when(F.col(b) > 0, F.col(b))).otherwise(F.lit(float("nan"))), 6)
    return out.select("tokenizer", F.when(F.col("g") == 1, "overall").otherwise(F.col(by)).alias(by), "tokens", ratio("tokens", "w").alias("fertility"), ratio("b", "tokens").alias("compression_ratio"))
