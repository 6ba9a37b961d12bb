"""Arithmetic of compute budgets and model shapes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the shape rule and of the sweep.
HEAD_SIZE, ANCHOR_WIDTH, ANCHOR_LAYERS, FLOPS_PER_PARAM_TOKEN = 64, 512, 8, 6
BUDGETS = (1e14, 3.16e14, 1e15, 1.78e15, 3.16e15)
WIDTHS = (4, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, 448, 512, 640, 768)
MIN_ITERS, MAX_ITERS = 100, 50_000


def layers_for_width(width: Column) -> Column:
    return F.greatest(F.lit(1), F.rint(F.lit(float(ANCHOR_LAYERS)) * F.sqrt(width / F.lit(float(ANCHOR_WIDTH))))).cast("int")


def heads_for_width(width: Column) -> Column:
    """The divisor of the width whose head size is nearest to 64, the larger one in a tie; null below 1."""
    divisors = F.filter(F.sequence(F.lit(1), F.greatest(width, F.lit(1))), lambda h: width % h == 0)
    ranked = F.transform(divisors, lambda h: F.struct(F.abs(width / h - F.lit(float(HEAD_SIZE))).alias("d"), (-h).alias("h")))
    return F.when(width >= 1, -F.array_min(ranked)["h"])


def num_params(width: Column, layers: Column, vocab: int, block: int) -> Column:
    w = width.cast("long")
    return F.lit(vocab) * w + F.lit(block) * w + non_embedding_params(width, layers)


def non_embedding_params(width: Column, layers: Column) -> Column:
    w, n = width.cast("long"), layers.cast("long")
    return n * (12 * w * w + 13 * w) + 2 * w


def tokens_for_budget(flops: Column, params: Column) -> Column:
    return F.rint(flops / (F.lit(FLOPS_PER_PARAM_TOKEN) * params)).cast("long")


def iters_for_budget(flops: Column, params: Column, batch: int, block: int) -> Column:
    return F.greatest(F.lit(1), F.rint(tokens_for_budget(flops, params) / F.lit(batch * block))).cast("long")


def duration(seconds: Column) -> Column:
    """3h45m24s, 45m24s or 24s."""
    s = F.floor(seconds)
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return (
        F.when(h > 0, F.format_string("%dh%02dm%02ds", h, m, r)).when(m > 0, F.format_string("%dm%02ds", m, r)).otherwise(F.format_string("%ds", r))
    )


def budget_text(flops: Column, params: Column, layers: Column, heads: Column, width: Column, batch: int, block: int) -> Column:
    """One line that describes a budget and what it buys."""
    return F.format_string(
        f"%.3e FLOPs: width %d, %d layers, %d heads, %,d parameters; %,d tokens in %,d steps of {batch} x {block}",
        flops, width, layers, heads, params, tokens_for_budget(flops, params), iters_for_budget(flops, params, batch, block),
    )


def learning_rate(it: Column, peak: float, low: float, warmup: int, most: Column) -> Column:
    """Linear warm-up, then a cosine down to `low` at `most`."""
    ratio = (it - warmup) / F.greatest(F.lit(1), most - warmup)
    return F.when(it < warmup, F.lit(peak) * (it + 1) / F.lit(warmup)).when(it >= most, F.lit(low)).otherwise(F.lit(low) + 0.5 * (1.0 + F.cos(F.lit(3.141592653589793) * ratio)) * (peak - low))


def vocab_label(size: Column) -> Column:
    """65.5k, 32k."""
    return F.concat(F.regexp_replace(F.regexp_replace(F.format_string("%.1f", F.bround(size / 1000, 1)), "0$", ""), r"\.$", ""), F.lit("k"))


def json_number(x: Column) -> Column:
    """null for what JSON has no number for."""
    return F.when(~(F.isnan(x) | (F.abs(x) == F.lit(float("inf")))), x)
