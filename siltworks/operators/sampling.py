"""Samples of a corpus: byte caps, several disjoint buckets, ratios by repetition."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.operators.prefix import running_total


def byte_capped(docs: DataFrame, cap: int, by: str = "lang", order: str = "doc_id") -> DataFrame:
    """The records, in order, for which the bytes before them are below the cap; the last one may exceed it. Needs a column bytes."""
    return running_total(docs, [by], order, "bytes", "bytes_before").where(F.col("bytes_before") < cap)


def fill_buckets(docs: DataFrame, caps: dict[str, int], by: str = "lang", order: str = "doc_id") -> DataFrame:
    """(by, order, bucket): each record goes to the bucket that is filled least in proportion and isn't full, the first listed in a tie;
    records that come when all are full have none. A bucket exceeds its cap by one record at most, so a record can only matter while
    the bytes before it are below the sum of the caps and such excesses: what a task folds over is bounded by the caps, not by
    the data, and only (order, bytes) gets there."""
    names, sizes = list(caps), list(caps.values())
    total = sum(sizes) + (len(sizes) - 1) * (docs.agg(F.max("bytes")).first()[0] or 0)
    near = running_total(docs.select(by, order, "bytes"), [by], order, "bytes", "_before").where(F.col("_before") < total)

    def fold(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(order, kind="stable")
        have = [0] * len(names)
        chosen: list[str | None] = []
        for n in df["bytes"].tolist():
            best = min((i for i in range(len(names)) if have[i] < sizes[i]), key=lambda i: have[i] / sizes[i], default=None)
            chosen.append(None if best is None else names[best])
            if best is not None:
                have[best] += n
        return df[[by, order]].assign(bucket=chosen)

    kept = near.groupBy(by).applyInPandas(fold, f"{by} string, {order} long, bucket string")
    kept = kept.select(F.col(by).alias("_by"), F.col(order).alias("_order"), "bucket")
    return docs.select(by, order).join(kept, F.col(by).eqNullSafe(F.col("_by")) & (F.col(order) == F.col("_order")), "left").select(by, order, "bucket")


def oversample(docs: DataFrame, ratios: dict[str, float], target_bytes: float | None = None, by: str = "lang", order: str = "doc_id") -> DataFrame:
    """docs with repeats: how often each record is taken when a language's records are repeated in order, cyclically, until its bytes
    reach its share of the target; closed form from the bytes before it. Without a target it is the least total that every language
    reaches with each record once. Refuses ratios without a positive sum, and languages without bytes."""
    whole = sum(w for w in ratios.values() if w > 0)
    if whole <= 0:
        raise ValueError("the ratios need a positive sum")
    share = {k: w / whole for k, w in ratios.items() if w > 0}
    natural = {r[by]: int(r["b"] or 0) for r in docs.where(F.col(by).isin(*share)).groupBy(by).agg(F.sum("bytes").alias("b")).collect()}
    if missing := [k for k in share if not natural.get(k)]:
        raise ValueError(f"no text for {missing}")
    target = max(natural[k] / s for k, s in share.items()) if target_bytes is None else target_bytes
    given = F.create_map(*[F.lit(x) for k, s in share.items() for x in (k, float(target * s))])
    size = F.create_map(*[F.lit(x) for k, n in natural.items() for x in (k, n)])
    t = running_total(docs.where(F.col(by).isin(*share)), [by], order, "bytes", "bytes_before")
    return t.withColumn("repeats", F.greatest(F.lit(0), F.ceil((given[F.col(by)] - F.col("bytes_before")) / size[F.col(by)]))).drop("bytes_before")


def repeated(counted: DataFrame) -> DataFrame:
    """One row for each repetition, with copy counted from 0."""
    return counted.where("repeats > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("repeats") - 1).cast("int")))).drop("repeats")


def parse_ratios(spec: str, languages: tuple[str, ...]) -> dict[str, float]:
    """'lang:weight,lang:weight' as a dict, the last weight of a language counting; refuses malformed entries and unknown languages."""
    out: dict[str, float] = {}
    for entry in spec.split(","):
        name, colon, weight = entry.partition(":")
        name = name.strip()
        if not (name and colon and weight.strip()):
            raise ValueError(f"{entry!r} is not lang:weight")
        if name not in languages:
            raise ValueError(f"unknown language {name!r}")
        out[name] = float(weight)
        if math.isnan(out[name]):
            raise ValueError(f"{entry!r} has no weight")
    return out
