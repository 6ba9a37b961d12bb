"""Which rows of a large table have a key of a smaller set, without a shuffle of the large table's other rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FROM, _MOST = 1 << 10, 1 << 20


def marked(df: DataFrame, key: str, keys: DataFrame, name: str = "maybe") -> DataFrame:
    """df with a boolean `name` that is true wherever `key` is in keys(key), and seldom elsewhere.

    The keys are hashed into a bit map of 64-bit words, about one word a key, that is broadcast: at most 2^20 rows (some 50 MB)
    whatever the number of keys. Of other rows about one in 64 is marked up to a million keys, half of them at 45 million; beyond, the
    map fills up and more and more of them are, so that what follows must be exact. Null keys are not marked.
    """
    words = _FROM
    n = keys.count()
    while words < min(n, _MOST):
        words *= 2
    word = F.pmod(F.xxhash64(key), F.lit(words)).cast("int")
    bit = F.expr(f"shiftleft(1L, cast(pmod(shiftrightunsigned(xxhash64(`{key}`), 24), 64) AS int))")
    bits = keys.where(F.col(key).isNotNull()).select(word.alias("_w"), bit.alias("_b")).groupBy("_w").agg(F.bit_or("_b").alias("_b"))
    out = df.withColumn("_w", word).join(F.broadcast(bits), "_w", "left")
    return out.withColumn(name, F.col(key).isNotNull() & F.coalesce(F.col("_b").bitwiseAND(bit) != 0, F.lit(False))).drop("_w", "_b")


def having(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """df's rows whose `key` is in keys(key): most others are dropped before the exact join shuffles anything."""
    return marked(df, key, keys, "_maybe").where("_maybe").drop("_maybe").join(keys.select(key), key, "left_semi")


def joined_where_known(df: DataFrame, key: str, other: DataFrame) -> DataFrame:
    """df left-joined with other(key, ...), whose keys are distinct; rows of df that can have no partner aren't shuffled."""
    m = marked(df, key, other.select(key), "_maybe")
    near = m.where("_maybe").drop("_maybe").join(other, key, "left")
    far = m.where("NOT _maybe").drop("_maybe")
    for f in other.schema:
        if f.name != key:
            far = far.withColumn(f.name, F.lit(None).cast(f.dataType))
    return near.select(far.columns).unionByName(far)
