"""Problem 7: filling containers of fixed capacity, by best-fit decreasing in partitions whose results dual feasible
functions certify. Partitions with a gap between containers and bound exchange their items in pairs: both are packed anew as
one, which is taken pair by pair where it saves a container. Bounds round up once for each partition, so that certified ones may
still lose part of a container each: what stands in containers with much room is packed anew across all partitions. A
histogram of sizes gives the bound of the whole."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltworks.storage import settle


@dataclass(frozen=True)
class Packing:
    capacity: int = 4096
    #: Items in one partition, about.
    partition_items: int = 20_000
    #: Rounds of exchange at most; each one doubles the items of the partitions that still have a gap.
    rounds: int = 6
    #: Containers filled less than this share are packed anew across partitions.
    loose: float = 0.9


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The containers that any packing of the sizes has at least; items of no size take a place in one."""
    return bound_of(np.bincount(sizes[sizes > 0], minlength=capacity + 1)[: capacity + 1], capacity) or int(len(sizes) > 0)


def bound_of(h: np.ndarray, capacity: int) -> int:
    """The most that dual feasible functions prove, of h[s] items of each size s up to the capacity.

    Threshold functions (items above capacity - t count as whole containers, items below t as none) for every t up to half the
    capacity, and rounding functions (floor((k+1) x / C) / k unless (k+1) x / C is whole) for k up to 20.
    """
    h = np.where(np.arange(capacity + 1) > 0, h, 0).astype(np.int64)
    if not h.any():
        return 0
    x = np.arange(capacity + 1)
    volume, count = np.cumsum(h * x), np.cumsum(h)
    t = np.arange(1, capacity // 2 + 1)
    large = count[-1] - count[capacity - t]
    middle = volume[capacity - t] - volume[t - 1]
    best = max(-(-int(volume[-1]) // capacity), int(np.max(large - (-middle // capacity))) if len(t) else 0)
    for k in range(1, 21):
        whole = (k + 1) * x % capacity == 0
        # in units of capacity * k, so that all is whole numbers
        f = np.where(whole, x * k, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((h * f).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item. An integer holds a bit for every amount of room that some container has left; the lowest bit
    from the item's size on is the best fit."""
    bins = np.zeros(len(sizes), dtype=np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = made = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fit = mask >> s
        if fit:
            r = s + (fit & -fit).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
        else:
            r, b, made = capacity, made, made + 1
        bins[i] = b
        room[r - s].append(b)
        mask |= 1 << (r - s)
    return bins


def _pack(p: Packing):
    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["size", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        sizes = df["size"].to_numpy(np.int64)
        bins = best_fit_decreasing(sizes, p.capacity)
        made = int(bins.max()) + 1
        return df.assign(bin=bins, gap=made - lower_bound(sizes, p.capacity), made=made, saved=0)

    return run


def _exchange(p: Packing):
    """Two packed partitions as one: packed anew if that saves a container, else side by side."""
    again = _pack(p)

    def run(df: pd.DataFrame) -> pd.DataFrame:
        made = df.groupby("old")["made"].first().sort_index()
        new = again(df.drop(columns=["bin", "gap", "made", "saved"]))
        saved = int(made.sum()) - int(new["made"].iloc[0])
        if saved > 0:
            return new.drop(columns="old").assign(saved=saved)
        before = (made.cumsum() - made).to_dict()
        bound = int(new["made"].iloc[0]) - int(new["gap"].iloc[0])
        return df.assign(bin=df["bin"] + df["old"].map(before), made=int(made.sum()), gap=int(made.sum()) - bound, saved=0).drop(columns="old")

    return run


def _gather(p: Packing):
    """The items of loose containers of many partitions: packed anew if that saves a container, else as they were."""
    again = _pack(p)

    def run(df: pd.DataFrame) -> pd.DataFrame:
        was = df.groupby(["old", "bin"], sort=True).ngroup()
        n = int(was.max()) + 1
        new = again(df.drop(columns=["bin", "gap", "made", "saved"]))
        made = int(new["made"].iloc[0])
        if made < n:
            return new.drop(columns="old").assign(saved=n - made)
        return df.assign(bin=was, made=n, gap=n - made + int(new["gap"].iloc[0]), saved=0).drop(columns="old")

    return run


def pack(items: DataFrame, p: Packing = Packing()) -> DataFrame:
    """(doc_id, piece, size, container, bound_gap) of items(doc_id, size, ...).

    An item above the capacity, and only that, is split: pieces 0, 1, ... are full containers, the last is packed like an
    item. Sizes of null or below 1 count as 0 and take a place in some container all the same. bound_gap is by how many
    containers the item's partition exceeds its proven lower bound (0: optimal). Repeated rows are packed each; null
    doc_ids are left out; an empty table gives an empty result.
    """
    n = items.where("doc_id IS NOT NULL").select("doc_id", F.greatest(F.coalesce(F.col("size"), F.lit(0)), F.lit(0)).cast("long").alias("n"))
    last = F.greatest(F.floor((F.col("n") - 1) / F.lit(p.capacity)), F.lit(0)).cast("int")
    pieces = n.select("doc_id", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece")).select(
        "doc_id", "piece", F.least(F.col("n") - F.col("piece") * F.lit(p.capacity), F.lit(p.capacity)).alias("size")
    )
    pieces = settle(pieces)
    shape = "doc_id long, piece int, size long, part long, bin long, gap long, made long, saved long"
    parts = max(1, round(pieces.count() / p.partition_items))
    keyed = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    open_ = settle(keyed.repartition(min(parts, 20000), "part").groupBy("part").applyInPandas(_pack(p), shape))
    done = []
    for r in range(1, p.rounds + 1):
        gaps = open_.where("gap > 0")
        # partitions are few rows, one for each; neighbours in their order meet, the last of an odd number waits for the next round
        pairs = gaps.select(F.col("part").alias("old")).distinct().select("old", (F.floor((F.row_number().over(Window.orderBy("old")) - 1) / 2) + F.lit(r << 32)).alias("part"))
        pairs = settle(pairs)
        if pairs.count() < 2:
            break
        done.append(open_.where("gap = 0"))
        met = gaps.withColumnRenamed("part", "old").join(pairs, "old")
        n = min(pairs.select("part").distinct().count(), 20000)
        open_ = settle(met.repartition(n, "part").groupBy("part").applyInPandas(_exchange(p), shape))
        if open_.where("saved > 0").isEmpty():
            break
    out = open_
    for df in done:
        out = out.unionByName(df)
    kept, groups = [], parts
    for r in range(1, p.rounds + 1):
        # once all that is loose was packed together, there is nothing left to exchange with
        if groups == 1:
            break
        fill = settle(out.groupBy("part", "bin").agg(F.sum("size").alias("fill"), F.count(F.lit(1)).alias("n")).where(F.col("fill") < F.lit(p.loose * p.capacity)))
        groups = max(1, round((fill.agg(F.sum("n")).first()[0] or 0) / p.partition_items))
        part = (F.pmod(F.xxhash64("old", F.lit(r)), F.lit(groups)) + F.lit((p.rounds + r) << 32)).alias("part")
        loose = out.join(fill.select("part", "bin").hint("merge"), ["part", "bin"]).withColumnRenamed("part", "old").select("*", part)
        kept.append(out.join(fill.select("part", "bin").hint("merge"), ["part", "bin"], "left_anti"))
        out = settle(loose.repartition(min(groups, 20000), "part").groupBy("part").applyInPandas(_gather(p), shape))
        if out.where("saved > 0").isEmpty():
            break
    for df in kept:
        out = out.unionByName(df)
    return out.select("doc_id", "piece", "size", (F.col("part") * F.lit(1 << 24) + F.col("bin")).alias("container"), F.col("gap").alias("bound_gap"))


def split_items(packed: DataFrame) -> DataFrame:
    """(doc_id): items whose pieces fill more than one container; of a doc_id given several times, more containers than times."""
    by = packed.groupBy("doc_id").agg(F.count_distinct("container").alias("containers"), F.count(F.when(F.col("piece") == 0, 1)).alias("items"))
    return by.where("containers > items").select("doc_id")


def certified(packed: DataFrame, p: Packing = Packing()) -> DataFrame:
    """One row of a packing as a whole: items, containers, lower_bound (what no packing of all the pieces can be below), gap (containers more
    than that) and fill (share of the containers' room that is used). The bound comes from a histogram of sizes, of capacity + 1 rows
    at most. Nothing packed gives zeros."""
    packed = settle(packed.select("size", "container", "piece"))
    h = np.zeros(p.capacity + 1, dtype=np.int64)
    for x in packed.groupBy("size").agg(F.count(F.lit(1)).alias("n")).where(F.col("size").between(1, p.capacity)).collect():
        h[x["size"]] = x["n"]
    t = packed.agg(F.count(F.when(F.col("piece") == 0, 1)).alias("items"), F.count_distinct("container").alias("containers"), F.coalesce(F.sum("size"), F.lit(0)).alias("used"))
    bound = F.greatest(F.lit(bound_of(h, p.capacity)), (F.col("containers") > 0).cast("int")).cast("long")
    room = F.col("containers") * p.capacity
    return t.select("items", "containers", bound.alias("lower_bound"), (F.col("containers") - bound).alias("gap"), F.round(F.when(room > 0, F.col("used") / F.when(room > 0, room)).otherwise(F.lit(0.0)), 6).alias("fill"))
