"""Problem 1: mixing sources to target weights.

Shares are exact sums; how a mixture's blocks come to its output shards is drawn by a splitting tree: the quotas of the
sources are split between the two halves of the shards by a multivariate hypergeometric draw, then each half's again,
down to single shards. Every split depends on its own seed alone, so that any task can draw any part of the tree, and all
quotas are exact. Shards take disjoint blocks of the permuted copies of the sources, records are shuffled within a shard.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions.text import LANGUAGES, language_code
from siltworks.storage import spread


@dataclass(frozen=True)
class Mixing:
    #: Output shards at least, and the characters that a shard has at most where that needs more of them.
    shards: int = 8
    shard_chars: int = 256 << 20
    #: A source is cut into blocks of about so many characters.
    block_chars: int = 4096
    seed: int = 1

    def shards_for(self, chars: int) -> int:
        return max(self.shards, -(-int(chars) // self.shard_chars))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of `drawn` items out of good + bad are good, for numbers of any size.

    By inversion: the probabilities around the mode, as products of the ratios of neighbours, over 12 standard deviations on either
    side; what lies beyond has less than 1e-30 of the whole. That is a few million values at 10^13 items.
    """
    lo, hi = max(0, drawn - bad), min(good, drawn)
    if lo == hi:
        return lo
    n = good + bad
    mode = min(max((drawn + 1) * (good + 1) // (n + 2), lo), hi)
    share = good / n
    reach = int(12 * (drawn * share * (1 - share) * (n - drawn) / max(n - 1, 1)) ** 0.5) + 40
    lo, hi = max(lo, mode - reach), min(hi, mode + reach)
    k = np.arange(mode, hi, dtype=np.float64)
    up = np.cumprod((good - k) * (drawn - k) / ((k + 1) * (bad - drawn + k + 1)))
    k = np.arange(mode, lo, -1, dtype=np.float64)
    down = np.cumprod(k * (bad - drawn + k) / ((good - k + 1) * (drawn - k + 1)))
    p = np.concatenate([down[::-1], [1.0], up])
    upto = np.cumsum(p)
    return lo + min(int(np.searchsorted(upto, rng.random() * upto[-1], side="right")), len(p) - 1)


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (columns) in each shard (rows), for any number of blocks. Column sums are the quotas, row sums differ by one
    at most. A node of the tree draws one source after the other, each out of what is left."""
    quotas = np.asarray(quotas, dtype=np.int64)
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    total = sum(map(int, quotas))
    todo = [(0, shards, [int(x) for x in quotas])]
    while todo:
        lo, hi, q = todo.pop()
        if hi - lo == 1:
            out[lo] = q
            continue
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed & (2**63 - 1), lo, hi])
        wanted, rest, left = total * mid // shards - total * lo // shards, sum(q), []
        for x in q:
            left.append(hypergeometric(rng, x, rest - x, wanted))
            wanted, rest = wanted - left[-1], rest - x
        todo += [(lo, mid, left), (mid, hi, [x - y for x, y in zip(q, left)])]
    return out


def unplaced(shard_blocks: np.ndarray, wanted: int, supply: int, block: int) -> np.ndarray:
    """Characters of each shard's quota of a source that the source has no text left for. The shards draw one after the other from the
    source's permuted blocks, the last of which is short if `wanted` isn't a multiple of `block`."""
    ends = np.minimum(np.cumsum(shard_blocks) * block, wanted)
    return np.diff(np.maximum(ends, supply), prepend=max(0, supply))


def permuted(i: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A bijection of 0..n-1 (n > 0): four Feistel rounds on the next power of four, walked until the value is below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = np.random.default_rng([seed & (2**63 - 1), n]).integers(1, 1 << 62, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    x = np.asarray(i, dtype=np.uint64).copy()
    live = np.ones(len(x), dtype=bool)
    while live.any():
        a, b = x[live] >> np.uint64(half), x[live] & low
        for k in keys:
            a, b = b, a ^ (((b + np.uint64(1)) * k >> np.uint64(29)) & low)
        x[live] = (a << np.uint64(half)) | b
        live = x >= np.uint64(n)
    return x.astype(np.int64)


def latest_sizes(stats: DataFrame) -> DataFrame:
    """(sample_id, lang, train_chars): the latest row of each sample and language, spellings of a language being one. Rows
    that total a sample, and unknown languages, are left out; of rows of one time the largest counts; null counts as 0."""
    return (
        stats.select("sample_id", language_code(F.col("lang")).alias("lang"), "measured_at", "train_chars")
        .where("sample_id IS NOT NULL AND lang IS NOT NULL")
        .groupBy("sample_id", "lang")
        .agg(F.max(F.struct("measured_at", "train_chars")).alias("m"))
        .select("sample_id", "lang", F.greatest(F.coalesce("m.train_chars", F.lit(0)), F.lit(0)).alias("train_chars"))
    )


def weights(ratios: Column) -> Column:
    """Of 'lang:weight,lang:weight' an array of (lang, weight as written) for pt, es and hi: the last weight of a language counts;
    entries without ':' or of another language are left out."""
    entries = F.transform(F.split(ratios, ","), lambda x: F.split(x, ":", 2))
    named = lambda code: F.filter(entries, lambda e: (F.trim(e[0]) == code) & (F.size(e) == 2))
    return F.array(*[F.struct(F.lit(c).alias("lang"), F.try_element_at(F.try_element_at(named(c), F.lit(-1)), F.lit(2)).alias("weight")) for c in LANGUAGES])


def plan_shares(plans: DataFrame, stats: DataFrame) -> DataFrame:
    """One row for each plan and language with a weight above 0: mix_id, lang, wanted_share, wanted_chars, train_chars, max_chars,
    used_chars, uses (how often the sample is used), share (of total_chars), actual_share (of what is used), short.

    A language gets what its weight asks of total_chars, at most max_repeats times its sample; one that cannot reach its share
    is short, and the others keep theirs, since every share of total_chars is then as near as can be. A sample that is
    missing has 0 characters. Plans without total_chars, max_repeats or a weight above 0 give no rows; a plan given
    twice gives each row once.
    """
    w = plans.select("mix_id", "sample_id", "total_chars", "max_repeats", F.explode(weights(F.col("lang_ratios"))).alias("x")).select(
        "mix_id", "sample_id", "total_chars", "max_repeats", "x.lang", F.expr("try_cast(trim(x.weight) AS decimal(24, 9))").alias("weight")
    )
    w = w.where("weight > 0 AND total_chars IS NOT NULL AND max_repeats IS NOT NULL").distinct()
    total = w.groupBy("mix_id").agg(F.sum("weight").alias("all_weights"))
    joined = w.join(total, "mix_id").join(latest_sizes(stats), ["sample_id", "lang"], "left")
    # weights are summed as decimals, so that the order of a plan's languages makes no difference
    part = F.col("weight").cast("double") / F.col("all_weights").cast("double")
    wanted = F.col("total_chars") * F.col("weight").cast("double") / F.col("all_weights").cast("double")
    return (
        joined.withColumn("train_chars", F.coalesce("train_chars", F.lit(0)))
        .withColumn("wanted_chars", wanted)
        .withColumn("max_chars", F.col("max_repeats") * F.col("train_chars"))
        .withColumn("short", F.col("wanted_chars") > F.col("max_chars"))
        .withColumn("used_chars", F.when(F.col("short"), F.col("max_chars")).otherwise(F.rint("wanted_chars").cast("long")))
        .withColumn("in_all", F.expr("sum(used_chars) OVER (PARTITION BY mix_id)"))
        .select(
            "mix_id", "lang",
            F.round(part, 9).alias("wanted_share"),
            "wanted_chars", "train_chars", "max_chars", "used_chars",
            F.round(F.when(F.col("train_chars") > 0, F.col("used_chars") / F.col("train_chars")).otherwise(F.lit(0.0)), 9).alias("uses"),
            F.round(F.when(F.col("total_chars") > 0, F.col("used_chars") / F.col("total_chars")).otherwise(F.lit(0.0)), 9).alias("share"),
            F.round(F.when(F.col("in_all") > 0, F.col("used_chars") / F.col("in_all")).otherwise(F.lit(0.0)), 9).alias("actual_share"),
            "short",
        )
    )


def plan_blocks(plans: DataFrame, stats: DataFrame, p: Mixing = Mixing()) -> DataFrame:
    """plan_shares with what the splitting tree makes of it: blocks (how many blocks of the source the plan asks for), shard_unplaced (of what
    each output shard is to draw, the characters for which the source, used as often as it may be, has no text left), used_blocks and
    shard_blocks (the blocks that are taken and how many of them each shard takes). A plan's languages, three at most, meet in
    one row; the plans stay distributed."""
    s = plan_shares(plans, stats).withColumn("need", F.ceil("wanted_chars"))
    s = s.withColumn("blocks", F.ceil(F.col("need") / F.lit(p.block_chars))).withColumn("used_blocks", F.ceil(F.col("used_chars") / F.lit(p.block_chars)))
    one = s.groupBy("mix_id").agg(F.array_sort(F.collect_list(F.struct("lang", "need", "blocks", "max_chars", "used_blocks"))).alias("q"))

    def run(it):
        for df in it:
            out: dict[str, list] = {"mix_id": [], "lang": [], "shard_unplaced": [], "shard_blocks": []}
            for m, q in zip(df["mix_id"].tolist(), df["q"]):
                seed, shards = p.seed * 1_000_003 + int(m), p.shards_for(sum(x["need"] for x in q))
                asked = split_quotas([x["blocks"] for x in q], shards, seed)
                missing = [unplaced(asked[:, i], x["need"], x["max_chars"], p.block_chars) for i, x in enumerate(q)]
                # where all can be placed the quotas stand; else what there is is split anew, so that no shard goes without
                taken = split_quotas([x["used_blocks"] for x in q], shards, seed) if any(x.any() for x in missing) else asked
                for i, x in enumerate(q):
                    out["mix_id"].append(m)
                    out["lang"].append(x["lang"])
                    out["shard_unplaced"].append(missing[i].tolist())
                    out["shard_blocks"].append(taken[:, i].tolist())
            yield pd.DataFrame(out)

    # drawing takes time and the plans are few rows: each task gets some
    split = spread(one).mapInPandas(run, "mix_id long, lang string, shard_unplaced array<long>, shard_blocks array<long>")
    return s.drop("need").join(split, ["mix_id", "lang"])


def unreachable(plans: DataFrame, stats: DataFrame, p: Mixing = Mixing()) -> DataFrame:
    """(mix_id, lang): the languages of a plan that cannot reach their share: those of whose quotas, split between the shards, some
    shard finds no text left."""
    return plan_blocks(plans, stats, p).where("exists(shard_unplaced, x -> x > 0)").select("mix_id", "lang").distinct()


def mix_records(docs: DataFrame, ratios: dict[str, float], total_chars: int | None = None, max_repeats: int = 4, p: Mixing = Mixing()) -> DataFrame:
    """(doc_id, lang, n_chars, copy, shard, place): a mixture of the records of docs(doc_id, text, lang, ...) itself.

    Without total_chars the mixture is as large as the records with text. Each language's records are cut into blocks by a
    hash; whole passes over the source come first, the last pass takes the part of its blocks that is wanted. Blocks are
    permuted and dealt to shards by the splitting tree; place is a random order within the shard. Records without text,
    doc_id or a known language are not used, a doc_id given twice is used as one. Only three sums go to the driver.
    """
    r = docs.where("doc_id IS NOT NULL AND text <> ''").select("doc_id", language_code(F.col("lang")).alias("lang"), F.char_length("text").alias("n"))
    r = r.where(F.col("lang").isin(*ratios)).groupBy("doc_id").agg(F.min(F.struct("lang", "n")).alias("x")).select("doc_id", "x.lang", "x.n")
    size = {x["lang"]: int(x["n"]) for x in r.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    total = sum(size.values()) if total_chars is None else total_chars
    whole = sum(w for w in ratios.values() if w > 0)
    langs = sorted(lang for lang in size if ratios[lang] > 0)
    blocks = {lang: -(-size[lang] // p.block_chars) for lang in langs}
    shards = p.shards_for(total)
    taken = {lang: min(round(total * ratios[lang] / whole * blocks[lang] / size[lang]), max_repeats * blocks[lang]) for lang in langs}
    quotas = split_quotas(np.array([taken[lang] for lang in langs], dtype=np.int64), shards, p.seed) if langs else np.zeros((shards, 0), np.int64)
    upto = {lang: np.cumsum(quotas[:, i]) for i, lang in enumerate(langs)}

    def run(it):
        for df in it:
            for lang, part in df.groupby("lang"):
                if lang not in upto or not taken[lang]:
                    continue
                n, most = blocks[lang], taken[lang]
                block = part["h"].to_numpy() % n
                for copy in range(-(-most // n)):
                    # the passes have different orders, and the last one takes the first of its order
                    at = permuted(block, n, p.seed * 7919 + copy) + copy * n
                    keep = at < most
                    place = permuted(at[keep], most, p.seed + 17)
                    yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[keep], "lang": lang, "n_chars": part["n"].to_numpy()[keep], "copy": copy, "shard": np.searchsorted(upto[lang], place, side="right")})

    dealt = r.select("doc_id", "lang", F.col("n").cast("long").alias("n"), F.pmod(F.xxhash64("doc_id", F.lit(p.seed)), F.lit((1 << 62) - 57)).alias("h")).mapInPandas(run, "doc_id long, lang string, n_chars long, copy int, shard int")
    return dealt.select("*", F.xxhash64("doc_id", "copy", "shard", F.lit(p.seed)).alias("place"))


def mixed_shares(mixed: DataFrame, ratios: dict[str, float]) -> DataFrame:
    """(lang, shard, records, chars, wanted_share, share): what a mixture came to, of each language and shard, and over all shards (shard null).
    Records are whole, so that shares are near the wanted ones and not equal to them; share is of the shard's characters."""
    whole = sum(w for w in ratios.values() if w > 0)
    wanted = F.create_map(*[F.lit(x) for lang, w in ratios.items() for x in (lang, round(max(w, 0.0) / whole, 9))])
    parts = mixed.groupBy("lang", "shard").agg(F.count(F.lit(1)).alias("records"), F.sum("n_chars").alias("chars"))
    every = parts.groupBy("lang").agg(F.sum("records").alias("records"), F.sum("chars").alias("chars")).select("lang", F.lit(None).cast("int").alias("shard"), "records", "chars")
    both = parts.unionByName(every)
    return both.select("lang", "shard", "records", "chars", wanted[F.col("lang")].alias("wanted_share"), F.round(F.col("chars") / F.expr("sum(chars) OVER (PARTITION BY shard)"), 9).alias("share"))
