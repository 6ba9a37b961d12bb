"""Problem 5: near-duplicate records with small edits, by tensored banding.

A table key is a pair of half keys, one from each of two small collections: `left` half keys of three minhashes and
`right` half keys of two give left*right table keys from 3*left + 2*right minhashes, where independent tables of five
hashes would need 5*left*right. The pairs of half keys are only formed where the left half already agrees, so that
most of them are never written.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm import textnum as tn
from siltworks.operators.blocks import candidate_pairs
from siltworks.operators.components import components
from siltworks.operators.semijoin import having
from siltworks.storage import settle, spread


@dataclass(frozen=True)
class Banding:
    words: int = 5
    left: int = 18
    right: int = 10
    left_rows: int = 3
    right_rows: int = 2
    seed: int = 5
    similarity: float = 0.6
    #: Characters of texts that one task holds to verify pairs.
    verify_chars: int = 4_000_000

    def recall(self, s: float) -> float:
        """Probability that a pair of similarity s shares a table key."""
        return (1 - (1 - s**self.left_rows) ** self.left) * (1 - (1 - s**self.right_rows) ** self.right)


def _shingles(texts: list[str], n: int, powers: tn.Powers, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    words, counts = tn.words_of([t.lower() for t in texts], powers, table)
    if len(words) < n:
        return words, counts, words[:0], np.zeros(len(counts), dtype=np.int64)
    x = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for i in range(n):
        x = tn.mix(x * np.uint64(0xD6E8FEB86659FD93) + words[i : len(words) - n + 1 + i])
    per = np.maximum(counts - n + 1, 0)
    first = np.cumsum(counts) - counts
    inside = np.repeat(first - (np.cumsum(per) - per), per) + np.arange(per.sum())
    return words, counts, x[inside], per


def _signatures(p: Banding):
    def run(it):
        powers, table = tn.Powers(), tn.space_table()
        rng = np.random.default_rng(p.seed)
        k = p.left * p.left_rows + p.right * p.right_rows
        mul = rng.integers(1, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for b, texts in tn.batches(it):
            words, counts, x, per = _shingles(texts, p.words, powers, table)
            has = per > 0
            if not has.any():
                continue
            starts = (np.cumsum(per) - per)[has]
            mins = [np.minimum.reduceat(x * m, starts) for m in mul]
            half = []
            for i in range(p.left + p.right):
                rows, at = (p.left_rows, i * p.left_rows) if i < p.left else (p.right_rows, p.left * p.left_rows + (i - p.left) * p.right_rows)
                key = np.full(len(starts), i + 1, dtype=np.uint64)
                for m in mins[at : at + rows]:
                    key = tn.mix(key * np.uint64(0x9E3779B97F4A7C15) + m)
                half.append(key)
            left = np.stack(half[: p.left], axis=1).view(np.int64).ravel()
            right = (np.stack(half[p.left :], axis=1) >> np.uint64(33)).astype(np.int32).ravel()
            h = tn.prefix_hash(words, powers)
            first = (np.cumsum(counts) - counts)[has]
            last = first + counts[has]
            f1 = tn.range_hash(h, first, last, powers)
            h2 = tn.prefix_hash(tn.mix(words ^ np.uint64(0x5851F42D4C957F2D)), powers)
            f2 = tn.range_hash(h2, first, last, powers)
            n = len(starts)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").filter(pa.array(has)),
                    pa.array(f1.view(np.int64)),
                    pa.array(f2.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * p.left), pa.array(left)),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * p.right), pa.array(right)),
                ],
                names=["doc_id", "f1", "f2", "lefts", "rights"],
            )

    return run


def _verify(p: Banding):
    """Of the pairs (a, b) of one part and the texts of that part, each given once: the similar pairs."""

    def run(pairs: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        powers, table = tn.Powers(), tn.space_table()
        ids, texts = docs["doc_id"].to_numpy(), docs["text"].tolist()
        sets: list[np.ndarray] = []
        for i, j in tn.chunks(texts):
            _, _, x, n = _shingles(texts[i:j], p.words, powers, table)
            ends = np.cumsum(n)
            sets += [np.unique(x[e - k : e]) for e, k in zip(ends, n)]
        order = np.argsort(ids)
        at = {c: order[np.searchsorted(ids, pairs[c].to_numpy(), sorter=order)] for c in ("a", "b")}
        sim, keep = np.zeros(len(pairs)), np.zeros(len(pairs), dtype=bool)
        for r, (i, j) in enumerate(zip(at["a"].tolist(), at["b"].tolist())):
            x, y = sets[i], sets[j]
            # no pair of sets of such different sizes can be similar enough
            if not len(x) or not len(y) or min(len(x), len(y)) < p.similarity * max(len(x), len(y)) - 1e-9:
                continue
            both = np.concatenate((x, y))
            both.sort()
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            either = len(both) - common
            sim[r], keep[r] = common / either, common > 0 and common >= p.similarity * either - 1e-9
        return pairs[["a", "b"]].assign(similarity=sim)[keep]

    return run


def classes_and_links(docs: DataFrame, p: Banding = Banding()) -> tuple[DataFrame, DataFrame]:
    """(members, links) of the records of docs(doc_id, text, ...).

    members(doc_id, rep): every record of at least `words` words with the least doc_id of the records that have the same
    words (case and white space aside). links(a, b, similarity): all verified pairs a < b of different representatives
    whose sets of `words` consecutive words have a Jaccard similarity of at least `similarity`. Null, empty and short
    texts are in neither. Other columns are ignored; an empty table gives empty results. A doc_id given twice counts once.
    """
    texts = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    sig = settle(
        spread(texts).mapInArrow(_signatures(p), "doc_id long, f1 long, f2 long, lefts array<long>, rights array<int>"),
        "none",
    )
    reps = sig.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"))
    members = settle(sig.select("doc_id", "f1", "f2").join(reps, ["f1", "f2"]).select("doc_id", "rep").distinct())
    distinct = sig.join(members.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi")
    distinct = settle(distinct.select("doc_id", "lefts", "rights").dropDuplicates(["doc_id"]), "none")
    # half keys that stand alone are dropped before their pairs are formed; counts have map-side sums, so that a hot one is no task of its own
    several = distinct.select(F.explode("lefts").alias("l")).groupBy("l").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("l")
    agreeing = distinct.select("doc_id", "rights", F.explode("lefts").alias("l")).join(several, "l")
    keyed = settle(agreeing.select("l", "doc_id", F.posexplode("rights").alias("j", "r")))
    pairs = settle(candidate_pairs(keyed, ["l", "j", "r"], "doc_id", group="g"))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    some = settle(having(texts, "doc_id", settle(ids)).dropDuplicates(["doc_id"]))
    # a block's pairs are verified together, its texts are sent once for all of them
    need = pairs.select("g", F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    chars = need.join(some.select("doc_id", F.length("text").alias("n")), "doc_id").agg(F.sum("n")).first()[0] or 0
    parts = max(8, int(chars // p.verify_chars) + 1)
    tasks = min(parts, 20000)
    part = F.pmod("g", F.lit(parts)).alias("part")
    held = need.select(part, "doc_id").distinct().join(some, "doc_id").repartition(tasks, "part")
    links = pairs.select(part, "a", "b").repartition(tasks, "part").groupBy("part").cogroup(held.groupBy("part")).applyInPandas(_verify(p), "a long, b long, similarity double")
    return members, links


def across_classes(members: DataFrame, links: DataFrame, block: int = 64) -> DataFrame:
    """links(a, b, ...) with x and y: a row for every member x of the class of a and y of that of b. Classes meet in blocks of about `block`
    members, so that a large one is no key of a single task."""
    parts = members.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("parts")).where("parts > 1")
    own = F.pmod(F.xxhash64("doc_id"), F.coalesce("parts", F.lit(1))).cast("int")
    placed = members.join(parts, "rep", "left").select("rep", own.alias("own"), "doc_id")
    met = links
    for side in ("a", "b"):
        blocks = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
        met = met.join(parts.withColumnRenamed("rep", side), side, "left").withColumn(f"{side}_own", blocks).drop("parts")
    return met.join(placed.toDF("a", "a_own", "x"), ["a", "a_own"]).join(placed.toDF("b", "b_own", "y"), ["b", "b_own"]).drop("a_own", "b_own")


def expand(members: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs (doc_id_a < doc_id_b) of documents: all pairs inside the classes, and of each link of two representatives all pairs of the
    members of their classes. Classes meet block by block, whatever their size."""
    across = across_classes(members, links.select("a", "b")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b")
    return candidate_pairs(members, ["rep"], "doc_id").union(across).distinct().toDF("doc_id_a", "doc_id_b")


def linked_members(members: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, rep, links): members with how many other records each is linked to: those of the classes that its representative's links
    lead to, and its own copies. The links between representatives and this table are all pairs, without listing them."""
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    ends = links.select("a", F.col("b").alias("rep")).union(links.select("b", "a"))
    others = ends.join(sizes, "rep").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    own = sizes.join(others, "rep", "left").select("rep", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    return members.join(own, "rep").select("doc_id", "rep", "links")


def near_duplicate_pairs(docs: DataFrame, p: Banding = Banding()) -> DataFrame:
    """(doc_id_a, doc_id_b): all pairs of records of similarity p.similarity or more, copies among them; see classes_and_links."""
    members, links = classes_and_links(docs, p)
    return expand(members, settle(links))


def near_duplicate_members(docs: DataFrame, p: Banding = Banding()) -> DataFrame:
    """(doc_id, rep, links): one row for each record of at least p.words words: the least doc_id of the records of the same words, and how
    many other records are similar to it, copies included."""
    members, links = classes_and_links(docs, p)
    return linked_members(members, settle(links))


def near_duplicate_links(docs: DataFrame, p: Banding = Banding()) -> DataFrame:
    """(rep_a, rep_b, similarity): the similar pairs of different texts, by the least doc_id of each text (near_duplicate_members)."""
    _, links = classes_and_links(docs, p)
    return links.select(F.col("a").alias("rep_a"), F.col("b").alias("rep_b"), F.round("similarity", 6).alias("similarity"))


def near_duplicate_groups(docs: DataFrame, p: Banding = Banding()) -> DataFrame:
    """(doc_id, group_id, links): one row per record; group_id is the least doc_id of all records linked to it, directly or
    through others, links the number of other different texts it is linked to plus the copies it has. Records without
    text, or shorter than p.words words, are groups of their own with no links; null doc_ids are left out."""
    members, links = classes_and_links(docs, p)
    links = settle(links)
    roots = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("others"))
    sized = members.join(members.groupBy("rep").agg((F.count(F.lit(1)) - 1).alias("copies")), "rep")
    known = (
        sized.join(roots.withColumnRenamed("id", "rep"), "rep", "left")
        .join(degree, "rep", "left")
        .select("doc_id", F.coalesce("root", "rep").alias("group_id"), (F.coalesce("others", F.lit(0)) + F.col("copies")).alias("links"))
    )
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").distinct()
    return ids.join(known, "doc_id", "left").select("doc_id", F.coalesce("group_id", "doc_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
