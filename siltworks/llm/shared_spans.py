"""Problem 8: long exact spans shared between records, by compressed FM-indexes over shards.

Anchors (the least of the hashes of `gram` characters in every run of `least` - `gram` + 1 of them) are chosen by content
alone, so any two records with `least` characters in common have an anchor in common. The pieces of text around anchors
that several records have meet in shards of bounded size. A shard indexes some of its pieces and streams others against
the index: backward search over the wavelet matrix gives matching statistics at every `stride`-th place, as far as
`least` - `stride` + 1 characters. Where they get there, the places that match are located; those of one diagonal that
follow each other are one run, whose two ends alone are looked for character by character, over `stride` of them at most.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm import textnum as tn
from siltworks.llm.fm_index import FMIndex
from siltworks.llm.near_duplicates import expand, linked_members
from siltworks.operators.blocks import block_groups
from siltworks.operators.semijoin import marked
from siltworks.storage import settle, spread


@dataclass(frozen=True)
class Spans:
    least: int = 300
    gram: int = 150
    stride: int = 64
    #: Longer stretches of text around anchors are cut to pieces of about so many characters that overlap by `least`.
    piece: int = 30_000
    #: Characters of the pieces that share an anchor which are indexed together; larger groups meet block by block.
    block_chars: int = 600_000
    #: Characters of a shard, that of one block or of several small groups.
    shard_chars: int = 600_000
    #: Places that are located and joined to runs at a time.
    hits: int = 2_000_000


def _anchors(p: Spans):
    def run(it):
        powers = tn.Powers()
        w = p.least - p.gram + 1
        for b, texts in tn.batches(it):
            ids = np.asarray(b.column("doc_id"))
            lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
            cp = tn.code_points("".join(texts)).astype(np.uint64) + np.uint64(1)
            h = tn.prefix_hash(cp, powers)
            ends = np.cumsum(lengths)
            begins = ends - lengths
            f1 = tn.range_hash(h, begins, ends, powers).view(np.int64)
            h2 = tn.prefix_hash(tn.mix(cp), powers)
            f2 = tn.range_hash(h2, begins, ends, powers).view(np.int64)
            n = len(cp) - p.gram + 1
            chosen, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            if n > 0:
                at = np.arange(n)
                grams = tn.range_hash(h, at, at + p.gram, powers)
                for r in np.flatnonzero(lengths >= p.least):
                    g = grams[begins[r] : ends[r] - p.gram + 1]
                    low = tn.sliding(g, w, np.minimum)
                    # position i is chosen if it is the least of some window that holds it
                    top = tn.sliding(np.pad(low, w - 1), w, np.maximum)
                    keys = np.unique(g[np.flatnonzero(top == g)])
                    chosen.append(keys.view(np.int64))
                    of.append(np.full(len(keys), r))
            of, chosen = np.concatenate(of), np.concatenate(chosen)
            counts = np.bincount(of, minlength=len(texts)) if len(of) else np.zeros(len(texts), np.int64)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(f1), pa.array(f2), pa.array(lengths), pa.ListArray.from_arrays(pa.array(offsets), pa.array(chosen))],
                names=["doc_id", "f1", "f2", "n", "anchors"],
            )

    return run


def _pieces(p: Spans):
    """Of each (doc_id, text, keys): the merged regions around the anchors in keys, cut to pieces, with where they start and the anchors
    that are wholly in them. Any `least` characters of a region are wholly in one of its pieces."""

    def run(it):
        powers = tn.Powers()
        reach = p.least - p.gram
        for b in it:
            out: dict[str, list] = {"doc_id": [], "at": [], "region": [], "anchors": []}
            keys = b.column("keys")
            for r, (doc, text) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())):
                cp = tn.code_points(text).astype(np.uint64) + np.uint64(1)
                h = tn.prefix_hash(cp, powers)
                at = np.arange(len(cp) - p.gram + 1)
                grams = tn.range_hash(h, at, at + p.gram, powers).view(np.int64)
                hit = np.flatnonzero(np.isin(grams, np.asarray(keys[r].values)))
                begin, end = np.maximum(hit - reach, 0), np.minimum(hit + p.gram + reach, len(text))
                new = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
                stop = np.concatenate([new[1:] - 1, [len(hit) - 1]])
                for x, y in zip(begin[new].tolist(), end[stop].tolist()):
                    for u in range(x, max(y - p.least, x) + 1, p.piece):
                        v = min(u + p.piece + p.least, y)
                        own = hit[np.searchsorted(hit, u) : np.searchsorted(hit, v - p.gram, side="right")]
                        out["doc_id"].append(doc)
                        out["at"].append(u)
                        out["region"].append(text[u:v])
                        out["anchors"].append(np.unique(grams[own]))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("region", pa.string()), ("anchors", pa.list_(pa.int64()))]))

    return run


def _extend(q: np.ndarray, x: np.ndarray, t: np.ndarray, y: np.ndarray, way: int, most: int) -> np.ndarray:
    """How far, up to `most`, q matches from x on and t from y on, going right (way 1) or left (way -1); separators (0) never match."""
    step = np.arange(most) * way + most
    q, t = (np.concatenate([np.zeros(most, v.dtype), v, np.zeros(most, v.dtype)]) for v in (q, t))
    a, b = q[x[:, None] + step], t[y[:, None] + step]
    same = (a == b) & (a != 0)
    return np.where(same.all(axis=1), most, np.argmin(same, axis=1))


def _merged(d: np.ndarray, x: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (diagonal, begin, end) with those that touch or overlap on a diagonal as one."""
    if not len(d):
        return d, x, end
    order = np.lexsort((x, d))
    d, x, end = d[order], x[order], end[order]
    # the furthest end so far on the diagonal: diagonals are far apart once each has its own offset
    far = int(end.max() - x.min()) + 2
    off = np.cumsum(np.concatenate([[0], d[1:] != d[:-1]])) * far
    reach = np.maximum.accumulate(end + off) - off
    new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (x[1:] > reach[:-1])]))
    return d[new], x[new], reach[np.concatenate([new[1:] - 1, [len(d) - 1]])]


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points plus one, 0 after each text; where each text begins; the text of each place)."""
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    begins = np.cumsum(lengths) - lengths
    cp = tn.code_points(" ".join(texts) + " " * bool(texts)) + np.uint32(1)
    cp[begins + lengths - 1] = 0
    return cp, begins, np.repeat(np.arange(len(texts)), lengths)


def find_spans(docs: np.ndarray, at: np.ndarray, texts: list[str], p: Spans, indexed: np.ndarray | None = None, streamed: np.ndarray | None = None) -> pd.DataFrame:
    """The runs of `least` characters or more that a streamed and an indexed text of different docs share, none of which can be extended:
    (a, a_at, b, b_at, n), a < b. Without marks all texts are indexed and streamed."""
    names = ("a", "a_at", "b", "b_at", "n")
    every = np.ones(len(texts), dtype=bool)
    rows_t, rows_q = (np.flatnonzero(every if m is None else m) for m in (indexed, streamed))
    none = pd.DataFrame({c: np.zeros(0, np.int64) for c in names})
    if not len(rows_t) or not len(rows_q) or len(np.unique(docs)) < 2:
        return none
    t, begin_t, row_t = _joined([texts[i] for i in rows_t])
    q, begin_q, row_q = _joined([texts[i] for i in rows_q])
    values, s = np.unique(np.concatenate([t, q]), return_inverse=True)
    t, q = s[: len(t)].astype(np.int64), s[len(t) :].astype(np.int64)
    fm = FMIndex(t, len(values))
    both = np.isin(rows_q, rows_t)
    # every stride-th place of a streamed text, from its end on, that has `need` characters before it
    need = p.least - p.stride + 1
    length = np.diff(np.append(begin_q, len(q)))
    ends = np.concatenate([np.arange(b + n - 1, b + need - 1, -p.stride)[::-1] for b, n in zip(begin_q, length)] or [np.zeros(0, np.int64)])
    n, lo, hi = fm.statistics(q, ends, np.full(len(ends), need))
    # a text that is indexed too always finds itself
    live = np.flatnonzero((n == need) & (hi - lo > both[row_q[ends - 1]]))
    if not len(live):
        return none
    size = hi[live] - lo[live]
    part = np.cumsum(size) // p.hits
    runs = [np.zeros(0, np.int64)] * 3
    doc_q, doc_t, both_t = docs[rows_q], docs[rows_t], np.isin(rows_t, rows_q)
    for k in np.unique(part):
        mine, of = live[part == k], size[part == k]
        x = np.repeat(ends[mine] - need, of)
        y = fm.locate(np.repeat(lo[mine], of) + np.arange(of.sum()) - np.repeat(np.cumsum(of) - of, of))
        i, j = row_q[x], row_t[y]
        # of two texts that are both indexed and streamed, one way is enough
        keep = (doc_q[i] != doc_t[j]) & ((doc_q[i] < doc_t[j]) | ~(both[i] & both_t[j]))
        d, x, end = _merged((y - x)[keep], x[keep], x[keep] + need)
        if len(x):
            left = _extend(q, x - 1, t, x + d - 1, -1, p.stride)
            right = _extend(q, end, t, end + d, 1, p.stride)
            # what was cut between two parts overlaps once extended
            runs = list(_merged(*(np.concatenate(z) for z in zip(runs, (d, x - left, end + right)))))
    d, x, end = runs
    keep = end - x >= p.least
    d, x, n = d[keep], x[keep], (end - x)[keep]
    y = x + d
    i, j = row_q[x], row_t[y]
    da, db = doc_q[i], doc_t[j]
    pa_, pb = at[rows_q[i]] + x - begin_q[i], at[rows_t[j]] + y - begin_t[j]
    swap = da > db
    out = pd.DataFrame({"a": np.where(swap, db, da), "a_at": np.where(swap, pb, pa_), "b": np.where(swap, da, db), "b_at": np.where(swap, pa_, pb), "n": n})
    return out.drop_duplicates()


def _shard(p: Spans):
    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.groupby(["doc_id", "at"], sort=True).agg({"region": "first", "indexed": "any", "streamed": "any"}).reset_index()
        return find_spans(df["doc_id"].to_numpy(), df["at"].to_numpy(), df["region"].tolist(), p, df["indexed"].to_numpy(), df["streamed"].to_numpy())

    return run


def _whole_runs(found: DataFrame) -> DataFrame:
    """Spans of several shards as whole runs: those that overlap on one diagonal of two records are parts of one run."""
    on = "PARTITION BY a, b, b_at - a_at ORDER BY a_at, n"
    first = found.withColumn("new", F.expr(f"CASE WHEN a_at <= max(a_at + n) OVER ({on} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END"))
    runs = first.withColumn("run", F.expr(f"sum(new) OVER ({on} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")).withColumn("shift", F.expr("b_at - a_at"))
    whole = runs.groupBy("a", "b", "shift", "run").agg(F.min("a_at").alias("a_at"), F.max(F.expr("a_at + n")).alias("end"))
    return whole.select("a", "a_at", "b", F.expr("a_at + shift").alias("b_at"), F.expr("end - a_at").alias("n"))


def _classes(docs: DataFrame, p: Spans) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, signatures, members); see classes_and_spans."""
    texts = docs.select("doc_id", "text").where(f"doc_id IS NOT NULL AND length(text) >= {p.least}")
    sig = settle(spread(texts).mapInArrow(_anchors(p), "doc_id long, f1 long, f2 long, n long, anchors array<long>"), "none")
    reps = sig.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"))
    members = settle(sig.select("doc_id", "f1", "f2", "n").join(reps, ["f1", "f2", "n"]).select("doc_id", "rep").distinct())
    return texts, sig, members


def classes_and_found(docs: DataFrame, p: Spans = Spans()) -> tuple[DataFrame, DataFrame]:
    """As classes_and_spans, but a long span may come in parts, each of at least p.least characters, and more than once."""
    texts, sig, members = _classes(docs, p)
    each = sig.join(members.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi").select("doc_id", F.explode("anchors").alias("h"))
    common = each.groupBy("h").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x <> y").select("h")
    keys = settle(each.join(common, "h").groupBy("doc_id").agg(F.collect_set("h").alias("keys")))
    near = marked(texts, "doc_id", keys.select("doc_id")).where("maybe").drop("maybe").dropDuplicates(["doc_id"]).join(keys, "doc_id")
    pieces = settle(near.mapInArrow(_pieces(p), "doc_id long, at long, region string, anchors array<long>"))
    held = pieces.select("doc_id", "at", F.length("region").alias("size"), F.explode("anchors").alias("h"))
    # the pieces that have an anchor belong to the least of them
    piece = F.struct("doc_id", "at")
    roots = held.groupBy("h").agg(F.min(piece).alias("root"), F.max("doc_id").alias("last")).where("root.doc_id <> last").select("h", "root")
    groups = held.join(roots, "h").select("root", piece.alias("piece"), "size").distinct()
    met = block_groups(groups, ["root"], "piece", p.block_chars, "size").select("root", "bi", "bj", "own", "piece.doc_id", "piece.at", "size")
    met = settle(met)
    shards = max(8, int((met.agg(F.sum("size")).first()[0] or 0) // p.shard_chars) + 1)
    placed = met.select(
        F.pmod(F.xxhash64("root", "bi", "bj"), F.lit(shards)).alias("shard"), "doc_id", "at", (F.col("own") == F.col("bj")).alias("indexed"), (F.col("own") == F.col("bi")).alias("streamed")
    )
    found = (
        placed.join(pieces.select("doc_id", "at", "region"), ["doc_id", "at"])
        .repartition(min(shards, 20000), "shard")
        .groupBy("shard")
        .applyInPandas(_shard(p), "a long, a_at long, b long, b_at long, n long")
    )
    return members, found


def classes_and_spans(docs: DataFrame, p: Spans = Spans()) -> tuple[DataFrame, DataFrame]:
    """(members, spans) of the records of docs(doc_id, text, ...).

    members(doc_id, rep): records of at least `least` characters with the least doc_id of those with the same text.
    spans(a, a_at, b, b_at, n): runs of n >= least characters that two different representatives a < b share, from
    character a_at and b_at (from 0), none of which can be extended. Null and shorter texts are in neither, other columns are
    ignored, a doc_id given twice counts once.
    """
    members, found = classes_and_found(docs, p)
    return members, _whole_runs(found)


def shared_span_pairs(docs: DataFrame, p: Spans = Spans()) -> DataFrame:
    """(doc_id_a, doc_id_b): all pairs of records whose texts have p.least characters in a row in common, copies among them."""
    members, found = classes_and_found(docs, p)
    return expand(members, settle(found.select("a", "b").distinct()))


def shared_span_members(docs: DataFrame, p: Spans = Spans()) -> DataFrame:
    """(doc_id, rep, links): one row for each record that shares p.least characters with another: the least doc_id of the records of the
    same text, and how many other records share some with it, its copies included."""
    members, found = classes_and_found(docs, p)
    return linked_members(members, settle(found.select("a", "b").distinct()))


def shared_passages(docs: DataFrame, p: Spans = Spans()) -> DataFrame:
    """(rep_a, at_a, rep_b, at_b, n_chars): the passages, between different texts: runs of p.least characters or more that can't be
    extended, from characters at_a and at_b (from 0) of the texts of the records rep_a < rep_b, each the least doc_id of those with its text
    (shared_span_members has which records those are)."""
    _, spans = classes_and_spans(docs, p)
    return spans.toDF("rep_a", "at_a", "rep_b", "at_b", "n_chars")


def shared_parts(docs: DataFrame, p: Spans = Spans()) -> DataFrame:
    """(doc_id, n_chars, shared_chars, share): of each record, how many characters lie in a run of p.least or more that also
    stands in another record; a record with a copy is shared as a whole if it has p.least characters. Null and empty
    texts have 0 characters and share 0."""
    members, spans = classes_and_spans(docs, p)
    spans = settle(spans)
    several = members.groupBy("rep").agg(F.count(F.lit(1)).alias("same"))
    part = spans.select(F.col("a").alias("rep"), F.col("a_at").alias("x"), (F.col("a_at") + F.col("n")).alias("y")).union(
        spans.select("b", "b_at", F.col("b_at") + F.col("n"))
    )
    # merged length of intervals: what each adds beyond the furthest end before it
    before = F.expr("max(y) OVER (PARTITION BY rep ORDER BY x, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    cover = part.distinct().withColumn("before", before).groupBy("rep").agg(
        F.sum(F.greatest(F.col("y") - F.greatest("x", F.coalesce("before", F.lit(0))), F.lit(0))).alias("shared")
    )
    known = members.join(several, "rep").join(cover, "rep", "left").select("doc_id", "same", "shared")
    return (
        docs.where("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("n_chars"))
        .join(known, "doc_id", "left")
        .withColumn("shared_chars", F.when(F.col("same") > 1, F.col("n_chars")).otherwise(F.coalesce("shared", F.lit(0))))
        .select("doc_id", "n_chars", "shared_chars", F.round(F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(F.lit(0.0)), 6).alias("share"))
    )
