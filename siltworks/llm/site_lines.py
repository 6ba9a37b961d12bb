"""Problem 4: lines repeated across one site's documents, by distributed PrefixSpan over sequences of line identifiers.

Every document is the sequence of its lines that enough documents of its site have; its own lines between them don't count.
Sequences that many documents share are one row with its number. PrefixSpan grows sequences of neighbours, level by level:
what is frequent at one level is extended by the line that follows, until a level has none. A line that always follows
another, which is itself never followed by anything else, adds nothing to a sequence: both are one step, so that a notice of
eighty lines is one level and not eighty. Only closed sequences are kept, those with no longer one in as many places; a
document of m such lines has m * m / 2 of them at most. All lines at the places of closed sequences are those to remove.
The levels are tables of (sequence, place), never a site's documents in one task: a hot site is spread like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions.text import SPACE_CLASS
from siltworks.operators.semijoin import having, joined_where_known, marked
from siltworks.storage import settle, spread


@dataclass(frozen=True)
class Repeats:
    documents: int = 6
    least_chars: int = 20


def plain_lines(text: Column) -> Column:
    """The lines of a text as they are compared: without digits of any script, lower case, white space as single blanks, none at the
    ends. The text is made plain as a whole, what ends a line excepted, and then cut."""
    bare = F.regexp_replace(F.lower(text), r"\p{Nd}+", "")
    blanks = SPACE_CLASS.replace(r"\t-\r", r"\t\x0b-\r")
    return F.split(F.regexp_replace(bare, f"[{blanks}]+", " "), "\n", -1)


@dataclass(frozen=True)
class Mined:
    #: (doc_id, line_nos, seq): documents with frequent lines, where those stand, and which sequence they are; seq is the least doc_id of it.
    documents: DataFrame
    #: (pattern, length, support, seq, begin, end): closed sequences, one row for each of their places in each different sequence.
    closed: DataFrame


def _sited(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL AND site IS NOT NULL").select("doc_id", "site", "text")


def _frequent(docs: DataFrame, p: Repeats) -> DataFrame:
    """(doc_id, line_no, item): the lines that stand in at least p.documents documents of their site."""
    lines = spread(_sited(docs)).select("doc_id", "site", F.posexplode(plain_lines(F.col("text"))).alias("at", "line")).withColumn("line", F.trim("line"))
    # lines are compared by two hashes; what is left has few enough for one
    rows = settle(lines.where(F.length("line") >= p.least_chars).select("doc_id", (F.col("at") + 1).cast("long").alias("line_no"), F.xxhash64("site", "line").alias("item"), F.xxhash64("line", "site").alias("check")))
    # rows of a line are at least its documents; what has enough of them is then counted exactly
    often = settle(rows.groupBy("item", "check").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= p.documents).select("item", "check"))
    found = settle(marked(rows, "item", often.select("item")).where("maybe").join(often, ["item", "check"]).select("doc_id", "line_no", "item").distinct())
    support = found.select("doc_id", "item").distinct().groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= p.documents)
    return found.join(support.select("item"), "item", "left_semi")


def _mine(docs: DataFrame, p: Repeats) -> Mined:
    own = _frequent(docs, p).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "item"))).alias("s"))
    own = settle(own.select("doc_id", F.col("s.line_no").alias("line_nos"), F.col("s.item").alias("items")))
    seqs = settle(own.groupBy("items").agg(F.min("doc_id").alias("seq"), F.count(F.lit(1)).alias("n")))
    documents = own.join(seqs.select("items", "seq"), "items").select("doc_id", "line_nos", "seq")

    # lines that always follow the same line, which nothing else ever follows, are steps of one
    total = seqs.select("n", F.explode("items").alias("item")).groupBy("item").agg(F.sum("n").alias("n"))
    pairs = seqs.select("n", F.explode(F.expr("transform(slice(items, 2, size(items)), (y, i) -> struct(items[i] AS x, y))")).alias("p"))
    pairs = pairs.groupBy("p.x", "p.y").agg(F.sum("n").alias("c"))
    bound = pairs.join(total.toDF("x", "nx"), "x").join(total.toDF("y", "ny"), "y").where("c = nx AND c = ny").select(F.col("y").alias("item"))
    steps = seqs.select("seq", "n", F.size("items").alias("size"), F.posexplode("items").alias("at", "item")).join(bound, "item", "left_anti")
    steps = settle(steps.groupBy("seq", "n", "size").agg(F.array_sort(F.collect_list(F.struct("at", "item"))).alias("s")).select("seq", "n", "size", F.col("s.at").alias("at"), F.col("s.item").alias("h")))

    k, going = 1, steps.select("seq", F.expr("sequence(0, size(h) - 1)").alias("ok"))
    levels: list[tuple[DataFrame, DataFrame]] = []
    while True:
        place = F.expr(f"struct(slice(h, i + 1, {k}) AS pattern, at[i] AS begin, CASE WHEN i + {k} < size(h) THEN at[i + {k}] ELSE size END AS end)")
        here = steps.join(going, "seq").select("seq", "n", "size", "at", "h", F.explode("ok").alias("i")).select("seq", "n", "i", place.alias("x")).select("seq", "n", "i", "x.*")
        once = here.groupBy("pattern", "seq").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("c"))
        good = once.groupBy("pattern").agg(F.sum("n").alias("support"), F.sum(F.col("n") * F.col("c")).alias("places"))
        good = settle(good.where(F.col("support") >= p.documents))
        if good.isEmpty():
            break
        kept = settle(here.join(good, "pattern").select("pattern", "support", "places", "seq", "i", "begin", "end"))
        levels.append((good, kept))
        ok = kept.groupBy("seq").agg(F.collect_set("i").alias("ok"))
        going = ok.select("seq", F.expr("filter(ok, i -> array_contains(ok, i + 1))").alias("ok")).where("size(ok) > 0")
        k += 1
    closed = None
    for k, (_, kept) in enumerate(levels, 1):
        if k < len(levels):
            longer = levels[k][0]
            ends = longer.select(F.slice("pattern", 1, k).alias("pattern"), "places").union(longer.select(F.slice("pattern", 2, k), "places")).distinct()
            kept = kept.join(ends, ["pattern", "places"], "left_anti")
        part = kept.select("pattern", (F.col("end") - F.col("begin")).alias("length"), "support", "seq", "begin", "end")
        closed = part if closed is None else closed.union(part)
    if closed is None:
        closed = seqs.where("false").selectExpr("items AS pattern", "0 AS length", "n AS support", "seq", "0 AS begin", "0 AS end")
    return Mined(documents, settle(closed))


def repeated_lines(docs: DataFrame, p: Repeats = Repeats()) -> DataFrame:
    """(doc_id, line_no, longest): the lines of docs(doc_id, text, site, ...) at the places of closed frequent sequences of their site, with the
    length of the longest of them.

    Frequent: in at least p.documents documents of the site. A line that is frequent by itself is a sequence of one, or all its places are
    places of a longer one, so that every occurrence of a frequent line is at a place of a closed sequence. Documents without site
    or text and lines with fewer than p.least_chars characters once compared are in none. Repeated rows of a doc_id are one document.
    An empty table gives an empty result.
    """
    m = _mine(docs, p)
    cover = m.closed.select("seq", "length", F.explode(F.expr("sequence(begin, end - 1)")).alias("at")).groupBy("seq", "at").agg(F.max("length").alias("longest"))
    by = cover.groupBy("seq").agg(F.map_from_entries(F.collect_list(F.struct("at", "longest"))).alias("longest"))
    rows = m.documents.join(by, "seq").select("doc_id", "longest", F.posexplode("line_nos").alias("at", "line_no"))
    return rows.select("doc_id", "line_no", F.element_at("longest", F.col("at")).alias("longest")).where("longest IS NOT NULL")


def frequent_sequences(docs: DataFrame, p: Repeats = Repeats()) -> DataFrame:
    """(site, length, lines, support): the closed frequent sequences of each site, lines as they are compared, joined by ' / ', with the number
    of documents that have them in a row (their own lines between them aside). The lines are read from one document of each."""
    m = _mine(docs, p)
    shown = m.closed.groupBy("pattern").agg(F.max("length").alias("length"), F.max("support").alias("support"), F.min(F.struct("seq", "begin", "end")).alias("x"))
    shown = shown.select("length", "support", F.col("x.seq").alias("doc_id"), "x.begin", "x.end").join(m.documents.select("doc_id", "line_nos"), "doc_id")
    shown = settle(shown.select("doc_id", "length", "support", F.expr("slice(line_nos, begin + 1, end - begin)").alias("line_nos")))
    texts = having(_sited(docs), "doc_id", shown.select("doc_id").distinct()).dropDuplicates(["doc_id"]).select("doc_id", "site", plain_lines(F.col("text")).alias("all"))
    lines = F.expr("array_join(transform(line_nos, i -> trim(all[cast(i - 1 AS int)])), ' / ')")
    return texts.join(shown, "doc_id").select("site", "length", lines.alias("lines"), "support")


def without_repeated_lines(docs: DataFrame, p: Repeats = Repeats()) -> DataFrame:
    """(doc_id, text): each text without its repeated lines, the others unchanged and in order; null stays null. Texts without repeated
    lines stay where they are."""
    marks = settle(repeated_lines(docs, p).groupBy("doc_id").agg(F.collect_set("line_no").alias("drop")))
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("drop", (i + 1).cast("long")))
    joined = joined_where_known(docs.select("doc_id", "text"), "doc_id", marks)
    return joined.select("doc_id", F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
