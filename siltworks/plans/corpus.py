"""Queries over the corpus: reading, statistics, duplicates, samples, shards, packed windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions import chat
from siltworks.functions.text import LANGUAGES, byte_pieces, code_points, language_code, shingles, utf8_bytes, word_count
from siltworks.operators import dedup, sampling, shards, windows
from siltworks.operators.prefix import running_total
from siltworks.sources import readers
from siltworks.storage import load, settle

# The same class of white space as functions.text.SPACE_CLASS, in the SQL dialect.
WHITE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
LANG = """CASE regexp_replace(lower(trim(lang)), '-.*$', '') WHEN 'pt' THEN 'pt' WHEN 'por_latn' THEN 'pt' WHEN 'es' THEN 'es'
  WHEN 'spa_latn' THEN 'es' WHEN 'hi' THEN 'hi' WHEN 'hin_deva' THEN 'hi' END"""
DOCS = f"d AS (SELECT doc_id, text, {LANG} AS lang, source, source_id, site FROM documents)"
WORDS = f"len(list_filter(regexp_split_to_array(text, '{WHITE}'), lambda w: w <> ''))"
RATIOS = {"pt": 1.0, "es": 1.0, "hi": 2.0}
CAPS = {"train": 400_000, "heldout": 40_000}
BLOCK, EOS, SEED = 1024, 0, 42


def docs(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "documents").select("doc_id", "text", language_code(F.col("lang")).alias("lang"), "source", "source_id", "site")


def filled(s: SparkSession, d: str) -> DataFrame:
    """Records with text and a known language, with their bytes."""
    return docs(s, d).where("text <> '' AND lang IS NOT NULL").withColumn("bytes", utf8_bytes(F.col("text")).cast("long"))


def corpus_stats_rollup(s: SparkSession, d: str) -> DataFrame:
    t = docs(s, d).where("text <> ''")
    rows = t.select("lang", word_count(F.col("text")).alias("w"), utf8_bytes(F.col("text")).alias("b"), code_points(F.col("text")).alias("c"))
    out = rows.rollup("lang").agg(F.grouping("lang").alias("g"), F.count(F.lit(1)).alias("docs"), F.sum("w").alias("words"), F.sum("b").alias("bytes"), F.sum("c").alias("chars"))
    name = F.when(F.col("g") == 1, "overall").otherwise(F.coalesce("lang", F.lit("unknown")))
    return out.select(name.alias("lang"), "docs", "words", "bytes", "chars", F.round(F.col("bytes") / F.when(F.col("words") > 0, F.col("words")), 6).alias("bytes_per_word"))


def source_union_limit(s: SparkSession, d: str) -> DataFrame:
    """The first 100 records of each source, chained in the order of the registry."""
    specs = load(s, d, "source_specs").select("row_name", "lang").orderBy("lang", "row_name").collect()
    return readers.chain(
        [readers.limited(docs(s, d).where(F.col("source") == r["row_name"]).select(F.col("text"), F.col("source_id").cast("string").alias("id"), "doc_id", F.lit(i).alias("source_rank")), "doc_id", 100) for i, r in enumerate(specs)]
    ).drop("text")


def nonempty_limit_semantics(s: SparkSession, d: str) -> DataFrame:
    """Documents with text among the first 200 of a source, against the first 200 with text."""
    t = docs(s, d).select("source", "doc_id", (F.coalesce(F.col("text"), F.lit("")) != "").cast("int").alias("full"))
    r = running_total(t.withColumn("one", F.lit(1)), ["source"], "doc_id", "one", "i")
    r = running_total(r, ["source"], "doc_id", "full", "j")
    return r.groupBy("source").agg(F.sum(F.when(F.col("i") < 200, F.col("full"))).alias("read_then_filter"), F.sum(F.when(F.col("j") < 200, F.col("full"))).alias("filter_then_read"))


def metadata_struct(s: SparkSession, d: str) -> DataFrame:
    """Provenance of each record: every column but text, id and language folded into one structure, written as JSON."""
    t = load(s, d, "documents")
    extra = [c for c in t.columns if c not in ("doc_id", "text", "lang")]
    return t.select("doc_id", F.to_json(F.struct(*extra)).alias("folded"), F.try_parse_json("metadata").isNotNull().alias("valid_json"))


def dedup_shingles(s: SparkSession, d: str) -> DataFrame:
    t = docs(s, d).where("text IS NOT NULL").select("doc_id", F.array_distinct(shingles(F.col("text"))).alias("sh"))
    return t.select("doc_id", F.size("sh").alias("shingles"), F.md5(F.coalesce(F.array_min("sh"), F.lit(""))).alias("least"))


def dedup_signatures(s: SparkSession, d: str) -> DataFrame:
    return dedup.signatures(docs(s, d)).select("doc_id", "signature")


def dedup_band_candidates(s: SparkSession, d: str) -> DataFrame:
    return dedup.duplicate_links(settle(dedup.signatures(docs(s, d))))


def dedup_clusters(s: SparkSession, d: str) -> DataFrame:
    return dedup.clusters(docs(s, d))


def dedup_survivors(s: SparkSession, d: str) -> DataFrame:
    return dedup.split_duplicates(docs(s, d))[0].select("doc_id", "lang", "source")


def dedup_removed(s: SparkSession, d: str) -> DataFrame:
    return dedup.split_duplicates(docs(s, d))[1].select("doc_id", "lang", "source")


def dedup_rate_by_source(s: SparkSession, d: str) -> DataFrame:
    t = docs(s, d)
    gone = dedup.clusters(t).where("doc_id <> root").select("doc_id", F.lit(1).alias("gone"))
    out = t.select("doc_id", "lang", "source").join(gone, "doc_id", "left").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("docs"), F.count("gone").alias("removed"))
    return out.withColumn("rate", F.round(F.col("removed") / F.col("docs"), 6))


def sample_byte_cap(s: SparkSession, d: str) -> DataFrame:
    return sampling.byte_capped(filled(s, d).drop("text"), 300_000).select("lang", "doc_id", "bytes", "bytes_before")


def sample_two_buckets(s: SparkSession, d: str) -> DataFrame:
    return sampling.fill_buckets(filled(s, d).drop("text"), CAPS)


def bucket_stats(s: SparkSession, d: str) -> DataFrame:
    """Documents and characters of each language and bucket, and that no document is in two."""
    t = filled(s, d).select("lang", "doc_id", "bytes", code_points(F.col("text")).alias("chars"))
    b = sampling.fill_buckets(t, CAPS).where("bucket IS NOT NULL")
    return t.join(b.select("doc_id", "bucket"), "doc_id").groupBy("lang").agg(
        F.count(F.when(F.col("bucket") == "train", 1)).alias("train_docs"), F.coalesce(F.sum(F.when(F.col("bucket") == "train", F.col("chars"))), F.lit(0)).alias("train_chars"),
        F.count(F.when(F.col("bucket") == "heldout", 1)).alias("heldout_docs"), F.coalesce(F.sum(F.when(F.col("bucket") == "heldout", F.col("chars"))), F.lit(0)).alias("heldout_chars"),
    )


def bucket_disjointness(s: SparkSession, d: str) -> DataFrame:
    """Records that two samples have in common: none for the two buckets of one draw; for a bucket and a split drawn by itself, some."""
    t = filled(s, d).drop("text")
    b = settle(sampling.fill_buckets(t, CAPS))
    samples = {k: b.where(F.col("bucket") == k).select("doc_id") for k in CAPS}
    samples["val"] = shards.split_by_record(t, "doc_id", 0.05, SEED).where("split = 'val'").select("doc_id")
    common = [samples[x].intersect(samples[y]).agg(F.count(F.lit(1)).alias("in_both")).select(F.lit(x).alias("a"), F.lit(y).alias("b"), "in_both") for x, y in (("train", "heldout"), ("train", "val"), ("heldout", "val"))]
    return readers.chain(common)


def lang_ratio_parse(s: SparkSession, d: str) -> DataFrame:
    """Weights of every plan, the last of a language counting, with its share."""
    p = load(s, d, "mix_plans").select("mix_id", F.posexplode(F.split("lang_ratios", ",")).alias("i", "e"))
    e = p.select("mix_id", "i", F.trim(F.split("e", ":", 2)[0]).alias("lang"), F.expr("try_cast(trim(split(e, ':', 2)[1]) AS decimal(24, 9))").alias("w"))
    last = e.where(F.col("lang").isin(*LANGUAGES)).groupBy("mix_id", "lang").agg(F.max_by("w", "i").alias("weight"))
    total = F.expr("sum(weight) OVER (PARTITION BY mix_id)").cast("double")
    return last.select("mix_id", "lang", F.col("weight").cast("double").alias("weight"), F.round(F.col("weight").cast("double") / F.when(total > 0, total), 9).alias("share"))


def oversample_repeats(s: SparkSession, d: str) -> DataFrame:
    return sampling.oversample(filled(s, d).drop("text"), RATIOS).select("lang", "doc_id", "bytes", "repeats")


def oversample_stats(s: SparkSession, d: str) -> DataFrame:
    t = sampling.oversample(filled(s, d).drop("text"), RATIOS)
    a = t.groupBy("lang").agg(F.count(F.lit(1)).alias("natural_docs"), F.sum("bytes").alias("natural_bytes"))
    b = sampling.repeated(t).groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("bytes").alias("bytes"))
    return a.join(b, "lang")


def _sharded(s: SparkSession, d: str, target: int = 200_000) -> DataFrame:
    """Shards of about `target` bytes for each language."""
    t = filled(s, d)
    n = t.groupBy("lang").agg(F.greatest(F.lit(1), F.bround(F.sum("bytes") / F.lit(target)).cast("int")).alias("n"))
    return shards.assign_shards(t.join(n, "lang"), "doc_id", F.col("n"), SEED)


def shard_assignment(s: SparkSession, d: str) -> DataFrame:
    return _sharded(s, d).select("doc_id", "lang", "shard")


def shard_sizes(s: SparkSession, d: str) -> DataFrame:
    return _sharded(s, d).groupBy("lang", "shard").agg(F.count(F.lit(1)).alias("docs"), F.sum("bytes").alias("bytes"))


def shard_order(s: SparkSession, d: str) -> DataFrame:
    return _sharded(s, d).select("doc_id", "lang", "shard", F.expr("row_number() OVER (PARTITION BY lang, shard ORDER BY place, doc_id)").alias("row"))


def val_split_shards(s: SparkSession, d: str) -> DataFrame:
    return shards.split_by_shard(_sharded(s, d).select("lang", "shard").distinct(), 2)


def val_split_docs(s: SparkSession, d: str) -> DataFrame:
    return shards.split_by_record(filled(s, d), "doc_id", 0.05, SEED).select("doc_id", "split")


def pretoken_counts(s: SparkSession, d: str) -> DataFrame:
    t = docs(s, d).where("text <> ''").select(F.explode(byte_pieces(F.col("text"))).alias("piece"))
    return t.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


def _placed(s: SparkSession, d: str) -> DataFrame:
    """The stream of each language's code points, a document followed by its end-of-text token."""
    t = filled(s, d).select("doc_id", "lang", code_points(F.col("text")).cast("long").alias("n_tokens"))
    return windows.stream_offsets(t, ["lang"])


def pack_offsets(s: SparkSession, d: str) -> DataFrame:
    return _placed(s, d).select("lang", "doc_id", "start", "size")


def pack_segments(s: SparkSession, d: str) -> DataFrame:
    return windows.window_segments(_placed(s, d), ["lang"], BLOCK)


def pack_windows(s: SparkSession, d: str) -> DataFrame:
    """Whole windows of code points as token ids, with their targets, by digests; 0 ends a document."""
    t = filled(s, d).select("lang", "doc_id", F.transform(F.split("text", ""), lambda c: F.ascii(c)).alias("ids"))
    w = windows.shifted_windows(t, ["lang"], BLOCK, EOS)
    digest = lambda c: F.md5(F.array_join(F.col(c).cast("array<string>"), ","))
    return w.select("lang", "window", digest("x").alias("x"), digest("y").alias("y"))


def causal_pairs(s: SparkSession, d: str) -> DataFrame:
    return windows.causal_pairs(windows.window_segments(_placed(s, d), ["lang"], BLOCK), ["lang"])


def pack_split_stats(s: SparkSession, d: str) -> DataFrame:
    t = shards.split_by_record(filled(s, d), "doc_id", 0.05, SEED)
    return t.groupBy("split").agg(F.count(F.lit(1)).alias("docs"), F.sum(code_points(F.col("text")) + 1).alias("tokens"))


def chat_render(s: SparkSession, d: str) -> DataFrame:
    """Each document as a question (its first line) and an answer (the rest)."""
    t = docs(s, d).where("text IS NOT NULL")
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    rest = F.substring("text", F.length(first) + 2, F.length("text"))
    m = F.array(F.struct(F.lit("user").alias("role"), first.alias("content")), F.struct(F.lit("assistant").alias("role"), rest.alias("content")))
    return t.select("doc_id", chat.render(m).alias("chat"), F.length(chat.render(m, True)).alias("prompt_length"))


def dataset_card(s: SparkSession, d: str) -> DataFrame:
    """The rows of the dataset card's table."""
    t = filled(s, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return t.select("lang", F.format_string("| `%s` | %,d |", "lang", "n").alias("line"))


# Unicode's white space, as functions.text.UNICODE_SPACE. What the pattern's look-ahead does is done before: the last blank of a run that a word
# follows is set apart by a character that no text has.
_SPACE = WHITE[1:-2].replace(r"\x1c-\x20", r"\x20")
_SPLIT = f"""{DOCS}, f AS (SELECT *, strlen(text) AS bytes FROM d WHERE text <> '' AND lang IS NOT NULL)"""
_HASH = "('0x' || substr(md5('{seed}:' || doc_id), 1, 7))::BIGINT"
_AB = "[" + ", ".join(f"[{a}, {b}]" for a, b in dedup.MinhashConfig().coefficients()) + "]"
_SIG = f"""{DOCS},
  w AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(text, '{WHITE}'), lambda x: x <> '') AS w FROM d WHERE text IS NOT NULL),
  sh AS (SELECT doc_id, lang, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) >= 5),
  z AS (SELECT doc_id, lang, list_transform(s, lambda x: ('0x' || substr(md5(x), 1, 7))::BIGINT) AS h FROM sh),
  sig AS (SELECT doc_id, lang, list_transform({_AB}, lambda c: list_min(list_transform(h, lambda x: (c[1] * x + c[2]) % 2147483647))) AS signature FROM z)"""
_LINKS = f"""{_SIG},
  bands AS (SELECT doc_id, lang, k, signature[k * 8 + 1:k * 8 + 8] AS band FROM sig, (SELECT unnest(range(14)) AS k)),
  links AS (SELECT DISTINCT a, doc_id AS b FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY coalesce(lang, '?'), k, band) AS a FROM bands) WHERE doc_id > a)"""
_ROOTS = f"""{_LINKS},
  e AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
  walk(doc_id, root) AS (SELECT a, a FROM e UNION SELECT e.b, walk.root FROM walk JOIN e ON e.a = walk.doc_id),
  roots AS (SELECT doc_id, min(root) AS root FROM walk GROUP BY doc_id)"""
_BUCKETS = f"""{_SPLIT},
  o AS (SELECT lang, doc_id, bytes, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM f),
  fold(lang, i, doc_id, a, b, bucket) AS (
    SELECT DISTINCT lang, 0::BIGINT, NULL::BIGINT, 0::BIGINT, 0::BIGINT, NULL::VARCHAR FROM o
    UNION ALL
    SELECT lang, i, doc_id, a + CASE WHEN p = 'train' THEN bytes ELSE 0 END, b + CASE WHEN p = 'heldout' THEN bytes ELSE 0 END, p FROM (
      SELECT o.lang, o.i, o.doc_id, o.bytes, a, b, CASE WHEN a >= {CAPS['train']} AND b >= {CAPS['heldout']} THEN NULL
        WHEN a < {CAPS['train']} AND (b >= {CAPS['heldout']} OR a / {CAPS['train']}.0 <= b / {CAPS['heldout']}.0) THEN 'train' ELSE 'heldout' END AS p
      FROM fold JOIN o ON o.lang = fold.lang AND o.i = fold.i + 1)),
  picked AS (SELECT lang, doc_id, bucket FROM fold WHERE i > 0)"""
_OVER = f"""{_SPLIT},
  n AS (SELECT lang, sum(bytes) AS have, CASE lang WHEN 'hi' THEN 0.5 ELSE 0.25 END AS ratio FROM f GROUP BY lang),
  t AS (SELECT *, (SELECT max(have / ratio) FROM n) * ratio AS target FROM n),
  r AS (SELECT f.lang, doc_id, bytes, greatest(0, ceil((target - (sum(bytes) OVER (PARTITION BY f.lang ORDER BY doc_id) - bytes)) / have))::BIGINT AS repeats FROM f JOIN t USING (lang))"""
_SHARDS = f"""{_SPLIT},
  c AS (SELECT lang, greatest(1, round_even(sum(bytes) / 200000.0, 0))::BIGINT AS n FROM f GROUP BY lang),
  s AS (SELECT doc_id, lang, bytes, ({_HASH.format(seed=SEED)} % n)::INT AS shard, md5('{SEED + 1}:' || doc_id) AS place FROM f JOIN c USING (lang))"""
_STREAM = f"""{_SPLIT},
  p AS (SELECT lang, doc_id, length(text) + 1 AS size, sum(length(text) + 1) OVER (PARTITION BY lang ORDER BY doc_id) - length(text) - 1 AS start FROM f)"""
_TOKENS = f"""{_STREAM},
  tok AS (SELECT lang, doc_id, start + i AS spot, i FROM (SELECT *, unnest(range(size)) AS i FROM p)),
  seg AS (SELECT lang, doc_id, (spot // {BLOCK})::BIGINT AS "window", min(spot % {BLOCK})::BIGINT AS t, count(*) AS n, min(i) AS position FROM tok GROUP BY ALL)"""
_VAL = f"""{_SPLIT},
  h AS (SELECT *, row_number() OVER (ORDER BY {_HASH.format(seed=SEED)}, doc_id) AS r, greatest(1, floor(count(*) OVER () * 0.05)) AS k FROM f),
  v AS (SELECT *, CASE WHEN r <= k THEN 'val' ELSE 'train' END AS split FROM h)"""

QUERIES = {
    "corpus_stats_rollup": (corpus_stats_rollup, f"""WITH {DOCS}, r AS (SELECT lang, {WORDS} AS w, strlen(text) AS b, length(text) AS c FROM d WHERE text <> '')
        SELECT CASE WHEN grouping(lang) = 1 THEN 'overall' ELSE coalesce(lang, 'unknown') END AS lang, count(*) AS docs, sum(w)::BIGINT AS words, sum(b)::BIGINT AS bytes,
          sum(c)::BIGINT AS chars, round(sum(b) / sum(w), 6) AS bytes_per_word FROM r GROUP BY ROLLUP (lang)"""),
    "source_union_limit": (source_union_limit, """WITH k AS (SELECT row_name, (row_number() OVER (ORDER BY lang, row_name) - 1)::INT AS source_rank FROM source_specs)
        SELECT source_id AS id, doc_id, source_rank FROM documents JOIN k ON source = row_name QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 100"""),
    "nonempty_limit_semantics": (nonempty_limit_semantics, """WITH f AS (SELECT source, doc_id, CASE WHEN coalesce(text, '') <> '' THEN 1 ELSE 0 END AS full_, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
        g AS (SELECT *, sum(full_) OVER (PARTITION BY source ORDER BY doc_id) - full_ AS j FROM f)
        SELECT source, sum(CASE WHEN i <= 200 THEN full_ END)::BIGINT AS read_then_filter, sum(CASE WHEN j < 200 THEN full_ END)::BIGINT AS filter_then_read FROM g GROUP BY source"""),
    "metadata_struct": (metadata_struct, """WITH f AS (SELECT doc_id, metadata, [CASE WHEN source IS NOT NULL THEN '"source":' || to_json(source) END, CASE WHEN n_chars IS NOT NULL THEN '"n_chars":' || n_chars END,
          CASE WHEN source_id IS NOT NULL THEN '"source_id":' || to_json(source_id) END, CASE WHEN site IS NOT NULL THEN '"site":' || to_json(site) END, CASE WHEN url IS NOT NULL THEN '"url":' || to_json(url) END,
          CASE WHEN metadata IS NOT NULL THEN '"metadata":' || to_json(metadata) END, CASE WHEN crawled_at IS NOT NULL THEN '"crawled_at":"' || strftime(crawled_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%gZ"') END,
          CASE WHEN ingested_at IS NOT NULL THEN '"ingested_at":"' || strftime(ingested_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%gZ"') END] AS l FROM documents)
        SELECT doc_id, '{' || array_to_string(list_filter(l, lambda x: x IS NOT NULL), ',') || '}' AS folded, coalesce(json_valid(metadata), false) AS valid_json FROM f"""),
    "dedup_shingles": (dedup_shingles, f"""WITH {DOCS}, w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{WHITE}'), lambda x: x <> '') AS w FROM d WHERE text IS NOT NULL),
        s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) ELSE [] END AS sh FROM w)
        SELECT doc_id, len(sh)::INT AS shingles, md5(coalesce(list_min(sh), '')) AS least FROM s"""),
    "dedup_signatures": (dedup_signatures, f"WITH {_SIG} SELECT doc_id, signature FROM sig"),
    "dedup_band_candidates": (dedup_band_candidates, f"WITH {_LINKS} SELECT a, b FROM links"),
    "dedup_clusters": (dedup_clusters, f"WITH RECURSIVE {_ROOTS} SELECT doc_id, root FROM roots"),
    "dedup_survivors": (dedup_survivors, f"WITH RECURSIVE {_ROOTS} SELECT doc_id, lang, source FROM d WHERE doc_id NOT IN (SELECT doc_id FROM roots WHERE doc_id <> root)"),
    "dedup_removed": (dedup_removed, f"WITH RECURSIVE {_ROOTS} SELECT doc_id, lang, source FROM d WHERE doc_id IN (SELECT doc_id FROM roots WHERE doc_id <> root)"),
    "dedup_rate_by_source": (dedup_rate_by_source, f"""WITH RECURSIVE {_ROOTS} SELECT lang, source, count(*) AS docs, count(root) FILTER (doc_id <> root) AS removed,
        round(count(root) FILTER (doc_id <> root) / count(*), 6) AS rate FROM (SELECT d.*, root FROM d LEFT JOIN roots USING (doc_id)) GROUP BY lang, source"""),
    "sample_byte_cap": (sample_byte_cap, f"""WITH {_SPLIT}, r AS (SELECT lang, doc_id, bytes, (sum(bytes) OVER (PARTITION BY lang ORDER BY doc_id) - bytes)::BIGINT AS bytes_before FROM f)
        SELECT * FROM r WHERE bytes_before < 300000"""),
    "sample_two_buckets": (sample_two_buckets, f"WITH RECURSIVE {_BUCKETS} SELECT lang, doc_id, bucket FROM picked"),
    "bucket_stats": (bucket_stats, f"""WITH RECURSIVE {_BUCKETS} SELECT p.lang, count(*) FILTER (bucket = 'train') AS train_docs, coalesce(sum(length(text)) FILTER (bucket = 'train'), 0)::BIGINT AS train_chars,
        count(*) FILTER (bucket = 'heldout') AS heldout_docs, coalesce(sum(length(text)) FILTER (bucket = 'heldout'), 0)::BIGINT AS heldout_chars
        FROM picked p JOIN f USING (doc_id) WHERE bucket IS NOT NULL GROUP BY p.lang"""),
    "bucket_disjointness": (bucket_disjointness, f"""WITH RECURSIVE {_BUCKETS}, {_VAL.removeprefix(_SPLIT + ',')},
        m AS (SELECT bucket AS k, doc_id FROM picked WHERE bucket IS NOT NULL UNION ALL SELECT 'val', doc_id FROM v WHERE split = 'val'),
        p(a, b) AS (VALUES ('train', 'heldout'), ('train', 'val'), ('heldout', 'val'))
        SELECT a, b, (SELECT count(*) FROM (SELECT doc_id FROM m WHERE k = a INTERSECT SELECT doc_id FROM m WHERE k = b)) AS in_both FROM p"""),
    "lang_ratio_parse": (lang_ratio_parse, """WITH e AS (SELECT mix_id, unnest(string_split(lang_ratios, ',')) AS e, generate_subscripts(string_split(lang_ratios, ','), 1) AS i FROM mix_plans),
        l AS (SELECT mix_id, trim(split_part(e, ':', 1)) AS lang, arg_max(try_cast(trim(split_part(e, ':', 2)) AS DECIMAL(24, 9)), i) AS weight FROM e GROUP BY ALL)
        SELECT mix_id, lang, weight::DOUBLE AS weight, round(weight::DOUBLE / nullif((sum(weight) OVER (PARTITION BY mix_id))::DOUBLE, 0), 9) AS share FROM l WHERE lang IN ('pt', 'es', 'hi')"""),
    "oversample_repeats": (oversample_repeats, f"WITH {_OVER} SELECT lang, doc_id, bytes, repeats FROM r"),
    "oversample_stats": (oversample_stats, f"WITH {_OVER} SELECT lang, count(*) AS natural_docs, sum(bytes)::BIGINT AS natural_bytes, sum(repeats)::BIGINT AS docs, sum(bytes * repeats)::BIGINT AS bytes FROM r GROUP BY lang"),
    "shard_assignment": (shard_assignment, f"WITH {_SHARDS} SELECT doc_id, lang, shard FROM s"),
    "shard_sizes": (shard_sizes, f"WITH {_SHARDS} SELECT lang, shard, count(*) AS docs, sum(bytes)::BIGINT AS bytes FROM s GROUP BY lang, shard"),
    "shard_order": (shard_order, f"WITH {_SHARDS} SELECT doc_id, lang, shard, row_number() OVER (PARTITION BY lang, shard ORDER BY place, doc_id)::INT AS row FROM s"),
    "val_split_shards": (val_split_shards, f"""WITH {_SHARDS}, k AS (SELECT DISTINCT lang, shard FROM s)
        SELECT lang, shard, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY shard) <= least(2, greatest(1, count(*) OVER (PARTITION BY lang) // 10)) THEN 'val' ELSE 'train' END AS split FROM k"""),
    "val_split_docs": (val_split_docs, f"WITH {_VAL} SELECT doc_id, split FROM v"),
    "pretoken_counts": (pretoken_counts, f"""WITH t AS (SELECT regexp_replace(text, '([{_SPACE}])([{_SPACE}][^{_SPACE}])', '\\1' || chr(57344) || '\\2', 'g') AS t FROM documents WHERE text <> ''),
        p AS (SELECT unnest(regexp_extract_all(t, '\\x27(?:s|t|re|ve|m|ll|d)| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{_SPACE}\\p{{L}}\\p{{N}}\\x{{e000}}]+|[{_SPACE}]+')) AS piece FROM t)
        SELECT piece, count(*) AS n FROM p GROUP BY piece"""),
    "pack_offsets": (pack_offsets, f"WITH {_STREAM} SELECT lang, doc_id, start::BIGINT AS start, size FROM p"),
    "pack_segments": (pack_segments, f"""WITH {_TOKENS} SELECT lang, doc_id, "window", t, n, position, row_number() OVER (PARTITION BY lang, "window" ORDER BY t)::INT - 1 AS doc FROM seg"""),
    "pack_windows": (pack_windows, f"""WITH {_STREAM}, c AS (SELECT lang, p.start + i - 1 AS spot, CASE WHEN i <= length(text) THEN ord(text[i]) ELSE {EOS} END AS tok FROM p JOIN f USING (lang, doc_id), unnest(range(1, size + 1)) AS r(i)),
        w AS (SELECT lang, spot // {BLOCK} AS "window", spot, tok FROM c UNION ALL SELECT lang, spot // {BLOCK} - 1, spot, tok FROM c WHERE spot % {BLOCK} = 0 AND spot > 0)
        SELECT lang, "window"::BIGINT AS "window", md5(string_agg(tok::VARCHAR, ',' ORDER BY spot) FILTER (spot < ("window" + 1) * {BLOCK})) AS x,
          md5(string_agg(tok::VARCHAR, ',' ORDER BY spot) FILTER (spot > "window" * {BLOCK})) AS y FROM w GROUP BY lang, "window" HAVING count(*) = {BLOCK} + 1"""),
    "causal_pairs": (causal_pairs, f"""WITH {_TOKENS} SELECT lang, "window", sum(n)::BIGINT AS tokens, count(*) AS documents, sum(n * (n + 1) // 2)::BIGINT AS pairs FROM seg GROUP BY lang, "window" """),
    "pack_split_stats": (pack_split_stats, f"WITH {_VAL} SELECT split, count(*) AS docs, sum(length(text) + 1)::BIGINT AS tokens FROM v GROUP BY split"),
    "chat_render": (chat_render, """WITH m AS (SELECT doc_id, split_part(text, chr(10), 1) AS q, substr(text, length(split_part(text, chr(10), 1)) + 2) AS a FROM documents WHERE text IS NOT NULL),
        c AS (SELECT doc_id, '<|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10) || q || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) || a || '<|eot_id|>' AS chat FROM m)
        SELECT doc_id, chat, (length(chat) + length('<|start_header_id|>assistant<|end_header_id|>') + 2)::INT AS prompt_length FROM c"""),
    "dataset_card": (dataset_card, f"WITH {_SPLIT} SELECT lang, '| `' || lang || '` | ' || format('{{:,}}', count(*)) || ' |' AS line FROM f GROUP BY lang"),
}
