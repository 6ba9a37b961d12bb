"""Queries pN_... over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions.text import language_code, utf8_bytes, word_count
from siltworks.llm import bpe_stream, mixing, near_duplicates, packing, scanned_pages, shared_spans, site_lines, text_quality
from siltworks.operators import metrics
from siltworks.storage import load

RATIOS = {"pt": 2.0, "es": 2.0, "hi": 1.0}
Query = Callable[[SparkSession, str], DataFrame]


def _docs(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return load(spark, folder, "documents").select("doc_id", "text", *columns)


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return load(spark, folder, "mix_plans"), load(spark, folder, "sample_stats")


def p2_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics by name."""
    s = text_quality.quality_statistics(_docs(spark, folder), load(spark, folder, "word_counts"))
    return s.select("doc_id", "n_words", *[F.round(F.col("s")[i], 6).alias(name) for i, name in enumerate(text_quality.STATISTICS)])


def p6_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Per document whether decoding its ids gives its text again."""
    docs = _docs(spark, folder)
    back = bpe_stream.decode_corpus(bpe_stream.encode_corpus(docs)).withColumnRenamed("text", "decoded")
    return docs.join(back, "doc_id").selectExpr("doc_id", "decoded = coalesce(text, '') AS same")


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """Fertility and compression of the public vocabulary by language, and overall, as tokenizer_report; counts are joined, not texts."""
    docs = _docs(spark, folder, "lang").withColumn("lang", language_code(F.col("lang"))).where("text <> '' AND lang IS NOT NULL")
    sizes = docs.select("doc_id", "lang", word_count(F.col("text")).alias("w"), utf8_bytes(F.col("text")).alias("b"))
    tokens = bpe_stream.token_counts(docs.select("doc_id", "text")).select("doc_id", F.col("n_tokens").alias("t_byte_bpe_50k"))
    return metrics.report_of_counts(sizes.join(tokens, "doc_id"), ["byte_bpe_50k"])


def p6_baselines(spark: SparkSession, folder: str) -> DataFrame:
    """p6_report of other public vocabularies, by the libraries they are made for, and ours by the transducer."""
    at = os.path.dirname(bpe_stream.VOCABULARY)
    others = {
        "byte_bpe_multi_50k": ("tiktoken", f"{at}/byte_bpe_multi_50k.tiktoken"),
        "word_bpe_49k": ("tokenizers", f"{at}/word_bpe_49k.json"),
        "piece_bpe_32k": ("sentencepiece", f"{at}/piece_bpe_32k.model"),
    }
    docs = _docs(spark, folder, "lang").withColumn("lang", language_code(F.col("lang"))).where("text <> '' AND lang IS NOT NULL")
    sizes = docs.select("doc_id", "lang", word_count(F.col("text")).alias("w"), utf8_bytes(F.col("text")).alias("b"))
    own = bpe_stream.token_counts(docs.select("doc_id", "text")).select("doc_id", F.col("n_tokens").alias("t_byte_bpe_50k"))
    counts = sizes.join(own, "doc_id").join(bpe_stream.baseline_counts(docs, others), "doc_id")
    return metrics.report_of_counts(counts, ["byte_bpe_50k", *others])


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(bpe_stream.token_counts(_docs(spark, folder)).withColumnRenamed("n_tokens", "size"))


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: mixing.unreachable(*_mix(s, d)),
        "p1_shares": lambda s, d: mixing.plan_shares(*_mix(s, d)),
        "p1_shards": lambda s, d: mixing.plan_blocks(*_mix(s, d)).select("mix_id", "lang", "blocks", "shard_unplaced", "used_blocks", "shard_blocks"),
        "p1_records": lambda s, d: mixing.mix_records(_docs(s, d, "lang"), RATIOS),
        "p1_record_shares": lambda s, d: mixing.mixed_shares(mixing.mix_records(_docs(s, d, "lang"), RATIOS), RATIOS),
        "p2_found": lambda s, d: text_quality.page_kinds(_docs(s, d), load(s, d, "word_counts")).where("n_words >= 5 AND kind <> 'prose'").select("doc_id").distinct(),
        "p2_statistics": p2_statistics,
        "p2_kinds": lambda s, d: text_quality.page_kinds(_docs(s, d), load(s, d, "word_counts")),
        "p3_found": lambda s, d: scanned_pages.scan_noise(_docs(s, d), load(s, d, "word_counts")),
        "p3_texts": lambda s, d: scanned_pages.repaired(_docs(s, d), load(s, d, "word_counts")),
        "p4_found": lambda s, d: site_lines.repeated_lines(_docs(s, d, "site")).select("doc_id", "line_no"),
        "p4_sequences": lambda s, d: site_lines.frequent_sequences(_docs(s, d, "site")),
        "p4_texts": lambda s, d: site_lines.without_repeated_lines(_docs(s, d, "site")),
        "p5_found": lambda s, d: near_duplicates.near_duplicate_pairs(_docs(s, d)),
        "p5_members": lambda s, d: near_duplicates.near_duplicate_members(_docs(s, d)),
        "p5_links": lambda s, d: near_duplicates.near_duplicate_links(_docs(s, d)),
        "p5_groups": lambda s, d: near_duplicates.near_duplicate_groups(_docs(s, d)),
        "p6_ids": lambda s, d: bpe_stream.encode_corpus(_docs(s, d)),
        "p6_round_trip": p6_round_trip,
        "p6_report": p6_report,
        "p6_baselines": p6_baselines,
        "p7_found": lambda s, d: packing.split_items(_packed(s, d)),
        "p7_containers": _packed,
        "p7_bound": lambda s, d: packing.certified(_packed(s, d)),
        "p8_found": lambda s, d: shared_spans.shared_span_pairs(_docs(s, d)),
        "p8_members": lambda s, d: shared_spans.shared_span_members(_docs(s, d)),
        "p8_spans": lambda s, d: shared_spans.shared_passages(_docs(s, d)),
        "p8_shares": lambda s, d: shared_spans.shared_parts(_docs(s, d)),
    }


_WHITE = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_LATEST = """
sizes AS (
  SELECT sample_id, lang, greatest(coalesce(m.n, 0), 0) AS train_chars FROM (
    SELECT sample_id, lang, max(struct_pack(t := measured_at, n := coalesce(train_chars, -1))) AS m FROM (
      SELECT *  REPLACE (CASE regexp_replace(lower(trim(lang)), '-.*$', '') WHEN 'pt' THEN 'pt' WHEN 'por_latn' THEN 'pt' WHEN 'es' THEN 'es'
        WHEN 'spa_latn' THEN 'es' WHEN 'hi' THEN 'hi' WHEN 'hin_deva' THEN 'hi' END AS lang) FROM sample_stats
    ) WHERE lang IS NOT NULL GROUP BY ALL)),
parts AS (
  SELECT DISTINCT mix_id, sample_id, total_chars, max_repeats, i, trim(split_part(e, ':', 1)) AS lang, try_cast(trim(split_part(e, ':', 2)) AS DECIMAL(24, 9)) AS weight
  FROM (SELECT *, unnest(string_split(lang_ratios, ',')) AS e, generate_subscripts(string_split(lang_ratios, ','), 1) AS i FROM mix_plans)),
given AS (
  SELECT mix_id, sample_id, total_chars, max_repeats, lang, arg_max(weight, i) AS weight FROM parts WHERE lang IN ('pt', 'es', 'hi') GROUP BY ALL),
shares AS (
  SELECT *, total_chars * weight::DOUBLE / (sum(weight) OVER (PARTITION BY mix_id))::DOUBLE AS wanted_chars,
    weight::DOUBLE / (sum(weight) OVER (PARTITION BY mix_id))::DOUBLE AS part
  FROM given WHERE weight > 0),
joined AS (
  SELECT s.*, coalesce(z.train_chars, 0) AS train_chars, max_repeats * coalesce(z.train_chars, 0) AS max_chars FROM shares s LEFT JOIN sizes z USING (sample_id, lang))
"""
_OFTEN = f"""lines AS (
            SELECT doc_id, site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no
            FROM documents WHERE site IS NOT NULL AND text IS NOT NULL),
          plain AS (SELECT doc_id, site, line_no, trim(regexp_replace(regexp_replace(lower(line), '\\p{{Nd}}+', '', 'g'), '[{_WHITE}]+', ' ', 'g')) AS p FROM lines),
          often AS (SELECT site, p FROM plain WHERE length(p) >= 20 GROUP BY ALL HAVING count(DISTINCT doc_id) >= 6)"""
_SETS = f"""w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[{_WHITE}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
          s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
          n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id)"""
# The classes of texts of the same words, and the similar pairs between their least ids.
_NEAR = """member AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY array_to_string(w, ' ')) AS rep FROM w WHERE len(w) >= 5),
  near AS (SELECT j.*, x.n AS na, y.n AS nb FROM (
      SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
      WHERE a.doc_id IN (SELECT rep FROM member) AND b.doc_id IN (SELECT rep FROM member) GROUP BY ALL) j
    JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.6 * (x.n + y.n - c))"""
_MEMBERS = """sizes AS (SELECT rep, count(*) AS k FROM member GROUP BY rep),
  others AS (SELECT e.a AS rep, sum(k) AS k FROM (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs) e JOIN sizes ON rep = e.b GROUP BY ALL)
  SELECT doc_id, m.rep, (z.k - 1 + coalesce(o.k, 0))::BIGINT AS links FROM member m JOIN sizes z USING (rep) LEFT JOIN others o ON o.rep = m.rep"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_LATEST} SELECT DISTINCT mix_id, lang FROM joined WHERE wanted_chars > max_chars",
        "p1_shares": f"""WITH {_LATEST}, used AS (
            SELECT *, wanted_chars > max_chars AS short,
              CASE WHEN wanted_chars > max_chars THEN max_chars ELSE cast(round_even(wanted_chars, 0) AS BIGINT) END AS used_chars FROM joined)
            SELECT mix_id, lang, round(part, 9) AS wanted_share, wanted_chars, train_chars, max_chars, used_chars,
              round(CASE WHEN train_chars > 0 THEN used_chars / train_chars ELSE 0 END, 9) AS uses, round(used_chars / total_chars, 9) AS share,
              round(coalesce(used_chars / nullif(sum(used_chars) OVER (PARTITION BY mix_id), 0), 0), 9) AS actual_share, short FROM used""",
        "p4_found": f"WITH {_OFTEN} SELECT doc_id, line_no FROM plain JOIN often USING (site, p)",
        "p4_texts": f"""WITH {_OFTEN}, x AS (SELECT doc_id, list(line_no) AS drop_ FROM plain JOIN often USING (site, p) GROUP BY doc_id)
          SELECT d.doc_id, CASE WHEN x.doc_id IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda l, i: NOT list_contains(drop_, i)), chr(10)) END AS text
          FROM documents d LEFT JOIN x ON x.doc_id = d.doc_id""",
        "p5_found": f"""WITH {_SETS}, j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL)
          SELECT a AS doc_id_a, b AS doc_id_b FROM j JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.6 * (x.n + y.n - c)""",
        "p5_links": f"WITH {_SETS}, {_NEAR} SELECT a AS rep_a, b AS rep_b, round(c / (na + nb - c), 6) AS similarity FROM near",
        "p5_members": f"""WITH {_SETS}, {_NEAR}, pairs AS (SELECT a, b FROM near), {_MEMBERS}""",
        "p6_round_trip": "SELECT doc_id, true AS same FROM documents",
        "p8_members": f"""WITH member AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS rep FROM documents WHERE length(text) >= 300),
          g AS (SELECT DISTINCT doc_id, md5(substr(text, i, 300)) AS h FROM (
            SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents JOIN member USING (doc_id) WHERE rep = doc_id)),
          pairs AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.h = b.h AND a.doc_id < b.doc_id), {_MEMBERS}""",
        "p8_found": """WITH g AS (SELECT DISTINCT doc_id, md5(substr(text, i, 300)) AS h FROM (
            SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300))
          SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM g a JOIN g b ON a.h = b.h AND a.doc_id < b.doc_id""",
    }
