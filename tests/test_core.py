"""General operators: properties, brute force and edge cases."""

import json
import math
import os
import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltworks import storage
from siltworks.functions import chat
from siltworks.functions import scaling as sc
from siltworks.functions import text as tx
from siltworks.operators import dedup, fitting, metrics, sampling, semijoin, shards, windows
from siltworks.operators.blocks import candidate_pairs
from siltworks.operators.components import components
from siltworks.operators.prefix import running_total
from siltworks.plans import analytics, corpus
from siltworks.sources import readers, sinks
from siltworks.storage import settle
from siltworks.streaming import history as hist


def test_words_follow_python(spark):
    texts = ["a b", " a   b\n", "", "a b　c\x1cd\x85e", None, "x y"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.words(F.col("t")).alias("w"), tx.word_count(F.col("t")).alias("n")).collect()
    for r in rows:
        t = texts[r.i]
        assert r.w == (None if t is None else t.split()) and r.n == (None if t is None else len(t.split()))


def test_language_codes(spark):
    given = ["pt", " PT ", "por_Latn", "es-x", "HIN_deva", "overall", None, ""]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in given], "x string").select(tx.language_code(F.col("x"))).collect()]
    assert got == ["pt", "pt", "pt", "es", "hi", None, None, None]


def test_shingles(spark):
    s = lambda t: spark.createDataFrame([(t,)], "t string").select(tx.shingles(F.col("t"), 5)).first()[0]
    assert s("a b c d") == [] and s("a b  c d e\nf") == ["a b c d e", "b c d e f"] and s("") == []


def test_byte_pieces(spark):
    p = spark.createDataFrame([("I'll  go 42!\n",)], "t string").select(tx.byte_pieces(F.col("t"))).first()[0]
    assert p == ["I", "'ll", " ", " go", " 42", "!", "\n"] and "".join(p) == "I'll  go 42!\n"
    # other white space than ASCII's
    p = spark.createDataFrame([("a\u00a0\u00a0! b\u3000c\u2003\u2003",)], "t string").select(tx.byte_pieces(F.col("t"))).first()[0]
    assert p == ["a", "\u00a0", "\u00a0", "!", " b", "\u3000", "c", "\u2003\u2003"]


def test_running_total(spark):
    r = random.Random(1)
    rows = [(r.choice("ab"), i, r.choice([None, 1, 5, 9])) for i in range(0, 400_000, 997)]
    got = running_total(spark.createDataFrame(rows, "k string, o long, v long"), ["k"], "o", "v", parts=7).collect()
    have = {"a": 0, "b": 0}
    want = {}
    for k, o, v in rows:
        want[o] = have[k]
        have[k] += v or 0
    assert {x.o: x.before for x in got} == want


def test_running_total_of_sparse_and_skewed_keys(spark):
    """Hashed ids, one key with most rows, null keys and text as order: right totals, and no range that holds the whole of the hot key."""
    r = random.Random(3)
    rows = [(r.choice(["hot"] * 9 + ["cold", None]), f"{r.getrandbits(60):015x}", r.choice([None, 2, 3])) for _ in range(3000)]
    d = spark.createDataFrame(rows, "k string, o string, v long")
    got = {x.o: x.before for x in running_total(d, ["k"], "o", "v", parts=16).collect()}
    have: dict = {}
    for k, o, v in sorted(rows, key=lambda x: x[1]):
        assert got[o] == have.get(k, 0)
        have[k] = have.get(k, 0) + (v or 0)
    sizes = d.repartitionByRange(16, "k", "o").withColumn("p", F.spark_partition_id()).where("k = 'hot'").groupBy("p").count().collect()
    assert max(x["count"] for x in sizes) < 3000 / 4
    assert running_total(d.where("false"), ["k"], "o", "v").collect() == []


def test_semi_joins(spark):
    big = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x")).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS k, 7L AS x"))
    keys = spark.range(0, 9000, 7).select(F.col("id").alias("k"))
    assert sorted(r.k for r in semijoin.having(big, "k", keys).collect()) == list(range(0, 5000, 7))
    assert semijoin.having(big, "k", keys.where("false")).collect() == []
    marked = semijoin.marked(big, "k", keys)
    assert marked.count() == 5001 and marked.where("maybe").count() < 5000 / 7 + 300 and not marked.where("k IS NULL").first().maybe
    other = keys.withColumn("y", F.lit("a"))
    rows = {r.k: (r.x, r.y) for r in semijoin.joined_where_known(big, "k", other).collect()}
    assert rows == {**{i: (2 * i, None if i % 7 else "a") for i in range(5000)}, None: (7, None)}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 200 + i) for i in range(30)] + [(7, 7), (None, 3)]
    got = {x.id: x.root for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, **{200 + i: 100 for i in range(30)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_candidate_pairs_of_large_groups(spark):
    rows = [("k", i) for i in range(150)] + [("l", 1), ("l", 999), ("m", 5)]
    got = candidate_pairs(spark.createDataFrame(rows, "k string, m long"), ["k"], "m", 16)
    assert {tuple(x) for x in got.collect()} == {(a, b) for a in range(150) for b in range(a + 1, 150)} | {(1, 999)}


def test_dedup_across_sources_and_languages(spark):
    a, b = " ".join(f"w{i}" for i in range(50)), " ".join(f"v{i}" for i in range(50))
    rows = [(1, a, "pt"), (2, a, "pt"), (3, b, "pt"), (4, a, "es"), (5, "too short", "pt"), (6, "too short", "pt"), (7, None, None), (8, a, None), (9, a, None)]
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, signature string")
    kept, gone = dedup.split_duplicates(d)
    assert {r.doc_id for r in gone.collect()} == {2, 9} and {r.doc_id for r in kept.collect()} == {1, 3, 4, 5, 6, 7, 8}
    assert dedup.clusters(d.where("false")).collect() == []
    with pytest.raises(TypeError):
        dedup.MinhashConfig.of({"n_gram": 5})
    # words as the caller cuts them
    letters = [(1, "a,b,c,d,e,f", "pt"), (2, "a,b,c;d,e,f", "pt"), (3, "a b c d e f", "pt")]
    s = dedup.signatures(spark.createDataFrame(letters, "doc_id long, text string, lang string"), words=lambda t: t.replace(";", ",").split(","))
    s = {r.doc_id: r.signature for r in s.collect()}
    assert set(s) == {1, 2} and s[1] == s[2]


def test_minhash_estimates_similarity(spark):
    w = [f"w{i}" for i in range(400)]
    x, y = w[:300], w[60:360]
    rows = [(1, " ".join(x), "pt"), (2, " ".join(y), "pt")]
    s = {r.doc_id: r.signature for r in dedup.signatures(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert abs(np.mean(np.array(s[1]) == np.array(s[2])) - 236 / 356) < 0.15


def test_signature_values(spark):
    """The definition itself, shingle by shingle."""
    import hashlib

    t, c = "um  dois três\u3000quatro cinco seis um dois três quatro cinco", dedup.MinhashConfig(num_buckets=2, hashes_per_bucket=3)
    got = dedup.signatures(spark.createDataFrame([(1, t, "pt")], "doc_id long, text string, lang string"), c).first().signature
    w = t.split()
    h = {int(hashlib.md5(" ".join(w[i : i + 5]).encode()).hexdigest()[:7], 16) for i in range(len(w) - 4)}
    assert got == [min((a * x + b) % (2**31 - 1) for x in h) for a, b in c.coefficients()]


def test_two_buckets_equal_a_loop(spark):
    r = random.Random(2)
    rows = [(i, "pt", r.randrange(1, 90)) for i in range(300)]
    caps = {"train": 4000, "heldout": 400}
    d = spark.createDataFrame(rows, "doc_id long, lang string, bytes long")
    got = {x.doc_id: x.bucket for x in sampling.fill_buckets(d, caps).collect()}
    # ids that two languages have, and no language at all
    both = d.unionByName(d.withColumn("lang", F.lit(None).cast("string")))
    assert sorted(map(repr, sampling.fill_buckets(both, caps).collect())) == sorted(f"Row(lang={k!r}, doc_id={i}, bucket={got[i]!r})" for i in got for k in ("pt", None))
    have = dict.fromkeys(caps, 0)
    for i, _, n in rows:
        free = [k for k in caps if have[k] < caps[k]]
        b = min(free, key=lambda k: have[k] / caps[k]) if free else None
        assert got[i] == b
        if b:
            have[b] += n


def test_oversample_equals_a_loop(spark):
    rows = [(i, "pt", 10 + i % 7) for i in range(30)] + [(100 + i, "hi", 5) for i in range(4)]
    d = spark.createDataFrame(rows, "doc_id long, lang string, bytes long")
    for target in (None, 1, 700):
        got = {x.doc_id: x.repeats for x in sampling.oversample(d, {"pt": 1, "hi": 1, "es": 0}, target).collect()}
        t = max(sum(n for _, k, n in rows if k == lang) / 0.5 for lang in ("pt", "hi")) if target is None else target
        for lang in ("pt", "hi"):
            own, taken, i, count = [x for x in rows if x[1] == lang], 0, 0, {}
            while taken < t * 0.5:
                count[own[i % len(own)][0]] = count.get(own[i % len(own)][0], 0) + 1
                taken += own[i % len(own)][2]
                i += 1
            assert {k: got[k] for k, *_ in own} == {k: count.get(k, 0) for k, *_ in own}
    with pytest.raises(ValueError):
        sampling.oversample(d, {"es": 1.0})


def test_parse_ratios():
    assert sampling.parse_ratios("hi:0.5, pt:1,hi:2", tx.LANGUAGES) == {"hi": 2.0, "pt": 1.0}
    for bad in ("hi", "xx:1", ":2", "pt:"):
        with pytest.raises(ValueError):
            sampling.parse_ratios(bad, tx.LANGUAGES)


def test_shards(spark, tmp_path):
    d = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("pt").alias("lang"))
    a = shards.assign_shards(d, "doc_id", 7)
    shards.write_shards(a.where("shard <> 3"), str(tmp_path / "out"), ["lang"])
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.doc_id for r in back.collect()) == sorted(r.doc_id for r in a.collect() if r.shard != 3)
    # one file for each shard that has rows, numbered without gaps
    assert sorted(p.parent.name for p in (tmp_path / "out").rglob("*.parquet")) == [f"part={i:05d}-of-00006" for i in range(6)]
    names = {(r.lang, r.shard): (r.number, r.of) for r in shards.numbered_shards(a.where("shard <> 3"), ["lang"]).collect()}
    assert names == {("pt", k): (i, 6) for i, k in enumerate([0, 1, 2, 4, 5, 6])}
    assert shards.is_complete(spark, str(tmp_path / "out")) and not shards.is_complete(spark, str(tmp_path / "none"))
    assert sorted(a.collect()) == sorted(shards.assign_shards(d.repartition(3), "doc_id", 7).collect())
    assert [shards.shard_count(*x) for x in ((1, 100), (250, 100), (350, 100))] == [1, 2, 4]
    v = shards.split_by_record(d, "doc_id", 0.05)
    assert v.where("split = 'val'").count() == 25 and v.count() == 500
    s = {r.shard: r.split for r in shards.split_by_shard(spark.createDataFrame([("pt", i) for i in range(25)], "lang string, shard int"), 5).collect()}
    assert [k for k in sorted(s) if s[k] == "val"] == [0, 1]


def test_completed_rows(spark, tmp_path):
    spark.range(37).write.parquet(str(tmp_path / "out"))
    assert shards.completed_rows(spark, str(tmp_path / "out")) == 37 and shards.completed_rows(spark, str(tmp_path / "none")) is None
    (tmp_path / "out" / "_SUCCESS").unlink()
    assert shards.completed_rows(spark, str(tmp_path / "out")) is None


def test_windows_equal_tokens(spark):
    sizes = [5, 0, 17, 3, 30]
    d = spark.createDataFrame([("pt", i, n) for i, n in enumerate(sizes)], "lang string, doc_id long, n_tokens long")
    seg = windows.window_segments(windows.stream_offsets(d, ["lang"]), ["lang"], 8)
    stream = [(doc, t) for doc, n in enumerate(sizes) for t in range(n + 1)]
    for s in seg.collect():
        assert [stream[s.window * 8 + s.t + i] for i in range(s.n)] == [(s.doc_id, s.position + i) for i in range(s.n)]
    pairs = {r.window: r.pairs for r in windows.causal_pairs(seg, ["lang"]).collect()}
    for w in pairs:
        part = [x[0] for x in stream[w * 8 : w * 8 + 8]]
        assert pairs[w] == sum(part[k] == part[q] for q in range(len(part)) for k in range(q + 1))


def test_shifted_windows(spark):
    docs = [("pt", 2, [5, 6, 7]), ("pt", 1, [1, 2]), ("pt", 3, []), ("pt", 4, None), ("pt", 5, [8] * 9), ("es", 6, [4])]
    got = {(r.lang, r.window): (r.x, r.y) for r in windows.shifted_windows(spark.createDataFrame(docs, "lang string, doc_id long, ids array<int>"), ["lang"], 4, 0).collect()}
    stream = [t for _, _, ids in sorted((x for x in docs if x[0] == "pt"), key=lambda x: x[1]) for t in [*(ids or []), 0]]
    assert got == {("pt", w): (stream[4 * w : 4 * w + 4], stream[4 * w + 1 : 4 * w + 5]) for w in range((len(stream) - 1) // 4)}


def test_metrics(spark):
    d = spark.createDataFrame([("pt", "a bb"), ("es", " "), ("pt", "ção")], "lang string, text string")
    got = {(r.tokenizer, r.lang): r for r in metrics.report(d, {"chars": tx.code_points(F.col("text"))}).collect()}
    assert got["chars", "pt"].fertility == round(7 / 3, 6) and got["chars", "pt"].compression_ratio == round(9 / 7, 6)
    assert math.isnan(got["chars", "es"].fertility) and got["chars", "overall"].tokens == 8


def test_scaling_functions(spark):
    w = spark.createDataFrame([(x,) for x in (4, 80, 96, 112, 160, 224, 512, 640)], "w int")
    r = {x.w: x for x in w.select("w", sc.layers_for_width(F.col("w")).alias("n"), sc.heads_for_width(F.col("w")).alias("h")).collect()}
    assert {k: k // x.h for k, x in r.items()} == {4: 4, 80: 80, 96: 48, 112: 56, 160: 80, 224: 56, 512: 64, 640: 64}
    assert (r[512].n, r[512].h) == (8, 8)
    p = w.where("w = 512").select(sc.num_params(F.col("w"), sc.layers_for_width(F.col("w")), 32_000, 1024).alias("p"))
    assert p.first().p == 42_128_384
    b = p.select(sc.tokens_for_budget(F.lit(1e17), F.col("p")).alias("d"), sc.iters_for_budget(F.lit(1e17), F.col("p"), 8, 1024).alias("i")).first()
    assert (b.d, b.i) == (395_616_093, 48_293)
    s = [r[0] for r in spark.createDataFrame([(13524.9,), (65.0,), (9.0,)], "s double").select(sc.duration(F.col("s"))).collect()]
    assert s == ["3h45m24s", "1m05s", "9s"]
    v = [r[0] for r in spark.createDataFrame([(65536,), (32000,), (8192,)], "v int").select(sc.vocab_label(F.col("v"))).collect()]
    assert v == ["65.5k", "32k", "8.2k"]


def test_nearest_width_has_no_upper_end(spark, tmp_path):
    sizes = spark.createDataFrame([(w,) for w in (64, 8192, 16384, 50048)], "w int")
    sizes.select(sc.num_params(F.col("w"), sc.layers_for_width(F.col("w")), analytics.VOCAB, analytics.BLOCK).alias("n_params")).write.parquet(str(tmp_path / "isoflop_results.parquet"))
    assert sorted(r.width for r in analytics.nearest_width(spark, str(tmp_path)).collect()) == [64, 8192, 16384, 50048]


def test_fits(spark):
    x = np.linspace(1, 5, 10)
    rows = [("g", float(a), float(2 * a * a - 12 * a + 20)) for a in x] + [("line", float(a), float(a)) for a in x[:2]] + [("g", float("nan"), 1.0), ("g", 1.0, None)]
    f = {r.g: r for r in fitting.parabolas(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y").collect()}
    assert np.allclose([f["g"].a, f["g"].b, f["g"].c, f["g"].x_min, f["g"].y_min], [2, -12, 20, 3, 2]) and f["line"].a is None
    p = spark.createDataFrame([("k", float(c), float(4 * c**0.5 * (1 + 0.1 * (i % 3)))) for i, c in enumerate(np.geomspace(1e12, 1e18, 8))] + [("two", 1.0, 1.0), ("two", 2.0, 2.0)], "g string, x double, y double")
    laws = {r.g: r for r in fitting.power_laws(p, ["g"], "x", "y").collect()}
    t = p.where("g = 'k'").toPandas()
    e, c = np.polyfit(np.log(t.x), np.log(t.y), 1)
    assert np.allclose([laws["k"].exponent, laws["k"].coefficient], [e, np.exp(c)])
    drops = [np.polyfit(np.log(np.delete(t.x.values, i)), np.log(np.delete(t.y.values, i)), 1)[0] for i in range(8)]
    se = {r.g: r.se for r in fitting.jackknife(p, ["g"], "x", "x", "y").collect()}
    assert np.isclose(se["k"], np.sqrt(7 / 8 * np.sum((drops - np.mean(drops)) ** 2))) and math.isnan(se["two"])


def test_agreement(spark):
    rows = [(0.157, float("nan")), (0.157, 0.163), (0.5, 0.1), (0.0, 0.0), (0.1, 0.0)]
    got = [r.agree for r in fitting.agreement(spark.createDataFrame(rows, "gap double, se double"), "gap", "se").collect()]
    assert got == [None, True, False, True, False]


def test_elbow(spark):
    sizes = [8000, 16000, 32000, 50000, 65536, 100000]
    rows = [("curve", v, y) for v, y in zip(sizes, (3.670, 3.932, 4.140, 4.246, 4.300, 4.360))] + [("line", v, float(i)) for i, v in enumerate(sizes[:5])] + [("one", 8000, 1.0)]
    got = {r.g: (r.chosen, r.knee) for r in fitting.elbows(spark.createDataFrame(rows, "g string, v int, y double"), ["g"], "v", "y").collect()}
    assert got == {"curve": (32000, True), "line": (32000, False), "one": (8000, False)}


def test_chat(spark):
    m = spark.sql("SELECT array(named_struct('role', 'user', 'content', 'hi'), named_struct('role', 'assistant', 'content', null)) AS m")
    t = m.select(chat.render(F.col("m"), True)).first()[0]
    assert t.count(chat.START) == 3 and t.count(chat.TURN) == 2 and t.endswith(f"assistant{chat.END}\n\n")


def test_sources(spark, tmp_path):
    spark.createDataFrame([("a1", "x", 1)], "id string, text string, extra int").write.parquet(str(tmp_path / "one/data"))
    spark.createDataFrame([(7, "y", "z")], "doc_id long, body string, extra string").write.parquet(str(tmp_path / "two/data"))
    src = [readers.Source("one", "hi", "data"), readers.Source("two", "hi", "data", "body", "doc_id")]
    assert {(r.id, r.text, r.source_rank) for r in readers.read_language(spark, str(tmp_path), src, "hi").collect()} == {("a1", "x", 0), ("7", "y", 1)}
    only = readers.read_language(spark, str(tmp_path), src[:1], "hi")
    assert only.first().metadata.extra == 1
    with pytest.raises(ValueError):
        readers.read_language(spark, str(tmp_path), src, "pt")


def test_metadata_struct_folds_every_column(spark, tmp_path):
    t = spark.sql("SELECT 1L AS doc_id, 'x' AS text, 'pt' AS lang, 's' AS source, '{\"k\": 1}' AS metadata, timestamp'2024-01-02 03:04:05' AS crawled_at, 7 AS further")
    t.write.parquet(str(tmp_path / "documents.parquet"))
    row = corpus.metadata_struct(spark, str(tmp_path)).first()
    assert json.loads(row.folded) == {"source": "s", "metadata": '{"k": 1}', "crawled_at": "2024-01-02T03:04:05.000Z", "further": 7} and row.valid_json


def test_packed_and_csv(spark, tmp_path):
    np.array([1, 65535, 0], dtype="<u2").tofile(tmp_path / "t.bin")
    (tmp_path / "empty.bin").touch()
    got = sorted((r.start, r.n, r.tokens) for r in readers.read_packed(spark, str(tmp_path), 2).collect())
    assert got == [(0, 2, [1, 65535]), (2, 1, [0])]
    docs = [(i, [i, 60_000 + i] if i % 3 else None, "val" if i % 5 == 0 else "train") for i in range(1, 40)]
    out = sinks.write_packed(spark.createDataFrame(docs, "doc_id long, ids array<int>, split string"), str(tmp_path / "stream"), 0, 65_536)
    meta = sinks.stream_metadata(out, 65_536, 0).first()
    assert (meta.docs, meta.tokens) == (39, sum(len(ids or ()) + 1 for _, ids, _ in docs))
    for split in ("train", "val"):
        rows = sorted((r.file, r.start, r.tokens) for r in readers.read_packed(spark, str(tmp_path / f"stream/split={split}"), 7).collect())
        assert [t for _, _, part in rows for t in part] == [t for _, ids, s in docs if s == split for t in [*(ids or ()), 0]]
    with pytest.raises(ValueError):
        sinks.write_packed(out, str(tmp_path / "no"), 0, 70_000)
    sinks.write_csv(spark.createDataFrame([(1, "a")], "x int, y string"), str(tmp_path / "c"))
    from pyspark.sql.types import StructType

    assert readers.read_csv(spark, str(tmp_path / "c"), StructType.fromDDL("x int, y string")).collect() == [(1, "a")]
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(tmp_path / "c"), StructType.fromDDL("x int, z string"))


def test_runs_are_appended_once(spark, tmp_path):
    row = spark.createDataFrame([(1e14, 64, 1, 3, 1, 64, 10, 5, 100, 9, 1.0, 2.0, 3.0)], sinks.RUN_SCHEMA)
    for _ in range(2):
        sinks.append_new_runs(spark, row, str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 1
    with pytest.raises(ValueError):
        sinks.append_runs(row.drop("seed"), str(tmp_path / "runs"))


def test_settled_tables(spark):
    assert settle(spark.range(5)).count() == 5 and settle(spark.range(0)).collect() == []
    path = settle(spark.range(3)).inputFiles()[0].rpartition("/")[0].removeprefix("file://")
    assert os.path.isdir(path) and storage.release() > 0 and not os.path.isdir(path)


def test_stage_tables_need_a_shared_folder():
    """On a cluster without spark.checkpoint.dir each executor would write to its own disk."""
    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master="yarn", getConf=lambda: SimpleNamespace(get=lambda k: None)))
    with pytest.raises(RuntimeError):
        storage.shared_dir(unset)


def test_limits_without_the_rest(spark, tmp_path):
    rows = [("pt" if i % 3 else "es", f"{(i * 7919) % 100:03d}", "" if i % 10 == 0 else f"t{i}") for i in range(100)]
    d = spark.createDataFrame(rows, "lang string, id string, text string")
    assert sorted(r.id for r in readers.limited(d, "id", 7).collect()) == [f"{i:03d}" for i in range(7)]
    assert readers.limited(d, "id", 0).collect() == [] and readers.limited(d, "id", -1).count() == 100 and readers.limited(d, "id", 1000).count() == 100
    d.write.partitionBy("lang").parquet(str(tmp_path / "c"))
    got = {(r.lang, r.id) for r in readers.read_processed(spark, str(tmp_path / "c"), 5).collect()}
    want = {(lang, i) for lang in ("pt", "es") for i, t in sorted((i, t) for k, i, t in rows if k == lang)[:5] if t}
    assert got == want and len(readers.list_shards(spark, str(tmp_path / "c"), "pt")) > 0
    with pytest.raises(FileNotFoundError):
        readers.list_shards(spark, str(tmp_path / "c"), "hi")
    d.where("false").write.parquet(str(tmp_path / "none"))
    with pytest.raises(ValueError):
        readers.read_processed(spark, str(tmp_path / "none"))


def test_history_stream(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES (1L, 0L, 2D, 3D, 1D, 0L, 1D, timestamp'2024-01-01 00:10:00', timestamp'2024-01-01 00:10:01'), (1L, 0L, 2D, 3D, 1D, 0L, 1D, timestamp'2024-01-01 00:10:00', timestamp'2024-01-02'), (1L, 1L, 4D, double('NaN'), 1D, 0L, 1D, timestamp'2024-02-01', timestamp'2024-02-01') AS t(run_id, iter, train_loss, val_loss, lr, tokens_seen, elapsed_s, logged_at, arrived_at)")
    rows.write.parquet(str(tmp_path / "in"))
    q = hist.write_available(hist.history_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted((r.run_id, r.iter) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 0), (1, 1)]
    # what is known comes first, whether its id is less or greater; ids decide within the batch; a null language is one too
    text = lambda c: " ".join(f"{c}{i}" for i in range(40))
    shape = "doc_id long, text string, lang string"
    known = dedup.band_keys(dedup.signatures(spark.createDataFrame([(10, text("w"), "pt"), (11, text("n"), None)], shape)))
    new = spark.createDataFrame([(5, text("w"), "pt"), (20, text("w"), "pt"), (6, text("w"), "es"), (3, text("u"), "pt"), (4, text("u"), "pt"), (12, text("n"), None), (13, "short", "pt")], shape)
    assert sorted(r.doc_id for r in hist.dedup_increment(new, known).collect()) == [3, 6, 13]
