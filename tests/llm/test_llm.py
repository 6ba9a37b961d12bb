"""Operators on training data against brute force, exact round trips and edge cases."""

import random
import re
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltworks.llm import bpe_stream, mixing, near_duplicates, packing, queries, scanned_pages, shared_spans, site_lines, text_quality
from siltworks.llm.fm_index import FMIndex

DOCS = "doc_id long, text string, lang string, site string, a long, b long, rep long, h string, n long"
# frequent words first, nouns and verbs after the sixty that frame sentences
_FRAME = "a o de que um uma não e em com para por se foi mas quando porque ainda já cada".split() + [f"quadro{chr(97 + i)}" for i in range(40)]
_NOUNS = "casa ponte livro jornal praça chegou abriu fechou".split() + [a + b for a in ("mont", "barc", "fest", "jard", "vizinh", "quart", "torr", "merc") for b in ("anha", "eiro", "ival", "ado", "ura")]
WORDS = [("pt", w, 1000 - i) for i, w in enumerate(_FRAME + _NOUNS)]


def table(spark, rows):
    """(doc_id, text, lang, site) with further columns whose names operators use inside."""
    return spark.createDataFrame([(*r, 1, 2, 3, "x", 4) for r in rows], DOCS)


def vocabulary(words, n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))


W = [f"w{i}" for i in range(400)]


def words_table(spark):
    return spark.createDataFrame(WORDS, "lang string, word string, cnt long")


EDGE = [
    (1, None, None, None), (2, "", "pt", "s"), (3, "  \n\t ", "pt", None), (4, "word", None, "s"), (5, "x" * 100_000, "xx", "s"), (6, "ab " * 20_000, "pt", "s"),
    (7, "o livro <|endoftext|> \r\n ab", "pt", "s"), (7, "o livro <|endoftext|> \r\n ab", "pt", "s"), (None, "text without id", "pt", "s"), (8, "नमस्ते दुनिया 😀﻿́", "hi", "s"),
]

OPERATORS = {
    "near pairs": lambda s, d: near_duplicates.near_duplicate_pairs(d),
    "near groups": lambda s, d: near_duplicates.near_duplicate_groups(d),
    "span pairs": lambda s, d: shared_spans.shared_span_pairs(d),
    "span shares": lambda s, d: shared_spans.shared_parts(d),
    "near members": lambda s, d: near_duplicates.near_duplicate_members(d),
    "near links": lambda s, d: near_duplicates.near_duplicate_links(d),
    "span members": lambda s, d: shared_spans.shared_span_members(d),
    "passages": lambda s, d: shared_spans.shared_passages(d),
    "sequences": lambda s, d: site_lines.frequent_sequences(d),
    "baselines": lambda s, d: bpe_stream.baseline_counts(d, {"piece": ("sentencepiece", "/opt/tokenizers/piece_bpe_32k.model"), "word": ("tokenizers", "/opt/tokenizers/word_bpe_49k.json")}),
    "ids": lambda s, d: bpe_stream.encode_corpus(d),
    "packing": lambda s, d: packing.pack(bpe_stream.token_counts(d).withColumnRenamed("n_tokens", "size")),
    "lines": lambda s, d: site_lines.repeated_lines(d),
    "without lines": lambda s, d: site_lines.without_repeated_lines(d),
    "scans": lambda s, d: scanned_pages.scan_noise(d, words_table(s)),
    "repaired": lambda s, d: scanned_pages.repaired(d, words_table(s)),
    "kinds": lambda s, d: text_quality.page_kinds(d, words_table(s)),
    "mixture": lambda s, d: mixing.mix_records(d, {"pt": 1.0, "hi": 1.0}),
    "mixed shares": lambda s, d: mixing.mixed_shares(mixing.mix_records(d, {"pt": 1.0, "hi": 1.0}), {"pt": 1.0, "hi": 1.0}),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_cases(spark, name):
    assert OPERATORS[name](spark, table(spark, [])).collect() == []
    rows = OPERATORS[name](spark, table(spark, EDGE)).collect()
    if name == "ids":
        got = {r.doc_id: r.ids for r in rows}
        assert got[1] == [] and got[2] == [] and len(rows) == len(EDGE)
    if name in ("without lines", "repaired"):
        assert {r.doc_id: r.text for r in rows}[1] is None
    if name == "kinds":
        assert {r.doc_id: r.kind for r in rows}[3] == "empty"
    if name == "near groups":
        assert {r.doc_id: r.group_id for r in rows} == {i: i for i in range(1, 9)}
    if name == "span shares":
        assert {r.doc_id: r.share for r in rows}[1] == 0
    if name in ("near pairs", "span pairs", "near links", "passages", "sequences"):
        assert rows == []
    if name in ("near members", "span members"):
        assert {r.doc_id: (r.rep, r.links) for r in rows} == {i: (i, 0) for i in ((6,) if name == "near members" else (5, 6))}
    if name == "baselines":
        assert len(rows) == len(EDGE) and {r.doc_id: r.t_piece for r in rows}[1] == 0 and {r.doc_id: r.t_word for r in rows}[2] == 0


def test_split_quotas_exact():
    q = np.array([1000, 37, 0, 411])
    for shards in (1, 3, 8):
        m = mixing.split_quotas(q, shards, 7)
        assert m.sum(axis=0).tolist() == q.tolist()
        assert m.sum(axis=1).max() - m.sum(axis=1).min() <= 1
        assert (m == mixing.split_quotas(q, shards, 7)).all()


def test_split_of_any_number_of_blocks():
    """10^11 and more blocks; and small draws against numpy's own."""
    for total in (10**9, 10**11, 3 * 10**12):
        q = np.array([total // 2, total // 3, total - total // 2 - total // 3 - 5, 5])
        m = mixing.split_quotas(q, 8, 3)
        assert m.sum(axis=0).tolist() == q.tolist() and m.sum(axis=1).max() - m.sum(axis=1).min() <= 1
        # each shard's part is within six standard deviations of its share
        assert (np.abs(m - q / 8) <= 6 * np.sqrt(q / 8) + 5).all() and m.std(axis=0)[0] > 0
    mine, theirs = np.random.default_rng(1), np.random.default_rng(2)
    for good, bad, n in ((5, 7, 4), (300, 20, 100), (3, 900, 450), (1000, 1000, 1)):
        x = np.array([mixing.hypergeometric(mine, good, bad, n) for _ in range(4000)])
        y = theirs.hypergeometric(good, bad, n, 4000)
        assert x.min() >= max(0, n - bad) and x.max() <= min(good, n)
        assert abs(x.mean() - y.mean()) < 0.1 * (y.std() + 0.1) and abs(x.std() - y.std()) < 0.1 * (y.std() + 0.1)


@given(st.lists(st.integers(0, 9), min_size=1, max_size=6), st.integers(0, 60), st.integers(1, 9), st.integers(0, 8))
def test_unplaced_is_what_the_supply_lacks(blocks, supply, block, short):
    wanted = max(0, sum(blocks) * block - min(short, block - 1)) if sum(blocks) else 0
    missing = mixing.unplaced(np.array(blocks), wanted, supply, block)
    assert missing.sum() == max(0, wanted - supply) and (missing >= 0).all() and (missing <= np.array(blocks) * block).all()


@given(st.integers(1, 3000), st.integers(0, 99))
@settings(max_examples=30, deadline=None)
def test_permuted_is_bijection(n, seed):
    assert sorted(mixing.permuted(np.arange(n), n, seed).tolist()) == list(range(n))


def test_mix_plans(spark):
    stats = spark.sql(
        """SELECT * FROM VALUES (1L, 'PT', 100L, timestamp'2024-01-02'), (1L, ' por_Latn', 999L, timestamp'2024-01-01'), (1L, 'es', null, timestamp'2024-01-01'),
           (1L, 'TOTAL', 5000L, timestamp'2024-02-01') AS t(sample_id, lang, train_chars, measured_at)"""
    )
    plans = spark.sql("SELECT * FROM VALUES (1L, 1L, 'pt:9, pt:1,es:1,hi:0', 400L, 2), (2L, 1L, 'pt:2', 100L, 1), (3L, null, null, null, null) AS t(mix_id, sample_id, lang_ratios, total_chars, max_repeats)")
    rows = {(r.mix_id, r.lang): r for r in mixing.plan_blocks(plans, stats, mixing.Mixing(shards=4, block_chars=10)).collect()}
    assert set(rows) == {(1, "pt"), (1, "es"), (2, "pt")}
    assert (rows[1, "pt"].used_chars, rows[1, "pt"].short, rows[1, "pt"].uses) == (200, False, 2.0)
    assert (rows[1, "es"].used_chars, rows[1, "es"].short) == (0, True)
    assert sum(rows[1, "pt"].shard_blocks) == rows[1, "pt"].used_blocks == 20 and rows[1, "es"].blocks == 20
    assert sum(rows[1, "es"].shard_unplaced) == 200 and not any(rows[1, "pt"].shard_unplaced) and not sum(rows[1, "es"].shard_blocks)
    assert len(mixing.plan_blocks(plans, stats, mixing.Mixing(shards=1, shard_chars=7)).where("mix_id = 1").first().shard_blocks) == 58
    assert [tuple(r) for r in mixing.unreachable(plans, stats).collect()] == [(1, "es")]


def test_mix_records_shares(spark):
    rows = [(i, vocabulary(W, 40, i), "pt" if i % 4 else "hi", "s") for i in range(800)]
    out = mixing.mix_records(table(spark, rows), {"pt": 1.0, "hi": 1.0}, max_repeats=2).collect()
    assert len({(r.doc_id, r["copy"]) for r in out}) == len(out)
    assert max(r["copy"] for r in out) <= 1
    by = {lang: sum(r.lang == lang for r in out) for lang in ("pt", "hi")}
    assert abs(by["hi"] - 400) <= 40 and abs(by["pt"] - 400) <= 40
    assert {r.shard for r in out} == set(range(8))
    shares = {(r.lang, r.shard): r for r in mixing.mixed_shares(mixing.mix_records(table(spark, rows), {"pt": 1.0, "hi": 1.0}, max_repeats=2), {"pt": 1.0, "hi": 1.0}).collect()}
    assert len(shares) == 18 and all(r.wanted_share == 0.5 for r in shares.values()) and abs(shares["hi", None].share - 0.5) < 0.05
    assert all(abs(shares["hi", k].share + shares["pt", k].share - 1) < 1e-6 for k in [None, *range(8)])
    assert shares["pt", 3].chars == sum(len(rows[r.doc_id][1]) for r in out if r.lang == "pt" and r.shard == 3)


def sets(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_near_duplicates_brute_force(spark):
    r = random.Random(3)
    rows = []
    for i in range(40):
        base = vocabulary(W, 150, i).split()
        rows.append((10 * i, " ".join(base), "pt", "s"))
        for k, edits in enumerate((1, 3, 6, 14)):
            w = list(base)
            for _ in range(edits):
                w[r.randrange(len(w))] = "edit"
            rows.append((10 * i + k + 1, "  ".join(w).upper() if k == 1 else " ".join(w), "pt", "t"))
        rows.append((10 * i + 7, "\n".join(base), "es", None))
    truth = set()
    ss = {d: sets(t) for d, t, _, _ in rows}
    for a in ss:
        for b in ss:
            if a < b and len(ss[a] & ss[b]) >= 0.6 * len(ss[a] | ss[b]):
                truth.add((a, b))
    got = {tuple(x) for x in near_duplicates.near_duplicate_pairs(table(spark, rows)).collect()}
    assert got <= truth and len(got) >= 0.97 * len(truth)
    groups = {x.doc_id: x.group_id for x in near_duplicates.near_duplicate_groups(table(spark, rows)).collect()}
    assert all(groups[a] == groups[b] for a, b in got) and groups[7] == 0
    assert near_duplicates.Banding().recall(0.6) > 0.95


def test_hot_group_of_near_copies_is_whole(spark):
    """More members than a block holds: all pairs of different texts still come out."""
    base = vocabulary(W, 120, 5).split()
    rows = [(i, " ".join(base[:60] + [f"id{i}"] + base[60:]), "pt", "s") for i in range(150)]
    assert near_duplicates.near_duplicate_pairs(table(spark, rows)).count() == 150 * 149 // 2


def test_members_and_links_are_all_pairs(spark):
    """A class of 100 copies, an edited text and one that stands alone: no link of a copy is lost, and members tell their number."""
    text = vocabulary(W, 90, 8)
    rows = [(i, text, "pt", "s") for i in range(100)] + [(1000, text.replace(text.split()[4], "other", 1), "pt", "s"), (1001, vocabulary(W, 90, 9), "pt", "s")]
    d = table(spark, rows)
    ids = [*range(100), 1000]
    for pairs, members in ((near_duplicates.near_duplicate_pairs, near_duplicates.near_duplicate_members), (shared_spans.shared_span_pairs, shared_spans.shared_span_members)):
        assert {tuple(x) for x in pairs(d).collect()} == {(a, b) for a in ids for b in ids if a < b}
        assert {(x.doc_id, x.rep, x.links) for x in members(d).collect()} == {(i, 0, 100) for i in range(100)} | {(1000, 1000, 100), (1001, 1001, 0)}
    assert [(x.rep_a, x.rep_b) for x in near_duplicates.near_duplicate_links(d).collect()] == [(0, 1000)]


def test_queries_pair_every_copy_of_large_classes(spark, tmp_path):
    """Two classes of more than 64 copies and a text near both, at least one of which takes several blocks: no pair is left to the least id."""
    text = vocabulary(W, 90, 8)
    near, other = (text.replace(text.split()[k], "other", 1) for k in (4, 80))
    rows = [(i, text, "pt", "s") for i in range(150)] + [(i, near, "pt", "s") for i in range(500, 570)] + [(1000, other, "pt", "s"), (1001, vocabulary(W, 90, 9), "pt", "s")]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    ids = [r[0] for r in rows if r[0] != 1001]
    truth = {(a, b) for a in ids for b in ids if a < b}
    for name in ("p5_found", "p8_found"):
        got = [tuple(x) for x in queries.queries()[name](spark, str(tmp_path)).collect()]
        assert len(got) == len(set(got)) and set(got) == truth, name


def test_shared_spans_brute_force(spark):
    r = random.Random(4)
    shared = [vocabulary(W, 140, 100 + i) for i in range(6)]
    rows = []
    for i in range(60):
        t = vocabulary(W, 120, i)
        if i % 3 == 0:
            s = r.choice(shared)
            n = r.choice((250, 299, 300, 301, 420))
            at = r.randrange(len(s) - n)
            cut = r.randrange(len(t))
            t = t[:cut] + s[at : at + n] + t[cut:]
        rows.append((i, t, "pt", "s"))
    rows += [(100, rows[0][1], "pt", "s"), (101, "\0" * 400, "pt", "s"), (102, "\0" * 350, "pt", "s")]
    text = {d: t for d, t, _, _ in rows}
    grams = {d: {t[i : i + 300] for i in range(len(t) - 299)} for d, t in text.items()}
    truth = {(a, b) for a in text for b in text if a < b and grams[a] & grams[b]}
    d = table(spark, rows)
    assert {tuple(x) for x in shared_spans.shared_span_pairs(d).collect()} == truth
    for x in shared_spans.shared_parts(d).collect():
        t, other = text[x.doc_id], set().union(*(g for e, g in grams.items() if e != x.doc_id))
        cover = np.zeros(len(t), bool)
        for i in range(len(t) - 299):
            if t[i : i + 300] in other:
                cover[i : i + 300] = True
        assert x.shared_chars == cover.sum(), x.doc_id


def test_query_of_shared_passages(spark, tmp_path):
    """Every passage at its places, against all maximal runs; the texts with passages have copies, which the members name."""
    one, two = vocabulary(W, 100, 40)[:400], vocabulary(W, 100, 41)[:310]
    texts = [vocabulary(W, 60, 50 + i) for i in range(4)]
    texts = [texts[0] + one + texts[0][:40] + two, one + "#" + texts[1], "%" + two + texts[2] + one, texts[3] + two[:299]]
    rows = [(k if k < 4 else 10 * k, texts[k % 4 if k < 6 else 1], "pt", "s") for k in range(80)]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    text, truth, runs = {r[0]: r[1] for r in rows}, set(), {}
    for x in texts:
        for y in texts:
            if x == y:
                runs[x, y] = [(0, 0, len(x))]
                continue
            a, b, found = np.array(list(x)), np.array(list(y)), []
            for shift in range(-len(b) + 1, len(a)):
                lo, hi = max(0, shift), min(len(a), len(b) + shift)
                same = np.concatenate([[0], (a[lo:hi] == b[lo - shift : hi - shift]).astype(int), [0]])
                for i, j in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)):
                    if j - i >= 300:
                        found.append((int(lo + i), int(lo + i - shift), int(j - i)))
            runs[x, y] = found
    for a in text:
        for b in text:
            if a < b and text[a] != text[b]:
                truth |= {(a, i, b, j, n) for i, j, n in runs[text[a], text[b]]}
    reps, members = {}, {}
    for x in queries.queries()["p8_members"](spark, str(tmp_path)).collect():
        reps[x.doc_id] = x.rep
        members.setdefault(x.rep, []).append(x.doc_id)
    assert all((reps[a] == reps[b]) == (text[a] == text[b]) for a in text for b in text)
    got = [tuple(x) for x in queries.queries()["p8_spans"](spark, str(tmp_path)).collect()]
    every = {(x, i, y, j, n) if x < y else (y, j, x, i, n) for a, i, b, j, n in got for x in members[a] for y in members[b]}
    assert len(got) == len(set(got)) and every == truth and {x[4] for x in got} == {310, 400}


def test_span_blocks_of_a_hot_anchor(spark):
    s = vocabulary(W, 130, 9)
    rows = [(i, vocabulary(W, 30, i) + s + vocabulary(W, 30, 500 + i), "pt", "s") for i in range(30)]
    p = shared_spans.Spans(block_chars=5000, shard_chars=5000, hits=500)
    assert shared_spans.shared_span_pairs(table(spark, rows), p).count() == 30 * 29 // 2


def test_hot_passage_in_bounded_memory():
    """What one task of a hot passage holds: two blocks of records that all share 5,000 characters, within 1 GB; every pair comes out."""
    import tracemalloc

    p, s = shared_spans.Spans(), vocabulary(W, 1300, 9)[:5000]
    texts = [vocabulary(W, 60, i) + s + vocabulary(W, 60, 5000 + i) for i in range(208)]
    half = np.arange(208) < 104
    tracemalloc.start()
    found = shared_spans.find_spans(np.arange(208), np.zeros(208, np.int64), texts, p, half, ~half)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1e9 and len(found[["a", "b"]].drop_duplicates()) == 104 * 104 and found["n"].min() >= 5000


def test_long_near_copies(spark):
    """Two texts of four million characters with 2,000 changes: work in proportion to their length, all passages between the changes."""
    import time

    text = list(vocabulary(W, 1_050_000, 3)[:4_000_000])
    other, r = list(text), random.Random(4)
    for _ in range(2000):
        other[r.randrange(len(other))] = "#"
    at = [-1, *(i for i in range(len(text)) if text[i] != other[i]), len(text)]
    want = {(i + 1, j - i - 1) for i, j in zip(at, at[1:]) if j - i - 1 >= 300}
    began = time.time()
    got = shared_spans.shared_passages(table(spark, [(1, "".join(text), "pt", "s"), (2, "".join(other), "pt", "s")])).collect()
    assert time.time() - began < 60 and {(x.at_a, x.n_chars) for x in got if x.at_a == x.at_b} == want


def test_periodic_texts(spark):
    rows = [(1, "ab " * 8000, "pt", "s"), (2, "ab " * 7000 + "x", "pt", "s"), (3, "\0" * 3000, "pt", "s"), (4, "\0" * 2000, "pt", "s")]
    p = shared_spans.Spans(piece=5000, hits=100_000)
    assert {tuple(x) for x in shared_spans.shared_span_pairs(table(spark, rows), p).collect()} == {(1, 2), (3, 4)}
    assert {x.doc_id: x.shared_chars for x in shared_spans.shared_parts(table(spark, rows), p).collect()} == {1: 24000, 2: 21000, 3: 3000, 4: 2000}


@given(st.lists(st.text("ab", max_size=40), min_size=2, max_size=6))
@settings(max_examples=60, deadline=None)
def test_spans_equal_all_maximal_runs(texts):
    """Small windows, pieces of a few places at a time, against every maximal run of two texts."""
    p = shared_spans.Spans(least=6, gram=3, stride=2, hits=7)
    want = set()
    for a, x in enumerate(texts):
        for b, y in enumerate(texts):
            if a < b:
                for i in range(len(x)):
                    for j in range(len(y)):
                        if not (i and j and x[i - 1] == y[j - 1]):
                            n = 0
                            while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                                n += 1
                            if n >= 6:
                                want.add((a, i, b, j, n))
    got = shared_spans.find_spans(np.arange(len(texts)), np.zeros(len(texts), np.int64), texts, p)
    assert {tuple(map(int, x)) for x in got.itertuples(index=False)} == want


@given(st.lists(st.text("abc", max_size=30), min_size=1, max_size=5), st.text("abcd", min_size=1, max_size=40))
@settings(max_examples=60, deadline=None)
def test_matching_statistics(texts, query):
    t = np.concatenate([np.array([ord(c) - 96 for c in x] + [0]) for x in texts])
    fm = FMIndex(t, 5, sample=3)
    q = np.array([ord(c) - 96 for c in query])
    ends = np.arange(1, len(q) + 1)
    n, lo, hi = fm.statistics(q, ends, np.minimum(ends, 7))
    for e, k, a, b in zip(ends, n, lo, hi):
        best = max(m for m in range(min(e, 7) + 1) if m == 0 or any(query[e - m : e] in x for x in texts))
        assert k == best
        if k:
            assert sorted(fm.locate(np.arange(a, b))) == [i for i in range(len(t)) if list(t[i : i + k]) == list(q[e - k : e])]


@given(st.text("abc", min_size=1, max_size=80), st.text("abc", min_size=1, max_size=5))
@settings(max_examples=60, deadline=None)
def test_fm_index_counts(text, pattern):
    s = np.array([ord(c) - 96 for c in text] + [0])
    fm = FMIndex(s)
    lo, hi = np.array([0]), np.array([len(s)])
    for c in reversed(pattern):
        lo, hi = fm.step(np.array([ord(c) - 96]) if ord(c) - 96 <= s.max() else np.array([0]), lo, hi)
        if ord(c) - 96 > s.max():
            return
    assert max(0, hi[0] - lo[0]) == len(re.findall(f"(?={pattern})", text))


@pytest.fixture(scope="module")
def bpe():
    return bpe_stream.StreamingBpe(open(bpe_stream.VOCABULARY).read())


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe_stream.VOCABULARY)
    t.encode_special_tokens = True
    return t


@given(st.text(max_size=200))
@settings(max_examples=200, deadline=None)
def test_encoding_equals_the_public_library(bpe, public, text):
    ids = np.frombuffer(bpe.encode(text), np.int32).tolist()
    assert ids == public.encode(text, add_special_tokens=False).ids
    assert bpe.decode(ids) == text


@pytest.mark.parametrize("alphabet", ["a", "ab", "-=", "aeiou", "xX", "अआकि", "thein", "ãõ"])
def test_streaming_equals_whole(bpe, alphabet):
    r = random.Random(alphabet)
    data = "".join(r.choice(alphabet) for _ in range(9000)).encode()
    assert list(bpe.stream(data)) == bpe._merge(data)
    assert 0 < bpe.lookahead < 1000


def test_stretches_of_a_long_text(bpe, public):
    """Cut anywhere before white space, one stretch at a time, with the same ids."""
    r = random.Random(9)
    text = "".join(r.choice(["casa", " ", "  ", "\n", "\u3000", "ção", "12", "!?", "\t ", "नमस्ते"]) for _ in range(3000))
    whole = public.encode(text, add_special_tokens=False).ids
    for most in (1, 7, 100, 1 << 16):
        parts = list(bpe.stretches(text, most))
        assert "".join(u for units in parts for u in units) == text and (most > 100 or len(parts) > 50)
        assert [t for units in parts for u in units for t in np.frombuffer(bpe.pieces(u), np.int32).tolist()] == whole
    long = "a b " * 40_000
    assert len(list(bpe.encode_stream(long))) == 3 and np.frombuffer(bpe.encode(long), np.int32).tolist() == public.encode(long, add_special_tokens=False).ids


def test_special_strings_are_text(bpe, public):
    assert np.frombuffer(bpe.encode("a<|endoftext|>b"), np.int32).tolist() == public.encode("a<|endoftext|>b", add_special_tokens=False).ids
    assert 50256 not in np.frombuffer(bpe.encode("<|endoftext|>"), np.int32)


def test_round_trip_on_spark(spark):
    texts = {1: "Olá, mundo!\r\n\n  x", 2: "नमस्ते 😀", 3: None, 4: ""}
    ids = bpe_stream.encode_corpus(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r.doc_id: r.text for r in bpe_stream.decode_corpus(ids).collect()} == {k: v or "" for k, v in texts.items()}


def test_report_of_the_public_vocabulary(spark, public, tmp_path):
    rows = [(1, "o livro é da casa", "pt", "s"), (2, "el libro 😀", "es", "s"), (3, "नमस्ते दुनिया", "hin_Deva", "s"), (4, None, "pt", "s"), (5, "sem língua", None, "s")]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.lang: (r.tokens, r.fertility, r.compression_ratio) for r in queries.queries()["p6_report"](spark, str(tmp_path)).collect()}
    want = {}
    for lang, texts in {"pt": [rows[0][1]], "es": [rows[1][1]], "hi": [rows[2][1]], "overall": [r[1] for r in rows[:3]]}.items():
        n, w, b = (sum(map(f, texts)) for f in (lambda t: len(public.encode(t, add_special_tokens=False).ids), lambda t: len(t.split()), lambda t: len(t.encode())))
        want[lang] = (n, pytest.approx(n / w, abs=1e-6), pytest.approx(b / n, abs=1e-6))
    assert got == want
    rows = {(r.tokenizer, r.lang): r for r in queries.queries()["p6_baselines"](spark, str(tmp_path)).collect()}
    assert {k for k, _ in rows} == {"byte_bpe_50k", "byte_bpe_multi_50k", "word_bpe_49k", "piece_bpe_32k"} and len(rows) == 16
    assert {lang: rows["byte_bpe_50k", lang].tokens for lang in want} == {lang: n for lang, (n, *_) in want.items()}
    import sentencepiece

    piece = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    assert rows["piece_bpe_32k", "es"].tokens == len(piece.encode("el libro 😀"))


@given(st.lists(st.integers(0, 100), max_size=60))
@settings(max_examples=100, deadline=None)
def test_packing_and_bound(sizes):
    s = np.array(sizes, dtype=np.int64)
    bins = packing.best_fit_decreasing(s, 100)
    if len(s):
        assert np.bincount(bins, weights=s).max() <= 100
        assert packing.lower_bound(s, 100) <= bins.max() + 1


def test_lower_bound_of_halves():
    assert packing.lower_bound(np.full(9, 51), 100) == 9
    assert packing.lower_bound(np.full(9, 34), 100) == 5  # three do not fit, though their sum would


def test_pack_on_spark(spark):
    r = random.Random(1)
    rows = [(i, r.randrange(1, 1500)) for i in range(900)] + [(1000, 10_000), (1001, 4096), (1002, 0), (1003, None), (1004, 4097)]
    p = packing.Packing(partition_items=200)
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, size long"), p).collect()
    fill = {}
    for x in out:
        fill[x.container] = fill.get(x.container, 0) + x["size"]
    assert max(fill.values()) <= 4096
    total = {}
    for x in out:
        total[x.doc_id] = total.get(x.doc_id, 0) + x["size"]
    assert total == {d: n or 0 for d, n in rows}
    assert {x.doc_id for x in out if x.piece} == {1000, 1004}
    assert len(fill) <= 1.02 * sum(total.values()) / 4096 + 6
    d = packing.pack(spark.createDataFrame(rows, "doc_id long, size long"), p)
    c = packing.certified(d, p).first()
    assert (c["items"], c.containers) == (905, len(fill)) and 0 <= c.gap == c.containers - c.lower_bound and abs(c.fill - sum(total.values()) / len(fill) / 4096) < 1e-6
    assert {x.doc_id for x in packing.split_items(d).collect()} == {1000, 1004}
    twice = packing.pack(spark.createDataFrame([(1, 4000), (1, 4000), (2, 5000), (2, 5000)], "doc_id long, size long"), p)
    assert [x.doc_id for x in packing.split_items(twice).collect()] == [2]
    none = packing.certified(packing.pack(d.where("false").select("doc_id", "size"), p), p).first()
    assert tuple(none) == (0, 0, 0, 0, 0.0)


def test_exchange_saves_containers(spark):
    """Partitions of few items, most of them optimal by their own bound, leave a container partly filled each: across partitions fewer do.
    And two partitions are packed as one if that saves a container, else they stay as they are, each container by itself."""
    r = random.Random(2)
    items = spark.createDataFrame([(i, r.randrange(100, 900)) for i in range(640)], "doc_id long, size long")
    own, all_ = (packing.certified(packing.pack(items, packing.Packing(partition_items=20, loose=x))).first() for x in (0.0, 0.9))
    assert own.lower_bound == all_.lower_bound and own.gap >= 8 and all_.gap <= 3
    exchange = packing._exchange(packing.Packing(capacity=100))
    for size, bins, made in ((50, 3, 2), (60, 6, 3)):
        rows = [(k, 0, size, 7, 0, made, 0, old, i * size // 100 if size == 50 else i) for old in (1, 2) for i, k in enumerate(range(3 * old, 3 * old + 3))]
        df = pd.DataFrame(rows, columns=["doc_id", "piece", "size", "part", "gap", "made", "saved", "old", "bin"])
        out = exchange(df)
        assert out["bin"].nunique() == bins and out["made"].eq(bins).all() and out["gap"].eq(0).all() and out["saved"].eq(2 * made - bins).all()


def test_site_lines(spark):
    line, other = "Todos  os DIREITOS reservados 12", "Compartilhe esta página agora"
    rows = [(i, f"texto próprio número {'x' * i}\n{line.lower() if i % 2 else line} \n{other} {i}\nfim", "pt", "a") for i in range(6)]
    rows += [(10 + i, f"{line}\noutro", "pt", "b") for i in range(5)] + [(20, line, "pt", None), (21, f"{line}\n{line}", "pt", "b")]
    d = table(spark, rows + rows[:2])
    got = {(x.doc_id, x.line_no): x.longest for x in site_lines.repeated_lines(d).collect()}
    assert got == {**{(i, k): 2 for i in range(6) for k in (2, 3)}, **{(10 + i, 1): 1 for i in range(5)}, (21, 1): 1, (21, 2): 1}
    clean = {x.doc_id: x.text for x in site_lines.without_repeated_lines(table(spark, rows)).collect()}
    assert clean[3] == "texto próprio número xxx\nfim" and clean[20] == line and clean[21] == ""
    names = {(x.site, x.length, x.support) for x in site_lines.frequent_sequences(d).collect()}
    assert names == {("a", 2, 6), ("b", 1, 6)}  # in a, neither line ever stands without the other


def test_notice_of_five_lines(spark):
    """Five lines that six documents have in this order, the first of them once more in two documents: one sequence of five, and the first line."""
    lines = [f"linha comum do sítio, {w} parte" for w in ("primeira", "segunda", "terceira", "quarta", "quinta")]
    rows = [(i, "\n".join([*lines[:3], f"texto próprio {'x' * i}", *lines[3:], *(lines[:1] if i < 2 else [])]), "pt", "a") for i in range(6)]
    d = table(spark, rows)
    got = [(x.length, x.lines, x.support) for x in site_lines.frequent_sequences(d).collect()]
    assert sorted(got) == [(1, lines[0], 6), (5, " / ".join(lines), 6)]
    assert {(x.doc_id, x.line_no): x.longest for x in site_lines.repeated_lines(d).collect()} == {**{(i, k): 5 for i in range(6) for k in (1, 2, 3, 5, 6)}, (0, 7): 1, (1, 7): 1}


def test_closed_sequences_brute_force(spark):
    """Against all runs of frequent lines: those in six documents that no longer run has as many places of. Rows are all places of lines in six documents."""
    r = random.Random(11)
    lines = [f"linha comum do sítio número {w} do texto" for w in "abcdefgh"]
    rows = []
    for i in range(60):
        chosen = r.choice(([0, 1, 2, 3], [0, 1, 2, 3, 4], [5, 0, 1], [6, 7], [6, 7, 6, 7], [2, 3, 6], [4])) + r.choice(([], [5], [0, 1]))
        text = []
        for k in chosen:
            text += [lines[k] + str(r.randrange(99))] + [f"próprio texto {i} {'y' * r.randrange(30)}" for _ in range(r.randrange(2))]
        rows.append((i, "\n".join(text), "pt", "ab"[i % 2]))
    keep = lambda x: re.sub(r"\d+", "", x)
    have: dict = {}
    for i, text, _, site in rows:
        for x in set(map(keep, text.split("\n"))):
            have.setdefault((site, x), set()).add(i)
    often = {x for x, ds in have.items() if len(ds) >= 6}
    want_rows = {(i, n) for i, text, _, site in rows for n, x in enumerate(text.split("\n"), 1) if (site, keep(x)) in often and len(keep(x)) >= 20}
    places, docs = {}, {}
    for i, text, _, site in rows:
        s = [keep(x) for x in text.split("\n") if (site, keep(x)) in often and len(keep(x)) >= 20]
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                run = (site, *s[a:b])
                places[run] = places.get(run, 0) + 1
                docs.setdefault(run, set()).add(i)
    longer = {(run[0], *part, n) for run, n in places.items() for part in (run[1:-1], run[2:])}
    want = {(run[0], len(run) - 1, " / ".join(run[1:]), len(docs[run])) for run, n in places.items() if len(docs[run]) >= 6 and (*run, n) not in longer}
    d = table(spark, rows)
    assert {tuple(x) for x in site_lines.frequent_sequences(d).collect()} == want and len(want) > 8
    assert {(x.doc_id, x.line_no) for x in site_lines.repeated_lines(d).collect()} == want_rows


def test_long_notices(spark):
    """300 documents with a notice of 80 lines, one of which each document leaves out or not."""
    lines = [f"linha comum do sítio, parte {chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)]
    r = random.Random(5)
    whole = [(i, "\n".join(lines), "pt", "a") for i in range(300)]
    d = table(spark, whole)
    assert [(x.length, x.support) for x in site_lines.frequent_sequences(d).collect()] == [(80, 300)]
    short = lines[:20]
    cut = [(i, "\n".join(x for k, x in enumerate(short) if k != out), "pt", "a") for i in range(300) for out in [r.randrange(40)]]
    got = {(x.doc_id, x.line_no) for x in site_lines.repeated_lines(table(spark, cut)).collect()}
    assert got == {(i, n) for i, text, _, _ in cut for n in range(1, text.count("\n") + 2)}


PAGE = """o livro que foi de casa para a pon-
te e não abriu a praça que ainda já
jomal de casa e com um livro para
A CASA DO LIVRO
12
cada ponte que foi de casa e fechou
com p0nte de casa para um jor¬
nal que a casa de um livro não abriu
A CASA DO LIVR0
13
porque a praça não foi de casa em um
livro que já fechou a ponte de casa."""


def test_scanned_page(spark):
    plain = [(i, "o livro que foi de casa para a ponte e não abriu a praça.", "pt", "s") for i in range(2, 40)]
    d = table(spark, [(1, PAGE, "pt", "s"), *plain])
    got = {(x.doc_id, x.line_no, x.kind) for x in scanned_pages.scan_noise(d, words_table(spark)).collect()}
    assert got == {(1, 1, "broken"), (1, 3, "misread"), (1, 4, "furniture"), (1, 5, "furniture"), (1, 7, "misread"), (1, 7, "broken"), (1, 9, "furniture"), (1, 10, "furniture")}
    text = {x.doc_id: x.text for x in scanned_pages.repaired(d, words_table(spark)).collect()}
    assert "para a ponte e não" in text[1] and "um jornal que a casa" in text[1] and "13" not in text[1] and "\n" not in text[1]
    assert text[2] == plain[0][1]


def test_long_book():
    """2,000 pages of 30 lines with running headers, a fifth of them misread, and numbers at the ends of other lines: in seconds."""
    import time

    r, lines, want = random.Random(1), [], set()
    for k in range(2000):
        want.add(len(lines))
        title = "HISTÓRIA DE UMA CASA" if k % 2 else "VIAGENS ATÉ A PONTE"
        at = r.randrange(len(title))
        lines.append(f"{title if r.random() < 0.8 else title[:at] + '1' + title[at + 1:]} {k + 1}")
        for _ in range(30):
            line = vocabulary([w for w in _FRAME + _NOUNS if not w.startswith("quadro")], 14, r.random())[:66].strip()
            lines.append(line + (f" 1{r.randrange(1000)}" if r.random() < 0.05 else ""))
    began = time.time()
    got = scanned_pages.furniture(lines, scanned_pages.page_width(lines))
    assert time.time() - began < 5 and len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)


def test_headers_far_apart_in_order():
    """Headers without a number, misread at both ends, or with 30 others between them and the ones they are alike to from either side."""
    r, lines, want = random.Random(7), [], set()
    letters = lambda: "".join(r.choice("BCDFGHJKLMQRSXZ") for _ in range(25))
    between = [f"VIAGENS AU{letters()}" for _ in range(30)] + [f"{letters()}UÉ A PONTE" for _ in range(30)]
    for k in range(120):
        want.add(len(lines))
        lines.append(f"{between[k // 2] if k % 2 else 'VIAGENS ATÉ A PONTE'} {k + 1}" if k % 10 else ("QIAGENS ATÉ A PONTQ", "VIAGENS AXÉ A PONTE")[k // 10 % 2])
        lines += [vocabulary([w for w in _FRAME + _NOUNS if not w.startswith("quadro")], 14, r.random())[:66].strip() for _ in range(9)]
    assert scanned_pages.furniture(lines, scanned_pages.page_width(lines)) == want


def test_headers_against_all_with_all():
    r, keys = random.Random(3), set()
    for _ in range(50):
        ab = "abcdefghijklmnopqrstuvwxyzáéि "[: r.choice([2, 4, 30])]
        key = [r.choice(ab) for _ in range(r.choice([1, 3, 8, 20, 40]))]
        keys |= {scanned_pages._key("".join(r.choice(ab) if r.random() < 0.15 else c for c in key if r.random() > 0.05)) for _ in range(3)}
    keys = sorted(keys - {""} | {"x" * 300, "x" * 250})
    headers = scanned_pages.Headers(keys)
    alike = lambda x, y: abs(len(x) - len(y)) <= 0.3 * max(len(x), len(y)) and SequenceMatcher(None, x, y, autojunk=False).ratio() > 0.75
    for x in keys:
        assert headers.has(x, 1) == any(alike(x, y) for y in keys if y != x), x


def test_gates_of_pages():
    """Each gate is a setting: with another value the page passes or not."""
    text, lists = PAGE, {"pt": {w for _, w, _ in WORDS}}
    found = lambda p: scanned_pages.analyse(text, lists, scanned_pages._punctuation(), p) is not None
    assert found(scanned_pages.Scans())
    for gate in ({"least_lines": 13}, {"widths": (50, 110)}, {"widths": (20, 30)}, {"full_lines": 0.99}, {"open_lines": 1.01}, {"line_words": 12.0}, {"listed": 0.99}):
        assert not found(scanned_pages.Scans(**gate)), gate


def test_page_numbers():
    assert [scanned_pages.page_number(x) for x in ("— 12 —", "[९]", "xiv", "Página 3", "पृष्ठ ७३ / ११३", "texto 5", "1a")] == [12, 9, 14, 3, 73, None, None]


def test_mixture_moves_to_the_data(spark):
    """Rows lie around places a good way off the examples that components start at: the components end there, and the mixture says more of the rows."""
    rng = np.random.default_rng(4)
    chosen = [0, 7, 11, 15]
    places = np.array([text_quality.EXAMPLES[i][2] for i in chosen]) + rng.normal(0, 0.05, (4, len(text_quality.STATISTICS)))
    rows = [(row.tolist(),) for c in places for row in c + rng.normal(0, 0.02, (150, len(c)))]
    stats = spark.createDataFrame(rows, "s array<double>")
    z = np.array([x for (x,) in rows])
    off, said = {}, {}
    for rounds in (0, 15):
        model, center, scale = text_quality.fit_mixture(stats, text_quality.Mixture(rounds=rounds))
        off[rounds] = max(np.abs(model.means * scale + center - c).max(axis=1).min() for c in places)
        said[rounds] = model.responsibilities((z - center) / scale)[1].mean()
    # four standard errors of the mean of 150 rows
    assert off[15] < 4 * 0.02 / 150**0.5 < off[0] and said[15] > said[0] + 1


def test_page_kinds(spark):
    r = random.Random(6)
    noun = lambda: r.choice(_NOUNS)
    number = lambda: r.choice((f"{r.randrange(100)}%", f"{r.randrange(9999)}", f"{r.randrange(99)}.{r.randrange(100, 999)}", f"{r.randrange(999)},{r.randrange(10, 99)}"))

    def prose():
        return " ".join(f"Quando a {noun()} abriu, um {noun()} foi para a {noun()} e não fechou com o {noun()} de Belo{r.choice('abcdef')}." for _ in range(9))

    def items():
        return "\n".join(f"• {noun()} {r.choice(('de Mira', 'regional', 'para ' + noun(), 'antigo'))}{r.choice('abcde')}" for _ in range(25))

    def cells():
        return "\n".join(f"{noun()} {r.choice(('regional', 'Mirão', 'antigo'))}\t{number()}\t{number()}\t{number()}\t{number()}" for _ in range(20))

    def noise():
        return " ".join("".join(r.choice("{}[]%$#@<>=~^|+*") for _ in range(r.randrange(1, 6))) for _ in range(90))

    makers = {"prose": prose, "list": items, "table": cells, "junk": noise}
    rows = [(1000 * k + i, f(), "pt", "s") for k, (name, f) in enumerate(makers.items()) for i in range(80 if name == "prose" else 12)]
    kinds = list(makers)
    for x in text_quality.page_kinds(table(spark, rows), words_table(spark)).collect():
        assert x.kind == kinds[x.doc_id // 1000], x
