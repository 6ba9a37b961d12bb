"""Problem 2: per-document text quality statistics, and prose, list, table or junk by a Gaussian mixture.

The statistics of every document are computed once and kept; expectation-maximization then runs over all of them, each
round one pass that sends a component's sums, not rows, to the driver. What a component holds is told by inspected
examples: statistics of pages that were looked at, with what they are.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm import textnum as tn
from siltworks.storage import settle, spread

STATISTICS = ("words_per_line", "closed_lines", "top_words", "frame_words", "listed_words", "digit_words", "symbols", "word_length", "repeats", "sentence_length", "separators", "mixed_words", "sentence_words")
_CLOSE = ".!?।॥…"


@dataclass(frozen=True)
class Lists:
    """Of each language: its most frequent words, the next ones, all listed."""

    top: dict[str, frozenset]
    frame: dict[str, frozenset]
    listed: dict[str, frozenset]


def word_lists(rows: list[tuple[str, str, int]], top: int = 8, frame: int = 60) -> Lists:
    by: dict[str, list[tuple[int, str]]] = {}
    for lang, word, n in rows:
        by.setdefault(lang, []).append((-n, unicodedata.normalize("NFC", word)))
    a, b, c = {}, {}, {}
    for lang, ws in by.items():
        w = [x for _, x in sorted(ws)]
        a[lang], b[lang], c[lang] = frozenset(w[:top]), frozenset(w[top:frame]), frozenset(w)
    return Lists(a, b, c)


_SYMBOL = regex.compile(r"[^\p{L}\p{N}\p{M}\s.,;:!?¿¡«»\"'()\-–—।]")
_LETTER = regex.compile(r"[\p{L}\p{Mn}\p{Mc}-]")


def kind_of(word: str) -> tuple[bool, bool]:
    """Whether a word is a number, and whether it is no word of letters: very long, broken or with other characters inside."""
    n = len(_LETTER.findall(word))
    digit = any(map(str.isdigit, word))
    return digit and not any(map(str.isalpha, word)), len(word) > 25 or "\ufffd" in word or (n < 0.8 * len(word) and not word.isdigit())


_CUT = re.compile(r"[,;|·\t•→*]|  +| [-–—] ")


def statistics(text: str, lists: Lists, kinds: dict[str, tuple[bool, bool]]) -> list[float]:
    """The statistics of one text of at least one word, in the order of STATISTICS. kinds keeps what kind_of said of words."""
    text = unicodedata.normalize("NFC", text)
    lines = [x for x in (y.strip() for y in text.split("\n")) if x]
    raw = text.split()
    n = len(raw)
    strip = ".,;:!?¿¡«»\"'()[]“”‘’…।॥-–—*•·|→"
    words = [w.strip(strip).lower() for w in raw]
    best = max(sorted(lists.listed), key=lambda k: sum(map(lists.listed[k].__contains__, words)), default=None)
    top, frame, listed = (lists.top[best], lists.frame[best], lists.listed[best]) if best else (frozenset(),) * 3
    count = Counter(words)
    digits = mixed = 0
    for w, k in count.items():
        if w not in kinds:
            kinds[w] = kind_of(w)
        d, m = kinds[w]
        digits += k * d
        mixed += k * m
    letters = sum(map(len, words))
    symbols = len(_SYMBOL.findall(text))
    ends = sum(w[-1] in _CLOSE or w[-1] in "»\"”)" and w[-2:-1] in _CLOSE for w in raw)
    sentence = at = 0
    for x in lines:
        k = len(x.split())
        parts = max(1, k // 20)  # a line of many sentences is judged in parts
        for i in range(parts):
            here = words[at + k * i // parts : at + k * (i + 1) // parts]
            m = len(here)
            f, t = sum(map(frame.__contains__, here)), sum(map(top.__contains__, here))
            if m >= 4 and f and f + t >= 0.3 * m and len(set(here)) > 0.5 * m:
                sentence += m
        at += k
    return [
        float(np.log1p(n / len(lines))),
        sum(x[-1] in _CLOSE or x[-1] in "»\"”" for x in lines) / len(lines),
        sum(map(top.__contains__, words)) / n,
        sum(map(frame.__contains__, words)) / n,
        sum(map(listed.__contains__, words)) / n,
        digits / n,
        float(np.log1p(20 * symbols / max(len(text), 1))),
        min(letters / n, 15.0),
        1 - len(count) / n,
        float(np.log1p(n / (1 + ends))),
        min(len(_CUT.findall(text)) / n, 1.0),
        mixed / n,
        sentence / n,
    ]


# Inspected examples: statistics of pages that were looked at, in the order of STATISTICS, with what the pages are.
EXAMPLES = (
    ("prose", "sentences", (3.81, 0.88, 0.27, 0.29, 0.90, 0.01, 0.0, 4.75, 0.47, 2.89, 0.05, 0.0, 1.0)),
    ("prose", "sentences closed by '|'", (3.98, 0.33, 0.27, 0.33, 0.89, 0.02, 0.2, 4.09, 0.38, 4.38, 0.06, 0.0, 1.0)),
    ("prose", "scanned page, hi", (2.31, 0.14, 0.26, 0.31, 0.85, 0.03, 0.02, 3.90, 0.40, 2.79, 0.03, 0.0, 0.95)),
    ("prose", "scanned page, es", (2.19, 0.10, 0.27, 0.27, 0.86, 0.02, 0.02, 4.78, 0.43, 2.85, 0.04, 0.0, 0.88)),
    ("prose", "sentences among site lines", (3.31, 0.71, 0.25, 0.27, 0.87, 0.0, 0.0, 4.97, 0.37, 2.88, 0.05, 0.0, 0.91)),
    ("list", "commas", (3.51, 0.0, 0.08, 0.09, 0.69, 0.05, 0.0, 6.22, 0.11, 4.19, 0.34, 0.0, 0.14)),
    ("list", "ingredients", (1.71, 0.0, 0.05, 0.06, 0.41, 0.24, 0.0, 4.34, 0.29, 4.42, 0.41, 0.0, 0.11)),
    ("list", "numbered", (1.58, 0.03, 0.09, 0.09, 0.61, 0.27, 0.0, 5.01, 0.16, 1.56, 0.01, 0.0, 0.11)),
    ("list", "bullets", (1.60, 0.03, 0.09, 0.07, 0.51, 0.04, 0.62, 4.71, 0.30, 4.25, 0.25, 0.01, 0.13)),
    ("table", "tabs", (1.93, 0.0, 0.0, 0.0, 0.30, 0.62, 0.45, 4.90, 0.03, 4.36, 0.86, 0.49, 0.0)),
    ("table", "semicolons", (1.18, 0.0, 0.03, 0.11, 0.56, 0.0, 0.35, 14.72, 0.11, 3.61, 1.0, 0.44, 0.0)),
    ("table", "names and amounts", (1.79, 0.05, 0.08, 0.08, 0.40, 0.18, 0.62, 4.72, 0.32, 3.98, 0.04, 0.29, 0.31)),
    ("table", "bars", (2.44, 0.0, 0.03, 0.02, 0.18, 0.25, 1.26, 2.65, 0.56, 4.99, 0.51, 0.17, 0.0)),
    ("junk", "tags", (3.23, 0.33, 0.07, 0.05, 0.27, 0.03, 0.70, 11.95, 0.03, 3.62, 0.01, 0.07, 0.23)),
    ("junk", "lost characters", (4.17, 0.5, 0.02, 0.0, 0.02, 0.01, 2.29, 4.99, 0.18, 1.45, 0.02, 0.94, 0.0)),
    ("junk", "encoded bytes", (0.84, 0.0, 0.07, 0.0, 0.10, 0.0, 0.40, 15.0, 0.0, 3.40, 0.0, 0.72, 0.0)),
    ("junk", "logs", (2.04, 0.04, 0.04, 0.05, 0.14, 0.42, 0.76, 6.06, 0.16, 4.47, 0.01, 0.55, 0.17)),
    ("junk", "wrongly decoded", (3.09, 0.0, 0.02, 0.0, 0.07, 0.05, 2.36, 11.07, 0.12, 3.76, 0.0, 0.79, 0.0)),
    ("junk", "code", (1.90, 0.03, 0.02, 0.03, 0.09, 0.06, 0.95, 4.27, 0.51, 4.64, 0.15, 0.44, 0.09)),
    ("junk", "repeated words", (2.12, 0.03, 0.02, 0.02, 0.59, 0.13, 0.0, 6.42, 0.75, 4.71, 0.01, 0.0, 0.11)),
)
KINDS = ("prose", "list", "table", "junk")


@dataclass(frozen=True)
class Mixture:
    rounds: int = 15
    #: Added to the variances of standardized statistics, so that no component collapses.
    ridge: float = 0.05
    #: EM ends when the mean log-likelihood gains less.
    gain: float = 1e-3
    list_rows: int = 200_000


def _lists(words: DataFrame, p: Mixture) -> Lists:
    rows = words.select("lang", "word", "cnt").where("lang IS NOT NULL AND word IS NOT NULL").limit(p.list_rows + 1).collect()
    if len(rows) > p.list_rows:
        raise ValueError(f"the word list has more than {p.list_rows} rows")
    return word_lists([(r["lang"], r["word"], r["cnt"] or 0) for r in rows])


def quality_statistics(docs: DataFrame, words: DataFrame, p: Mixture = Mixture()) -> DataFrame:
    """(doc_id, n_words, s) of docs(doc_id, text, ...): s holds STATISTICS, null for texts without a word (null, empty, blank).
    words(lang, word, cnt) is the word list; a text is taken to be in the language most of whose words it has. Rows with a
    null doc_id are kept, repeated rows too."""
    lists = _lists(words, p)

    def run(it):
        kinds: dict[str, tuple[bool, bool]] = {}
        for b, texts in tn.batches(it):
            if len(kinds) > 1 << 17:
                kinds = {}
            n = [len(t.split()) for t in texts]
            s = [statistics(t, lists, kinds) if k else None for t, k in zip(texts, n)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(s, pa.list_(pa.float64()))], names=["doc_id", "n_words", "s"])

    return spread(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_words long, s array<double>")


class Gaussians:
    """A mixture over standardized statistics."""

    def __init__(self, weights: np.ndarray, means: np.ndarray, covariances: np.ndarray) -> None:
        self.weights, self.means = weights, means
        self.roots = np.linalg.inv(np.linalg.cholesky(covariances))
        self.level = np.log(np.maximum(weights, 1e-300)) + np.log(np.abs(np.linalg.det(self.roots))) - 0.5 * means.shape[1] * np.log(2 * np.pi)

    def responsibilities(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(responsibility of each component, log-likelihood) of each row."""
        log = np.stack([lv - 0.5 * (((z - m) @ r.T) ** 2).sum(axis=1) for lv, m, r in zip(self.level, self.means, self.roots)], axis=1)
        top = log.max(axis=1, keepdims=True)
        e = np.exp(log - top)
        total = e.sum(axis=1, keepdims=True)
        return e / total, (top + np.log(total)).ravel()


def _rows(b: pa.RecordBatch, center: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return (np.asarray(b.column("s").flatten()).reshape(-1, len(center)) - center) / scale


def fit_mixture(stats: DataFrame, p: Mixture = Mixture()) -> tuple[Gaussians, np.ndarray, np.ndarray]:
    """The mixture of all rows of stats(s), with the means and deviations that standardize them. One component starts at each
    inspected example. Each round sends k * (1 + d + d*d) sums to the driver, whatever the number of rows."""
    d, k = len(STATISTICS), len(EXAMPLES)
    some = stats.where("s IS NOT NULL").select("s")
    at = [F.col("s")[i] for i in range(d)]
    m = some.agg(*[F.avg(x).alias(f"a{i}") for i, x in enumerate(at)], *[F.stddev_pop(x).alias(f"d{i}") for i, x in enumerate(at)]).first()
    center = np.array([m[f"a{i}"] or 0.0 for i in range(d)])
    scale = np.array([m[f"d{i}"] or 1.0 for i in range(d)])
    model = Gaussians(np.full(k, 1 / k), (np.array([e[2] for e in EXAMPLES]) - center) / scale, np.stack([np.eye(d) * 0.25] * k))
    before = None
    for _ in range(p.rounds):

        def run(it, model=model):
            sums = np.zeros((k, 1 + d + d * d))
            whole = np.zeros(2)
            for b in it:
                z = _rows(b, center, scale)
                r, log = model.responsibilities(z)
                sums[:, 0] += r.sum(axis=0)
                sums[:, 1 : 1 + d] += r.T @ z
                for i in range(k):
                    sums[i, 1 + d :] += ((z * r[:, i : i + 1]).T @ z).ravel()
                whole += log.sum(), len(z)
            v = np.concatenate([whole, sums.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], names=["i", "v"])

        got = {x["i"]: x["v"] for x in some.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
        v = np.array([got.get(i, 0.0) for i in range(2 + k * (1 + d + d * d))])
        log, n, sums = v[0], v[1], v[2:].reshape(k, -1)
        if not n:
            break
        weight = np.maximum(sums[:, 0], 1e-9)
        means = np.where(sums[:, :1] > 1, sums[:, 1 : 1 + d] / weight[:, None], model.means)
        second = sums[:, 1 + d :].reshape(k, d, d) / weight[:, None, None] - means[:, :, None] * means[:, None, :]
        # a component of few rows leans on the shape it began with
        lean = (2.0 * d / (2.0 * d + sums[:, 0]))[:, None, None]
        covariances = (1 - lean) * np.where(sums[:, :1, None] > 1, second, 0.0) + lean * np.eye(d) * 0.25 + np.eye(d) * p.ridge
        model = Gaussians(sums[:, 0] / n, means, covariances)
        if before is not None and log / n - before < p.gain:
            break
        before = log / n
    return model, center, scale


def component_kinds(model: Gaussians, center: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The kind (index in KINDS) of each component: that of the examples it takes most of, or of the nearest example to its mean."""
    z = (np.array([e[2] for e in EXAMPLES]) - center) / scale
    kind = np.array([KINDS.index(e[0]) for e in EXAMPLES])
    r, _ = model.responsibilities(z)
    out = []
    for i in range(len(model.means)):
        by = np.bincount(kind, weights=r[:, i], minlength=len(KINDS))
        out.append(int(by.argmax()) if by.max() > 0.2 else int(kind[((z - model.means[i]) ** 2).sum(axis=1).argmin()]))
    return np.array(out)


def page_kinds(docs: DataFrame, words: DataFrame, p: Mixture = Mixture()) -> DataFrame:
    """(doc_id, n_words, kind, probability): prose, list, table or junk of every record, 'empty' (probability 1) for texts without a
    word. The mixture is fitted on all records; see quality_statistics for nulls and repeated rows."""
    stats = settle(quality_statistics(docs, words, p))
    model, center, scale = fit_mixture(stats, p)
    kinds = component_kinds(model, center, scale)

    def run(it):
        for b in it:
            full = b.column("s").is_valid()
            has = np.asarray(full)
            kind = np.full(len(has), len(KINDS))
            sure = np.ones(len(has))
            if has.any():
                r, _ = model.responsibilities(_rows(b.filter(full), center, scale))
                by = np.stack([r[:, kinds == i].sum(axis=1) for i in range(len(KINDS))], axis=1)
                kind[has], sure[has] = by.argmax(axis=1), by.max(axis=1)
            names = np.array([*KINDS, "empty"], dtype=object)[kind]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(names, pa.string()), pa.array(np.round(sure, 6))], names=["doc_id", "n_words", "kind", "probability"])

    return stats.mapInArrow(run, "doc_id long, n_words long, kind string, probability double")
