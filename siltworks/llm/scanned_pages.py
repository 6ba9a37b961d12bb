"""Problem 3: noise in text from scanned pages.

Per document, in Python: which lines are wrapped like those of a page, which of them are page furniture (numbers, running
headers), which break a word, and which words are not in the word list. Over all documents, in SQL: unknown words are
joined with list words through anagram hashes (the sum of a hash of each character, whatever their order) from which
the characters of a confusable difference are taken on either side; matches are checked letter by letter and ranked.
Words that pages with whole lines use about as often are words, not misreadings.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import cached_property
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm import textnum as tn
from siltworks.operators.semijoin import joined_where_known
from siltworks.storage import settle, spread

# Hyphens that break words, and what closes a sentence.
HYPHENS = "-\u00ad\u00ac\u2010\u2011"
CLOSING = ".!?।॥:;»”\"…"


@dataclass(frozen=True)
class Scans:
    """What counts as a page. The gates as set lose few lines: see the README for what each is measured to keep out."""

    #: A word misread nowhere stands at most so many times more often on wrapped pages than on others.
    excess: float = 4.0
    #: Signs (page numbers or headers, counting 2, broken and misread words) from which a wrapped page counts as scanned.
    signs: int = 2
    #: Word lists of more rows are refused, since the list is sent to every executor.
    list_rows: int = 200_000
    #: Fewer lines that aren't blank have no width that could be told.
    least_lines: int = 5
    #: Least and greatest width, in characters, that lines of a page are wrapped to.
    widths: tuple[int, int] = (20, 110)
    #: Share of a page's lines that are about as long as its width, share of those that don't end a sentence, and their mean number of words.
    full_lines: float = 0.5
    open_lines: float = 0.6
    line_words: float = 3.5
    #: Share of a page's words that the list of its language must have.
    listed: float = 0.35
    #: Words of so many characters or more aren't looked at as misread.
    word_chars: int = 40
    #: Words before a page number, and those that begin the heading of a chapter.
    page_words: tuple[str, ...] = ("página", "pagina", "pág", "pag", "pg", "p", "page", "पृष्ठ", "पृ")
    chapter_words: tuple[str, ...] = ("capítulo", "capitulo", "अध्याय", "chapter")


def page_number(line: str, words: tuple[str, ...] = Scans.page_words) -> int | None:
    """The number if the line is a page number and nothing else, in digits of any script or Roman."""
    s = line.strip().strip("-–—[]()|.·*~ ­‐").strip()
    m = re.fullmatch(r"(?:([^\d\s.]+)(?:\.\s*|\s+))?(\d{1,4})(?:\s*(?:/|de)\s*\d{1,4})?", s)
    if m and (m[1] is None or m[1].lower() in words):
        return int(m[2])
    return roman(s) if s and s == line.strip().strip("-–—[]() ") else None


def roman(s: str) -> int | None:
    if not re.fullmatch(r"(?i)(?=[ivxlc])c{0,3}(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})", s):
        return None
    value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    v = [value[c] for c in s.lower()]
    return sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0]))


def number_beside(line: str) -> tuple[int, str] | None:
    """(number, rest) of a line that begins or ends with a number and has something else beside it."""
    s = line.strip()
    if not s or not any(c.isdecimal() or c in "ivxlc" for c in (s[0], s[-1])):
        return None
    for m in (re.match(r"(\d{1,4})[\s.|—–-]+(\D.*)$", s), re.match(r"(.*\D)[\s|—–-]+(\d{1,4})$", s)):
        if m:
            a, b = m[1], m[2]
            n, rest = (a, b) if a.isdigit() else (b, a)
            return int(n), rest.strip()
    for m in (re.match(r"([ivxlc]{1,7})\s+(.+)$", s), re.match(r"(.+)\s+([ivxlc]{1,7})$", s)):
        if m:
            for n, rest in ((m[1], m[2]), (m[2], m[1])):
                if (v := roman(n)) and (rest.isupper() or not any(c.islower() and c.isascii() for c in rest)):
                    return v, rest
    return None


def page_width(lines: list[str], p: Scans = Scans()) -> int:
    """The width that the lines are wrapped to; 0 if they aren't wrapped."""
    if len(lines) < p.least_lines:
        return 0
    sizes = sorted(len(x.rstrip()) for x in lines if x.strip())
    if len(sizes) < p.least_lines:
        return 0
    m = sizes[len(sizes) * 6 // 10]
    if not p.widths[0] <= m <= p.widths[1]:
        return 0
    like = [n for n in sizes if 0.75 * m <= n <= 1.3 * m]
    if len(like) < p.full_lines * len(sizes):
        return 0
    full = [x.rstrip() for x in lines if 0.75 * m <= len(x.rstrip()) <= 1.3 * m]
    if sum(x[-1] not in CLOSING for x in full) < p.open_lines * len(full) or sum(len(x.split()) for x in full) < p.line_words * len(full):
        return 0
    return like[int(0.9 * (len(like) - 1))]


def _upper(s: str) -> bool:
    # 0.7 of four are three capitals
    if sum(map(str.isupper, s)) < 3:
        return False
    a = [c for c in s if c.isalpha() and c.lower() != c.upper()]
    return len(a) >= 4 and sum(c.isupper() for c in a) > 0.7 * len(a)


def _loose(line: str, width: int) -> bool:
    """Looks like a header: short or in capitals, and neither the end of a sentence nor of half a word."""
    s = line.strip()
    if not s or len(s) > width * 1.1 or s[-1] in CLOSING + "," + HYPHENS:
        return False
    return len(s) < 0.8 * width or _upper(s)


def _key(line: str) -> str:
    """A line as headers are compared: its letters."""
    return re.sub(r"[\W\d]+", " ", line.lower()).strip()


def _apart(x: int, y: int) -> bool:
    """Lengths of which one is too long for the other."""
    return abs(x - y) > 0.3 * max(x, y)


def _alike(x: str, y: str) -> bool:
    if _apart(len(x), len(y)):
        return False
    return 2 * _common(x, y) / (len(x) + len(y)) > 0.75 and SequenceMatcher(None, x, y, autojunk=False).ratio() > 0.75


def _common(x: str, y: str) -> int:
    """The length of the longest common subsequence, of which the blocks that a SequenceMatcher matches are one."""
    places: dict[str, int] = {}
    for i, c in enumerate(y):
        places[c] = places.get(c, 0) | 1 << i
    rest = whole = (1 << len(y)) - 1
    for c in x:
        u = rest & places.get(c, 0)
        rest = ((rest + u) | (rest ^ u)) & whole
    return len(y) - rest.bit_count()


class Block:
    """Keys side by side in one whole number, a bit for each character and then a counter for each key, so that the longest common subsequences
    of another key with all of them are counted at once: what carries into the counter is one character more (after Hyyrö). Characters
    are dealt out to three lanes, each a third as long, since a common subsequence is at most as long as those of its lanes together."""

    def __init__(self, keys: list[str]) -> None:
        self.keys = keys
        self.done: set[str] = set()
        self.sizes = np.array([len(k) for k in keys])
        cp = np.frombuffer("".join(keys).encode("utf-32-le"), np.uint32)
        owner = np.repeat(np.arange(len(keys)), self.sizes)
        self.chars, code, often = np.unique(cp, return_inverse=True, return_counts=True)
        lane = np.empty(len(often), np.int64)
        lane[np.argsort(-often, kind="stable")] = np.resize([0, 1, 2, 2, 1, 0], len(often))
        self.lanes = [self._lane(code[here], owner[here]) for here in (lane[code] == n for n in range(3))]

    def _lane(self, code: np.ndarray, owner: np.ndarray) -> tuple[dict[str, tuple[int, int]], int, int, np.ndarray]:
        """(the bits of each character and those of all others, all bits, bytes, which bytes are counters)"""
        sizes = np.bincount(owner, minlength=len(self.keys))
        counter = 1 if sizes.max() < 256 else 4
        ends = np.cumsum(-(-sizes // 8) + counter)
        size = int(ends[-1])
        at = np.arange(len(code)) + np.repeat(8 * (ends - counter) - np.cumsum(sizes), sizes)
        order = np.argsort(code.astype(np.uint16) if len(self.chars) < 1 << 16 else code, kind="stable")
        codes, first = np.unique(code[order], return_index=True)
        whole = _number(at, size)
        here = [_number(x, size) for x in np.split(at[order], first[1:])] if len(codes) else []
        return {chr(self.chars[c]): (x, whole ^ x) for c, x in zip(codes, here)}, whole, size, ends[:, None] - counter + np.arange(counter)

    def common(self, k: str) -> np.ndarray:
        """Of each key: what its longest common subsequence with k can't be longer than."""
        total = np.zeros(len(self.keys), np.int64)
        for places, rest, size, counters in self.lanes:
            for c in k:
                if c in places:
                    here, others = places[c]
                    rest = (rest + (rest & here)) | (rest & others)
            total += np.frombuffer(rest.to_bytes(size, "little"), np.uint8)[counters] @ (256 ** np.arange(counters.shape[1]))
        return total


def _number(at: np.ndarray, size: int) -> int:
    bits = np.zeros(8 * size, np.uint8)
    bits[at] = 1
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


class Headers:
    """Lines to compare others with. Equal ones are told by their key. Misread ones are looked for among all keys, of which those are
    passed over whose longest common subsequence is too short for the ratio. That is the same from either side: a key that met all others
    without being alike to one leaves the blocks, and those it may be alike to from the other side keep it in mind."""

    #: Characters of a block of keys, and keys that need none: these bound memory and time, not what is compared.
    CHARS = 1 << 17
    FEW = 24

    def __init__(self, lines: list[str]) -> None:
        self.count = Counter(k for k in map(_key, lines) if k)
        self.near: dict[str, bool] = {}
        self.met: dict[str, list[str]] = {}
        self.gone: list[str] = []

    def has(self, line: str, own: int = 0) -> bool:
        """Whether a line is alike to one of the lines, of which `own` are the line itself."""
        k = _key(line)
        if not k:
            return False
        if self.count[k] > own:
            return True
        if k not in self.near:
            self.near[k] = any(_alike(k, other) for other in self._likely(k))
        return self.near[k]

    @cached_property
    def blocks(self) -> dict[int, Block]:
        keys = sorted(self.count, key=lambda k: (len(k), k))
        ends = np.cumsum([len(k) for k in keys]) // self.CHARS
        return {n: Block([k for _, k in g]) for n, g in groupby(zip(ends.tolist(), keys), key=lambda x: x[0])}

    def _likely(self, k: str) -> Iterator[str]:
        """All other keys that can be alike, the likeliest of a block first. Blocks go by length, those of other lengths are passed over.
        Of few keys all are likely, a block would take longer than they do."""
        if len(self.count) <= self.FEW:
            yield from (x for x in self.count if x != k)
            return
        yield from self.met.pop(k, ()) if k in self.count else self.gone
        for n, b in [*self.blocks.items()]:
            if _apart(len(k), min(max(len(k), int(b.sizes[0])), int(b.sizes[-1]))):
                continue
            share = 2 * b.common(k) / (b.sizes + len(k))
            for i in sorted(np.flatnonzero(share > 0.75).tolist(), key=share.__getitem__, reverse=True):
                if b.keys[i] == k:
                    own = n
                    continue
                if k in self.count:
                    self.met.setdefault(b.keys[i], []).append(k)
                yield b.keys[i]
        # only if none was alike
        if k in self.count:
            self.blocks[own].done.add(k)
            self._shrink(own)

    def _shrink(self, n: int) -> None:
        b = self.blocks[n]
        if 4 * len(b.done) > len(b.keys):
            del self.blocks[n]
            self.gone += b.done
            if left := [k for k in b.keys if k not in b.done]:
                self.blocks[n] = Block(left)


def furniture(lines: list[str], width: int, p: Scans = Scans()) -> set[int]:
    """Indexes of the lines that hold a page number, a running header or footer, or both. Numbers are looked up by their value, in time
    in proportion to the lines; different headers are compared all with all, many at once."""
    chapter = lambda x: x.lower().lstrip().startswith(p.chapter_words)
    alone = {i: n for i, x in enumerate(lines) if x.strip() and (n := page_number(x, p.page_words)) is not None}
    beside = {}
    for i, x in enumerate(lines):
        if i not in alone and len(x.strip()) <= width * 1.1 and (m := number_beside(x)) and m[1] and m[1].rstrip()[-1] not in CLOSING + "," and not chapter(x):
            beside[i] = m
    # lines that all have a number are a table, not pages
    if len(beside) > 0.25 * sum(bool(x.strip()) for x in lines):
        beside = {}
    out = set(alone)
    first: dict[int, int] = {}
    last: dict[int, int] = {}
    bare: dict[int, list[int]] = {}
    for i, n in sorted([*alone.items(), *((k, v[0]) for k, v in beside.items())]):
        first.setdefault(n, i)
        last[n] = i
    for i, n in sorted(alone.items()):
        bare.setdefault(n, []).append(i)
    rests = Headers([v[1] for v in beside.values()])
    for i, (n, rest) in beside.items():
        # numbers beside a header go up from page to page: one to three more, at least three lines on for each
        steps = any(last.get(n + k, i) - i >= 3 * k or i - first.get(n - k, i) >= 3 * k for k in (1, 2, 3))
        at = bisect_left(bare.get(n, []), i - 40)
        again = at < len(bare.get(n, [])) and bare[n][at] <= i + 40
        if (steps or again or (_upper(rest) and len(rest) > 4)) and (_loose(rest, width) or rests.has(rest, 1)):
            out.add(i)
    headers = [beside[i][1] for i in out if i in beside]
    # the lines next to bare numbers, on the side where they look like headers
    side: dict[int, list[int]] = {-1: [], 1: []}
    for i in sorted(alone):
        for d in (-1, 1):
            j = i + d
            if 0 <= j < len(lines) and lines[j].strip() and j not in alone:
                side[d].append(j)
    good = {}
    for d, js in side.items():
        own = Headers([lines[j] for j in js])
        good[d] = [j for j in js if _loose(lines[j], width) or own.has(lines[j], 1)]
    best = max((-1, 1), key=lambda d: (sum(2 if _upper(lines[j]) else 1 for j in good[d]) - (len(side[d]) - len(good[d]))))
    chosen = good[best]
    if chosen and len(chosen) >= 0.6 * len(side[best]):
        out.update(chosen)
        headers += [lines[j] for j in chosen]
    else:
        # not every page has a header: what is much too short for a line of text, or in capitals
        clear = [j for j in side[-1] + side[1] if _loose(lines[j], width) and (_upper(lines[j]) or len(lines[j].strip()) < 0.65 * width)]
        out.update(clear)
        headers += [lines[j] for j in clear]
    # a header that stands without its number
    known = Headers(headers)
    for i, x in enumerate(lines):
        if i not in out and len(x.strip()) > 5 and _loose(x, width) and not chapter(x) and known.has(x) and not (i and chapter(lines[i - 1])):
            out.add(i)
    return out


def _bare(word: str, punctuation: set[str]) -> str:
    i, j = 0, len(word)
    while i < j and word[i] in punctuation:
        i += 1
    while j > i and word[j - 1] in punctuation:
        j -= 1
    return word[i:j]


def _composed(text: str) -> str:
    """One normal form, so that a word has one spelling; keeps the lines as they are."""
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def analyse(text: str, lists: dict[str, set[str]], punctuation: set[str], p: Scans = Scans()) -> tuple[str, list[tuple[int, str, str]]] | None:
    """(language, [(line_no, kind, word)]) of a wrapped page: kinds furniture, broken, and unknown for words not in the list of
    the language. None if the text isn't wrapped. Word is the joined word of a broken line."""
    lines = _composed(text).split("\n")
    width = page_width(lines, p)
    if not width:
        return None
    tokens = [[_bare(w, punctuation) for w in x.split()] for x in lines]
    seen = [w for t in tokens for w in t]
    hits = {lang: sum(w in s for w in seen) for lang, s in lists.items()}
    lang = max(sorted(hits), key=hits.get) if hits else ""
    if not seen or hits.get(lang, 0) < p.listed * len(seen):
        return None
    known = lists[lang]
    out_lines = furniture(lines, width, p)
    rows = [(i + 1, "furniture", "") for i in sorted(out_lines)]
    head = {i for i, x in enumerate(lines) for k in (0, 1) if i - k >= 0 and lines[i - k].lower().lstrip().startswith(p.chapter_words)}
    running = [i for i, x in enumerate(lines) if x.strip() and i not in out_lines and i not in head]
    carried = False
    for at, i in enumerate(running):
        raw = lines[i].rstrip()
        words = raw.split()
        follows = lines[running[at + 1]].split() if at + 1 < len(running) else []
        half = len(raw) > 1 and raw[-1] in HYPHENS and (raw[-2].isalnum() or unicodedata.category(raw[-2])[0] == "M" or raw[-2] in "@!")
        here = [_bare(w, punctuation) for w in words]
        if half and follows:
            join = _bare(words[-1].rstrip(HYPHENS) + follows[0], punctuation)
            whole = _bare(words[-1] + follows[0], punctuation)
            rows.append((i + 1, "broken", "-" if whole in known and join not in known and raw[-1] == "-" else join))
        skip_first, skip_last = carried, half
        if not half and follows and here[-1] and here[-1] not in known and here[-1].islower():
            first = _bare(follows[0], punctuation)
            if first not in known and raw[-1] not in CLOSING + "," and len(here[-1]) > 1 and here[-1] + first in known:
                rows.append((i + 1, "broken", here[-1] + first))
                skip_last = True
        for k, w in enumerate(here):
            if not w or w in known or (k == 0 and skip_first) or (k == len(here) - 1 and skip_last):
                continue
            letter = next((c for c in w if c.isalpha()), "")
            if letter and not letter.isupper() and not w.isdigit() and len(w) < p.word_chars:
                rows.append((i + 1, "unknown", w))
        carried = skip_last
    return lang, rows


def _punctuation() -> set[str]:
    return {chr(c) for c in range(0x3002) if unicodedata.category(chr(c))[0] == "P" and chr(c) != "@" or unicodedata.category(chr(c)) == "Cf"} | set("|¬=+<>~`^´\ufeff")


_SHAPE = "kind string, doc_id long, line_no long, lang string, word string, hash long, n long"


def _scan(lists: dict[str, set[str]], p: Scans):
    def run(it):
        powers, table = tn.Powers(), tn.space_table()
        punctuation = _punctuation()
        edge = np.zeros(0x3002, dtype=bool)
        edge[[ord(c) for c in punctuation if ord(c) < 0x3002]] = True
        for b, texts in tn.batches(it):
            out: dict[str, list] = {k: [] for k in ("kind", "doc_id", "line_no", "lang", "word", "hash", "n")}
            whole = []
            for doc, t in zip(b.column("doc_id").to_pylist(), texts):
                found = analyse(t, lists, punctuation, p)
                if found is None:
                    whole.append(_composed(t))
                    continue
                lang, rows = found
                words = [w for _, kind, w in rows if kind == "unknown"]
                hashes = iter(word_hashes(words, powers, table))
                for line, kind, w in rows:
                    for k, v in zip(out, (kind, doc, line, lang, w, next(hashes) if kind == "unknown" else 0, 1)):
                        out[k].append(v)
                out_words = sum(len(x.split()) for x in t.split("\n"))
                for k, v in zip(out, ("size", None, 1, None, None, 0, out_words)):
                    out[k].append(v)
            # how often each word stands in texts that aren't wrapped
            h = tn.mix(np.zeros(0, np.uint64))
            if whole:
                cp = tn.code_points(" ".join(whole) + " ")
                gap = tn.is_space(cp, table)
                soft = gap | edge[np.minimum(cp, 0x3001)]
                e = np.flatnonzero(np.diff(gap, prepend=True))
                start, end = e[::2], e[1::2]
                at = np.arange(len(cp))
                first = np.minimum.accumulate(np.where(soft, len(cp), at)[::-1])[::-1][start]
                last = np.maximum.accumulate(np.where(soft, -1, at))[end - 1] + 1
                some = first < end
                h = tn.range_hash(tn.prefix_hash(cp.astype(np.uint64) + np.uint64(1), powers), first[some], last[some], powers)
            keys, n = np.unique(h, return_counts=True)
            rows = pa.RecordBatch.from_pydict(out, schema=_arrow())
            yield rows
            k = len(keys)
            none = pa.nulls(k, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(["whole"] * k, pa.string()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), none, none, pa.array(keys.view(np.int64)), pa.array(n)], schema=_arrow())

    return run


def _arrow() -> pa.Schema:
    return pa.schema([("kind", pa.string()), ("doc_id", pa.int64()), ("line_no", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("hash", pa.int64()), ("n", pa.int64())])


def word_hashes(words: list[str], powers: tn.Powers, table: np.ndarray) -> list[int]:
    if not words:
        return []
    h, _ = tn.words_of(words, powers, table)
    return h.view(np.int64).tolist()


def _reduced(df: DataFrame, most: int) -> DataFrame:
    """Of each (lang, word, ...): the words left when 0 to `most` neighbouring characters are taken out, each with where it was
    and the anagram hash of what is left."""
    chars = F.split("word", "")
    return (
        df.withColumn("c", F.filter(chars, lambda x: x != ""))
        .withColumn("codes", F.transform("c", lambda x: F.shiftright(F.xxhash64(x), 20)))
        .withColumn("full", F.aggregate("codes", F.lit(0).cast("long"), lambda a, x: a + x))
        .withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(most))))
        .withColumn("at", F.explode(F.when(F.col("cut") == 0, F.array(F.lit(0))).when(F.size("c") >= F.col("cut"), F.sequence(F.lit(1), F.size("c") - F.col("cut") + 1)).otherwise(F.array().cast("array<int>"))))
        .withColumn("left_hash", F.col("full") - F.aggregate(F.slice("codes", F.greatest("at", F.lit(1)), F.col("cut")), F.lit(0).cast("long"), lambda a, x: a + x))
        .withColumn("before", F.when(F.col("cut") == 0, F.col("word")).otherwise(F.concat_ws("", F.slice("c", 1, F.greatest(F.col("at") - 1, F.lit(0))))))
        .withColumn("after", F.when(F.col("cut") == 0, F.lit("")).otherwise(F.concat_ws("", F.expr("slice(c, at + cut, greatest(size(c), 1))"))))
        .withColumn("taken", F.when(F.col("cut") == 0, F.lit("")).otherwise(F.concat_ws("", F.expr("slice(c, greatest(at, 1), cut)"))))
        .drop("c", "codes", "full")
    )


def corrections(types: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, word, right): the best list word for each unknown word that is a confusable variant of one.

    One character for another, missing or added, or one for two neighbours and the reverse. The join is on the anagram hash
    of what both have in common; ranked by how many words the same change explains and how frequent the list word is.
    """
    listed = _reduced(words.select("lang", "word", F.log1p("cnt").alias("weight")), 2).select("lang", F.col("word").alias("right"), "weight", F.col("cut").alias("rcut"), F.col("at").alias("rat"), "left_hash", F.col("before").alias("rb"), F.col("after").alias("ra"), F.col("taken").alias("rt"))
    rare = _reduced(types, 2)
    same = rare.join(listed.hint("merge"), ["lang", "left_hash"]).where(
        "concat(before, after) = concat(rb, ra) AND right <> word AND cut + rcut BETWEEN 1 AND 3 AND abs(cut - rcut) <= 1 AND (cut = 0 OR rcut = 0 OR at = rat)"
    )
    # what is taken out of a short word must not be most of it
    fair = settle(same.where("length(right) > rcut OR cut = 1").select("lang", "word", "right", "taken", "rt", "weight"))
    # a change that explains many words is a likely one: rn for m rather than c for f
    change = fair.groupBy("lang", "taken", "rt").agg(F.log(F.count_distinct("word", "right").cast("double")).alias("likely"))
    ranked = fair.join(change, ["lang", "taken", "rt"]).withColumn("score", F.col("likely") + F.lit(0.3) * F.col("weight"))
    return ranked.groupBy("lang", "word").agg(F.max_by("right", F.struct("score", "right")).alias("right"))


def _lists(words: DataFrame, p: Scans) -> tuple[dict[str, set[str]], DataFrame]:
    """The word list by language, and as a table, both in one normal form. Refused beyond p.list_rows."""
    rows = words.select("lang", "word", "cnt").where("lang IS NOT NULL AND word IS NOT NULL").limit(p.list_rows + 1).collect()
    if len(rows) > p.list_rows:
        raise ValueError(f"the word list has more than {p.list_rows} rows")
    plain = [(r["lang"], _composed(r["word"]), r["cnt"] or 0) for r in rows]
    out: dict[str, set[str]] = {}
    for lang, word, _ in plain:
        out.setdefault(lang, set()).add(word)
    return out, words.sparkSession.createDataFrame(plain, "lang string, word string, cnt long")


def _noise(docs: DataFrame, words: DataFrame, p: Scans) -> DataFrame:
    """(doc_id, line_no, kind, word, right) of all scanned pages."""
    lists, words = _lists(words, p)
    rows = settle(spread(docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")).mapInArrow(_scan(lists, p), _SHAPE))
    unknown = rows.where("kind = 'unknown'")
    sizes = rows.agg(F.sum(F.when(F.col("kind") == "size", F.col("n"))).alias("w"), F.sum(F.when(F.col("kind") == "whole", F.col("n"))).alias("c")).first()
    ratio = (sizes["w"] or 0) / max(sizes["c"] or 0, 1)
    types = unknown.groupBy("lang", "word", "hash").agg(F.count(F.lit(1)).alias("scanned"))
    clean = rows.where("kind = 'whole'").groupBy("hash").agg(F.sum("n").alias("clean"))
    odd = types.join(clean.hint("merge"), "hash", "left").where(F.col("scanned") > F.lit(p.excess * ratio) * F.coalesce("clean", F.lit(0)))
    right = settle(corrections(odd.select("lang", "word").distinct(), words))
    # the stage tables compress well: their file sizes would have them broadcast however large they are
    misread = unknown.join(right.hint("merge"), ["lang", "word"]).select("doc_id", "line_no", F.lit("misread").alias("kind"), "word", "right")
    plain = rows.where("kind IN ('furniture', 'broken')").select("doc_id", "line_no", "kind", "word", F.lit(None).cast("string").alias("right"))
    found = settle(plain.union(misread))
    # a break at a hyphen that the word has anyway is no sign, wrapped texts have those too
    signs = found.groupBy("doc_id").agg(F.sum(F.when(F.col("word") == "-", 0).when(F.col("kind") == "furniture", 2).otherwise(1)).alias("signs")).where(F.col("signs") >= p.signs)
    return found.join(signs.select("doc_id").hint("merge"), "doc_id", "left_semi")


def scan_noise(docs: DataFrame, words: DataFrame, p: Scans = Scans()) -> DataFrame:
    """(doc_id, line_no, kind) with kind furniture, broken or misread, of docs(doc_id, text, ...) whose lines are wrapped like those
    of a scanned page and show at least p.signs signs of it. words(lang, word, cnt) is the word list. Lines are counted
    from 1 between "\\n". Null, empty and unwrapped texts give no rows; repeated rows of a doc_id count once."""
    return _noise(docs, words, p).select("doc_id", "line_no", "kind").distinct()


def repaired(docs: DataFrame, words: DataFrame, p: Scans = Scans()) -> DataFrame:
    """(doc_id, text): scanned pages as paragraphs, without furniture, with broken words joined and misread ones corrected; all
    other texts unchanged, null stays null."""
    noise = _noise(docs, words, p).groupBy("doc_id").agg(F.collect_set(F.struct("line_no", "kind", "word", "right")).alias("noise"))

    def run(it):
        punctuation = _punctuation()
        for b in it:
            out = []
            for text, noise in zip(b.column("text").to_pylist(), b.column("noise").to_pylist()):
                out.append(text if noise is None or text is None else repair(text, noise, punctuation))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return joined_where_known(docs.select("doc_id", "text"), "doc_id", settle(noise)).select("doc_id", "text", "noise").mapInArrow(run, "doc_id long, text string")


def repair(text: str, noise: list[dict], punctuation: set[str]) -> str:
    drop = {x["line_no"] for x in noise if x["kind"] == "furniture"}
    broken = {x["line_no"]: x["word"] for x in noise if x["kind"] == "broken"}
    fix: dict[int, dict[str, str]] = {}
    for x in noise:
        if x["kind"] == "misread":
            fix.setdefault(x["line_no"], {})[x["word"]] = x["right"]
    paragraphs, join, ended = [""], "", True
    for i, line in enumerate(_composed(text).split("\n"), 1):
        if i in drop:
            continue
        if not line.strip():
            # a gap in the middle of a sentence is where a page ended
            if ended and paragraphs[-1]:
                paragraphs.append("")
            continue
        words = []
        for w in line.split():
            bare = _bare(w, punctuation)
            words.append(w.replace(bare, fix[i][bare], 1) if bare and bare in fix.get(i, {}) else w)
        words = [w for k, w in enumerate(words) if w.strip("-–—") or not 0 < k < len(words) - 1] or words
        s = " ".join(words)
        if i in broken:
            s = s if broken[i] == "-" else s.rstrip(HYPHENS)
        paragraphs[-1] += (join if paragraphs[-1] else "") + s
        join = "" if i in broken else " "
        ended = i not in broken and s[-1:] in CLOSING
    return "\n\n".join(x for x in paragraphs if x)
