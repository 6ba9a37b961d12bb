"""Scalar functions on text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split() and the regular expression \s of Python take it; Java's \s has fewer, even with (?U).
SPACE_CLASS = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Fixed value: the split pattern that byte-level vocabularies are published with, in the spelling of Perl.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as Unicode defines it, which is what that pattern means; Python's str.split() takes \x1c to \x1f too.
UNICODE_SPACE = SPACE_CLASS.replace(r"\x1c-\x20", r"\x20")
#: Other codes that the sources use for the languages.
LANGUAGE_CODES = {"por_latn": "pt", "spa_latn": "es", "hin_deva": "hi"}
LANGUAGES = ("pt", "es", "hi")


def words(text: Column) -> Column:
    """The words of a text, split at white space, none empty; null gives null."""
    return F.filter(F.split(text, f"[{SPACE_CLASS}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words; null gives null."""
    return F.when(text.isNotNull(), F.size(words(text)))


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(text)


def code_points(text: Column) -> Column:
    return F.char_length(text)


def language_code(lang: Column) -> Column:
    """pt, es or hi for their spellings (case, blanks, configuration names, a region after '-'); else null."""
    plain = F.regexp_replace(F.lower(F.trim(lang)), "-.*$", "")
    out = F.when(plain.isin(*LANGUAGES), plain)
    for code, short in LANGUAGE_CODES.items():
        out = out.when(plain == code, F.lit(short))
    return out


def shingles(text: Column, n: int = 5) -> Column:
    """Every run of n words joined by one blank; the empty array for fewer than n words."""
    # the words are bound once: named inside the inner function they would be split again for every shingle
    def runs(w: Column) -> Column:
        last = F.size(w) - (n - 1)
        starts = F.sequence(F.lit(1), F.greatest(last, F.lit(1)))
        return F.when(last >= 1, F.transform(starts, lambda i: F.concat_ws(" ", F.slice(w, i, n)))).otherwise(F.array().cast("array<string>"))

    return F.element_at(F.transform(F.array(words(text)), runs), 1)


def byte_pieces(text: Column) -> Column:
    """The pieces a byte-level tokenizer merges within, by the published split pattern; Java's \\s has ASCII characters only."""
    pattern = SPLIT.replace(r"[^\s", f"[^{UNICODE_SPACE}").replace(r"\S", f"[^{UNICODE_SPACE}]").replace(r"\s", f"[{UNICODE_SPACE}]")
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
