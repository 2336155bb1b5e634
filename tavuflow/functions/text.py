"""Scalar text expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as a word splitter sees it, and characters that a file name must not hold.
SPACE = "\\t-\\r \\x1c-\\x1f\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
UNSAFE = '[<>:"/\\\\|?*]'


def strip(text: Column) -> Column:
    """text without Unicode white space at its ends."""
    return F.btrim(text, F.lit(_SPACES))


def words(text: Column) -> Column:
    """The runs of non-space: no empty elements; null for null."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def characters(text: Column) -> Column:
    """Code points including white space; [] for the empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def ngrams(text: Column, n: int) -> Column:
    """Overlapping windows of n code points; [] for a shorter text. Built from the characters' array: linear in the length."""
    if n < 1:
        raise ValueError("n must be at least 1")
    if n == 1:
        return characters(text)
    cs = F.split(text, "")
    windows = cs
    for k in range(1, n):
        # The k-th shift of the array is joined on; the tail is cut below.
        windows = F.zip_with(windows, F.slice(cs, k + 1, F.greatest(F.size(cs) - k, F.lit(0))), lambda a, b: F.concat(a, b))
    fits = F.char_length(text) >= n
    return F.when(fits, F.slice(windows, 1, F.size(cs) - (n - 1))).when(text.isNotNull(), F.array().cast("array<string>"))


def byte_size(text: Column) -> Column:
    return F.octet_length(text)


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, UNSAFE, "_")


def safe_tag(tag: Column) -> Column:
    """Slashes, backslashes and blanks as underscores."""
    return F.translate(tag, "/\\ ", "___")


def title_slug(title: Column, size: int = 50) -> Column:
    """Words joined by underscores, the first size code points, made safe."""
    return safe_name(F.substring(F.array_join(words(title), "_"), 1, size))


def article_name(ordinal: Column, title: Column) -> Column:
    return F.format_string("article_%d_%s.txt", ordinal, title_slug(title))


def article_body(title: Column, text: Column) -> Column:
    return F.concat(F.lit("Title: "), title, F.lit("\n"), text, F.lit("\n"))


def vocabulary_size(strategy: Column) -> Column:
    """25000 for BPE25k; null for other strategies."""
    return F.when(strategy.rlike("^BPE[0-9]+k$"), F.regexp_extract(strategy, "^BPE([0-9]+)k$", 1).cast("int") * 1000)


def token_line(word: Column, tag: Column, sep: str = "\t") -> Column:
    return F.concat_ws(sep, word, tag)


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))
