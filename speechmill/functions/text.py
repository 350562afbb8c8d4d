"""Text primitives as column expressions; the few that act on query text are plain Python."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character classes the text index is cut by.
KANJI_RUN = "[一-鿿々]{2,}"
KATAKANA_RUN = "[ァ-ヴー]{2,}"
WIDE_RUN = "[Ａ-Ｚａ-ｚ０-９]{2,}"
RUN_PATTERN = f"{KANJI_RUN}|{KATAKANA_RUN}|{WIDE_RUN}"
#: Candidate terms for topics: kanji and katakana only, at most ten characters.
CANDIDATE_PATTERN = "[一-鿿々]{2,10}|[ァ-ヴー]{2,10}"

ASCII_ALNUM = "".join(chr(c) for c in range(0x30, 0x7B) if chr(c).isalnum())
WIDE_ALNUM = "".join(chr(ord(c) + 0xFEE0) for c in ASCII_ALNUM)
WIDE_LOWER = "".join(chr(c) for c in range(0xFF41, 0xFF5B))
WIDE_UPPER = "".join(chr(c) for c in range(0xFF21, 0xFF3B))
KATAKANA = "".join(chr(c) for c in range(0x30A1, 0x30F7))
HIRAGANA = "".join(chr(ord(c) - 0x60) for c in KATAKANA)

#: Blanks of any width, and characters that take no room.
BLANKS = "   " + "".join(map(chr, range(0x2000, 0x200B))) + "  　"
INVISIBLE = "­͏؜᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿"


def _half_katakana() -> tuple[dict[str, str], dict[str, str]]:
    """Half-width katakana: the two-sign voiced forms, and the single signs."""
    single = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0xFF61, 0xFF9E)}
    voiced = {}
    for c in single:
        for mark in "ﾞﾟ":
            whole = unicodedata.normalize("NFKC", c + mark)
            if len(whole) == 1:
                voiced[c + mark] = whole
    return voiced, single


VOICED, SINGLE = _half_katakana()


def full_width(c: Column) -> Column:
    """ASCII letters and digits to their full-width forms; nothing else changes."""
    return F.translate(c, ASCII_ALNUM, WIDE_ALNUM)


def word_key(c: Column) -> Column:
    """Full-width small letters to capitals, as index keys are stored."""
    return F.translate(c, WIDE_LOWER, WIDE_UPPER)


def to_hiragana(c: Column) -> Column:
    return F.translate(c, KATAKANA, HIRAGANA)


def same_look(c: Column) -> Column:
    """One form for strings that differ by width, invisible characters or blanks at the ends only."""
    printable = "".join(map(chr, range(0x21, 0x7F)))
    wide = "".join(chr(ord(x) + 0xFEE0) for x in printable)
    inner = BLANKS.replace("　", "")
    out = reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), [p for p in VOICED.items()], c)
    out = F.translate(out, "".join(SINGLE) + printable + inner + INVISIBLE, "".join(SINGLE.values()) + wide + "　" * len(inner))
    return F.trim(out, F.lit("　"))


def name_key(c: Column) -> Column:
    """Names compared without blanks, dots, width and kana script."""
    return F.regexp_replace(to_hiragana(same_look(c)), "[\\s　・･]", "")


def fold(c: Column) -> Column:
    """For name search: white space dropped, katakana as hiragana."""
    return to_hiragana(F.regexp_replace(c, "[\\s　]", ""))


def is_japanese(c: Column) -> Column:
    return c.rlike("[぀-ヿ一-鿿]")


def runs(c: Column, pattern: str = RUN_PATTERN) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def ngrams(c: Column, n: int) -> Column:
    """The windows of n characters of a string; none if it is shorter."""
    return F.when(F.char_length(c) >= n, F.transform(F.sequence(F.lit(1), F.char_length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def run_bigrams(c: Column) -> Column:
    """Distinct two-character windows inside the runs of a text, folded to index keys."""
    return F.array_distinct(F.flatten(F.transform(runs(c), lambda r: ngrams(word_key(r), 2))))


def occurrences(c: Column, form: Column) -> Column:
    """Non-overlapping occurrences of a literal."""
    return F.when(F.length(form) > 0, ((F.length(c) - F.length(F.replace(c, form, F.lit("")))) / F.length(form)).cast("long")).otherwise(F.lit(0).cast("long"))


def snippet(c: Column, term: Column, before: int = 40, length: int = 160) -> Column:
    return F.substring(c, F.greatest(F.lit(1), F.instr(c, term) - before), F.lit(length))


def marked_snippet(c: Column, term: Column, before: int = 12, length: int = 26, opening: str = "\x01", closing: str = "\x02", dots: str = "…") -> Column:
    """A window around the first hit, compared in lower case, with the hit marked and cut ends dotted."""
    at = F.instr(F.lower(c), F.lower(term))
    start = F.greatest(F.lit(1), at - before)
    stop = start + F.greatest(F.lit(length), F.length(term))
    head, hit = F.substring(c, start, at - start), F.substring(c, at, F.length(term))
    tail = F.substring(c, at + F.length(term), F.greatest(F.lit(0), stop - at - F.length(term)))
    return F.when(at > 0, F.concat(F.when(start > 1, F.lit(dots)).otherwise(F.lit("")), head, F.lit(opening), hit, F.lit(closing), tail, F.when(stop <= F.length(c), F.lit(dots)).otherwise(F.lit(""))))


def escape_html(c: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def highlight(c: Column, terms: list[str], opening: str = "<mark>", closing: str = "</mark>") -> Column:
    """Every term marked in one pass, the longest first, case aside; the text is escaped."""
    out = escape_html(c)
    wanted = sorted({t for t in terms if t}, key=lambda t: (-len(t), t))
    if not wanted:
        return out
    escaped = [_quoted(t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&#39;")) for t in wanted]
    return F.regexp_replace(out, f"(?iu)({'|'.join(escaped)})", f"{opening}$1{closing}")


def _quoted(term: str) -> str:
    return "".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in term)


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n+"), lambda x: F.regexp_replace(x, "^[\\s　]+|[\\s　]+$", "")), lambda x: x != "")


def unit_key(speaker: Column, yomi: Column, group: Column) -> Column:
    return F.concat_ws("\t", F.coalesce(speaker, F.lit("")), F.coalesce(yomi, F.lit("")), F.coalesce(group, F.lit("")))


def safe_url(c: Column) -> Column:
    """An http or https address without blanks or control characters, else null."""
    t = F.trim(c)
    return F.when(F.lower(t).rlike("^https?://") & ~t.rlike("[\\s\\x00-\\x1f]"), t)


def last_segment(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def json_script(c: Column) -> Column:
    return F.replace(c, F.lit("<"), F.lit("\\u003c"))


def fingerprint(values: Column) -> Column:
    """The first sixteen hex digits of the SHA-256 of an array of strings."""
    return F.substring(F.sha2(F.array_join(values, "\n"), 256), 1, 16)


def rate(hits: Column, total: Column, per: int = 1000) -> Column:
    return F.when(total > 0, hits / total * per).otherwise(F.lit(0.0))


def smoothed_ratio(value: Column, base: Column, by: float = 0.1) -> Column:
    return (value + by) / (base + by)


def prefixes_and_parts(name: Column) -> tuple[Column, Column]:
    """All substrings of a name of two characters or more, and its leading two to four characters."""
    whole = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.char_length(name))), lambda n: F.when(F.char_length(name) >= n, F.transform(F.sequence(F.lit(1), F.char_length(name) - n + 1), lambda i: F.substring(name, i, n))))
    lead = F.filter(F.transform(F.array(F.lit(2), F.lit(3), F.lit(4)), lambda n: F.when(F.char_length(name) >= n, F.substring(name, F.lit(1), n))), lambda x: x.isNotNull())
    return F.array_distinct(F.flatten(F.filter(whole, lambda x: x.isNotNull()))), lead
