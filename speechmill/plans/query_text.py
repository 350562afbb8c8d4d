"""Planning of query text: plain Python, as it acts on what was typed and not on data."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.text import ASCII_ALNUM, WIDE_ALNUM, WIDE_LOWER, WIDE_UPPER

# Limits on what is typed.
MAX_TERMS = 16
MAX_TERM_LENGTH = 64
MAX_INPUT_LENGTH = MAX_TERMS * (MAX_TERM_LENGTH + 1)

#: What the indexes can find: anything of three characters, or two of one class of runs.
_FINDABLE = re.compile("[一-鿿々]{2}|[ァ-ヴー]{2}|[Ａ-Ｚａ-ｚ０-９]{2}|.{3,}", re.DOTALL)
_GAPS = re.compile("([\\s　]+)")
_TO_WIDE = dict(zip(map(ord, ASCII_ALNUM), WIDE_ALNUM))
_TO_KEY = dict(zip(map(ord, WIDE_LOWER), WIDE_UPPER))


def to_full_width(text: str) -> str:
    return text.translate(_TO_WIDE)


def to_word_key(term: str) -> str:
    return term.translate(_TO_KEY)


def _as_key(term: str) -> str:
    """A term as it is looked up: short ones by their index key, others as they are."""
    return to_word_key(term) if len(term) <= 2 else term


def _pieces(text: str) -> list[str]:
    """Terms and the blanks between them in turn, terms first and last, within the limits."""
    pieces = _GAPS.split(text)
    if sum(map(bool, pieces[::2])) <= MAX_TERMS and max(map(len, pieces[::2])) <= MAX_TERM_LENGTH:
        return pieces
    kept = [t[:MAX_TERM_LENGTH] for t in pieces[::2] if t]
    return _GAPS.split(" ".join(kept[:MAX_TERMS]))


def split_terms(text: str) -> list[str]:
    """Full-width terms, at most sixteen of at most 64 characters."""
    return list(filter(None, _pieces(to_full_width(text))[::2]))


def canonical_query(text: str) -> str:
    """What is shown for a query: clamped, full width, terms shorter than three as index keys, blanks as typed."""
    pieces = _pieces(text[:MAX_INPUT_LENGTH])
    pieces[::2] = [_as_key(to_full_width(t)) for t in pieces[::2]]
    return to_full_width("".join(pieces))


def probe_keys(terms: list[str]) -> list[str]:
    """Index keys whose frequencies the plan needs."""
    return [_as_key(t) for t in terms if len(t) <= 2]


def unsearchable_terms(terms: list[str]) -> list[str]:
    """Terms that no index path can ever find."""
    return [t for t in terms if not _FINDABLE.fullmatch(t)]


@dataclass(frozen=True)
class Plan:
    """``fts``: all terms as substrings, case aside. ``word``: an index key and further literal substrings. ``topic``: a topic's postings."""

    mode: str
    terms: tuple[str, ...] = ()
    driver: str = ""
    filters: tuple[str, ...] = field(default=())
    topic: int | None = None


def word_plan(terms: list[str], counts: dict[str, int]) -> Plan:
    """Substring search if every term has three characters, else from the rarest short term (the first of equally rare ones), the rest as filters."""
    keys = [_as_key(t) for t in terms]
    by_rarity = sorted((counts.get(k, 0), place) for place, k in enumerate(keys) if len(k) <= 2)
    if by_rarity:
        lead = by_rarity[0][1]
        return Plan("word", driver=keys[lead], filters=(*keys[:lead], *keys[lead + 1 :]))
    return Plan("fts", terms=tuple(keys)) if keys else Plan("word")


def match_topic(text: str, topics: list[dict]) -> int | None:
    """The indexed topic whose term or variant the whole query is, case aside."""
    wanted = to_full_width(text).strip().upper()
    return next((t["id"] for t in topics if t.get("indexed") and wanted and wanted in (x.upper() for x in [t["term"], *(t.get("variants") or [])])), None)


def related_topics(text: str, topics: list[dict], most: int = 12) -> list[int]:
    """Topics whose term holds any term of the query."""
    terms = [t.upper() for t in split_terms(text)]
    return [t["id"] for t in topics if any(x in t["term"].upper() for x in terms)][:most]
