"""Test items leaking into a corpus: a generalised suffix automaton of the items, through which every text is streamed."""

from __future__ import annotations

import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, small_enough
from .arrow import cogroup_batches, map_batches, spread

#: A passage counts from so many consecutive letters and digits of the item.
LEAST = 70
#: Around one letter in so many may be changed, lost or added.
EVERY = 25
#: A text that holds this part of an item's letters in exact pieces, however short each, exceeds the limit of coverage.
COVERAGE = 0.8
#: A passage ends where so many edits gain fewer letters than PACE.
BURST, PACE = 4, 12
#: Letters of items that one automaton holds (a few hundred MB in a worker). More items are split into blocks by their id.
BLOCK_LETTERS = 250_000
#: With several blocks, letters of candidate texts that one task searches with one block.
GROUP_LETTERS = 20_000_000
#: Parts of one gram's texts when texts meet the grams of several blocks.
SALTS = 16
#: Occurrence lists that an automaton keeps at hand.
KEPT = 200_000


class _Letters(dict):
    """Code point to its letters and digits in compatible form, or nothing."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if 0x3099 <= code <= 0x309C:
            out = chr(code if code < 0x309B else code - 2)
        else:
            out = "".join(x for x in unicodedata.normalize("NFKC", c) if x.isalnum() or x in "゙゚").lower()
        self[code] = out
        return out


_LETTERS = _Letters()


def letters(text: str | None) -> str:
    """Letters and digits only, width and case aside."""
    out = (text or "").translate(_LETTERS)
    return unicodedata.normalize("NFC", out) if "゙" in out or "゚" in out else out


def letter_places(text: str) -> tuple[str, list[int]]:
    """The same letters, with the place in the text each comes from."""
    out, places = [], []
    for i, c in enumerate(text):
        x = _LETTERS[ord(c)]
        if x in ("゙", "゚") and out and len(whole := unicodedata.normalize("NFC", out[-1] + x)) == 1:
            out[-1] = whole
            continue
        out += x
        places += [i] * len(x)
    return "".join(out), places


class Automaton:
    """Generalised suffix automaton of several strings."""

    def __init__(self, items: list[tuple[int, str]], least: int):
        self.items = dict(items)
        self.least = least
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for item, text in items:
            last = 0
            for place, c in enumerate(text):
                last = self._extend(last, c)
                self.ends[last].append((item, place + 1))
        self.children: list[list[int]] = [[] for _ in self.next]
        for v in range(1, len(self.next)):
            self.children[self.link[v]].append(v)
        self._all: dict[int, list[tuple[int, int]]] = {}
        self.repeated = self._repeated(items)
        self.half = max(1, least // 2)
        self.grams = {text[i : i + self.half] for _, text in items for i in range(len(text) - self.half + 1)}

    def _state(self, length: int, link: int, following: dict[str, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: str) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: str) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def _repeated(self, items: list[tuple[int, str]]) -> dict[int, tuple[list[int], list[int]]]:
        """For each item the ends of its grams of ``least`` letters that stand elsewhere in the items too, and the states of these grams."""
        gram, count = list(range(len(self.next))), [len(e) for e in self.ends]
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        for v in order:
            if self.length[self.link[v]] >= self.least:
                gram[v] = gram[self.link[v]]
        for v in reversed(order):
            count[self.link[v]] += count[v]
        out = {}
        for item, text in items:
            state, ends, states = 0, [], []
            for end, c in enumerate(text, 1):
                state = self.next[state][c]
                if end >= self.least and count[gram[state]] > 1:
                    ends.append(end)
                    states.append(gram[state])
            out[item] = ends, states
        return out

    def occurrences(self, state: int) -> list[tuple[int, int]]:
        """(item, end) of the strings of a state."""
        if state not in self._all:
            if len(self._all) >= KEPT:
                self._all.clear()
            out, stack = [], [state]
            while stack:
                v = stack.pop()
                out += self.ends[v]
                stack += self.children[v]
            self._all[state] = out
        return self._all[state]

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """(end, length, state) of the maximal matches of ``least`` or more while the text streams through.

        Such a match holds one of the grams of ``half`` letters that begin at every ``step``-th place. Where that gram is in no item, nothing can
        be missed, so letters go through the automaton only from shortly before a known gram to where no match of ``half`` is left.
        """
        following, link, length, least, half, grams = self.next, self.link, self.length, self.least, self.half, self.grams
        step = least - half + 1
        found, size, p, last = [], len(text), 0, -1
        while p + half <= size:
            if text[p : p + half] not in grams:
                p += step
                continue
            i, sure = max(0, p - step + 1), p + half
            state, n, here = 0, 0, following[0]
            while i < size:
                c = text[i]
                to = here.get(c)
                if to is not None:
                    n += 1
                else:
                    if n >= least and i > last:
                        found.append((i, n, state))
                        last = i
                    to = 0
                    n = 0
                    while state:
                        state = link[state]
                        known = following[state].get(c)
                        if known is not None:
                            n = length[state] + 1
                            to = known
                            break
                state = to
                here = following[to]
                i += 1
                if n < half and i >= sure:
                    break
            else:
                if n >= least and size > last:
                    found.append((size, n, state))
                    last = size
            p = max(p + step, -(-(i - n) // step) * step)
        return found

    def pieces(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item, start, end, item end) of the longest equal pieces of ``least`` or more letters of the text and any place of any item.

        All lie within the maximal matches. What other items hold of a match are the repeated grams of the item it was found in.
        """
        done: dict[tuple[int, int], int] = {}
        for end, n, state in self.matches(text):
            here = self.occurrences(state)
            for item, item_end in here:
                done[item, end - item_end] = end
                yield item, end - n, end, item_end
            item, item_end = here[0]
            ends, states = self.repeated[item]
            for k in range(bisect_left(ends, item_end - n + self.least), bisect_right(ends, item_end)):
                b = end - item_end + ends[k]
                for other, d in self.occurrences(states[k]):
                    if done.get((other, b - d), -1) >= b:
                        continue
                    whole, first, last, place = self.items[other], b - self.least, b, d
                    while first > 0 and first - b + d > 0 and text[first - 1] == whole[first - 1 - b + d]:
                        first -= 1
                    while last < len(text) and place < len(whole) and text[last] == whole[place]:
                        last += 1
                        place += 1
                    done[other, b - d] = last
                    yield other, first, last, place

    def spans(self, text: str, shortest: int, every: int, coverage: float | None) -> list[tuple[int, int, int, int, int, str]]:
        """(item, start, end, item start, item end, rule) of what exceeds a limit: the length of one passage, or the part of the item's letters that
        the exact pieces in the text cover together."""
        pieces = list(self.pieces(text))
        out = [(*x, "length") for x in self.passages(text, shortest, every, pieces)]
        if coverage is not None:
            of: dict[int, list[tuple[int, int, int]]] = {}
            for item, start, end, item_end in pieces:
                of.setdefault(item, []).append((item_end - (end - start), item_end, start))
            for item, parts in of.items():
                covered = at = 0
                for a, b, _ in sorted(parts):
                    covered += max(0, b - max(at, a))
                    at = max(at, b)
                if covered >= coverage * len(self.items[item]):
                    out += [(item, start, start + b - a, a, b, "coverage") for a, b, start in parts]
        return out

    def passages(self, text: str, shortest: int, every: int, pieces: list | None = None) -> list[tuple[int, int, int, int, int]]:
        """(item, start, end, item start, item end) of the passages of ``shortest`` letters of an item, edits allowed."""
        out: dict[int, list[tuple[int, int, int, int]]] = {}
        for item, start, end, item_end in self.pieces(text) if pieces is None else pieces:
            if len(self.items[item]) < shortest:
                continue
            spans = out.setdefault(item, [])
            if any(a <= start and end <= b and item_end <= d for a, b, _, d in spans):
                continue
            whole, item_start = self.items[item], item_end - (end - start)
            if end - start + 2 * (PACE - 1) < shortest and not _goes_on(text, whole, end, item_end, 1) and not _goes_on(text, whole, start - 1, item_start - 1, -1):
                continue
            rights, lefts = _reach(text, whole, end, item_end, 1), _reach(text, whole, start - 1, item_start - 1, -1)
            best = None
            for more, left, item_left in lefts:
                for edits, right, item_right in rights:
                    n = item_right - item_left
                    if n >= shortest and edits + more <= max(1, n / (every * 0.8)) and (best is None or n > best[3] - best[2]):
                        best = (left, right, item_left, item_right)
            if best:
                spans.append(best)
        return [(item, *span) for item, spans in out.items() for span in spans]


def _goes_on(a: str, b: str, i: int, j: int, step: int) -> bool:
    """Whether ``_reach`` may gain ``PACE`` letters: most of these must then be among the next letters of the other string. Never wrongly no."""
    near, known = (a[i : i + PACE + BURST], b[j : j + PACE]) if step > 0 else (a[max(0, i - PACE - BURST + 1) : i + 1], b[max(0, j - PACE + 1) : j + 1])
    return len(known) == PACE and sum(map(near.__contains__, known)) >= PACE - BURST


def _reach(a: str, b: str, i: int, j: int, step: int) -> list[tuple[int, int, int]]:
    """(edits, place in a, place in b): how far from places i and j on the strings agree in one direction, for each number of edits.

    The places are those after the last equal letter, so a passage may end at any of them. One edit needs an equal letter after it, several at
    an end must gain three letters each, as what follows a passage may agree by chance. It goes on until ``BURST`` edits gain less than ``PACE`` letters.
    """
    base = 0 if step > 0 else 1
    room_a, room_b = (len(a) - i, len(b) - j) if step > 0 else (i + 1, j + 1)
    front, gained, out, edits = {0: 0}, [0], [(0, i + base, j + base)], 0
    while front:
        edits += 1
        after: dict[int, int] = {}
        for d, y in front.items():
            # Changed, added in a, lost from b: d is how much further a is than b.
            for to, n in ((d, y + 1), (d + 1, y), (d - 1, y + 1)):
                if n <= room_b and n + to <= room_a and n > after.get(to, -1):
                    after[to] = n
        best, at = gained[-1], None
        for d, y in after.items():
            k = y
            while k < room_b and k + d < room_a and a[i + (k + d) * step] == b[j + k * step]:
                k += 1
            after[d] = k
            if k > y and k > best:
                best, at = k, d
        gained.append(best)
        if at is not None and all(best - gained[-1 - n] >= 3 * n for n in range(2, edits + 1)):
            out.append((edits, i + base + (best + at) * step, j + base + best * step))
        if edits >= BURST and best - gained[-1 - BURST] < PACE:
            break
        front = {d: y for d, y in after.items() if y >= best - 40}
    return out


_BUILT: dict[tuple, Automaton] = {}


def _automaton(items: list[tuple[int, str]], least: int) -> Automaton:
    """One for each Python worker and item set."""
    key = (hash(tuple(items)), least)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton(items, least)
    return _BUILT[key]


def seeds(text: str, least: int) -> set[int]:
    """Hashes of grams such that any two texts that share ``least`` letters share one: of each ``least`` letters the gram with the least hash."""
    size = least // 2
    hashes = [int.from_bytes(blake2b(text[i : i + size].encode(), digest_size=8).digest(), "big", signed=True) for i in range(len(text) - size + 1)]
    wide = least - size + 1
    return {min(hashes[i : i + wide]) for i in range(len(hashes) - wide + 1)}


def _located(text: str, automaton: Automaton, shortest: int, every: int, coverage: float | None) -> list[dict]:
    found = automaton.spans(letters(text), shortest, every, coverage) if text else []
    if not found:
        return []
    _, places = letter_places(text)
    return [{"item_id": item, "first": places[a], "last": places[b - 1] + 1, "item_letters": d - c, "share": (d - c) / len(automaton.items[item]), "rule": rule} for item, a, b, c, d, rule in found]


_SPAN = "item_id long, first int, last int, item_letters int, share double, rule string"
_SPANS = f"array<struct<{_SPAN.replace(' ', ':').replace(',:', ',')}>>"


def _searched(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, shortest: int, every: int, coverage: float | None, keep: bool) -> DataFrame:
    """(doc_id, text, spans) of the texts with a passage, repeated rows once; text is null unless kept."""
    edits = -(-shortest // every)
    least = max(4, (shortest - edits) // (edits + 1))
    shortest_item = shortest if coverage is None else min(shortest, 2 * least)
    schema = f"doc_id long, key long, text string, spans {_SPANS}"
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).cast("string").alias("text")).where("text <> ''")
    texts = texts.select("doc_id", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text").alias("key"), "text")

    def to_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in batches:
            yield {"item_id": batch.column(0).to_pylist(), "letters": [letters(t) for t in batch.column(1).to_pylist()]}

    known = map_batches(items.select(F.col(item_id).cast("long"), F.col(item_text).cast("string")), to_letters, "item_id long, letters string")
    known = materialize(known.where((F.length("letters") >= shortest_item) & F.col("item_id").isNotNull()).distinct())
    total = known.agg(F.sum(F.length("letters"))).first()[0] or 0

    def search(rows: pa.RecordBatch | pa.Table, block: list[tuple[int, str]]) -> dict[str, list]:
        automaton = _automaton(block, least)
        columns = (rows.column(c).to_pylist() for c in ("doc_id", "key", "text"))
        found = [(doc, key, text if keep else None, spans) for doc, key, text in zip(*columns) if (spans := _located(text, automaton, shortest, every, coverage))]
        return {c: [r[k] for r in found] for k, c in enumerate(("doc_id", "key", "text", "spans"))}

    if total <= BLOCK_LETTERS:
        # All items are one block, whose size has just been counted: every task searches its texts where they lie.
        held = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in known.orderBy("item_id", "letters").toLocalIterator()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
            for batch in batches:
                if held.value:
                    yield search(batch, held.value)

        return map_batches(spread(texts, "doc_id"), run, schema).distinct()

    # Several blocks: a text goes only to those whose seeds it holds, read once for all of them.
    def to_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in batches:
            rows = [(k, h) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for h in seeds(letters(t), least)]
            yield {"key": [k for k, _ in rows], "seed": [h for _, h in rows]}

    known = known.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(-(-total // BLOCK_LETTERS))))
    of_block = map_batches(known.select("block", "letters"), to_seeds, "key long, seed long").withColumnRenamed("key", "block").distinct()
    of_text = map_batches(texts.select("key", "text"), to_seeds, "key long, seed long")
    if small_enough(total, 16):
        pairs = of_text.join(F.broadcast(of_block), "seed")
    else:
        # A gram that a third of the texts hold is met in parts.
        parts = of_block.select("seed", "block", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        pairs = of_text.withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int")).join(parts, ["seed", "salt"])
    wanted = texts.join(pairs.select("key", "block").distinct(), "key").withColumn("size", F.length("text"))
    wanted = materialize(wanted)
    largest = wanted.groupBy("block").agg(F.sum("size").alias("n")).agg(F.max("n")).first()[0] or 0
    salts = -(-largest // GROUP_LETTERS) or 1
    left = wanted.select((F.col("block") * salts + F.pmod("key", F.lit(salts))).alias("part"), "doc_id", "key", "text")
    right = known.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(salts - 1)), lambda i: F.col("block") * salts + i)).alias("part"), "item_id", "letters")

    def both(of_texts: pa.Table, of_items: pa.Table) -> dict[str, list]:
        block = sorted(zip(of_items.column("item_id").to_pylist(), of_items.column("letters").to_pylist()))
        return search(of_texts, block)

    # A text's spans are bounded by its length, so one row holds them.
    parts = cogroup_batches(left, right, "part", both, schema).distinct()
    return parts.groupBy("doc_id", "key").agg(F.first("text").alias("text"), F.flatten(F.collect_list("spans")).alias("spans"))


def leaked(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, shortest: int = LEAST, every: int = EVERY, coverage: float | None = None) -> DataFrame:
    """(doc_id, item_id, first, last, item_letters, share, rule): the passages of items in texts, as places in the original text.

    ``length``: a passage of at least ``shortest`` consecutive letters and digits of an item, of which about one in ``every`` may be
    edited; blanks, punctuation, width and case do not count. With so few edits the passage holds an exact piece of
    (shortest - edits) / (edits + 1) letters, which the automaton finds; the passage is then checked letter by letter from
    there. ``coverage``: the exact pieces of an item in one text, each of that many letters, together hold this part of the item's letters,
    however short each is (not searched for where the limit is null). share is the part of the item's letters in the passage or piece.
    Null and empty texts and items have none, repeated rows come out once. Items shorter than a passage have no passage by length.
    """
    found = _searched(docs, doc_id, doc_text, items, item_id, item_text, shortest, every, coverage, False)
    return found.select("doc_id", F.inline("spans"))


def cleaned(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, shortest: int = LEAST, every: int = EVERY, coverage: float | None = COVERAGE) -> DataFrame:
    """(doc_id, items, removed, text): each text with a passage, once, with everything cut out that exceeds the limit of length or of coverage.

    ``removed`` counts the characters cut, blanks and punctuation within a passage too. Texts without passages do not come out; see ``leaked``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in batches:
            out: dict[str, list] = {"doc_id": batch.column(0).to_pylist(), "items": [], "removed": [], "text": []}
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                kept, at, removed = [], 0, 0
                for a, b in sorted((x["first"], x["last"]) for x in spans):
                    kept.append(text[at : max(at, a)])
                    removed += max(0, b - max(at, a))
                    at = max(at, b)
                out["items"].append(sorted({x["item_id"] for x in spans}))
                out["removed"].append(removed)
                out["text"].append("".join(kept) + text[at:])
            yield out

    found = _searched(docs, doc_id, doc_text, items, item_id, item_text, shortest, every, coverage, True)
    return map_batches(found, run, "doc_id long, items array<long>, removed int, text string")
