"""Text that looks the same, in one consistent form, by confusable skeletons.

A skeleton is the text decomposed, with every character replaced by the prototype of its look-alikes, and decomposed again. Values or
words of equal skeleton look the same; the one written in a single script is the consistent form of its group.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import INVISIBLE
from ..session import materialize
from .arrow import map_batches, spread

# Characters of one script that look like those of another. The table lists, for each katakana sign, the kanji or the hiragana of its
# shape, and for each Latin letter the Greek, Cyrillic and Armenian ones. Width, ligature, radical, compatibility and mathematical forms follow by rule.
KANJI_LIKE = {"カ": "力", "ロ": "口", "ニ": "二", "ハ": "八", "エ": "工", "タ": "夕", "ト": "卜", "オ": "才", "チ": "千", "ミ": "三", "ー": "一", "ノ": "丿", "メ": "乂", "セ": "七", "ヌ": "又", "ム": "厶", "サ": "廾", "ヒ": "匕"}
HIRAGANA_LIKE = {"ヘ": "へ", "ベ": "べ", "ペ": "ぺ", "リ": "り"}
LETTER_LIKE = {
    "A": "ΑА", "B": "ΒВ", "C": "СϹ", "D": "Ꭰ", "E": "ΕЕ", "F": "Ϝ", "G": "Ԍ", "H": "ΗН", "I": "ΙІӀ", "J": "ЈͿ", "K": "ΚК", "L": "Ꮮ", "M": "ΜМϺ", "N": "Ν", "O": "ΟОՕ", "P": "ΡР", "Q": "Ԛ", "S": "ЅՏ", "T": "ΤТ", "U": "Ս", "V": "Ѵ", "W": "Ԝ", "X": "ΧХ", "Y": "ΥУҮ", "Z": "Ζ",
    "a": "αа", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ց", "h": "һհ", "i": "іι", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "οоօ", "p": "ρр", "q": "ԛզ", "s": "ѕ", "u": "υս", "v": "νѵ", "w": "ԝ", "x": "х", "y": "у",
}
#: Strokes that stand for the mark of a long vowel within a katakana word.
DASHES = "―—–−─━‐－"
#: Of the hiragana, these have the shape of their katakana.
SAME_SHAPE = "へべぺり"

FOREIGN = "".join(LETTER_LIKE.values())
KANJI = "".join(KANJI_LIKE.values())
_LATIN = "".join(chr(ord(p) + 0xFEE0) * len(xs) for p, xs in LETTER_LIKE.items())
_PROTOTYPE = str.maketrans({x: p for p, xs in LETTER_LIKE.items() for x in xs} | {x: p for p, x in KANJI_LIKE.items()} | {x: p for p, x in HIRAGANA_LIKE.items()} | {"゛": "゙", "゜": "゚"} | dict.fromkeys(DASHES, "ー") | dict.fromkeys(INVISIBLE, None))


def skeleton(text: str) -> str:
    """Decompose, replace by prototypes, decompose again; blanks are dropped."""
    text = unicodedata.normalize("NFKD", text.translate(_PROTOTYPE)).translate(_PROTOTYPE)
    return unicodedata.normalize("NFKD", "".join(text.split()))


class _House(dict):
    """Code point to consistent form, filled by rule as characters are met."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        kind = unicodedata.category(c)
        if c == "\n":
            out = c
        elif kind == "Zs" or c == "\t" or kind in ("Zl", "Zp"):
            out = "　"
        elif kind in ("Cf", "Cc") or c in INVISIBLE or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
            out = None
        elif code < 0x7F and c.isalnum():
            out = chr(code + 0xFEE0)
        elif code in (0x309B, 0x309C):
            out = chr(code - 2)
        elif 0xFF61 <= code <= 0xFF9F or 0xF900 <= code <= 0xFAFF or 0x2E80 <= code <= 0x2FDF or 0x2F800 <= code <= 0x2FA1F or 0x3200 <= code <= 0x33FF and unicodedata.normalize("NFKC", c).isalpha():
            out = unicodedata.normalize("NFKC", c)
        elif 0x1D400 <= code <= 0x1D7FF:
            out = "".join(chr(ord(x) + 0xFEE0) if x.isascii() else x for x in unicodedata.normalize("NFKC", c))
        else:
            out = c
        self[code] = out
        return out


_HOUSE = _House()
_GAP = re.compile("　+(?=[゙゚])")
#: Text of these characters alone is in that form: most texts are.
_FINE = re.compile("[ぁ-ゖァ-ヺー一-鿿々Ａ-Ｚａ-ｚ０-９　\n。、．，「」『』（）・：；！？％■-◿〇]*\\Z")


def composed(text: str) -> str:
    """Composed full-width kana, full-width letters and digits, ordinary kanji, U+3000 the only blank, nothing invisible."""
    if _FINE.match(text):
        return text
    text = text.translate(_HOUSE)
    if "゙" in text or "゚" in text:
        text = _GAP.sub("", text)
    return unicodedata.normalize("NFC", text)


_WIDE = "Ａ-Ｚａ-ｚ０-９"
_KATA = "ァ-ヺー"
_HAN = "一-鿿々"
_LIKE = "".join(KANJI_LIKE)
_WORDS = re.compile(f"[ァ-ヺ](?:[{_KATA}{KANJI}{SAME_SHAPE}]|[{DASHES}](?=[ァ-ヺ]))+|[{_KATA}{KANJI}{SAME_SHAPE}]{{2,}}|[{_WIDE}{FOREIGN}]*[{FOREIGN}][{_WIDE}{FOREIGN}]*|[{_WIDE}]{{2,}}")
_KANJI_WORDS = re.compile(f"(?<![{_KATA}{_HAN}])(?=[{_HAN}]*[{_LIKE}{KANJI}])[{_HAN}{_LIKE}]{{2,}}+(?![{_KATA}])")
_ONE_SIGN = re.compile(f"(?:[{_HAN}]|(?<![{_LIKE}])[{_LIKE}](?![{_LIKE}]))+\\Z")
_HIRAGANA_WORDS = re.compile(f"[{''.join(HIRAGANA_LIKE)}](?![{_KATA}])(?<![{_KATA}].)(?:(?<=[ぁ-ゖ].)|(?=[ぁ-ゖ]))")
_KATAKANA = re.compile("[ァ-ヺー]")
_PURE_KATAKANA = re.compile("[ァ-ヺー]+\\Z")
_PURE_WIDE = re.compile(f"[{_WIDE}]+\\Z")
_HAS_FOREIGN = re.compile(f"[{FOREIGN}]")
_HAS_WIDE = re.compile(f"[{_WIDE}]")
_HAS_KANJI = re.compile(f"[{KANJI}]")
_EDGE = f"{KANJI}{SAME_SHAPE}"
_TO_LATIN = str.maketrans(FOREIGN, _LATIN)


def words_of(text: str) -> tuple[list[str], list[tuple[str, str | None]]]:
    """Words in one script, and words that mix scripts by look-alike characters (also without such characters at their ends).

    The latter come with their form where it is certain from the word alone: Latin words with foreign letters, and single katakana signs of
    hiragana shape beside hiragana. All others have to be told from the words of the same skeleton.
    """
    pure: list[str] = []
    mixed: list[tuple[str, str | None]] = []
    for word in _WORDS.findall(text):
        if _PURE_KATAKANA.match(word) or _PURE_WIDE.match(word):
            pure.append(word)
        elif _HAS_FOREIGN.search(word):
            mixed.append((word, word.translate(_TO_LATIN) if _HAS_WIDE.search(word) else None))
        elif _KATAKANA.search(word):
            right, left = word.rstrip(_EDGE), word.lstrip(_EDGE)
            mixed += {(w, None) for w in (word, right, left, right.lstrip(_EDGE)) if len(w) > 1 and not _PURE_KATAKANA.match(w)}
    for word in _KANJI_WORDS.findall(text):
        if not _KATAKANA.search(word):
            pure.append(word)
        elif _ONE_SIGN.match(word) and any("一" <= c <= "鿿" for c in word):
            mixed.append((word, None))
    for m in _HIRAGANA_WORDS.finditer(text):
        word = text[max(0, m.start() - 1) : m.end() + 1]
        mixed.append((word, word.replace(m.group(), HIRAGANA_LIKE[m.group()])))
    return pure, mixed


_MARKS = "゙゚゛゜ﾞﾟ"
_CELL = re.compile(f"(?s).(?:[\\s　]*[{_MARKS}]|[{INVISIBLE}])*")
_CLAUSE = re.compile("[^。、\n]+")


def _sort(c: str) -> str:
    return "kata" if "ァ" <= c <= "ヺ" or c == "ー" else "hira" if "ぁ" <= c <= "ゖ" else "kanji" if "一" <= c <= "鿿" or c == "々" else "blank" if c.isspace() else "wide" if c.isalnum() else "sign"


def originals_of(text: str) -> list[tuple[str, str]]:
    """(word as it stands, its house form) of the words that hold characters other than the house members of their prototypes."""
    out = []
    for clause in _CLAUSE.findall(text):
        if composed(clause) == clause:
            continue
        word, kind = "", None
        for cell in [*_CELL.findall(clause), "。"]:
            form = composed(cell)
            sort = _sort(form[0]) if form else kind
            if word and sort != kind and kind is not None:
                if (house := composed(word)) != word:
                    out.append((word, house))
                word = ""
            word, kind = word + cell, sort
    return out


_TO_KATAKANA = str.maketrans({x: p for p, x in KANJI_LIKE.items()} | {x: p for p, x in HIRAGANA_LIKE.items()})
_TO_HIRAGANA = str.maketrans({p: x for p, x in HIRAGANA_LIKE.items()} | {x: chr(ord(p) - 0x60) for p, x in KANJI_LIKE.items() if p != "ー"} | {"一": "ー"})


def _scripts(word: str) -> tuple[int, int]:
    """How many unmistakable katakana and hiragana a word has."""
    return sum("ァ" <= c <= "ヺ" and c not in HIRAGANA_LIKE for c in word), sum("ぁ" <= c <= "ゖ" and c not in SAME_SHAPE for c in word)


def reading_form(reading: str) -> str:
    """A reading in consistent form: each of its words in the script of its unmistakable characters."""
    words = composed(reading).split("　")
    clear = [_scripts(w) for w in words]
    whole = (sum(k for k, _ in clear), sum(h for _, h in clear))
    out = []
    for word, (kata, hira) in zip(words, clear):
        if kata == hira:
            kata, hira = whole
        out.append(word.translate(_TO_KATAKANA) if kata > hira else word.translate(_TO_HIRAGANA) if hira > kata else word)
    return "　".join(out)


def scan(values: DataFrame, kind: str) -> DataFrame:
    """One pass over (tbl, field, rec_id, value). Two sorts of rows come out.

    With tbl: a value's ``originals``, the words (of readings: the value) that may not be in house form, each with its skeleton and, where its
    prototypes leave no choice, its house form. Without tbl: ``word``, one that is in house form, its skeleton and how often it stands in a batch.
    """
    schema = "kind string, tbl string, field string, rec_id long, form string, originals array<struct<original:string,skeleton:string,house:string,mixed:boolean>>, word string, skeleton string, n long"
    names = ["kind", "tbl", "field", "rec_id", "form", "originals", "word", "skeleton", "n"]

    def marks(value: str, count: Counter) -> tuple[str, list[tuple[str, str | None, bool]]]:
        if kind == "reading":
            form = reading_form(value)
            # Without one unmistakable sign nothing but a reading of the same skeleton tells the script.
            clear = any(_scripts(composed(value))) or not _HAS_KANJI.search(form)
            if form == value and clear:
                count[value] += 1
                return form, []
            return form, [(value, form if clear or form != value else None, not clear)]
        form = composed(value)
        pure, mixed = words_of(form)
        count.update(pure)
        return form, [*((w, h, False) for w, h in (originals_of(value) if form != value else ())), *((w, h, True) for w, h in mixed)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in names}
            count: Counter = Counter()
            for t, f, r, v in zip(*(batch.column(i).to_pylist() for i in range(4))):
                form, found = marks(v, count) if v else (v, [])
                if found:
                    said = [{"original": w, "skeleton": skeleton(w), "house": h, "mixed": m} for w, h, m in found]
                    for k, x in zip(names, (kind, t, f, r, form, said, None, None, None)):
                        out[k].append(x)
            for word, n in count.items():
                for k, x in zip(names, (kind, None, None, None, None, None, word, skeleton(word), n)):
                    out[k].append(x)
            yield out

    return map_batches(spread(values.select("tbl", "field", "rec_id", "value"), "rec_id"), run, schema)


def departures(texts: DataFrame, readings: DataFrame) -> DataFrame:
    """(tbl, field, rec_id, form) of every value that is not in consistent form.

    Both inputs are (tbl, field, rec_id, value). Null and empty values are never cases. A value is a case if the skeleton of one of its words
    belongs to another original than the word itself: where the prototypes leave one house form, to that form; where they leave several (a
    kanji or a katakana sign), to the most frequent original in one script that has the same skeleton anywhere in the texts, then the smallest.
    Ambiguous look-alikes (a numeral after a katakana word) therefore only count with such evidence. Digits and letters are kept apart, and a
    single katakana sign between kanji counts only as part of a kanji word of the texts.
    """
    found = materialize(scan(texts, "word").unionByName(scan(readings, "reading")))
    suspects = found.where("tbl IS NOT NULL").select("kind", "tbl", "field", "rec_id", "form", F.inline("originals"))
    wanted = suspects.where("house IS NULL").select("kind", "skeleton").distinct()
    pure = found.where("tbl IS NULL").groupBy("kind", "skeleton", "word").agg(F.sum("n").alias("n")).join(wanted, ["kind", "skeleton"], "left_semi")
    house = pure.groupBy("kind", "skeleton").agg(F.max_by("word", F.struct(F.col("n"), F.col("word"))).alias("told"))
    # Only what the prototypes leave open meets the originals, each skeleton once.
    told = suspects.where("house IS NULL").select("kind", "skeleton", "original").distinct().join(house, ["kind", "skeleton"]).where("told <> original").select("kind", "original", "told")
    named = suspects.where("house IS NULL").join(told, ["kind", "original"]).withColumn("house", F.col("told")).drop("told")
    departing = suspects.where("house <> original").select(*suspects.columns).unionByName(named.select(*suspects.columns))
    fix = F.when(F.col("mixed") | (F.col("kind") == "reading"), F.struct(F.length("original").alias("k"), "original", "house"))
    rows = departing.groupBy("kind", "tbl", "field", "rec_id", "form").agg(F.sort_array(F.collect_set(fix), asc=False).alias("fixes"))
    text = F.expr("aggregate(fixes, form, (text, x) -> replace(text, x.original, x.house))")
    return rows.select("tbl", "field", "rec_id", F.when(F.col("kind") == "reading", F.element_at("fixes", 1).getField("house")).otherwise(text).alias("form"))


def skeleton_groups(texts: DataFrame, readings: DataFrame) -> DataFrame:
    """(kind, skeleton, originals, members, house): words of the texts, and readings, that look the same.

    Only groups of several originals come out: their number, how often they stand all together, and the one in consistent form that stands most
    often, or null. Null and empty values belong to no group; a word that is in doubt at its ends (a numeral after it) is counted with and without them.
    """
    found = materialize(scan(texts, "word").unionByName(scan(readings, "reading")))
    pure = found.where("tbl IS NULL").select("kind", "skeleton", F.col("word").alias("original"), "n", F.lit(True).alias("fine"))
    other = found.where("tbl IS NOT NULL").select("kind", F.inline("originals")).groupBy("kind", "skeleton", "original").agg(F.count("*").alias("n")).withColumn("fine", F.lit(False))
    spelt = pure.unionByName(other).groupBy("kind", "skeleton", "original").agg(F.sum("n").alias("n"), F.max("fine").alias("fine"))
    best = F.when(F.col("fine"), F.struct("n", "original"))
    return spelt.groupBy("kind", "skeleton").agg(F.count("*").alias("originals"), F.sum("n").alias("members"), F.max(best).getField("original").alias("house")).where("originals > 1")
