"""Personal information in free text: a semi-Markov conditional random field over whole candidate spans.

Anchors (signs, cues, honorifics, groups of digits) lead to stretches of text that may hold personal information. In each, candidate spans
of bounded length are proposed for five types; features look at the whole span and at both sides of it; the best set of spans that do not
overlap is found by dynamic programming over the ends of the spans, so boundaries and types are chosen together.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches, spread

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDERS = {"email": "［メール］", "phone": "［電話番号］", "id_number": "［番号］", "address": "［住所］", "name": "［氏名］"}
#: The longest span of each kind that is considered: the method bounds the length of an entity. 320 is what mail allows an address; names and
#: numbers are far shorter, a street address with town, block, building and room takes some fifty signs.
LONGEST = {"email": 320, "phone": 40, "id_number": 40, "address": 120, "name": 40}
MODEL = Path(__file__).with_name("pii_model.json")

# Words of the language at large, not of any collection, that stand beside personal information of a kind, or beside what only resembles it.
CUES = {
    "phone": ["電話", "ＴＥＬ", "TEL", "Tel", "tel", "携帯", "ケータイ", "ＦＡＸ", "FAX", "Fax", "ファクス", "ファックス", "phone", "Phone", "mobile", "Mobile", "call", "ring", "連絡先", "内線", "直通", "折り返し"],
    "id_number": ["個人番号", "マイナンバー", "番号カード", "年金番号", "年金手帳", "免許", "識別", "手帳", "カード", "旅券", "パスポート", "保険証", "被保険者"],
    "other": ["文書", "受付", "整理", "議案", "伝票", "請求", "注文", "型番", "口座", "総額", "金額", "単価", "予算", "面積", "人口", "施行", "期日", "日付", "第", "doc", "http", "No."],
    "address": ["住所", "所在地", "居所", "現地", "本籍", "送付先", "転居先", "配達先", "自宅", "実家"],
}
HONORIFICS = ["さん", "さま", "様", "氏", "殿", "君", "くん", "ちゃん", "先生"]
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Prof"]
NOT_NAMES = ["皆", "各位", "委員", "大臣", "議員", "知事", "会長", "部長", "課長", "校長", "社長", "市長", "町長", "村長", "住民", "参考人", "政府", "客", "同", "多", "仕", "模", "有", "両", "事務局", "審議会", "検討会", "自治体", "理事", "奥", "患者", "業者", "店員", "職員", "農家", "神", "王", "父", "母", "兄", "姉", "子", "貴", "医者", "利用者", "担当者", "関係者", "先方", "会社", "市民", "選手", "記者", "教授", "担任", "旦那", "彼", "某", "者", "人", "方々", "老人", "大人", "一人", "二人", "本人", "夫人", "主人", "他人", "個人", "法人", "役人", "病人", "詩人"]
_NAME_NOUN = "氏名|名前|姓名|署名|名義|宛名|Name"
#: The end of a word for a person or their part in something: 届出人, 世帯主, 世話役.
_PERSON_NOUN = "[人者主係役]|代表|担当|[Ss]igned|From|Contact"

_D = "0-9０-９"
_K = "〇一二三四五六七八九十百"
_H = "\\-－‐ー−–—"

_ALNUM = "A-Za-z0-9Ａ-Ｚａ-ｚ０-９"
_AT = "(?:[@＠]|\\s?[(\\[（［<＜]\\s*(?:at|AT|ａｔ|アット(?:マーク)?)\\s*[)\\]）］>＞]\\s?|\\s+at\\s+)"
_DOT = "(?:[.．]|\\s?[(\\[（［]\\s*(?:dot|DOT|ｄｏｔ|ドット)\\s*[)\\]）］]\\s?|\\s+dot\\s+)"
_LABEL_OF_HOST = f"[{_ALNUM}](?:[{_ALNUM}\\-－]*[{_ALNUM}])?"
_EMAIL = re.compile(f"[{_ALNUM}](?:[{_ALNUM}_+\\-＿＋－]|{_DOT}(?=[{_ALNUM}]))*{_AT}{_LABEL_OF_HOST}(?:{_DOT}{_LABEL_OF_HOST})+")

_SEP = f"[{_H} 　.．・]"
_NUMBER = [
    re.compile(f"[+＋][{_D}]{{1,3}}{_SEP}?[(（]?[{_D}]{{1,4}}[)）]?{_SEP}?[{_D}]{{1,4}}{_SEP}?[{_D}]{{3,4}}(?![{_D}])"),
    re.compile(f"(?<![{_D}{_H}])[(（][{_D}〇]{{2,5}}[)）]{_SEP}?[{_D}]{{1,4}}{_SEP}?[{_D}]{{3,4}}(?![{_D}])"),
    re.compile(f"(?<![{_D}])[{_D}]{{2,5}}[(（][{_D}]{{1,4}}[)）][{_D}]{{3,4}}(?![{_D}])"),
    re.compile(f"(?<![{_D}+＋])[{_D}]{{2,6}}(?:{_SEP}[{_D}]{{1,6}}){{1,3}}(?![{_D}])"),
    re.compile(f"(?<![{_D}+＋])[{_D}]{{9,13}}(?![{_D}])"),
    re.compile(f"(?<![{_K}])〇[〇一二三四五六七八九]{{1,4}}{_SEP}?[〇一二三四五六七八九]{{1,4}}{_SEP}?[〇一二三四五六七八九]{{3,4}}(?![{_K}])"),
]

_N = f"(?:[{_D}]{{1,5}}|[{_K}]{{1,5}})"
_BLOCK = re.compile(f"{_N}丁目{_N}(?:番地?(?:の?{_N}号?)?|(?:[{_H}]{_N})+)?|{_N}番地?(?:の?{_N}号?)?(?![{_D}])|[{_D}]{{1,4}}(?:[{_H}][{_D}]{{1,4}}){{1,3}}|{_N}丁目")
_FRONT = re.compile(f"(〒[{_D}]{{3}}[{_H}]?[{_D}]{{4}}[ 　]?)?([一-鿿ヶ]{{1,3}}[都道府県])?([一-鿿ヶケ]{{1,5}}?[市区町村](?:[一-鿿]{{1,3}}区)?)([一-鿿々ヶケァ-ヴーぁ-ん]{{1,9}})\\Z")
_ROOM = re.compile(f"[ 　]?(?:第[{_K}{_D}]+)?[一-鿿ァ-ヴーＡ-ＺA-Z]{{1,12}}[ 　]?[{_D}]{{2,4}}(?:号室?)?")

_NAME_SIGN = "一-鿿々ヶぁ-ゖァ-ヺー"
_CHOSEN = "(?:紹介|推薦|指名|任命)(?:を受け|され|し)"
_SIGNS = "：:「『（(／/】〕＝="
_LABEL = re.compile(f"(?P<name>{_NAME_NOUN})(?:(?P<a>[はがをの])|[ 　]*(?P<b>[{_SIGNS}])[ 　]*|(?P<c>[ 　]))?|(?:{_PERSON_NOUN})(?:(?P<d>は)|[ 　]*(?P<e>[{_SIGNS}])[ 　]*|(?P<f>[ 　]))|{_CHOSEN}(?P<g>た)")
_TITLE = re.compile(f"\\b(?:{'|'.join(TITLES)})\\.? ")
_AFTER = re.compile("|".join([*HONORIFICS, "ほか", "[ 　]ほか", "[ 　]?他(?=[一二三四五六七八九十数0-9０-９])", "／", "と(?:申[しす]|名乗|称[しす]|いいます|記[しす]|書[いきく]|署名)", "に(?:聞[いきく]|会[いうっ]|頼[まみむん]|尋ね|相談)"]))
_WEAK_AFTER = re.compile("で(?:す|し|あ)|と(?=[一-鿿いあ])|から|より|まで|へ|は|が|も|に|を|の|宛")
_SHAPED = re.compile(
    "(?<![一-鿿々ヶ])[一-鿿々ヶ]{1,3}[ 　][一-鿿々ヶ]{1,3}(?![一-鿿々ヶ])|(?<![ぁ-ゖ])[ぁ-ゖ]{2,8}[ 　][ぁ-ゖ]{2,8}(?![ぁ-ゖ])"
    "|(?<![ァ-ヺー])[ァ-ヺー]{2,9}[・ 　][ァ-ヺー]{2,9}(?![ァ-ヺー])|\\b[A-Z][a-z]+(?: [A-Z]\\.?)? [A-Z](?:[a-z]+|[A-Z]+)\\b"
)
_NAME_CHAR = re.compile(f"[{_NAME_SIGN}A-Za-z・ 　]")
_ROMAJI = re.compile("(?:(?:[kgsztdnhbpmrjfw]|[kgnhbpmr]y|sh|ch|ts)?[aeiou]|n(?![aeiouy]))+", re.I)

# Anchors: at least one stands in every candidate or beside it, so where none stands, there is no candidate.
_TRIGGER = re.compile("|".join([
    f"[@＠〒]|{_AT}{_LABEL_OF_HOST}{_DOT}", f"[{_D}〇+＋(（][{_D}〇一二三四五六七八九{_H} 　.．・()（）]{{7,}}", f"丁目|[{_D}{_K}]番|[{_D}][{_H}][{_D}]",
    _AFTER.pattern, f"(?:{_PERSON_NOUN})[は {_SIGNS}　]|{_NAME_NOUN}|{_CHOSEN}た", _TITLE.pattern, "(?<=[一-鿿々ヶぁ-ゖァ-ヺー])[ 　・](?=[一-鿿々ヶぁ-ゖァ-ヺー])|(?<=[A-Za-z.]) (?=[A-Z])",
]))


def _script(c: str) -> str:
    if not c:
        return "edge"
    if "一" <= c <= "鿿" or c in "々ヶ〇":
        return "kanji"
    if "ぁ" <= c <= "ゖ":
        return "hira"
    if "ァ" <= c <= "ヺ" or c == "ー":
        return "kata"
    if c.isdigit():
        return "digit"
    if c.isalpha():
        return "latin"
    return "blank" if c.isspace() else "sign"


def _cue(text: str, at: int, words: list[str], reach: int) -> str | None:
    """The last of the words in the ``reach`` characters before a place."""
    before = text[max(0, at - reach) : at]
    found = max(((before.rfind(w) + len(w), len(w), w) for w in words if w in before), default=None)
    return found[2] if found else None


def _number_candidates(text: str) -> Iterator[tuple[int, int, str, list[str]]]:
    seen = set()
    for k, pattern in enumerate(_NUMBER):
        for m in pattern.finditer(text):
            if m.span() in seen:
                continue
            seen.add(m.span())
            raw = unicodedata.normalize("NFKC", m.group())
            digits = re.sub("[^0-9〇一-九]", "", raw.translate(str.maketrans("〇一二三四五六七八九", "0123456789")))
            n = len(digits)
            if not 9 <= n <= 13:
                continue
            groups = "-".join(str(len(g)) for g in re.findall("[0-9〇一二三四五六七八九]+", raw))
            cues = {kind: _cue(text, m.start(), CUES[kind], 12) for kind in ("phone", "id_number", "other")}
            before = text[max(0, m.start() - 12) : m.start()]
            nearest = max(cues, key=lambda c: (before.rfind(cues[c]) + len(cues[c])) if cues[c] else -1) if any(cues.values()) else "none"
            after = text[m.end() : m.end() + 2]
            shape = "plus" if raw[0] == "+" else "bracket" if k in (1, 2) else "kanji" if k == 5 else "plain"
            common = [f"cue:{nearest}", f"digits:{n}", f"shape:{shape}", f"groups:{groups if groups in ('4-4-4', '4-6', '12', '10', '11', '3-4-4', '2-4-4', '4-2-4', '3-3-4') else 'other'}", f"zero:{digits[0] == '0'}", f"after:{'unit' if after[:1] in ('円', '億', '万', '人', '件', '票', '戸', '号') else 'other'}", f"call:{bool(re.search('折り返|かけ|架電|電話|call|ring', text[m.end() : m.end() + 10]))}", f"inside:{_script(text[m.start() - 1 : m.start()]) in ('digit', 'latin')}", "end:digit" if text[m.end() : m.end() + 1].isalnum() and text[m.end()].isascii() else "end:free"]
            for kind in ("phone", "id_number"):
                yield m.start(), m.end(), kind, common


def _email_candidates(text: str) -> Iterator[tuple[int, int, str, list[str]]]:
    for m in _EMAIL.finditer(text):
        span = unicodedata.normalize("NFKC", m.group())
        sign = "sign" if "@" in span else "spaced" if re.search("\\sat\\s", span) else "word"
        labels = len(re.split(_DOT, span))
        yield m.start(), m.end(), "email", [f"at:{sign}", f"labels:{min(labels, 4)}", f"marked:{bool(re.search('[0-9_+.-]', re.split('@| ?[(]', span)[0]))}", f"left:{_script(text[m.start() - 1 : m.start()])}"]


def _address_candidates(text: str) -> Iterator[tuple[int, int, str, list[str]]]:
    for block in _BLOCK.finditer(text):
        b = block.start()
        fronts = []
        for s in range(max(0, b - 48), b):
            c = text[s]
            if c == "〒" or "一" <= c <= "鿿":
                front = _FRONT.match(text, s, b)
                if front:
                    fronts.append((s, front))
        if not fronts:
            continue
        first = fronts[0][0]
        kind = "chome" if "丁目" in block.group() else "banchi" if "番" in block.group() else "dashes"
        complete = kind != "chome" or not block.group().endswith("丁目")
        room = _ROOM.match(text, block.end())
        ends = [(block.end(), "none" if not room else "left")] + ([(room.end(), "taken")] if room else [])
        for s, front in fronts:
            cue = _cue(text, s, CUES["address"], 8)
            for e, rooms in ends:
                if e - s > LONGEST["address"]:
                    continue
                yield s, e, "address", [f"post:{bool(front[1])}", f"pref:{bool(front[2])}", f"block:{kind}", f"complete:{complete}", f"room:{rooms}", f"first:{s == first}", f"left:{_script(text[s - 1 : s])}", f"cue:{bool(cue)}", f"town:{min(len(front[4]), 6)}", f"end:{_script(text[e : e + 1]) in ('digit',)}"]


_PARTICLES = "はがのをにともでへや"


def _left(text: str, s: int, labels: dict[int, str]) -> str:
    """What stands before a name, as a sort."""
    if s in labels:
        return labels[s]
    if s == 0:
        return "start"
    c = text[s - 1]
    if _script(text[s]) == "latin":
        word = re.search("([A-Za-z]+)[ .]*\\Z", text[max(0, s - 16) : s])
        if not word:
            return "sign"
        w = word[1]
        return "title" if w in TITLES else "article" if w.lower() in ("the", "a", "an", "this", "that", "its", "our") else "preposition" if w in ("by", "from", "to", "with", "named", "dear", "Dear", "and", "for") else "lower" if w.islower() else "capital"
    if c in "、，,。":
        return "comma"
    if c in "「『（([【〔〈<":
        return "open"
    if c in "：:／/】〕・＝":
        return "sign"
    if c.isspace():
        return "line" if not text[:s].strip() else "blank"
    kind = _script(c)
    if kind == "hira":
        if c in _PARTICLES and _script(text[s - 2 : s - 1]) in ("kanji", "kata", "latin", "digit"):
            return "particle"
        return "hira" if _script(text[s]) != "hira" else "ending" if c in "ただるいで" and re.search("[一-鿿][^はがのをにともへや一-鿿][ぁ-ゖ]{0,3}\\Z", text[max(0, s - 5) : s]) else "cut"
    return "cut" if kind == _script(text[s]) else kind


def _right(text: str, e: int, rights: dict[int, str]) -> str:
    """What stands behind a name, as a sort."""
    if e == len(text):
        return "end"
    after = rights.get(e)
    if after:
        return "honorific" if after in HONORIFICS else "quote" if after[0] == "と" else "asked" if after[0] == "に" else "bar" if after == "／" else "others"
    c = text[e]
    if c in "、，,":
        return "comma"
    if c in "」』）)]】〕〉>。.":
        return "close"
    if c.isspace():
        following = text[e + 1 : e + 2]
        return "blanklower" if following.islower() else "blank"
    weak = _WEAK_AFTER.match(text, e)
    if weak and (_script(text[e - 1]) != "hira" or len(weak[0]) > 1 or weak[0] == "と"):
        return "copula" if weak[0][0] == "で" else "saying" if weak[0] == "と" else "particle"
    return "cut" if _script(c) == _script(text[e - 1]) else _script(c)


def _name_candidates(text: str) -> Iterator[tuple[int, int, str, list[str]]]:
    """Spans that end before an honorific or its like, begin behind a label or title, or have the shape of two names."""
    spans: set[tuple[int, int]] = set()
    rights = {m.start(): m[0].strip() for m in _AFTER.finditer(text)}
    labels = {m.end(): f"{'name' if m['name'] else 'person'}{m['a'] or m['d'] or m['g'] or ('sign' if m['b'] or m['e'] else 'blank' if m['c'] or m['f'] else '')}" for m in _LABEL.finditer(text)}
    labels |= {m.end(): "title" for m in _TITLE.finditer(text)}

    def edge(s: int) -> bool:
        """Whether a name may begin here: the script changes, or in hiragana a particle of the word before or an ending stands before."""
        return s == 0 or s in labels or _script(text[s - 1]) != _script(text[s]) or _script(text[s]) == "hira" and _left(text, s, labels) in ("particle", "ending")

    def starts(e: int) -> Iterator[int]:
        for s in range(e - 1, max(-1, e - 31), -1):
            if not _NAME_CHAR.match(text, s):
                return
            if e - s > 1 and edge(s):
                yield s

    def stops(s: int) -> Iterator[int]:
        for e in range(s + 1, min(len(text), s + LONGEST["name"]) + 1):
            if e - s > 1 and (e == len(text) or e in rights or _script(text[e]) != _script(text[e - 1]) or _script(text[e]) == "hira" and _WEAK_AFTER.match(text, e)):
                yield e
            if e == len(text) or not _NAME_CHAR.match(text, e):
                return

    for e in rights:
        spans.update((s, e) for s in starts(e))
    for s in labels:
        if s < len(text) and _NAME_CHAR.match(text, s):
            spans.update((s, e) for e in stops(s))
    shaped = set()
    for m in _SHAPED.finditer(text):
        s, e = m.span()
        if _script(text[s]) == "hira":
            # A particle at its head belongs to the word before, an honorific and what follows it is no part of the name.
            s += text[s] in _PARTICLES and _script(text[s - 1 : s]) in ("kanji", "kata")
            e = min((x for x in rights if s + 4 < x < e), default=e)
        shaped.add((s, e))
    for s, e in spans | shaped:
        span = text[s:e]
        if span[0].isspace() or span[-1].isspace() or span[0] in "・ー":
            continue
        parts = re.split("[ 　・]+", span)
        scripts = {_script(c) for c in span if not c.isspace() and c != "・"}
        one = scripts.pop() if len(scripts) == 1 else "kanjihira" if scripts == {"kanji", "hira"} else "mixed"
        if one == "latin":
            proper = all(re.fullmatch("[A-Z][A-Za-z]*", p) for p in parts)
            one = "latinlower" if not proper else "romaji" if all(_ROMAJI.fullmatch(p) for p in parts) else "latin"
        # Kanji follow kana or the other way in words, hardly within one part of a name.
        mixture = one == "kanjihira" and any(re.search("[ぁ-ゖ][一-鿿]", p) for p in parts)
        sizes = [len(p) for p in parts]
        size = f"{one}:{'+'.join(str(min(n, 6)) for n in sizes[:3])}" if one in ("kanji", "romaji", "latin") or len(parts) > 1 else f"{one}:{min(sizes[0] // 2, 6)}"
        left, right = _left(text, s, labels), _right(text, e, rights)
        office = span in NOT_NAMES or any(len(w) > 1 and w in span for w in NOT_NAMES) or span[-1] == "者" or (one == "kanjihira" and span[0] in "お")
        yield s, e, "name", [
            f"left:{left}", f"right:{right}", f"sides:{left}-{right}", f"shape:{one}", f"size:{size}", f"parts:{one}{min(len(parts), 3)}", f"shape:{one}-{left}", f"shape:{one}-{right}", f"parts:{min(len(parts), 3)}-{left}", f"parts:{min(len(parts), 3)}-{right}",
            f"office:{office}", f"mixture:{mixture}", f"shaped:{(s, e) in shaped}", f"tail:{any(span.endswith(h) for h in HONORIFICS if h != '氏')}", f"particle:{one in ('hira', 'kanjihira', 'mixed') and bool(re.search('[一-鿿ァ-ヺ][はがのをにで]', span))}",
        ]


def candidates(text: str) -> list[tuple[int, int, str, list[str]]]:
    """(start, end, kind, features) of every span that may be personal information."""
    found = [*_email_candidates(text), *_number_candidates(text), *_address_candidates(text), *_name_candidates(text)]
    return [(s, e, k, [f"{k}|{x}" for x in [*features, "any"]]) for s, e, k, features in found if e - s <= LONGEST[k]]


def decode(found: list[tuple[int, int, str, list[str]]], weights: dict[str, float]) -> list[tuple[int, int, str]]:
    """The spans, none overlapping, with the largest sum of scores; a span must score above zero."""
    by_end: dict[int, list[tuple[float, int, str]]] = {}
    for s, e, kind, features in found:
        score = sum(weights.get(x, 0.0) for x in features)
        if score > 0:
            by_end.setdefault(e, []).append((score, s, kind))
    points = sorted({0} | set(by_end) | {s for v in by_end.values() for _, s, _ in v})
    best: dict[int, tuple[float, list]] = {}
    value, chosen = 0.0, None
    for p in points:
        for score, s, kind in by_end.get(p, ()):
            total = best[s][0] + score
            if total > value:
                value, chosen = total, (best[s][1], (s, p, kind))
        best[p] = (value, chosen)
    out = []
    while chosen:
        chosen, span = chosen
        out.append(span)
    return out[::-1]


@cache
def model() -> dict[str, float]:
    return json.loads(MODEL.read_text())


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Sentences or lines that hold an anchor."""
    done = 0
    while m := _TRIGGER.search(text, done):
        a = max(text.rfind("\n", 0, m.start()), text.rfind("。", 0, m.start())) + 1
        ends = [x for x in (text.find("\n", m.start()), text.find("。", m.start())) if x >= 0]
        b = min(ends, default=len(text))
        yield a, b
        done = b + 1


def find(text: str | None, weights: dict[str, float] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the personal information in a text, in order."""
    if not text:
        return []
    weights = model() if weights is None else weights
    out = []
    for a, b in stretches(text):
        out += [(a + s, a + e, k) for s, e, k in decode(candidates(text[a:b]), weights)]
    return out


def redacted(text: str | None, found: list[tuple[int, int, str]]) -> str | None:
    """The text with every span replaced by the placeholder of its kind."""
    for s, e, kind in reversed(found):
        text = text[:s] + PLACEHOLDERS[kind] + text[e:]
    return text


def personal_information(docs: DataFrame, doc_id: str, doc_text: str) -> DataFrame:
    """(doc_id, pii_kind, pii_text, first): what was found where. Null and empty texts hold nothing; repeated rows are each searched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in batches:
            rows = [(doc, k, text[s:e], s) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for s, e, k in find(text)]
            yield {c: [r[i] for r in rows] for i, c in enumerate(("doc_id", "pii_kind", "pii_text", "first"))}

    return map_batches(spread(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).cast("string").alias("text")), "doc_id"), run, "doc_id long, pii_kind string, pii_text string, first int")


def redact(docs: DataFrame, doc_id: str, doc_text: str) -> DataFrame:
    """(doc_id, text, replaced): every text with its personal information replaced; texts without any are unchanged, null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in batches:
            docs_, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = [find(t) for t in texts]
            yield {"doc_id": docs_, "text": [redacted(t, f) for t, f in zip(texts, found)], "replaced": [len(f) for f in found]}

    return map_batches(spread(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).cast("string").alias("text")), "doc_id"), run, "doc_id long, text string, replaced int")
