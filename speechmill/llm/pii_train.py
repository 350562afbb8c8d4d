"""Training of the span model on invented sentences.

``python -m speechmill.llm.pii_train`` writes pii_model.json. People, places and numbers are made up here from random syllables, and the
sentences from frames of everyday notes, so that the weights learn shapes and surroundings, not words. No frame is taken from a collection
the model is used on; those of ``HELD`` are never trained on and measure how it does on sentences of another make.
"""

from __future__ import annotations

import json
import math
import random
import re
from collections import defaultdict

from .pii import KINDS, MODEL, candidates, decode

#: Sentences to train on; all labelled rows come from the generator below.
SENTENCES = 12_000
PASSES = 4

#: Frames: {name} and the like are labelled spans, {t} is a topic, {p} a place, {d4} so many digits. A bar separates what is chosen from.
TRAIN = {
    "name": [
        "{l}：{name}", "{l}:{name}", "{l}　{name}", "　{l}：{name}", "{l}「{name}」", "{l}は{name}です", "{l}は{name}でした", "{l}：{name}（六十代）", "{l}は{name}と見える", "{l}／{name}／{t}", "{l}　{name}　他二名", "{l}　{name}　ほか五名", "{l} {name} ほか", "{l}の{name}さんが来所", "{l}の{name}氏より連絡", "氏名：{name}", "氏名　{name}", "お名前は{name}でした", "姓名「{name}」", "署名は{name}と読める", "名前が{name}と似ている", "宛名は{name}様", "氏名は{name}に変わった",
        "先日、{name}さんが来所されました", "隣の{name}さん宅で会合を開いた", "昨夜、{name}様から苦情がありました", "窓口で{name}殿へ書類を渡した", "そこで{name}氏に確認済み", "また、{name}くんの通う学校", "私と{name}さんとで{t}を調べた", "前に勤めた{name}さんは不在でした", "{name}様", "{name}さん、お元気ですか", "{name}先生の診察を受けた", "元教師の{name}さんへ通知した", "一緒に住む{name}ちゃんの世話", "{t}に詳しい{name}氏と面談した", "病院で会った{name}さんより寄附", "{name}殿の長男", "それは{name}君の自転車だ", "{name}／{address}／{phone}", "{name}（{phone}）", "{name}　{phone}", "会場で{name}と名乗った人", "母の{name}と申します", "駅で{name}に会う約束", "明日{name}に頼む", "指名された{name}です", "推薦した{name}に決まる", "名簿に{name}と書いた",
        "Yours, {name}", "From: {name}", "Mr {name} called twice about the drains", "Dr. {name} wrote that it was late", "a letter from {name} about the drains", "according to {name}, who lives nearby", "({name}, pensioner)", "{name}, aged 54, said so", "thanks to {name}. The rest is known", "submitted by {name} in May", "Miss {name} lives there", "Dear {name},", "a neighbour, {name}, came along", "{name} complained again.", "Mrs {name}, a widow", "Prof. {name} and the drains", "The form named {name}. It was late",
    ],
    "phone": ["電話番号：{phone}", "電話 {phone}", "TEL {phone}", "携帯電話は{phone}", "{phone}まで電話を", "直通{phone}（{t}係）", "夜間は{phone}が通じます", "FAX：{phone}", "{name}、{phone}", "お問い合わせ　{phone}", "Mobile {phone}", "Phone: {phone}", "Call {phone} after six", "my number is {phone}, thanks", "{t}の係（{phone}）", "朝は{phone}に架電"],
    "id_number": ["{w}：{id_number}", "{w}は{id_number}", "{w}「{id_number}」を控えた", "{w} {id_number}", "　{w}　{id_number}", "{w}（{id_number}）が届く", "{w}が{id_number}でした"],
    "address": ["住所：{address}", "住所　{address}", "現住所は{address}", "{address}", "　{address}", "自宅（{address}）へ伺う", "{address}へ引っ越した", "配達先「{address}」", "実家は{address}にある", "本籍{address}", "{name}、{address}", "事故は{address}の前で起きた"],
    "email": ["アドレス：{email}", "{email}", "アドレスは{email}でした", "{email}へ返信を", "連絡は {email} に", "Email {email} please", "send it to {email} today", "（{email}）", "{name} <{email}>", "「{email}」が宛先"],
    "none": [
        "伝票番号{d4}-{d4}-{d4}を控えた", "注文{d4}-{d6}の{t}", "請求額は{d10}円でした", "在庫は{d11}件ある", "期日は20{d2}-0{d1}-1{d1}まで", "型番{d4} {d4} {d4}", "https://pages.example/{d8}", "一個@{d2}0円で買う", "{p}へ旅行した", "皆さんにお伝えください", "お客さまの{t}", "各位殿", "患者さんの{t}が増えた", "校長先生の{t}", "業者さんが来た", "お子さんの{t}", "奥様と旦那様", "神様に祈る", "同様に{t}を急いだ", "多様な{t}がある", "仕様を変えた", "この模様では{t}も遅れる", "彼氏と別れた", "責任者の処分を求める", "利用者は増加している", "対象者が減少した", "加入者の要件", "受取人の変更手続", "氏名：記載なし", "氏名は不明でした", "お名前は結構です", "署名　別紙", "担当：総務課", "代表：別途選任", "担当の変更", "代表は不在", "本人：欠席", "規程　附則", "第一　総則", "議題　予算", "報告書　概要", "要望　道路", "あした　また", "これまで　ずっと", "セミナー・イベント", "システム・サービス", "データ　センター",
        "The Minister of Works", "Harbour Bridge is closed", "the Tide Barrier Act", "Given Heavy Rain, we wait", "Monday Morning was cold", "In Northern Districts the roads", "A Public Meeting was held", "the Chairman asked again", "Water Supply and Road Works", "by the Works Office", "from the Housing Board", "Dear Sir or Madam", "Mr Chairman, we agree",
        "道が広くなったと感じる", "値段は三倍になったという", "利用者の減少という事情", "店が閉まるとある人が言う", "先に行くと言った", "担当者の話では遅れると思う", "売り手は増えたと見る", "話し手の都合", "持ち主の了解", "一人の{t}", "大人の{t}", "老人は多い", "主な{t}", "主に{t}", "株主の意見", "前者の{t}", "後者は{t}", "業者に任せる", "有識者の会", "若者は{t}", "第三者の立場", "参加者へ知らせる", "多くの人は{t}を使う", "代表的な{t}", "担当部署の返事", "役の見直し", "関係者へ広く知らせた", "参加者が集まらないことも",
        "責任者は{t}の変更を求めた", "世帯主は{t}の減免を受ける", "参加者は{t}を知らない", "後継者は{t}へ移った", "管理人は{t}が嫌いだ", "この頃の{b}が増えた", "{b}は遅れる", "町の{b}を直す", "{b}、{b}と続く", "前の{b}には", "{t}への{b}が無い",
        "窓口に聞く", "会社に頼む", "専門家に相談", "先方に尋ねる", "{t}に聞いた話", "{t}に会わせる", "推薦された企業", "任命した理由", "指名した{t}の件", "{t}と書いた", "紹介された{t}を見る",
        "二丁目の{t}", "{p}と{p}の境", "残りは三十名ほかに移る", "{t}ほか四件", "{t}／{t}", "{t}と言う人もいる", "結果は{t}とある", "この{t}から始める", "午前{d1}-{d1}時", "{p}{d1}月の{t}", "予算{d4}-{d4}-{d4}の枠", "人口{d9}人", "整理{d4} {d6}", "会議室{d2}-{d1}",
    ],
}
HELD = {
    "name": ["受付簿に{name}さんと書いた", "発注者：{name}", "同封者は{name}です", "貸主の{name}様に払う", "{name}くんの弟", "仲間の{name}氏が笑う", "借主　{name}　ほか一名", "翌朝には{name}さんの姿があった", "{name}殿（留守）", "記名は「{name}」", "氏名／{name}", "バス停で{name}様に会う", "係の{name}さんを呼ぶ", "「{name}と申します」", "後で{name}に尋ねる", "任命された{name}です", "Sincerely, {name}", "Ms {name} paid the fee", "an appeal by {name}, widow", "reply to {name} at once", "{name}, our tenant, left"],
    "phone": ["ＴＥＬ　{phone}", "至急{phone}へかける", "（携帯 {phone}）", "ring me on {phone}", "Tel: {phone}", "電話は{phone}だけ"],
    "id_number": ["手続には{w}（{id_number}）が要る", "{w}＝{id_number}", "{w}、{id_number}"],
    "address": ["転居先：{address}", "昔は{address}に居た", "所在地　{address}", "（{address}）"],
    "email": ["mail: {email}", "宛先{email}", "{email} が使えない", "write {email} or call"],
    "none": ["請求書{d4}-{d4}-{d4}", "残高は{d10}円", "店員さんに聞く", "この様に{t}を", "有様を見る", "貴殿の{t}", "提出者の義務", "氏名は非公開", "目次　序文", "クラブ・チーム", "The Northern Line stopped", "Ferry Terminal and Car Park", "the Mayor said", "人数{d9}人", "三丁目付近", "{t}ほか二点", "契約者は多数", "作業{d4} {d6}"],
}
_LABELS = ["記入者", "届出人", "相談者", "通報者", "受取人", "世帯主", "保護者", "契約者", "依頼人", "発信者", "本人", "担当", "受付担当", "連絡係", "被害者", "加入者", "投稿者", "家主", "店主", "代表", "会の代表", "世話役", "当選者"]

_KANJI = "山川田中村木林森石原野島岸橋沢谷崎浜池坂松竹梅桜杉菊藤花鳥鹿熊鷹鶴亀虎龍星月雪雨風雲霧霞光陽夏秋冬春東西南北上下大小長高広深清水泉湖"
_GIVEN = "一二太郎子美恵介助夫雄人也之志生樹斗香奈穂代江乃世道真正義信和明智勇健康忠久"
_KANA = ["あ", "い", "う", "か", "き", "く", "こ", "さ", "し", "す", "せ", "た", "つ", "と", "な", "に", "ね", "の", "は", "ひ", "ふ", "ほ", "ま", "み", "む", "も", "や", "ゆ", "よ", "ら", "り", "る", "ろ", "わ", "が", "じ", "だ", "ば", "しょう", "りゅう", "ぎ"]
_ROMAN = ["ka", "ki", "ku", "sa", "shi", "su", "ta", "chi", "to", "na", "ni", "no", "ha", "hi", "ma", "mi", "mu", "ya", "yu", "yo", "ri", "ru", "ga", "ji", "da"]
_TOPIC = ["道路予算", "年金制度", "農地政策", "医療費", "教育計画", "港湾整備", "防災計画", "通信基盤", "福祉サービス", "住宅支援", "エネルギー料金", "データ管理"]
_WIDE = str.maketrans("0123456789-", "０１２３４５６７８９－")


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def width(self, text: str) -> str:
        return text.translate(_WIDE) if self.r.random() < 0.35 else text

    def broken(self) -> str:
        """A word with a stray blank inside."""
        word = self.r.choice(_TOPIC)
        at = self.r.randrange(1, min(4, len(word)))
        return word[:at] + self.r.choice("　 ") + word[at : at + self.r.randint(1, 3)]

    def name(self, latin: bool = False) -> str:
        r = self.r
        gap = r.choice(["", "", "　", " "])
        kind = 0.9 if latin else r.random()
        if kind < 0.55:
            family = "".join(r.choice(_KANJI) for _ in range(r.choice([1, 2, 2, 2])))
            family = family[0] + "ヶ" + r.choice(_KANJI) if r.random() < 0.3 else family
            if r.random() < 0.3 and len(family) > 1:
                return family
            return family + gap + "".join(r.choice(_GIVEN + _KANJI) for _ in range(r.choice([1, 2, 2, 2, 3])))
        if kind < 0.82:
            a, b = ("".join(r.choice(_KANA) for _ in range(r.randint(2, 5))) for _ in range(2))
            if r.random() < 0.5:
                a, b = ("".join(chr(ord(c) + 0x60) for c in x) for x in (a, b))
                gap = r.choice([gap, "・"])
            return a + gap + b
        a, b = ("".join(r.choice(_ROMAN) for _ in range(r.randint(2, 4))).capitalize() for _ in range(2))
        return a + " " + (b.upper() if r.random() < 0.3 else b)

    def phone(self) -> str:
        r = self.r
        area = r.choice(["03", "06", "011", "045", "0742", "0985", "090", "080", "070", "050"])
        rest = self.digits(4) if len(area) > 2 and area[1:2] in "5789" and len(area) == 3 else self.digits(6 - len(area)) if len(area) > 2 else self.digits(4)
        last = self.digits(4)
        form = r.random()
        if form < 0.5:
            out = r.choice(["-", "-", " ", ".", "‐", "－", "ー"]).join([area, rest, last])
            if "-" in out and r.random() < 0.15:
                return out.translate(str.maketrans("0123456789-", "〇一二三四五六七八九－"))
        elif form < 0.65:
            out = area + rest + last
        elif form < 0.75:
            out = f"({area}){rest}-{last}"
        elif form < 0.85:
            return self.width(f"{area}（{rest}）{last}")
        else:
            out = r.choice(["-", " "]).join(["+81", area[1:], rest, last])
            return out
        return self.width(out)

    def number(self) -> tuple[str, str]:
        r = self.r
        if r.random() < 0.4:
            return r.choice(["基礎年金番号", "年金手帳の番号"]), self.width(r.choice(["-", "", " ", "－"]).join([self.digits(4), self.digits(6)]))
        if r.random() < 0.4:
            return r.choice(["免許証番号", "運転免許の番号"]), self.width(self.digits(12))
        return r.choice(["個人番号", "マイナンバー", "番号カードの番号", "個人識別の番号"]), self.width(r.choice(["-", " ", "", "－"]).join(self.digits(4) for _ in range(3)))

    def place(self) -> str:
        r = self.r
        pref = "".join(r.choice(_KANJI) for _ in range(2)) + r.choice("県県府都")
        return r.choice([pref, pref, ""]) + "".join(r.choice(_KANJI) for _ in range(r.choice([1, 2, 2]))) + r.choice("市市町村区")

    def address(self) -> str:
        r = self.r
        post = r.choice(["", "", "〒" + self.width(self.digits(3) + "-" + self.digits(4)) + r.choice(["", " ", "　"])])
        town = "".join(r.choice(_KANJI) for _ in range(2)) + r.choice(["", "", "町", "通", "ヶ丘"]) + ("字" + r.choice(_KANJI) + r.choice(_KANJI) if r.random() < 0.15 else "")
        a, b, c = (str(r.randint(1, 40)) for _ in range(3))
        kanji = ["一", "三", "七", "十二", "二十一", "三十四"]
        block = r.choice([f"{a}-{b}-{c}", f"{a}丁目{b}番{c}号", f"{a}番地", f"{a}番地の{c}", f"{r.choice(kanji)}丁目{r.choice(kanji)}番地{r.choice(kanji)}", f"{a}-{b}"])
        room = r.choice(["", "", r.choice(["", "　"]) + r.choice(["コーポ", "ハイツ", "メゾン", "第二", "グリーンテラス"]) + r.choice(_KANJI) + r.choice(["", "荘"]) + self.width(self.digits(3)) + r.choice(["", "号室"])])
        return post + self.place() + town + self.width(block) + room

    def email(self) -> str:
        r = self.r
        roman = lambda n: "".join(r.choice(_ROMAN) for _ in range(n))
        local = r.choice([roman(3) + str(r.randint(1, 99)), roman(2) + "." + roman(3), roman(1) + "_" + roman(3), roman(4), roman(2).upper() + "." + roman(3).capitalize(), roman(3) + "-" + roman(2), roman(3) + "+info"])
        host = r.choice([roman(3), roman(2) + "-" + roman(2), "mail." + roman(3)]) + "." + r.choice(["example", "test", "invalid", "jp", "co.jp", "org"])
        at = r.choice(["@", "@", "@", "＠", "(at)", "[at]", "（アット）", " at "])
        if r.random() < 0.12:
            host = host.replace(".", "[dot]")
        out = local + at + host
        return "".join(chr(ord(c) + 0xFEE0) if 0x21 <= ord(c) <= 0x7E else c for c in out) if at == "@" and r.random() < 0.1 else out

    def sentence(self, frames: dict[str, list[str]]) -> tuple[str, list[tuple[int, int, str]]]:
        """A sentence and its labelled spans; some hold only things that resemble them."""
        r = self.r
        sort = r.choices(["name", "phone", "id_number", "address", "email", "none"], [34, 12, 10, 11, 8, 25])[0]
        frame = r.choice(frames[sort])
        word, value = self.number()
        latin = frame[0].isascii() and frame.isascii() and " " in frame.strip()
        made = {"b": self.broken, "name": lambda: self.name(latin and r.random() < 0.9), "l": lambda: r.choice(_LABELS), "t": lambda: r.choice(_TOPIC), "p": self.place, "w": lambda: word, "id_number": lambda: value}
        text = "" if frame[0].isascii() or r.random() < 0.6 else r.choice(["　", f"{r.choice(_TOPIC)}のこと、", "念のため、", "なるほど、"])
        spans = []
        for i, part in enumerate(re.split(r"\{(\w+)\}", frame)):
            if i % 2 == 0:
                text += part
            elif part in KINDS:
                said = (made.get(part) or getattr(self, part))()
                spans.append((len(text), len(text) + len(said), part))
                text += said
            else:
                text += made[part]() if part in made else self.width(self.digits(int(part[1:])))
        return text, spans


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def expectations(found: list, weights: dict[str, float]) -> list[float]:
    """The probability of every candidate over all sets of spans that do not overlap (forward and backward over their ends)."""
    scores = [sum(weights.get(x, 0.0) for x in f) for _, _, _, f in found]
    points = sorted({0} | {s for s, *_ in found} | {e for _, e, *_ in found})
    place = {p: i for i, p in enumerate(points)}
    into, out = defaultdict(list), defaultdict(list)
    for i, (s, e, _, _) in enumerate(found):
        into[place[e]].append((place[s], scores[i]))
        out[place[s]].append((place[e], scores[i]))
    n = len(points)
    forward, backward = [0.0] * n, [0.0] * n
    for k in range(1, n):
        forward[k] = forward[k - 1]
        for s, score in into[k]:
            forward[k] = _log_add(forward[k], forward[s] + score)
    for k in range(n - 2, -1, -1):
        backward[k] = backward[k + 1]
        for e, score in out[k]:
            backward[k] = _log_add(backward[k], backward[e] + score)
    return [math.exp(forward[place[s]] + scores[i] + backward[place[e]] - forward[-1]) for i, (s, e, _, _) in enumerate(found)]


def train(seed: int = 11, sentences: int = SENTENCES, passes: int = PASSES) -> dict[str, float]:
    """Weights by stochastic gradient ascent (AdaGrad) on the conditional likelihood of the labelled spans."""
    maker = Maker(seed)
    data = []
    for _ in range(sentences):
        text, spans = maker.sentence(TRAIN)
        found = candidates(text)
        if found:
            data.append((found, set(spans)))
    weights: dict[str, float] = defaultdict(float)
    squares: dict[str, float] = defaultdict(lambda: 1e-6)
    for turn in range(passes):
        random.Random(seed + turn).shuffle(data)
        for found, spans in data:
            step: dict[str, float] = defaultdict(float)
            for (s, e, kind, features), p in zip(found, expectations(found, weights)):
                gap = ((s, e, kind) in spans) - p
                if abs(gap) > 1e-4:
                    for x in features:
                        step[x] += gap
            for x, g in step.items():
                g -= 2e-4 * weights[x]
                squares[x] += g * g
                weights[x] += 0.4 * g / math.sqrt(squares[x])
    return {k: round(v, 3) for k, v in sorted(weights.items()) if abs(v) >= 0.05}


def accuracy(weights: dict[str, float], seed: int = 99, sentences: int = 1_500, frames: dict[str, list[str]] = HELD) -> dict[str, tuple[float, float]]:
    """Precision and recall of each kind on sentences of frames not trained on."""
    maker, right, said, true = Maker(seed), defaultdict(int), defaultdict(int), defaultdict(int)
    for _ in range(sentences):
        text, spans = maker.sentence(frames)
        got = decode(candidates(text), weights)
        for x in got:
            said[x[2]] += 1
            right[x[2]] += x in spans
        for x in spans:
            true[x[2]] += 1
    return {k: (right[k] / max(1, said[k]), right[k] / max(1, true[k])) for k in true}


if __name__ == "__main__":
    trained = train()
    MODEL.write_text(json.dumps(trained, ensure_ascii=False, indent=0))
    print(len(trained), "trained on:", accuracy(trained, frames=TRAIN), "held out:", accuracy(trained))
