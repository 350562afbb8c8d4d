"""Speakers matched to politicians without a common key: collective linkage over a candidate graph.

Distinct speakers and politicians are nodes; an edge joins two that share an attribute. Every edge is compared in full, none is pruned
by its weight, and the comparison refined by propagation: how well a spoken group name stands for a group follows from the matches so far,
and the matches from that, until they stay the same.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import HIRAGANA, KATAKANA, same_look
from ..session import materialize
from .arrow import map_batches
from .confusables import reading_form

# Old or variant forms of kanji and the usual one.
VARIANT_KANJI = dict(zip("國龍﨑嵜嶋嶌澤濱濵惠榮櫻豐廣瀧邊邉齋齊斎髙德眞圓鐵澁壽齡學會藏淺黑靜條縣賴寳彌顯樂實處乘兒轉藝應燈爲鷄", "国竜崎崎島島沢浜浜恵栄桜豊広滝辺辺斉斉斉高徳真円鉄渋寿齢学会蔵浅黒静条県頼宝弥顕楽実処乗児転芸応灯為鶏"))
#: What may follow a name without being part of it.
TITLES = re.compile("(?:君|議員|委員|氏|さん|くん|先生|[（(][^）)]*[）)])+$")
#: A match is given from this confidence on, and only so far ahead of the next candidate.
LEAST_CONFIDENCE = 0.62
LEAST_LEAD = 0.04
#: Propagation goes on until the matches repeat; more rounds than this are an error, not a result.
MOST_ROUNDS = 100

_KANJI = str.maketrans(VARIANT_KANJI | {"ケ": "ヶ", "が": "が"})
_HIRAGANA = str.maketrans(KATAKANA, HIRAGANA)
_SMALL = str.maketrans("ぁぃぅぇぉっゃゅょゎゕゖ", "あいうえおつやゆよわかけ")


def name_form(name: str | None) -> str:
    """A name without titles, blanks and dots, kanji in their usual form."""
    text = unicodedata.normalize("NFKC", name or "")
    text = re.sub("[\\s・･·　​-‏⁠﻿­᠎]+", "", text)
    return TITLES.sub("", text).translate(_KANJI)


def reading_key(reading: str | None) -> str:
    """A reading as plain hiragana, voicing and small signs aside."""
    text = unicodedata.normalize("NFD", reading_form(reading or "").translate(_HIRAGANA))
    return re.sub("[^ぁ-ゖー]", "", text.replace("゙", "").replace("゚", "")).translate(_SMALL)


def _short(key: str) -> str:
    """A reading key without lengthened vowels, which are often left out."""
    return re.sub("(?<=[おこそとのほもよろ])[うお]|ー", "", key)


def _kana_split(name: str) -> tuple[str, str, bool] | None:
    """(kanji part, kana part, kanji first) of a name half in kana; ヶ counts as kanji."""
    m = re.fullmatch("([一-鿿々ヶ]+)([ぁ-ゖァ-ヺー]+)", name)
    if m:
        return m[1], reading_key(m[2]), True
    m = re.fullmatch("([ぁ-ゖァ-ヺー]+?)([一-鿿々ヶ]+)", name)
    return (m[2], reading_key(m[1]), False) if m else None


def speaker_keys(speaker: str | None, reading: str | None) -> set[str]:
    """Attributes that a speaker may share with a politician."""
    name, key = name_form(speaker), reading_key(reading)
    if name and re.fullmatch("[ぁ-ゖァ-ヺー]+", name):
        key = key if len(key) >= len(reading_key(name)) else reading_key(name)
        name = ""
    keys = set()
    if name:
        keys.add("n" + name)
        split = _kana_split(name)
        if split:
            kanji, kana, first = split
            keys.add(("h" if first else "t") + kanji + "/" + (kana[-2:] if first else kana[:2]))
        elif len(name) >= 2:
            keys.add("p" + name)
        keys |= {"x" + name[:i] + name[i + 1 :] for i in range(len(name))} if len(name) >= 4 and not split else set()
    if key:
        keys |= {"r" + key, "v" + _short(key)}
        keys |= {"d" + key[:i] + key[i + 1 :] for i in range(len(key))} | {"d" + key}
    return keys


def politician_keys(name: str | None, readings: list[str]) -> set[str]:
    name = name_form(name)
    keys = set()
    if name:
        keys.add("n" + name)
        keys |= {"p" + name[:i] for i in range(2, len(name))}
        keys |= {"x" + name[:i] + name[i + 1 :] for i in range(len(name))} if len(name) >= 4 else set()
    for key in {reading_key(r) for r in readings if r}:
        keys |= {"r" + key, "v" + _short(key)}
        keys |= {"d" + key[:i] + key[i + 1 :] for i in range(len(key))} | {"d" + key}
        for i in range(1, len(name)):
            keys.add("h" + name[:i] + "/" + key[-2:])
            keys.add("t" + name[i:] + "/" + key[:2])
    return keys


def _distance(a: str, b: str, most: int = 3) -> int:
    """Edits between two strings, or ``most`` + 1."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row[-1], most + 1)


def likeness(speaker: str | None, reading: str | None, name: str | None, readings: list[str]) -> float:
    """How well a speaker's name and reading agree with a politician's, from 0 to 1."""
    spoken, known = name_form(speaker), name_form(name)
    key, keys = reading_key(reading), [k for k in (reading_key(r) for r in readings or [] if r) if k]
    whole_kana = bool(spoken) and re.fullmatch("[ぁ-ゖァ-ヺー]+", spoken) is not None
    by_reading = 0.0
    family_only = False
    for k in keys:
        if key:
            d = _distance(key, k)
            by_reading = max(by_reading, 1.0 if d == 0 else 0.8 if d == 1 and len(k) > 4 else 0.8 if _short(key) == _short(k) else 0.45 if d == 2 and len(k) > 6 else 0.0)
            if by_reading < 0.8 and len(key) >= 2 and k.startswith(key):
                by_reading, family_only = max(by_reading, 0.5), True
        if whole_kana:
            d = _distance(reading_key(spoken), k)
            by_reading = max(by_reading, 1.0 if d == 0 else 0.8 if d == 1 else 0.0)
    if not spoken or whole_kana:
        return 0.85 * by_reading if keys else 0.0
    split = _kana_split(spoken)
    if spoken == known:
        by_name = 1.0
    elif split:
        kanji, kana, first = split
        fits = known.startswith(kanji) if first else known.endswith(kanji)
        part = 0.0
        for k in keys:
            tail = k[-len(kana) :] if first else k[: len(kana)]
            d = _distance(kana, tail)
            part = max(part, 0.95 if d == 0 else 0.75 if d == 1 and len(kana) > 2 else 0.3)
        by_name = (part if keys else 0.6) if fits else 0.0
    elif len(spoken) >= 2 and known.startswith(spoken):
        by_name = 0.7
    elif len(known) >= 4 and _distance(spoken, known) == 1:
        by_name = 0.55
    else:
        by_name = 0.0
    if by_name == 0.55 and by_reading < 1.0:
        by_name = 0.25
    if by_name == 0.0:
        return 0.3 * by_reading
    if not key or not keys:
        return by_name * (0.9 if spoken == known else 0.8)
    if by_name == 1.0:
        return 1.0 if by_reading >= 0.8 else 0.92 if by_reading or family_only else 0.78
    if by_reading == 0.0:
        return 0.45 * by_name
    return 0.55 * by_name + 0.45 * by_reading


def candidate_graph(units: DataFrame, people: DataFrame) -> DataFrame:
    """(unit, person): edges by shared attributes.

    No attribute is too common: a bare family name may still be told by the group on the day, however many bear it. Nor is an edge left out
    for another that shares more: a reading counts once for each of its letters, a name that agrees exactly only once.
    """

    def unit_attributes(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in batches:
            rows = [(u, k) for u, s, r in zip(*(batch.column(i).to_pylist() for i in range(3))) for k in speaker_keys(s, r)]
            yield {"unit": [u for u, _ in rows], "key": [k for _, k in rows]}

    def person_attributes(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in batches:
            rows = [(p, k) for p, n, r in zip(*(batch.column(i).to_pylist() for i in range(3))) for k in politician_keys(n, r or [])]
            yield {"person": [p for p, _ in rows], "key": [k for _, k in rows]}

    left = map_batches(units.select("unit", "speaker", "reading"), unit_attributes, "unit long, key string")
    right = map_batches(people.select("person", "name", "readings"), person_attributes, "person long, key string")
    return left.join(right, "key").select("unit", "person").distinct()


def compare(edges: DataFrame, units: DataFrame, people: DataFrame) -> DataFrame:
    """(unit, person, alike) of the edges whose names agree at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in batches:
            unit, person, speaker, reading, name, readings = (batch.column(i).to_pylist() for i in range(6))
            yield {"unit": unit, "person": person, "alike": [likeness(s, r, n, rs) for s, r, n, rs in zip(speaker, reading, name, readings)]}

    full = edges.join(units.select("unit", "speaker", "reading"), "unit").join(people.select("person", "name", "readings"), "person")
    return map_batches(full.select("unit", "person", "speaker", "reading", "name", "readings"), run, "unit long, person long, alike double").where("alike >= 0.4")


def group_likeness(linked: DataFrame) -> DataFrame:
    """(spoken, kaiha, share): how much of what is said under a spoken group name comes from members of a group."""
    pairs = linked.groupBy("spoken", "kaiha").agg(F.sum("weight").alias("w"))
    of_kaiha = F.sum("w").over(Window.partitionBy("kaiha"))
    of_spoken = F.max("w").over(Window.partitionBy("spoken"))
    return pairs.withColumn("_k", of_kaiha).withColumn("_s", of_spoken).select("spoken", "kaiha", (F.col("w") / F.col("_s")).alias("share"))


def unit_id(speaker: str, reading: str) -> Column:
    """One number for a speaker and reading; a null is marked, as a hash alone passes over it."""
    return F.xxhash64(F.col(speaker).isNull(), speaker, F.col(reading).isNull(), reading)


def link_speakers(speech: DataFrame, politician: DataFrame, affiliation: DataFrame) -> DataFrame:
    """(row_id, politician_id, wikidata_id, confidence) for members' speeches without politician_id.

    Rows whose speaker fits nobody, or two people equally, have no match; nor have rows without a speaker and reading. Repeated rows come
    out once. People of one name are told apart by the group they belonged to on the day, then by the groups they ever belonged to.
    """
    spoken = same_look(F.col("speaker_group")).alias("spoken")
    open_row = F.expr("speaker_kind <=> '議員' AND politician_id IS NULL")
    # One pass: linked speeches by person, reading and group, open ones by speaker, reading, group and day. Both combine before the shuffle.
    said = speech.where(open_row | F.col("politician_id").isNotNull()).select(F.col("politician_id").cast("long").alias("person"), F.when(open_row, F.col("speaker")).alias("speaker"), F.col("speaker_yomi").alias("reading"), spoken, F.when(open_row, F.col("date")).alias("date"))
    said = materialize(said.groupBy("person", "speaker", "reading", "spoken", "date").agg(F.count("*").alias("n")))
    asked = said.where("person IS NULL").select(unit_id("speaker", "reading").alias("unit"), "speaker", "reading", "spoken", "date", "n")
    units = materialize(asked.groupBy("unit", "speaker", "reading").agg(F.sum("n").alias("rows")))
    asked = asked.select("unit", "spoken", "date", "n")
    told = said.where("person IS NOT NULL").select("person", F.col("reading").alias("r"), "spoken", "n")
    # The reading heard most: a misspelt one is rarely repeated. A minimum over (−n, reading) combines before the shuffle.
    heard = told.where("r IS NOT NULL").groupBy("person", "r").agg(F.sum("n").alias("n")).groupBy("person").agg(F.array(F.min(F.struct((-F.col("n")).alias("k"), "r")).getField("r")).alias("_heard"))
    people = politician.select(F.col("id").cast("long").alias("person"), "name", F.array("name_kana").alias("_own"), "wikidata_id")
    people = people.join(heard, "person", "left").select("person", "name", F.array_distinct(F.filter(F.concat("_own", F.coalesce("_heard", F.array().cast("array<string>"))), lambda x: x.isNotNull())).alias("readings"), "wikidata_id")
    people = materialize(people)
    scored = materialize(compare(candidate_graph(units, people), units, people))

    held = affiliation.where("kaiha IS NOT NULL").select(F.col("politician_id").cast("long").alias("person"), same_look(F.col("kaiha")).alias("kaiha"), F.coalesce("start_date", F.lit("0001-01-01").cast("date")).alias("a"), F.coalesce("end_date", F.lit("9999-12-31").cast("date")).alias("b"))
    ever = held.select("person", "kaiha").distinct()
    best = F.max("alike").over(Window.partitionBy("unit"))
    rivals = materialize(scored.withColumn("_best", best).where("alike >= _best - 0.25").withColumn("_n", F.count("*").over(Window.partitionBy("unit"))).drop("_best"))

    # The group names of one candidate's units, against the groups of that candidate; linked speeches are matches from the start.
    spoken_units = asked.where("spoken IS NOT NULL").groupBy("unit", "spoken").agg(F.sum("n").alias("n"))
    votes = spoken_units.groupBy("unit").agg(F.sum("n").alias("_t"))
    rivals = materialize(rivals.join(votes, "unit", "left"))
    ties = materialize(spoken_units.join(rivals.select("unit", "person"), "unit").join(ever, "person"))
    base = materialize(told.where("spoken IS NOT NULL").groupBy("person", "spoken").agg(F.sum("n").alias("weight")).join(ever, "person").groupBy("spoken", "kaiha").agg(F.sum("weight").alias("weight")))
    own = held.select(F.col("kaiha").alias("spoken")).distinct().select("spoken", F.col("spoken").alias("kaiha"), F.lit(1.0).alias("share"))
    sure = rivals.where("_n = 1 AND alike >= 0.6").select("unit", "person")
    states: set[tuple[int, int]] = set()
    while True:
        found = ties.join(sure, ["unit", "person"]).select("spoken", "kaiha", F.col("n").alias("weight"))
        # A group's own name stands for it fully, whatever the matches say.
        groups = materialize(group_likeness(base.unionByName(found)).where("share >= 0.3 AND spoken <> kaiha").unionByName(own))
        near = ties.join(groups, ["spoken", "kaiha"]).groupBy("unit", "person", "spoken", "n").agg(F.max("share").alias("share"))
        evidence = near.groupBy("unit", "person").agg(F.sum(F.col("share") * F.col("n")).alias("_s"))
        place = Window.partitionBy("unit").orderBy(F.desc("score"), "person")
        standing = rivals.join(evidence, ["unit", "person"], "left").withColumn("near", F.coalesce(F.col("_s") / F.col("_t"), F.lit(0.5)))
        standing = standing.withColumn("score", F.col("alike") * 0.8 + F.col("near") * 0.2).withColumn("_k", F.row_number().over(place))
        standing = materialize(standing.withColumn("_lead", F.col("score") - F.coalesce(F.lead("score").over(place), F.lit(0.0))).select("unit", "person", "alike", "near", "score", "_k", "_lead"))
        sure = standing.where("_k = 1 AND score >= 0.55 AND _lead > 0.02").select("unit", "person")
        state = sure.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("unit", "person")), F.lit(0))).first()
        # The next round follows from these matches alone: once they repeat, at once or in a cycle, nothing new comes.
        if tuple(state) in states:
            break
        states.add(tuple(state))
        if len(states) >= MOST_ROUNDS:
            raise RuntimeError(f"the matches have not become stable in {MOST_ROUNDS} rounds")

    # Each speaker, group and day between the candidates: the group on the day, then ever, beside the names. No row is met before this is decided.
    options = asked.drop("n").join(standing.select("unit", "person", "alike", "near"), "unit")
    terms = held.join(groups, "kaiha").select("person", "spoken", "share", "a", "b")
    keys = ["unit", "spoken", "date", "person", "alike", "near"]
    on_day = F.when(F.col("date").between(F.col("a"), F.col("b")), F.col("share"))
    rated = options.join(terms, ["person", "spoken"], "left").groupBy(*keys).agg(F.max(on_day).alias("now"), F.max("share").alias("once"))
    group = F.when(F.col("spoken").isNull(), F.col("near")).otherwise(0.7 * F.coalesce("now", F.lit(0.0)) + 0.3 * F.coalesce("once", F.lit(0.0)))
    rated = rated.withColumn("confidence", F.col("alike") * 0.85 + group * 0.15)
    order = Window.partitionBy("unit", "spoken", "date").orderBy(F.desc("confidence"), "person")
    ranked = rated.withColumn("_k", F.row_number().over(order)).withColumn("_next", F.lead("confidence").over(order))
    first = ranked.where(f"_k = 1 AND confidence >= {LEAST_CONFIDENCE} AND (_next IS NULL OR confidence - _next >= {LEAST_LEAD})")
    first = first.join(people.select("person", "wikidata_id"), "person").select("unit", "spoken", F.col("date").alias("day"), F.col("person").alias("politician_id"), "wikidata_id", F.round("confidence", 4).alias("confidence"))
    rows = speech.where(open_row).select("row_id", "date", unit_id("speaker", "speaker_yomi").alias("of"), spoken.alias("group"))
    found = rows.join(first, (F.col("of") == F.col("unit")) & F.col("group").eqNullSafe(F.col("spoken")) & F.col("date").eqNullSafe(F.col("day")))
    return found.select("row_id", "politician_id", "wikidata_id", "confidence").distinct()
