"""Queries of the training-data problems, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .confusables import departures, skeleton_groups
from .contamination import COVERAGE, cleaned, leaked
from .linkage import link_speakers
from .packing import fill, pack, placed_texts
from .pii import personal_information, redact
from .terms import term_frequencies


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_frequencies(table(spark, sf_dir, "speech").select("speech_id", "fetched_at", "row_id", "body"), "speech_id", "fetched_at", "row_id", "body")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_terms(spark, sf_dir).where("mark IS NOT NULL").select("term", "mark")


def _values(spark: SparkSession, sf_dir: str, name: str, field: str, rec: str) -> DataFrame:
    return table(spark, sf_dir, name).select(F.lit(name).alias("tbl"), F.lit(field).alias("field"), F.col(rec).cast("long").alias("rec_id"), F.col(field).cast("string").alias("value"))


def _texts_and_readings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    readings = _values(spark, sf_dir, "speech", "speaker_yomi", "row_id").unionByName(_values(spark, sf_dir, "politician", "name_kana", "id"))
    return _values(spark, sf_dir, "speech", "body", "row_id"), readings


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value that departs from the consistent form, in that form."""
    return departures(*_texts_and_readings(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_forms(spark, sf_dir).select("tbl", "field", "rec_id").distinct()


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all bodies, and readings of speakers and politicians, that look the same, grouped by skeleton."""
    return skeleton_groups(*_texts_and_readings(spark, sf_dir))


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where in which document what of which item stands, by the limits of length and of coverage."""
    return leaked(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_item"), "item_id", "text", coverage=COVERAGE)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and items by the limit of length alone: many shorter stretches are no cases here."""
    found = leaked(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_item"), "item_id", "text")
    return found.select("doc_id", "item_id").distinct()


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents concerned, with everything beyond the limits cut out."""
    return cleaned(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_item"), "item_id", "text")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's container and place in it."""
    return pack(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each container holds."""
    return fill(p7_containers(spark, sf_dir))


def p7_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document was placed, and what is wrong with its places."""
    return placed_texts(p7_containers(spark, sf_dir))


def p4_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each member's speech without politician_id with the politician found, also those without wikidata_id."""
    speech = table(spark, sf_dir, "speech").select("row_id", "date", "speaker", "speaker_yomi", "speaker_group", "speaker_kind", "politician_id")
    return link_speakers(speech, table(spark, sf_dir, "politician"), table(spark, sf_dir, "affiliation"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_matches(spark, sf_dir).where("wikidata_id IS NOT NULL").select("row_id", "wikidata_id").distinct()


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was found, and where in the document it begins."""
    return personal_information(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_spans(spark, sf_dir).select("doc_id", "pii_kind", "pii_text").distinct()


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with placeholders in place of personal information."""
    return redact(table(spark, sf_dir, "documents"), "doc_id", "text")


def p4_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the matches those whose speaker has exactly the name and reading of one politician who shares neither: they can be told by SQL."""
    p = table(spark, sf_dir, "politician").select("id", "name", "name_kana")
    only = p.join(p.groupBy("name").count().where("count = 1").select("name"), "name", "left_semi").join(p.groupBy("name_kana").count().where("count = 1").select("name_kana"), "name_kana", "left_semi")
    said = table(spark, sf_dir, "speech").select("row_id", F.col("speaker").alias("name"), F.col("speaker_yomi").alias("name_kana"))
    return p4_matches(spark, sf_dir).join(said.join(only, ["name", "name_kana"]).select("row_id"), "row_id", "left_semi").select("row_id", "politician_id")


#: Characters that are never in house form, wherever they stand.
_NEVER = "[A-Za-z0-9ｦ-ﾟ 豈-﫿]"


def p5_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the departing values those that a pattern of single characters tells."""
    texts, readings = _texts_and_readings(spark, sf_dir)
    told = texts.unionByName(readings).where(F.col("value").rlike(_NEVER)).select("tbl", "field", "rec_id")
    return p5_found(spark, sf_dir).join(told, ["tbl", "field", "rec_id"], "left_semi")


def p9_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of what was found the addresses written plainly, which a pattern tells."""
    return p9_found(spark, sf_dir).where("pii_kind = 'email'").where(F.col("pii_text").rlike("^[A-Za-z0-9._+@-]+$")).select("doc_id", "pii_text")


QUERIES = {"p4_exact": p4_exact, "p5_width": p5_width, "p9_mail": p9_mail, "p9_spans": p9_spans, "p9_found": p9_found, "p9_redacted": p9_redacted, "p4_matches": p4_matches, "p4_found": p4_found, "p7_containers": p7_containers, "p7_fill": p7_fill, "p7_placed": p7_placed, "p8_passages": p8_passages, "p8_found": p8_found, "p8_clean": p8_clean, "p1_terms": p1_terms, "p1_found": p1_found, "p5_forms": p5_forms, "p5_found": p5_found, "p5_groups": p5_groups}

_TERMS = """
WITH latest AS (
    SELECT body FROM (SELECT body, row_number() OVER (PARTITION BY speech_id ORDER BY fetched_at DESC, row_id DESC) AS n FROM speech WHERE speech_id IS NOT NULL) WHERE n = 1),
    found AS (
    SELECT row_number() OVER () AS record, regexp_extract_all(translate(body, 'ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ', 'ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ'), '[一-鿿々]{{2,}}|[ァ-ヴー]{{2,}}|[Ａ-Ｚａ-ｚ０-９]{{2,}}') AS terms FROM latest),
    flat AS (SELECT record, unnest(terms) AS term FROM found),
    counted AS (SELECT term, count(*) AS occurrences, count(DISTINCT record) AS records FROM flat GROUP BY term)
SELECT term{counts}, CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.1 * (SELECT count(*) FROM latest) THEN 'common' END AS mark FROM counted{only}"""

ORACLES = {
    "p4_exact": "SELECT DISTINCT s.row_id, CAST(p.id AS BIGINT) AS politician_id FROM speech s JOIN politician p ON p.name = s.speaker AND p.name_kana = s.speaker_yomi WHERE s.speaker_kind = '議員' AND s.politician_id IS NULL AND (SELECT count(*) FROM politician q WHERE q.name = p.name) = 1 AND (SELECT count(*) FROM politician q WHERE q.name_kana = p.name_kana) = 1",
    "p5_width": " UNION ALL ".join(f"SELECT '{t}' AS tbl, '{f}' AS field, CAST({i} AS BIGINT) AS rec_id FROM {t} WHERE regexp_matches({f}, '{_NEVER}')" for t, f, i in (("speech", "body", "row_id"), ("speech", "speaker_yomi", "row_id"), ("politician", "name_kana", "id"))),
    "p9_mail": "SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9._+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:[.][A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+')) AS pii_text FROM documents",
    "p7_placed": "SELECT doc_id, count(*) AS copies, 0 AS faults FROM documents WHERE text IS NOT NULL GROUP BY doc_id",
    "p1_terms": _TERMS.format(counts=", occurrences, records", only=""),
    "p1_found": _TERMS.format(counts="", only=" WHERE records <= 2 OR records > 0.1 * (SELECT count(*) FROM latest)"),
}
