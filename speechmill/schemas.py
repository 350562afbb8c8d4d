"""Explicit schemas of raw records and reference data."""

from __future__ import annotations

from pyspark.sql import types as T

#: A raw speech record as delivered, one JSON object a line.
RAW = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("issueID", T.StringType()), ("speechID", T.StringType()), ("session", T.IntegerType()), ("nameOfHouse", T.StringType()), ("nameOfMeeting", T.StringType()), ("issue", T.StringType()), ("date", T.StringType()), ("meetingURL", T.StringType()), ("pdfURL", T.StringType()),
        ("speechOrder", T.IntegerType()), ("speaker", T.StringType()), ("speakerYomi", T.StringType()), ("speakerGroup", T.StringType()), ("speakerPosition", T.StringType()), ("speakerRole", T.StringType()), ("speech", T.StringType()), ("startPage", T.IntegerType()), ("speechURL", T.StringType()),
    )]
)

#: Raw name to column name, for speeches and for meetings.
SPEECH_COLUMNS = {"speechID": "speech_id", "issueID": "issue_id", "speechOrder": "speech_order", "date": "date", "speaker": "speaker", "speakerYomi": "speaker_yomi", "speakerGroup": "speaker_group", "speakerPosition": "speaker_position", "speakerRole": "speaker_role", "speech": "body", "startPage": "start_page", "speechURL": "speech_url"}
MEETING_COLUMNS = {"issueID": "issue_id", "session": "session", "nameOfHouse": "house", "nameOfMeeting": "name", "issue": "issue", "date": "date", "meetingURL": "meeting_url", "pdfURL": "pdf_url"}

TOPIC = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("category", T.StringType()), T.StructField("variants", T.ArrayType(T.StringType()))])
KB_MEMBER = T.StructType([T.StructField(n, t) for n, t in (("wikidata_id", T.StringType()), ("name", T.StringType()), ("kana", T.StringType()), ("houses", T.ArrayType(T.StringType())), ("parties", T.ArrayType(T.StringType())))])
KB_TERM = T.StructType([T.StructField(n, t) for n, t in (("wikidata_id", T.StringType()), ("house", T.StringType()), ("start", T.DateType()), ("end", T.DateType()), ("district", T.StringType()))])

# Speakers that stand for headings, roles of outside speakers, and the indexed population.
NON_SPEECH = ("会議録情報",)
OUTSIDE_ROLES = ("参考人", "公述人", "証人")
MEMBER = "議員"
