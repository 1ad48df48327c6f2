"""Plain-text transcripts into turns, inside each row: no shuffle and no group over a text's lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: An optional time in brackets, a name of 2 to 30 characters, a colon or dash, and the rest.
SPEAKER_LINE = r"(?dU)^\s*(?:\[([^\]]+)\]\s*)?([a-zA-Z0-9_\-\s]{2,30}?)\s*[:\-]\s*(.*)$"
#: A noncharacter of Unicode, put before each line that opens a turn; it is dropped from the texts themselves.
_MARK = "﷐"


def segment_text(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, turn_no, speaker_raw, timestamp, content): a matching line opens a turn, others continue it.

    Lines before the first match are dropped; a text without a match is one turn of ``Unknown``; null or
    blank texts have no turns.  Contents are stripped of outer white space.
    """
    plain = F.regexp_replace(F.translate(F.col(text), _MARK, ""), "\r\n?", "\n")
    marked = F.transform(F.split(plain, "\n"), lambda x: F.when(x.rlike(SPEAKER_LINE), F.concat(F.lit(_MARK), x)).otherwise(x))
    parts = F.split(F.array_join(marked, "\n"), _MARK)
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")

    def turn(part):
        head = F.substring_index(part, "\n", 1)
        group = lambda n: F.regexp_extract(head, SPEAKER_LINE, n)
        rest = F.substring(part, F.length(head) + 1, F.length(part))
        return F.struct(
            strip(group(2)).alias("speaker_raw"), F.nullif(group(1), F.lit("")).alias("timestamp"), strip(F.concat(group(3), rest)).alias("content")
        )

    whole = F.struct(F.lit("Unknown").alias("speaker_raw"), F.lit(None).cast("string").alias("timestamp"), strip(plain).alias("content"))
    none = F.filter(F.array(whole), lambda w: w["content"] != "")
    turns = F.when(F.size("_parts") > 1, F.transform(F.slice("_parts", 2, F.size("_parts")), turn)).otherwise(none)
    x = texts.where(F.col(text).isNotNull()).withColumn("_parts", parts)
    x = x.select(key, F.posexplode(turns).alias("turn_no", "_t"))
    return x.select(key, F.col("turn_no").cast("long").alias("turn_no"), "_t.speaker_raw", "_t.timestamp", "_t.content")
