"""Mixed timestamp texts to one UTC instant (problem 5).

All formats are one regular expression: date alternatives and a shared time and zone part, every
component a named group.  One ``regexp_replace`` per row writes the groups into a fixed slot layout;
calendar ranges are checked on the slots, and the instant is put together with integer day
arithmetic.  Everything stays in JVM expressions; the only join is with the small client table.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, functions as F

from turnwise.functions.timezones import abbreviations_of, unambiguous_abbreviations

_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sept?|oct|nov|dec)[a-z]*\.?"
_WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"

#: Date alternatives; the suffix of a group name tells the alternative.
_DATES = [
    r"(?<ya>\d{4})(?<sa>[-/.])(?<ma>\d{1,2})\k<sa>(?<da>\d{1,2})",  # year first
    r"(?<pc>\d{1,2})(?<sc>[-/.])(?<qc>\d{1,2})\k<sc>(?<yc>\d{4})",  # day or month first
    _WEEKDAY + r"(?<dd>\d{1,2})[-\s](?<md>" + _MONTH + r")[-\s](?<yd>\d{4})",  # 03-Mar-2025, Mon, 03 Mar 2025
    _WEEKDAY + r"(?<me>" + _MONTH + r")\s+(?<de>\d{1,2})(?:st|nd|rd|th)?,?\s+(?<ye>\d{4})",  # Mar 3, 2025
]
_TIME = r"(?<h>\d{1,2}):(?<mi>\d{2})(?::(?<s>\d{2})(?:[.,](?<f>\d{1,12}))?)?(?:\s*(?<ap>[ap])\.?m\.?)?"
_ZONE = (
    r"(?:\s*(?:(?<zn>[a-z]+(?:/[a-z0-9_+-]+)+)|(?<ab>[a-z]{1,5})?(?<of>[+-]\d{2}(?::?\d{2})?)?))?"
    r"(?:\s*\[(?<zb>[a-z]+(?:/[a-z0-9_+-]+)*)\])?"
)
_COMPACT = r"(?<yg>\d{4})(?<mg>\d{2})(?<dg>\d{2})t(?<hg>\d{2})(?<nig>\d{2})(?<sg>\d{2})?(?:[.,](?<fg>\d{1,12}))?(?<zg>z|[+-]\d{2}(?::?\d{2})?)?"
_COUNT = r"(?<ng>[+-]?)(?<n>\d{9,19})(?:\.(?<nf>\d{1,12}))?"

PATTERN = (
    r"(?is)^[\s ​]*(?:(?:"
    + "|".join(_DATES)
    + r")(?:t|,?\s+(?:at\s+)?)"
    + _TIME
    + _ZONE
    + "|"
    + _COMPACT
    + "|"
    + _COUNT
    + r")[\s ​]*$"
)
#: Slots of the layout; groups that fill the same slot never match together.
_SLOTS = {
    "year": "${ya}${yc}${yd}${ye}${yg}", "month": "${ma}${mg}", "month_name": "${md}${me}", "day": "${da}${dd}${de}${dg}",
    "first": "${pc}", "second": "${qc}", "sep": "${sc}", "hour": "${h}${hg}", "minute": "${mi}${nig}", "sec": "${s}${sg}",
    "fraction": "${f}${fg}", "half": "${ap}", "abbr": "${ab}", "offset": "${of}${zg}", "zone": "${zn}", "bracket": "${zb}",
    "sign": "${ng}", "count": "${n}", "count_fraction": "${nf}",
}
_SEP = "\u0001"
_DAY_US = 86_400_000_000


def _days_from_civil(y: str, m: str, d: str) -> str:
    """Days since 1970-01-01 of a proleptic Gregorian date, in integers (years from March)."""
    ym = f"({y} - (CASE WHEN {m} <= 2 THEN 1 ELSE 0 END))"
    doy = f"((153 * ({m} + (CASE WHEN {m} > 2 THEN -3 ELSE 9 END)) + 2) div 5 + {d} - 1)"
    return f"(365L * {ym} + {ym} div 4 - {ym} div 100 + {ym} div 400 + {doy} - 719468)"


_INT_SLOTS = {"year", "month", "day", "first", "second", "hour", "minute", "sec"}
_SLOT_SCHEMA = "_pad string, " + ", ".join(f"{n} {'int' if n in _INT_SLOTS else 'string'}" for n in _SLOTS)


def _layout() -> str:
    """The replacement text; group numbers instead of names, which Java resolves faster."""
    number = {name: k for k, name in enumerate(re.findall(r"\(\?<([a-z]+)>", PATTERN), 1)}
    return _SEP + _SEP.join(re.sub(r"\$\{([a-z]+)\}", lambda m: f"${number[m[1]]}", slot) for slot in _SLOTS.values())


def with_components(df: DataFrame, text: str) -> DataFrame:
    """Adds ``_c``: the components of a timestamp text as a struct, null where no format matches.

    One pass of the regular expression writes all groups into a fixed layout, which is read once;
    the struct's fields are cheap, so later projections do not repeat the expression.
    """
    once = F.regexp_replace(F.col(text), F.lit(PATTERN), F.lit(_layout()))
    slots = F.from_csv("_r", _SLOT_SCHEMA, {"sep": _SEP, "quote": "\u0000", "mode": "PERMISSIVE"})
    return df.withColumn("_r", once).withColumn("_c", F.when(F.col("_r").startswith(_SEP), slots)).drop("_r")


def to_instants(df: DataFrame, text: str, zone: str, locale: str, abbreviations: str, out: str = "epoch_us") -> DataFrame:
    """Adds ``out``: microseconds since 1970 UTC of a timestamp text, or null.

    ``zone`` and ``locale`` are the columns that hold the record's home zone (an IANA name, already
    checked) and locale; ``abbreviations`` maps the zone's abbreviations to seconds.

    Defined results: null or empty text, text without full valid date and time, 24:00, second 60,
    February 30: null.  An offset, a zone or an abbreviation in the text decides; an abbreviation is
    read in the home zone's sense, else in the only sense it has anywhere; one with several senses
    and no home zone gives null.  Without any of these the home zone decides; unknown: null.  A
    local time that occurs twice is the earlier instant; one that a clock change skips is read with
    the offset before the change.  Dates with slashes need the locale unless the year comes first;
    dotted and dashed dates start with the day.  Plain numbers of 9-11, 12-14, 15-17 and 18-19
    digits are seconds, milli-, micro- and nanoseconds; digits beyond microseconds are cut off.
    """
    x = with_components(df, text)
    names = ", ".join(f"'{m}'" for m in _MONTHS)
    month_first = f"{locale} = 'en-US'"
    slash = "_c.sep = '/'"
    x = x.withColumns(
        {
            "_y": F.expr("_c.year"),
            "_m": F.expr(
                f"CASE WHEN _c.month_name IS NOT NULL THEN CAST(array_position(array({names}), lower(substring(_c.month_name, 1, 3))) AS INT) "
                f"WHEN _c.sep IS NULL THEN _c.month WHEN NOT {slash} THEN _c.second WHEN {locale} IS NULL THEN NULL WHEN {month_first} THEN _c.first ELSE _c.second END"
            ),
            "_d": F.expr(f"CASE WHEN _c.sep IS NULL THEN _c.day WHEN NOT {slash} THEN _c.first WHEN {locale} IS NULL THEN NULL WHEN {month_first} THEN _c.second ELSE _c.first END"),
            "_h": F.expr(
                "CASE WHEN _c.half IS NULL THEN CASE WHEN _c.hour BETWEEN 0 AND 23 THEN _c.hour END "
                "WHEN _c.hour BETWEEN 1 AND 12 THEN _c.hour % 12 + (CASE WHEN lower(_c.half) = 'p' THEN 12 ELSE 0 END) END"
            ),
        }
    )
    month_days = "(CASE WHEN _m = 2 THEN (CASE WHEN (_y % 4 = 0 AND _y % 100 <> 0) OR _y % 400 = 0 THEN 29 ELSE 28 END) WHEN _m IN (4, 6, 9, 11) THEN 30 ELSE 31 END)"
    x = x.withColumn("_days", F.expr(f"CASE WHEN _y >= 1 AND _m BETWEEN 1 AND 12 AND _d BETWEEN 1 AND {month_days} THEN {_days_from_civil('_y', '_m', '_d')} END"))
    x = x.withColumn(
        "_local",
        F.expr(
            f"CASE WHEN _c.minute <= 59 AND coalesce(_c.sec, 0) <= 59 THEN _days * {_DAY_US}L "
            "+ CAST(_h * 3600 + _c.minute * 60 + coalesce(_c.sec, 0) AS BIGINT) * 1000000L + coalesce(CAST(rpad(substring(_c.fraction, 1, 6), 6, '0') AS BIGINT), 0L) END"
        ),
    )
    digits = "regexp_replace(_c.offset, '[^0-9]', '')"
    x = x.withColumn("_hhmm", F.expr(f"CASE WHEN lower(_c.offset) = 'z' THEN 0 ELSE CAST(rpad({digits}, 4, '0') AS INT) END"))
    single = F.from_json(F.lit(json.dumps(unambiguous_abbreviations())), "map<string,int>")
    label = F.upper(F.col("_c.abbr"))
    by_label = F.when(label.isin("Z", "UT", "UTC", "GMT"), 0).otherwise(F.coalesce(F.element_at(F.col(abbreviations), label), F.element_at(single, label)))
    by_number = F.expr("CASE WHEN _hhmm % 100 <= 59 AND _hhmm <= 1800 THEN ((_hhmm div 100) * 3600 + (_hhmm % 100) * 60) * (CASE WHEN _c.offset LIKE '-%' THEN -1 ELSE 1 END) END")
    named = F.coalesce("_c.bracket", "_c.zone")
    x = x.withColumns(
        {
            "_stated": F.expr("_c.offset IS NOT NULL OR _c.abbr IS NOT NULL"),
            "_sec": F.when(F.col("_c.offset").isNotNull(), by_number).otherwise(by_label).cast("long"),
            "_zone": F.when(named.isNull(), F.col(zone)).when(abbreviations_of(named).isNotNull(), named),
        }
    )
    in_zone = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("_local"), F.col("_zone")))
    dated = F.when(F.col("_stated"), F.col("_local") - F.col("_sec") * 1_000_000).otherwise(in_zone)
    rest = "CAST(substring(rpad(coalesce(_c.count_fraction, ''), 6, '0'), 1, %d) AS BIGINT)"
    counted = F.expr(
        "(CASE WHEN _c.sign = '-' THEN -1L ELSE 1L END) * (CASE WHEN length(_c.count) <= 11 THEN try_cast(_c.count AS BIGINT) * 1000000L + "
        + rest % 6
        + " WHEN length(_c.count) <= 14 THEN try_cast(_c.count AS BIGINT) * 1000L + "
        + rest % 3
        + " WHEN length(_c.count) <= 17 THEN try_cast(_c.count AS BIGINT) ELSE CAST(try_cast(_c.count AS DECIMAL(19, 0)) div 1000 AS BIGINT) END)"
    )
    return x.withColumn(out, F.when(F.col("_c.count").isNotNull(), counted).otherwise(dated)).select(*df.columns, out)


def client_zones(clients: DataFrame) -> DataFrame:
    """(client_id, zone, locale, abbreviations); zone is null where home_zone names no zone."""
    c = clients.select("client_id", "home_zone", "locale").where("client_id IS NOT NULL").dropDuplicates(["client_id"])
    named = c.withColumn("abbreviations", abbreviations_of(F.col("home_zone")))
    return named.select("client_id", F.when(F.col("abbreviations").isNotNull(), F.col("home_zone")).alias("zone"), "locale", "abbreviations")


def find_instants(turns: DataFrame, messages: DataFrame, clients: DataFrame) -> DataFrame:
    """(origin, owner_id, idx, epoch_us) of every record whose timestamp fixes a moment.

    Both record tables pass one scan each; the client table is joined on client_id (Catalyst
    broadcasts it by its measured size, else it shuffles).  Rows delivered several times come out
    once.  Null keys stay null in the output; null timestamps give no row.
    """
    part = turns.select(F.lit("turns").alias("origin"), F.col("transcript_id").cast("long").alias("owner_id"), F.col("turn_idx").cast("long").alias("idx"), F.col("timestamp").alias("text"), F.col("metadata.client_id").alias("client_id"))
    rest = messages.select(F.lit("session_messages").alias("origin"), F.col("session_id").cast("long").alias("owner_id"), F.col("msg_idx").cast("long").alias("idx"), F.col("timestamp").alias("text"), F.col("client_id"))
    rows = part.unionByName(rest).where(F.col("text").isNotNull())
    joined = rows.join(client_zones(clients), "client_id", "left")
    found = to_instants(joined, "text", "zone", "locale", "abbreviations")
    # The filter reads an aggregate's result on purpose: on the plain column Catalyst would push it
    # down to the scan and evaluate the whole parse once more in each place it passes.
    once = found.groupBy("origin", "owner_id", "idx", "epoch_us").agg(F.max("epoch_us").alias("_seen"))
    return once.where("_seen IS NOT NULL").drop("_seen")
