"""One unambiguous text for times in many notations.

A value is brought to plain characters, then rewritten by a chain of anchored
patterns into one list of fields (year, month, day, half of day, hour, minute,
second, fraction, zone).  Wall-clock times find their offset by an as-of join
to the zone-offset intervals: one matching interval gives the offset, two mean
that the time occurs twice, none means that it never occurs; in both last cases
the offset in force before the change is taken.  Everything but the interval
table itself is built of JVM expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import zones

MARK = "\u0001"

#: Full-width characters that occur in written times, and their plain forms.
WIDE = "０１２３４５６７８９－：／．，＋　ＴＺ"
PLAIN = "0123456789-:/.,+ TZ"

#: Names of months in English, German and French by their number.
MONTHS = {
    1: "jan january januar jänner janvier janv",
    2: "feb february februar février fevrier févr",
    3: "mar march märz maerz mär mars",
    4: "apr april avril avr",
    5: "may mai",
    6: "jun june juni juin",
    7: "jul july juli juillet juil",
    8: "aug august août aout",
    9: "sep sept september septembre",
    10: "oct october okt oktober octobre",
    11: "nov november novembre",
    12: "dec december dez dezember décembre decembre déc",
}

_ZONE = r"[Zz]|[A-Za-z]{2,5}|[A-Z][A-Za-z_]+(?:/[A-Za-z0-9_+\-]+)+|(?:GMT|UTC)?[+\-]\d{2}(?::?\d{2})?"
_CLOCK = r"(\d{1,2})[:h](\d{2})(?::(\d{2})(?:[.,](\d{1,12}))?)?"

#: Each pattern with the fields that it leaves: y, mo, d, half, h, mi, s, fraction, zone.
_FORMS = [
    # 2021-02-05[T ]16:33:28,466+08:00, 2015年9月6日 下午1:26, 2016/7/13, 2015.09.18, 2021-06, 2015年
    (
        r"^(\d{4})(?:年|[-/.](?=\d))?(?:(?<=\D)(\d{1,2})(?:月|[-/.](?=\d))?(?:(?<=\D)(\d{1,2})日?(?:[T\s]\s*(上午|下午|AM|PM|am|pm)?\s*"
        + _CLOCK
        + r"\s*(" + _ZONE + r")?(?:\[(?=[A-Za-z_/+\-0-9]+\]$))?([A-Za-z_/+\-0-9]+)?\]?)?)?)?$",
        "$1|$2|$3|$4|$5|$6|$7|$8|$9$10",
    ),
    # 20180519T144147Z, 20161106015247
    (r"^(\d{4})(\d{2})(\d{2})T?(\d{2})(\d{2})(\d{2})(?:[.,](\d{1,12}))?\s*(" + _ZONE + r")?$", "$1|$2|$3||$4|$5|$6|$7|$8"),
    # 19.04.2022 22:13
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})(?:,?\s+" + _CLOCK + r"\s*(" + _ZONE + r")?)?$", "$3|$2|$1||$4|$5|$6|$7|$8"),
    # Wed, 7 Jun 2023 14:07:49 CET, 25. Januar 2018 um 18:39, 24 janvier 2019 à 4h08, 14 Apr 2019
    (
        r"^(?:\p{L}{2,10}\.?,?\s+)?(\d{1,2})\.?\s+(\p{L}{3,10})\.?,?\s+(\d{4})(?:,?\s+(?:um\s+|à\s+|at\s+)?"
        + _CLOCK + r"(?:\s*(AM|PM|am|pm))?\s*(" + _ZONE + r")?)?$",
        "$3|$2|$1|$8|$4|$5|$6|$7|$9",
    ),
    # Mar 28, 2018 9:15 PM
    (
        r"^(?:\p{L}{2,10}\.?,\s+)?(\p{L}{3,10})\.?\s+(\d{1,2}),?\s+(\d{4})(?:,?\s+(?:at\s+)?"
        + _CLOCK + r"(?:\s*(AM|PM|am|pm))?\s*(" + _ZONE + r")?)?$",
        "$3|$1|$2|$8|$4|$5|$6|$7|$9",
    ),
]

#: Values that are their own normal form as far as their shape goes; they need no rewriting.
_EPOCH = r"^(?:\d{10}(?:[.,]\d+)?|\d{13})$"

_STRIP = r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$"


def _month(text: Column) -> Column:
    names = [x for n, all_names in MONTHS.items() for name in all_names.split() for x in (F.lit(name), F.lit(n))]
    return F.when(text.rlike(r"^\d+$"), text.try_cast("int")).otherwise(F.create_map(*names)[F.lower(text)])


def _days_in_month(year: Column, month: Column) -> Column:
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def _day_number(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01 of a calendar date, in whole-number arithmetic."""
    shifted = year - F.when(month <= 2, 1).otherwise(0)
    era_year = shifted % 400
    era = F.floor(shifted / 400)
    day_of_year = F.floor((153 * (month + F.when(month > 2, -3).otherwise(9)) + 2) / 5) + day - 1
    day_of_era = era_year * 365 + F.floor(era_year / 4) - F.floor(era_year / 100) + day_of_year
    return (era * 146097 + day_of_era - 719468).cast("bigint")


def _utc_text(millis: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS.mmmZ`` of epoch milliseconds, whatever the session's zone; NULL outside the years 1 to 9999."""
    day = F.floor(millis / 86_400_000).cast("int")
    rest = (millis - day.cast("bigint") * 86_400_000).cast("bigint")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    text = F.concat(
        F.date_from_unix_date(day).cast("string"), F.lit("T"),
        two(F.floor(rest / 3_600_000)), F.lit(":"), two(F.floor(rest / 60_000) % 60), F.lit(":"),
        two(F.floor(rest / 1000) % 60), F.lit("."), F.lpad((rest % 1000).cast("string"), 3, "0"), F.lit("Z"),
    )
    return F.when((day >= -719162) & (day <= 2932896), text)


def instant_text(column: str) -> Column:
    """The normal form of a TIMESTAMP column, cut to milliseconds."""
    return _utc_text(F.unix_millis(F.col(column)))


def normalize_times(df: DataFrame, value: str, default_zone: str, out: str = "normal_form") -> DataFrame:
    """Adds ``out``, the normal form of the text in column ``value``, or NULL where it names no real time.

    ``default_zone`` is the column with the IANA zone of wall-clock times; where
    it is NULL or unknown, they are UTC.  Partial dates keep their precision.
    Null, empty and illegible values give NULL; rows are neither lost nor doubled,
    other columns stay as they are, whatever their names (only one named like
    ``out`` is replaced).
    """
    spark: SparkSession = df.sparkSession
    kept = [c for c in df.columns if c != out]
    # The row travels in one column, so no name of its own can clash with those used here.
    df = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_t_row"), F.col(value).alias("_t_value"), F.col(default_zone).alias("_t_default"))
    clean = F.regexp_replace(F.translate(F.col("_t_value"), WIDE, PLAIN), _STRIP, "")
    epoch = F.col("_t_clean").rlike(_EPOCH)
    fields = F.col("_t_clean")
    for pattern, replacement in _FORMS:
        fields = F.regexp_replace(fields, pattern, MARK + replacement.replace("|", MARK))
    part = lambda n: F.nullif(F.get(F.col("_t_f"), F.lit(n)), F.lit(""))
    number = lambda n: part(n).try_cast("int")

    df = df.withColumn("_t_clean", clean)
    df = df.withColumn("_t_f", F.when(epoch, None).otherwise(F.split(fields, MARK)))
    df = df.withColumn("_t_f", F.when(F.size("_t_f") == 10, F.col("_t_f")))
    df = df.withColumns({"_t_y": number(1), "_t_mo": _month(part(2)), "_t_d": number(3), "_t_h": number(5)})
    half = F.lower(part(4))
    hour = (
        F.when(half.isNull(), F.col("_t_h"))
        .when(~F.col("_t_h").between(1, 12), None)
        .otherwise(F.col("_t_h") % 12 + F.when(half.isin("下午", "pm"), 12).otherwise(0))
    )
    df = df.withColumn("_t_h", hour)
    minute, second = number(6), F.coalesce(number(7), F.lit(0))
    millis = F.rpad(F.substring(F.coalesce(part(8), F.lit("")), 1, 3), 3, "0").try_cast("int")

    year, month, day = F.col("_t_y"), F.col("_t_mo"), F.col("_t_d")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    year_text = F.lpad(year.cast("string"), 4, "0")
    real_month = (year >= 1) & (part(2).isNull() | month.between(1, 12))
    real_day = real_month & month.isNotNull() & (day >= 1) & (day <= _days_in_month(year, month))
    real_clock = real_day & F.col("_t_h").between(0, 23) & minute.between(0, 59) & second.between(0, 59)
    partial = (
        F.when(part(3).isNull() & part(2).isNull(), F.when(real_month, year_text))
        .when(part(3).isNull(), F.when(real_month, F.concat_ws("-", year_text, two(month))))
        .when(part(5).isNull(), F.when(real_day, F.concat_ws("-", year_text, two(month), two(day))))
    )
    local = F.when(real_clock, _day_number(year, month, day) * 86400 + F.col("_t_h") * 3600 + minute * 60 + second)

    zone = F.regexp_replace(part(9), r"^(?:GMT|UTC)(?=[+\-])", "")
    signed = F.regexp_extract(zone, r"^([+\-])(\d{2}):?(\d{2})?$", 1)
    offset_minutes = (
        F.regexp_extract(zone, r"^[+\-](\d{2})", 1).try_cast("int") * 60
        + F.coalesce(F.regexp_extract(zone, r"^[+\-]\d{2}:?(\d{2})$", 1).try_cast("int"), F.lit(0))
    ) * F.when(signed == "-", -1).otherwise(1)
    named = F.create_map(*[x for k, v in zones.ABBREVIATIONS.items() for x in (F.lit(k), F.lit(v))])
    fixed = F.when(signed != "", offset_minutes).otherwise(named[F.upper(zone)])
    df = df.withColumns(
        {
            "_t_partial": partial,
            "_t_local": local,
            "_t_ms": millis,
            "_t_fixed": (fixed * 60).cast("bigint"),
            "_t_region": F.when(zone.isNull(), F.coalesce(F.col("_t_default"), F.lit("UTC"))).when(zone.contains("/"), zone),
            "_t_named": zone.isNotNull(),
        }
    )
    # Only wall-clock times look for intervals; a NULL key matches nothing and moves no row.
    df = df.withColumn("_t_key", F.when(F.col("_t_local").isNotNull() & F.col("_t_fixed").isNull(), F.col("_t_region")))
    df = df.withColumn("_t_year", F.when(F.col("_t_key").isNotNull(), zones.bucket_of(F.col("_t_local"))))
    intervals = F.broadcast(
        zones.zone_intervals(spark).select(F.col("zone").alias("_t_zone"), F.col("year").alias("_t_zone_year"), "spans")
    )
    df = df.join(intervals, (F.col("_t_key") == F.col("_t_zone")) & (F.col("_t_year") == F.col("_t_zone_year")), "left")
    matching = F.filter("spans", lambda s: (s[0] <= F.col("_t_local")) & (F.col("_t_local") < s[1]))
    before = F.filter("spans", lambda s: s[0] <= F.col("_t_local"))
    found = F.when(F.size(matching) >= 1, F.get(matching, F.lit(0))[2]).otherwise(F.get(F.reverse(before), F.lit(0))[2])
    offset = F.coalesce(F.col("_t_fixed"), found, F.when(~F.col("_t_named"), F.lit(0)).cast("bigint"))
    clock = _utc_text((F.col("_t_local") - offset) * 1000 + F.col("_t_ms"))
    seconds = F.regexp_extract("_t_clean", r"^(\d+)", 1).try_cast("bigint")
    fraction = F.rpad(F.substring(F.regexp_extract("_t_clean", r"[.,](\d+)$", 1), 1, 3), 3, "0").try_cast("int")
    stamp = _utc_text(F.when(F.col("_t_clean").rlike(r"^\d{13}$"), seconds).otherwise(seconds * 1000 + fraction))
    result = F.when(F.col("_t_clean").rlike(_EPOCH), stamp).otherwise(F.coalesce("_t_partial", clock))
    return df.select("_t_row.*", result.alias(out))


def with_zone(df: DataFrame, connections: DataFrame) -> DataFrame:
    """Adds ``_zone``, the time zone of each row's connection, NULL without one.

    Whether ``connections`` is broadcast is left to Spark, which goes by its size.
    """
    zone = connections.groupBy("connection_id").agg(F.min("time_zone").alias("_zone"))
    return df.join(zone, "connection_id", "left")


def changed_forms(values: DataFrame) -> DataFrame:
    """From (record_key, field_name, value, _zone): distinct rows whose legible value is not its own normal form."""
    # A null value has no form, and one that already has the final shape is its own form or illegible.
    shaped = r"^\d{4}(?:-\d{2}(?:-\d{2}(?:T\d{2}:\d{2}:\d{2}\.\d{3}Z)?)?)?$"
    open_values = values.filter(F.col("value").isNotNull() & ~F.col("value").rlike(shaped))
    done = normalize_times(open_values, "value", "_zone")
    kept = done.filter(F.col("normal_form").isNotNull() & (F.col("normal_form") != F.col("value")))
    return kept.select("record_key", "field_name", "normal_form").distinct()
