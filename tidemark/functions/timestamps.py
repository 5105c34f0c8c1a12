"""Timestamps of many spellings, precisions and zones, as one instant in UTC milliseconds.

Every spelling is one branch of a single regular expression with named groups. One replacement per value writes all
groups, in a fixed order, into one delimited text, so that the expression runs once however many parts are read from it.
The parts are checked against the calendar and put together by integer arithmetic on days; only wall-clock times of named
zones consult zone rules. All of it is built-in expressions inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Months in English, and zone abbreviations with their offsets in minutes.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH_NAMES = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "SAST": 120, "CAT": 120, "EAT": 180, "WAT": 60, "MSK": 180, "SGT": 480, "HKT": 480, "PHT": 480, "AWST": 480, "JST": 540,
    "KST": 540, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240,
    "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}

_PARTS = ("mark", "year", "month", "day", "name", "first", "sep", "second", "hour", "minute", "sec", "frac", "half", "offset", "zone", "epoch")
_BLANK = r"[\s  -​ 　﻿]"
_NAMES = "|".join(f"{m}|{s}" if m != s else m for m, s in zip(MONTH_NAMES, MONTHS, strict=True)) + "|sept"
_DAYNAME = r"(?:(?:mon|tue|tues|wed|wednes|thu|thur|thurs|fri|sat|satur|sun)(?:day)?\.?,?_+)?"
PATTERN = (
    r"(?i)^_*(?:"
    r"(?:"
    r"(?:(?<y1>\d{4})(?<s1>[-/.])(?<m1>\d{1,2})\k<s1>(?<d1>\d{1,2})"
    r"|(?<a>\d{1,2})(?<s2>[-/.])(?<b>\d{1,2})\k<s2>(?<y2>\d{4})"
    r"|" + _DAYNAME + r"(?<d3>\d{1,2})(?:st|nd|rd|th)?[\s-]+(?<n3>NAMES)\.?,?[\s-]+(?<y3>\d{4})"
    r"|" + _DAYNAME + r"(?<n4>NAMES)\.?_+(?<d4>\d{1,2})(?:st|nd|rd|th)?,?_+(?<y4>\d{4}))"
    r"(?:t|,?_+(?:at_+)?)(?<h1>\d{1,2}):(?<i1>\d{2})(?::(?<e1>\d{2})(?:[.,](?<f1>\d{1,9}))?)?_*(?<p1>[ap]\.?m\b\.?)?"
    r"|(?<y5>\d{4})(?<m5>\d{2})(?<d5>\d{2})(?:t|_)(?<h5>\d{2}):?(?<i5>\d{2})(?::?(?<e5>\d{2})(?:[.,](?<f5>\d{1,9}))?)?"
    r")_*(?:(?:utc|gmt)?_*(?<o>[+\-−]\d{1,2}(?::?\d{2})?))?_*\[?(?<z>[a-z][a-z0-9_+\-]*(?:/[a-z0-9_+\-]+)*)?\]?"
    r"|(?<epoch>[+-]?\d{1,16}(?:\.\d{1,9})?)"
    r")_*$"
)
PATTERN = PATTERN.replace("NAMES", _NAMES).replace(r"[a-z0-9_+\-]", r"[a-z0-9\x5f+\-]").replace("_", _BLANK)
_OUT = "\u0001".join(
    ("\u0002", "${y1}${y2}${y3}${y4}${y5}", "${m1}${m5}", "${d1}${d3}${d4}${d5}", "${n3}${n4}", "${a}", "${s2}", "${b}", "${h1}${h5}", "${i1}${i5}", "${e1}${e5}", "${f1}${f5}", "${p1}", "${o}", "${z}", "${epoch}")
)


def known_zones(spark: SparkSession) -> list[str]:
    """Names of the zones whose rules the JVM holds (some hundred)."""
    try:
        return sorted(spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds())
    except Exception:  # no JVM gateway, as over Spark Connect
        import zoneinfo

        return sorted(zoneinfo.available_timezones())


def days_from_civil(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01 of a Gregorian date, by integer arithmetic: years start in March, leap days come last."""
    y = year - F.when(month <= 2, 1).otherwise(0)
    m = F.pmod(month + F.lit(9), F.lit(12))
    within = F.floor((m * 153 + 2) / 5) + day - 1
    return (y * 365 + F.floor(y / 4) - F.floor(y / 100) + F.floor(y / 400) + within - F.lit(719468)).cast("long")


def _month_length(year: Column, month: Column) -> Column:
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def _apart(x: Column) -> Column:
    """``x`` itself, through a higher-order function: a projection that has one is compiled to several small methods instead of
    becoming part of one large method, which the JVM would leave interpreted.
    """
    return F.get(F.transform(F.array(x), lambda v: v), F.lit(0))


def with_instant(df: DataFrame, text: str, zone: str | None, order: str | None, out: str, default_zone: str = "UTC") -> DataFrame:
    """``df`` with column ``out``: UTC milliseconds (bigint) of the timestamp text in column ``text``, or null.

    ``zone``: column with the IANA zone of texts that name none; ``order``: column with 'MDY' or 'DMY' for numeric dates
    whose year is not first (dates with dots are day first). Without these columns: ``default_zone`` and day first.
    A wall time that occurs twice is its earlier instant; one that is skipped is read with the offset before the change.
    Bare numbers of 9 to 11 digits count seconds, those of 12 to 14 digits milliseconds, since 1970. Missing seconds are 0,
    digits beyond milliseconds are cut. Null for null, empty and unreadable texts, dates or times that do not exist
    (hour 24 and second 60 included), unknown zones, and texts that name no zone where the zone column is null or unknown.
    Other columns stay as they are; the helper columns have names that ``df`` does not use.
    """
    taken = {c.lower() for c in df.columns}
    prefix = "_ts"
    while any(c.startswith(prefix) for c in taken):
        prefix += "_"
    p, c = f"{prefix}p", f"{prefix}c"
    part = lambda name: F.get(F.col(p), F.lit(_PARTS.index(name)))
    number = lambda x: F.when(x != "", x.try_cast("int"))  # noqa: E731  (a failing cast costs an exception)
    zones = known_zones(df.sparkSession)
    source = F.col(f"`{text}`")
    order_value = F.upper(F.trim(F.col(f"`{order}`"))) if order else F.lit("DMY")
    zone_value = F.trim(F.col(f"`{zone}`")) if zone else F.lit(default_zone)

    df = df.withColumn(p, F.split(F.regexp_replace(source, PATTERN, _OUT), "\u0001"))
    named = F.lower(F.substring(part("name"), 1, 3))
    month_of_name = F.when(named != "", ((F.instr(F.lit("".join(MONTHS)), named) + 2) / 3).cast("int"))
    day_first = (part("sep") == ".") | (order_value == "DMY")
    first, second = number(part("first")), number(part("second"))
    half = F.lower(F.substring(part("half"), 1, 1))
    hour = number(part("hour"))
    offset = F.replace(part("offset"), F.lit("−"), F.lit("-"))
    digits = F.regexp_replace(offset, "[^0-9]", "")
    digits = F.when(F.length(digits) <= 2, F.concat(digits, F.lit("00"))).otherwise(digits)
    offset_minutes = F.floor(number(digits) / 100) * 60 + number(digits) % 100
    df = df.withColumn(
        c,
        F.when(
            (part("mark") == "\u0002"),
            F.struct(
                number(part("year")).alias("y"),
                F.coalesce(number(part("month")), month_of_name, F.when(day_first, second).when(order_value == "MDY", first)).alias("m"),
                F.coalesce(number(part("day")), F.when(day_first, first).when(order_value == "MDY", second)).alias("d"),
                F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0)).alias("h"),
                number(part("minute")).alias("i"),
                F.when(part("sec") == "", 0).otherwise(number(part("sec"))).alias("s"),
                number(F.substring(F.concat(part("frac"), F.lit("000")), 1, 3)).alias("f"),
                F.when(offset != "", F.when(F.startswith(offset, F.lit("-")), -offset_minutes).otherwise(offset_minutes)).alias("o"),
                part("zone").alias("z"),
                _apart(part("epoch")).alias("e"),
            ),
        ),
    )
    of = lambda name: F.col(f"{c}.{name}")
    exists = of("m").between(1, 12) & (of("y") >= 1) & (of("d") >= 1) & (of("d") <= _month_length(of("y"), of("m"))) & of("h").between(0, 23) & of("i").between(0, 59) & of("s").between(0, 59)
    wall = days_from_civil(of("y"), of("m"), of("d")) * F.lit(86_400_000) + (of("h") * 3_600_000 + of("i") * 60_000 + of("s") * 1000 + of("f")).cast("long")
    fixed = F.element_at(F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair]), F.upper(of("z")))
    rule = F.when(of("z") == "", zone_value).otherwise(of("z"))
    whole = F.length(F.regexp_replace(F.regexp_replace(of("e"), r"\..*$", ""), "[^0-9]", ""))
    epoch = F.when(whole.between(9, 11), F.floor(of("e").try_cast("decimal(28,9)") * 1000)).when(whole.between(12, 14), F.floor(of("e").try_cast("decimal(28,9)")))
    df = df.withColumn(f"{prefix}w", F.when(exists, wall))
    wall = F.col(f"{prefix}w")
    ruled = F.when(rule.isin(zones), F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(wall), rule)))
    instant = F.when(of("e") != "", epoch.cast("long")).when(of("o").isNotNull(), F.when(F.abs(of("o")) <= 1080, wall - of("o") * 60_000)).when((of("z") != "") & fixed.isNotNull(), wall - fixed * 60_000).otherwise(ruled)
    kept = [f"`{x}`" for x in df.columns if x not in (p, c, f"{prefix}w", out)]
    df = df.select(*kept, _apart(instant.cast("long")).alias(f"{prefix}i"))
    # One generated row each: a filter on the result must not be pushed below, where it would repeat the whole expression.
    return df.select(*kept, F.explode(F.array(f"{prefix}i")).alias(out))
