"""Column expressions on dates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def calendar_parts(date: Column) -> dict[str, Column]:
    """year, month, weekday (Monday 0) and weekend flag."""
    return {"year": F.year(date), "month": F.month(date), "weekday": F.weekday(date), "is_weekend": (F.weekday(date) >= 5).cast("int")}


def year_month(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def since_flags(month: Column, starts: Mapping[str, str]) -> dict[str, Column]:
    """A 0/1 column for each named month ('YYYY-MM'): 1 from that month on."""
    return {name: (month >= start).cast("int") for name, start in starts.items()}


def minutes_between(start: Column, end: Column) -> Column:
    """Minutes from start to end, with fractions."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(end) - micros(start)) / 6e7


def parse_first(text: Column, formats: tuple[str, ...]) -> Column:
    """The timestamp by the first format that fits, null if none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])
