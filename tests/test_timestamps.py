from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.functions.timestamps import with_instant

UTC = timezone.utc


def ms(*parts, zone="UTC", micro=0, fold=0):
    return int(datetime(*parts, tzinfo=ZoneInfo(zone), fold=fold).astimezone(UTC).timestamp()) * 1000 + micro // 1000


CASES = [
    ("2024-07-02 06:53:00", "America/New_York", "MDY", ms(2024, 7, 2, 6, 53, zone="America/New_York")),
    ("2024/07/02 21:05", "Asia/Singapore", "MDY", ms(2024, 7, 2, 21, 5, zone="Asia/Singapore")),
    ("03/04/2024 07:20", "UTC", "DMY", ms(2024, 4, 3, 7, 20)),
    ("03/04/2024 07:20", "UTC", "MDY", ms(2024, 3, 4, 7, 20)),
    ("03.04.2024 07:20", "UTC", "MDY", ms(2024, 4, 3, 7, 20)),
    ("8/4/2024 12:57 am", "UTC", "MDY", ms(2024, 8, 4, 0, 57)),
    ("8/4/2024 12:57 pm", "UTC", "MDY", ms(2024, 8, 4, 12, 57)),
    ("08-17-2024 01:27:00 AM", "UTC", "MDY", ms(2024, 8, 17, 1, 27)),
    ("July 03, 2024 02:01PM", "Europe/London", "DMY", ms(2024, 7, 3, 14, 1, zone="Europe/London")),
    ("3 Jul 2024 19:24", "UTC", "MDY", ms(2024, 7, 3, 19, 24)),
    ("Sat, 06 Jul 2024 05:33:47 +0800", "UTC", "MDY", ms(2024, 7, 5, 21, 33, 47)),
    ("20240703T122551", "UTC", "MDY", ms(2024, 7, 3, 12, 25, 51)),
    ("2024-07-02T11:02:59.616999", "UTC", "MDY", ms(2024, 7, 2, 11, 2, 59) + 616),
    ("  2024-07-02T09:45:41.722Z ", "Asia/Singapore", "DMY", ms(2024, 7, 2, 9, 45, 41) + 722),
    ("2024-07-04 20:32 GMT+10:00", "UTC", "DMY", ms(2024, 7, 4, 10, 32)),
    ("2024-07-03 04:32 UTC-04:30", "UTC", "DMY", ms(2024, 7, 3, 9, 2)),
    ("2024-07-07 00:04:00 Asia/Singapore", "UTC", "DMY", ms(2024, 7, 6, 16, 4)),
    ("2024-07-04T09:50:00+08:00[Asia/Singapore]", "UTC", "DMY", ms(2024, 7, 4, 1, 50)),
    ("2024-10-27 01:03:52 +00:00 Europe/London", "UTC", "DMY", ms(2024, 10, 27, 1, 3, 52)),
    ("2024-11-03 02:40:00 EST", "UTC", "DMY", ms(2024, 11, 3, 7, 40)),
    ("1719990180", "Asia/Singapore", "DMY", 1719990180000),
    ("1719896460123", "Asia/Singapore", "DMY", 1719896460123),
    ("2024-10-27 01:30:00", "Europe/London", "DMY", ms(2024, 10, 27, 0, 30)),  # twice: the earlier
    ("2024-03-31 01:30:00", "Europe/London", "DMY", ms(2024, 3, 31, 1, 30)),  # skipped: the offset before
    ("2024-02-29 10:00", "UTC", "DMY", ms(2024, 2, 29, 10, 0)),
    ("2023-02-29 10:00", "UTC", "DMY", None),
    ("2025-13-04 09:00", "UTC", "DMY", None),
    ("2024-07-02 24:00:00", "UTC", "DMY", None),
    ("2024-07-02 10:00:60", "UTC", "DMY", None),
    ("8/4/2024 13:57 am", "UTC", "MDY", None),
    ("2024-07-02 10:00 Europe/Atlantis", "UTC", "DMY", None),
    ("2024-07-02 10:00", None, "DMY", None),
    ("2024-07-02 10:00", "Nowhere/At_All", "DMY", None),
    ("03/04/2024 07:20", "UTC", None, None),
    ("2024-07-02", "UTC", "DMY", None),
    ("10:45", "UTC", "DMY", None),
    ("", "UTC", "DMY", None),
    ("   ", "UTC", "DMY", None),
    (None, "UTC", "DMY", None),
    ("see roster", "UTC", "DMY", None),
    ("2" * 100_000, "UTC", "DMY", None),
    ("2024-07-02 " + " " * 50_000 + "x", "UTC", "DMY", None),
]


def test_spellings(spark):
    df = spark.createDataFrame([(k, *c[:3], "kept", 1) for k, c in enumerate(CASES)], "k int, t string, z string, o string, _tsp string, _tsc int")
    out = with_instant(df, "t", "z", "o", "ms")
    assert out.columns == [*df.columns, "ms"]
    got = {r.k: r.ms for r in out.collect()}
    wrong = [(c[0] and c[0][:60], got[k], c[3]) for k, c in enumerate(CASES) if got[k] != c[3]]
    assert not wrong


def test_filter_on_result_and_overwritten_column(spark):
    df = spark.createDataFrame([("2024-07-02 10:00:00Z", 1), ("x", 2), ("x", 2)], "t string, ms int")
    out = with_instant(df, "t", None, None, "ms")
    assert out.columns == ["t", "ms"]
    assert [r.ms for r in out.where("ms is not null").collect()] == [ms(2024, 7, 2, 10, 0)]
    assert with_instant(df.limit(0), "t", None, None, "ms").count() == 0


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.datetimes(datetime(1971, 1, 1), datetime(2037, 1, 1)), min_size=40, max_size=60), st.sampled_from(["Europe/Berlin", "Australia/Sydney", "America/New_York", "Asia/Kathmandu"]))
def test_against_zoneinfo(spark, times, zone):
    rows = [(k, t.strftime("%Y-%m-%d %H:%M:%S.") + f"{t.microsecond:06d}") for k, t in enumerate(times)]
    got = {r.k: r.ms for r in with_instant(spark.createDataFrame(rows, "k int, t string"), "t", None, None, "ms", default_zone=zone).collect()}
    epoch = datetime(1970, 1, 1, tzinfo=UTC)
    for k, t in enumerate(times):
        delta = t.replace(tzinfo=ZoneInfo(zone)).astimezone(UTC) - epoch
        assert got[k] == delta.days * 86_400_000 + delta.seconds * 1000 + delta.microseconds // 1000


def test_days_far_away(spark):
    got = with_instant(spark.createDataFrame([("0001-01-01T00:00Z",), ("9999-12-31T23:59Z",), ("1600-03-01T00:00Z",)], "t string"), "t", None, None, "ms").collect()
    expected = [(datetime(*p, tzinfo=UTC) - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds() * 1000 for p in ((1, 1, 1), (9999, 12, 31, 23, 59), (1600, 3, 1))]
    assert [r.ms for r in got] == pytest.approx(expected, abs=0)
