import datetime as dt
from zoneinfo import ZoneInfo

import pytest

from shelfmark.functions.timestamps import normalize_timestamps, published_instants


def micros(*parts, zone="UTC", us=0):
    at = dt.datetime(*parts, tzinfo=ZoneInfo(zone)) - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    return (at.days * 86400 + at.seconds) * 10**6 + us


NY, KTM = "America/New_York", "Asia/Kathmandu"
CASES = [
    ("2024-03-05T22:50:38Z", NY, "mdy", micros(2024, 3, 5, 22, 50, 38)),
    ("20130221T123006Z", NY, "mdy", micros(2013, 2, 21, 12, 30, 6)),
    ("20090129 161342", "UTC", "dmy", micros(2009, 1, 29, 16, 13, 42)),
    ("07/21/11", "UTC", "mdy", micros(2011, 7, 21)),
    ("21/07/11", "UTC", "dmy", micros(2011, 7, 21)),
    ("07/21/11", "UTC", "dmy", None),
    ("1373934692784252", NY, "mdy", 1373934692784252),
    ("1655790182", NY, "mdy", 1655790182 * 10**6),
    ("1270611003000", NY, "mdy", 1270611003000 * 10**3),
    ("2011-09-04T21:42:03.000000996Z", NY, "mdy", micros(2011, 9, 4, 21, 42, 3)),
    ("2011-12-28 18:50:03,877", "UTC", "dmy", micros(2011, 12, 28, 18, 50, 3, us=877000)),
    ("Saturday, September 7th, 2024 at 6:53 AM", NY, "mdy", micros(2024, 9, 7, 6, 53, zone=NY)),
    ("Mar 27, 2022 1:58 AM EDT", "UTC", "dmy", micros(2022, 3, 27, 5, 58)),
    ("27 July 2021, 09:50 (BST)", "UTC", "dmy", micros(2021, 7, 27, 8, 50)),
    ("2015-02-10T09:26:42-05:00[America/New_York]", "UTC", "dmy", micros(2015, 2, 10, 14, 26, 42)),
    ("2016-03-27 00:51:53 America/New_York", "UTC", "dmy", micros(2016, 3, 27, 0, 51, 53, zone=NY)),
    ("18 May 2023, 07:06 (UTC+05:45)", "UTC", "dmy", micros(2023, 5, 18, 7, 6, zone=KTM)),
    ("8. August 2023, 04:12 Uhr", "UTC", "dmy", micros(2023, 8, 8, 4, 12)),
    ("4 janvier 2011 à 14h01", "UTC", "dmy", micros(2011, 1, 4, 14, 1)),
    ("2017-W16-2", "UTC", "dmy", micros(2017, 4, 18)),
    ("2015-W53-5", "UTC", "dmy", micros(2016, 1, 1)),
    ("2017-W53-1", "UTC", "dmy", None),
    ("2016-366", "UTC", "dmy", micros(2016, 12, 31)),
    ("2015-366", "UTC", "dmy", None),
    (" Published: 23.04.2014 20:49\t", "UTC", "dmy", micros(2014, 4, 23, 20, 49)),
    ("11/8/2011 12:05 am", "UTC", "mdy", micros(2011, 11, 8, 0, 5)),
    ("11/8/2011 13:05 am", "UTC", "mdy", None),
    # the clock goes back: the earlier instant; it goes forward: on by the gap
    ("2012-11-04 01:30:00", NY, "mdy", micros(2012, 11, 4, 5, 30)),
    ("2012-03-11 02:30:00", NY, "mdy", micros(2012, 3, 11, 7, 30)),
    ("2024-02-30", "UTC", "dmy", None), ("0000-00-00 00:00:00", "UTC", "dmy", None), ("2022-09-31T08:00:00+02:00", "UTC", "dmy", None),
    ("2022-09-30T25:00:00", "UTC", "dmy", None), ("spring 2012", "UTC", "dmy", None), ("circa 2015", "UTC", "dmy", None), ("n.d.", "UTC", "dmy", None),
    ("", "UTC", "dmy", None), (None, "UTC", "dmy", None), ("   ", "UTC", "dmy", None), ("2012-01-01", None, None, None), ("2012-01-01", "Mars/Base", "dmy", None),
    ("2012-01-01T00:00:00Z", None, None, micros(2012, 1, 1)), ("9" * 100_000, "UTC", "dmy", None),
]


def test_every_notation(spark):
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, v string, z string, o string, want long")
    got = {r.i: r.us for r in normalize_timestamps(rows, "v", "z", "o", "us").collect()}
    wrong = [(c, got[i]) for i, c in enumerate(CASES) if got[i] != c[3]]
    assert not wrong


def test_white_space_does_not_count_as_length(spark):
    stamp = "2012-01-01T00:00:00Z"
    cases = [(" " * 200 + stamp, True), (stamp + "\n" * 300, True), ("\u00a0\u200b" * 200 + stamp + " \t" * 50_000, True), (" " * 300 + "x" * 200, False), ("Published:" + " " * 150 + stamp, True), ("Published:" + " " * 300 + stamp, True), ("x" + " " * 100_000 + "x", False)]
    rows = spark.createDataFrame([(i, v, "UTC", "dmy") for i, (v, _) in enumerate(cases)], "i int, v string, z string, o string")
    got = {r.i: r.us for r in normalize_timestamps(rows, "v", "z", "o", "us").collect()}
    assert got == {i: micros(2012, 1, 1) if good else None for i, (_, good) in enumerate(cases)}


def test_tables_with_nulls_copies_and_clashing_names(spark):
    pages = spark.createDataFrame([(1, "a", "2012-01-01", "x"), (1, "a", "2012-01-01", "y"), (2, "b", "2012-01-01", "x"), (None, "a", "2012-01-01", "x"), (3, None, "2012-01-01Z", "x"), (4, "a", None, "x")], "page_id long, source string, published string, tz string")
    sites = spark.createDataFrame([("a", "UTC", "dmy", 1), ("a", "UTC", "dmy", 2)], "source string, tz string, date_order string, published int")
    assert sorted(map(tuple, published_instants(pages, sites).collect())) == [(1, micros(2012, 1, 1)), (3, micros(2012, 1, 1))]
    assert published_instants(pages.limit(0), sites.limit(0)).count() == 0


def test_plan_stays_in_the_engine(spark):
    pages = spark.createDataFrame([(1, "a", "2012-01-01")], "page_id long, source string, published string")
    sites = spark.createDataFrame([("a", "UTC", "dmy")], "source string, tz string, date_order string")
    plan = published_instants(pages, sites)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("zone", ["Europe/Berlin", "Australia/Sydney", "America/Los_Angeles"])
def test_hours_of_a_year_agree_with_the_zone_database(spark, zone):
    start = dt.datetime(2021, 1, 1)
    hours = [start + dt.timedelta(hours=h) for h in range(0, 365 * 24, 7)]
    rows = spark.createDataFrame([(i, h.strftime("%Y-%m-%d %H:%M:%S"), zone, "dmy") for i, h in enumerate(hours)], "i int, v string, z string, o string")
    got = {r.i: r.us for r in normalize_timestamps(rows, "v", "z", "o", "us").collect()}
    for i, h in enumerate(hours):
        assert got[i] == micros(h.year, h.month, h.day, h.hour, zone=zone)
