from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest

from leafmill.operators import timestamps as ts

CASES = [
    ("2024-05-06T07:08:09Z", None, "2024-05-06T07:08:09.000000Z"),
    ("2024-05-06t07:08:09.123456789z", None, "2024-05-06T07:08:09.123456Z"),
    ("2024-05-06 07:08:09+02", None, "2024-05-06T05:08:09.000000Z"),
    ("2024-05-06 07:08:09 -0430", None, "2024-05-06T11:38:09.000000Z"),
    ("2024-05-06T07:08:09+02:00[Europe/Berlin]", "UTC", "2024-05-06T05:08:09.000000Z"),
    ("2024-05-06T07:08:09 America/New_York", None, "2024-05-06T11:08:09.000000Z"),
    ("Sun, 21 May 2023 01:45:40 +0200 (CEST)", None, "2023-05-20T23:45:40.000000Z"),
    ("Tue Sep  3 13:53:00 CEST 2019", None, "2019-09-03T11:53:00.000000Z"),
    ("6.5.24 7:08", None, "2024-05-06T05:08:00.000000Z"),
    ("Mo., 6. März 2023, 23:50:13", "UTC", "2023-03-06T23:50:13.000000Z"),
    ("29.3.2021, 02:49 Uhr", "UTC", "2021-03-29T02:49:00.000000Z"),
    ("02/08/2024 1:48 PM", "UTC", "2024-02-08T13:48:00.000000Z"),
    ("12/31/2024 12:00 AM", "UTC", "2024-12-31T00:00:00.000000Z"),
    ("2021/06/13 07:43:30", "UTC", "2021-06-13T07:43:30.000000Z"),
    ("Mar 17, 2018 10:11 PM PDT", None, "2018-03-18T05:11:00.000000Z"),
    ("February 10, 2024 at 1:08 AM", "Asia/Kolkata", "2024-02-09T19:38:00.000000Z"),
    ("20240611T010203", "UTC", "2024-06-11T01:02:03.000000Z"),
    ("20240611T010203Z", "Asia/Tokyo", "2024-06-11T01:02:03.000000Z"),
    ("1651312235", None, "2022-04-30T09:50:35.000000Z"),
    ("1651312235123", None, "2022-04-30T09:50:35.123000Z"),
    ("1651312235123456", None, "2022-04-30T09:50:35.123456Z"),
    ("2024-05-06", None, "2024-05-05T22:00:00.000000Z"),
    ("  2024-05-06  ", "Not/AZone", "2024-05-05T22:00:00.000000Z"),
    # A time that occurs twice means the first, one that is skipped takes the offset before.
    ("27.10.2024 02:30", "Europe/Zurich", "2024-10-27T00:30:00.000000Z"),
    ("31.03.2024 02:30", "Europe/Zurich", "2024-03-31T01:30:00.000000Z"),
    ("2024-11-03 01:30:00", "America/New_York", "2024-11-03T05:30:00.000000Z"),
    ("2024-03-10 02:30:00", "America/New_York", "2024-03-10T07:30:00.000000Z"),
]
NONE = ["", " ", "unknown", "gestern", "tbd", "n/a", "-", "2026-02-30T10:00:00Z", "31.11.2025 09:15", "2025-13-05", "13/40/2024 10:00 AM", "0000-00-00 00:00:00", "2024-05-06 25:00", "2024-05-06 10:60", "5:08 PM", "2024-05-06 13:00 PM", "2024-05-06T07:08:09 Not/AZone", "x" * 5000]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = spark.createDataFrame([(r, z) for r, z, _ in CASES] + [(r, None) for r in NONE] + [(None, None)], "raw string, zone string")
    return {(r.raw, r.zone): r.utc for r in ts.with_utc(rows).collect()}


@pytest.mark.parametrize("raw,zone,expected", CASES)
def test_instants(parsed, raw, zone, expected):
    assert parsed[(raw, zone)] == expected


@pytest.mark.parametrize("raw", [*NONE, None])
def test_no_instants(parsed, raw):
    assert parsed[(raw, None)] is None


def test_local_times_against_zoneinfo(spark):
    zones = ["Europe/Zurich", "America/New_York", "Australia/Sydney", "Asia/Kolkata", "Europe/London"]
    hours = [datetime(2023, m, d, h, 17) for m, d in ((3, 12), (3, 26), (4, 2), (10, 1), (10, 29), (11, 5)) for h in range(24)]
    rows = [(t.strftime("%Y-%m-%d %H:%M:%S"), z) for t in hours for z in zones]
    got = ts.with_utc(spark.createDataFrame(rows, "raw string, zone string")).collect()
    for r in got:
        local = datetime.strptime(r.raw, "%Y-%m-%d %H:%M:%S").replace(tzinfo=ZoneInfo(r.zone))
        assert r.utc == local.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.000000Z"), r


def test_rows_keep_repeats_and_other_columns(spark):
    rows = spark.createDataFrame([("t", 1, None, "2024-05-06", "x")] * 3 + [("t", 2, None, "unknown", "y"), ("t", 3, None, None, "z")], "src string, row_key long, zone string, raw string, n string")
    found = ts.normalise(rows)
    assert found.columns == ["src", "row_key", "zone", "raw", "n", "utc"]
    assert [(r.row_key, r.n) for r in found.collect()] == [(1, "x")] * 3


def test_hot_and_cold_strings(spark):
    rows = spark.range(3000).selectExpr("'t' AS src", "id AS row_key", "CAST(NULL AS STRING) AS zone", "CASE WHEN id % 3 = 0 THEN '2024-05-06' ELSE concat(1600000000 + id, '') END AS raw")
    found = ts.normalise(rows).collect()
    assert len(found) == 3000 and {r.row_key for r in found} == set(range(3000))
    assert {r.utc for r in found if r.row_key % 3 == 0} == {"2024-05-05T22:00:00.000000Z"}


def test_empty_table(spark):
    assert ts.normalise(spark.createDataFrame([], "src string, row_key long, zone string, raw string")).count() == 0


def test_dictionary_grows_and_parses_only_new(spark, tmp_path):
    book = ts.TimestampDictionary(spark, f"file://{tmp_path}/book")
    make = lambda *raws: spark.createDataFrame([("t", i, "UTC", r) for i, r in enumerate(raws)], "src string, row_key long, zone string, raw string")
    assert ts.normalise(make("2024-05-06", "2024-05-07"), book).count() == 2
    assert book.read().count() == 2
    again = ts.normalise(make("2024-05-06", "2024-05-08", "2024-05-08"), book)
    assert sorted(r.utc[:10] for r in again.collect()) == ["2024-05-06", "2024-05-08", "2024-05-08"]
    assert book.read().count() == 3


def test_kept_dictionary_serves_the_query(spark, data, tmp_path):
    from leafmill.queries import general

    first = sorted(map(tuple, general.p3_found(spark, data).collect()))
    kept = f"file://{tmp_path}/dictionary"
    spark.conf.set(general.KEPT_DICTIONARY, kept)
    try:
        assert sorted(map(tuple, general.p3_found(spark, data).collect())) == first
        size = spark.read.parquet(kept).count()
        # The second run finds all texts there and adds none.
        assert sorted(map(tuple, general.p3_found(spark, data).collect())) == first and spark.read.parquet(kept).count() == size > 0
    finally:
        spark.conf.unset(general.KEPT_DICTIONARY)
