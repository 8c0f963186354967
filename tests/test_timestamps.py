import zoneinfo
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.functions import zones
from lodestrata.operators import timestamps

CASES = [
    ("2021-02-05T16:33:28.466Z", None, "2021-02-05T16:33:28.466Z"),
    ("2017－04－17 ２０：５６：３９", None, "2017-04-17T20:56:39.000Z"),
    ("2015-09-14 04:50:46", "Asia/Shanghai", "2015-09-13T20:50:46.000Z"),
    ("２０２２－０７－１６", None, "2022-07-16"),
    ("　2018-11-28T17:44:23\xa0", None, "2018-11-28T17:44:23.000Z"),
    ("2016-12-18 02:07:16,700", None, "2016-12-18T02:07:16.700Z"),
    ("2019-11-28T18:39:42.230999Z", None, "2019-11-28T18:39:42.230Z"),
    ("20180519T144147Z", None, "2018-05-19T14:41:47.000Z"),
    ("20161106015247", "UTC", "2016-11-06T01:52:47.000Z"),
    ("1632966984", "Asia/Tokyo", "2021-09-30T01:56:24.000Z"),
    ("1647589320.8679", None, "2022-03-18T07:42:00.867Z"),
    ("1490022811956", None, "2017-03-20T15:13:31.956Z"),
    ("2017", None, "2017"),
    ("2015年", None, "2015"),
    ("2017年9月", None, "2017-09"),
    ("2016/7/3", None, "2016-07-03"),
    ("2015.09.18", None, "2015-09-18"),
    ("14 Apr 2019", None, "2019-04-14"),
    ("2019年4月22日 下午6:32", None, "2019-04-22T18:32:00.000Z"),
    ("2019年4月22日 上午12:32", None, "2019-04-22T00:32:00.000Z"),
    ("Mar 28, 2018 12:15 AM", None, "2018-03-28T00:15:00.000Z"),
    ("Mar 28, 2018 9:15 PM", None, "2018-03-28T21:15:00.000Z"),
    ("Wed, 7 Jun 2023 14:07:49 CET", None, "2023-06-07T13:07:49.000Z"),
    ("Fri, 12 Jul 2019 04:25:15 EST", None, "2019-07-12T09:25:15.000Z"),
    ("Mon, 02 Nov 2020 08:53:14 -0330", None, "2020-11-02T12:23:14.000Z"),
    ("25. Januar 2018 um 18:39", "Europe/Berlin", "2018-01-25T17:39:00.000Z"),
    ("28. März 2016 01:26", None, "2016-03-28T01:26:00.000Z"),
    ("24 janvier 2019 à 4h08", None, "2019-01-24T04:08:00.000Z"),
    ("29 octobre 2017 1h57", None, "2017-10-29T01:57:00.000Z"),
    ("28.11.2022 13:15", None, "2022-11-28T13:15:00.000Z"),
    ("2022-11-06 02:25:25 America/Los_Angeles", None, "2022-11-06T10:25:25.000Z"),
    ("2020-11-15T06:45:06[Australia/Sydney]", None, "2020-11-14T19:45:06.000Z"),
    ("2017-02-28T22:31:47-07", None, "2017-03-01T05:31:47.000Z"),
    ("2022-08-02T11:01:30+0545", None, "2022-08-02T05:16:30.000Z"),
    ("2016-09-18T18:24:28z", None, "2016-09-18T18:24:28.000Z"),
    # Twice, never, and far away.
    ("2021-10-31 02:30", "Europe/Berlin", "2021-10-31T00:30:00.000Z"),
    ("2021-03-28 02:30", "Europe/Berlin", "2021-03-28T01:30:00.000Z"),
    ("1899-01-01 00:00", "UTC", "1899-01-01T00:00:00.000Z"),
    ("2400-07-01 12:00", "Asia/Shanghai", "2400-07-01T04:00:00.000Z"),
    # No real time.
    ("2020-13-07 08:15:00", None, None),
    ("2023-02-29T10:00:00Z", None, None),
    ("2019-00-10", None, None),
    ("0000-00-00 00:00:00", None, None),
    ("2021-02-03 25:00", None, None),
    ("Wed, 7 Jun 2023 14:07:49 QQT", None, None),
    ("去年冬天", None, None),
    ("n/a", None, None),
    ("-", None, None),
    ("", None, None),
    (None, None, None),
    ("x" * 100_000, None, None),
]


def normal(spark, rows):
    df = spark.createDataFrame([(i, v, z) for i, (v, z) in enumerate(rows)], "n int, v string, z string")
    return [r.f for r in timestamps.normalize_times(df, "v", "z", "f").orderBy("n").collect()]


def test_notations(spark):
    assert normal(spark, [c[:2] for c in CASES]) == [c[2] for c in CASES]


def test_names_cannot_clash(spark):
    df = spark.createDataFrame([("2015年", "x", 1, 2)], "v string, spans string, _t_y int, zone int")
    row = timestamps.normalize_times(df.selectExpr("*", "cast(null as string) as year"), "v", "year").head()
    assert row.asDict() == {"v": "2015年", "spans": "x", "_t_y": 1, "zone": 2, "year": None, "normal_form": "2015"}


def test_empty_table(spark):
    assert normal(spark, []) == []


def test_repeated_rows_give_one_case(spark):
    rows = [("a", "f", "2015年", None)] * 3 + [("b", "f", "2015", None), ("c", "f", None, None)]
    got = timestamps.changed_forms(spark.createDataFrame(rows, "record_key string, field_name string, value string, _zone string")).collect()
    assert [tuple(r) for r in got] == [("a", "f", "2015")]


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(["Europe/London", "America/New_York", "Australia/Lord_Howe", "Africa/Casablanca", "Asia/Kathmandu"]), st.datetimes(datetime(1950, 1, 1), datetime(2090, 1, 1)))
def test_intervals_agree_with_zoneinfo(zone, moment):
    """Offset before the change where a wall-clock time occurs twice or never."""
    t = int((moment - datetime(1970, 1, 1)) / timedelta(seconds=1))
    spans = zones.intervals_of(zone)
    inside = [s for s in spans if s[0] <= t < s[1]]
    offset = inside[0][2] if inside else [s for s in spans if s[0] <= t][-1][2]
    assert offset == moment.replace(tzinfo=zoneinfo.ZoneInfo(zone), fold=0).utcoffset().total_seconds()


@pytest.mark.parametrize("zone", ["UTC", "Asia/Shanghai", "Europe/Berlin"])
def test_bucket_edges(spark, zone):
    rows = [(f"{y}-{d} 00:30:00", zone) for y in (1899, 1900, 1909, 1910, 1999, 2000, 2089, 2090) for d in ("01-01", "12-31")]
    expected = []
    for v, z in rows:
        local = datetime.fromisoformat(v)
        utc = local - local.replace(tzinfo=zoneinfo.ZoneInfo(z)).utcoffset()
        expected.append(utc.strftime("%Y-%m-%dT%H:%M:%S.000Z"))
    assert normal(spark, rows) == expected
