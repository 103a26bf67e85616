import datetime as dt
import zoneinfo

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quernstone.functions.zones import all_zones, tz_version, zone_table
from quernstone.operators import timestamps as ts

ZONES = ["America/New_York", "Europe/London", "Australia/Sydney", "Asia/Kolkata", "America/Phoenix"]


def convert(value, order="MDY", zone="America/New_York", old=False, instant=False):
    micros, ok = ts.Converter(all_zones()[1]).convert([value], [order], [zone], np.array([old]), instant)
    if not ok[0]:
        return None
    stamp = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=int(micros[0]))
    return stamp.isoformat(timespec="microseconds") + "Z" if instant else stamp.date().isoformat()


def test_dates():
    cases = {
        "2021/03/04": "2021-03-04", "Fri September 12th, 2025": "2025-09-12", "16 de enero de 2022": "2022-01-16", "44634": "2022-03-14", "2023-126": "2023-05-06",
        "30JUN2025": "2025-06-30", "20201201": "2020-12-01", "June 18, 2022": "2022-06-18", "6-16-2025": "2025-06-16", "2021-11-21T06:55:00+05:30": "2021-11-21",
        "3. März 2021": "2021-03-03", "2023-02-30": None, "0000-00-00": None, "2024-03": None, "unknown": None, "": None, "x" * 5000: None, "2023-366": None, "2024-366": "2024-12-31",
        "29/02/2023": None, "31.04.2020": None,
    }
    assert {k: convert(k) for k in cases} == cases


def test_order_and_short_years():
    assert convert("04.08.21", "DMY") == "2021-08-04" and convert("04.08.21", "MDY") == "2021-04-08"
    assert convert("9/9/85", old=True) == "1985-09-09" and convert("01/02/1990", None) is None and convert("25/02/1990", None) == "1990-02-25"


def test_instants():
    i = lambda v, **k: convert(v, instant=True, **k)
    assert i("2022-02-24 00:06:35", zone="America/Chicago") == "2022-02-24T06:06:35.000000Z"
    assert i("Sat, 19 Jul 2025 22:22 +0530") == "2025-07-19T16:52:00.000000Z"
    assert i("2022-09-26 17:25 EDT") == "2022-09-26T21:25:00.000000Z"
    assert i("2019-10-22 20:01:16 America/New_York", zone=None) == "2019-10-23T00:01:16.000000Z"
    assert i("1614718133000") == "2021-03-02T20:48:53.000000Z" and i("1717457968") == "2024-06-03T23:39:28.000000Z"
    assert i("12/12/2020 12:15:23 AM") == "2020-12-12T05:15:23.000000Z" and i("20220616T205855Z") == "2022-06-16T20:58:55.000000Z"
    assert i("2023-11-28 01:13 UTC+01:00") == "2023-11-28T00:13:00.000000Z" and i("2024-01-01 25:00") is None and i("2024-01-01") is None
    assert i("2024-01-01 10:00:00", zone="Nowhere/None") is None and i("2024-01-01 10:00 XYZ") is None


def test_long_texts():
    for zone in ("America/Argentina/ComodRivadavia", "america/north_dakota/new_salem"):
        text = f"Wednesday, September 30, 2020, 11:15:23.123456789 PM {zone}"
        assert len(text) > 70 and convert(text, instant=True, zone=None) == {"A": "2020-10-01T02:15:23.123456Z", "a": "2020-10-01T04:15:23.123456Z"}[zone[0]]
    assert convert("2020-09-30 " * 50_000) is None and convert("Septemb" + "e" * 5000 + "r 30, 2020") is None
    assert convert("2024-01-02X03:04:05", instant=True) is None and convert("٢٠٢٤-01-02") is None and convert("2024-01-02T03:04:05", instant=True) == "2024-01-02T08:04:05.000000Z"


def test_repeated_and_skipped_times():
    assert convert("2024-11-03 01:30:00", instant=True) == "2024-11-03T05:30:00.000000Z"  # the first of two
    assert convert("2024-03-10 02:30:00", instant=True) == "2024-03-10T07:30:00.000000Z"  # the offset before the change


@settings(max_examples=200, deadline=None)
@given(st.datetimes(dt.datetime(1975, 1, 1), dt.datetime(2090, 1, 1)), st.sampled_from(ZONES))
def test_tables_agree_with_the_library(wall, zone):
    wall = wall.replace(microsecond=0)
    local = wall.replace(tzinfo=zoneinfo.ZoneInfo(zone), fold=0)
    seconds = int((wall - dt.datetime(1970, 1, 1)).total_seconds())
    assert int(zone_table(zone).to_utc(np.array([seconds]))[0]) == int(local.timestamp())


def test_version_is_known():
    assert tz_version()


def test_operator_on_odd_rows(spark):
    rows = [(1, None, "abc1_x.csv"), (2, "", "abc1_x.csv"), (3, "03/04/2020", "ABC1_x.csv"), (3, "03/04/2020", "ABC1_x.csv"), (4, "03/04/2020", None), (5, "2020-01-02", "abc1"), (6, " 2020-01-02 ", "abc1")]
    df = spark.createDataFrame(rows, "row_id long, value string, source string").selectExpr("'t' src_table", "row_id", "'f' field_name", "value", "source", "false instant", "false old", "1 facility_code")
    fac = spark.createDataFrame([("ABC1", "DMY", "Europe/London")], "facility_code string, date_order string, time_zone string")
    got = sorted((r.row_id, r.norm_value) for r in ts.not_yet_normal(df.drop("facility_code"), fac).collect())
    assert got == [(3, "2020-04-03"), (3, "2020-04-03"), (6, "2020-01-02")]
    assert ts.not_yet_normal(df.drop("facility_code").limit(0), fac).collect() == []
