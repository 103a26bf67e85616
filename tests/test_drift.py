import datetime as dt

from pyspark.sql import functions as F

from quernstone.operators import drift

CATALOG = "column_signature string, column_mapping map<string,struct<canonical:string,type:string,format:string>>"


def run(spark, files, rows, mapping=None):
    f = spark.createDataFrame([(i, "A", h, dt.datetime(2024, 1, i)) for i, h in files], "file_id long, feed_code string, headers array<string>, delivered_at timestamp_ntz")
    r = spark.createDataFrame([(k, i, n, c) for k, (i, n, c) in enumerate(rows)], "_id long, file_id long, row_no int, cells array<string>")
    c = spark.createDataFrame([("s", mapping or {})], CATALOG)
    return sorted(tuple(x) for x in drift.schema_changes(f, r, c).select("file_id", "change_kind", "column_name").collect())


def test_raw_types(spark):
    values = ["$1,200.50", "(43.35)", "-7", "12%", "2024-01-05", "21-may-2023", "01/13/2025", "2024-01-05 10:00:00", "2024-01-05t10:00:00z", "late january 2025", "approx. 4, see note", "10^9/l", "n/a", "", None, "a7923-001"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(drift.raw_type(F.col("v"))).collect()]
    assert got == ["numeric"] * 4 + ["date"] * 3 + ["timestamptz"] * 2 + ["text"] * 3 + [None] * 3 + ["text"]


def test_changes(spark):
    files = [(1, ["Ref", "Amt Billed", "Note"]), (2, [" amt_billed", "REF", "fld_note", "Dose"]), (3, ["ref", "amtbilled", "Strength"])]
    rows = [(1, 1, ["a", "1.5", "x"]), (2, 1, ["2", "b", "y", "5 mg"]), (3, 1, ["c", "band low", "7 mg"]), (3, 1, ["c", "band low", "7 mg"])]
    mapping = {"dose": ("strength", "text", None), "strength": ("strength", "text", None)}
    got = run(spark, files, rows, mapping)
    assert got == [(2, "added", "dose"), (2, "renamed", "fld_note"), (3, "removed", "fld_note"), (3, "renamed", "amtbilled"), (3, "renamed", "strength"), (3, "retyped", "amtbilled")]


def test_values_tell_a_rename(spark):
    drugs = ["metformin", "warfarin", "apixaban", "naproxen"]
    rows = [(1, i, [d, str(i)]) for i, d in enumerate(drugs)] + [(2, i, [d, str(i)]) for i, d in enumerate(drugs)]
    assert run(spark, [(1, ["Arznei", "n"]), (2, ["Produkt", "n"])], rows) == [(2, "renamed", "produkt")]


def test_odd_files(spark):
    assert run(spark, [], []) == []
    # no rows, clashing headers, a header without letters, an empty column
    got = run(spark, [(1, ["A", "a ", "--", "B"]), (2, ["A", "B"])], [(1, 1, ["1", None, "x", ""]), (2, 1, ["1", "t"])])
    assert got == []


def cells(spark, files, rows, mapping=None):
    f = spark.createDataFrame([(i, "A", h, dt.datetime(2024, 1, i)) for i, h in files], "file_id long, feed_code string, headers array<string>, delivered_at timestamp_ntz")
    r = spark.createDataFrame([(k, i, n, c) for k, (i, n, c) in enumerate(rows)], "_id long, file_id long, row_no int, cells array<string>")
    places = spark.createDataFrame([("a", "DMY", "America/New_York")], "facility_code string, date_order string, time_zone string")
    return drift.consistent_rows(f, r, spark.createDataFrame([("s", mapping or {})], CATALOG), places)


def test_rows_are_cast(spark):
    rows = [("2023-04-05", "1,200.50", "2024-01-05 10:00"), ("2023-13-45", "$-5", "2024-01-06"), ("31/02/2024", "(7)", "2024-01-05 10:00:00Z"), ("04/05/2024", "approx. 4", "2024-01-05 25:00"), ("n/a", "12%", "2024-01-07 09:30")]
    got = cells(spark, [(1, ["Seen", "Paid", "Posted"])], [(1, n, list(r)) for n, r in enumerate(rows)])
    assert {(r.row_no, r.column_name) for r in got.where("cast_failed").collect()} == {(1, "seen"), (2, "seen"), (3, "paid"), (3, "posted")}
    table = drift.feed_table(got.withColumn("as_timestamp", F.date_format(F.to_utc_timestamp("as_timestamp", F.current_timezone()), "yyyy-MM-dd HH:mm")), "A").orderBy("row_no").collect()
    assert [r.seen for r in table] == [dt.date(2023, 4, 5), None, None, dt.date(2024, 5, 4), None]
    assert [r.paid if r.paid is None else float(r.paid) for r in table] == [1200.5, -5.0, -7.0, None, 12.0]
    assert [r.posted for r in table] == ["2024-01-05 15:00", "2024-01-06 05:00", "2024-01-05 10:00", None, "2024-01-07 14:30"]
    assert [r.failed_casts for r in table] == [[], ["seen"], ["seen"], ["paid", "posted"], []]


def test_renamed_columns_are_one(spark):
    drugs = ["metformin", "warfarin", "apixaban", "naproxen"]
    files = [(1, ["Arznei", "ssn_last4"]), (2, ["Produkt", "ssn_last_4"]), (3, ["Produkt"]), (4, ["Produkt", "SSN Last4"])]
    rows = [(f, i, [d, "12"][: len(h)]) for f, h in files for i, d in enumerate(drugs)]
    got = cells(spark, files, rows).groupBy("column_name").count().collect()
    assert sorted(r["count"] for r in got) == [12, 16]


def test_columns_of_one_file_stay_apart(spark):
    mapping = {"dose": ("strength", "text", None), "strength": ("strength", "text", None)}
    got = cells(spark, [(1, ["Dose"]), (2, ["Dose", "Strength"])], [(1, 1, ["a"]), (2, 1, ["b", "c"])], mapping)
    assert sorted((r.column_name, r.value) for r in got.collect()) == [("strength", "a"), ("strength", "b"), ("strength_2", "c")]


def test_rows_staged_twice(spark):
    rows = spark.createDataFrame([(1, 1, 5, ["a"]), (1, 1, 9, ["b"]), (1, 1, 9, ["b"]), (1, 2, 3, ["c"]), (1, None, 4, ["d"]), (None, 1, 6, None), (2, 1, None, ["e"]), (2, 1, 1, ["f"])], "file_id long, row_no int, _id long, cells array<string>")
    got = sorted((tuple(r) for r in drift.staged_once(rows).collect()), key=str)
    assert got == sorted([(1, 1, 9, ["b"]), (1, 2, 3, ["c"]), (1, None, 4, ["d"]), (None, 1, 6, None), (2, 1, 1, ["f"])], key=str)
    assert drift.staged_once(rows.limit(0)).collect() == []
