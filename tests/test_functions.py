import datetime as dt

from pyspark.sql import functions as F

from quernstone.functions import casts, text


def one(spark, column, *values, schema="v string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(column).collect()]


def test_identifiers(spark):
    got = one(spark, text.safe_identifier(F.col("v")), " Amt Billed ", "SSN last4", "2nd Visit", "--", None, "A__b")
    assert got == ["amt_billed", "ssn_last4", "c2nd_visit", None, None, "a_b"]


def test_title_case_after_any_non_letter(spark):
    assert one(spark, text.normalise_name(F.col("v")), " o'brien  mary-jane ", "JOHN") == ["O'Brien Mary-Jane", "John"]


def test_unicode_trim_and_words(spark):
    assert one(spark, text.strip(F.col("v")), "  a \n") == ["a"]
    assert one(spark, F.size(text.words(F.col("v"))), "a b\tc", "", " ") == [3, 0, 0]


def test_null_tokens(spark):
    assert one(spark, text.null_if_token(F.col("v")), " N/A ", "--", "", "x ", None) == [None, None, None, "x", None]


def test_signature_ignores_order_and_repeats(spark):
    df = spark.createDataFrame([(["B", "a ", "A"],), (["a", "b"],)], "h array<string>")
    a, b = (r[0] for r in df.select(text.column_signature(F.col("h"))).collect())
    assert a == b and len(a) == 32


def test_safe_numeric(spark):
    got = one(spark, casts.safe_numeric(F.col("v")).cast("double"), "$1,200", "", "N/A", "(100.00)", "-5", "$-5", "1.2.3", "1e5", None)
    assert got == [1200.0, None, None, -100.0, -5.0, 5.0, None, 15.0, None]


def test_formats_are_lenient_in_width(spark):
    assert casts.spark_format("YYYY-MM-DD HH24:MI:SS") == "yyyy-M-d H:m:s"
    assert [str(x) if x else None for x in one(spark, casts.safe_date(F.col("v")), "2024-1-5", "2024-02-30", "", None)] == ["2024-01-05", None, None, None]
    assert one(spark, casts.any_date(F.col("v")), "1/5/2024", "5 March 2024", "soon") == ["2024-01-05", "2024-03-05", "soon"]


def test_dates_of_whole_tables(spark, tmp_path):
    from quernstone.plans import reference

    values = ["2024-01-05", " 2024-1-5 ", "2024-02-30", "01/05/2024", "1/5/2024", "1-5-2024", "5 March 2024", "March 5, 2024", "31/12/2024", "late May", "", None]
    for name, column in (("records", "record_date"), ("patients", "dob")):
        spark.createDataFrame(list(enumerate(values)), f"id long, {column} string").write.parquet(f"{tmp_path}/{name}.parquet")

    def brute(value, formats):
        for f in formats:
            try:
                return str(dt.datetime.strptime((value or "").strip(), f).date())
            except ValueError:
                pass

    read = lambda name: {r.id: str(r.as_date) if r.as_date is not None else None for r in reference.QUERIES[name](spark, str(tmp_path)).collect()}
    assert read("safe_dates") == {i: brute(v, ["%Y-%m-%d"]) for i, v in enumerate(values)}
    assert read("any_dates") == {i: brute(v, ["%Y-%m-%d", "%m/%d/%Y", "%m-%d-%Y", "%d %B %Y", "%B %d, %Y"]) or v for i, v in enumerate(values)}
