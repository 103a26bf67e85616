import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quernstone.functions import text
from quernstone.operators import catalog, staging


def staged(spark, rows):
    return spark.createDataFrame(rows, "_source_file string, _row_hash string, row_idx long, _deleted_at timestamp")


NOW = dt.datetime(2024, 1, 1)


def keys(df):
    return sorted(tuple(r) for r in df.select("_source_file", "_row_hash").collect())


def test_loads(spark):
    old = staged(spark, [("f", "a", 1, None), ("f", "b", 2, NOW), ("g", "a", 1, None)])
    new = staged(spark, [("f", "a", 1, None), ("f", "b", 2, None), ("f", "c", 3, None), ("f", "c", 4, None)])
    assert keys(staging.append_load(old, new)) == [("f", "c")]
    assert keys(staging.snapshot_load(old, new)) == [("f", "b"), ("f", "c")]
    again = old.unionByName(staging.append_load(old, new))
    assert keys(staging.append_load(again, new)) == []


def test_reconcile_guards(spark):
    old = staged(spark, [("f", f"h{i}", i, None) for i in range(100)])
    new = staged(spark, [("f", f"h{i}", i, None) for i in range(20, 120)])
    assert keys(staging.reconcile(old, new)) == []  # 100 of 120 counted after the load is below 90 %
    assert len(keys(staging.reconcile(old, new, guard="pre_insert"))) == 20
    assert keys(staging.reconcile(old, new.limit(5), guard="pre_insert")) == []
    assert keys(staging.reconcile(old.limit(0), new)) == []


def test_upsert_prefers_the_incoming_row_of_equals(spark):
    a = spark.createDataFrame([(1, 1, "old"), (2, 5, "keep")], "k int, s int, v string")
    b = spark.createDataFrame([(1, 1, "new"), (2, 4, "late")], "k int, s int, v string")
    assert sorted(tuple(r) for r in staging.upsert(a, b, "k", "s").select("k", "v").collect()) == [(1, "new"), (2, "keep")]


def test_denylist(spark):
    df = spark.createDataFrame([(["amount", "ssn_last4", "businessname", "x"],)], "c array<string>")
    assert df.select(catalog.stored_columns(F.col("c"), ("x",))).first()[0] == ["amount"]
    raw = spark.createDataFrame([(1, 2, 3)], "`Amt Billed` int, `SSN` int, ` amt-billed` int")
    assert catalog.select_stored(raw).columns == ["amt_billed"] and catalog.select_stored(raw).first()[0] == 3
    with pytest.raises(ValueError):
        catalog.select_stored(raw.select("SSN"))


def test_drift_prefix_filter_against_all_pairs(spark):
    import itertools
    import random

    rnd = random.Random(5)
    sets = {f"s{i}": sorted(rnd.sample("abcdefghijkl", rnd.randint(2, 8))) for i in range(60)}
    rows = [(s, c, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)) for i, (s, c) in enumerate(sets.items())]
    df = spark.createDataFrame(rows, "column_signature string, safe_columns array<string>, first_ingested_at timestamp")
    got = {r.column_signature: r.candidate for r in catalog.drift_candidates(df).collect()}
    want = {}
    for a, b in itertools.permutations(sets, 2):
        if len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= 0.7:
            want.setdefault(a, b)
    assert got == want


def test_aliases_and_prefix(spark):
    df = spark.createDataFrame([("ab1", None, "t1"), ("ab2", "ab1", None), ("c3", "ab2", None)], "column_signature string, aliased_to string, staging_table string")
    got = {r.column_signature: (r.target, r.staging_table, r.chained) for r in catalog.resolve_aliases(df).collect()}
    assert got == {"ab1": ("ab1", "t1", False), "ab2": ("ab1", "t1", False), "c3": ("ab2", None, True)}
    assert catalog.by_prefix(df, "c") == "c3"
    for bad in ("ab", "zz"):
        with pytest.raises(ValueError):
            catalog.by_prefix(df, bad)


def test_typed_view(spark):
    df = spark.createDataFrame([("$5", "1/5/2024", None), ("x", "", None), ("7", "2/1/2024", NOW)], "amt string, day string, _deleted_at timestamp")
    view = catalog.typed_view(df, {"amt": ("amount", "numeric", None), "day": ("d", "date", "MM/DD/YYYY")})
    assert [(float(r.amount) if r.amount is not None else None, str(r.d) if r.d else None) for r in view.collect()] == [(5.0, "2024-01-05"), (None, None)]
    with pytest.raises(ValueError, match="denied"):
        catalog.typed_view(df, {"ssn": ("s", "text", None)})
    with pytest.raises(ValueError, match="not found"):
        catalog.typed_view(df, {"nope": ("s", "text", None)})


def test_registration(spark, tmp_path):
    columns = "column_signature string, staging_table string, aliased_to string, candidate_drift_of string, representative_headers array<string>, safe_columns array<string>, stored_columns array<string>, load_mode string, human_label string, query_exposed boolean, rows_total long, first_ingested_at timestamp, last_ingested_at timestamp"
    at = lambda n: dt.datetime(2024, 1, n)
    sign = lambda *headers: spark.range(1).select(text.column_signature(F.array(*[F.lit(h) for h in headers]))).first()[0]
    a, b = sign("id", "name", "dob", "city"), sign("x", "y")
    rows = [(a, "stg_a", None, None, ["id"], ["city", "dob", "id", "name"], ["city", "dob", "id"], "append", None, False, 5, at(1), at(1)), (b, "stg_b", a, None, ["x"], ["x", "y"], ["x"], "append", None, False, 0, at(2), at(2))]
    known = spark.createDataFrame(rows, columns)
    files = spark.createDataFrame([(1, ["ID", "Name", "DOB", "City"], at(3)), (2, ["X", "Y"], at(4)), (3, ["id", "name", "dob", "city", "ssn"], at(5)), (4, ["SSN", "id", "Name", "DOB", "city"], at(6))], "file_id long, headers array<string>, delivered_at timestamp")
    declared = spark.createDataFrame([(a, "people", None)], "column_signature string, human_label string, load_mode string")
    after, placed = catalog.register(known, files, declared)
    got = {r.file_id: (r.outcome, r.staging_table) for r in placed.collect()}
    fresh = sign("id", "name", "dob", "city", "ssn")
    assert got == {1: ("known", "stg_a"), 2: ("aliased", "stg_a"), 3: ("new", f"stg_{fresh[:12]}"), 4: ("new", f"stg_{fresh[:12]}")}
    table = {r.column_signature: r for r in after.collect()}
    assert len(table) == 3 and table[fresh].candidate_drift_of == a and table[fresh].stored_columns == ["city", "dob", "id", "name"]
    assert (table[a].human_label, table[a].load_mode) == ("people", "append") and table[a].stored_columns == ["city", "dob", "id", "name", "x", "y"] and table[a].last_ingested_at == at(3)
    assert [r.signature for r in catalog.listing(after).collect()] == [a[:8], b[:8], fresh[:8]]
    assert catalog.labelled(after, fresh[:8], " New People ").where(F.col("column_signature") == fresh).first().human_label == "new_people"
    led = {r.column_signature: r for r in catalog.aliased(after, fresh[:8], a[:8]).collect()}
    assert led[fresh].aliased_to == a and set(led[a].stored_columns) == {"city", "dob", "id", "name", "x", "y"}
    with pytest.raises(ValueError):
        catalog.aliased(after, fresh[:8], b[:8])
    (tmp_path / "o.json").write_text(json.dumps({"sources": [{"column_signature": a}, {"column_signature": "short"}, {"column_signature": "f" * 32}]}))
    assert len(catalog.overlay_errors(after, catalog.read_overlay(str(tmp_path / "o.json")))) == 2 and catalog.read_overlay(str(tmp_path / "none.yaml")) == []


def test_headers_are_read_as_they_are(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`a``b` int, `A.B` int, `c d` int")
    assert catalog.select_stored(df).columns == ["a_b", "c_d"] and catalog.select_stored(df).first()[0] == 2
    assert text.safe_name("  2nd Höhe ") == "c2nd_h_he" and text.safe_name("--") is None


def test_prompt_of_views(spark):
    spark.createDataFrame([(1, "x", None)], "total_amount int, payer string, _deleted_at timestamp").createOrReplaceTempView("v_bills")
    said = catalog.schema_prompt(spark, ["total", "payer"], examples=[("how many", "SELECT count(*) FROM v_bills")])
    assert "v_bills(total_amount, payer)" in said and said.endswith("SELECT count(*) FROM v_bills") and "_deleted_at" not in said
    spark.catalog.dropTempView("v_bills")
