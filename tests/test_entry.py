import importlib.util

import duckdb
import pytest

import __spark_entry__ as entry
from quernstone.plans import reference

SF = "/root/testdata/sf0.001"


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p1_found", "p3_found", "p5_found"} <= set(entry.queries())
    assert ("p2_found" in entry.queries()) == (importlib.util.find_spec("quernstone.llm") is not None)


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(round(v, 6)) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(reference.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("patients", "providers", "records", "admissions", "documents", "eval_items", "embeddings", "events", "orders", "customer", "lineitem", "source_catalog", "stream_files", "stg_rows"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = reference.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(reference.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == want
