import random

import xxhash
from pyspark.sql import functions as F

from quernstone.operators import snapshots as s

FILES = "file_id long, feed_code string, column_signature string, headers array<string>, row_count int, delivered_at timestamp_ntz, extra string"
ROWS = "_id long, file_id long, row_no int, cells array<string>, file_name string"
CATALOG = "column_signature string, load_mode string, natural_key array<string>"


def frames(spark, files, rows, catalog=(("s", "snapshot", ["k"]),)):
    import datetime as dt

    f = [(i, feed, "s", h, n, dt.datetime(2024, 1, 1) + dt.timedelta(days=day), None) for i, feed, h, n, day in files]
    r = [(k, fid, no, cells, None) for k, (fid, no, cells) in enumerate(rows)]
    return spark.createDataFrame(f, FILES), spark.createDataFrame(r, ROWS), spark.createDataFrame(list(catalog), CATALOG)


def changes(df):
    return sorted(tuple(r) for r in df.select("file_id", "row_key", "change_kind").collect())


def test_hash_matches_spark(spark):
    v = spark.range(1).select(F.xxhash64(F.lit(7).cast("long"), F.lit(-9).cast("long"))).first()[0]
    assert s._signed(s._chain(7, -9)) == v and xxhash.VERSION


def test_small_feed(spark):
    files = [(1, "A", ["K", " V "], 3, 0), (2, "A", ["v", "K"], 3, 1), (3, "A", ["K", "V"], 9, 2), (4, "A", ["K", "V"], 2, 3), (5, "B", ["K", "V"], 1, 0)]
    rows = [(1, 1, ["a", "1"]), (1, 2, ["b", None]), (1, 3, ["c", "3"]), (1, 3, ["c", "3"]), (2, 1, ["1", " a"]), (2, 2, ["", "B"]), (2, 3, ["4", "c"]), (3, 1, ["z", "z"]), (4, 1, ["a", "1"]), (4, 2, ["d", "9"]), (5, 1, ["q", "1"])]
    got = changes(s.snapshot_changes(*frames(spark, files, rows)))
    # file 3 is incomplete: 4 is compared with 2
    assert got == [(2, "C", "changed"), (4, "B", "removed"), (4, "C", "removed"), (4, "D", "added")]


def test_empty_tables(spark):
    assert changes(s.snapshot_changes(*frames(spark, [], []))) == []


def brute(pairs):
    a, b = pairs
    return sorted([(2, k, "added") for k in b.keys() - a.keys()] + [(2, k, "removed") for k in a.keys() - b.keys()] + [(2, k, "changed") for k in a.keys() & b.keys() if a[k] != b[k]])


def random_snapshots(n, seed):
    rnd = random.Random(seed)
    a = {f"K{i}": str(rnd.random()) for i in range(n)}
    b = {k: (v if rnd.random() > 0.2 else str(rnd.random())) for k, v in a.items() if rnd.random() > 0.1} | {f"N{i}": "1" for i in range(n // 8)}
    return a, b


def test_failed_buckets_are_enlarged(spark, monkeypatch):
    a, b = random_snapshots(300, 1)
    files = [(1, "A", ["K", "V"], len(a), 0), (2, "A", ["K", "V"], len(b), 1)]
    rows = [(f, i, [k, v]) for f, d in ((1, a), (2, b)) for i, (k, v) in enumerate(d.items())]
    data = frames(spark, files, rows)
    assert changes(s.snapshot_changes(*data, cells=12, rows_per_bucket=64)) == brute((a, b))
    monkeypatch.setattr(s, "MAX_ROUNDS", 1)  # then row by row
    assert changes(s.snapshot_changes(*data, cells=12, rows_per_bucket=64)) == brute((a, b))


def test_changed_rows_peel(spark):
    """The tables alone must do it: no bucket may be left to the row-by-row comparison at the size they are made for."""
    a, b = random_snapshots(300, 2)
    rows = [("A", f, hash(k) % 4, hash(("k", k)), hash(v)) for f, d in ((1, a), (2, b)) for k, v in d.items()]
    df = spark.createDataFrame(rows, "feed_code string, file_id long, bucket long, key_hash long, digest long")
    pairs = spark.createDataFrame([(2, 1)], "file_id long, prev_id long")
    got = s.peel_buckets(s.subtracted(df, pairs, s.CELLS), s.CELLS).toPandas()
    assert not got.failed.any()
    want = sum((k in b and 2 or 1) if k in a and a[k] != b.get(k) else (k not in a) for k in a.keys() | b.keys())
    assert len(got) == want
