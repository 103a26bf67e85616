from quernstone.sources.tables import VersionedTable
from quernstone.streaming import ingest


def test_files_are_staged_once(spark, tmp_path):
    src, table = tmp_path / "in", VersionedTable(spark, str(tmp_path / "staged"))
    src.mkdir()
    (src / "a.csv").write_text("k,v\n1,x\n1,x\n2,y\n")

    def load():
        ingest.stream_into(spark, str(src), "k string, v string", table, str(tmp_path / "ckpt")).awaitTermination()
        return sorted((r._source_file, r.k, r.v) for r in table.read().collect())

    assert load() == [("a.csv", "1", "x"), ("a.csv", "2", "y")]
    (src / "b.csv").write_text("k,v\n1,x\n")
    assert load() == [("a.csv", "1", "x"), ("a.csv", "2", "y"), ("b.csv", "1", "x")]


def test_windows_on_a_stream(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 10:05:00' ts, 'a' k, 1.5D value UNION ALL SELECT timestamp'2024-01-01 10:50:00', 'a', 2D").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, k string, value double").parquet(str(tmp_path / "e"))
    q = ingest.windowed_counts(stream, "ts", "k").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r)[1:] for r in spark.table("w").collect()] == [("a", 2, 3.5)]
