from pyspark.sql import functions as F

from loomspark.streaming.windows import activity_windows, lexical_upkeep
from tests.conftest import SF


def test_windows_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/events.parquet")
    table.select("ts", "event_type").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "in"))
    q = activity_windows(stream, late="60 days").writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, activity_windows(table).collect()))


def test_upkeep(spark, tmp_path):
    spark.createDataFrame([("a", "x y x"), ("b", "y")], "chunk_id string, text string").write.parquet(str(tmp_path / "in"))
    got = {}
    q = lexical_upkeep(spark.readStream.schema("chunk_id string, text string").parquet(str(tmp_path / "in")), lambda t, rows, i: got.setdefault(t, []).extend(map(tuple, rows.collect()))).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(got["postings"]) == [("x", "a", 2), ("y", "a", 1), ("y", "b", 1)]
    assert sorted(got["doc_len"]) == [("a", 3), ("b", 1)]


def test_late_rows_are_dropped(spark):
    assert activity_windows(spark.createDataFrame([], "ts timestamp, event_type string"), "1 hour", "30 minutes").select(F.count("*")).first()[0] == 0
