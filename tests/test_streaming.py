import datetime as dt

import pytest

from panelwright.streaming import arrivals

SCHEMA = "key string, year int, value double, ts timestamp"


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", 2000, 1.0, dt.datetime(2024, 1, 1)), ("a", 2000, 1.0, dt.datetime(2024, 1, 2)), ("b", 2000, 2.0, dt.datetime(2024, 1, 3))]
    src = tmp_path / "in"
    for i, r in enumerate(rows):
        spark.createDataFrame([r], SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
    schema = spark.createDataFrame([], SCHEMA).schema
    s = arrivals.first_arrivals(arrivals.read_arrivals(spark, str(src), schema), ["key", "year"], "ts")
    q = s.writeStream.format("memory").queryName("got").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["key"] for r in spark.sql("select key from got").collect()) == ["a", "b"]
    w = arrivals.windowed_counts(arrivals.read_arrivals(spark, str(src), schema), "ts", "key")
    q = w.writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) s from counts").first()["s"] == 3


def test_merge_keeps_the_latest(spark, tmp_path):
    f = arrivals.merge_latest(str(tmp_path / "t"), ["key"], "ts")
    a = spark.createDataFrame([("a", 1, 1.0, dt.datetime(2024, 1, 1)), ("b", 1, 2.0, dt.datetime(2024, 1, 1))], SCHEMA)
    b = spark.createDataFrame([("a", 2, 9.0, dt.datetime(2024, 2, 1)), ("b", 0, 0.0, dt.datetime(2023, 1, 1))], SCHEMA)
    f(a, 0)
    f(b, 1)
    assert {r["key"]: r["value"] for r in spark.read.parquet(str(tmp_path / "t/v1")).collect()} == {"a": 9.0, "b": 2.0}


def test_merge_does_not_go_on_without_the_history(spark, tmp_path):
    f = arrivals.merge_latest(str(tmp_path / "t"), ["key"], "ts")
    a = spark.createDataFrame([("a", 1, 1.0, dt.datetime(2024, 1, 1))], SCHEMA)
    f(a, 0)
    f(a, 0)  # a batch that is written again
    with pytest.raises(Exception, match="v4"):
        f(a, 5)
    assert not (tmp_path / "t/v5").exists()
