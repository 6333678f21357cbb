import datetime as dt
import json

from ambarina.streaming import ingest as I


def test_cases_arrive(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text(json.dumps({"id": "a", "voces": {}}))
    q = I.stream_status(I.stream_cases(spark, str(src))).writeStream.format("memory").queryName("st").outputMode("append").start()
    q.processAllAvailable()
    (src / "b.json").write_text("{")
    q.processAllAvailable()
    q.stop()
    assert [r.reason for r in spark.sql("select * from st where case_id = 'a'").collect()] == ["no audio_file"] and spark.sql("select * from st").count() == 2


def test_redelivery_and_late_rows(spark, tmp_path):
    day = dt.datetime(2025, 1, 1)
    path = str(tmp_path / "t")
    rows = [("a", 0, "hola", day), ("a", 0, "hola", day + dt.timedelta(days=40)), ("a", 1, None, day + dt.timedelta(days=2))]
    spark.createDataFrame(rows, "case_id string, seq int, texto string, recibido_en timestamp_ntz").write.parquet(path)
    q = I.first_deliveries(I.stream_table(spark, path), ["case_id", "seq"]).writeStream.format("memory").queryName("fd").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select * from fd").count() == 2
    q = I.turns_by_day(I.stream_table(spark, path)).writeStream.format("memory").queryName("td").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {str(r.day.date()): (r.n_turns, r.n_chars) for r in spark.sql("select * from td").collect()}["2025-01-01"] == (1, 4)
