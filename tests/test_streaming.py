import datetime as dt

from lodestone import api
from lodestone.streaming import ingest as stream

DAY, NOW = "2025-05-05", "2025-05-05 06:07:08"


def test_each_file_once(spark, tmp_path):
    landing, table, check = (str(tmp_path / x) for x in ("in", "table", "check"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"GAZETTE NOTICE NO. 1\nA\nGAZETTE NOTICE NO. 2\nB")

    def run():
        stream.start_ingest(stream.stream_files(spark, landing), table, check, DAY, NOW).awaitTermination()
        return sorted(r["notice_number"] for r in spark.read.parquet(table).collect())

    assert run() == ["1", "2"]
    assert not api.stop_processing(spark)
    (tmp_path / "in" / "b.pdf").write_bytes(b"GAZETTE NOTICE NO. 3\nC")
    assert run() == ["1", "2", "3"]
    assert run() == ["1", "2", "3"]


def test_stored_issues_ids_and_days(spark, tmp_path):
    """A stored issue under another file name is passed over, ids go on, and each batch has its own day."""
    landing, table, check = (str(tmp_path / x) for x in ("in", "table", "check"))
    (tmp_path / "in").mkdir()
    days = iter(["2025-05-05", "2025-05-06", "2025-05-07"])
    sent = str(tmp_path / "sent")

    def run(name, body):
        (tmp_path / "in" / name).write_bytes(body)
        stream.start_ingest(stream.stream_files(spark, landing), table, check, lambda: next(days), NOW, send=lambda x: open(sent, "a").write("x")).awaitTermination()
        return sorted((r["id"], r["notice_number"], str(r["published_date"])) for r in spark.read.parquet(table).collect())

    first = b"Vol. A No. 7 2025-01-02\nGAZETTE NOTICE NO. 1\nA\nGAZETTE NOTICE NO. 2\nB"
    assert run("a.pdf", first) == [(1, "1", "2025-01-02"), (2, "2", "2025-01-02")]
    assert len(run("b.pdf", first)) == 2
    assert run("c.pdf", b"GAZETTE NOTICE NO. 3\nC")[2:] == [(3, "3", "2025-05-07")]


def test_stop(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream.start_ingest(stream.stream_files(spark, str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c"), DAY, NOW, available_now=False)
    assert api.stop_processing(spark)
    assert not api.stop_processing(spark)


def test_counters(spark, tmp_path):
    schema = "ts timestamp, user_id long, event_type string"
    at = dt.datetime(2024, 1, 1, 10)
    spark.createDataFrame([(at, 1, "view"), (at, 1, "click"), (at + dt.timedelta(minutes=5), 1, "view"), (at + dt.timedelta(hours=3), 2, "error")], schema).write.parquet(str(tmp_path / "ev"))
    q = stream.stream_counters(spark.readStream.schema(schema).parquet(str(tmp_path / "ev"))).writeStream.outputMode("complete").format("memory").queryName("counters").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = {r["id"]: (r["view_count"], r["thumbs_up"], r["thumbs_down"]) for r in spark.sql("SELECT * FROM counters").collect()}
    assert rows == {1: (2, 1, 0), 2: (0, 0, 1)}
