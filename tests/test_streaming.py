import datetime

from docquarry.streaming import events as streams


def write(spark, folder, first, count, kind="view"):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(seconds=i), 1, kind, 0.5, "{}") for i in range(first, first + count)]
    spark.createDataFrame(rows, streams.EVENTS).coalesce(1).write.mode("append").parquet(str(folder))


def test_history_goes_on_where_it_stopped(spark, tmp_path):
    out = str(tmp_path / "history")
    write(spark, tmp_path / "in", 0, 30)
    first = streams.keep_history(streams.read_events(spark, str(tmp_path / "in")), 10, out)
    assert sorted(r["event_id"] for r in spark.read.parquet(first).collect()) == list(range(20, 30))
    write(spark, tmp_path / "in", 100, 4)
    write(spark, tmp_path / "in", 200, 3, "error")
    second = streams.keep_history(streams.read_events(spark, str(tmp_path / "in")), 10, out)
    kept = spark.read.parquet(second).collect()
    assert sorted(r["event_id"] for r in kept if r["event_type"] == "view") == [*range(24, 30), *range(100, 104)]
    assert sorted(r["event_id"] for r in kept if r["event_type"] == "error") == [200, 201, 202]


def test_finished_windows_are_appended(spark, tmp_path):
    write(spark, tmp_path / "in", 0, 300)
    stream = streams.windowed_rates(streams.read_events(spark, str(tmp_path / "in")), "60 seconds", "0 seconds")
    out = streams.run_available(stream, str(tmp_path / "out"), mode="append")
    rows = spark.read.parquet(out).collect()
    # the last window may still grow, so it is not final yet
    assert len(rows) == 4 and all(r["n"] == 60 and r["rate"] == 1.0 for r in rows)


def test_counters_cover_all_files(spark, tmp_path):
    for i in range(3):
        write(spark, tmp_path / "in", i * 10, 10)
    out = streams.run_available(streams.counters(streams.read_events(spark, str(tmp_path / "in"))))
    assert [(r["event_type"], r["n"]) for r in spark.read.parquet(out).collect()] == [("view", 30)]
