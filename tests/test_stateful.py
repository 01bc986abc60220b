"""Streams with state against the batch operators, with restarts, late and repeated batches."""

import datetime
import random
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from docquarry.operators import metrics
from docquarry.streaming import events as streams
from docquarry.streaming import stateful

START = datetime.datetime(2024, 1, 1)
LOG = "seq bigint, crate_id bigint, crate string, updated_at timestamp, status string, error_message string, items_processed bigint, total_items bigint, ingestion_tier string"


def write_events(spark, folder, rows):
    data = [(i, START + datetime.timedelta(seconds=s), 1, kind, float(i), "{}") for i, s, kind in rows]
    spark.createDataFrame(data, streams.EVENTS).coalesce(1).write.mode("append").parquet(str(folder))


def write_log(spark, folder, rows):
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(str(folder))


def reports(n, crates, seed=1, gap=60):
    rnd = random.Random(seed)
    rows = []
    for seq in range(n):
        crate = rnd.randrange(crates)
        status = rnd.choice(["started", "downloading", "processing", "completed", "failed"])
        rows.append((
            seq, crate, f"c{crate}", START + datetime.timedelta(seconds=rnd.randrange(n * gap)), status, "bad" if status == "failed" else None,
            seq if seq % 3 else None, 100 if seq % 5 == 0 else None, "full" if seq % 7 == 0 else None,
        ))
    return rows


def log_stream(spark, folder):
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_history_with_late_and_repeated_batches(spark, tmp_path):
    source, progress = tmp_path / "in", str(tmp_path / "progress")
    batches = [
        [(i, i, "view") for i in range(40)],
        [(i, i, "view") for i in range(100, 130)] + [(200 + i, i, "error") for i in range(5)],
        [(50 + i, 115, "view") for i in range(3)],  # late, among the last ones
        [(i, i, "view") for i in range(120, 130)],  # once more
    ]
    for batch in batches:
        write_events(spark, source, batch)
        stateful.run_history(streams.read_events(spark, str(source)), 10, progress, shards=3)
    seen = {row for batch in batches for row in batch}
    last = sorted((r for r in seen if r[2] == "view"), key=lambda r: (r[1], r[0]))[-10:]
    got = stateful.history(spark, progress, 10).collect()
    assert sorted(r.event_id for r in got if r.event_type == "view") == sorted(r[0] for r in last)
    assert sorted(r.event_id for r in got if r.event_type == "error") == [200, 201, 202, 203, 204]
    assert {(r.event_id, r.age_rank) for r in got if r.event_type == "error"} == {(204 - k, k + 1) for k in range(5)}
    assert {r.event_type: r.n for r in stateful.lifetime_counters(spark, progress).collect()} == {"view": 73, "error": 5}


def test_state_stays_bounded_for_one_frequent_type(spark, tmp_path):
    source, progress = tmp_path / "in", str(tmp_path / "progress")
    for part in range(2):
        write_events(spark, source, [(i, i, "view") for i in range(part * 10_000, part * 10_000 + 10_000)])
        stateful.run_history(streams.read_events(spark, str(source)), 20, progress, shards=4)
        assert stateful.state_rows(spark, progress, "last") == 80
    assert stateful.state_rows(spark, progress, "count") == 4
    assert [r.event_id for r in stateful.history(spark, progress, 20).orderBy("age_rank").collect()] == list(range(19_999, 19_979, -1))
    assert stateful.lifetime_counters(spark, progress).first().n == 20_000


def test_status_is_merged_in_any_order(spark, tmp_path):
    rows = reports(300, 12)
    for part in range(5):
        write_log(spark, tmp_path / "in", rows[part::5])
    table = stateful.status_table(spark, str(tmp_path / "table"), every=2)
    stateful.feed(stateful.status_parts(log_stream(spark, tmp_path / "in")), table, str(tmp_path / "progress"))
    want = metrics.merge_status(spark.createDataFrame(rows, LOG))
    got = stateful.current_status(table).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert table.entry()["writers"] == {"stream": 4} and len(table.entry()["folders"]) <= 2


@pytest.mark.parametrize("where", ["before the entry", "after the entry"])
def test_a_killed_batch_is_merged_once(spark, tmp_path, where):
    for part in range(3):
        write_events(spark, tmp_path / "in", [(part * 10 + i, i, "view" if i % 2 else "error") for i in range(10)])
    stream = spark.readStream.schema(streams.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counted = stream.select("event_type", F.lit(1).cast("bigint").alias("n"))

    class Breaks(type(stateful.counter_table(spark, str(tmp_path / "none")))):
        def _enter(self, entry):
            if where == "after the entry":
                super()._enter(entry)
            if entry["number"] == 2:
                raise RuntimeError("killed")
            if where == "before the entry":
                super()._enter(entry)

    table = stateful.counter_table(spark, str(tmp_path / "table"))
    broken = Breaks(spark, table.path, table.keys, table.merges, table.schema)
    with pytest.raises(StreamingQueryException):
        stateful.feed(counted, broken, str(tmp_path / "progress"))
    half = {r.event_type: r.n for r in table.read().collect()}
    assert half == ({"view": 5, "error": 5} if where == "before the entry" else {"view": 10, "error": 10})
    stateful.feed(counted, table, str(tmp_path / "progress"))
    assert {r.event_type: r.n for r in table.read().collect()} == {"view": 15, "error": 15}


def test_folders_of_a_table_are_cleared(spark, tmp_path):
    table = stateful.counter_table(spark, str(tmp_path / "table"), every=3)
    assert table.read().collect() == []
    for epoch in range(8):
        table.add(spark.createDataFrame([("a", 1), ("a", 2), (None, 5)], "event_type string, n bigint"), epoch)
        table.add(spark.createDataFrame([("never", 1)], "event_type string, n bigint"), epoch)
    assert {r.event_type: r.n for r in table.read().collect()} == {"a": 24, None: 40}
    folders = [p.name for p in (tmp_path / "table").iterdir() if p.name != "ledger"]
    assert len(folders) <= 7
    table.add(spark.createDataFrame([("a", 1)], "event_type string, n bigint"), 0, writer="another")
    assert {r.event_type: r.n for r in table.read().collect()} == {"a": 25, None: 40}


def test_stalled_runs_by_event_time(spark, tmp_path):
    rows = reports(400, 25, seed=4, gap=5)
    for part in range(4):
        write_log(spark, tmp_path / "in", sorted(rows, key=lambda r: r[3])[part * 100 : part * 100 + 100])
    table = stateful.stalled_table(spark, str(tmp_path / "table"))
    stateful.feed(stateful.quiet_runs(log_stream(spark, tmp_path / "in"), 60), table, str(tmp_path / "progress"), "update")
    last = max(r[3] for r in rows)
    newest = {}
    for r in rows:
        newest[r[1]] = max(newest.get(r[1], r), r, key=lambda x: (x[3], x[0]))
    want = {c: r[4] for c, r in newest.items() if r[4] in ("started", "downloading", "processing") and (last - r[3]).total_seconds() > 60}
    got = {r.crate_id: r.status for r in stateful.stalled_runs(table).collect()}
    assert got == want and 0 < len(want) < 25


def test_a_run_stalls_without_another_report(spark, tmp_path):
    now = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
    row = lambda seq, crate, status: (seq, crate, f"c{crate}", now, status, None, None, None, None)
    write_log(spark, tmp_path / "in", [row(1, 1, "processing"), row(2, 2, "completed")])
    table = stateful.stalled_table(spark, str(tmp_path / "table"))
    stream = stateful.quiet_runs(log_stream(spark, tmp_path / "in"), 3, late=None, shards=1)
    query = stateful.feed(stream, table, str(tmp_path / "progress"), "update", trigger={"processingTime": "1 second"})
    try:
        until = time.time() + 90
        while time.time() < until and not stateful.stalled_runs(table).count():
            time.sleep(1)
        assert [(r.crate_id, r.status) for r in stateful.stalled_runs(table).collect()] == [(1, "processing")]
    finally:
        query.stop()


def test_many_runs_share_a_state(spark, tmp_path):
    rows = [(i, i, f"c{i}", START + datetime.timedelta(seconds=i % 2 * 500), "started", None, None, None, None) for i in range(3000)]
    write_log(spark, tmp_path / "in", [*rows, (3000, None, None, START, "started", None, None, None, None)])
    table = stateful.stalled_table(spark, str(tmp_path / "table"))
    query = stateful.feed(stateful.quiet_runs(log_stream(spark, tmp_path / "in"), 60, buckets=32), table, str(tmp_path / "progress"), "update")
    assert sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"]) <= 32
    assert {r.crate_id for r in stateful.stalled_runs(table).collect()} == {None, *range(0, 3000, 2)}


def test_a_stalled_run_reports_again(spark, tmp_path):
    row = lambda seq, crate, seconds, status: (seq, crate, f"c{crate}", START + datetime.timedelta(seconds=seconds), status, None, None, None, None)
    progress, table = str(tmp_path / "progress"), stateful.stalled_table(spark, str(tmp_path / "table"))
    seen = []
    for part in (
        [row(1, 1, 0, "started"), row(2, 2, 0, "started"), row(3, 3, 0, "started"), row(4, 9, 60, "completed")],
        [row(5, 9, 61, "completed")],  # more than 60 seconds later
        [row(6, 1, 62, "processing"), row(7, 2, 62, "failed"), row(8, 9, 100, "completed")],
        [row(9, 9, 400, "completed")],
    ):
        write_log(spark, tmp_path / "in", part)
        stateful.feed(stateful.quiet_runs(log_stream(spark, tmp_path / "in"), 60), table, progress, "update")
        seen.append(sorted((r.crate_id, r.status) for r in stateful.stalled_runs(table).collect()))
    every = [(1, "started"), (2, "started"), (3, "started")]
    assert seen == [[], every, [(3, "started")], [(1, "processing"), (3, "started")]]
