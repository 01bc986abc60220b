"""What an ingestion leaves on disk, and what it holds there while it runs."""

import json
import os
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from docquarry import session
from docquarry.session import staged, temporary
from docquarry.sources import embedding, ingest, rustdoc, store

MODEL = embedding.hashing_model(8)


def a_file(n, docs):
    """A struct with a method that shares its path with one of every other file of the release."""
    index = {
        f"{n}:0": {"name": f"S{n}", "docs": docs, "inner": {"struct": {}}},
        f"{n}:1": {"name": "io", "docs": f"{docs} io", "inner": {"function": {"decl": {"inputs": [], "output": None}}}},
        f"{n}:2": {"name": "quiet", "docs": None, "inner": {"module": {"items": []}}},
        f"{n}:3": {"name": None, "docs": "```rust\nrun();\n```", "inner": {}},
    }
    return json.dumps({"index": index, "paths": {f"{n}:0": {"crate_id": 0, "path": ["net", f"S{n}"], "kind": "struct"}}})


def files(spark, numbers):
    rows = [("net", f"{n % 2}.0.0", a_file(n, f"text {n}")) for n in numbers]
    return spark.createDataFrame(rows, "crate string, version string, text string").repartition(4)


@pytest.fixture
def shared(tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    return str(tmp_path)


def shuffles(spark):
    top = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for folder in top for _, _, names in os.walk(folder) for f in names if f.startswith("shuffle_")}


def holding(folder, column):
    """Staged tables with a column."""
    found = set()
    for at, _, names in os.walk(folder):
        for name in names:
            if "staged-" in at and name.endswith(".parquet") and column in pq.read_schema(f"{at}/{name}").names:
                found.add(at.split("staged-")[1][:32])
    return found


def test_nothing_but_the_library_stays(spark, shared, tmp_path):
    before, setting = shuffles(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting)
    for numbers in (range(8), range(4, 12)):  # the second time rows are merged
        ingest.ingest(files(spark, numbers), f"{tmp_path}/library", MODEL)
    assert os.listdir(shared) == ["library"]
    assert spark.conf.get(setting) == was
    for _ in range(50):  # Spark deletes them a little later
        if not (left := shuffles(spark) - before):
            break
        time.sleep(0.2)
    assert not left
    stored = spark.read.parquet(f"{tmp_path}/library/items")
    assert stored.where("header like 'S%'").count() == 12


def test_parsed_files_are_gone_before_items_are_stored(spark, shared, monkeypatch):
    write, seen = store.write_table, {}

    def watched(df, path, **kwargs):
        seen[os.path.basename(path)] = len(holding(shared, "item")), len(holding(shared, "content"))
        write(df, path, **kwargs)

    monkeypatch.setattr(store, "write_table", watched)
    ingest.ingest(files(spark, range(8)), f"{shared}/library", MODEL)
    # parsed files with their texts, then items with the same texts, never both and the stored table
    assert seen["methods"] == (1, 0) and seen["items"] == (0, 1) and seen["examples"] == (0, 1)


def test_slices_give_the_same_items(spark, monkeypatch):
    parsed = rustdoc.parse(files(spark, range(12)))
    places = staged(rustdoc.located_paths(parsed))
    whole = ingest.stored_items(parsed, places, MODEL)
    monkeypatch.setattr(ingest, "SLICE_BYTES", 1)
    parts = ingest.slices(parsed)
    assert len(parts) > 2
    assert sum(parsed.index.where(p).count() for p in parts) == parsed.index.count() == 48
    cut = ingest.stored_items(parsed, places, MODEL)
    rows = [sorted(map(str, t.collect())) for t in (whole, cut)]
    assert rows[0] == rows[1]
    found = {(r.version, r.item_path): r.content for r in cut.collect()}
    # of items with one path that of the largest id stays, with its own text
    assert found["0.0.0", "io"] == "text 8 io" and found["1.0.0", "io"] == "text 9 io"
    assert found["1.0.0", "net::S5"] == "text 5" and found["0.0.0", "quiet"] == ""


def test_texts_stay_behind_until_paths_are_unique(spark):
    parsed = rustdoc.parse(files(spark, range(4)))
    places = staged(rustdoc.located_paths(parsed))
    plan = ingest.item_rows(parsed, places)._jdf.queryExecution().optimizedPlan().toString()
    assert "docs" not in plan and "content" not in plan


def test_staged_tables_of_a_block_go_with_it(spark, shared):
    with temporary(spark) as outer:
        staged(spark.range(3))
        with temporary(spark):
            inner = staged(spark.range(4).withColumn("x", F.lit("a")), "x")
            outer.clear()
            assert inner.count() == 4 and len(os.listdir(shared)) == 1
        assert not os.listdir(shared)
    kept = staged(spark.range(5))
    assert kept.count() == 5
