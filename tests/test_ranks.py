"""Order statistics and running sums against sorted lists."""

import math
import random

import pytest

from docquarry.operators import metrics, ranks, versions


def groups(seed=1):
    rnd = random.Random(seed)
    rows = [("wide", rnd.choice([-1, 1]) * 10.0 ** rnd.uniform(-300, 300)) for _ in range(400)]
    rows += [("same", 2.5)] * 300 + [("ties", float(rnd.randrange(3))) for _ in range(300)] + [("one", 7.0)]
    rows += [(None, rnd.gauss(0, 1)) for _ in range(150)] + [("wide", None), ("none", None), ("nan", float("nan"))]
    rows += [("edge", v) for v in (1.7e308, -1.7e308, 0.0, 5e-324, -5e-324)]
    return rows


@pytest.mark.parametrize("share", [0.0, 0.5, 0.95, 1.0])
def test_values_at_ranks(spark, share):
    rows = groups()
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: (r.n, r.value) for r in ranks.value_at(df, ["k"], "v", share, few=20).collect()}
    want = {}
    for key in {k for k, _ in rows}:
        values = sorted(v for k, v in rows if k == key and v is not None and not math.isnan(v))
        if values:
            want[key] = len(values), values[min(int(len(values) * share), len(values) - 1)]
    assert got == want


def test_statistics_of_all_events(spark):
    rows = [(i, "a" if i % 3 else "b", float(i % 50)) for i in range(700)] + [(900, "c", None), (901, "d", 0.0)]
    df = spark.createDataFrame(rows, "event_id long, event_type string, duration double")
    got = {r.event_type: (r.events, r.avg_duration, r.p95_duration) for r in metrics.all_event_stats(df, ["event_type"]).collect()}
    for kind in "ab":
        values = sorted(v for _, k, v in rows if k == kind and v)
        n = sum(k == kind for _, k, _ in rows)
        assert got[kind] == (n, pytest.approx(sum(values) / len(values), abs=1e-3), values[int(len(values) * 0.95)])
    assert got["c"] == got["d"] == (1, 0.0, 0.0)
    assert "collect_list" not in metrics.all_event_stats(df, ["event_type"])._jdf.queryExecution().toString()


def test_running_sums_split_equal_leading_values(spark):
    rnd = random.Random(3)
    rows = [(0.0 if i % 10 else float(i), i, rnd.randrange(100)) for i in range(1000)]
    df = spark.createDataFrame(rows, "p double, i long, size long").repartition(3)
    got = {r.i: r.running_total for r in ranks.prefix_sums(df, "size", ["p", "i"], parts=7).collect()}
    total, want = 0, {}
    for p, i, size in sorted(rows):
        total += size
        want[i] = total
    assert got == want
    assert ranks.prefix_sums(df.limit(0), "size", ["p", "i"]).collect() == []
    plan = ranks.prefix_sums(df, "size", ["p", "i"])._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


def test_evictions_of_one_hot_count(spark):
    files = spark.createDataFrame([(f"c{i:03}", 10, i) for i in range(200)], "crate string, size_bytes long, mtime long")
    counts = spark.createDataFrame([("c007", 5)], "crate string, downloads long")
    gone = versions.evictions(files, counts, 1_500)
    assert sorted(r.crate for r in gone.collect()) == sorted([f"c{i:03}" for i in range(51) if i != 7])
