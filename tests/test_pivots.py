"""Pruned nearest rows against a full scan, and the files they leave out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.operators import pivots, search

SCHEMA = "id long, embedding array<float>, kind string"


def clustered(width, n=3000, centres=12, seed=2):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((centres, width)) * 4
    rows = middle[rng.integers(0, centres, n)] + rng.standard_normal((n, width)) * 0.3
    return [(i, [float(v) for v in r], "ab"[i % 2]) for i, r in enumerate(rows.astype(np.float32))]


@pytest.mark.parametrize("width", [64, 384])
def test_same_rows_from_a_part_of_the_files(spark, tmp_path, width):
    rows = clustered(width)
    odd = [(10_000, None, "a"), (10_001, [], "a"), (10_002, [1.0] * 5, "a"), (10_003, [None] * width, "b"), (10_004, [float("nan")] * width, "b")]
    items = spark.createDataFrame(rows + odd, SCHEMA).repartition(4)
    layout = pivots.PivotLayout.write(items, str(tmp_path / "layout"), cells=16, files=24)
    assert layout.rows().count() == len(rows) + len(odd)
    whole = items.where("id < 10000")
    for probe in (0, 7, 1234):
        query = rows[probe][1]
        want = [(r.id, round(r.distance, 9)) for r in search.nearest(whole, query, 20).collect()]
        got = layout.nearest(query, 20)
        assert got.columns == ["id", "embedding", "kind", "distance"]
        assert [(r.id, round(r.distance, 9)) for r in got.collect()] == want
        wanted, every, _ = layout.files(query, 20)
        assert len(wanted) <= len(every) // 3
        read = {r[0] for r in got.select(F.input_file_name()).collect()}
        assert len(read) <= len(wanted)
        some = layout.nearest(query, 20, F.col("kind") == "b").collect()
        assert [r.id for r in some] == [r.id for r in search.nearest(whole.where("kind = 'b'"), query, 20).collect()]


def test_far_queries_and_small_tables_are_exact(spark, tmp_path):
    rows = clustered(8, n=50, centres=3)
    items = spark.createDataFrame(rows, SCHEMA)
    layout = pivots.PivotLayout.write(items, str(tmp_path / "layout"), cells=4, files=5)
    far = [100.0] * 8
    assert [r.id for r in layout.nearest(far, 7).collect()] == [r.id for r in search.nearest(items, far, 7).collect()]
    assert len(layout.nearest(far, 500).collect()) == 50
    assert layout.nearest([1.0, 2.0], 3).collect() == []
    empty = pivots.PivotLayout.write(items.limit(0), str(tmp_path / "empty"))
    assert empty.nearest(far, 3).collect() == []


def test_one_vector_that_repeats_is_spread(spark, tmp_path):
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 else [float(i), 0.0, 0.0], "a") for i in range(600)]
    layout = pivots.PivotLayout.write(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "layout"), cells=8, files=12)
    sizes = [r["count"] for r in layout.rows().groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) >= 10 and max(sizes) < 120
    assert [r.id for r in layout.nearest([1.0, 2.0, 3.0], 5).collect()] == [1, 2, 4, 5, 7]
