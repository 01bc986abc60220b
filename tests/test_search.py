import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry import params
from docquarry.functions import vectors
from docquarry.operators import search
from docquarry.operators.patterns import api_evolution
from docquarry.operators.topn import first_per_group

ITEMS = (
    "id bigint, item_path string, header string, content string, embedding array<float>, item_type string, "
    "examples string, visibility string, deprecated boolean, stability_level string, crate string"
)


def items_of(spark, matrix, **columns):
    rows = [
        (i, f"c::m::i{i}", f"h{i}", columns.get("content", "x" * 100), [float(x) for x in row], "function", None,
         "public" if i % 2 else "private", False, "stable", "c")
        for i, row in enumerate(matrix)
    ]
    return spark.createDataFrame(rows, ITEMS)


@pytest.mark.parametrize("dim", [3, 64, 384])
def test_distances_equal_numpy(spark, dim):
    rng = np.random.default_rng(1)
    matrix, query = rng.normal(size=(40, dim)).astype(np.float32), rng.normal(size=dim)
    rows = items_of(spark, matrix).select("id", vectors.l2_distance("embedding", query).alias("d"),
                                          vectors.cosine_similarity("embedding", query).alias("c"))
    got = {r["id"]: (r["d"], r["c"]) for r in rows.collect()}
    for i, row in enumerate(matrix.astype(float)):
        assert got[i][0] == pytest.approx(np.linalg.norm(row - query))
        assert got[i][1] == pytest.approx(row @ query / np.linalg.norm(row) / np.linalg.norm(query))


def test_wide_vectors_skip_broken_rows(spark):
    rows = spark.createDataFrame([(1, [1.0] * 200), (2, None), (3, [1.0])], "id int, embedding array<float>")
    got = {r["id"]: r["d"] for r in rows.select("id", vectors.l2_distance("embedding", [0.0] * 200).alias("d")).collect()}
    assert got[1] == pytest.approx(200**0.5) and got[2] is None and got[3] is None


def test_nearest_ignores_rows_without_vector(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0])], "id bigint, embedding array<float>")
    assert [r["id"] for r in search.nearest(rows, [0.0, 0.0], 5).collect()] == [1]


def test_filter_after_the_cut_may_return_fewer(spark):
    matrix = [[i, 0.0] for i in range(60)]
    items = items_of(spark, matrix)
    before = search.candidates(items, [0.0, 0.0], 5, "pre", visibility="public")
    after = search.candidates(items, [0.0, 0.0], 5, "post", visibility="public")
    assert before.count() == 15 and after.count() == 7


def test_late_read_equals_single_read(spark):
    items = items_of(spark, np.random.default_rng(2).normal(size=(50, 4)))
    once = [r["id"] for r in search.nearest(items, [0.0] * 4, 7).collect()]
    twice = [r["id"] for r in search.nearest_late(items, [0.0] * 4, 7).collect()]
    assert once == twice


def greedy(scores, matrix, k, balance):
    """The definition, pair by pair."""
    chosen = [0]
    while len(chosen) < min(k, len(scores)):
        best, at = -np.inf, None
        for i in range(len(scores)):
            if i in chosen:
                continue
            sims = [0.0]
            for j in chosen:
                size = np.linalg.norm(matrix[i]) * np.linalg.norm(matrix[j])
                sims.append(matrix[i] @ matrix[j] / size if size else 0.0)
            gain = balance * scores[i] + (1 - balance) * (1 - max(sims))
            if gain > best + 1e-12:
                best, at = gain, i
        chosen.append(at)
    return chosen


def test_diversification_equals_definition():
    rng = np.random.default_rng(3)
    for trial in range(30):
        n = int(rng.integers(2, 20))
        matrix = rng.normal(size=(n, 5))
        if trial % 3 == 0:
            matrix[rng.integers(0, n)] = 0  # a zero vector must not stall the choice
        scores = np.sort(rng.random(n))[::-1]
        assert search._select_diverse(scores, matrix, 6, 0.6) == greedy(scores, matrix, 6, 0.6)


def test_no_diversification_without_surplus(spark):
    found = search.search(items_of(spark, [[1.0, 0.0], [0.0, 1.0]]), [1.0, 0.0], 5)
    assert [r["position"] for r in found.collect()] == [1, 2]


def test_score_is_clamped_and_boosted(spark):
    items = items_of(spark, [[0.0, 0.0], [9.0, 9.0]], content="x" * 5000)
    scored = search.candidates(items, [0.0, 0.0], 5).orderBy("id").collect()
    assert scored[0]["score"] == 1.0  # 0.6 + 0.18 + 0.1 + 0.15 is over the top
    assert scored[1]["score"] == 0.0


def test_regex_scores(spark):
    rows = [(1, "a::Foo", "h", "text", None), (2, "a::b", "h", "about foo", None), (3, "foo", "h", "", None)]
    items = spark.createDataFrame(rows, "id bigint, item_path string, header string, content string, examples string")
    got = [(r["id"], r["score"]) for r in search.regex_search(items, "foo").collect()]
    assert got == [(3, 1.5), (1, 1.0), (2, 0.7)]
    first = [r["id"] for r in search.regex_search(items, "foo", k=2, first_hits=True).collect()]
    assert first == [1, 2]


@pytest.mark.parametrize("pattern", ["(a+)+", "(a*)*", "(a?)?", "a+b+", "a*b*", "(", "(a{2,3})+"])
def test_dangerous_patterns_are_refused(pattern):
    with pytest.raises(ValueError):
        params.safe_regex(pattern)


def test_fusion_adds_reciprocal_ranks(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "y"), ("b", 2, "z")]
    placed = spark.createDataFrame(rows, "crate string, position int, item_path string")
    placed = placed.withColumns({"header": F.col("item_path"), "content": F.col("item_path")})
    got = [(r["item_path"], r["score"]) for r in search.fuse(placed, ["a", "b"], 3).collect()]
    assert [p for p, _ in got] == ["y", "x", "z"]
    assert got[0][1] == pytest.approx(1 / 62 + 1 / 61)


def test_too_many_crates():
    with pytest.raises(ValueError):
        params.crate_list("a,b,c,d,e,f")
    assert params.crate_list("a, b,a") == ["a", "b"]


def test_plan_takes_top_rows_without_shuffle(spark):
    items = items_of(spark, [[1.0, 0.0]])
    plan = search.nearest(items, [0.0, 0.0], 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_groups_are_cut_before_the_shuffle(spark):
    rows = spark.range(10).selectExpr("id % 2 AS crate", "id")
    plan = first_per_group(rows, ["crate"], [F.asc("id")], 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_second_read_is_pruned_by_id(spark, sf_dir):
    items = spark.read.schema("doc_id bigint, text string").parquet(f"{sf_dir}/documents.parquet")
    found = search._with_distances(items.withColumnRenamed("doc_id", "id"), [{"id": 3, "distance": 0.5}])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,3)" in plan or "In(doc_id" in plan
    assert [(r["id"], r["distance"]) for r in found.collect()] == [(3, 0.5)]


def test_copies_of_examples_take_no_places(spark):
    rows = [(i, "c", "rust", "same", [0.0, 0.1]) for i in range(100)] + [(100 + i, "c", "rust", f"h{i}", [0.0, 1.0 + i]) for i in range(20)]
    rows += [(200, "c", "rust", None, [0.0, 0.2]), (201, "c", "rust", None, [0.0, 0.3]), (202, "c", "rust", "h99", None)]
    examples = spark.createDataFrame(rows, "id bigint, crate string, language string, example_hash string, embedding array<float>")
    got = [r["id"] for r in search.search_examples(examples, [0.0, 0.0], k=5).collect()]
    assert got == [0, 200, 100, 101, 102]


def test_releases_meet_counted_items(spark):
    releases = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("a", "1")], "crate string, version string")
    items = spark.createDataFrame(
        [("a", "1", f"p{i % 7}", i % 7 == 0, "function") for i in range(50)] + [("a", "2", "p", None, None)],
        "crate string, version string, item_path string, deprecated boolean, item_type string",
    )
    got = {tuple(r)[:5]: r["stability_score"] for r in api_evolution(releases, items).collect()}
    assert got == {("a", "1", 7, 1, 1): pytest.approx(6 / 7), ("a", "2", 1, 0, 0): 1.0, ("b", "1", 0, 0, 0): 1.0}
