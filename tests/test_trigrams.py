"""Pattern search by postings against the whole scan, and the bytes it reads."""

import random

import pytest
from pyspark.sql import functions as F

from docquarry.operators import search, trigrams

PATTERNS = [
    "stupid", "needle", "NEEDLE", "need(le|ed)", "(alpha|beta)gamma", "alpha.*omega", "al+pha", "(abc)+def", "(abc)*def", "colou?r", "x{3}yzw", "[nm]eedle",
    "needle$", "^pkg::mod", "pkg::mod[0-9]+::item_7", "été", "ÉTÉ", "straße", r"a\.b\.c", r"\bword\b", r"\d{3}-\d{4}", "ab", "a|needle", "zzz|needle|omega",
    "(?:alpha|omega) end", "tail\\s+end", "item_1[0-9]", "no such text at all", ".*", "日本語",
]


@pytest.fixture(scope="module")
def items(spark):
    rnd = random.Random(4)
    words = "alpha beta gamma omega needle Needless needed colour color abcabcdef def xxxyzw été ÉTÉ Straße a.b.c word 555-1234 tail  end 日本語 stupid neeedle".split(" ")
    rows = [
        (i, f"pkg::mod{i % 7}::item_{i}", " ".join(rnd.choice(words) if rnd.random() < 0.04 else f"w{rnd.randrange(500)}" for _ in range(60)) if i % 50 else None, "function", None, None, None, None)
        for i in range(1500)
    ]
    schema = "id long, item_path string, content string, item_type string, examples string, visibility string, deprecated boolean, stability_level string"
    return spark.createDataFrame(rows, schema).repartition(4)


@pytest.fixture(scope="module")
def index(items, tmp_path_factory):
    return trigrams.TrigramIndex.write(items, str(tmp_path_factory.mktemp("grams") / "index"), files=8)


def test_same_rows_as_a_whole_scan(items, index, spark, tmp_path):
    kept = items.persist()
    for pattern in PATTERNS:
        want = [(r.id, r.score) for r in search.regex_search(kept, pattern, 40).collect()]
        assert [(r.id, r.score) for r in index.search(kept, pattern, 40).collect()] == want, pattern
        needed = trigrams.needed_text(pattern)
        if needed is not None:
            matching = {r.id for r in kept.where(F.col("content").rlike(f"(?i){pattern}") | F.col("item_path").rlike(f"(?i){pattern}")).collect()}
            assert matching <= {r.id for r in index.candidates(needed).collect()}, pattern


def test_few_rows_and_bytes_are_read(items, index, spark, tmp_path):
    items.sort("id").write.option("parquet.block.size", 16_384).option("parquet.page.size", 4_096).parquet(str(tmp_path / "items"))
    stored = spark.read.schema(items.schema).parquet(str(tmp_path / "items"))
    pattern = "pkg::mod3::item_1403"
    found = index.narrowed(stored, pattern)
    assert [r.id for r in index.search(stored, pattern).collect()] == [1403]
    assert found.count() < 60 < stored.count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(id" in plan or "EqualTo(id" in plan or "id IN" in plan


def test_needed_text():
    assert trigrams.needed_text("abc.*Def") == ("all", [("text", "abc"), ("text", "def")])
    assert trigrams.needed_text("(abc|xyz)q") == ("all", [("all", [("any", [("all", [("text", "abc")]), ("all", [("text", "xyz")])])])])
    for unknown in ("ab", "a*", "(abc)?", "abc|x", "(?i)abcd", "[a&&[b]]abcd", "abcd[", r"\Qabc\E", r"abc\v", "a{,3}bcd)"):
        assert trigrams.needed_text(unknown) is None, unknown


def test_more_ids_than_can_be_listed(items, index, monkeypatch):
    monkeypatch.setattr(trigrams, "LISTED_IDS", 3)
    want = [r.id for r in search.regex_search(items, "needle", 40).collect()]
    assert [r.id for r in index.search(items, "needle", 40).collect()] == want


def test_empty_tables(items, spark, tmp_path):
    none = trigrams.TrigramIndex.write(items.limit(0), str(tmp_path / "none"))
    assert none.search(items.limit(0), "needle").collect() == []


def test_ids_of_a_trigram_share_rows(items, index, spark):
    stored = spark.read.parquet(index.path)
    found = {(r.gram, r.id) for r in stored.select("gram", F.explode("ids").alias("id")).collect()}
    want = {(int(g), r.id) for r in items.collect() for t in (r.item_path, r.content) for g in trigrams.grams(t or "")}
    assert found == want
    assert stored.count() * 5 < len(want)
