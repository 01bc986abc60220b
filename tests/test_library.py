import pytest
from pyspark.sql import functions as F

from docquarry import schemas
from docquarry.catalog.corpus import derived
from docquarry.operators.filters import item_condition
from docquarry.plans.library import TABLES, Library
from docquarry.sources import embedding, stdlib, store


def shaped(df, schema):
    """Rows with exactly the columns of a table schema."""
    have = set(df.columns)
    return df.select(
        *[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    )


@pytest.fixture(scope="module")
def library(spark, sf_dir, tmp_path_factory):
    items = derived(spark, sf_dir, "items").withColumn("version", F.lit("1.0.0")).drop("embedding")
    items = embedding.embed(items, embedding.item_text(), embedding.hashing_model(64))
    items = items.withColumn("doc_length", F.length("content"))
    newer = items.where("id % 10 <> 0").withColumn("version", F.lit("2.0.0"))
    tables = {
        "items": items.unionByName(newer),
        "crates": items.select("crate", "version").distinct(),
        "modules": derived(spark, sf_dir, "modules").withColumn("crate", F.lower("crate")),
        "reexports": derived(spark, sf_dir, "reexports"),
        "impls": derived(spark, sf_dir, "trait_impls"),
        "methods": derived(spark, sf_dir, "methods"),
        "associated": derived(spark, sf_dir, "associated_items"),
        "constraints": derived(spark, sf_dir, "generic_constraints"),
        "examples": embedding.embed_examples(store.extract_examples(items), embedding.hashing_model(64)).withColumn(
            "item_id", F.col("id")
        ),
        "status": spark.createDataFrame([], schemas.INGESTION_STATUS),
    }
    rows = {n: shaped(tables[n], s) for n, s in TABLES.items()}
    root = str(tmp_path_factory.mktemp("library"))
    for name, df in rows.items():
        if "version" in df.columns:
            rows[name] = df.fillna("1.0.0", ["version"])
    Library(**rows).save(root)
    return Library.open(spark, root, embedding.hashing_model(64))


def test_search_modes(library):
    assert library.search_items("en", "the async thing", 4, version="1.0.0").count() == 4
    assert library.search_items(["en", "de"], "the thing", 4).count() == 4
    hits = library.search_items("en", "x", 5, mode="regex", pattern="doc_1").collect()
    assert hits and all("doc_1" in r["item_path"] or r["score"] == 0.7 for r in hits)
    named = library.search_items("en", "en::src1::doc_1", 3, mode="fuzzy").collect()
    assert named[0]["item_path"].startswith("en::")
    with pytest.raises(ValueError):
        library.search_items("en", "x", mode="magic")


def test_latest_version_is_the_default(library):
    assert library.latest_version("en") == "1.0.0" and library.latest_version("nowhere") is None
    assert library._release(library.items, "en").select("version").distinct().collect()[0][0] == "1.0.0"
    assert library._release(library.items, "en", "2.0.0").count() < library._release(library.items, "en").count()


def test_partition_filter_reaches_the_scan(library):
    plan = library._release(library.items, "en", "1.0.0")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(crate" in plan and "version" in plan.split("PartitionFilters")[1]


def test_length_filter_needs_no_text(library):
    items = library._release(library.items, "en").select("id", "embedding", "doc_length", "item_path", "content")
    narrow = items.where(item_condition(min_doc_length=200, columns=items.columns)).select("id", "embedding")
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "doc_length" in plan and "content" not in plan
    assert library.search_items("en", "the thing", 3, min_doc_length=200).count() == 3


def test_reading(library):
    path = library.items.where("crate = 'en'").first()["item_path"]
    assert library.get_item_doc("en", path).first()["item_path"] == path
    assert library.get_documentation_detail("en", path, "expert").count() == 1
    assert library.get_code_intelligence("en", path).count() == 1
    assert library.search_examples("en", "open a file", 3).count() == 3
    assert library.get_crate_summary("asia").count() > 0
    assert library.get_module_tree("asia").where("parent_id IS NULL").count() == 1


def test_versions(library):
    changes = library.compare_versions("en", "1.0.0", "2.0.0")
    assert {r["change_type"] for r in changes.collect()} == {"removed"}
    steps = library.generate_learning_path("en", "1.0.0", "2.0.0").collect()
    assert [r["title"] for r in steps] == ["Address Breaking Changes"]
    with pytest.raises(ValueError):
        library.compare_versions("nowhere", "1.0.0", "2.0.0")


def test_types_and_links(library):
    assert library.get_trait_implementors("parts", "x::PROMO").count() > 0
    assert library.method_status("parts", "parts::T7", "m3").count() <= 1
    assert library.get_dependency_graph("en").count() > 0
    alias = library.reexports.where("crate = 'en' AND link_type = 'reexport'").first()["alias_path"]
    assert library.trace_reexports("en", alias).count() == 1
    assert library.resolve_import("en", "doc_1", True).count() >= 1


def test_stdlib_fallback(spark):
    rows = stdlib.fallback_items(spark, "std", "1.80.0").collect()
    assert len(rows) == 33 and rows[0]["item_path"] == "std" and rows[0]["parent_id"] is None
    assert stdlib.fallback_items(spark, "other", "1").first()["content"] == "Rust other library"


def test_embedding_is_deterministic_and_unit_length(spark):
    rows = spark.createDataFrame([("a b a",), ("",), (None,)], "content string").withColumn("header", F.lit(""))
    got = [r["embedding"] for r in embedding.embed(rows, embedding.item_text(), embedding.hashing_model(8)).collect()]
    assert sum(x * x for x in got[0]) == pytest.approx(1.0) and sum(got[1]) == 0
