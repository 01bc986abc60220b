"""From files to searches: releases apart, rows replaced once, bounds of generics."""

import json

import pytest
from pyspark.sql import functions as F

from docquarry.plans.library import Library
from docquarry.sources import embedding, ingest, rustdoc

MODEL = embedding.hashing_model(64)


def a_file(docs, methods=("new",), bound="Clone"):
    """One struct ``net::Conn`` with inherent methods, and two impl blocks that both have ``from``."""
    index = {
        "0": {"name": "Conn", "docs": docs, "visibility": "public", "inner": {"struct": {"generics": {
            "params": [{"name": "T", "kind": {"type": {"bounds": [{"trait_bound": {"trait": {"name": bound}}}]}}}],
            "where_predicates": [{"bound_predicate": {"type": {"generic": "T"}, "bounds": [{"outlives": "'static"}]}},
                                 {"bound_predicate": {"type": {"qualified_path": {"name": "Item"}}, "bounds": []}}]}}}},
        "i": {"name": None, "docs": "", "inner": {"impl": {
            "trait": None, "for": {"resolved_path": {"name": "Conn", "id": "0"}}, "items": [f"m{m}" for m in methods]}}},
    }
    for m in methods:
        index[f"m{m}"] = {"name": m, "docs": f"{m} a conn", "inner": {"function": {"decl": {"inputs": [], "output": None}}}}
    for kind in ("u8", "u16"):
        trait = {"name": "From", "args": {"angle_bracketed": {"args": [{"type": {"primitive": kind}}]}}}
        index[f"i{kind}"] = {"name": None, "docs": "", "inner": {"impl": {
            "trait": trait, "for": {"resolved_path": {"name": "Conn", "id": "0"}}, "items": [f"f{kind}"]}}}
        index[f"f{kind}"] = {"name": "from", "docs": f"from {kind}", "inner": {"function": {
            "decl": {"inputs": [["x", {"primitive": kind}]], "output": None}}}}
    return json.dumps({"index": index, "paths": {"0": {"crate_id": 0, "path": ["net", "Conn"], "kind": "struct"}}})


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "crate string, version string, text string")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("ingested"))
    ingest.ingest(frame(spark, ("net", "1.0.0", a_file("opens a socket", ("new", "old"))), ("net", "0.9.0", "{broken")), root, MODEL)
    ingest.ingest(frame(spark, ("net", "2.0.0", a_file("opens a quick channel", bound="Send"))), root, MODEL)
    for _ in range(2):  # again: same rows
        ingest.ingest(frame(spark, ("net", "1.0.0", a_file("opens a slow socket"))), root, MODEL)
    return Library.open(spark, root, MODEL)


def test_releases_stay_apart_and_rows_are_replaced(stored):
    rows = stored.items.select("version", "item_path", "content").collect()
    found = {(r.version, r.item_path): r.content for r in rows}
    assert len(found) == len(rows)
    assert found["1.0.0", "net::Conn"] == "opens a slow socket"
    assert found["2.0.0", "net::Conn"] == "opens a quick channel"
    assert ("1.0.0", "net::Conn::old") in found and ("2.0.0", "net::Conn::old") not in found
    # both impls of one trait keep their method
    for version in ("1.0.0", "2.0.0"):
        texts = {v for (w, p), v in found.items() if w == version and p.startswith("net::Conn::From::from")}
        assert texts == {"from u8", "from u16"}
    assert sorted(r.version for r in stored.crates.collect()) == ["1.0.0", "2.0.0"]
    assert stored.methods.groupBy("version", "parent_type_path", "method_name", "full_signature").count().where("count > 1").isEmpty()


def test_search_finds_what_was_ingested(stored):
    first = stored.search_items("net", "opens a quick channel", 1).collect()
    assert [r.item_path for r in first] == ["net::Conn"] and "quick" in first[0].snippet
    first = stored.search_items("net", "opens a slow socket", 1, version="1.0.0").collect()
    assert "slow" in first[0].snippet


def test_types_are_read_per_release(stored):
    now = stored.get_generic_constraints("net", "net::Conn").collect()
    before = stored.get_generic_constraints("net", "net::Conn", "1.0.0").collect()
    assert [r.bounds for r in now] == ["Send + 'static"] and [r.bounds for r in before] == ["Clone + 'static"]
    assert stored.resolve_method("net", "Conn", "new").count() == 1
    assert stored.resolve_method("net", "Conn", "old").count() == 0
    assert stored.resolve_method("net", "Conn", "old", "1.0.0").count() == 1
    assert stored.method_status("net", "Conn", "new").select("version", "candidates").collect() == [("2.0.0", 1)]
    assert stored.get_type_traits("net", "Conn").count() == 2


def test_files_without_entries_give_no_rows(spark):
    files = rustdoc.parse(frame(spark, ("a", "1", None), ("b", "1", "{}"), ("c", "1", "not json")))
    for name, rows in ingest.tables(files, MODEL).items():
        assert rows.isEmpty(), name


def test_ids_are_the_same_in_every_release(stored):
    per_path = stored.items.groupBy("item_path").agg(F.count_distinct("id").alias("n"))
    assert per_path.where("n > 1").isEmpty()


def generics(spark, params, where=()):
    """Constraints of one struct with these parameters and where clauses, without the keys."""
    body = {"generics": {"params": params, "where_predicates": list(where)}}
    text = json.dumps({"index": {"0": {"name": "S", "docs": "", "inner": {"struct": body}}}, "paths": {}})
    found = rustdoc.generic_constraints(rustdoc.parse(frame(spark, ("a", "1", text))))
    return found, [(r.position, r.param_name, r.param_kind, r.bounds, r.default_value) for r in found.orderBy("position").collect()]


def test_generics_of_odd_shapes(spark):
    trait = {"trait_bound": {"trait": {"name": "Into", "args": {"angle_bracketed": {"args": [{"type": {"primitive": "u8"}}]}}}}}
    maybe = {"trait_bound": {"trait": {"name": "Sized"}, "modifier": "maybe"}}
    _, rows = generics(
        spark,
        [
            {"name": "'a", "kind": {"lifetime": {"outlives": ["'b", "'b"]}}},
            {"name": "T", "kind": {"type": {"bounds": [trait, maybe, trait, None], "default": "u8"}}},
            None,
            "not an object",
            {"kind": {"type": {}}},
            {"name": "N", "kind": {"const": {"type": {"primitive": "usize"}, "default": 3}}},
            {"name": 7, "kind": "odd"},
            {"name": "E", "kind": {"type": {"bounds": {"trait": "X"}, "default": {"generic": "T"}}}},
        ],
        [
            {"bound_predicate": {"type": {"generic": "T"}, "bounds": [{"trait": "Send"}, {"outlives": "'a"}]}},
            {"lifetime_predicate": {"lifetime": "'a", "outlives": ["'c"]}},
            {"region_predicate": {"lifetime": "a", "bounds": []}},
            {"bound_predicate": {"type": {"qualified_path": {"name": "Item"}}, "bounds": [trait]}},
            "odd",
        ],
    )
    assert rows == [
        (0, "'a", "lifetime", "'b + 'c", None),
        (1, "T", "type", "Into<u8> + ?Sized + Send + 'a", "u8"),
        (5, "N", "const", "usize", "3"),
        (6, "7", "type", None, None),
        (7, "E", "type", None, "T"),
    ]


def test_generics_are_parsed_once_per_item(spark):
    """No JSON path inside a lambda: there it parses a text anew for each field of each bound."""
    found, _ = generics(spark, [{"name": "T", "kind": {"type": {"bounds": []}}}])
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_and_entries_are_computed_once(spark):
    """Types are rendered and places joined once for all tables of the same files."""
    files = rustdoc.parse(frame(spark, ("net", "1", a_file("x"))))
    plans = [t._jdf.queryExecution().optimizedPlan().toString()
             for t in (rustdoc.trait_rows(files), rustdoc.located_paths(files), rustdoc.generic_constraints(files))]
    assert files.blocks is files.blocks and files.entries is files.entries
    # what is left renders trait arguments of blocks; their types are not rendered again
    assert not any('$.for)' in plan for plan in plans)
