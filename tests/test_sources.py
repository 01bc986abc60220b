import gzip
import io
import json
import tarfile

import pytest
import zstandard

from docquarry.functions import code, signatures
from docquarry.operators import metrics, topn, versions
from docquarry.sources import archives, cargo, rust_source, rustdoc, store

SOURCE = '''//! Top level
use std::fmt;

/// A thing.
///
/// More about it.

pub struct Thing<T> {
    x: T,
}

pub struct Undocumented;

pub fn long(
    a: u8,
    b: u8,
) -> u8 {
}

/// Not public
fn hidden() {}

/// Adds.
#[macro_export]
macro_rules! add {
    ($a:expr, $b:ident) => {
        $a + $b
    };
}

macro_rules! local { () => {}; }

/// Derives it.
#[proc_macro_derive(Fancy, attributes(x))]
pub fn derive_fancy(input: TokenStream) -> TokenStream {}
'''


@pytest.fixture()
def files(spark):
    return spark.createDataFrame([("kit", "kit-1.0/src/lib.rs", SOURCE)], "crate string, file string, text string")


def test_declarations(files):
    got = {r["header"]: r for r in rust_source.declarations(files).collect()}
    assert set(got) == {"Thing", "long", "derive_fancy"}
    assert got["Thing"]["item_path"] == "kit::Thing"
    assert got["Thing"]["content"] == "A thing.\n\nMore about it."
    assert got["long"]["signature"] == "pub fn long( a: u8, b: u8, ) -> u8 {"


def test_macros(files):
    got = {r["header"]: r for r in rust_source.macros(files).collect()}
    assert set(got) == {"add", "local", "Fancy"}
    assert got["add"]["visibility"] == "public" and got["local"]["visibility"] == "crate"
    assert got["add"]["content"] == "Adds." and got["Fancy"]["content"] == "Derives it."
    assert got["Fancy"]["item_type"] == "derive macro"
    arms = rust_source.macro_arms(rust_source.macros(files)).collect()
    assert {(r["name"], r["type"]) for r in arms} == {("a", "expression"), ("b", "identifier")}


def test_archive(spark, tmp_path):
    with tarfile.open(tmp_path / "kit-1.2.0.crate", "w:gz") as tar:
        for name in ("kit-1.2.0/src/lib.rs", "kit-1.2.0/tests/t.rs", "kit-1.2.0/README.md"):
            data = b"pub fn f() {}"
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    rows = rust_source.read_archives(spark, str(tmp_path)).collect()
    assert [(r["crate"], r["file"]) for r in rows] == [("kit", "kit-1.2.0/src/lib.rs")]


def test_decompress():
    data = b"text" * 100
    for packed in (data, gzip.compress(data), zstandard.ZstdCompressor().compress(data)):
        assert archives.decompress(packed) == data
    with pytest.raises(ValueError):
        archives.decompress(gzip.compress(data), limit=10)


def test_unpack_reports_broken_files(spark):
    rows = spark.createDataFrame([("a", bytearray(b"\x1f\x8bnope"))], "name string, content binary")
    got = archives.unpack(rows).head()
    assert got["text"] is None and got["error"]


def test_manifests(spark, tmp_path):
    (tmp_path / "Cargo.toml").write_text('[dependencies]\nserde = "1.0"\nx = {path = "y"}\n[workspace.dependencies]\nz = {version = "2"}')
    rows = cargo.crate_specs(cargo.read_manifests(spark, str(tmp_path))).collect()
    assert [r["spec"] for r in rows] == ["serde@1.0", "x@latest", "z@2"]
    with pytest.raises(ValueError):
        cargo.reader_for("package.json")


def test_rendered_types():
    path = {"resolved_path": {"name": "Vec", "args": {"angle_bracketed": {"args": [{"type": {"primitive": "u8"}}]}}}}
    assert signatures.render_type(path) == "Vec<u8>"
    assert signatures.render_type({"tuple": [path, {"generic": "T"}]}) == "(Vec<u8>, T)"
    assert signatures.render_type({"borrowed_ref": {"lifetime": "a", "mutable": True, "type": path}}) == "&'a mut Vec<u8>"
    assert signatures.render_type({"array": {"type": path, "len": 3}}) == "[Vec<u8>; 3]"
    assert signatures.render_type({"odd": 1}) == "UnknownType"
    assert signatures.render_type({"borrowed_ref": {"lifetime": "'a", "is_mutable": True, "type": path}}) == "&'a mut Vec<u8>"
    assert signatures.render_type({"borrowed_ref": {"lifetime": None, "is_mutable": False, "type": path}}) == "&Vec<u8>"
    assert signatures.render_type({"raw_pointer": {"is_mutable": False, "type": {"primitive": "u8"}}}) == "*const u8"
    function = {"path": "Fn", "args": {"parenthesized": {"inputs": [{"primitive": "u8"}], "output": {"generic": "T"}}}}
    assert signatures.render_type({"dyn_trait": {"traits": [{"trait": function}]}}) == "dyn Fn(u8) -> T"
    assert signatures.render_type({"impl_trait": [{"trait_bound": {"trait": {"path": "Iterator"}}}]}) == "impl Iterator"
    item = {"name": "Item", "self_type": {"generic": "I"}, "trait": {"path": "Iterator"}}
    assert signatures.render_type({"qualified_path": item}) == "<I as Iterator>::Item"


def test_rustdoc_traits_and_broken_file(spark):
    good = {
        "index": {
            "1": {"name": "T", "docs": "", "inner": {"trait": {"items": [], "bounds": []}}},
            "2": {"name": "", "docs": "", "inner": {"impl": {"trait": {"id": "1"}, "for": {"generic": "X"}, "negative": True, "items": []}}},
            "3": {"name": "", "docs": "", "inner": {"impl": {"trait": None, "for": {"generic": "X"}, "items": []}}},
        },
        "paths": {"1": {"path": ["k"], "kind": "trait"}},
    }
    files = spark.createDataFrame(
        [("k", "1.0.0", json.dumps(good)), ("bad", "1.0.0", "{oops")], "crate string, version string, text string"
    )
    files = rustdoc.parse(files)
    rows = rustdoc.trait_impls(files).collect()
    assert [(r["trait_path"], r["impl_type_path"], r["is_negative"]) for r in rows] == [("k::T", "X", True)]
    assert [r["item_path"] for r in rustdoc.items_table(files).collect()] == ["k::T"]


def test_examples_in_every_stored_form(spark):
    stored = ['[{"code": "a", "language": "toml"}]', '["b", "c"]', '"whole text"', "[]", None]
    rows = spark.createDataFrame([(s,) for s in stored], "examples string")
    got = [[e["code"] for e in r[0]] if r[0] is not None else None for r in rows.select(code.parse_examples(rows["examples"])).collect()]
    assert got == [["a"], ["b", "c"], ["whole text"], None, None]


def test_insert_ignore_keeps_stored_rows_and_null_keys(spark):
    schema = "crate string, trait_path string, impl_type_path string, generic_params string, seq int"
    old = spark.createDataFrame([("c", "T", "X", "[]", 0)], schema)
    new = spark.createDataFrame([("c", "T", "X", "[]", 1), ("c", "T", "Y", "[]", 3), ("c", "T", "Y", "[]", 2), ("c", "T", "X", None, 4), ("c", "T", "X", None, 5)], schema)
    got = sorted(r["seq"] for r in store.insert_ignore(old, new, "trait_impls", ["seq"]).collect())
    assert got == [0, 2, 4, 5]


def test_first_per_group_beyond_the_planner_limit(spark):
    rows = spark.range(5000).selectExpr("id % 2 AS g", "id AS v")
    got = topn.first_per_group(rows, ["g"], [rows["v"].desc()], 1500)
    assert got.count() == 3000 and got.agg({"v": "min"}).head()[0] == 2000


@pytest.mark.parametrize(
    "spec, expected",
    [("^1.0.0", "1.5.0"), ("~1.2.3", "1.2.5"), ("1.*", "1.5.0"), ("2.*", "2.1.0"), ("1.2.3", "1.2.3"), ("9.9.9", None), (">=1", "2.1.0")],
)
def test_version_matching(spark, spec, expected):
    names = ["1.0.0", "1.2.3", "1.2.5", "1.5.0", "2.0.0", "2.1.0", "2.2.0-alpha.1", "broken"]
    published = spark.createDataFrame([("c", v) for v in names], "crate string, version string")
    wanted = spark.createDataFrame([("c", spec)], "crate string, spec string")
    assert versions.best_versions(wanted, published).head()["matched_version"] == expected


def test_prereleases_count_only_without_a_stable_release(spark):
    names = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1"]
    published = spark.createDataFrame([("c", v) for v in names], "crate string, version string")
    wanted = spark.createDataFrame([("c", "1.*")], "crate string, spec string")
    assert versions.best_versions(wanted, published).head()["matched_version"] == "1.0.0-rc.1"
    from docquarry.functions.semver import sort_key

    ordered = [r["version"] for r in published.orderBy(sort_key(published["version"])).collect()]
    assert ordered == names


def test_status_keeps_last_known_values(spark):
    rows = [(1, 7, "c", "2024-01-01 00:00:00", "started", None, None), (2, 7, "c", "2024-01-01 00:01:00", "processing", 5, 9), (3, 7, "c", "2024-01-01 00:02:00", "failed", None, None)]
    log = spark.createDataFrame(rows, "seq bigint, crate_id bigint, crate string, t string, status string, items_processed bigint, total_items bigint")
    log = log.selectExpr("*", "to_timestamp_ntz(t) AS updated_at", "cast(NULL AS string) AS error_message", "cast(NULL AS string) AS ingestion_tier")
    got = metrics.merge_status(log).head()
    assert (got["status"], got["items_processed"], got["total_items"], got["completed_at"]) == ("failed", 5, 9, None)


def test_texts_become_objects_in_small_pieces():
    import pyarrow as pa

    from docquarry.plans.spread import pieces

    texts = ["a" * 400, None, "b" * 5000, "", "c" * 700, "d" * 300, "e" * 10]
    batch = pa.record_batch({"name": pa.array(range(7)), "text": pa.array(texts)})
    found = list(pieces(iter([batch, batch.slice(0, 0)]), "text", 1000))
    assert [t for p in found for t in p.column("text").to_pylist()] == texts
    assert max(sum(len(t or "") for t in p.column("text").to_pylist()) for p in found) == 5000 and len(found) > 2


def test_small_files_take_little_memory():
    import tracemalloc

    import zstandard

    packed = zstandard.compress(b"text " * 1000)
    tracemalloc.start()
    assert archives.decompress(packed) == b"text " * 1000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10_000_000
