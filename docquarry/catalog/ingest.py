"""Registered sources, sinks and streams.

Source files are made from the given tables: every document turns into a small
rustdoc file, a Rust source file and a manifest, so the work grows with them.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from docquarry.catalog.corpus import derived, table, with_tables
from docquarry.catalog.registry import query
from docquarry.functions import signatures
from docquarry.operators import search
from docquarry.plans.library import Library
from docquarry.plans.spread import spread
from docquarry.session import shared_dir
from docquarry.sources import ingest as chain
from docquarry.sources import archives, cargo, embedding, rust_source, rustdoc, store
from docquarry.streaming import events as streams
from docquarry.streaming import stateful

# %1$s is the document number, %2$s its text as JSON
RUSTDOC = """{"index": {
"0:0": {"name": "c%1$s", "crate_id": 0, "docs": "root", "visibility": "public", "inner": {"module": {"items": []}}},
"0:1": {"name": "S%1$s", "crate_id": 0, "docs": %2$s, "visibility": "public", "links": {"the trait": "0:2", "gone": "9:9"},
  "deprecation": {"since": "1.0"}, "inner": {"struct": {"generics": {"params": [{"name": "T", "kind": {"type": {"bounds": []}}}]}}}},
"0:2": {"name": "Tr", "crate_id": 0, "docs": "", "attrs": ["#[unstable]"], "inner": {"trait": {"is_unsafe": %3$s, "items": ["0:5", "0:6", "0:7", "0:9"],
  "bounds": [{"trait_bound": {"trait": {"name": "Display", "id": "7:7"}}}, {"resolved_path": {"name": "Base", "id": "1:1"}}],
  "generics": {"params": [], "where_predicates": []}}}},
"0:3": {"name": null, "docs": "", "inner": {"impl": {"trait": {"name": "Tr", "id": "0:2"},
  "for": {"resolved_path": {"name": "S%1$s", "id": "0:1", "args": {"angle_bracketed": {"args": [{"type": {"generic": "T"}}]}}}},
  "items": ["0:8"], "generics": {"params": [{"name": "T"}], "where_predicates": [{"bound_predicate": {}}]}, "negative": false, "synthetic": false}}},
"0:4": {"name": "", "docs": "", "inner": {"impl": {"trait": null, "for": {"resolved_path": {"name": "S%1$s", "id": "0:1"}}, "items": ["0:10"],
  "generics": {"params": [], "where_predicates": []}}}},
"0:5": {"name": "Out", "docs": "kind of output", "inner": {"assoc_type": {"bounds": []}}},
"0:6": {"name": "MAX", "docs": "limit", "inner": {"assoc_const": {"type": {"primitive": "u32"}, "default": "%1$s"}}},
"0:7": {"name": "run", "docs": "runs", "inner": {"function": {"decl": {"inputs": [], "output": null}}}},
"0:8": {"name": "run", "docs": "runs it", "inner": {"function": {"sig": {"inputs": [["self", {"borrowed_ref": {"is_mutable": false, "type": {"generic": "Self"}}}],
  ["n", {"primitive": "usize"}]], "output": {"resolved_path": {"name": "Result", "args": {"angle_bracketed": {"args": [{"type": {"primitive": "u8"}},
  {"type": {"resolved_path": {"name": "E%1$s"}}}]}}}}}, "generics": {"params": []}, "header": {"is_async": true}}}},
"0:9": {"name": "stop", "docs": "stops", "inner": {"function": {"decl": {"inputs": [], "output": null}}}},
"0:10": {"name": "make", "docs": "makes", "inner": {"function": {"decl": {"inputs": [["v", {"slice": {"primitive": "u8"}}], ["t", {"tuple": [{"primitive": "i8"}, {"generic": "T"}]}]],
  "output": {"generic": "Self"}, "header": {"unsafety": "unsafe", "constness": "const"}}, "generics": {"params": [{"name": "a", "kind": {"lifetime": {}}},
  {"name": "T", "kind": {"type": {"bounds": [{"trait": {"name": "Clone"}}]}}}, {"name": "N", "kind": {"const": {"type": {"primitive": "usize"}}}}]}}}},
"0:11": {"name": "io", "docs": "", "inner": {"use": {"source": "std::io", "name": "io", "is_glob": %3$s}}},
"0:12": {"name": null, "docs": null, "inner": {}}},
"paths": {"0:0": {"crate_id": 0, "path": ["c%1$s"], "kind": "module"}, "0:1": {"crate_id": 0, "path": ["c%1$s", "m", "S%1$s"], "kind": "struct"},
"0:2": {"crate_id": 0, "path": ["c%1$s"], "kind": "trait"}, "0:13": {"crate_id": 0, "path": ["c%1$s", "m"], "kind": "module"},
"1:1": {"crate_id": 1, "path": ["ext", "Base"], "kind": "trait"}}}"""


def _rustdoc(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    number = F.col("doc_id").cast("string")
    text = F.expr("substring(to_json(named_struct('d', text)), 6, length(to_json(named_struct('d', text))) - 6)")
    unsafe = F.when(F.col("doc_id") % 2 == 0, "true").otherwise("false")
    files = docs.select(
        F.concat(F.lit("c"), number).alias("crate"),
        F.lit("1.0.0").alias("version"),
        F.format_string(RUSTDOC, number, text, unsafe).alias("text"),
    )
    return rustdoc.parse(files)


@query(
    "src1_rustdoc_items",
    """WITH d AS (SELECT 'c' || CAST(doc_id AS VARCHAR) AS crate, CAST(doc_id AS VARCHAR) AS n, text FROM documents)
    SELECT crate, '0:0' AS item_id, crate AS item_path, 'module' AS item_type, crate AS header, 'root' AS content, NULL AS signature, FALSE AS deprecated FROM d
    UNION ALL SELECT crate, '0:1', crate || '::m::S' || n, 'struct', 'S' || n, text, NULL, TRUE FROM d
    UNION ALL SELECT crate, '0:2', crate || '::Tr', 'trait', 'Tr', '', NULL, FALSE FROM d
    UNION ALL SELECT crate, '0:5', 'Out', 'type', 'Out', 'kind of output', NULL, FALSE FROM d
    UNION ALL SELECT crate, '0:6', 'MAX', 'const', 'MAX', 'limit', 'u32', FALSE FROM d
    UNION ALL SELECT crate, '0:7', 'run', 'function', 'run', 'runs', 'fn run()', FALSE FROM d
    UNION ALL SELECT crate, '0:8', 'run', 'function', 'run', 'runs it', 'fn run(self: &Self, n: usize) -> Result<u8, E' || n || '>', FALSE FROM d
    UNION ALL SELECT crate, '0:9', 'stop', 'function', 'stop', 'stops', 'fn stop()', FALSE FROM d
    UNION ALL SELECT crate, '0:10', 'make', 'function', 'make', 'makes', 'fn make<''a, T: Clone, const N: usize>(v: [u8], t: (i8, T)) -> Self', FALSE FROM d
    UNION ALL SELECT crate, '0:11', 'io', 'use', 'io', '', NULL, FALSE FROM d""",
)
def src1_rustdoc_items(spark, sf_dir):
    items = rustdoc.items_table(_rustdoc(spark, sf_dir))
    return items.select("crate", "item_id", "item_path", "item_type", "header", "content", "signature", "deprecated")


@query(
    "src2_rustdoc_item_facts",
    """SELECT item_type, stability_level, errors, is_generic, count(*) AS n FROM (
      SELECT unnest(['module', 'struct', 'trait', 'type', 'const', 'function', 'function', 'function', 'function', 'use']) AS item_type,
        unnest(['stable', 'deprecated', 'unstable', 'stable', 'stable', 'stable', 'stable', 'stable', 'stable', 'stable']) AS stability_level,
        unnest(['', '', '', '', '', '', 'E', '', '', '']) AS errors,
        unnest([FALSE, TRUE, FALSE, FALSE, FALSE, FALSE, FALSE, FALSE, TRUE, FALSE]) AS is_generic FROM documents)
    GROUP BY item_type, stability_level, errors, is_generic""",
)
def src2_rustdoc_item_facts(spark, sf_dir):
    items = rustdoc.items_table(_rustdoc(spark, sf_dir))
    return items.groupBy(
        "item_type",
        "stability_level",
        F.substring(F.array_join("error_types", ","), 1, 1).alias("errors"),
        F.col("generic_params").isNotNull().alias("is_generic"),
    ).agg(F.count("*").alias("n"))


@query(
    "tst3_module_rows",
    """SELECT 'c' || CAST(doc_id AS VARCHAR) AS crate, m.path_end AS name, CAST(m.depth AS INTEGER) AS depth, m.parent AS parent_id, CAST(m.n AS BIGINT) AS item_count
    FROM documents, LATERAL (VALUES ('c' || CAST(doc_id AS VARCHAR), 0, NULL, 1), ('m', 1, '0:0', 1)) m(path_end, depth, parent, n)""",
)
def tst3_module_rows(spark, sf_dir):
    modules = rustdoc.modules_table(_rustdoc(spark, sf_dir))
    return modules.select("crate", "name", "depth", "parent_id", "item_count")


@query(
    "typ8_trait_impls",
    """SELECT 'c' || CAST(doc_id AS VARCHAR) AS crate, 'c' || CAST(doc_id AS VARCHAR) || '::Tr' AS trait_path, 'S' || CAST(doc_id AS VARCHAR) || '<T>' AS impl_type_path,
      FALSE AS is_blanket, FALSE AS is_negative, 'impl<T> c' || CAST(doc_id AS VARCHAR) || '::Tr for S' || CAST(doc_id AS VARCHAR) || '<T> where ...' AS impl_signature
    FROM documents""",
)
def typ8_trait_impls(spark, sf_dir):
    found = rustdoc.trait_impls(_rustdoc(spark, sf_dir))
    return found.select("crate", "trait_path", "impl_type_path", "is_blanket", "is_negative", "impl_signature")


@query(
    "typ9_rendered_types",
    """SELECT page_id, CASE page_id % 5 WHEN 0 THEN '&''a mut [T' || CAST(page_id AS VARCHAR) || '; 4]' WHEN 1 THEN '(u' || CAST(page_id AS VARCHAR) || ',)'
      WHEN 2 THEN 'Map<K, Vec<V' || CAST(page_id AS VARCHAR) || '>>' WHEN 3 THEN 'fn(...)' ELSE '[&P' || CAST(page_id AS VARCHAR) || ']' END AS rendered FROM pages""",
)
def typ9_rendered_types(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    trees = [
        '{"borrowed_ref": {"lifetime": "a", "mutable": true, "type": {"array": {"type": {"generic": "T%s"}, "len": "4"}}}}',
        '{"tuple": [{"primitive": "u%s"}]}',
        '{"resolved_path": {"name": "Map", "args": {"angle_bracketed": {"args": [{"type": {"generic": "K"}}, {"type": {"resolved_path": '
        '{"name": "Vec", "args": {"angle_bracketed": {"args": [{"type": {"path": "V%s"}}]}}}}}]}}}}',
        '{"function_pointer": {"n": "%s"}}',
        '{"slice": {"borrowed_ref": {"type": {"path": {"name": "P%s"}}}}}',
    ]
    turn = F.col("page_id") % 5
    tree = F.lit(None)
    for i, text in enumerate(trees):
        tree = F.when(turn == i, F.format_string(text, F.col("page_id").cast("string"))).otherwise(tree)
    return pages.select("page_id", signatures.type_name(tree).alias("rendered"))


@query(
    "typ10_trait_names",
    """SELECT kind, full_name, count(*) AS n FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN 'Display' WHEN 1 THEN 'Iterator' WHEN 2 THEN 'ToString' ELSE p_type END AS kind,
      CASE p_partkey % 4 WHEN 0 THEN 'core::fmt::Display' WHEN 1 THEN 'core::iter::Iterator' WHEN 2 THEN 'alloc::string::ToString' ELSE p_type END AS full_name FROM part)
    GROUP BY kind, full_name""",
)
def typ10_trait_names(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    names = F.array(F.lit("Display"), F.lit("Iterator"), F.lit("ToString"), F.col("p_type"))
    kind = F.get(names, (F.col("p_partkey") % 4).cast("int"))
    named = parts.select(kind.alias("kind"), rustdoc.standard_trait(kind).alias("full_name"))
    return named.groupBy("kind", "full_name").agg(F.count("*").alias("n"))


@query(
    "typ11_trait_definitions",
    """SELECT 'c' || CAST(doc_id AS VARCHAR) AS crate, 'c' || CAST(doc_id AS VARCHAR) || '::Tr' AS trait_path, doc_id % 2 = 0 AS is_unsafe,
      'unstable' AS stability_level, s AS supertrait FROM documents, (VALUES ('core::fmt::Display'), ('ext::Base')) v(s)""",
)
def typ11_trait_definitions(spark, sf_dir):
    files = _rustdoc(spark, sf_dir)
    traits = rustdoc.traits(files).select("crate", "version", "trait_path", "is_unsafe", "stability_level")
    joined = traits.join(rustdoc.supertrait_rows(files), ["crate", "version", "trait_path"])
    return joined.select("crate", "trait_path", "is_unsafe", "stability_level", "supertrait")


@query(
    "join11_associated_items",
    """SELECT 'c' || CAST(doc_id AS VARCHAR) AS crate, v.name AS item_name, v.kind AS item_kind, v.sig AS item_signature,
      CASE WHEN v.kind = 'const' THEN CAST(doc_id AS VARCHAR) END AS default_value FROM documents,
      (VALUES ('Out', 'type', 'type Out'), ('MAX', 'const', 'const MAX: u32'), ('run', 'function', 'fn run(...)'), ('stop', 'function', 'fn stop(...)')) v(name, kind, sig)""",
)
def join11_associated_items(spark, sf_dir):
    found = rustdoc.associated_items(_rustdoc(spark, sf_dir))
    return found.select("crate", "item_name", "item_kind", "item_signature", "default_value")


@query(
    "typ12_methods",
    """SELECT 'c' || CAST(doc_id AS VARCHAR) AS crate, v.name AS method_name, v.kind AS method_kind, v.receiver AS receiver_type,
      v.a AS is_async, v.u AS is_unsafe, v.c AS is_const, v.id AS item_id FROM documents,
      (VALUES ('run', 'trait', '&self', TRUE, FALSE, FALSE, '0:8'), ('make', 'inherent', NULL, FALSE, TRUE, TRUE, '0:10'),
        ('stop', 'trait', NULL, NULL, NULL, NULL, 'default_stop')) v(name, kind, receiver, a, u, c, id)""",
)
def typ12_methods(spark, sf_dir):
    found = rustdoc.methods(_rustdoc(spark, sf_dir))
    return found.select(
        "crate", "method_name", "method_kind", "receiver_type", "is_async", "is_unsafe", "is_const", "item_id"
    )


@query(
    "strf12_function_signature",
    """SELECT page_id, '<T: Clone + Send>(x' || CAST(page_id AS VARCHAR) || ': u8, y: Option<T>)' || CASE WHEN page_id % 2 = 0 THEN ' -> Box<T>' ELSE '' END AS signature FROM pages""",
)
def strf12_function_signature(spark, sf_dir):
    body = """{"decl": {"inputs": [{"name": "x%1$s", "type": {"primitive": "u8"}}, ["y", {"resolved_path": {"name": "Option", "args": {"angle_bracketed":
      {"args": [{"type": {"generic": "T"}}]}}}}]], "output": %2$s}, "generics": {"params": [{"name": "T", "kind": {"type": {"bounds": [{"trait": {"name": "Clone"}},
      {"trait": {"resolved_path": {"name": "Send"}}}]}}}]}}"""
    boxed = '{"resolved_path": {"name": "Box", "args": {"angle_bracketed": {"args": [{"type": {"generic": "T"}}]}}}}'
    output = F.when(F.col("page_id") % 2 == 0, boxed).otherwise("null")
    pages = table(spark, sf_dir, "pages").select(
        "page_id",
        F.lit("function").alias("inner_kind"),
        F.format_string(body, F.col("page_id").cast("string"), output).alias("body"),
    )
    return rustdoc.with_signature(pages, name=False).select("page_id", "signature")


@query(
    "tst1_reexports",
    """SELECT 'c' || CAST(doc_id AS VARCHAR) || '::io' AS alias_path, 'std::io' AS actual_path, doc_id % 2 = 0 AS is_glob FROM documents""",
)
def tst1_reexports(spark, sf_dir):
    return rustdoc.reexports(_rustdoc(spark, sf_dir)).select("alias_path", "actual_path", "is_glob")


@query(
    "tst2_cross_references",
    """SELECT 'c' || CAST(doc_id AS VARCHAR) || '::m::S' || CAST(doc_id AS VARCHAR) AS source_path,
      'c' || CAST(doc_id AS VARCHAR) || '::Tr' AS target_path, 'the trait' AS link_text FROM documents""",
)
def tst2_cross_references(spark, sf_dir):
    return rustdoc.cross_references(_rustdoc(spark, sf_dir)).select("source_path", "target_path", "link_text")


@query(
    "tst4_combined_filters",
    with_tables(
        "items",
        """SELECT id, item_path FROM items WHERE item_type = 'struct' AND starts_with(item_path, 'en::') AND visibility = 'public'
        AND deprecated = FALSE AND examples IS NOT NULL AND length(content) >= 100""",
    ),
)
def tst4_combined_filters(spark, sf_dir):
    from docquarry.operators.filters import filter_items

    kept = filter_items(
        derived(spark, sf_dir, "items"),
        item_type="struct", crate="en", visibility="public", deprecated=False, has_examples=True, min_doc_length=100,
    )
    return kept.select("id", "item_path")


# --- Rust sources, manifests, archives


def _sources(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    number = F.col("doc_id").cast("string")
    file = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("c-1.0/src/lib.rs")))
        .when(F.col("doc_id") % 3 == 1, F.lit("c-1.0/src/net/mod.rs"))
        .otherwise(F.lit("c-1.0/src/io.rs"))
    )
    comment = F.concat(F.lit("/// "), F.regexp_replace("text", "\n", "\n/// "))
    text = F.concat_ws(
        "\n",
        F.lit("//! Module docs"),
        F.lit("//!  second line"),
        F.lit("use std::io;"),
        comment,
        F.lit(""),
        F.concat(F.lit("pub struct S"), number, F.lit("<T> {")),
        F.lit("}"),
        F.lit("pub struct Plain;"),
        F.lit("pub async fn run("),
        F.lit("    a: u8,"),
        F.lit(") -> u8 {"),
        F.lit("}"),
        F.lit("/// Makes it."),
        F.lit("#[macro_export]"),
        F.concat(F.lit("macro_rules! mk"), number, F.lit(" {")),
        F.lit("    ($a:expr, $b:ident) => { pub fn hidden() {} };"),
        F.lit("}"),
    )
    return docs.select(F.concat(F.lit("c"), number).alias("crate"), file.alias("file"), text.alias("text"))


MODULE = "CASE doc_id % 3 WHEN 0 THEN 'c' || CAST(doc_id AS VARCHAR) WHEN 1 THEN 'src::net' ELSE 'src::io' END"


@query(
    "src3_rust_declarations",
    f"""WITH d AS (SELECT 'c' || CAST(doc_id AS VARCHAR) AS crate, CAST(doc_id AS VARCHAR) AS n, {MODULE} AS m, text FROM documents)
    SELECT crate, m AS item_path, split_part(m, '::', -1) AS header, 'module' AS item_type, 'mod ' || split_part(m, '::', -1) AS signature,
      'Module docs' || chr(10) || ' second line' AS content, 'public' AS visibility FROM d
    UNION ALL SELECT crate, m || '::S' || n, 'S' || n, 'struct', 'pub struct S' || n || '<T> {{', text, 'public' FROM d
    UNION ALL SELECT crate, m || '::run', 'run', 'fn', 'pub async fn run( a: u8, ) -> u8 {{', '', 'public' FROM d
    UNION ALL SELECT crate, m || '::hidden', 'hidden', 'fn', '($a:expr, $b:ident) => {{ pub fn hidden() {{}} }};', '', 'public' FROM d""".replace("{{", "{").replace("}}", "}"),
)
def src3_rust_declarations(spark, sf_dir):
    files = _sources(spark, sf_dir)
    return rust_source.module_docs(files).unionByName(rust_source.declarations(files))


@query(
    "src4_macros",
    f"""SELECT 'c' || CAST(doc_id AS VARCHAR) AS crate, {MODULE} || '::mk' || CAST(doc_id AS VARCHAR) AS item_path, 'macro' AS item_type,
      'Makes it.' AS content, 'public' AS visibility,
      'macro_rules! mk' || CAST(doc_id AS VARCHAR) || ' {{ ($a:expr, $b:ident) => {{ pub fn hidden() {{}} }}; }}' AS signature FROM documents""".replace(
        "{{", "{"
    ).replace("}}", "}"),
)
def src4_macros(spark, sf_dir):
    found = rust_source.macros(_sources(spark, sf_dir))
    return found.select("crate", "item_path", "item_type", "content", "visibility", "signature")


@query(
    "src4_macro_fragments",
    """SELECT name, type, count(*) AS n FROM (SELECT unnest(['a', 'b']) AS name, unnest(['expression', 'identifier']) AS type FROM documents) GROUP BY name, type""",
)
def src4_macro_fragments(spark, sf_dir):
    arms = rust_source.macro_arms(rust_source.macros(_sources(spark, sf_dir)))
    return arms.groupBy("name", "type").agg(F.count("*").alias("n"))


def _manifests(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    manifest = F.format_string(
        '[package]\nname = "p%1$s"\n[dependencies]\nserde = "1.%2$s"\nlocal = { path = "x" }\n[dev-dependencies]\n'
        'tokio = { version = "0.%2$s", features = ["full"] }\n[target.\'cfg(unix)\'.dependencies]\nlibc = "0.2"\n',
        key.cast("string"),
        (key % 7).cast("string"),
    )
    lock = F.format_string(
        '[[package]]\nname = "serde"\nversion = "1.0.%1$s"\n[[package]]\nname = "only-name"\n', (key % 7).cast("string")
    )
    is_lock = key % 4 == 3
    return suppliers.select(
        F.concat(F.lit("/p"), key.cast("string"), F.when(is_lock, "/Cargo.lock").otherwise("/Cargo.toml")).alias("file"),
        F.when(is_lock, lock).otherwise(manifest).alias("text"),
    )


MANIFEST = """rows AS (SELECT s_suppkey AS k, v.dep AS dependency, v.before || CASE WHEN v.fill THEN CAST(s_suppkey % 7 AS VARCHAR) ELSE '' END AS requirement
  FROM supplier, (VALUES ('serde', '1.', TRUE), ('local', 'latest', FALSE), ('tokio', '0.', TRUE), ('libc', '0.2', FALSE)) v(dep, before, fill) WHERE s_suppkey % 4 <> 3
  UNION ALL SELECT s_suppkey, 'serde', '1.0.' || CAST(s_suppkey % 7 AS VARCHAR) FROM supplier WHERE s_suppkey % 4 = 3)"""


@query(
    "src7_manifests",
    f"""WITH {MANIFEST} SELECT '/p' || CAST(k AS VARCHAR) || '/Cargo.toml' AS file, dependency, requirement FROM rows WHERE k % 4 <> 3""",
)
def src7_manifests(spark, sf_dir):
    return cargo.dependencies(_manifests(spark, sf_dir).where("file like '%.toml'"))


@query(
    "src8_lock_files",
    f"""WITH {MANIFEST} SELECT '/p' || CAST(k AS VARCHAR) || '/Cargo.lock' AS file, dependency, requirement FROM rows WHERE k % 4 = 3""",
)
def src8_lock_files(spark, sf_dir):
    return cargo.dependencies(_manifests(spark, sf_dir).where("file like '%.lock'"))


@query(
    "src9_crate_specs",
    f"WITH {MANIFEST} SELECT DISTINCT dependency || '@' || requirement AS spec FROM rows",
)
def src9_crate_specs(spark, sf_dir):
    return cargo.crate_specs(cargo.dependencies(_manifests(spark, sf_dir)))


@query(
    "src6_compressed_files",
    """SELECT CAST(doc_id AS VARCHAR) || CASE doc_id % 3 WHEN 0 THEN '.zst' WHEN 1 THEN '.gz' ELSE '.raw' END AS name, text FROM documents""",
)
def src6_compressed_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), "text", "doc_id")
    packed = None
    for turn, codec in enumerate(["zst", "gz", "raw"]):
        part = archives.compress(docs.where(F.col("doc_id") % 3 == turn), codec)
        packed = part if packed is None else packed.unionByName(part)
    return archives.unpack(packed).select("name", "text")


@query(
    "src5_format_choice",
    """SELECT 'c' || CAST(doc_id AS VARCHAR) AS crate, 'x.json' || CASE WHEN doc_id % 2 = 0 THEN '.zst' WHEN doc_id % 3 = 0 THEN '.gz' ELSE '' END AS name FROM documents""",
)
def src5_format_choice(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names = F.array_compact(
        F.array(
            F.lit("x.json"),
            F.when(F.col("doc_id") % 3 == 0, "x.json.gz"),
            F.when(F.col("doc_id") % 2 == 0, "x.json.zst"),
        )
    )
    crate = F.concat(F.lit("c"), F.col("doc_id").cast("string"))
    rows = docs.select(crate.alias("crate"), F.lit("1.0.0").alias("version"), F.explode(names).alias("name"))
    return archives.pick_format(rows).select("crate", "name")


@query(
    "src13_item_scan",
    with_tables("items", "SELECT item_path, header, content, item_type, signature, parent_id, examples, visibility, deprecated FROM items"),
)
def src13_item_scan(spark, sf_dir):
    return derived(spark, sf_dir, "items").select(
        "item_path", "header", "content", "item_type", "signature", "parent_id", "examples", "visibility", "deprecated"
    )


@query(
    "src14_distinct_paths",
    with_tables("items", "SELECT DISTINCT parent_id AS item_path FROM items WHERE parent_id IS NOT NULL"),
)
def src14_distinct_paths(spark, sf_dir):
    items = derived(spark, sf_dir, "items")
    return items.select(F.col("parent_id").alias("item_path")).where("item_path IS NOT NULL").distinct()


# --- sinks


@query(
    "snk1_upsert_items",
    """WITH fresh AS (SELECT 'a::t' || CAST(doc_id % 300 AS VARCHAR) AS item_path, max(doc_id) AS id FROM documents GROUP BY 1),
    old AS (SELECT 'a::t' || CAST(vec_id AS VARCHAR) AS item_path, vec_id AS id FROM embeddings)
    SELECT f.item_path AS item_path, 't' || CAST(f.id % 300 AS VARCHAR) AS header, d.text AS content, TRUE AS is_new FROM fresh f JOIN documents d ON d.doc_id = f.id
    UNION ALL SELECT item_path, 'old', 'old', FALSE FROM old WHERE item_path NOT IN (SELECT item_path FROM fresh)""",
)
def snk1_upsert_items(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    none = F.lit(None).cast("string")
    chunks = docs.select(
        F.concat(F.lit("a::t"), (F.col("doc_id") % 300).cast("string")).alias("item_path"),
        F.col("doc_id").alias("item_id"),
        F.lit("function").alias("item_type"),
        F.when(F.col("doc_id") < 0, "x").alias("header"),
        F.col("text").alias("doc"),
        none.alias("visibility"),
        F.lit(None).cast("boolean").alias("deprecated"),
        F.col("doc_id").alias("seq"),
        F.lit(True).alias("is_new"),
    )
    old = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("a::t"), F.col("vec_id").cast("string")).alias("item_path"),
        F.lit("old").alias("header"),
        F.lit("old").alias("content"),
        F.lit(False).alias("is_new"),
    )
    merged = store.upsert_items(old, chunks)
    return merged.select("item_path", "header", "content", "is_new")


@query(
    "snk2_insert_ignore",
    """SELECT 'T' || CAST(l_suppkey AS VARCHAR) AS trait_path, l_returnflag AS impl_type_path, min(l_orderkey) AS first_seen
    FROM lineitem GROUP BY l_suppkey, l_returnflag""",
)
def snk2_insert_ignore(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.lit("parts").alias("crate"),
        F.concat(F.lit("T"), F.col("l_suppkey").cast("string")).alias("trait_path"),
        F.col("l_returnflag").alias("impl_type_path"),
        F.lit("[]").alias("generic_params"),
        F.col("l_orderkey").alias("first_seen"),
    )
    kept = store.insert_ignore(None, rows, "trait_impls", ["first_seen"])
    return kept.select("trait_path", "impl_type_path", "first_seen")


@query(
    "snk3_trait_definitions",
    """SELECT 'c' || CAST(doc_id AS VARCHAR) || '::Tr' AS trait_path, d.is_definition AS is_definition FROM documents, (VALUES (TRUE), (FALSE)) d(is_definition)""",
)
def snk3_trait_definitions(spark, sf_dir):
    return rustdoc.trait_rows(_rustdoc(spark, sf_dir)).select("trait_path", "is_definition")


@query(
    "snk4_number_modules",
    with_tables(
        "modules",
        """SELECT m.path AS path, p.path AS parent_path FROM modules m LEFT JOIN modules p ON p.id = m.parent_id AND p.crate = m.crate""",
    ),
)
def snk4_number_modules(spark, sf_dir):
    raw = derived(spark, sf_dir, "modules").select(
        "crate", "path", F.col("id").alias("raw_id"), F.col("parent_id").alias("raw_parent")
    )
    numbered = store.number_modules(raw)
    parents = numbered.select(F.col("id").alias("parent_id"), F.col("path").alias("parent_path"))
    return numbered.join(parents, "parent_id", "left").select("path", "parent_path")


@query(
    "snk5_dependency_edges",
    f"""WITH {MANIFEST} SELECT 'p' || CAST(k AS VARCHAR) || '::__dependency::' || dependency AS alias_path, dependency AS actual_path,
      dependency || '@' || requirement AS link_text, 'dependency' AS link_type FROM rows""",
)
def snk5_dependency_edges(spark, sf_dir):
    rows = cargo.dependencies(_manifests(spark, sf_dir))
    crate = F.regexp_extract("file", "/(p[0-9]+)/", 1)
    edges = store.dependency_edges(rows.select(crate.alias("crate"), "dependency", "requirement"))
    return edges.select("alias_path", "actual_path", "link_text", "link_type")


@query(
    "snk6_without_crate",
    with_tables("items", "SELECT id, item_path FROM items WHERE NOT starts_with(item_path, 'en::')"),
)
def snk6_without_crate(spark, sf_dir):
    return store.without_crate(derived(spark, sf_dir, "items"), "en").select("id", "item_path")


@query("snk7_keep_latest", "SELECT text, max(doc_id) AS doc_id FROM documents GROUP BY text")
def snk7_keep_latest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("text", "doc_id")
    return store.keep_last(docs, ["text"], ["doc_id"])


@query(
    "snk8_partitioned_store",
    with_tables("items", "SELECT crate, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars FROM items GROUP BY crate"),
)
def snk8_partitioned_store(spark, sf_dir):
    folder = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    items = derived(spark, sf_dir, "items").select("crate", "item_path", "content")
    store.write_table(items, folder, ("crate",))
    # writing one crate again replaces that partition only
    store.write_table(items.where("crate = 'fr'"), folder, ("crate",))
    kept = store.read_table(spark, folder, "item_path string, content string, crate string")
    return kept.groupBy("crate").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


@query(
    "snk9_dependency_set",
    with_tables("reexports", "SELECT DISTINCT actual_path AS path FROM reexports WHERE link_type = 'dependency'"),
)
def snk9_dependency_set(spark, sf_dir):
    folder = f"{shared_dir(spark)}/dependencies-{uuid.uuid4().hex}"
    edges = derived(spark, sf_dir, "reexports").where("link_type = 'dependency'")
    edges.select(F.col("actual_path").alias("path")).distinct().write.parquet(folder)
    return spark.read.schema("path string").parquet(folder)


@query("embed_texts")
def embed_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.lit("").alias("header"))
    vectors = embedding.embed(docs, embedding.item_text(), embedding.hashing_model(64))
    return vectors.select("doc_id", F.size("embedding").alias("dim"))


# --- streams


@query(
    "str1_stream_rates",
    """SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(count(*) / 3600.0, 8) AS rate
    FROM events GROUP BY 1, 2""",
)
def str1_stream_rates(spark, sf_dir):
    base = stateful.stream_folder(spark, "rates")
    windows = streams.window_table(spark, f"{base}/table")
    stateful.feed(streams.windowed_rates(streams.read_events(spark, sf_dir, "events.parquet"), "1 hour"), windows, f"{base}/progress", "update")
    return windows.read().select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n",
        F.round("rate", 8).alias("rate"),
    )


@query("str2_stream_counters", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def str2_stream_counters(spark, sf_dir):
    base = stateful.stream_folder(spark, "counters")
    counted = streams.read_events(spark, sf_dir, "events.parquet").select("event_type", F.lit(1).cast("bigint").alias("n"))
    table_ = stateful.counter_table(spark, f"{base}/table")
    stateful.feed(counted, table_, f"{base}/progress")
    return table_.read()


@query(
    "str2_stream_history",
    """SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 50""",
)
def str2_stream_history(spark, sf_dir):
    progress = stateful.stream_folder(spark, "history")
    stateful.run_history(streams.read_events(spark, sf_dir, "events.parquet"), 50, progress)
    return stateful.history(spark, progress, 50).select("event_type", "event_id")


@query("str2_stream_lifetime", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def str2_stream_lifetime(spark, sf_dir):
    progress = stateful.stream_folder(spark, "history")
    stateful.run_history(streams.read_events(spark, sf_dir, "events.parquet"), 50, progress)
    return stateful.lifetime_counters(spark, progress)


def _status_log(spark, sf_dir):
    """The reports of ``status_log``, as a stream."""
    events, number = streams.read_events(spark, sf_dir, "events.parquet"), F.col("event_id")
    status = F.create_map(*[F.lit(v) for v in ("view", "started", "click", "downloading", "signup", "processing", "purchase", "completed")])
    return events.select(
        number.alias("seq"), F.col("user_id").alias("crate_id"), F.concat(F.lit("crate_"), "user_id").alias("crate"), F.col("ts").alias("updated_at"),
        F.coalesce(F.try_element_at(status, F.col("event_type")), F.lit("failed")).alias("status"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("failed at "), number)).alias("error_message"),
        F.when(number % 3 != 0, number % 97).alias("items_processed"),
        F.when(number % 5 == 0, 100 + number % 50).alias("total_items"),
        F.when(number % 7 == 0, "rustdoc_json").when(number % 7 == 1, "source_extraction").alias("ingestion_tier"),
    )


@query(
    "str3_stream_stalled",
    with_tables(
        "status_log",
        """WITH last AS (SELECT crate_id, arg_max(crate, (updated_at, seq)) AS crate, arg_max(status, (updated_at, seq)) AS status, max(updated_at) AS updated_at,
          arg_max(items_processed, (updated_at, seq)) FILTER (WHERE items_processed IS NOT NULL) AS items_processed FROM status_log GROUP BY crate_id)
        SELECT crate_id, crate, status, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at, items_processed FROM last
        WHERE status IN ('started', 'downloading', 'processing') AND updated_at < (SELECT max(updated_at) FROM status_log) - INTERVAL 600 SECONDS""",
    ),
)
def str3_stream_stalled(spark, sf_dir):
    base = stateful.stream_folder(spark, "stalled")
    runs = stateful.stalled_table(spark, f"{base}/table")
    stateful.feed(stateful.quiet_runs(_status_log(spark, sf_dir)), runs, f"{base}/progress", "update")
    status = stateful.status_table(spark, f"{base}/status")
    stateful.feed(stateful.status_parts(_status_log(spark, sf_dir)), status, f"{base}/status-progress")
    return stateful.stalled_runs(runs, status).select(
        "crate_id", "crate", "status", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"), "items_processed"
    )


@query(
    "str9_stream_upsert",
    with_tables(
        "status_log",
        """SELECT crate_id, crate, arg_max(status, (updated_at, seq)) AS status, strftime(min(updated_at), '%Y-%m-%d %H:%M:%S') AS started_at,
          strftime(max(updated_at) FILTER (WHERE status = 'completed'), '%Y-%m-%d %H:%M:%S') AS completed_at,
          arg_max(items_processed, (updated_at, seq)) FILTER (WHERE items_processed IS NOT NULL) AS items_processed,
          arg_max(total_items, (updated_at, seq)) FILTER (WHERE total_items IS NOT NULL) AS total_items,
          arg_max(ingestion_tier, (updated_at, seq)) FILTER (WHERE ingestion_tier IS NOT NULL) AS ingestion_tier
        FROM status_log GROUP BY crate_id, crate""",
    ),
)
def str9_stream_upsert(spark, sf_dir):
    base = stateful.stream_folder(spark, "status")
    runs = stateful.status_table(spark, f"{base}/table")
    stateful.feed(stateful.status_parts(_status_log(spark, sf_dir)), runs, f"{base}/progress")
    return stateful.current_status(runs).select(
        "crate_id", "crate", "status", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("started_at", "completed_at")],
        "items_processed", "total_items", "ingestion_tier",
    )


@query(
    "str9_stream_status",
    """SELECT user_id AS crate_id, arg_max(event_type, (ts, event_id)) AS status, count(*) FILTER (WHERE event_type = 'purchase') > 0 AS was_completed
    FROM events GROUP BY user_id""",
)
def str9_stream_status(spark, sf_dir):
    events = streams.read_events(spark, sf_dir, "events.parquet")
    log = events.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("crate_id"),
        F.col("user_id").cast("string").alias("crate"),
        F.col("ts").alias("updated_at"),
        F.when(F.col("event_type") == "purchase", "completed").otherwise(F.col("event_type")).alias("status"),
        *[F.lit(None).cast(t).alias(n) for n, t in (
            ("error_message", "string"), ("items_processed", "bigint"), ("total_items", "bigint"), ("ingestion_tier", "string"))],
    )
    base = stateful.stream_folder(spark, "status")
    runs = stateful.status_table(spark, f"{base}/table")
    stateful.feed(stateful.status_parts(log), runs, f"{base}/progress")
    status = F.when(F.col("status") == "completed", "purchase").otherwise(F.col("status"))
    return stateful.current_status(runs).select("crate_id", status.alias("status"), F.col("completed_at").isNotNull().alias("was_completed"))



# --- from files to searches: releases of one crate per source

# %1$s is the document number, %2$s its text as JSON, %3$s the crate, %4$s the release
RELEASE_PART = """{"index": {
"%1$s:0": {"name": "S%1$s", "docs": %2$s, "visibility": "public", "inner": {"struct": {"kind": {"plain": {"fields": ["%1$s:6"]}}, "generics": {"params": [
  {"name": "'a", "kind": {"lifetime": {"outlives": ["'static"]}}},
  {"name": "T", "kind": {"type": {"bounds": [{"trait_bound": {"trait": {"name": "Clone"}, "modifier": "none"}}, {"trait_bound": {"trait": {"name": "Sized"}, "modifier": "maybe"}}]}}},
  {"name": "U", "kind": {"type": {"bounds": [], "default": {"primitive": "u8"}}}}],
  "where_predicates": [{"bound_predicate": {"type": {"generic": "T"}, "bounds": [{"trait_bound": {"trait": {"name": "Into", "args": {"angle_bracketed": {"args": [{"type": {"resolved_path": {"name": "P%1$s"}}}]}}}}}, {"outlives": "'a"},
    {"trait_bound": {"trait": {"name": "Clone"}}}]}}]}}}},
"%1$s:1": {"name": null, "docs": "", "inner": {"impl": {"trait": null, "for": {"resolved_path": {"name": "S%1$s", "id": "%1$s:0"}}, "items": ["%1$s:2"], "generics": {"params": [], "where_predicates": []}}}},
"%1$s:2": {"name": "new", "docs": "makes one", "inner": {"function": {"decl": {"inputs": [], "output": {"generic": "Self"}}, "generics": {"params": [{"name": "N", "kind": {"const": {"type": {"primitive": "usize"}, "default": "%1$s"}}}]}}}},
"%1$s:3": {"name": null, "docs": "", "inner": {"impl": {"trait": {"name": "Make", "id": "m"}, "for": {"resolved_path": {"name": "S%1$s", "id": "%1$s:0"}}, "items": ["%1$s:4"], "generics": {"params": [], "where_predicates": []}}}},
"%1$s:4": {"name": "new", "docs": "of release %4$s", "inner": {"function": {"decl": {"inputs": [["n", {"primitive": "u8"}]], "output": null}}}},
"%1$s:6": {"name": "field", "docs": "a field", "inner": {"struct_field": {"primitive": "u8"}}}},
"paths": {"%1$s:0": {"crate_id": 0, "path": ["%3$s", "S%1$s"], "kind": "struct"}}}"""
RELEASE_CRATE = "concat('lib_', lower(coalesce(source, 'none')))"


def _releases(spark, sf_dir):
    """Every document as a part of its source's crate, in two releases; the second has other texts."""
    docs = spread(table(spark, sf_dir, "documents")).withColumn("crate", F.expr(RELEASE_CRATE))
    rows = docs.select("doc_id", "crate", "text", F.explode(F.array(F.lit("1.0.0"), F.lit("2.0.0"))).alias("version"))
    body = F.when(F.col("version") == "2.0.0", F.concat(F.lit("again "), F.coalesce("text", F.lit("")))).otherwise(
        F.coalesce("text", F.lit(""))
    )
    text = F.expr("substring(to_json(named_struct('d', body)), 6, length(to_json(named_struct('d', body))) - 6)")
    number = F.col("doc_id").cast("string")
    return rows.withColumn("body", body).select(
        "crate", "version", F.format_string(RELEASE_PART, number, text, "crate", "version").alias("text")
    )


def _counts(texts: list[str]) -> np.ndarray:
    """A model of two whole numbers per text, which SQL can compute too."""
    return np.array([[len(t), t.count("e")] for t in texts], dtype=np.float32).reshape(-1, 2)


def _ingested(spark, sf_dir) -> Library:
    """Both releases of every crate, stored."""
    root = f"{shared_dir(spark)}/library-{uuid.uuid4().hex}"
    chain.ingest(_releases(spark, sf_dir), root, _counts)
    return Library.open(spark, root, _counts)


@query(
    "ing1_stored_items",
    f"""WITH d AS (SELECT doc_id, {RELEASE_CRATE} AS crate, v.version, {RELEASE_CRATE} || '::S' || CAST(doc_id AS VARCHAR) AS s,
      CASE WHEN v.version = '2.0.0' THEN 'again ' ELSE '' END || coalesce(text, '') AS text FROM documents, (VALUES ('1.0.0'), ('2.0.0')) v(version))
    SELECT crate, version, s AS item_path, crate AS parent_id, 'S' || CAST(doc_id AS VARCHAR) AS header, text AS content, CAST(NULL AS VARCHAR) AS signature FROM d
    UNION ALL SELECT crate, version, s || '::new', s, 'new', 'makes one', 'fn new<const N: usize>() -> Self' FROM d
    UNION ALL SELECT crate, version, s || '::Make::new', s || '::Make', 'new', 'of release ' || version, 'fn new(n: u8)' FROM d
    UNION ALL SELECT crate, version, s || '::field', s, 'field', 'a field', NULL FROM d""",
)
def ing1_stored_items(spark, sf_dir):
    items = _ingested(spark, sf_dir).items
    return items.select("crate", "version", "item_path", "parent_id", "header", "content", "signature")


@query(
    "ing2_nearest_after_ingest",
    f"""WITH d AS (SELECT doc_id, source, 'S' || CAST(doc_id AS VARCHAR) AS n, coalesce(text, '') AS text FROM documents WHERE {RELEASE_CRATE} = 'lib_src1'),
    t AS (SELECT n || ' again ' || text AS text FROM d UNION ALL SELECT 'new makes one' FROM d
      UNION ALL SELECT 'new of release 2.0.0' FROM d UNION ALL SELECT 'field a field' FROM d),
    v AS (SELECT length(text) AS a, length(text) - length(replace(text, 'e', '')) AS b FROM t)
    SELECT CAST(power(a - 400, 2) + power(b - 40, 2) AS BIGINT) AS squared FROM v ORDER BY squared LIMIT 10""",
)
def ing2_nearest_after_ingest(spark, sf_dir):
    library = _ingested(spark, sf_dir)
    latest = library._release(library.items, "lib_src1")
    found = search.nearest(latest, [400.0, 40.0], 10)
    return found.select(F.round(F.col("distance") * F.col("distance")).cast("long").alias("squared"))


@query(
    "typ5_constraints_of_files",
    f"""SELECT {RELEASE_CRATE} AS crate, v.version, {RELEASE_CRATE} || '::S' || CAST(doc_id AS VARCHAR) || p.tail AS item_path, p.name AS param_name, p.kind AS param_kind,
      replace(p.bounds, '%', CAST(doc_id AS VARCHAR)) AS bounds, replace(p.def, '%', CAST(doc_id AS VARCHAR)) AS default_value, p.position AS position
    FROM documents, (VALUES ('1.0.0'), ('2.0.0')) v(version),
      (VALUES ('', '''a', 'lifetime', '''static', NULL, 0), ('', 'T', 'type', 'Clone + ?Sized + Into<P%> + ''a', NULL, 1), ('', 'U', 'type', NULL, 'u8', 2),
        ('::new', 'N', 'const', 'usize', '%', 0)) p(tail, name, kind, bounds, def, position)""",
)
def typ5_constraints_of_files(spark, sf_dir):
    found = rustdoc.generic_constraints(rustdoc.parse(_releases(spark, sf_dir)))
    return found.select(
        "crate", "version", "item_path", "param_name", "param_kind", "bounds", "default_value", "position"
    )
