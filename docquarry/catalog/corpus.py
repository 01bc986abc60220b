"""Entity tables derived from the given parquet tables.

Each table is one SQL text that reads the same in Spark and in the oracle
engine, so a registered query and its oracle start from equal rows.  Sizes
follow the given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
BASE = list(SCHEMAS)

ID = "CAST(d.doc_id AS STRING)"

SQL: dict[str, str] = {}

# every document is an item, some have a vector; labels give visibility and deprecation
SQL["items"] = f"""
SELECT d.doc_id AS id, d.lang AS crate, d.source AS module,
  d.lang || '::' || d.source AS parent_id,
  d.lang || '::' || d.source || '::doc_' || {ID} AS item_path,
  substr(d.text, 1, 60) AS header, d.text AS content, e.embedding AS embedding,
  CASE coalesce(e.label, d.doc_id) % 5 WHEN 0 THEN 'function' WHEN 1 THEN 'struct' WHEN 2 THEN 'trait'
    WHEN 3 THEN 'enum' ELSE 'module' END AS item_type,
  CASE d.doc_id % 6
    WHEN 0 THEN 'pub fn doc_' || {ID} || '(a: u32, b: Vec<String>) -> Result<Vec<u8>, E' || d.source || '>'
    WHEN 1 THEN 'fn m' || CAST(d.doc_id % 7 AS STRING) || '(&self) -> Option<String>'
    WHEN 2 THEN 'pub unsafe fn doc_' || {ID} || '<T: Clone>(x: &T, n: usize) -> Result<T, ParseError>'
    WHEN 3 THEN 'pub struct Doc' || {ID} || '<T>'
    WHEN 5 THEN 'pub async fn run_' || CAST(d.doc_id % 7 AS STRING)
      || '<T>(x: T, y: u8, z: u8) -> Box<T> where T: Send, T: Sync' END AS signature,
  CASE WHEN d.doc_id % 6 = 0 THEN '[{{"code": "use std::io; impl Reader for File; obj'
      || CAST(d.doc_id % 5 AS STRING) || '.open(1);", "language": "rust", "detected": false}}, '
      || '{{"code": "[deps] k' || CAST(d.doc_id % 9 AS STRING) || ' = 1", "language": "toml", "detected": true}}]'
    WHEN d.doc_id % 6 = 3 THEN '[{{"code": "let v = obj' || CAST(d.doc_id % 5 AS STRING) || '.m'
      || CAST(d.doc_id % 7 AS STRING) || '(); v.send(1);", "language": "rust", "detected": false}}]'
    WHEN d.doc_id % 6 = 4 THEN '["plain.call' || CAST(d.doc_id % 4 AS STRING) || '(x)"]' END AS examples,
  CASE WHEN l.quality = 1 THEN 'public' WHEN l.quality = 0 THEN 'private' END AS visibility,
  CASE WHEN l.toxic = 1 THEN TRUE WHEN l.toxic = 0 THEN FALSE END AS deprecated,
  CASE WHEN l.toxic = 1 THEN 'unstable' ELSE 'stable' END AS stability_level,
  CASE WHEN d.doc_id % 6 = 2 THEN FALSE ELSE TRUE END AS is_safe
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id
"""

# every document as a plain item, without vector
SQL["pages_of_text"] = f"""
SELECT d.doc_id AS id, d.lang AS crate,
  d.lang || '::' || d.source || '::doc_' || {ID} AS item_path, d.text AS content
FROM documents d
"""

# documentation text with fenced blocks, attributes and a safety section
SQL["raw_docs"] = f"""
SELECT d.doc_id AS id, d.lang AS crate, d.lang || '::' || d.source || '::doc_' || {ID} AS item_path,
  d.text AS content,
  CASE WHEN d.doc_id % 4 = 0 THEN d.text
    WHEN d.doc_id % 4 = 1 THEN d.text || chr(10) || '```rust' || chr(10) || '// note' || chr(10)
      || 'let a  =  ' || CAST(d.doc_id % 17 AS STRING) || ';' || chr(10) || chr(10) || 'run(a);' || chr(10) || '```' || chr(10)
    WHEN d.doc_id % 4 = 2 THEN '```' || chr(10) || 'call(' || CAST(d.doc_id % 13 AS STRING) || ')' || chr(10)
      || '```' || chr(10) || d.text || chr(10) || '```TOML' || chr(10) || 'k = ' || CAST(d.doc_id % 5 AS STRING)
      || chr(10) || '```'
    ELSE d.text || chr(10) || '```rust' || chr(10) || '   ' || chr(10) || '```' || chr(10) || chr(10)
      || '# Safety' || chr(10) || chr(10) || 'Keep ' || CAST(d.doc_id % 11 AS STRING) || ' alive.' || chr(10)
      || '# Panics' || chr(10) || 'Never.' END AS doc,
  CASE d.doc_id % 5 WHEN 0 THEN '#[cfg(feature = "f' || CAST(d.doc_id % 3 AS STRING) || '")]'
    WHEN 1 THEN '#[cfg(all(feature = "a' || CAST(d.doc_id % 3 AS STRING) || '", feature = "b"))]'
    WHEN 2 THEN '#[deprecated(since = "1.0")]' WHEN 3 THEN '#[warn(unsafe_code)]' END AS attr,
  d.source AS source
FROM documents d
"""

# edges: a third each of re-exports, cross references and dependencies
SQL["edge_numbers"] = """
SELECT e.vec_id AS src,
  CASE WHEN e.vec_id % 10 = 0 THEN (e.vec_id * 7 + 3) % (SELECT count(*) FROM embeddings)
    ELSE CAST(floor(e.vec_id / 3) AS BIGINT) END AS dst,
  'reexport' AS link_type, CAST(0.9 AS DOUBLE) AS confidence_score
FROM embeddings e
UNION ALL
SELECT e.vec_id, (e.vec_id + 11) % (SELECT count(*) FROM embeddings), 'crossref', CAST(0.7 AS DOUBLE)
FROM embeddings e WHERE e.vec_id % 3 = 1
UNION ALL
SELECT e.vec_id, (e.vec_id * 5 + 1) % (SELECT count(*) FROM embeddings), 'dependency', CAST(1.0 AS DOUBLE)
FROM embeddings e WHERE e.vec_id % 4 = 0
"""
SQL["doc_paths"] = f"""
SELECT d.doc_id AS id, d.lang AS crate, d.lang || '::' || d.source || '::doc_' || {ID} AS item_path
FROM documents d
"""
SQL["reexports"] = """
SELECT s.crate AS crate, s.item_path AS alias_path, t.item_path AS actual_path,
  e.src % 8 = 0 AS is_glob, 'see ' || CAST(e.dst AS STRING) AS link_text, e.link_type AS link_type,
  e.confidence_score AS confidence_score
FROM edge_numbers e JOIN doc_paths s ON s.id = e.src JOIN doc_paths t ON t.id = e.dst
"""

# region -> nation -> supplier and customer as a module tree with real counts
SQL["modules"] = """
SELECT CAST(r.r_regionkey AS BIGINT) AS id, r.r_name AS name, r.r_name AS path,
  CAST(NULL AS BIGINT) AS parent_id, 0 AS depth, coalesce(c.n, 0) AS item_count, r.r_name AS crate
FROM region r LEFT JOIN (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey) c
  ON c.n_regionkey = r.r_regionkey
UNION ALL
SELECT CAST(100 + n.n_nationkey AS BIGINT), n.n_name, r.r_name || '::' || n.n_name,
  CAST(n.n_regionkey AS BIGINT), 1, coalesce(c.n, 0), r.r_name
FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey
  LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) c ON c.c_nationkey = n.n_nationkey
UNION ALL
SELECT 1000000000 + s.s_suppkey, CASE WHEN s.s_suppkey % 7 = 0 THEN '_' ELSE '' END || s.s_name,
  r.r_name || '::' || n.n_name || '::' || CASE WHEN s.s_suppkey % 5 = 0 THEN 'tests::' ELSE '' END || s.s_name,
  CAST(100 + n.n_nationkey AS BIGINT), 2, coalesce(c.n, 0), r.r_name
FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey
  LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey) c ON c.l_suppkey = s.s_suppkey
UNION ALL
SELECT 2000000000 + k.c_custkey, k.c_name, r.r_name || '::' || n.n_name || '::' || k.c_name,
  CAST(100 + n.n_nationkey AS BIGINT), 2, coalesce(c.n, 0), r.r_name
FROM customer k JOIN nation n ON n.n_nationkey = k.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey
  LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) c ON c.o_custkey = k.c_custkey
"""

# two snapshots of one crate: some items dropped, some new, some changed
_VERSION = """
SELECT p.lang || '::' || p.source || '::doc_' || CAST(p.doc_id AS STRING) AS item_path,
  substr(p.text, 1, 40) AS header, p.text AS content,
  CASE p.doc_id % 5 WHEN 0 THEN 'function' WHEN 1 THEN 'struct' WHEN 2 THEN 'trait' WHEN 3 THEN 'enum'
    ELSE 'mystery' END AS item_type,
  {signature} AS signature, {visibility} AS visibility, {deprecated} AS deprecated,
  {generics} AS generic_params, {bounds} AS trait_bounds
FROM documents p WHERE {rows}
"""
SQL["version_a"] = _VERSION.format(
    rows="p.doc_id % 10 <> 0",
    signature="'fn doc_' || CAST(p.doc_id AS STRING) || '(a: u32)'",
    visibility="CASE WHEN p.doc_id % 17 = 0 THEN 'private' WHEN p.doc_id % 17 <> 1 THEN 'public' END",
    deprecated="p.doc_id % 26 = 0",
    generics="CASE WHEN p.doc_id % 19 = 0 THEN '[\"T\"]' END",
    bounds="CASE WHEN p.doc_id % 23 = 0 THEN '[\"Clone\"]' END",
)
SQL["version_b"] = _VERSION.format(
    rows="p.doc_id % 10 <> 1",
    signature="CASE WHEN p.doc_id % 7 = 0 THEN 'fn doc_' || CAST(p.doc_id AS STRING) || '(a: u32, b: u8) -> u8' "
    "WHEN p.doc_id % 31 = 0 THEN NULL ELSE 'fn doc_' || CAST(p.doc_id AS STRING) || '(a: u32)' END",
    visibility="CASE WHEN p.doc_id % 11 = 0 OR p.doc_id % 17 = 0 THEN 'private' WHEN p.doc_id % 17 <> 1 THEN 'public' END",
    deprecated="p.doc_id % 13 = 0",
    generics="CASE WHEN p.doc_id % 38 = 0 THEN '[\"U\"]' WHEN p.doc_id % 19 = 0 THEN '[\"T\"]' END",
    bounds="CASE WHEN p.doc_id % 46 = 0 THEN '[\"Copy\"]' WHEN p.doc_id % 23 = 0 THEN '[\"Clone\"]' END",
)

# published versions of crates, with pre-releases, yanked and malformed ones
SQL["published"] = """
SELECT p.p_brand AS crate,
  CASE WHEN p.p_partkey % 23 = 0 THEN 'v' ELSE '' END || CAST(p.p_size % 5 AS STRING) || '.'
    || CAST(p.p_partkey % 12 AS STRING) || '.' || CAST(p.p_partkey % 7 AS STRING)
    || CASE WHEN p.p_partkey % 9 = 0 THEN '-rc.' || CAST(p.p_partkey % 14 AS STRING) ELSE '' END AS version,
  p.p_partkey % 11 = 0 AS yanked,
  '2020-' || lpad(CAST(1 + p.p_partkey % 12 AS STRING), 2, '0') || '-'
    || lpad(CAST(1 + p.p_partkey % 28 AS STRING), 2, '0') || ' 00:00:00' AS created_at,
  p.p_partkey AS seq
FROM part p
"""
SQL["requirements"] = """
SELECT s.s_suppkey AS id, 'Brand#' || CAST(1 + s.s_suppkey % 25 AS STRING) AS crate,
  CASE s.s_suppkey % 8 WHEN 0 THEN '^1.2.3' WHEN 1 THEN '~2.3.1' WHEN 2 THEN '1.*' WHEN 3 THEN '3.4.5'
    WHEN 4 THEN '>=1.0, <2.0' WHEN 5 THEN '2' WHEN 6 THEN '~ 4.1.0' ELSE 'abc' END AS spec
FROM supplier s
"""

# implementations, methods and other type-system rows
SQL["trait_impls"] = """
SELECT 'parts' AS crate,
  CASE WHEN p.p_partkey % 3 = 0 THEN p.p_type ELSE 'core::' || lower(p.p_type) || '::' || p.p_type END AS trait_path,
  'parts::' || replace(p.p_name, ' ', '_') || '::P' || CAST(p.p_partkey AS STRING) AS impl_type_path,
  CASE WHEN p.p_partkey % 4 = 0 THEN '[{"name": "T"}]' END AS generic_params,
  CASE WHEN p.p_partkey % 8 = 0 THEN '["T: Clone"]' END AS where_clauses,
  p.p_partkey % 10 = 0 AS is_blanket, p.p_partkey % 15 = 0 AS is_negative,
  'impl ' || p.p_type || ' for P' || CAST(p.p_partkey AS STRING) AS impl_signature,
  CASE WHEN p.p_partkey % 6 = 0 THEN 'unstable' ELSE 'stable' END AS stability_level, p.p_partkey AS item_id
FROM part p
"""
SQL["methods"] = """
SELECT 'parts' AS crate, 'parts::T' || CAST(l.l_partkey % 50 AS STRING) AS parent_type_path,
  'm' || CAST(l.l_linenumber AS STRING) AS method_name,
  'fn m' || CAST(l.l_linenumber AS STRING) || '(self: ' || l.l_returnflag || ') -> ' || l.l_linestatus AS full_signature,
  l.l_linestatus AS return_type, l.l_returnflag = 'A' AS is_const,
  CASE l.l_linestatus WHEN 'O' THEN 'inherent' ELSE 'trait' END AS method_kind,
  CASE l.l_linestatus WHEN 'F' THEN 'core::T' || l.l_returnflag END AS trait_source,
  CASE l.l_returnflag WHEN 'A' THEN '&self' WHEN 'N' THEN '&mut self' END AS receiver_type,
  count(*) AS uses
FROM lineitem l
GROUP BY l.l_partkey % 50, l.l_linenumber, l.l_returnflag, l.l_linestatus
"""
SQL["associated_items"] = """
SELECT 'parts' AS crate, 'parts::C' || CAST(CAST(floor(p.p_partkey / 40) AS BIGINT) AS STRING) AS container_path,
  replace(p.p_name, ' ', '_') || '_' || CAST(p.p_partkey AS STRING) AS item_name,
  CASE p.p_partkey % 3 WHEN 0 THEN 'type' WHEN 1 THEN 'const' ELSE 'function' END AS item_kind,
  'sig ' || p.p_brand AS item_signature, p.p_retailprice AS weight
FROM part p
"""
SQL["generic_constraints"] = """
SELECT 'parts' AS crate, 'parts::G' || CAST(p.p_size AS STRING) AS item_path,
  'P' || CAST(p.p_partkey AS STRING) AS param_name,
  CASE p.p_partkey % 3 WHEN 0 THEN 'type' WHEN 1 THEN 'lifetime' ELSE 'const' END AS param_kind,
  p.p_brand AS bounds, CAST(p.p_partkey % 6 AS INT) AS position
FROM part p
"""

# status reports of ingestion runs, one run per user
SQL["status_log"] = """
SELECT e.event_id AS seq, e.user_id AS crate_id, 'crate_' || CAST(e.user_id AS STRING) AS crate, e.ts AS updated_at,
  CASE e.event_type WHEN 'view' THEN 'started' WHEN 'click' THEN 'downloading' WHEN 'signup' THEN 'processing'
    WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status,
  CASE WHEN e.event_type = 'error' THEN 'failed at ' || CAST(e.event_id AS STRING) END AS error_message,
  CASE WHEN e.event_id % 3 <> 0 THEN CAST(e.event_id % 97 AS BIGINT) END AS items_processed,
  CASE WHEN e.event_id % 5 = 0 THEN CAST(100 + e.event_id % 50 AS BIGINT) END AS total_items,
  CASE WHEN e.event_id % 7 = 0 THEN 'rustdoc_json' WHEN e.event_id % 7 = 1 THEN 'source_extraction' END AS ingestion_tier
FROM events e
"""

# crates with download counts
SQL["popularity"] = """
SELECT c.c_name AS crate, c.c_mktsegment AS category, coalesce(o.downloads, 0) AS downloads,
  coalesce(o.last_order, 0) AS mtime, CAST(c.c_custkey % 1000 + 1 AS BIGINT) * 1000 AS size_bytes
FROM customer c LEFT JOIN (
  SELECT o_custkey, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS downloads,
    max(o_orderkey) AS last_order FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey
"""

# single code examples of items, each with its item's vector
SQL["example_items"] = """
SELECT i.id AS id, i.crate AS crate, i.item_path AS item_path,
  CASE WHEN i.id % 4 = 0 THEN 'let a = ' || CAST(i.id % 10 AS STRING) || ';' ELSE 'call(' || CAST(i.id % 20 AS STRING) || ')' END
    AS example_text,
  CASE WHEN i.id % 3 = 0 THEN 'toml' ELSE 'rust' END AS language, i.header AS context, i.embedding AS embedding
FROM items i
"""

DEPENDS = {
    "reexports": ["edge_numbers", "doc_paths"],
    "example_items": ["items"],
}


def _needed(names: list[str]) -> list[str]:
    out: list[str] = []
    for name in names:
        for part in [*_needed(DEPENDS.get(name, [])), name]:
            if part not in out:
                out.append(part)
    return out


def with_tables(names: list[str] | str, body: str, recursive: bool = False) -> str:
    """An oracle query that starts with the derived tables it names."""
    names = names.split() if isinstance(names, str) else names
    parts = [f"{n} AS ({SQL[n]})" for n in _needed(names)]
    keyword = "WITH RECURSIVE" if recursive else "WITH"
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"{keyword} {', '.join(parts)}, {body[5:]}"
    return f"{keyword} {', '.join(parts)} {body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived tables, as a plan over the given ones."""
    text = SQL[name].replace("{", "{{").replace("}", "}}")
    used = {}
    for source in [*BASE, *DEPENDS.get(name, [])]:
        marked = text
        for keyword in ("FROM ", "JOIN "):
            marked = _mark(marked, keyword, source)
        if marked != text:
            text = marked
            used[source] = (
                table(spark, sf_dir, source) if source in BASE else derived(spark, sf_dir, source)
            )
    return spark.sql(text, **used)


def _mark(text: str, keyword: str, source: str) -> str:
    out, rest = "", text
    while (at := rest.find(keyword + source)) >= 0:
        end = at + len(keyword) + len(source)
        follows = rest[end : end + 1]
        if follows.isalnum() or follows == "_":
            out, rest = out + rest[:end], rest[end:]
            continue
        out, rest = out + rest[:at] + keyword + "{" + source + "}", rest[end:]
    return out + rest


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """The vector of one row, fetched by key: the search parameter."""
    rows = table(spark, sf_dir, "embeddings").where(f"vec_id = {vec_id}").select("embedding")
    return [float(x) for x in rows.head()["embedding"]]
