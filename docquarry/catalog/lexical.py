"""Registered path lookups, text functions and row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.catalog.corpus import derived, table, with_tables
from docquarry.catalog.registry import query
from docquarry.functions import code, fuzzy, intelligence, paths, signatures, text
from docquarry.operators import filters, lookup
from docquarry.plans.spread import spread


# --- fuzzy paths: token ratios have no SQL form, tests compare them with brute force


@query("fuz1_path_score")
def fuz1_path_score(spark, sf_dir):
    docs = derived(spark, sf_dir, "pages_of_text")
    score = fuzzy.path_score_column("en::src3::doc_43", F.col("item_path"))
    return docs.select("item_path", F.round(score, 6).alias("score"))


@query(
    "fuz2_tail_bonus",
    with_tables(
        "pages_of_text",
        """SELECT item_path, CAST(CASE WHEN t = 'doc_43' THEN 0.15 WHEN t LIKE '%doc_43%' THEN 0.08
          WHEN 'doc_43' LIKE '%' || t || '%' THEN 0.048 ELSE 0 END AS DOUBLE) AS bonus
        FROM (SELECT item_path, lower(split_part(item_path, '::', 3)) AS t FROM pages_of_text)""",
    ),
)
def fuz2_tail_bonus(spark, sf_dir):
    docs = derived(spark, sf_dir, "pages_of_text")
    bonus = fuzzy.tail_bonus("en::src3::doc_43", F.col("item_path"))
    return docs.select("item_path", F.round(bonus, 6).alias("bonus"))


@query(
    "fuz3_adaptive_threshold",
    """SELECT p_type || ' ' || p_name AS query, count(*) AS n, CAST(CASE WHEN length(p_type || ' ' || p_name) <= 5 THEN 0.55
      WHEN length(p_type || ' ' || p_name) <= 10 THEN 0.6 WHEN length(p_type || ' ' || p_name) <= 20 THEN 0.63
      ELSE 0.65 END AS DOUBLE) AS threshold FROM part GROUP BY p_type || ' ' || p_name""",
)
def fuz3_adaptive_threshold(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_type", "p_name").alias("query"))
    counted = parts.groupBy("query").agg(F.count("*").alias("n"))
    return counted.withColumn("threshold", fuzzy.adaptive_threshold_column(F.col("query")))


@query("fuz4_suggestions")
def fuz4_suggestions(spark, sf_dir):
    docs = derived(spark, sf_dir, "pages_of_text")
    out = lookup.fuzzy_suggestions(docs, "en::scr3::doc_34", 5)
    return out.withColumn("score", F.round("score", 6))


REQUESTS = """requests AS (SELECT r.id AS id, r.crate AS crate,
  CASE r.id % 4 WHEN 0 THEN r.item_path WHEN 1 THEN substr(r.item_path, length(r.crate) + 3)
    WHEN 2 THEN 'crate' ELSE 'HashMap' END AS path,
  CASE r.id % 4 WHEN 3 THEN 'std' ELSE r.crate END AS asked FROM doc_paths r)"""
LATEST = """known AS (SELECT crate, alias, max(actual_path) AS actual_path FROM (
  SELECT crate, alias_path AS alias, actual_path FROM reexports
  UNION ALL SELECT crate, substr(alias_path, length(crate) + 3), actual_path FROM reexports) GROUP BY crate, alias)"""


@query(
    "ali1_resolve_aliases",
    with_tables(
        "doc_paths reexports",
        f"""WITH {REQUESTS}, {LATEST}
        SELECT r.id AS id, r.asked AS crate, r.path AS path, CASE WHEN r.path = 'crate' THEN 'crate' ELSE
          coalesce(f.actual_path, b.actual_path, CASE WHEN r.asked = 'std' AND r.path = 'HashMap'
            THEN 'std::collections::HashMap' END, r.path) END AS resolved_path
        FROM requests r LEFT JOIN known f ON f.crate = r.asked AND f.alias = r.asked || '::' || r.path
          LEFT JOIN known b ON b.crate = r.asked AND b.alias = r.path""",
    ),
)
def ali1_resolve_aliases(spark, sf_dir):
    docs = derived(spark, sf_dir, "doc_paths")
    turn = F.col("id") % 4
    requests = docs.select(
        "id",
        F.when(turn == 3, "std").otherwise(F.col("crate")).alias("crate"),
        F.when(turn == 0, F.col("item_path"))
        .when(turn == 1, F.expr("substring(item_path, length(crate) + 3)"))
        .when(turn == 2, "crate")
        .otherwise("HashMap")
        .alias("path"),
    )
    return lookup.resolve_aliases(requests, derived(spark, sf_dir, "reexports"))


@query(
    "join2_reexport_map",
    with_tables(
        "reexports",
        """SELECT crate, alias, max(actual_path) AS actual_path FROM (
          SELECT crate, alias_path AS alias, actual_path FROM reexports WHERE link_type = 'reexport'
          UNION ALL SELECT crate, substr(alias_path, length(crate) + 3), actual_path FROM reexports
          WHERE link_type = 'reexport') GROUP BY crate, alias""",
    ),
)
def join2_reexport_map(spark, sf_dir):
    return lookup.reexport_map(derived(spark, sf_dir, "reexports"))


@query(
    "grf8_reexport_map_all_links",
    with_tables("reexports", f"WITH {LATEST} SELECT crate, alias, actual_path FROM known"),
)
def grf8_reexport_map_all_links(spark, sf_dir):
    return lookup.reexport_map(derived(spark, sf_dir, "reexports"), include_crossrefs=True)


@query(
    "join3_import_alternatives",
    with_tables(
        "items reexports",
        """SELECT DISTINCT i.item_path AS item_path, r.alias_path AS alias_path,
          CAST(CASE WHEN i.item_path = 'en::doc_4' THEN 1.0 WHEN i.item_path ILIKE 'en::doc_4' THEN 0.8
            WHEN i.item_path ILIKE '%::doc_4' THEN 0.6 ELSE 0.4 END AS DOUBLE) AS confidence,
          CASE WHEN r.alias_path IS NULL THEN 'direct' ELSE 'reexport' END AS link_type
        FROM items i LEFT JOIN reexports r ON r.actual_path = i.item_path
        WHERE i.item_path ILIKE '%doc_4%' OR r.alias_path ILIKE '%doc_4%'
        ORDER BY confidence DESC, item_path, alias_path NULLS FIRST LIMIT 40""",
    ),
)
def join3_import_alternatives(spark, sf_dir):
    return lookup.import_alternatives(
        derived(spark, sf_dir, "items"), derived(spark, sf_dir, "reexports"), "en", "en::doc_4", 40
    )


@query(
    "resolve_import",
    with_tables(
        "items reexports",
        """WITH main AS (SELECT coalesce(max(actual_path), 'src3::doc_63') AS item_path,
            CAST(CASE WHEN max(actual_path) IS NULL THEN 0.5 ELSE 0.9 END AS DOUBLE) AS confidence
          FROM reexports WHERE crate = 'en' AND alias_path = 'en::src3::doc_63'),
        others AS (SELECT DISTINCT i.item_path AS item_path, r.alias_path AS alias_path,
            CAST(CASE WHEN i.item_path ILIKE 'en::doc_63' THEN 0.8
              WHEN i.item_path ILIKE '%::doc_63' THEN 0.6 ELSE 0.4 END AS DOUBLE) AS confidence,
            CASE WHEN r.alias_path IS NULL THEN 'direct' ELSE 'reexport' END AS link_type
          FROM items i LEFT JOIN (SELECT * FROM reexports WHERE crate = 'en') r ON r.actual_path = i.item_path
          WHERE i.item_path ILIKE '%doc_63%' OR r.alias_path ILIKE '%doc_63%'
          ORDER BY confidence DESC, item_path, alias_path NULLS FIRST LIMIT 5)
        SELECT item_path, NULL AS alias_path, confidence, 'resolved' AS link_type FROM main
        UNION ALL SELECT item_path, alias_path, confidence, link_type FROM others
        WHERE item_path NOT IN (SELECT item_path FROM main)""",
    ),
)
def resolve_import(spark, sf_dir):
    return lookup.resolve_import(
        derived(spark, sf_dir, "items"), derived(spark, sf_dir, "reexports"), "en", "src3::doc_63", True
    )


@query(
    "join9_siblings",
    with_tables(
        "items",
        """SELECT item_path, signature, item_type FROM items WHERE item_path <> 'en::src3::doc_63'
        AND parent_id = (SELECT parent_id FROM items WHERE item_path = 'en::src3::doc_63')
        ORDER BY item_path LIMIT 10""",
    ),
)
def join9_siblings(spark, sf_dir):
    return lookup.siblings(derived(spark, sf_dir, "items"), "en::src3::doc_63")


@query(
    "grf7_cross_references",
    with_tables(
        "reexports doc_paths",
        """WITH here AS (SELECT item_path FROM doc_paths WHERE id = 22)
        SELECT 'from' AS direction, actual_path AS other, link_text, confidence_score FROM reexports
        WHERE link_type = 'crossref' AND alias_path = (SELECT item_path FROM here)
        UNION ALL SELECT 'to', alias_path, link_text, confidence_score FROM reexports
        WHERE link_type = 'crossref' AND actual_path = (SELECT item_path FROM here)""",
    ),
)
def grf7_cross_references(spark, sf_dir):
    path = derived(spark, sf_dir, "doc_paths").where("id = 22").head()["item_path"]
    return lookup.cross_references(derived(spark, sf_dir, "reexports"), path)


def _with_intelligence(items):
    """Items with the facts ingestion stores next to the text."""
    none = F.array().cast("array<string>")
    return items.withColumns(
        {
            "safety_info": intelligence.safety_info(none, F.col("signature"), F.col("content")),
            "error_types": intelligence.error_types(F.col("signature")),
            "feature_requirements": none,
        }
    )


@query(
    "typ6_item_intelligence",
    with_tables(
        "items",
        """SELECT item_path, 'nowhere::doc_32' AS requested_path, signature AS enhanced_signature, is_safe,
          visibility, coalesce(deprecated, FALSE) AS deprecated, substr(content, 1, 500) AS documentation,
          'ParseError' AS errors FROM items
        WHERE item_path ILIKE '%::doc_32' ORDER BY item_path LIMIT 1""",
    ),
)
def typ6_item_intelligence(spark, sf_dir):
    items = _with_intelligence(derived(spark, sf_dir, "items"))
    found = lookup.item_intelligence(items, "en", "nowhere::doc_32")
    return found.select(
        "item_path", "requested_path", "enhanced_signature", "is_safe", "visibility", "deprecated",
        "documentation", F.array_join("error_types", ",").alias("errors"),
    )


@query(
    "get_item_doc",
    with_tables(
        "items",
        """SELECT item_path, content AS documentation, FALSE AS is_stdlib FROM items
        WHERE item_path ILIKE '%::doc_41' ORDER BY item_path LIMIT 1""",
    ),
)
def get_item_doc(spark, sf_dir):
    return lookup.item_documentation(derived(spark, sf_dir, "items"), None, "en", "doc_41")


# --- text functions


@query(
    "strf1_lookup_form",
    r"""SELECT doc_id, lower(trim(regexp_replace(nfc_normalize(text), '[^\p{L}\p{N}_]', ' ', 'g'))) AS form FROM documents""",
)
def strf1_lookup_form(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", text.lookup_form(F.col("text")).alias("form"))


@query(
    "strf2_query_form",
    r"""SELECT conv_id, turn, trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g')) AS form FROM conversations""",
)
def strf2_query_form(spark, sf_dir):
    talks = table(spark, sf_dir, "conversations")
    return talks.select("conv_id", "turn", text.query_form(F.col("text")).alias("form"))


WORDS = ["Serialise", "ASYNC", "colour", "impl fn", "BEHAVIOUR", "vec vec str", "box Normalise", "plain"]
PREPARED = {
    "Serialise": "Serialize",
    "ASYNC": "async asynchronous",
    "colour": "color",
    "impl fn": "impl implementation fn function",
    "BEHAVIOUR": "BEHAVIOR",
    "vec vec str": "vec vector str string",
    "box Normalise": "box heap allocated Normalize",
    "plain": "plain",
}


def _case(values, column="word") -> str:
    return " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items())


@query(
    "qpp1_prepare_query",
    f"""WITH asked AS (SELECT page_id, CASE page_id % {len(WORDS)}
        {' '.join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(WORDS))} END AS word,
        flatten(list_transform(string_split_regex(trim(regexp_replace(url, '[^a-z0-9]+', ' ', 'g')), ' '),
          lambda w: CASE WHEN w = 'ref' THEN ['ref', 'reference'] ELSE [w] END)) AS rest FROM pages)
    SELECT page_id, CASE word {_case(PREPARED)} END || ' ' || array_to_string(list_transform(list_filter(
        list_transform(range(1, len(rest) + 1), lambda i: struct_pack(w := rest[i], first := list_position(rest, rest[i]) = i)),
        lambda s: s.first), lambda s: s.w), ' ') AS prepared FROM asked""",
)
def qpp1_prepare_query(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    word = F.get(F.array(*[F.lit(w) for w in WORDS]), (F.col("page_id") % len(WORDS)).cast("int"))
    rest = F.regexp_replace("url", "[^a-z0-9]+", "\t ")
    asked = pages.select("page_id", F.concat(F.lit("  "), word, F.lit("\n"), rest).alias("asked"))
    return asked.select("page_id", text.prepare_query(F.col("asked")).alias("prepared"))


@query(
    "strf3_spelling_and_terms",
    f"""SELECT page_id % {len(WORDS)} AS k, CASE CASE page_id % {len(WORDS)}
        {' '.join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(WORDS))} END {_case(PREPARED)} END AS prepared,
        count(*) AS n FROM pages GROUP BY 1, 2""",
)
def strf3_spelling_and_terms(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    k = F.col("page_id") % len(WORDS)
    word = F.get(F.array(*[F.lit(w) for w in WORDS]), k.cast("int"))
    prepared = text.expand_terms(text.american_spelling(word))
    return pages.groupBy(k.alias("k"), prepared.alias("prepared")).agg(F.count("*").alias("n"))


FENCED = r"""blocks AS (SELECT id, item_path, content, tag, regexp_replace(code, '^\s+|\s+$', '', 'g') AS code, n FROM (
  SELECT id, item_path, content, unnest(regexp_extract_all(doc, '(?s)```(\w*)\s*\n(.*?)```', 1)) AS tag,
    unnest(regexp_extract_all(doc, '(?s)```(\w*)\s*\n(.*?)```', 2)) AS code,
    unnest(range(len(regexp_extract_all(doc, '(?s)```(\w*)\s*\n(.*?)```', 1)))) AS n FROM raw_docs))"""


@query(
    "strf4_code_examples",
    with_tables(
        "raw_docs",
        f"""WITH {FENCED} SELECT id, code, CASE WHEN tag = '' THEN 'rust' ELSE lower(tag) END AS language,
        tag = '' AS detected FROM blocks WHERE code <> ''""",
    ),
)
def strf4_code_examples(spark, sf_dir):
    docs = spread(derived(spark, sf_dir, "raw_docs"))
    return docs.select("id", F.inline(code.code_examples(F.col("doc"))))


NORMALIZED = r"""array_to_string(list_filter(list_transform(string_split({c}, chr(10)),
  lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '' AND NOT regexp_matches(x, '^(#|//|/\*|\*|--)')), chr(10))"""


@query(
    "strf5_normalize_code",
    f"SELECT doc_id, {NORMALIZED.format(c='text')} AS code FROM documents",
)
def strf5_normalize_code(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", code.normalize_code(F.col("text")).alias("code"))


@query(
    "strf6_example_hash",
    f"SELECT doc_id, substr(sha256('rust:' || {NORMALIZED.format(c='text')}), 1, 16) AS example_hash FROM documents",
)
def strf6_example_hash(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", code.example_hash(F.col("text"), F.lit("rust")).alias("example_hash"))


@query(
    "strf7_embedding_text",
    with_tables(
        "raw_docs",
        f"""WITH {FENCED} SELECT id, n, CASE WHEN tag = '' THEN '' ELSE 'Language: ' || lower(tag) || chr(10) || chr(10) END
          || 'Context: ' || substr(content, 1, 200) || chr(10) || chr(10) || code AS embedded
        FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS n FROM (SELECT * EXCLUDE (n), n FROM blocks WHERE code <> ''))""".replace(
            "SELECT *, row_number()", "SELECT * EXCLUDE (n), row_number()"
        ),
    ),
)
def strf7_embedding_text(spark, sf_dir):
    docs = spread(derived(spark, sf_dir, "raw_docs"))
    single = docs.select("id", "content", F.posexplode(code.fenced_blocks(F.col("doc"))).alias("n", "b"))
    embedded = code.embedding_text(F.col("b.code"), F.col("b.tag"), F.col("content"))
    return single.select("id", F.col("n").cast("bigint").alias("n"), embedded.alias("embedded"))


@query(
    "agg16_example_dedupe",
    with_tables(
        "raw_docs",
        f"""WITH {FENCED}, keyed AS (SELECT crate, id, n, code, CASE WHEN tag = '' THEN 'rust' ELSE lower(tag) END AS language
          FROM (SELECT b.*, r.crate AS crate FROM blocks b JOIN raw_docs r USING (id) WHERE code <> '')),
        hashed AS (SELECT *, substr(sha256(language || ':' || {NORMALIZED.format(c='code')}), 1, 16) AS example_hash FROM keyed)
        SELECT crate, example_hash, arg_max(code, id) AS code, max(id) AS id, count(*) AS copies FROM hashed GROUP BY crate, example_hash""",
    ),
)
def agg16_example_dedupe(spark, sf_dir):
    from docquarry.sources.store import extract_examples, keep_last

    docs = spread(derived(spark, sf_dir, "raw_docs"))
    docs = docs.select("crate", "id", "item_path", "content", code.examples_json(F.col("doc")).alias("examples"))
    single = extract_examples(docs)
    return keep_last(single, ["crate", "example_hash"], ["id"], copies="copies").select(
        "crate", "example_hash", F.col("example_text").alias("code"), "id", "copies"
    )


@query(
    "json1_parse_examples",
    with_tables(
        "items",
        """SELECT id, CASE WHEN json_type(e) = 'VARCHAR' THEN e ->> '$' ELSE e ->> '$.code' END AS code,
          coalesce(CASE WHEN json_type(e) <> 'VARCHAR' THEN e ->> '$.language' END, 'rust') AS language,
          coalesce(CASE WHEN json_type(e) <> 'VARCHAR' THEN CAST(e ->> '$.detected' AS BOOLEAN) END, FALSE) AS detected
        FROM (SELECT id, unnest(CAST(examples AS JSON[])) AS e FROM items WHERE examples IS NOT NULL)""",
    ),
)
def json1_parse_examples(spark, sf_dir):
    items = derived(spark, sf_dir, "items")
    return items.select("id", F.inline(code.parse_examples(F.col("examples"))))


@query(
    "json2_event_properties",
    """SELECT event_type, count(*) AS n, CAST(sum(CAST(props ->> '$.k' AS BIGINT)) AS BIGINT) AS total_k FROM events GROUP BY event_type""",
)
def json2_event_properties(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    k = F.from_json("props", "k bigint")["k"]
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total_k"))


@query(
    "json3_fingerprint",
    """SELECT substr(sha256('{"name":"' || p_name || '","size":' || CAST(p_size AS VARCHAR) || '}'), 1, 16) AS fingerprint,
      count(*) AS n FROM part GROUP BY 1""",
)
def json3_fingerprint(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    value = F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    return parts.groupBy(intelligence.fingerprint(value).alias("fingerprint")).agg(F.count("*").alias("n"))


@query(
    "strf8_error_types",
    with_tables(
        "items",
        """SELECT id, CASE id % 6 WHEN 0 THEN 'E' || module WHEN 2 THEN 'ParseError' ELSE '' END AS errors FROM items""",
    ),
)
def strf8_error_types(spark, sf_dir):
    items = derived(spark, sf_dir, "items")
    errors = intelligence.error_types(F.col("signature"))
    return items.select("id", F.array_join(errors, ",").alias("errors"))


@query(
    "strf9_safety_info",
    with_tables(
        "raw_docs",
        """SELECT id, id % 5 <> 3 AND id % 6 <> 2 AS is_safe,
          CASE WHEN id % 5 = 3 THEN 'unsafe attribute: #[warn(unsafe_code)]'
            WHEN id % 6 = 2 THEN 'unsafe keyword in signature' END AS unsafe_reason,
          CASE WHEN id % 4 = 3 THEN 'Keep ' || CAST(id % 11 AS VARCHAR) || ' alive.' END AS safety_docs FROM raw_docs""",
    ),
)
def strf9_safety_info(spark, sf_dir):
    docs = derived(spark, sf_dir, "raw_docs")
    signature = F.when(F.col("id") % 6 == 2, "pub unsafe fn f()").otherwise("pub fn unsafely()")
    attrs = F.array_compact(F.array("attr"))
    return docs.select("id", intelligence.safety_info(attrs, signature, F.col("doc")).alias("s")).select(
        "id", "s.*"
    )


@query(
    "strf10_feature_requirements",
    with_tables(
        "raw_docs",
        """SELECT id, CASE id % 5 WHEN 0 THEN 'f' || CAST(id % 3 AS VARCHAR)
          WHEN 1 THEN 'a' || CAST(id % 3 AS VARCHAR) || ',b' ELSE '' END AS features FROM raw_docs""",
    ),
)
def strf10_feature_requirements(spark, sf_dir):
    docs = derived(spark, sf_dir, "raw_docs")
    found = intelligence.feature_requirements(F.array_compact(F.array("attr")))
    return docs.select("id", F.array_join(found, ",").alias("features"))


@query(
    "strf11_signature_details",
    with_tables(
        "items",
        """SELECT id, CASE WHEN id % 6 = 5 THEN 'T: Send|T: Sync' ELSE '' END AS bounds,
          coalesce(contains(signature, '<'), FALSE) AS is_generic FROM items""",
    ),
)
def strf11_signature_details(spark, sf_dir):
    items = derived(spark, sf_dir, "items")
    details = intelligence.signature_details(F.col("signature"))
    return items.select("id", details.alias("d")).select(
        "id",
        F.coalesce(F.array_join("d.trait_bounds", "|"), F.lit("")).alias("bounds"),
        "d.is_generic",
    )


@query(
    "strf13_visibility_and_deprecation",
    with_tables(
        "raw_docs",
        """SELECT id, CASE id % 4 WHEN 0 THEN 'pub' WHEN 1 THEN 'pub(crate)' WHEN 2 THEN 'pub(in ' || item_path || ')'
          ELSE 'private' END AS visibility, id % 5 = 2 AS deprecated FROM raw_docs""",
    ),
)
def strf13_visibility_and_deprecation(spark, sf_dir):
    docs = derived(spark, sf_dir, "raw_docs")
    turn = F.col("id") % 4
    raw = (
        F.when(turn == 0, '{"public": true}')
        .when(turn == 1, "crate")
        .when(turn == 2, F.concat(F.lit('{"restricted": {"path": "'), F.col("item_path"), F.lit('"}}')))
        .otherwise("default")
    )
    return docs.select(
        "id",
        intelligence.visibility(raw).alias("visibility"),
        intelligence.deprecated(F.array_compact(F.array("attr"))).alias("deprecated"),
    )


@query(
    "strf14_normalize_kind",
    """SELECT kind, stored, count(*) AS n FROM (SELECT p_type || CASE p_partkey % 6 WHEN 0 THEN 'Function' WHEN 1 THEN 'Mod'
        WHEN 2 THEN 'typedef' WHEN 3 THEN 'Impl' WHEN 4 THEN 'assoc_const' ELSE '' END AS kind,
      CASE p_partkey % 6 WHEN 0 THEN 'function' WHEN 1 THEN 'module' WHEN 2 THEN 'type' WHEN 3 THEN 'trait_impl'
        WHEN 4 THEN 'const' ELSE lower(p_type) END AS stored FROM part) GROUP BY kind, stored""",
)
def strf14_normalize_kind(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    endings = ["Function", "Mod", "typedef", "Impl", "assoc_const", ""]
    ending = F.get(F.array(*[F.lit(e) for e in endings]), (F.col("p_partkey") % 6).cast("int"))
    kinds = parts.select(F.concat("p_type", ending).alias("kind"))
    stored = kinds.withColumn("stored", paths.normalize_kind(F.col("kind")))
    return stored.groupBy("kind", "stored").agg(F.count("*").alias("n"))


@query(
    "strf15_valid_path",
    r"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'item::' || CAST(page_id AS VARCHAR)
        WHEN 1 THEN 'crate' WHEN 2 THEN 'a::b_' || CAST(page_id AS VARCHAR)
        ELSE 'my_mod::f_x_y' || CAST(page_id AS VARCHAR) END AS path, page_id % 4 IN (0, 3) AS used_fallback FROM pages""",
)
def strf15_valid_path(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    number, turn = F.col("page_id").cast("string"), F.col("page_id") % 4
    raw = (
        F.when(turn == 0, "  ")
        .when(turn == 1, " crate ")
        .when(turn == 2, F.concat(F.lit("a::b_"), number))
        .otherwise(F.concat(F.lit("my-mod::<f>(x)--y"), number, F.lit("::__")))
    )
    fixed = paths.valid_path(raw, number, F.lit(None).cast("string"))
    return pages.select("page_id", fixed.alias("f")).select("page_id", "f.*")


@query(
    "strf16_path_parts",
    with_tables(
        "doc_paths",
        """SELECT id, crate || '::' || split_part(item_path, '::', 2) AS parent, split_part(item_path, '::', 3) AS name,
          CAST(2 AS INTEGER) AS depth, replace(item_path, 'doc_', 'd_c_') AS joined FROM doc_paths""",
    ),
)
def strf16_path_parts(spark, sf_dir):
    docs = derived(spark, sf_dir, "doc_paths")
    path = F.col("item_path")
    messy = F.transform(F.split(F.replace(path, F.lit("doc_"), F.lit("d-c-")), "::"), lambda p: F.concat(F.lit(" "), p))
    parts = paths.normalize_parts(F.concat(messy, F.array(F.lit(" "))))
    return docs.select(
        "id",
        paths.parent_of(path).alias("parent"),
        paths.last_segment(path).alias("name"),
        paths.depth_of(path).alias("depth"),
        paths.join_path(parts, F.get(parts, F.lit(2))).alias("joined"),
    )


@query(
    "strf17_kind_from_path",
    """SELECT kind, count(*) AS n FROM (SELECT CASE WHEN contains(lower(url), 'struct') THEN 'struct'
      WHEN contains(lower(url), 'trait') THEN 'trait' WHEN contains(lower(url), 'fn') OR contains(lower(url), 'function')
      THEN 'function' WHEN contains(lower(url), 'enum') THEN 'enum' WHEN contains(lower(url), 'mod') OR contains(url, '::')
      THEN 'module' ELSE 'unknown' END AS kind FROM (SELECT url || CASE page_id % 5 WHEN 0 THEN '/Struct' WHEN 1 THEN '/enum'
      WHEN 2 THEN '::x' WHEN 3 THEN '/fn_a' ELSE '' END AS url FROM pages)) GROUP BY kind""",
)
def strf17_kind_from_path(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    endings = F.array(*[F.lit(e) for e in ["/Struct", "/enum", "::x", "/fn_a", ""]])
    url = F.concat("url", F.get(endings, (F.col("page_id") % 5).cast("int")))
    return pages.groupBy(paths.kind_from_path(url).alias("kind")).agg(F.count("*").alias("n"))


@query("strf18_estimated_tokens", "SELECT doc_id, CAST(floor(length(text) / 4) AS BIGINT) AS tokens FROM documents")
def strf18_estimated_tokens(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.estimated_tokens(F.col("text")).alias("tokens"))


@query(
    "strf19_common_examples",
    """SELECT doc_id, substr(text, greatest(p - 100, 1), p + 6 + 100 - greatest(p - 100, 1)) AS snippet
    FROM (SELECT *, position('stupid' IN lower(text)) AS p FROM documents) WHERE p > 0""",
)
def strf19_common_examples(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = text.context_window(F.col("text"), "stupid")
    return docs.select("doc_id", found.alias("snippet")).where(F.col("snippet").isNotNull())


@query(
    "dif7_signature_parts",
    with_tables(
        "items",
        """SELECT id, CASE id % 6 WHEN 0 THEN 'a: u32|b: Vec<String>' WHEN 1 THEN '&self' WHEN 2 THEN 'x: &T|n: usize'
          WHEN 5 THEN 'x: T|y: u8|z: u8' WHEN 3 THEN '' END AS params,
          CASE id % 6 WHEN 0 THEN 'Result<Vec<u8>, E' || module || '>' WHEN 1 THEN 'Option<String>'
          WHEN 2 THEN 'Result<T, ParseError>' WHEN 5 THEN 'Box<T>' END AS returns FROM items""",
    ),
)
def dif7_signature_parts(spark, sf_dir):
    items = derived(spark, sf_dir, "items")
    return items.select(
        "id",
        F.array_join(signatures.parameters(F.col("signature")), "|").alias("params"),
        signatures.return_type(F.col("signature")).alias("returns"),
    )


# --- filters


@query(
    "flt1_optional_filters",
    with_tables(
        "items",
        """SELECT item_type, visibility, count(*) AS n FROM items WHERE item_type = 'struct' AND deprecated = FALSE
        GROUP BY item_type, visibility""",
    ),
)
def flt1_optional_filters(spark, sf_dir):
    kept = filters.filter_items(derived(spark, sf_dir, "items"), item_type="struct", deprecated=False)
    return kept.groupBy("item_type", "visibility").agg(F.count("*").alias("n"))


def _register_filter(name: str, where: str, **given):
    @query(name, with_tables("items", f"SELECT id, item_path FROM items WHERE {where}"))
    def run(spark, sf_dir):
        return filters.filter_items(derived(spark, sf_dir, "items"), **given).select("id", "item_path")


_register_filter("flt2_crate_prefix", "starts_with(item_path, 'de::')", crate="de")
_register_filter(
    "flt3_module_and_below",
    "item_path = 'en::src3' OR starts_with(item_path, 'en::src3::')",
    crate="en",
    module="src3",
)
_register_filter("flt4_module_anywhere", "item_path ILIKE '%::src3::%'", module="src3", mode="regex")
_register_filter("flt5_with_examples", "examples IS NOT NULL", has_examples=True)
_register_filter("flt5_without_examples", "examples IS NULL", has_examples=False, mode="regex")
_register_filter("flt6_min_doc_length", "length(content) >= 1500", min_doc_length=1500)
_register_filter("flt7_stability", "stability_level = 'unstable'", stability="unstable")


VISIBLE = """depth <= 3 AND (item_count >= 2 OR depth = 0) AND NOT regexp_matches(lower(path),
  'target::|\\.cargo::|build::|out::|tests::|benches::|examples::|deps::|__pycache__')"""


@query(
    "flt8_visible_modules",
    with_tables(
        "modules",
        f"""SELECT name, path, parent_id, depth, item_count FROM modules WHERE {VISIBLE}
        AND NOT (starts_with(name, '_') AND depth > 0)
        AND NOT regexp_matches(lower(path), 'generated|autogen|\\.pb\\.|proto')""",
    ),
)
def flt8_visible_modules(spark, sf_dir):
    return filters.visible_modules(derived(spark, sf_dir, "modules"))


@query(
    "flt8_visible_modules_fallback",
    with_tables(
        "modules",
        """SELECT '_' || name AS name, path, parent_id, depth + 1 AS depth, item_count FROM modules
        WHERE depth + 1 <= 1 OR item_count >= 5 ORDER BY depth + 1, item_count DESC, path LIMIT 20""",
    ),
)
def flt8_visible_modules_fallback(spark, sf_dir):
    modules = derived(spark, sf_dir, "modules")
    hidden = modules.withColumns({"name": F.concat(F.lit("_"), "name"), "depth": F.col("depth") + 1})
    return filters.visible_modules(hidden)


@query(
    "flt9_root_modules",
    with_tables("modules", "SELECT id, name, path, item_count FROM modules WHERE parent_id IS NULL"),
)
def flt9_root_modules(spark, sf_dir):
    roots = filters.root_modules(derived(spark, sf_dir, "modules"))
    return roots.select("id", "name", "path", "item_count")


@query(
    "flt10_unsafe_items",
    with_tables(
        "items",
        """SELECT item_path, item_type, signature, substr(content, 1, 200) AS documentation_excerpt,
        'unsafe keyword in signature' AS reason FROM items WHERE is_safe = FALSE ORDER BY item_path LIMIT 100""",
    ),
)
def flt10_unsafe_items(spark, sf_dir):
    items = _with_intelligence(derived(spark, sf_dir, "items"))
    out = filters.items_by_safety(items, safe=False, reasons=True)
    return out.select(
        "item_path", "item_type", "signature", "documentation_excerpt", F.col("safety_info.unsafe_reason").alias("reason")
    )


@query(
    "flt11_pattern_frequencies",
    with_tables(
        "items",
        """SELECT pattern, count(*) FILTER (WHERE examples ILIKE '%' || pattern || '%' OR content ILIKE '%' || pattern || '%'
          OR signature ILIKE '%' || pattern || '%') AS frequency
        FROM items, (VALUES ('unsafe'), ('Result<'), ('stupid'), ('OBJ1'), ('no such text')) v(pattern) GROUP BY pattern""",
    ),
)
def flt11_pattern_frequencies(spark, sf_dir):
    wanted = ["unsafe", "Result<", "stupid", "OBJ1", "no such text"]
    return filters.pattern_frequencies(derived(spark, sf_dir, "items"), wanted)


@query(
    "flt12_module_items",
    with_tables(
        "items", "SELECT item_path, header, item_type, signature FROM items WHERE starts_with(item_path, 'en::src5::')"
    ),
)
def flt12_module_items(spark, sf_dir):
    found = filters.module_items(derived(spark, sf_dir, "items"), "en::src5")
    return found.select("item_path", "header", "item_type", "signature")


WANTED = [f"{lang}::src{n}::doc_{n}" for n in range(20) for lang in ("en", "de", "fr", "es")]


@query(
    "flt13_signature_batch",
    with_tables(
        "items",
        f"""SELECT item_path, signature FROM items WHERE signature IS NOT NULL
        AND item_path IN ({', '.join(f"'{w}'" for w in WANTED)})""",
    ),
)
def flt13_signature_batch(spark, sf_dir):
    return filters.signatures_of(derived(spark, sf_dir, "items"), WANTED)


@query(
    "flt14_without_dependencies",
    with_tables(
        "items reexports",
        """WITH deps AS (SELECT DISTINCT actual_path AS path FROM reexports WHERE link_type = 'dependency'),
        named AS (SELECT id, CASE WHEN id % 9 = 0 THEN 'tokio::' || item_path ELSE item_path END AS item_path FROM items)
        SELECT id, item_path FROM named WHERE NOT starts_with(item_path, 'tokio::')
        AND item_path NOT IN (SELECT path FROM deps)""",
    ),
)
def flt14_without_dependencies(spark, sf_dir):
    items = derived(spark, sf_dir, "items").select(
        "id",
        F.when(F.col("id") % 9 == 0, F.concat(F.lit("tokio::"), "item_path"))
        .otherwise(F.col("item_path"))
        .alias("item_path"),
    )
    edges = derived(spark, sf_dir, "reexports").where("link_type = 'dependency'")
    deps = edges.select(F.col("actual_path").alias("path"))
    return filters.without_dependencies(items, deps, "en")


@query(
    "flt15_dependency_paths",
    with_tables(
        "doc_paths",
        """SELECT DISTINCT path FROM (SELECT item_path AS path FROM doc_paths WHERE id % 3 <> 0 AND crate <> 'en'
        UNION ALL SELECT item_path FROM doc_paths WHERE id % 5 = 0 AND NOT starts_with(item_path, 'en'))""",
    ),
)
def flt15_dependency_paths(spark, sf_dir):
    docs = derived(spark, sf_dir, "doc_paths")
    index = docs.select(
        (F.col("id") % 3).alias("crate_id"),
        F.split("item_path", "::").alias("path"),
        F.col("item_path").alias("name"),
        (F.col("id") % 5 == 0).alias("is_import"),
    )
    return filters.dependency_paths(index, "en")


@query(
    "flt16_point_lookups",
    with_tables(
        "modules items",
        """SELECT 'module' AS what, path, name AS found FROM modules WHERE path = 'ASIA'
        UNION ALL SELECT 'item', item_path, header FROM items WHERE item_path = 'en::src3::doc_63'""",
    ),
)
def flt16_point_lookups(spark, sf_dir):
    module = filters.module_by_path(derived(spark, sf_dir, "modules"), "ASIA")
    item = filters.item_document(derived(spark, sf_dir, "items"), "en::src3::doc_63")
    left = module.select(F.lit("module").alias("what"), "path", F.col("name").alias("found"))
    return left.union(item.select(F.lit("item"), "item_path", "header"))


@query(
    "dif5_kind_of_change",
    with_tables(
        "version_a",
        """SELECT item_type, CASE WHEN item_type IN ('function','struct','enum','trait') THEN item_type
        ELSE 'function' END AS kind, count(*) AS n FROM version_a GROUP BY 1, 2""",
    ),
)
def dif5_kind_of_change(spark, sf_dir):
    from docquarry.operators.diff import change_kind

    rows = derived(spark, sf_dir, "version_a")
    return rows.groupBy("item_type", change_kind(F.col("item_type")).alias("kind")).agg(F.count("*").alias("n"))


