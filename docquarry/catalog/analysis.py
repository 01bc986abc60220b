"""Registered aggregations, type navigation, versions, metrics and workflows."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.catalog.changes import changes_oracle
from docquarry.catalog.corpus import derived, table, with_tables
from docquarry.catalog.registry import query
from docquarry.functions import intelligence, semver
from docquarry.operators import diff, metrics, patterns, topn, typenav, versions, workflow
from docquarry.sources import store

# --- usage patterns


@query(
    "agg3_usage_counts",
    with_tables(
        "items",
        r"""WITH found AS (
          SELECT 'method' AS type, 'fn ' || unnest(regexp_extract_all(signature, 'fn\s+(\w+)', 1)) AS pattern FROM items
          UNION ALL SELECT 'method', '.' || unnest(regexp_extract_all(examples, '\.(\w+)\(', 1)[1:5]) || '()' FROM items
          UNION ALL SELECT 'generic', '<' || g || '>' FROM (SELECT unnest(regexp_extract_all(signature, '<([^>]+)>', 1)) AS g FROM items)
            WHERE NOT contains(g, ',')
          UNION ALL SELECT 'error_handling', 'Result<T, E>' FROM items WHERE contains(signature, 'Result<')
          UNION ALL SELECT 'error_handling', 'Option<T>' FROM items WHERE contains(signature, 'Option<')
          UNION ALL SELECT 'trait_impl', 'impl ' || unnest(regexp_extract_all(examples, 'impl\s+(\w+)\s+for\s+(\w+)', 1)) || ' for Type' FROM items),
        counts AS (SELECT type, pattern, count(*) AS frequency FROM found GROUP BY type, pattern),
        turns AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY frequency DESC, pattern) AS turn FROM counts)
        SELECT pattern, type, frequency, 'all' AS crate FROM turns WHERE turn <= CASE type WHEN 'method' THEN 10 ELSE 5 END
        ORDER BY frequency DESC, pattern, type LIMIT 20""",
    ),
)
def agg3_usage_counts(spark, sf_dir):
    return patterns.usage_counts(derived(spark, sf_dir, "items"), "all", 20)


USES = r"""uses AS (
  SELECT item_path, a || '.' || b || '()' AS pattern FROM (SELECT item_path,
    unnest(regexp_extract_all(examples, '\b(\w+)\.(\w+)\s*\(', 1)) AS a,
    unnest(regexp_extract_all(examples, '\b(\w+)\.(\w+)\s*\(', 2)) AS b FROM items)
  UNION ALL SELECT item_path, 'Generic<' || unnest(regexp_extract_all(signature, '<([^>]+)>', 1)) || '>' FROM items
  UNION ALL SELECT item_path, 'Result<' || ok || ', ' || CASE WHEN coalesce(err, '') = '' THEN 'Error' ELSE err END || '>' FROM (SELECT item_path,
    unnest(regexp_extract_all(signature, 'Result<([^,>]+)(?:,\s*([^>]+))?>', 1)) AS ok,
    unnest(regexp_extract_all(signature, 'Result<([^,>]+)(?:,\s*([^>]+))?>', 2)) AS err FROM items))"""


@query(
    "agg4_usage_patterns",
    with_tables(
        "items",
        f"""WITH {USES}, counts AS (SELECT pattern, count(*) AS frequency FROM uses GROUP BY pattern HAVING count(*) >= 2
          ORDER BY frequency DESC, pattern LIMIT 25)
        SELECT c.pattern AS pattern, frequency, least(1.0::DOUBLE, frequency / 10.0::DOUBLE) AS confidence,
          CASE WHEN contains(c.pattern, '.') THEN 'method_call' WHEN contains(c.pattern, 'Result<') THEN 'error_handling'
            WHEN contains(c.pattern, 'Option<') THEN 'optional_value' ELSE 'generic_type' END AS pattern_type,
          array_to_string(list_sort(list(u.item_path))[1:3], ' ') AS places
        FROM counts c JOIN uses u ON u.pattern = c.pattern GROUP BY c.pattern, frequency""",
    ),
)
def agg4_usage_patterns(spark, sf_dir):
    out = patterns.usage_patterns(derived(spark, sf_dir, "items"), 25)
    places = F.array_join(F.transform("examples", lambda e: e["item"]), " ")
    return out.select("pattern", "frequency", "confidence", "pattern_type", places.alias("places"))


@query(
    "agg5_pattern_category",
    with_tables(
        "items",
        f"""WITH {USES} SELECT CASE WHEN position('.' IN pattern) > 0 AND position('.' IN pattern) < position('(' IN pattern)
            THEN 'method_call' WHEN contains(pattern, 'Result<') THEN 'error_handling'
            WHEN contains(pattern, 'Option<') THEN 'optional_value' ELSE 'generic_type' END AS category, count(*) AS n
        FROM uses GROUP BY 1""",
    ),
)
def agg5_pattern_category(spark, sf_dir):
    uses = patterns.pattern_uses(derived(spark, sf_dir, "items"))
    category = patterns.pattern_category(F.col("pattern")).alias("category")
    return uses.groupBy(category).agg(F.count("*").alias("n"))


@query(
    "agg6_confidence_score",
    """SELECT p_brand, round(least(1.0, (count(*) / t.n + ln(count(*) + 1) / ln(t.n + 1)) / 2), 6) AS confidence
    FROM part, (SELECT CAST(count(*) AS DOUBLE) AS n FROM part) t GROUP BY p_brand, t.n""",
)
def agg6_confidence_score(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    total = parts.agg(F.count("*")).scalar()
    counts = parts.groupBy("p_brand").agg(F.count("*").alias("n"))
    score = patterns.confidence_score(F.col("n"), total)
    return counts.select("p_brand", F.round(score, 6).alias("confidence"))


@query(
    "agg7_module_analysis",
    with_tables(
        "items",
        r"""WITH m AS (SELECT * FROM items WHERE item_path ILIKE 'en::src1%'),
        facets AS (SELECT 'total' AS facet, 'all' AS value FROM m UNION ALL SELECT 'type', item_type FROM m
          UNION ALL SELECT 'visibility', coalesce(visibility, 'public') FROM m UNION ALL SELECT 'deprecated', 'true' FROM m WHERE deprecated),
        tops AS (SELECT 'generic' AS facet, g AS value FROM (SELECT unnest(regexp_extract_all(signature, '<([^>]+)>', 1)) AS g FROM m)
            WHERE NOT contains(g, ',')
          UNION ALL SELECT 'return', trim(split_part(signature, ' -> ', -1)) FROM m WHERE contains(signature, ' -> ')),
        ranked AS (SELECT facet, value, count(*) AS n, row_number() OVER (PARTITION BY facet ORDER BY count(*) DESC, value) AS turn
          FROM tops GROUP BY facet, value)
        SELECT facet, value, count(*) AS n FROM facets GROUP BY facet, value
        UNION ALL SELECT facet, value, n FROM ranked WHERE turn <= 5""",
    ),
)
def agg7_module_analysis(spark, sf_dir):
    return patterns.module_analysis(derived(spark, sf_dir, "items"), "en::src1")


@query(
    "agg8_error_catalog",
    with_tables(
        "items",
        """WITH e AS (SELECT item_path, CASE id % 6 WHEN 0 THEN 'E' || module ELSE 'ParseError' END AS error_type
          FROM items WHERE id % 6 IN (0, 2))
        SELECT error_type, count(*) AS occurrence_count, array_to_string(list_sort(list(item_path))[1:3], ' ') AS places
        FROM e WHERE error_type ILIKE '%src1%' OR error_type ILIKE '%er%' GROUP BY error_type""",
    ),
)
def agg8_error_catalog(spark, sf_dir):
    items = derived(spark, sf_dir, "items").withColumn(
        "error_types", intelligence.error_types(F.col("signature"))
    )
    out = patterns.error_catalog(items, "SRC1").unionByName(patterns.error_catalog(items, "er"))
    places = F.array_join(F.transform("example_items", lambda e: e["item_path"]), " ")
    return out.select("error_type", "occurrence_count", places.alias("places"))


VERSIONED = """SELECT crate, 'v' || CAST(id % 4 AS VARCHAR) AS version, item_path, deprecated, item_type FROM items"""


def _versioned(spark, sf_dir):
    items = derived(spark, sf_dir, "items")
    version = F.concat(F.lit("v"), (F.col("id") % 4).cast("string"))
    return items.select("crate", version.alias("version"), "item_path", "deprecated", "item_type")


def _releases(items):
    extra = items.select("crate", F.lit("v9").alias("version"))
    return items.select("crate", "version").union(extra).distinct()


STATS = f"""v AS ({VERSIONED}), r AS (SELECT DISTINCT crate, version FROM v UNION SELECT DISTINCT crate, 'v9' FROM v),
stats AS (SELECT r.crate AS crate, r.version AS version, count(DISTINCT item_path) AS item_count,
    count(DISTINCT CASE WHEN deprecated THEN item_path END) AS deprecated_count, count(DISTINCT item_type) AS type_diversity
  FROM r LEFT JOIN v ON v.crate = r.crate AND v.version = r.version GROUP BY r.crate, r.version)"""


@query(
    "agg1_api_evolution",
    with_tables(
        "items",
        f"""WITH {STATS} SELECT crate, version, item_count, deprecated_count, type_diversity,
        round(1.0 - deprecated_count / greatest(item_count, 1), 6) AS stability_score FROM stats""",
    ),
)
def agg1_api_evolution(spark, sf_dir):
    items = _versioned(spark, sf_dir)
    out = patterns.api_evolution(_releases(items), items)
    return out.withColumn("stability_score", F.round("stability_score", 6))


@query(
    "agg2_evolution_steps",
    with_tables(
        "items",
        f"""WITH {STATS}, p AS (SELECT *, lag(version) OVER w AS pv, lag(item_count) OVER w AS pi, lag(deprecated_count) OVER w AS pd
          FROM stats WINDOW w AS (PARTITION BY crate ORDER BY version))
        SELECT crate, pv AS from_version, version AS to_version, item_count - pi AS item_change,
        deprecated_count - pd AS deprecated_change, round(item_count / greatest(pi, 1) - 1, 6) AS growth_rate FROM p WHERE pv IS NOT NULL""",
    ),
)
def agg2_evolution_steps(spark, sf_dir):
    items = _versioned(spark, sf_dir)
    stats = patterns.api_evolution(_releases(items), items)
    out = patterns.evolution_steps(stats, F.col("version"))
    return out.withColumn("growth_rate", F.round("growth_rate", 6))


@query(
    "join7_release_items",
    with_tables(
        "items",
        f"""WITH {STATS} SELECT version, CAST(sum(item_count) AS BIGINT) AS items, count(*) FILTER (WHERE item_count = 0) AS empty FROM stats GROUP BY version""",
    ),
)
def join7_release_items(spark, sf_dir):
    items = _versioned(spark, sf_dir)
    stats = patterns.api_evolution(_releases(items), items)
    return stats.groupBy("version").agg(
        F.sum("item_count").alias("items"), F.count_if(F.col("item_count") == 0).alias("empty")
    )


@query(
    "agg9_associated_by_kind",
    with_tables(
        "associated_items",
        """SELECT container_path, item_kind, count(*) AS total, array_to_string(list_sort(list(item_name)), ',') AS names
        FROM associated_items GROUP BY container_path, item_kind""",
    ),
)
def agg9_associated_by_kind(spark, sf_dir):
    rows = derived(spark, sf_dir, "associated_items")
    grouped = rows.groupBy("container_path", "item_kind").agg(
        F.count("*").alias("total"), F.sort_array(F.collect_list("item_name")).alias("names")
    )
    return grouped.withColumn("names", F.array_join("names", ","))


@query(
    "agg11_consistency",
    """SELECT (SELECT count(*) FROM documents) AS items, (SELECT count(*) FROM embeddings) AS vectors,
      (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) AS orphans,
      (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS missing, FALSE AS consistent""",
)
def agg11_consistency(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return store.consistency(docs, vectors)


@query(
    "join5_unsynced",
    """SELECT doc_id AS id, 'missing vector' AS issue FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
    UNION ALL SELECT vec_id, 'orphan vector' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)""",
)
def join5_unsynced(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return store.unsynced(docs, vectors)


@query(
    "join1_items_with_vectors",
    "SELECT d.source AS source, count(*) AS n FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY d.source",
)
def join1_items_with_vectors(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return docs.join(vectors, "id").groupBy("source").agg(F.count("*").alias("n"))


@query(
    "join4_links_with_versions",
    with_tables(
        "reexports",
        """SELECT r.alias_path AS alias_path, r.actual_path AS actual_path, r.link_type AS link_type, v.version AS target_version
        FROM reexports r LEFT JOIN (VALUES ('en', '1.0'), ('de', '2.0')) v(crate, version) ON split_part(r.actual_path, '::', 1) = v.crate""",
    ),
)
def join4_links_with_versions(spark, sf_dir):
    from docquarry.functions.paths import crate_of

    links = derived(spark, sf_dir, "reexports").withColumn("_crate", crate_of(F.col("actual_path")))
    known = spark.createDataFrame([("en", "1.0"), ("de", "2.0")], "_crate string, target_version string")
    return links.join(known, "_crate", "left").select("alias_path", "actual_path", "link_type", "target_version")


@query(
    "agg12_latest_copy",
    """SELECT text, max(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1""",
)
def agg12_latest_copy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("text", "doc_id")
    last = store.keep_last(docs, ["text"], ["doc_id"], copies="copies")
    return last.where("copies > 1")


# --- type navigation


@query(
    "typ1_trait_implementors",
    with_tables(
        "trait_impls",
        """SELECT impl_type_path AS type_path, generic_params, where_clauses, is_blanket, impl_signature, stability_level AS stability
        FROM trait_impls WHERE trait_path = 'core::promo::PROMO'""",
    ),
)
def typ1_trait_implementors(spark, sf_dir):
    return typenav.trait_implementors(derived(spark, sf_dir, "trait_impls"), "parts", "core::promo::PROMO")


@query(
    "typ1_trait_implementors_bare_name",
    with_tables(
        "trait_impls",
        """SELECT impl_type_path AS type_path, generic_params, where_clauses, is_blanket, impl_signature, stability_level AS stability
        FROM trait_impls WHERE trait_path = 'PROMO'""",
    ),
)
def typ1_trait_implementors_bare_name(spark, sf_dir):
    return typenav.trait_implementors(derived(spark, sf_dir, "trait_impls"), "parts", "other::PROMO")


@query(
    "typ2_type_traits",
    with_tables(
        "trait_impls",
        """SELECT trait_path, generic_params, where_clauses, is_negative, impl_signature, stability_level AS stability
        FROM trait_impls WHERE impl_type_path = 'parts::' || (SELECT replace(p_name, ' ', '_') FROM part WHERE p_partkey = 60) || '::P60'""",
    ),
)
def typ2_type_traits(spark, sf_dir):
    name = table(spark, sf_dir, "part").where("p_partkey = 60").head()["p_name"].replace(" ", "_")
    return typenav.type_traits(derived(spark, sf_dir, "trait_impls"), "parts", f"parts::{name}::P60")


@query(
    "typ3_resolve_method",
    with_tables(
        "methods",
        """SELECT full_signature, method_kind, trait_source, receiver_type, is_const FROM methods
        WHERE parent_type_path = 'parts::T7' AND method_name = 'm3'""",
    ),
)
def typ3_resolve_method(spark, sf_dir):
    found = typenav.resolve_method(derived(spark, sf_dir, "methods"), "parts", "parts::T7", "m3")
    return found.select("full_signature", "method_kind", "trait_source", "receiver_type", "is_const")


@query(
    "typ3_method_status",
    with_tables(
        "methods",
        """WITH g AS (SELECT parent_type_path, method_name, count(*) AS candidates, count(*) FILTER (WHERE method_kind = 'inherent') AS i,
            count(*) FILTER (WHERE method_kind = 'trait') AS t, list_sort(list(DISTINCT trait_source) FILTER (WHERE trait_source IS NOT NULL)) AS s,
            list_sort(list(DISTINCT receiver_type) FILTER (WHERE receiver_type IS NOT NULL)) AS r, count(*) FILTER (WHERE is_const) AS c
          FROM methods GROUP BY parent_type_path, method_name)
        SELECT parent_type_path, method_name, candidates, CASE WHEN candidates = 1 THEN 'unique' ELSE 'ambiguous' END AS resolution_status,
          concat_ws('; ', CASE WHEN i > 0 AND t > 0 THEN 'Multiple methods found: inherent and trait implementations; Inherent method takes precedence by default' END,
            CASE WHEN i > 0 AND t > 0 AND len(s) > 0 THEN 'Trait methods from: ' || array_to_string(s, ', ') END,
            CASE WHEN candidates > 1 AND len(r) > 1 THEN 'Different receiver types: ' || array_to_string(r, ', ') END,
            CASE WHEN candidates > 1 AND c > 0 AND c < candidates THEN 'Both const and non-const versions available' END) AS hints FROM g""",
    ),
)
def typ3_method_status(spark, sf_dir):
    out = typenav.method_status(derived(spark, sf_dir, "methods"))
    return out.select(
        "parent_type_path", "method_name", "candidates", "resolution_status",
        F.array_join("disambiguation_hints", "; ").alias("hints"),
    )


@query(
    "typ4_associated_items",
    with_tables(
        "associated_items",
        """SELECT item_name, item_kind, item_signature FROM associated_items
        WHERE container_path = 'parts::C7' AND item_kind = 'const'""",
    ),
)
def typ4_associated_items(spark, sf_dir):
    found = typenav.associated_items(derived(spark, sf_dir, "associated_items"), "parts", "parts::C7", "const")
    return found.select("item_name", "item_kind", "item_signature")


@query(
    "typ5_generic_constraints",
    with_tables(
        "generic_constraints",
        """SELECT param_name, param_kind || '_params' AS param_group, bounds, position FROM generic_constraints WHERE item_path = 'parts::G9'""",
    ),
)
def typ5_generic_constraints(spark, sf_dir):
    found = typenav.generic_constraints(derived(spark, sf_dir, "generic_constraints"), "parts", "parts::G9")
    return found.select("param_name", "param_group", "bounds", "position")


@query(
    "typ7_row_readers",
    with_tables(
        "methods", "SELECT method_name, method_kind, full_signature FROM methods WHERE parent_type_path = 'parts::T9'"
    ),
)
def typ7_row_readers(spark, sf_dir):
    rows = typenav.query_rows(
        derived(spark, sf_dir, "methods"), ["method_kind", "method_name"], crate="parts", parent_type_path="parts::T9"
    )
    return rows.select("method_name", "method_kind", "full_signature")


@query(
    "join12_methods_with_defaults",
    with_tables(
        "methods",
        """WITH impls AS (SELECT DISTINCT parent_type_path AS ty, trait_source AS tr FROM methods WHERE trait_source IS NOT NULL),
        own AS (SELECT DISTINCT parent_type_path AS ty, trait_source AS tr, method_name AS m FROM methods
          WHERE trait_source IS NOT NULL AND method_name IN ('m1', 'm3', 'm5')),
        defaults AS (SELECT DISTINCT trait_source AS tr, method_name AS m FROM methods WHERE trait_source IS NOT NULL)
        SELECT ty AS impl_type_path, tr AS trait_path, m AS method_name, FALSE AS is_default FROM own
        UNION ALL SELECT i.ty, i.tr, d.m, TRUE FROM impls i JOIN defaults d ON d.tr = i.tr
        WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.ty = i.ty AND o.tr = i.tr AND o.m = d.m)""",
    ),
)
def join12_methods_with_defaults(spark, sf_dir):
    rows = derived(spark, sf_dir, "methods").where("trait_source IS NOT NULL")
    named = rows.select(
        F.col("parent_type_path").alias("impl_type_path"), F.col("trait_source").alias("trait_path"), "method_name"
    ).distinct()
    own = named.where(F.col("method_name").isin("m1", "m3", "m5"))
    defaults = named.select("trait_path", "method_name").distinct()
    return typenav.methods_with_defaults(own, defaults, named.select("impl_type_path", "trait_path"))


@query(
    "typ11_supertraits",
    """WITH RECURSIVE d AS (SELECT DISTINCT 'T' || CAST(s_suppkey AS VARCHAR) AS t, 'T' || CAST(CAST(floor(s_suppkey / 3) AS BIGINT) AS VARCHAR) AS s
      FROM supplier), w AS (SELECT t, s, 1 AS level FROM d UNION SELECT w.t, d.s, w.level + 1 FROM w JOIN d ON d.t = w.s WHERE w.level < 3)
    SELECT t AS trait_path, s AS supertrait, min(level) AS level FROM w GROUP BY t, s""",
)
def typ11_supertraits(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier")
    definitions = rows.select(
        F.concat(F.lit("T"), F.col("s_suppkey").cast("string")).alias("trait_path"),
        F.concat(F.lit("T"), F.floor(F.col("s_suppkey") / 3).cast("string")).alias("supertrait"),
    )
    return typenav.supertraits(definitions)


# --- versions and popularity

NUMBERS = r"""parsed AS (SELECT *, regexp_full_match(version, '\d+\.\d+\.\d+(-rc\.\d+)?') AS ok,
    TRY_CAST(split_part(version, '.', 1) AS BIGINT) AS a, TRY_CAST(split_part(version, '.', 2) AS BIGINT) AS b,
    TRY_CAST(regexp_extract(version, '^\d+\.\d+\.(\d+)', 1) AS BIGINT) AS c, NOT contains(version, '-') AS rel,
    coalesce(TRY_CAST(regexp_extract(version, '-rc\.(\d+)$', 1) AS BIGINT), 0) AS pre FROM published),
keyed AS (SELECT *, CASE WHEN ok THEN a * 1000000000000 + b * 1000000000 + c * 1000000 + CASE WHEN rel THEN 999999 ELSE pre END END AS k FROM parsed)"""


@query(
    "top4_list_versions",
    with_tables(
        "published",
        f"""WITH {NUMBERS}, latest AS (SELECT crate, arg_max(version, (created_at, coalesce(k, -1), version)) AS l FROM keyed WHERE NOT yanked GROUP BY crate)
        SELECT DISTINCT p.crate AS crate, version, yanked, version = l AS is_latest FROM keyed p JOIN latest USING (crate)""",
    ),
)
def top4_list_versions(spark, sf_dir):
    return versions.list_versions(derived(spark, sf_dir, "published"))


@query(
    "dat1_latest_version",
    with_tables(
        "published",
        f"""WITH {NUMBERS} SELECT crate, arg_max(version, (created_at, coalesce(k, -1), version)) AS latest FROM keyed WHERE NOT yanked GROUP BY crate""",
    ),
)
def dat1_latest_version(spark, sf_dir):
    listed = versions.list_versions(derived(spark, sf_dir, "published"))
    return listed.where("is_latest").select("crate", F.col("version").alias("latest")).distinct()


@query(
    "top4_version_rank",
    with_tables(
        "published",
        f"""WITH {NUMBERS}, d AS (SELECT DISTINCT crate, version, k FROM keyed)
        SELECT crate, version, row_number() OVER (PARTITION BY crate ORDER BY k DESC NULLS LAST, version DESC) AS place FROM d""",
    ),
)
def top4_version_rank(spark, sf_dir):
    from pyspark.sql import Window as W

    rows = derived(spark, sf_dir, "published").select("crate", "version").distinct()
    keyed = rows.withColumn("_key", semver.sort_key(F.col("version")))
    w = W.partitionBy("crate").orderBy(F.col("_key").desc_nulls_last(), F.desc("version"))
    return keyed.select("crate", "version", F.row_number().over(w).cast("bigint").alias("place"))


@query(
    "dif12_best_versions",
    with_tables(
        "published requirements",
        f"""WITH {NUMBERS}, pool AS (SELECT DISTINCT crate, version, a, b, c, k FROM keyed WHERE ok AND rel),
        r AS (SELECT *, CASE id % 8 WHEN 0 THEN 'caret' WHEN 1 THEN 'tilde' WHEN 2 THEN 'wildcard' WHEN 3 THEN 'exact' WHEN 4 THEN 'complex'
          WHEN 5 THEN 'exact' WHEN 6 THEN 'tilde' ELSE 'unknown' END AS kind FROM requirements),
        m AS (SELECT r.id AS id, arg_max(p.version, p.k) FILTER (WHERE CASE r.id % 8 WHEN 0 THEN p.a = 1 AND (p.b, p.c) >= (2, 3)
            WHEN 1 THEN p.a = 2 AND p.b = 3 AND p.c >= 1 WHEN 2 THEN p.a = 1 WHEN 3 THEN p.version = '3.4.5'
            WHEN 5 THEN p.version = '2.0.0' WHEN 6 THEN p.a = 4 AND p.b = 1 ELSE FALSE END) AS hit, arg_max(p.version, p.k) AS top
          FROM r LEFT JOIN pool p ON p.crate = r.crate GROUP BY r.id)
        SELECT r.id AS id, r.crate AS crate, r.spec AS spec, r.kind AS kind,
          CASE WHEN r.kind = 'exact' THEN m.hit ELSE coalesce(m.hit, m.top) END AS matched_version FROM r JOIN m USING (id)""",
    ),
)
def dif12_best_versions(spark, sf_dir):
    out = versions.best_versions(derived(spark, sf_dir, "requirements"), derived(spark, sf_dir, "published"))
    return out.select("id", "crate", "spec", "kind", "matched_version")


@query(
    "dif13_resolve_requirements",
    with_tables(
        "published requirements",
        f"""WITH {NUMBERS}, top AS (SELECT crate, arg_max(version, k) AS t FROM keyed WHERE ok AND rel GROUP BY crate)
        SELECT id, crate, spec, CASE WHEN id % 8 IN (4, 7) THEN spec ELSE coalesce(t, spec) END AS resolved
        FROM requirements LEFT JOIN top USING (crate)""",
    ),
)
def dif13_resolve_requirements(spark, sf_dir):
    return versions.resolve_requirements(
        derived(spark, sf_dir, "requirements"), derived(spark, sf_dir, "published")
    ).select("id", "crate", "spec", "resolved")


@query(
    "top7_ingestion_order",
    with_tables("popularity", "SELECT crate, CAST(-downloads AS DOUBLE) AS priority FROM popularity"),
)
def top7_ingestion_order(spark, sf_dir):
    return versions.ingestion_order(derived(spark, sf_dir, "popularity")).select(
        "crate", (F.col("priority") + 0.0).alias("priority")
    )


@query(
    "src10_popular",
    with_tables("popularity", "SELECT crate, downloads FROM popularity ORDER BY downloads DESC, crate LIMIT 100"),
)
def src10_popular(spark, sf_dir):
    return versions.popular(derived(spark, sf_dir, "popularity"), 100).select("crate", "downloads")


@query(
    "join13_with_downloads",
    with_tables(
        "popularity",
        """SELECT n_name || '_' || c.c_name AS file, coalesce(p.downloads, 0) AS downloads FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey
        LEFT JOIN (SELECT * FROM popularity WHERE category = 'MACHINERY') p ON p.crate = c.c_name""",
    ),
)
def join13_with_downloads(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    files = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    files = files.select(F.concat_ws("_", "n_name", "c_name").alias("file"), F.col("c_name").alias("crate"))
    known = derived(spark, sf_dir, "popularity").where("category = 'MACHINERY'")
    return versions.with_downloads(files, known).select("file", "downloads")


@query(
    "rnk2_evictions",
    with_tables(
        "popularity",
        """WITH r AS (SELECT *, CASE WHEN downloads > 0 THEN log10(downloads + 1) ELSE 0 END AS priority FROM popularity),
        s AS (SELECT *, sum(size_bytes) OVER (ORDER BY priority, mtime, crate ROWS UNBOUNDED PRECEDING) AS removed_bytes,
          sum(size_bytes) OVER () AS total FROM r)
        SELECT crate, downloads, CAST(removed_bytes AS BIGINT) AS removed_bytes FROM s WHERE removed_bytes - size_bytes < total - 300000000""",
    ),
)
def rnk2_evictions(spark, sf_dir):
    stored = derived(spark, sf_dir, "popularity")
    out = versions.evictions(stored.drop("downloads"), stored, 300_000_000)
    return out.select("crate", "downloads", "removed_bytes")


@query(
    "agg15_cache_size", with_tables("popularity", "SELECT CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM popularity")
)
def agg15_cache_size(spark, sf_dir):
    return versions.cache_size(derived(spark, sf_dir, "popularity"))


@query(
    "dat1_age_days",
    with_tables("popularity", "SELECT crate, round((1700000000.0 - mtime) / 86400, 6) AS age_days FROM popularity"),
)
def dat1_age_days(spark, sf_dir):
    aged = versions.age_days(derived(spark, sf_dir, "popularity"), 1_700_000_000)
    return aged.select("crate", F.round("age_days", 6).alias("age_days"))


# --- metrics and status

NOW = "2024-01-30 23:57:30"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", "event_type", F.col("value").alias("duration"))


@query(
    "agg13_event_stats",
    """WITH k AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000),
    d AS (SELECT list_sort(list(value)) AS v FROM k WHERE value <> 0)
    SELECT (SELECT count(*) FROM k) AS events, round(list_sum(v) / len(v), 3) AS avg_duration,
      round(v[CAST(floor(len(v) * 0.95) AS BIGINT) + 1], 3) AS p95_duration FROM d""",
)
def agg13_event_stats(spark, sf_dir):
    return metrics.event_stats(_events(spark, sf_dir))


@query(
    "agg13_all_events",
    """WITH d AS (SELECT event_type, count(*) AS events, list_sort(list(value) FILTER (WHERE value <> 0)) AS v FROM events GROUP BY event_type)
    SELECT event_type, events, round(list_sum(v) / len(v), 3) AS avg_duration, round(v[CAST(floor(len(v) * 0.95) AS BIGINT) + 1], 3) AS p95_duration FROM d""",
)
def agg13_all_events(spark, sf_dir):
    return metrics.all_event_stats(_events(spark, sf_dir), ["event_type"])


@query("agg13_counters", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def agg13_counters(spark, sf_dir):
    return metrics.counters(_events(spark, sf_dir))


@query(
    "str1_event_rates",
    f"""WITH w AS (SELECT *, date_diff('microsecond', ts, TIMESTAMP '{NOW}') / 1e6 AS age FROM events),
    i AS (SELECT * FROM w WHERE age BETWEEN 0 AND 86400)
    SELECT event_type, count(*) AS n, round(count(*) / (SELECT max(age) FROM i), 8) AS rate FROM i GROUP BY event_type""",
)
def str1_event_rates(spark, sf_dir):
    rates = metrics.event_rates(_events(spark, sf_dir), NOW, 86400)
    return rates.select("event_type", "n", F.round("rate", 8).alias("rate"))


@query(
    "str2_bounded_history",
    """SELECT event_type, event_id, age_rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS age_rank
    FROM events) WHERE age_rank <= 100""",
)
def str2_bounded_history(spark, sf_dir):
    kept = metrics.bounded_history(_events(spark, sf_dir), 100)
    return kept.select("event_type", "event_id", F.col("age_rank").cast("bigint").alias("age_rank"))


STATUS = """status AS (SELECT crate_id, crate, arg_max(status, (updated_at, seq)) AS status, min(updated_at) AS started_at,
    max(updated_at) AS updated_at, max(updated_at) FILTER (WHERE status = 'completed') AS completed_at,
    arg_max(coalesce(error_message, '-'), (updated_at, seq)) AS error_message,
    arg_max(items_processed, (updated_at, seq)) FILTER (WHERE items_processed IS NOT NULL) AS items_processed,
    arg_max(total_items, (updated_at, seq)) FILTER (WHERE total_items IS NOT NULL) AS total_items,
    arg_max(ingestion_tier, (updated_at, seq)) FILTER (WHERE ingestion_tier IS NOT NULL) AS ingestion_tier
  FROM status_log GROUP BY crate_id, crate)"""


@query(
    "str9_merge_status",
    with_tables(
        "status_log",
        f"""WITH {STATUS} SELECT crate_id, status, error_message, items_processed, total_items, ingestion_tier,
        strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at, strftime(completed_at, '%Y-%m-%d %H:%M:%S') AS completed_at FROM status""",
    ),
)
def str9_merge_status(spark, sf_dir):
    status = metrics.merge_status(derived(spark, sf_dir, "status_log"))
    return status.select(
        "crate_id", "status", F.coalesce("error_message", F.lit("-")).alias("error_message"),
        "items_processed", "total_items", "ingestion_tier",
        F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"),
        F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss").alias("completed_at"),
    )


@query(
    "str3_stalled",
    with_tables(
        "status_log",
        f"""WITH {STATUS} SELECT crate_id, status, date_sub('second', updated_at, TIMESTAMP '{NOW}') AS stale_seconds FROM status
        WHERE status IN ('started', 'downloading', 'processing') AND date_sub('second', updated_at, TIMESTAMP '{NOW}') > 600""",
    ),
)
def str3_stalled(spark, sf_dir):
    status = metrics.merge_status(derived(spark, sf_dir, "status_log"))
    return metrics.stalled(status, NOW).select("crate_id", "status", "stale_seconds")


@query(
    "join8_incomplete",
    with_tables(
        "status_log",
        f"""WITH {STATUS} SELECT crate_id, crate, status, items_processed, total_items FROM status WHERE status <> 'completed'""",
    ),
)
def join8_incomplete(spark, sf_dir):
    status = metrics.merge_status(derived(spark, sf_dir, "status_log"))
    return metrics.incomplete(status).select("crate_id", "crate", "status", "items_processed", "total_items")


@query(
    "agg14_progress",
    with_tables(
        "status_log",
        f"""WITH {STATUS}, b AS (SELECT count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS success,
          count(*) FILTER (WHERE status = 'failed') AS failed, avg(date_sub('second', started_at, completed_at))
            FILTER (WHERE status = 'completed' AND date_sub('second', started_at, completed_at) > 0) AS took FROM status)
        SELECT total, success, failed, success + failed AS processed, total - success - failed AS remaining,
          round((success + failed) / total * 100, 6) AS progress_percent, round((success + failed) / 3600.0, 6) AS rate_per_second,
          CAST(floor((total - success - failed) / (3 / took)) AS BIGINT) AS eta_seconds FROM b""",
    ),
)
def agg14_progress(spark, sf_dir):
    status = metrics.merge_status(derived(spark, sf_dir, "status_log"))
    out = metrics.progress(status, 3600.0)
    return out.withColumns(
        {n: F.round(n, 6) for n in ("progress_percent", "rate_per_second")}
    )


# --- workflows


@query(
    "dif14_migration_path",
    changes_oracle(
        """, n AS (SELECT count(*) FILTER (WHERE category = 'breaking') AS b, count(*) FILTER (WHERE category = 'deprecated') AS d,
          count(*) FILTER (WHERE category = 'added') AS a FROM listed), t AS (SELECT *, 15 * b + 10 * d + 5 * a AS m FROM n),
        e AS (SELECT *, CASE WHEN m < 60 THEN CAST(m AS VARCHAR) || ' minutes' WHEN m < 480 THEN CAST(m // 60 AS VARCHAR) || ' hours'
          ELSE CAST(m // 480 AS VARCHAR) || ' days' END AS estimated_effort FROM t)
        SELECT 1 AS step, 'Address Breaking Changes' AS title, 'Fix ' || b || ' breaking changes' AS description,
          (b * 15) || ' minutes' AS estimated_time, estimated_effort FROM e WHERE b > 0
        UNION ALL SELECT 2, 'Replace Deprecated Items', 'Update ' || d || ' deprecated items', (d * 10) || ' minutes', estimated_effort FROM e WHERE d > 0
        UNION ALL SELECT 3, 'Explore New Features', 'Learn about ' || a || ' new items', (a * 5) || ' minutes', estimated_effort FROM e WHERE a > 0"""
    ),
)
def dif14_migration_path(spark, sf_dir):
    changes = diff.compare(derived(spark, sf_dir, "version_a"), derived(spark, sf_dir, "version_b"))
    return workflow.migration_steps(diff.summary(changes))


@query(
    "dif14_onboarding",
    with_tables(
        "items",
        """WITH tops AS (SELECT DISTINCT item_path, item_type, header FROM items WHERE id % 20 = 0 AND item_type IN ('module','struct','trait','function')
          ORDER BY item_path LIMIT 20),
        s AS (SELECT CASE WHEN item_type IN ('module','trait') THEN 1 WHEN item_type = 'struct' THEN 2 ELSE 3 END AS step, * FROM tops),
        n AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY item_path) AS turn FROM s),
        f AS (SELECT item_path, item_type FROM items WHERE item_path ILIKE '%src7%' OR header ILIKE '%src7%' ORDER BY item_path LIMIT 5)
        SELECT step, item_path, item_type FROM n WHERE turn <= 5 UNION ALL SELECT 4, item_path, item_type FROM f""",
    ),
)
def dif14_onboarding(spark, sf_dir):
    items = derived(spark, sf_dir, "items")
    items = items.withColumn("parent_id", F.when(F.col("id") % 20 != 0, F.col("parent_id")))
    return workflow.onboarding_steps(items, ["src7"]).select("step", "item_path", "item_type")


@query(
    "dif15_documentation",
    with_tables(
        "items",
        """SELECT item_path, 'detailed' AS detail_level, header AS summary, signature, item_type AS type,
        coalesce(visibility, 'public') AS visibility, coalesce(deprecated, FALSE) AS deprecated, content AS documentation, examples
        FROM items WHERE item_path = 'en::src3::doc_63'""",
    ),
)
def dif15_documentation(spark, sf_dir):
    return workflow.documentation(derived(spark, sf_dir, "items"), "en::src3::doc_63", "detailed")


# --- sorted and limited reads


@query(
    "top1_per_group",
    """SELECT l_suppkey, l_orderkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey
      ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_quantity) AS rn FROM lineitem) WHERE rn <= 3""",
)
def top1_per_group(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    order = [F.desc("l_extendedprice"), *[F.asc(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")]]
    return topn.first_per_group(rows, ["l_suppkey"], order, 3).select("l_suppkey", "l_orderkey", "l_extendedprice")


@query(
    "top3_most_common_words",
    r"""SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM documents)
    WHERE word <> '' GROUP BY word ORDER BY n DESC, word LIMIT 50""",
)
def top3_most_common_words(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    words = docs.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where("word <> ''")
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "word").limit(50)


@query(
    "top5_ordered_members",
    with_tables(
        "trait_impls",
        """SELECT trait_path, impl_type_path, is_blanket FROM trait_impls ORDER BY is_blanket, impl_type_path LIMIT 200""",
    ),
)
def top5_ordered_members(spark, sf_dir):
    rows = typenav.query_rows(derived(spark, sf_dir, "trait_impls"), ["is_blanket", "impl_type_path"])
    return rows.limit(200).select("trait_path", "impl_type_path", "is_blanket")


@query(
    "set4_ordered_distinct",
    """SELECT conv_id, array_to_string(list_filter(r, lambda x, i: list_position(r, x) = i), ',') AS roles FROM (
      SELECT conv_id, list(role ORDER BY turn) AS r FROM conversations GROUP BY conv_id)""",
)
def set4_ordered_distinct(spark, sf_dir):
    # first turn of every role, then roles by first turn: no list of all turns is built
    talks = table(spark, sf_dir, "conversations")
    first = talks.groupBy("conv_id", "role").agg(F.min("turn").alias("turn"))
    listed = F.sort_array(F.collect_list(F.struct("turn", "role")))
    ordered = first.groupBy("conv_id").agg(listed.alias("r"))
    return ordered.select("conv_id", F.array_join(F.transform("r", lambda x: x["role"]), ",").alias("roles"))
