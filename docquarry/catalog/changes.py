"""Registered version comparisons and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.catalog.corpus import derived, with_tables
from docquarry.catalog.registry import query
from docquarry.operators import diff, graph

CHANGES = """both_sides AS (SELECT coalesce(a.item_path, b.item_path) AS path, a.item_path IS NULL AS new,
    b.item_path IS NULL AS gone, a.item_type AS a_type, b.item_type AS b_type, a.signature AS a_sig, b.signature AS b_sig,
    a.visibility AS a_vis, b.visibility AS b_vis, a.deprecated AS a_dep, b.deprecated AS b_dep,
    a.generic_params AS a_gen, b.generic_params AS b_gen, a.trait_bounds AS a_bnd, b.trait_bounds AS b_bnd,
    a.header IS DISTINCT FROM b.header OR a.content IS DISTINCT FROM b.content
      OR a.item_type IS DISTINCT FROM b.item_type AS other
  FROM version_a a FULL OUTER JOIN version_b b ON a.item_path = b.item_path),
marked AS (SELECT *, NOT new AND NOT gone AND coalesce(b_dep, FALSE) AND NOT coalesce(a_dep, FALSE) AS newly_deprecated,
    a_sig IS DISTINCT FROM b_sig AS sig, a_vis IS DISTINCT FROM b_vis AS vis, a_gen IS DISTINCT FROM b_gen AS gen,
    a_bnd IS DISTINCT FROM b_bnd AS bnd FROM both_sides),
changes AS (SELECT path, CASE WHEN gone THEN 'removed' WHEN new THEN 'added' ELSE 'modified' END AS change_type,
    CASE WHEN coalesce(CASE WHEN new THEN b_type ELSE a_type END, '') IN ('function','struct','enum','trait')
      THEN CASE WHEN new THEN b_type ELSE a_type END ELSE 'function' END AS kind,
    CASE WHEN gone THEN CASE WHEN coalesce(a_vis, 'public') = 'public' THEN 'breaking' ELSE 'minor' END
      WHEN new THEN 'minor' WHEN sig OR (vis AND b_vis = 'private') OR gen OR bnd THEN 'breaking'
      WHEN newly_deprecated THEN 'minor' ELSE 'patch' END AS severity,
    CASE WHEN gone THEN 'Item removed from API' WHEN new THEN 'New item added to API' ELSE concat_ws('; ',
      CASE WHEN sig THEN 'Function/type signature changed' END,
      CASE WHEN vis AND b_vis = 'private' THEN 'Changed from public to private'
        WHEN vis THEN 'Visibility changed to ' || coalesce(b_vis, 'unknown') END,
      CASE WHEN newly_deprecated THEN 'Item marked as deprecated' END,
      CASE WHEN gen THEN 'Generic parameters changed' END, CASE WHEN bnd THEN 'Trait bounds changed' END) END AS reasons,
    newly_deprecated, CASE WHEN NOT new THEN coalesce(a_sig, '') END AS signature_before,
    CASE WHEN NOT gone THEN coalesce(b_sig, '') END AS signature_after,
    coalesce(a_vis, 'public') AS vis_before, coalesce(b_vis, 'public') AS vis_after, new, gone, gen, a_gen, b_gen
  FROM marked WHERE new OR gone OR sig OR vis OR gen OR bnd OR other OR a_dep IS DISTINCT FROM b_dep),
listed AS (SELECT *, change_type AS category FROM changes
  UNION ALL SELECT *, 'breaking' FROM changes WHERE severity = 'breaking' AND change_type <> 'added'
  UNION ALL SELECT *, 'deprecated' FROM changes WHERE newly_deprecated)"""


def changes_oracle(final: str) -> str:
    return with_tables("version_a version_b", f"WITH {CHANGES} {final}")


def _compare(spark, sf_dir):
    return diff.compare(derived(spark, sf_dir, "version_a"), derived(spark, sf_dir, "version_b"))


@query(
    "dif1_compare_versions",
    changes_oracle(
        """SELECT path, kind, change_type, severity, reasons, signature_before, signature_after, newly_deprecated FROM changes"""
    ),
)
def dif1_compare_versions(spark, sf_dir):
    out = _compare(spark, sf_dir)
    return out.select(
        "path", "kind", "change_type", "severity", F.array_join("semantic_changes", "; ").alias("reasons"),
        "signature_before", "signature_after", "newly_deprecated",
    )


@query(
    "dif1_by_category",
    changes_oracle(
        """SELECT category, path, severity FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY path) AS rn
        FROM listed WHERE category IN ('breaking', 'deprecated', 'added')) WHERE rn <= 50"""
    ),
)
def dif1_by_category(spark, sf_dir):
    wanted = ["breaking", "deprecated", "added"]
    return diff.by_category(_compare(spark, sf_dir), wanted, 50).select("category", "path", "severity")


@query(
    "dif2_modified_severity",
    changes_oracle(
        """SELECT severity, reasons, count(*) AS n FROM changes WHERE change_type = 'modified' GROUP BY severity, reasons"""
    ),
)
def dif2_modified_severity(spark, sf_dir):
    changed = _compare(spark, sf_dir).where("change_type = 'modified'")
    reasons = F.array_join("semantic_changes", "; ").alias("reasons")
    return changed.groupBy("severity", reasons).agg(F.count("*").alias("n"))


@query(
    "dif3_item_hash",
    with_tables(
        "version_a",
        """SELECT item_path, substr(sha256(item_path || '|' || coalesce(header, '') || '|' || coalesce(content, '') || '|'
          || coalesce(item_type, '') || '|' || coalesce(signature, '') || '|' || coalesce(visibility, '') || '|'
          || coalesce(CAST(deprecated AS VARCHAR), '') || '|' || coalesce(generic_params, '') || '|'
          || coalesce(trait_bounds, '')), 1, 16) AS item_hash FROM version_a""",
    ),
)
def dif3_item_hash(spark, sf_dir):
    return derived(spark, sf_dir, "version_a").select("item_path", diff.item_hash().alias("item_hash"))


@query(
    "dif4_migration_hints",
    changes_oracle(
        """SELECT path AS affected_path, CASE WHEN gone THEN '''' || path || ''' has been removed'
            WHEN contains(reasons, 'signature changed') THEN 'Function signature has changed'
            ELSE 'Item is no longer publicly accessible' END AS issue,
          CASE WHEN NOT gone AND contains(reasons, 'signature changed') THEN signature_after END AS example_after
        FROM (SELECT * FROM changes WHERE severity = 'breaking' AND change_type <> 'added' ORDER BY path LIMIT 40)
        WHERE gone OR contains(reasons, 'signature changed') OR contains(reasons, 'private')"""
    ),
)
def dif4_migration_hints(spark, sf_dir):
    hints = diff.migration_hints(_compare(spark, sf_dir), 40)
    return hints.select("affected_path", "issue", "example_after")


@query(
    "dif6_breaking_reasons",
    changes_oracle(
        """SELECT path, concat_ws('; ',
          CASE WHEN gone AND vis_before = 'public' THEN 'Public item removed from API' END,
          CASE WHEN change_type = 'modified' AND signature_before <> '' AND signature_after <> ''
            AND contains(signature_after, '-> u8') THEN 'Function/method signature incompatibly changed' END,
          CASE WHEN change_type = 'modified' AND vis_before = 'public' AND vis_after = 'private' THEN 'Visibility reduced from public' END,
          CASE WHEN change_type = 'modified' AND gen THEN 'Generic parameters or bounds changed' END) AS reasons FROM changes
        WHERE NOT new"""
    ),
)
def dif6_breaking_reasons(spark, sf_dir):
    told = diff.breaking_reasons(_compare(spark, sf_dir)).where("change_type <> 'added'")
    return told.select("path", F.array_join("reasons", "; ").alias("reasons"))


@query(
    "dif8_change_advice",
    changes_oracle(
        """SELECT path, CASE WHEN gone THEN 'remove_usage' WHEN contains(lower(reasons), 'signature') THEN 'update_calls'
          WHEN contains(lower(reasons), 'private') THEN 'find_alternative' ELSE 'update_types' END AS action,
        CASE WHEN gone THEN 'Remove all usages of ''' || path || '''' WHEN contains(lower(reasons), 'signature')
          THEN 'Update all calls to ''' || path || '''' WHEN contains(lower(reasons), 'private')
          THEN '''' || path || ''' is no longer public' ELSE 'Update type parameters for ''' || path || '''' END AS description
        FROM changes WHERE gone OR (NOT new AND regexp_matches(lower(reasons), 'signature|private|generic'))"""
    ),
)
def dif8_change_advice(spark, sf_dir):
    return diff.change_advice(_compare(spark, sf_dir)).select("path", "action", "description")


MIGRATIONS = """moves AS (SELECT CASE WHEN a.item_path IS NOT NULL THEN a.item_path END AS old_path,
    CASE WHEN b.item_path IS NOT NULL THEN b.item_path END AS new_path,
    CASE WHEN b.item_path IS NULL THEN 'removed' WHEN a.item_path IS NULL THEN 'added' ELSE 'modified' END AS change_type,
    CAST(CASE WHEN a.item_path IS NOT NULL AND b.item_path IS NOT NULL THEN 0.7 ELSE 0.9 END AS DOUBLE) AS confidence
  FROM version_a a FULL OUTER JOIN version_b b ON a.item_path = b.item_path
  WHERE a.item_path IS NULL OR b.item_path IS NULL OR a.signature IS DISTINCT FROM b.signature)"""


@query(
    "dif9_suggest_migrations",
    with_tables(
        "version_a version_b",
        f"""WITH {MIGRATIONS} SELECT old_path, new_path, change_type, confidence, CASE change_type
          WHEN 'removed' THEN 'The item ''' || old_path || ''' has been removed. Check release notes for alternatives or deprecation notices.'
          WHEN 'added' THEN 'New item ''' || new_path || ''' was added. Consider using it if it replaces deprecated functionality.'
          ELSE 'The signature of ''' || old_path || ''' has changed. Review the new API at ''' || new_path || ''' for compatibility.' END AS notes
        FROM moves ORDER BY coalesce(old_path, new_path), change_type LIMIT 100""",
    ),
)
def dif9_suggest_migrations(spark, sf_dir):
    return diff.suggest_migrations(derived(spark, sf_dir, "version_a"), derived(spark, sf_dir, "version_b"))


@query(
    "set2_all_migrations",
    with_tables("version_a version_b", f"WITH {MIGRATIONS} SELECT DISTINCT old_path, new_path, change_type FROM moves"),
)
def set2_all_migrations(spark, sf_dir):
    a, b = derived(spark, sf_dir, "version_a"), derived(spark, sf_dir, "version_b")
    return diff.suggest_migrations(a, b, limit=None).select("old_path", "new_path", "change_type")


@query(
    "dif10_pattern_migrations",
    with_tables(
        "published",
        """WITH ups AS (SELECT DISTINCT crate, version AS to_version, '1.0.0' AS from_version FROM published),
        major AS (SELECT * FROM ups WHERE regexp_full_match(to_version, '\\d+\\.\\d+\\.\\d+') AND split_part(to_version, '.', 1) <> '1')
        SELECT crate, to_version, crate || '::Error' AS old_path, crate || '::error::Error' AS new_path FROM major
        UNION ALL SELECT crate, to_version, crate || '::Result', crate || '::result::Result' FROM major""",
    ),
)
def dif10_pattern_migrations(spark, sf_dir):
    published = derived(spark, sf_dir, "published").select("crate", F.col("version").alias("to_version")).distinct()
    moves = diff.pattern_migrations(published.withColumn("from_version", F.lit("1.0.0")))
    return moves.select("crate", "to_version", "old_path", "new_path")


@query(
    "agg10_diff_summary",
    changes_oracle(
        """SELECT count(*) AS total_changes, count(*) FILTER (WHERE category = 'breaking') AS breaking_changes,
          count(*) FILTER (WHERE category = 'deprecated') AS deprecated_items,
          count(*) FILTER (WHERE category = 'added') AS added_items,
          count(*) FILTER (WHERE category = 'removed') AS removed_items,
          count(*) FILTER (WHERE category = 'modified') AS modified_items FROM listed"""
    ),
)
def agg10_diff_summary(spark, sf_dir):
    return diff.summary(_compare(spark, sf_dir))


@query(
    "join6_version_sets",
    with_tables(
        "version_a version_b",
        """SELECT CASE WHEN b.item_path IS NULL THEN 'removed' WHEN a.item_path IS NULL THEN 'added' ELSE 'common' END AS side,
        count(*) AS n FROM version_a a FULL OUTER JOIN version_b b ON a.item_path = b.item_path GROUP BY 1""",
    ),
)
def join6_version_sets(spark, sf_dir):
    a = derived(spark, sf_dir, "version_a").select("item_path", F.lit(1).alias("a"))
    b = derived(spark, sf_dir, "version_b").select("item_path", F.lit(1).alias("b"))
    both = a.join(b, "item_path", "full_outer")
    side = F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").otherwise("common")
    return both.groupBy(side.alias("side")).agg(F.count("*").alias("n"))


@query(
    "set3_set_algebra",
    with_tables(
        "version_a version_b",
        """SELECT 'only_a' AS side, item_path FROM (SELECT item_path FROM version_a EXCEPT SELECT item_path FROM version_b)
        UNION ALL SELECT 'common', item_path FROM (SELECT item_path FROM version_a INTERSECT SELECT item_path FROM version_b)""",
    ),
)
def set3_set_algebra(spark, sf_dir):
    a = derived(spark, sf_dir, "version_a").select("item_path")
    b = derived(spark, sf_dir, "version_b").select("item_path")
    only, common = a.subtract(b), a.intersect(b)
    label = F.lit("only_a").alias("side")
    return only.select(label, "item_path").union(common.select(F.lit("common"), "item_path"))


# --- trees and graphs


TREE = """tree AS (SELECT id, name, path, parent_id, depth, item_count, 0 AS level FROM modules WHERE parent_id IS NULL
  UNION ALL SELECT m.id, m.name, m.path, m.parent_id, m.depth, m.item_count, t.level + 1 FROM modules m JOIN tree t ON m.parent_id = t.id)"""


@query(
    "grf1_module_tree",
    with_tables("modules", f"WITH {TREE} SELECT * FROM tree", recursive=True),
)
def grf1_module_tree(spark, sf_dir):
    return graph.module_tree(derived(spark, sf_dir, "modules"))


@query(
    "grf2_tree_with_root",
    with_tables(
        "modules",
        """SELECT id, name, path, coalesce(parent_id, -1) AS parent_id, item_count FROM modules
        UNION ALL SELECT -1, 'world', 'world', NULL, CAST(sum(item_count) AS BIGINT) FROM modules WHERE parent_id IS NULL""",
    ),
)
def grf2_tree_with_root(spark, sf_dir):
    out = graph.tree_with_root(derived(spark, sf_dir, "modules"), "world")
    return out.select("id", "name", "path", "parent_id", "item_count")


@query(
    "join10_module_parents",
    with_tables(
        "modules",
        """SELECT m.id AS id, p.id AS parent_id FROM modules m LEFT JOIN modules p
        ON p.path = substr(m.path, 1, length(m.path) - length(split_part(m.path, '::', -1)) - 2)""",
    ),
)
def join10_module_parents(spark, sf_dir):
    return graph.with_parent_paths(derived(spark, sf_dir, "modules")).select("id", "parent_id")


@query(
    "grf3_dependency_graph",
    with_tables(
        "reexports items",
        """WITH links AS (SELECT DISTINCT alias_path AS s, actual_path AS t FROM reexports WHERE crate = 'en'),
        walk AS (SELECT s, t, 1 AS depth, [s] AS used FROM links
          UNION SELECT l.s, l.t, w.depth + 1, list_append(w.used, l.s) FROM links l JOIN walk w ON l.s = w.t
          WHERE w.depth < 3 AND NOT list_contains(w.used, l.t))
        SELECT DISTINCT s AS source, t AS target, split_part(t, '::', 1) || '-1.0' AS target_version, depth FROM walk
        WHERE s IN (SELECT item_path FROM items) AND t IN (SELECT item_path FROM items)""",
        recursive=True,
    ),
)
def grf3_dependency_graph(spark, sf_dir):
    items = derived(spark, sf_dir, "items")
    crates = items.select("crate", F.concat("crate", F.lit("-1.0")).alias("version")).distinct()
    return graph.dependency_graph(derived(spark, sf_dir, "reexports"), items, crates, "en")


def _edges(spark, sf_dir, link_type: str):
    edges = derived(spark, sf_dir, "edge_numbers").where(f"link_type = '{link_type}'")
    return edges.select(F.col("src").cast("string").alias("source"), F.col("dst").cast("string").alias("target"))


@query(
    "grf4_cyclic_core",
    with_tables(
        "edge_numbers",
        """WITH e AS (SELECT DISTINCT src, dst FROM edge_numbers WHERE link_type = 'reexport'),
        reach AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON e.src = r.dst),
        looped AS (SELECT src AS n FROM reach WHERE src = dst)
        SELECT CAST(e.src AS VARCHAR) AS source, CAST(e.dst AS VARCHAR) AS target FROM e
        WHERE (e.src IN (SELECT n FROM looped) OR e.src IN (SELECT r.dst FROM reach r WHERE r.src IN (SELECT n FROM looped)))
          AND (e.dst IN (SELECT n FROM looped) OR e.dst IN (SELECT r.src FROM reach r WHERE r.dst IN (SELECT n FROM looped)))""",
        recursive=True,
    ),
)
def grf4_cyclic_core(spark, sf_dir):
    return graph.cyclic_core(_edges(spark, sf_dir, "reexport"))


@query(
    "grf4_has_cycles",
    with_tables(
        "edge_numbers",
        """WITH e AS (SELECT DISTINCT src, dst FROM edge_numbers),
        reach AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON e.src = r.dst)
        SELECT count(*) > 0 AS has_cycles FROM reach WHERE src = dst""",
        recursive=True,
    ),
)
def grf4_has_cycles(spark, sf_dir):
    edges = derived(spark, sf_dir, "edge_numbers")
    return graph.has_cycles(
        edges.select(F.col("src").cast("string").alias("source"), F.col("dst").cast("string").alias("target"))
    )


@query(
    "grf4_components",
    with_tables(
        "edge_numbers",
        """WITH e AS (SELECT DISTINCT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst FROM edge_numbers),
        reach AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON e.src = r.dst)
        SELECT a.src AS node, min(a.dst) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src""",
        recursive=True,
    ),
)
def grf4_components(spark, sf_dir):
    edges = derived(spark, sf_dir, "edge_numbers")
    return graph.strong_components(
        edges.select(F.col("src").cast("string").alias("source"), F.col("dst").cast("string").alias("target"))
    )


@query(
    "grf5_hierarchy",
    with_tables(
        "edge_numbers",
        """WITH e AS (SELECT DISTINCT CAST(src AS VARCHAR) AS s, CAST(dst AS VARCHAR) AS t FROM edge_numbers),
        d1 AS (SELECT s, t FROM e WHERE s = '40'),
        n1 AS (SELECT DISTINCT t AS n FROM d1 WHERE t <> '40'),
        d2 AS (SELECT s, t FROM e WHERE s IN (SELECT n FROM n1)),
        n2 AS (SELECT DISTINCT t AS n FROM d2 WHERE t <> '40' AND t NOT IN (SELECT n FROM n1)),
        d3 AS (SELECT s, t FROM e WHERE s IN (SELECT n FROM n2)),
        n3 AS (SELECT DISTINCT t AS n FROM d3 WHERE t <> '40' AND t NOT IN (SELECT n FROM n1) AND t NOT IN (SELECT n FROM n2)),
        every AS (SELECT *, 1 AS depth, t IN (SELECT n FROM n1) AS fresh FROM d1
          UNION ALL SELECT *, 2, t IN (SELECT n FROM n2) FROM d2 UNION ALL SELECT *, 3, t IN (SELECT n FROM n3) FROM d3)
        SELECT s AS source, t AS target, depth, fresh AND s = min(s) OVER (PARTITION BY depth, t) AS opened FROM every""",
    ),
)
def grf5_hierarchy(spark, sf_dir):
    edges = derived(spark, sf_dir, "edge_numbers")
    named = edges.select(F.col("src").cast("string").alias("source"), F.col("dst").cast("string").alias("target"))
    return graph.hierarchy(named, "40")


@query(
    "grf6_trace_reexports",
    with_tables(
        "reexports",
        """WITH f AS (SELECT crate, alias_path AS a, min(actual_path) AS b FROM reexports WHERE link_type = 'reexport'
          GROUP BY crate, alias_path),
        walk AS (SELECT crate, a AS start, b AS cur, [a] AS seen, 1 AS hops, a = b AS looped FROM f
          UNION ALL SELECT w.crate, w.start, f.b, list_append(w.seen, w.cur), w.hops + 1,
            list_contains(list_append(w.seen, w.cur), f.b)
          FROM walk w JOIN f ON f.crate = w.crate AND f.a = w.cur WHERE w.hops < 10 AND NOT w.looped),
        last AS (SELECT crate, start, arg_max(cur, hops) AS cur, max(hops) AS hops, bool_or(looped) AS looped,
            arg_max(list_append(seen, cur), hops) AS nodes FROM walk GROUP BY crate, start)
        SELECT crate, start AS alias_path, array_to_string(list_transform(range(1, hops + 1),
            lambda i: crate || '::' || nodes[i] || ' -> ' || crate || '::' || nodes[i + 1]), '; ') AS chain,
          CASE WHEN looped OR hops >= 10 THEN '' ELSE cur END AS original_source FROM last""",
        recursive=True,
    ),
)
def grf6_trace_reexports(spark, sf_dir):
    out = graph.trace_reexports(derived(spark, sf_dir, "reexports"))
    return out.select("crate", "alias_path", F.array_join("chain", "; ").alias("chain"), "original_source")
