"""Finding items by an inexact path: aliases, re-exports, similar names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry import constants as C
from docquarry.functions import fuzzy


def static_alias(crate: Column, path: Column) -> Column:
    """Fixed alias of a path, tried with the crate in front and then as it is."""
    table = F.create_map(*[F.lit(x) for pair in C.PATH_ALIASES.items() for x in pair])
    return F.coalesce(
        F.try_element_at(table, F.concat_ws("::", crate, path)), F.try_element_at(table, path)
    )


def reexport_map(reexports: DataFrame, include_crossrefs: bool = False) -> DataFrame:
    """``crate``, ``alias``, ``actual_path`` with every alias also stored without its crate.

    Where several edges share an alias the last by path order stands for it.
    """
    edges = reexports if include_crossrefs else reexports.where(F.col("link_type") == "reexport")
    prefix = F.concat(F.col("crate"), F.lit("::"))
    short = F.when(
        F.startswith(F.col("alias_path"), prefix),
        F.expr("substring(alias_path, length(crate) + 3)"),
    )
    keys = F.explode(F.array_compact(F.array("alias_path", short)))
    keyed = edges.select("crate", keys.alias("alias"), "actual_path")
    return keyed.groupBy("crate", "alias").agg(F.max("actual_path").alias("actual_path"))


def resolve_aliases(requests: DataFrame, reexports: DataFrame | None = None) -> DataFrame:
    """Resolve a table of ``crate``, ``path`` requests; adds ``resolved_path``.

    A discovered edge with the crate in front wins over one without, then the
    fixed aliases in the same order; anything else stays as it is.
    """
    known = static_alias(F.col("crate"), F.col("path"))
    if reexports is None:
        found = F.coalesce(known, F.col("path"))
        return requests.withColumn(
            "resolved_path", F.when(F.col("path") == "crate", F.col("path")).otherwise(found)
        )
    mapping = reexport_map(reexports, include_crossrefs=True)
    full = mapping.select("crate", F.col("alias").alias("_full"), F.col("actual_path").alias("_by_full"))
    bare = mapping.select("crate", F.col("alias").alias("_bare"), F.col("actual_path").alias("_by_bare"))
    out = (
        requests.withColumn("_full", F.concat_ws("::", "crate", "path"))
        .withColumn("_bare", F.col("path"))
        .join(full, ["crate", "_full"], "left")
        .join(bare, ["crate", "_bare"], "left")
    )
    found = F.coalesce("_by_full", "_by_bare", known, F.col("path"))
    return out.withColumn(
        "resolved_path", F.when(F.col("path") == "crate", F.col("path")).otherwise(found)
    ).select(*requests.columns, "resolved_path")


def fuzzy_suggestions(
    items: DataFrame, query: str, limit: int = 3, threshold: float = 0.6
) -> DataFrame:
    """Paths most like ``query``, best first, over all distinct paths.

    Rows without the query's first characters cannot score and are dropped in
    the JVM, before any text reaches Python.
    """
    threshold = min(threshold, fuzzy.adaptive_threshold(query))
    prepared = fuzzy.lookup_form(query)
    candidates = items.select("item_path").where(F.col("item_path").isNotNull()).distinct()
    if len(prepared) >= C.FUZZY_PREFIX and prepared.isascii():
        # punctuation becomes a blank before matching, so a blank may be any of it
        head = prepared[: C.FUZZY_PREFIX]
        shape = "".join("[^A-Za-z0-9_]" if ch == " " else ch for ch in head)
        plain = ~F.col("item_path").rlike(r"[^\x00-\x7F]")
        candidates = candidates.where(~plain | F.lower("item_path").rlike(shape))
    needed = threshold - C.FUZZY_SAME_TAIL_BONUS
    # short texts, dear scores: the paths left are dealt out evenly
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scored = candidates.repartition(tasks).withColumn(
        "base", fuzzy.path_score_column(prepared, F.col("item_path"), threshold, needed)
    )
    total = F.least(F.lit(1.0), F.col("base") + fuzzy.tail_bonus(query, F.col("item_path")))
    kept = scored.where(F.col("base") > 0).withColumn("score", total)
    return (
        kept.where(F.col("score") >= threshold)
        .orderBy(F.desc("score"), "item_path")
        .select("item_path", "score")
        .limit(limit)
    )


def import_alternatives(
    items: DataFrame, reexports: DataFrame, crate: str, path: str, limit: int = 5
) -> DataFrame:
    """Places an import could come from, surest first."""
    tail = path.split("::")[-1]
    item, alias = F.col("item_path"), F.col("alias_path")
    general = f"%{tail}%"
    confidence = (
        F.when(item == path, 1.0)
        .when(item.ilike(f"{crate}::{tail}"), 0.8)
        .when(item.ilike(f"%::{tail}"), 0.6)
        .otherwise(0.4)
    )
    # either side of the OR is filtered before its join, so the join sees matches
    # only, never all links of a much re-exported item
    links = reexports.select("alias_path", F.col("actual_path").alias("item_path"))
    paths = items.select("item_path")
    by_item = paths.where(item.ilike(general)).join(links.where(item.ilike(general)), "item_path", "left")
    by_alias = paths.where(~item.ilike(general)).join(links.where(alias.ilike(general)), "item_path")
    hits = by_item.unionByName(by_alias)
    return (
        hits.select(
            "item_path",
            "alias_path",
            confidence.alias("confidence"),
            F.when(alias.isNull(), "direct").otherwise("reexport").alias("link_type"),
        )
        .distinct()
        .orderBy(F.desc("confidence"), "item_path", F.asc_nulls_first("alias_path"))
        .limit(limit)
    )


def resolve_import(
    items: DataFrame, reexports: DataFrame, crate: str, path: str, alternatives: bool = False
) -> DataFrame:
    """The resolved path (confidence 0.9, or 0.5 unresolved) and, on request, others."""
    spark = items.sparkSession
    request = spark.createDataFrame([(crate, path)], "crate string, path string")
    edges = reexports.where(F.col("crate") == crate)
    main = resolve_aliases(request, edges).select(
        F.col("resolved_path").alias("item_path"),
        F.lit(None).cast("string").alias("alias_path"),
        F.when(F.col("resolved_path") != F.col("path"), 0.9).otherwise(0.5).alias("confidence"),
        F.lit("resolved").alias("link_type"),
    )
    if not alternatives:
        return main
    others = import_alternatives(items, edges, crate, path)
    return main.unionByName(others.join(main.select("item_path"), "item_path", "left_anti"))


def item_intelligence(items: DataFrame, crate: str, path: str) -> DataFrame:
    """One item's code facts, found under the path with or without its crate.

    Falls back to any item with the same last segment.
    """
    prefix = f"{crate}::"
    first, second = (path, path[len(prefix) :]) if path.startswith(prefix) else (prefix + path, path)
    tail = path.split("::")[-1]
    column = F.col("item_path")
    priority = (
        F.when(column == first, 1).when(column == second, 2).when(column.ilike(f"%::{tail}"), 3)
    )
    hits = items.withColumn("_priority", priority).where(F.col("_priority").isNotNull())
    best = hits.orderBy("_priority", "item_path").limit(1)
    return best.select(
        "item_path",
        F.lit(path).alias("requested_path"),
        F.col("signature").alias("enhanced_signature"),
        "safety_info",
        "error_types",
        "feature_requirements",
        "is_safe",
        "visibility",
        F.coalesce("deprecated", F.lit(False)).alias("deprecated"),
        F.substring("content", 1, 500).alias("documentation"),
    )


def item_documentation(
    items: DataFrame, reexports: DataFrame | None, crate: str, path: str
) -> DataFrame:
    """An item by its resolved path, its own path or its last segment, in that order."""
    request = items.sparkSession.createDataFrame([(crate, path)], "crate string, path string")
    edges = None if reexports is None else reexports.where(F.col("crate") == crate)
    target = resolve_aliases(request, edges).head()["resolved_path"]  # one row
    column = F.col("item_path")
    priority = (
        F.when(column == target, 1)
        .when(column == path, 2)
        .when(column.ilike(f"%::{path.split('::')[-1]}"), 3)
    )
    hits = items.withColumn("_priority", priority).where(F.col("_priority").isNotNull())
    return hits.orderBy("_priority", "item_path").limit(1).select(
        "item_path",
        F.col("content").alias("documentation"),
        F.lit(crate in C.STDLIB_CRATES).alias("is_stdlib"),
    )


def siblings(items: DataFrame, path: str, limit: int = 10) -> DataFrame:
    """Other items with the same parent."""
    parent = items.where(F.col("item_path") == path).select("parent_id").limit(1)
    return (
        items.where(F.col("item_path") != path)
        .join(parent, "parent_id", "left_semi")
        .orderBy("item_path")
        .select("item_path", "signature", "item_type")
        .limit(limit)
    )


def cross_references(reexports: DataFrame, path: str, direction: str = "both") -> DataFrame:
    """Links from and to an item."""
    links = reexports.where(F.col("link_type") == "crossref")
    out = links.where(F.col("alias_path") == path).select(
        F.lit("from").alias("direction"), F.col("actual_path").alias("other"), "link_text", "confidence_score"
    )
    into = links.where(F.col("actual_path") == path).select(
        F.lit("to").alias("direction"), F.col("alias_path").alias("other"), "link_text", "confidence_score"
    )
    return {"from": out, "to": into, "both": out.unionByName(into)}[direction]


def first_edges(reexports: DataFrame, link_type: str = "reexport") -> DataFrame:
    """One outgoing edge per alias: the first by target."""
    return (
        reexports.where(F.col("link_type") == link_type)
        .groupBy("crate", "alias_path")
        .agg(F.min("actual_path").alias("actual_path"))
    )
