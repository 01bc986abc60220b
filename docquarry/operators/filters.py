"""Row filters.  A parameter left at ``None`` means no filter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry import constants as C
from docquarry.functions import paths


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def item_condition(
    *,
    item_type: str | None = None,
    crate: str | None = None,
    module: str | None = None,
    has_examples: bool | None = None,
    min_doc_length: int | None = None,
    visibility: str | None = None,
    deprecated: bool | None = None,
    stability: str | None = None,
    mode: str = "vector",
    columns: list[str] | None = None,
) -> Column:
    """One condition from the optional search filters.

    With the table's ``columns`` given, a stored ``doc_length`` is used instead of
    measuring the text, which then need not be read.

    ``mode`` picks between two documented readings.  In ``vector`` mode a module
    filter matches the module and everything below it, and ``has_examples=False``
    does nothing.  In ``regex`` mode the module may sit anywhere in the path and
    does not match itself, and ``has_examples=False`` asks for items without any.
    """
    path = F.col("item_path")
    out = []
    if item_type is not None:
        out.append(F.col("item_type") == item_type)
    if crate is not None:
        out.append(paths.in_crate(path, crate))
    if module is not None:
        if mode == "vector":
            if crate is None:
                raise ValueError("a module filter needs its crate")
            out.append(paths.in_module(path, f"{crate}::{module}"))
        else:
            out.append(paths.contains_module(path, module))
    if has_examples is not None:
        if has_examples:
            out.append(F.col("examples").isNotNull())
        elif mode == "regex":
            out.append(F.col("examples").isNull())
    if min_doc_length is not None:
        stored = "doc_length" in (columns or [])
        out.append((F.col("doc_length") if stored else F.length("content")) >= min_doc_length)
    if visibility is not None:
        out.append(F.col("visibility") == visibility)
    if deprecated is not None:
        out.append(F.col("deprecated") == deprecated)
    if stability is not None and stability != "all":
        out.append(F.col("stability_level") == stability)
    return _all(out)


def filter_items(items: DataFrame, **filters) -> DataFrame:
    return items.where(item_condition(columns=items.columns, **filters))


def module_items(items: DataFrame, module: str) -> DataFrame:
    """Items of a module and below, by path."""
    return items.where(paths.in_module(F.col("item_path"), module)).orderBy("item_path")


def signatures_of(items: DataFrame, wanted: list[str]) -> DataFrame:
    """Signatures of listed items that have one."""
    return items.where(F.col("item_path").isin(wanted) & F.col("signature").isNotNull()).select(
        "item_path", "signature"
    )


def items_by_safety(
    items: DataFrame, safe: bool = True, limit: int = 100, reasons: bool = False
) -> DataFrame:
    """The first items by path that are, or are not, safe to use."""
    cols = ["item_path", "item_type", "signature"]
    if reasons:
        items = items.withColumn(
            "documentation_excerpt",
            F.when(F.col("safety_info").isNotNull(), F.substring("content", 1, 200)),
        )
        cols += ["safety_info", "documentation_excerpt"]
    return items.where(F.col("is_safe") == safe).orderBy("item_path").select(*cols).limit(limit)


def pattern_frequencies(items: DataFrame, patterns: list[str]) -> DataFrame:
    """How many items mention each pattern, ignoring case, from one scan.

    Case is ignored and ``%``/``_`` act as wildcards, as in a LIKE search.
    """
    def mentions(pattern: str) -> Column:
        like = f"%{pattern}%"
        hits = [F.col(c).ilike(like) for c in ("examples", "content", "signature")]
        return F.coalesce(hits[0], F.lit(False)) | F.coalesce(hits[1], F.lit(False)) | F.coalesce(
            hits[2], F.lit(False)
        )

    counts = items.agg(*[F.count_if(mentions(p)).alias(f"c{i}") for i, p in enumerate(patterns)])
    pairs = F.array(
        *[F.struct(F.lit(p).alias("pattern"), F.col(f"c{i}").alias("frequency")) for i, p in enumerate(patterns)]
    )
    return counts.select(F.inline(pairs))


def visible_modules(modules: DataFrame) -> DataFrame:
    """Modules worth listing: shallow, not empty, not generated and not private.

    When fewer than five survive out of more than ten candidates, the listing
    falls back to the twenty shallowest or fullest modules.
    """
    lowered = F.lower("path")

    def clear_of(fragments: list[str]) -> Column:
        return _all([~lowered.contains(f.lower()) for f in fragments])

    listed = clear_of(C.NOISE_FRAGMENTS)
    candidate = (
        (F.col("depth") <= 3) & ((F.col("item_count") >= 2) | (F.col("depth") == 0)) & listed
    )
    kept = candidate & clear_of(C.GENERATED_FRAGMENTS) & ~(
        F.col("name").startswith("_") & (F.col("depth") > 0)
    )
    spare = ((F.col("depth") <= 1) | (F.col("item_count") >= 5)) & clear_of(C.NOISE_FRAGMENTS[:2])

    counts = modules.agg(F.count_if(kept).alias("kept"), F.count_if(candidate).alias("candidates"))
    row = counts.head()  # one row of two numbers
    cols = ["name", "path", "parent_id", "depth", "item_count"]
    if row["kept"] < 5 and row["candidates"] > 10:
        order = [F.col("depth"), F.col("item_count").desc(), F.col("path")]
        return modules.where(spare).orderBy(*order).select(*cols).limit(20)
    return modules.where(kept).select(*cols).orderBy("depth", "path")


def root_modules(modules: DataFrame) -> DataFrame:
    return modules.where(F.col("parent_id").isNull()).orderBy("name", "path")


def module_by_path(modules: DataFrame, path: str) -> DataFrame:
    return modules.where(F.col("path") == path).limit(1)


def item_document(items: DataFrame, path: str) -> DataFrame:
    return items.where(F.col("item_path") == path).select("item_path", "header", "content").limit(1)


def without_dependencies(items: DataFrame, dependencies: DataFrame, crate: str) -> DataFrame:
    """Drop items that are known dependencies or live under a common foreign root.

    ``dependencies`` has one column ``path``.  The anti joins leave the choice
    of broadcasting to the planner, which looks at the real size.
    """
    known = dependencies.select(F.col("path").alias("_dep")).distinct()
    path = F.coalesce(F.col("item_path"), F.lit(""))
    root = paths.crate_of(path)
    foreign = (root != crate) & root.isin(C.COMMON_DEPENDENCIES)
    kept = items.where(~foreign).join(known, F.col("item_path") == F.col("_dep"), "left_anti")
    if "module_path" in items.columns:
        kept = kept.join(known, F.col("module_path") == F.col("_dep"), "left_anti")
    return kept


def dependency_paths(index: DataFrame, crate: str) -> DataFrame:
    """Foreign paths mentioned by a parsed index.

    Takes columns ``crate_id``, ``path`` (array), ``name`` and ``is_import``.
    """
    foreign = index.where(
        (F.col("crate_id") != 0) & (F.size("path") > 0) & (F.get("path", F.lit(0)) != crate)
    ).select(F.array_join("path", "::").alias("path"))
    imported = index.where(
        F.col("is_import") & (F.coalesce(F.col("name"), F.lit("")) != "") & ~F.col("name").startswith(crate)
    ).select(F.col("name").alias("path"))
    return foreign.union(imported).distinct()
