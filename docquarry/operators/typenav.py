"""Navigation of the type system: implementations, methods, associated items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry import texts as T


def query_rows(rows: DataFrame, order: list[str], **equal) -> DataFrame:
    """Rows with given column values; ``None`` means any."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows.orderBy(*order)


def trait_implementors(impls: DataFrame, crate: str, trait_path: str) -> DataFrame:
    """Types that implement a trait; the bare name is tried only when the path has none.

    The bare name is let through by a scalar count of exact hits.
    """
    bare = trait_path.split("::")[-1]
    names = [trait_path] if bare == trait_path else [trait_path, bare]
    found = impls.where((F.col("crate") == crate) & F.col("trait_path").isin(names))
    if len(names) > 1:
        exact = found.where(F.col("trait_path") == trait_path)
        hits = exact.agg(F.count("*")).scalar()
        found = found.where((F.col("trait_path") == trait_path) | (hits == 0))
    return found.orderBy("is_blanket", "impl_type_path").select(
        F.col("impl_type_path").alias("type_path"),
        "generic_params",
        "where_clauses",
        "is_blanket",
        "impl_signature",
        F.col("stability_level").alias("stability"),
    )


def type_traits(impls: DataFrame, crate: str, type_path: str) -> DataFrame:
    """Traits a type implements."""
    found = query_rows(impls, ["trait_path"], crate=crate, impl_type_path=type_path)
    return found.select(
        "trait_path", "generic_params", "where_clauses", "is_negative", "impl_signature",
        F.col("stability_level").alias("stability"),
    )


def resolve_method(methods: DataFrame, crate: str, type_path: str, name: str) -> DataFrame:
    """Candidates for a method call, inherent ones first."""
    return query_rows(
        methods, ["method_kind", "full_signature"], crate=crate, parent_type_path=type_path, method_name=name
    )


def method_status(methods: DataFrame) -> DataFrame:
    """Per type and method: how many candidates, and hints to tell them apart."""
    kind = F.col("method_kind")

    def listed(values: Column) -> Column:
        return F.array_join(F.sort_array(values), ", ")

    scope = [c for c in ("crate", "version") if c in methods.columns]  # releases are told apart
    stats = methods.groupBy(*scope, "parent_type_path", "method_name").agg(
        F.count("*").alias("candidates"),
        F.count_if(kind == "inherent").alias("inherent"),
        F.count_if(kind == "trait").alias("from_traits"),
        F.collect_set(F.when(kind == "trait", F.col("trait_source"))).alias("sources"),
        F.collect_set("receiver_type").alias("receivers"),
        F.count_if(F.col("is_const")).alias("const"),
    )
    many = F.col("candidates") > 1
    mixed = many & (F.col("inherent") > 0) & (F.col("from_traits") > 0)
    hints = F.array_compact(
        F.array(
            F.when(mixed, T.MANY_KINDS),
            F.when(mixed, T.INHERENT_FIRST),
            F.when(
                mixed & (F.size("sources") > 0),
                T.fill(T.FROM_TRAITS, sources=listed(F.col("sources"))),
            ),
            F.when(
                many & (F.size("receivers") > 1),
                T.fill(T.RECEIVERS, receivers=listed(F.col("receivers"))),
            ),
            F.when(
                many & (F.col("const") > 0) & (F.col("const") < F.col("candidates")),
                T.SOME_CONST,
            ),
        )
    )
    status = F.when(F.col("candidates") == 1, "unique").otherwise("ambiguous")
    return stats.select(
        *scope,
        "parent_type_path",
        "method_name",
        "candidates",
        status.alias("resolution_status"),
        hints.alias("disambiguation_hints"),
    )


def associated_items(rows: DataFrame, crate: str, container: str, kind: str | None = None) -> DataFrame:
    """Associated items of one container, by kind and name."""
    return query_rows(
        rows, ["item_kind", "item_name"], crate=crate, container_path=container, item_kind=kind
    )


def grouped_by_kind(rows: DataFrame, kind: str, name: str) -> DataFrame:
    """One row per kind with the sorted names.

    Meant for the items of one container, which a source file bounds.
    """
    return rows.groupBy(kind).agg(
        F.count("*").alias("total"), F.sort_array(F.collect_list(name)).alias("names")
    )


def generic_constraints(rows: DataFrame, crate: str, item_path: str) -> DataFrame:
    """Generic parameters of an item with the group each belongs to."""
    found = query_rows(rows, ["position", "param_name"], crate=crate, item_path=item_path)
    group = F.concat(F.col("param_kind"), F.lit("_params"))
    return found.withColumn("param_group", group)


def methods_with_defaults(
    own: DataFrame, defaults: DataFrame, impls: DataFrame, scope: list[str] | None = None
) -> DataFrame:
    """Methods of implementations plus the trait defaults they do not override.

    ``own`` has ``impl_type_path``, ``trait_path``, ``method_name``; ``defaults``
    has ``trait_path``, ``method_name``; ``impls`` pairs types with traits.
    Columns in ``scope`` (such as crate and version) must agree throughout.
    """
    scope = scope or []
    keys = [*scope, "impl_type_path", "trait_path", "method_name"]
    pairs = impls.select(*scope, "impl_type_path", "trait_path").distinct()
    inherited = pairs.join(defaults, [*scope, "trait_path"]).select(*keys).join(own.select(*keys), keys, "left_anti")
    return own.select(*keys, F.lit(False).alias("is_default")).unionByName(
        inherited.select(*keys, F.lit(True).alias("is_default"))
    )


def supertraits(definitions: DataFrame, levels: int = 3) -> DataFrame:
    """Supertraits of every trait up to ``levels`` steps, each at its nearest step.

    ``definitions`` has ``trait_path`` and ``supertrait``.
    """
    direct = definitions.select("trait_path", "supertrait").distinct()
    out = direct.withColumn("level", F.lit(1))
    last = out
    for level in range(2, levels + 1):
        further = direct.select(F.col("trait_path").alias("supertrait"), F.col("supertrait").alias("_next"))
        last = (
            last.join(further, "supertrait")
            .select("trait_path", F.col("_next").alias("supertrait"))
            .distinct()
            .withColumn("level", F.lit(level))
        )
        out = out.unionByName(last)
    return out.groupBy("trait_path", "supertrait").agg(F.min("level").alias("level"))
