"""The documented tools as methods over one set of entity tables.

Every method returns a DataFrame and does no work before an action, apart from
parameter checks and point lookups.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry import constants as C
from docquarry import params, schemas
from docquarry.functions import semver, text
from docquarry.operators import diff, filters, graph, lookup, metrics, patterns, search, typenav, versions, workflow
from docquarry.sources import cargo, embedding, store

TABLES = {
    "crates": schemas.CRATES,
    "modules": schemas.MODULES,
    "items": schemas.ITEMS,
    "reexports": schemas.REEXPORTS,
    "examples": schemas.EXAMPLE_ITEMS,
    "impls": schemas.TRAIT_IMPLS,
    "methods": schemas.METHODS,
    "associated": schemas.ASSOCIATED_ITEMS,
    "constraints": schemas.GENERIC_CONSTRAINTS,
    "status": schemas.INGESTION_STATUS,
}


@dataclass
class Library:
    """Entity tables plus the model that turns a query into a vector."""

    crates: DataFrame
    modules: DataFrame
    items: DataFrame
    reexports: DataFrame
    examples: DataFrame
    impls: DataFrame
    methods: DataFrame
    associated: DataFrame
    constraints: DataFrame
    status: DataFrame
    model: Callable | None = None

    @classmethod
    def open(cls, spark: SparkSession, root: str, model: Callable | None = None) -> Library:
        """Tables stored under ``root``, one folder each."""
        return cls(**{n: store.read_table(spark, f"{root}/{n}", s) for n, s in TABLES.items()}, model=model)

    def save(self, root: str) -> None:
        for field in fields(self):
            if field.name != "model":
                store.write_table(getattr(self, field.name), f"{root}/{field.name}")

    def latest_version(self, crate: str) -> str | None:
        """The highest stored version of a crate; one row is looked up."""
        stored = self.crates.where(F.col("crate") == params.crate_name(crate))
        key = semver.sort_key(F.col("version"))
        return stored.agg(F.max_by("version", key).alias("version")).head()["version"]

    def _release(self, table: DataFrame, crate: str, version: str | None = None) -> DataFrame:
        """Rows of one release; without a version, of the latest one.

        Crate and version are partition columns, so nothing else is read.
        """
        rows = table.where(F.col("crate") == params.crate_name(crate))
        if "version" not in table.columns:
            return rows
        wanted = params.version(version)
        if wanted in (None, "latest"):
            wanted = self.latest_version(crate)
        return rows if wanted is None else rows.where(F.col("version") == wanted)

    def _vector(self, query: str | Sequence[float]) -> list[float]:
        if not isinstance(query, str):
            return [float(x) for x in query]
        model = self.model or embedding.hashing_model()
        return [float(x) for x in model([params.search_text(query)])[0]]

    # --- search

    def search_items(
        self,
        crate: str | list[str],
        query: str | Sequence[float],
        k: int = 5,
        version: str | None = None,
        mode: str = "vector",
        pattern: str | None = None,
        tolerance: float = 0.7,
        **given,
    ) -> DataFrame:
        """Items that answer a query, with a snippet of each.

        Several crates are searched together and fused.  ``mode`` is ``vector``,
        ``hybrid`` (the same), ``fuzzy`` (names like the query) or ``regex``.
        """
        k = params.to_int(k, "k", *C.K_BOUNDS_TOOL)
        crates = params.crate_list(crate)
        if mode not in C.SEARCH_MODES:
            raise ValueError(f"mode must be one of {C.SEARCH_MODES}")
        wanted = params.SearchFilters(**given).as_dict()
        if len(crates) > 1:
            items = self._release(self.items, crates[0])
            for other in crates[1:]:
                items = items.unionByName(self._release(self.items, other))
            found = search.cross_crate_search(items, self._vector(query), crates, k, **wanted)
        else:
            items = self._release(self.items, crates[0], version)
            if wanted["module"] and wanted["crate"] is None:
                wanted["crate"] = crates[0]
            if mode == "regex" and pattern:
                found = search.regex_search(items, pattern, k, **wanted)
            elif mode == "fuzzy":
                names = lookup.fuzzy_suggestions(items, query, k, tolerance)
                found = items.join(F.broadcast(names), "item_path").orderBy(F.desc("score"), "item_path")  # k rows
            else:
                found = search.search(items, self._vector(query), k, **wanted)
        return found.select("item_path", "header", "score", text.snippet(F.col("content")).alias("snippet"))

    def see_also(self, crate: str, query, found: DataFrame) -> DataFrame:
        return search.see_also(self._release(self.items, crate), self._vector(query), found, k=10)

    def search_examples(
        self, crate: str, query, k: int = 5, language: str | None = None, version: str | None = None
    ) -> DataFrame:
        rows = self._release(self.examples, crate, version).withColumn("id", F.col("item_id"))
        return search.search_examples(rows, self._vector(query), k, language=language)

    # --- reading

    def get_crate_summary(self, crate: str, version: str | None = None) -> DataFrame:
        return filters.visible_modules(self._release(self.modules, crate, version))

    def get_item_doc(self, crate: str, path: str, version: str | None = None) -> DataFrame:
        """The item, or no row; ``fuzzy_suggestions`` then offers other names."""
        return lookup.item_documentation(self._release(self.items, crate, version), self.reexports, crate, path)

    def fuzzy_suggestions(self, crate: str, path: str, limit: int = 3) -> DataFrame:
        return lookup.fuzzy_suggestions(self._release(self.items, crate), path, limit)

    def get_module_tree(self, crate: str, version: str | None = None) -> DataFrame:
        tree = graph.module_tree(self._release(self.modules, crate, version))
        return graph.tree_with_root(tree, crate)

    def get_documentation_detail(
        self, crate: str, path: str, level: str = "summary", version: str | None = None
    ) -> DataFrame:
        return workflow.documentation(self._release(self.items, crate, version), path, level)

    def list_versions(self, published: DataFrame, crate: str) -> DataFrame:
        return versions.list_versions(self._release(published, crate))

    # --- types

    def get_trait_implementors(self, crate: str, trait_path: str, version: str | None = None) -> DataFrame:
        return typenav.trait_implementors(self._release(self.impls, crate, version), crate, trait_path)

    def get_type_traits(self, crate: str, type_path: str, version: str | None = None) -> DataFrame:
        return typenav.type_traits(self._release(self.impls, crate, version), crate, type_path)

    def resolve_method(self, crate: str, type_path: str, name: str, version: str | None = None) -> DataFrame:
        return typenav.resolve_method(self._release(self.methods, crate, version), crate, type_path, name)

    def method_status(self, crate: str, type_path: str, name: str, version: str | None = None) -> DataFrame:
        return typenav.method_status(self.resolve_method(crate, type_path, name, version))

    def get_associated_items(
        self, crate: str, container: str, kind: str | None = None, version: str | None = None
    ) -> DataFrame:
        return typenav.associated_items(self._release(self.associated, crate, version), crate, container, kind)

    def get_generic_constraints(self, crate: str, path: str, version: str | None = None) -> DataFrame:
        return typenav.generic_constraints(self._release(self.constraints, crate, version), crate, path)

    def get_code_intelligence(self, crate: str, path: str) -> DataFrame:
        return lookup.item_intelligence(self._release(self.items, crate), crate, path)

    def get_error_types(self, crate: str, pattern: str | None = None) -> DataFrame:
        return patterns.error_catalog(self._release(self.items, crate), pattern)

    def get_unsafe_items(self, crate: str, reasons: bool = False) -> DataFrame:
        return filters.items_by_safety(self._release(self.items, crate), safe=False, reasons=reasons)

    # --- versions and patterns

    def compare_versions(
        self,
        crate: str,
        before: str,
        after: str,
        categories: list[str] | None = None,
        limit: int = C.DEFAULT_DIFF_RESULTS,
    ) -> DataFrame:
        limit = params.to_int(limit, "limit", *C.MAX_DIFF_RESULTS)
        old, new = self._release(self.items, crate, before), self._release(self.items, crate, after)
        diff.check_enough_items(old, new)
        return diff.by_category(diff.compare(old, new), categories, limit)

    def suggest_migrations(self, crate: str, before: str, after: str) -> DataFrame:
        return diff.suggest_migrations(
            self._release(self.items, crate, before), self._release(self.items, crate, after)
        )

    def extract_usage_patterns(self, crate: str, limit: int = 10, min_frequency: int = 2) -> DataFrame:
        return patterns.usage_patterns(self._release(self.items, crate), limit, min_frequency)

    def generate_learning_path(
        self, crate: str, before: str | None = None, after: str | None = None, focus: list[str] | None = None
    ) -> DataFrame:
        if before and after:
            old, new = self._release(self.items, crate, before), self._release(self.items, crate, after)
            return workflow.migration_steps(diff.summary(diff.compare(old, new)))
        return workflow.onboarding_steps(self._release(self.items, crate, after), focus)

    # --- links

    def resolve_import(self, crate: str, path: str, alternatives: bool = False) -> DataFrame:
        return lookup.resolve_import(self._release(self.items, crate), self.reexports, crate, path, alternatives)

    def _releases(self, crate: str, version: str | None = None) -> DataFrame:
        """One (``crate``, ``version``) per crate: the wanted one of ``crate``, the latest of the others."""
        wanted = params.version(version)
        rows = self.crates
        if wanted not in (None, "latest"):
            rows = rows.where((F.col("crate") != params.crate_name(crate)) | (F.col("version") == wanted))
        return rows.groupBy("crate").agg(F.max_by("version", semver.sort_key(F.col("version"))).alias("version"))

    def get_dependency_graph(self, crate: str, max_depth: int = 3, version: str | None = None) -> DataFrame:
        """Links between known items; every crate counts with one release."""
        chosen = self._releases(crate, version)
        links = self._release(self.reexports, crate, version)
        items = self.items.join(chosen, ["crate", "version"], "left_semi")
        return graph.dependency_graph(links, items, chosen, crate, max_depth)

    def trace_reexports(self, crate: str, path: str) -> DataFrame:
        chains = graph.trace_reexports(self._release(self.reexports, crate))
        return chains.where(F.col("alias_path") == path)

    # --- ingestion

    def ingest_cargo_file(self, files: DataFrame, published: DataFrame) -> DataFrame:
        """Dependencies of manifest rows with the versions to ingest."""
        wanted = cargo.dependencies(files).select(
            "file", F.col("dependency").alias("crate"), F.col("requirement").alias("spec")
        )
        return versions.resolve_requirements(wanted, published)

    def ingestion_queue(self, popularity: DataFrame, count: int = 100) -> DataFrame:
        return versions.ingestion_order(versions.popular(popularity, count))

    def get_ingestion_status(self) -> DataFrame:
        return self.status

    def server_health(self, events: DataFrame) -> DataFrame:
        return metrics.event_stats(events)
