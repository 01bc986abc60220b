"""Trees and link graphs."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions import paths
from docquarry.operators.cycles import cyclic_core, has_cycles, strong_components  # noqa: F401
from docquarry.operators.lookup import first_edges
from docquarry.session import durable, staged

LINKS = ["dependency", "crossref", "reexport"]


# --- trees -------------------------------------------------------------------


def module_tree(modules: DataFrame, max_levels: int | None = None) -> DataFrame:
    """Modules reachable from the roots with their ``level``, down to ``max_levels`` if given.

    One equi join per level, each on the rows of the level before only.  Levels
    are checkpointed, so a lost executor never replays the whole climb.
    """
    rows = modules.select("id", "name", "path", "parent_id", "depth", "item_count")
    level = durable(rows.where(F.col("parent_id").isNull()).withColumn("level", F.lit(0)))
    out = level
    for step in itertools.count(1):
        if max_levels is not None and step > max_levels:
            break
        parents = level.select(F.col("id").alias("parent_id"))
        level = durable(rows.join(parents, "parent_id", "left_semi").withColumn("level", F.lit(step)))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def tree_with_root(tree: DataFrame, crate: str) -> DataFrame:
    """Flat tree rows under exactly one root.

    Several roots get a synthetic parent that sums their counts; an empty tree
    is a lone root.  Rows keep ids and parents, since a nested type cannot hold
    a tree of any depth.
    """
    roots = tree.where(F.col("parent_id").isNull())
    top = roots.agg(F.count("*").alias("n"), F.coalesce(F.sum("item_count"), F.lit(0)).alias("total"))
    added = top.where(F.col("n") != 1).select(
        F.lit(-1).cast("bigint").alias("id"),
        F.lit(crate).alias("name"),
        F.lit(crate).alias("path"),
        F.lit(None).cast("bigint").alias("parent_id"),
        F.lit(0).alias("depth"),
        F.col("total").alias("item_count"),
    )
    single = top.select(F.col("n") == 1).scalar()
    rows = tree.withColumn(
        "parent_id",
        F.when(F.col("parent_id").isNull() & ~single, F.lit(-1)).otherwise(F.col("parent_id")),
    )
    return rows.select(*added.columns).unionByName(added)


def with_parent_paths(modules: DataFrame) -> DataFrame:
    """Give every module the id of the module its path sits in."""
    parents = modules.select(F.col("crate"), F.col("path").alias("_parent"), F.col("id").alias("parent_id"))
    keyed = modules.drop("parent_id").withColumn("_parent", paths.parent_of(F.col("path")))
    return keyed.join(parents, ["crate", "_parent"], "left").drop("_parent")


# --- dependency graph ----------------------------------------------------------


def _can_tell_apart(kept: list[frozenset], new: frozenset, spare: int) -> bool:
    """Is there a set of at most ``spare`` nodes that meets every kept set but not ``new``?"""
    if not kept:
        return True
    if spare == 0:
        return False
    first = kept[0]
    return any(
        _can_tell_apart([k for k in kept if node not in k], new, spare - 1) for node in first - new
    )


def _representatives(spare: int):
    """Reduce the ways to reach a node to those that can still matter.

    Whether an edge may continue a walk depends only on which nodes the walk
    has used, and a walk takes at most ``spare`` further nodes.  A used set may
    go when the kept ones allow everything it allows.  What is left per node is
    a small number that depends on the depth alone, however many walks meet
    there; reducing in steps gives the same reachable edges as reducing at once.
    """

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[str, list[frozenset]] = {}

        def rows() -> pd.DataFrame:
            flat = [(node, sorted(used)) for node, sets in kept.items() for used in sets]
            return pd.DataFrame(flat, columns=["node", "used"])

        for batch in batches:
            for node, used in zip(batch["node"], batch["used"]):
                sets, new = kept.setdefault(node, []), frozenset(used)
                if new not in sets and _can_tell_apart(sets, new, spare):
                    sets.append(new)
            if len(kept) > 200_000:  # keep the memory of a task flat
                yield rows()
                kept.clear()
        yield rows()

    return reduce


def _trim(states: DataFrame, spare: int) -> DataFrame:
    """Representatives per node: first inside each partition, then per node."""
    schema = "node string, used array<string>"
    local = states.mapInPandas(_representatives(spare), schema)
    return local.repartition("node").mapInPandas(_representatives(spare), schema)


def dependency_graph(
    reexports: DataFrame, items: DataFrame, crates: DataFrame, crate: str, max_depth: int = 3
) -> DataFrame:
    """Edges between known items at every depth a simple walk can place them.

    ``depth`` 1 holds all links of the crate; an edge is at depth ``d`` when a
    walk of ``d`` links ends with it and its target is not among the walk's
    earlier sources.  Links and the walks of each depth are staged, since both
    the result and the next depth read them.
    """
    links = staged(
        reexports.where((F.col("crate") == crate) & F.col("link_type").isin(LINKS))
        .select(F.col("alias_path").alias("source"), F.col("actual_path").alias("target"))
        .distinct()
    )
    out = links.withColumn("depth", F.lit(1))
    states = links.select(F.col("target").alias("node"), F.array("source").alias("used"))
    for depth in range(2, max_depth + 1):
        states = _trim(states, max_depth - depth + 1)
        walked = links.join(states, F.col("source") == F.col("node")).where(
            ~F.array_contains("used", F.col("target"))
        )
        if depth < max_depth:
            walked = staged(walked)
        out = out.unionByName(walked.select("source", "target", F.lit(depth).alias("depth")).distinct())
        states = walked.select(F.col("target").alias("node"), F.array_union("used", F.array("source")).alias("used"))
    known = items.select(F.col("item_path")).distinct()
    real = out.join(known.withColumnRenamed("item_path", "source"), "source", "left_semi").join(
        known.withColumnRenamed("item_path", "target"), "target", "left_semi"
    )
    versions = crates.select(F.col("crate").alias("_crate"), F.col("version").alias("target_version"))
    return (
        real.withColumn("_crate", paths.crate_of(F.col("target")))
        .join(versions, "_crate", "left")
        .select("source", "target", "target_version", "depth")
        .distinct()
    )


def hierarchy(edges: DataFrame, root: str, max_depth: int = 3) -> DataFrame:
    """The graph below ``root``, each node opened at its first, shallowest visit.

    A node seen again is listed under its other parents as a leaf
    (``opened`` is false), and nothing below ``max_depth`` is opened.
    """
    links = staged(edges.select("source", "target").distinct())
    spark = edges.sparkSession
    frontier = spark.createDataFrame([(root,)], "node string")
    visited = frontier
    out = None
    for depth in range(1, max_depth + 1):
        step = links.join(frontier, F.col("source") == F.col("node"), "left_semi")
        fresh = step.select(F.col("target").alias("node")).distinct().join(visited, "node", "left_anti")
        marked = step.join(fresh.withColumn("opened", F.lit(True)), F.col("target") == F.col("node"), "left")
        first = marked.groupBy("target").agg(F.min("source").alias("_first"))
        level = (
            marked.join(first, "target")
            .select(
                "source",
                "target",
                F.lit(depth).alias("depth"),
                (F.coalesce("opened", F.lit(False)) & (F.col("source") == F.col("_first"))).alias("opened"),
            )
        )
        out = level if out is None else out.unionByName(level)
        visited = visited.unionByName(fresh)
        frontier = fresh
    return out


# --- re-export chains ------------------------------------------------------------


def trace_reexports(reexports: DataFrame, max_hops: int = 10) -> DataFrame:
    """Follow re-exports from every alias to the original item.

    Chains are doubled instead of walked: after joining the chains of length
    1, 2, 4 and 8 with themselves, every alias knows its next sixteen steps from
    four joins with one row per alias, each of a table that was written before.  The chain is then cut at the first node
    seen before and at ``max_hops``; ``original_source`` is empty for a cycle or
    a chain that is still going after the last hop.
    """
    chains = first_edges(reexports).select(
        "crate", F.col("alias_path").alias("node"), F.array("actual_path").alias("steps")
    )
    length = 1
    while length <= max_hops:
        chains = staged(chains)
        ends = chains.select("crate", F.col("node").alias("_end"), F.col("steps").alias("_more"))
        chains = (
            chains.withColumn("_end", F.element_at("steps", -1))
            .join(ends, ["crate", "_end"], "left")
            .select(
                "crate",
                "node",
                F.concat("steps", F.coalesce("_more", F.array().cast("array<string>"))).alias("steps"),
            )
        )
        length *= 2
    full = F.concat(F.array("node"), F.col("steps"))
    repeat = F.array_min(
        F.filter(
            F.sequence(F.lit(2), F.size(full)),
            lambda i: F.array_contains(F.slice(full, F.lit(1), i - 1), F.element_at(full, i)),
        )
    )
    hops = F.least(F.coalesce(repeat - 1, F.size("steps")), F.lit(max_hops))
    cut = chains.withColumn("hops", hops).withColumn("cyclic", repeat.isNotNull())
    ended = ~F.col("cyclic") & (F.col("hops") < max_hops)
    walked = F.slice(full, F.lit(1), F.col("hops") + 1)
    arrows = F.transform(
        F.sequence(F.lit(1), F.col("hops")),
        lambda i: F.concat(
            F.col("crate"), F.lit("::"), F.element_at(walked, i),
            F.lit(" -> "), F.col("crate"), F.lit("::"), F.element_at(walked, i + 1),
        ),
    )
    return cut.select(
        "crate",
        F.col("node").alias("alias_path"),
        arrows.alias("chain"),
        F.when(ended, F.element_at(walked, -1)).otherwise("").alias("original_source"),
    )
