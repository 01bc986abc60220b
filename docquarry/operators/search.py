"""Vector search, ranking, diversification, fusion and pattern search.

An item table has ``id``, ``item_path``, ``header``, ``content``, ``embedding``,
``item_type``, ``examples``, ``visibility``, ``deprecated``, ``stability_level``
and, for searches over several crates, ``crate``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from docquarry import constants as C
from docquarry import params
from docquarry.functions import code, text, vectors
from docquarry.operators.filters import item_condition
from docquarry.operators.topn import first_per_group


def fetch_size(k: int, extra: int = 10) -> int:
    """Candidates to rank for ``k`` results."""
    return k + extra


def nearest(items: DataFrame, query: Sequence[float], k: int, vector: str = "embedding") -> DataFrame:
    """The ``k`` closest rows by Euclidean distance, ties by id.

    Plans as one scan and ``TakeOrderedAndProject``: each task keeps ``k`` rows
    and only those leave it.
    """
    whole = items.where(F.size(vector) == len(query))
    measured = whole.withColumn("distance", vectors.l2_distance(vector, query))
    return measured.orderBy("distance", "id").limit(k)


ROW_KEY = ["crate", "version", "id"]


def _row_key(table: DataFrame) -> list[str]:
    """Columns that identify an item: its id, within its release if the table has releases."""
    return [c for c in ROW_KEY if c in table.columns]


def _with_distances(items: DataFrame, hits: list) -> DataFrame:
    """Whole rows of a few chosen items, with their distances as literals.

    The id condition is the one a scan can push down; the map on the full key
    keeps equal ids of other releases out.
    """
    if not hits:
        return items.withColumn("distance", F.lit(None).cast("double")).limit(0)
    key = _row_key(items)
    table = {"\x1f".join(str(row[c]) for c in key): row["distance"] for row in hits}
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = items.where(F.col("id").isin([row["id"] for row in hits]))
    name = F.concat_ws("\x1f", *[F.col(c).cast("string") for c in key])
    return found.withColumn("distance", F.try_element_at(pairs, name)).where(F.col("distance").isNotNull())


def _nearest_rows(items: DataFrame, query: Sequence[float], k: int, condition: Column | None) -> DataFrame:
    narrow = items if condition is None else items.where(condition)
    key = _row_key(items)
    hits = nearest(narrow.select(*key, "embedding"), query, k).select(*key, "distance").collect()
    return _with_distances(items, hits)


def nearest_late(items: DataFrame, query: Sequence[float], k: int, condition: Column | None = None) -> DataFrame:
    """``nearest`` in two reads, for tables where text is the bulk.

    The first read touches ids, vectors and filter columns only.  Its at most
    ``k`` ids come back as literals, so the second read can skip row groups by
    their id range instead of reading the text of every item.  Ids are unique.
    """
    return _nearest_rows(items, query, k, condition).orderBy("distance", "id")


def composite_score(distance: Column) -> Column:
    """Similarity, kind, documentation length and examples as one score in 0..1."""
    similarity = 1.0 - distance
    kinds = F.create_map(*[F.lit(x) for pair in C.ITEM_TYPE_WEIGHTS.items() for x in pair])
    weight = F.coalesce(F.try_element_at(kinds, F.col("item_type")), F.lit(1.0))
    quality = F.least(F.lit(1.0), F.coalesce(F.length("content"), F.lit(0)) / C.FULL_DOC_LENGTH)
    has_examples = F.coalesce(F.col("examples"), F.lit("")) != ""
    examples = F.when(has_examples, C.EXAMPLES_BOOST).otherwise(1.0)
    return vectors.clamp(
        C.VECTOR_WEIGHT * similarity
        + C.TYPE_WEIGHT * (similarity * weight)
        + C.QUALITY_WEIGHT * quality
        + C.EXAMPLES_WEIGHT * examples
    )


def candidates(
    items: DataFrame, query: Sequence[float], k: int, filter_mode: str = "pre", **filters
) -> DataFrame:
    """Scored candidates for ``k`` results.

    ``pre`` filters before the nearest rows are cut, so a selective filter still
    fills the result.  ``post`` cuts first, as an index that knows nothing of the
    filters would, and may return fewer rows.
    """
    if filter_mode not in ("pre", "post"):
        raise ValueError("filter_mode is 'pre' or 'post'")
    condition = item_condition(columns=items.columns, **filters)
    if filter_mode == "pre":
        found = _nearest_rows(items, query, fetch_size(k), condition)
    else:
        found = _nearest_rows(items, query, fetch_size(k), None).where(condition)
    return found.withColumn("score", composite_score(F.col("distance")))


def ranked(scored: DataFrame, k: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), "distance", "id").limit(k)


def _select_diverse(scores: np.ndarray, matrix: np.ndarray, k: int, balance: float) -> list[int]:
    """Greedy choice of ``k`` rows from candidates sorted by relevance."""
    sizes = np.linalg.norm(matrix, axis=1)
    unit = matrix / np.where(sizes == 0, 1.0, sizes)[:, None]  # a zero vector resembles nothing
    similar = unit @ unit.T
    chosen = [0]
    closest = np.maximum(similar[0], 0.0)
    while len(chosen) < min(k, len(scores)):
        gain = balance * scores + (1 - balance) * (1 - closest)
        gain[chosen] = -np.inf
        best = int(np.argmax(gain))  # the earliest of equal gains
        chosen.append(best)
        closest = np.maximum(closest, similar[best])
    return chosen


def diversify(
    scored: DataFrame, k: int, balance: float = C.MMR_LAMBDA, by: str | None = None
) -> DataFrame:
    """Maximal marginal relevance over scored candidates; adds ``position`` from 1.

    Takes the output of ``candidates``: at most 50 rows, or 50 per value of
    ``by``, so each group is small by construction.  Groups no larger than ``k``
    keep their ranking.
    """
    schema = StructType([*scored.schema.fields, StructField("position", IntegerType())])

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", "distance", "id"], ascending=[False, True, True])
        if len(group) > k:
            matrix = np.array(group["embedding"].tolist(), dtype=np.float64)
            order = _select_diverse(group["score"].to_numpy(), matrix, k, balance)
            group = group.iloc[order]
        return group.assign(position=np.arange(1, len(group) + 1, dtype=np.int32))

    keyed = scored.withColumn("_group", F.lit(0) if by is None else F.col(by))
    out = keyed.groupBy("_group").applyInPandas(lambda g: pick(g.drop(columns="_group")), schema)
    return out


def search(
    items: DataFrame,
    query: Sequence[float],
    k: int = 5,
    filter_mode: str = "pre",
    diverse: bool = True,
    balance: float = C.MMR_LAMBDA,
    **filters,
) -> DataFrame:
    """Ranked and diversified search results, ``position`` first to last."""
    scored = candidates(items, query, k, filter_mode, **filters)
    if diverse:
        return diversify(scored, k, balance).orderBy("position")
    top = ranked(scored, k)
    return first_per_group(
        top.withColumn("_all", F.lit(0)), ["_all"], [F.desc("score"), F.asc("distance"), F.asc("id")], k, "position"
    ).drop("_all").orderBy("position")


def see_also(
    items: DataFrame,
    query: Sequence[float],
    exclude: DataFrame,
    k: int = 8,
    threshold: float = 0.7,
    limit: int = 5,
) -> DataFrame:
    """Close neighbours that are not among the results in ``exclude``."""
    near = nearest(items.select("id", "item_path", "item_type", "embedding"), query, k)
    near = near.where(1.0 - F.col("distance") >= threshold).drop("embedding")
    fresh = near.join(exclude.select("item_path"), "item_path", "left_anti")
    return fresh.orderBy("distance", "id").limit(limit)


def search_examples(
    examples: DataFrame,
    query: Sequence[float],
    k: int = 5,
    crate: str | None = None,
    language: str | None = None,
    filter_mode: str = "pre",
) -> DataFrame:
    """Nearest code examples, one per distinct example, best first.

    ``pre`` filters and takes the nearest copy of every example before the cut,
    so copies leave no place empty: each task sends one key per example, and the
    at most ``k`` keys then select whole rows.  ``post`` cuts first and may
    return fewer rows.
    """
    condition = F.lit(True)
    if crate is not None:
        condition = condition & (F.col("crate") == crate)
    if language is not None:
        condition = condition & (F.col("language") == language)
    if filter_mode == "pre":
        wanted = examples.where(condition & (F.size("embedding") == len(query)))
        wanted = wanted.withColumn("distance", vectors.l2_distance("embedding", query))
        closest = wanted.groupBy("example_hash").agg(F.min(F.struct("distance", "id")).alias("closest"))
        top = closest.orderBy("closest", "example_hash").limit(k).select(F.col("example_hash").alias("top_hash"), "closest.id")
        found = wanted.join(top, (wanted.id == top.id) & wanted.example_hash.eqNullSafe(top.top_hash), "left_semi")
    else:
        found = nearest(examples, query, fetch_size(k, 5)).where(condition)
    unique = first_per_group(found, ["example_hash"], [F.asc("distance"), F.asc("id")])
    scored = unique.withColumn("score", 1.0 - F.col("distance"))
    return scored.orderBy("distance", "id").limit(k)


def search_item_examples(
    items: DataFrame, query: Sequence[float], k: int = 5, language: str | None = None
) -> DataFrame:
    """Examples of the nearest items that have any, for stores without example vectors."""
    found = nearest(items.where(F.col("examples").isNotNull()), query, 3 * k)
    single = found.select(
        "id",
        "item_path",
        "distance",
        "content",
        F.posexplode(code.parse_examples(F.col("examples"))).alias("n", "example"),
    ).select("id", "item_path", "distance", "content", "n", "example.*")
    if language is not None:
        single = single.where(F.col("language") == language)
    order = [F.asc("distance"), F.asc("id"), F.asc("n")]
    unique = first_per_group(single, ["code"], order)
    return (
        unique.orderBy(*order)
        .limit(k)
        .select(
            "item_path",
            "code",
            "language",
            "detected",
            text.snippet(F.col("content")).alias("context"),
            (1.0 / (1.0 + F.col("distance"))).alias("score"),
        )
    )


def regex_search(
    items: DataFrame, pattern: str, k: int = 10, first_hits: bool = False, **filters
) -> DataFrame:
    """Items whose path or text matches a pattern, ignoring case.

    A path hit scores 1.0, a text hit 0.7, and 1.5 if the first hit in the path
    is the whole path.  ``first_hits`` ranks only the first ``k`` matches in id
    order, the way a scan that stops early would; the default ranks all matches.
    """
    params.safe_regex(pattern)
    insensitive = f"(?i){pattern}"
    path_hit = F.col("item_path").rlike(insensitive)
    whole = F.regexp_extract("item_path", insensitive, 0) == F.col("item_path")
    score = F.when(path_hit & whole, 1.5).when(path_hit, 1.0).otherwise(0.7)
    hits = items.where(item_condition(mode="regex", columns=items.columns, **filters)).where(
        path_hit | F.col("content").rlike(insensitive)
    )
    hits = hits.withColumn("score", score)
    if first_hits:
        hits = hits.orderBy("id").limit(k)
    return hits.orderBy(F.desc("score"), "id").limit(k)


def cross_crate_search(
    items: DataFrame,
    query: Sequence[float],
    crates: list[str],
    k: int = 5,
    diverse: bool = True,
    **filters,
) -> DataFrame:
    """Reciprocal rank fusion of one search per crate, from a single scan.

    Each crate's candidates are the nearest rows of a window over the crate;
    Spark trims them to the fetch size inside every input partition, so a crate
    that holds most of the items sends no more rows than the others.
    """
    crates = params.crate_list(crates)
    wanted = items.where(F.col("crate").isin(crates)).where(item_condition(columns=items.columns, **filters))
    wanted = wanted.where(F.size("embedding") == len(query))
    measured = wanted.withColumn("distance", vectors.l2_distance("embedding", query))
    narrow = measured.select(*_row_key(items), "distance")
    near = first_per_group(narrow, ["crate"], [F.asc("distance"), F.asc("id")], fetch_size(2 * k))
    near = _with_distances(items, near.collect())  # five crates of at most 50 rows
    scored = near.withColumn("score", composite_score(F.col("distance")))
    if diverse:
        placed = diversify(scored, 2 * k, by="crate")
    else:
        order = [F.desc("score"), F.asc("distance"), F.asc("id")]
        placed = first_per_group(scored, ["crate"], order, 2 * k, "position")
    return fuse(placed, crates, k)


def fuse(placed: DataFrame, crates: list[str], k: int) -> DataFrame:
    """Add up reciprocal ranks by path; ties go to the path seen first."""
    turn = F.array_position(F.array(*[F.lit(c) for c in crates]), F.col("crate"))
    seen = F.struct(turn.alias("turn"), F.col("position").alias("position"))
    fused = placed.groupBy("item_path").agg(
        F.sum(1.0 / (C.RRF_CONSTANT + F.col("position"))).alias("score"),
        F.min(seen).alias("seen"),
        F.min_by("header", seen).alias("header"),
        F.min_by("content", seen).alias("content"),
    )
    best = fused.orderBy(F.desc("score"), "seen", "item_path").limit(k)
    return best.select("item_path", "score", "header", "content")
