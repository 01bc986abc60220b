"""Documentation at a chosen depth, and learning paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry import texts as T

LEVELS = ["summary", "detailed", "expert"]

# minutes of work per change
MINUTES = {"breaking_changes": 15, "deprecated_items": 10, "added_items": 5}


def documentation(items: DataFrame, path: str, level: str = "summary") -> DataFrame:
    """One item with the columns its level of detail calls for.

    An unknown level reads as ``summary``.
    """
    level = level if level in LEVELS else "summary"
    columns = [
        F.col("item_path"),
        F.lit(level).alias("detail_level"),
        F.coalesce("header", F.lit("No summary available")).alias("summary"),
        F.col("signature"),
        F.coalesce("item_type", F.lit("unknown")).alias("type"),
        F.coalesce("visibility", F.lit("public")).alias("visibility"),
        F.coalesce("deprecated", F.lit(False)).alias("deprecated"),
    ]
    if level != "summary":
        columns += [F.coalesce("content", F.lit("No documentation available")).alias("documentation"), F.col("examples")]
    if level == "expert":
        columns += [F.col(c) for c in ("generic_params", "trait_bounds") if c in items.columns]
    return items.where(F.col("item_path") == path).limit(1).select(*columns)


def effort(minutes: Column) -> Column:
    """Minutes in the largest sensible unit: minutes, hours, or days of eight hours."""
    return (
        F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" minutes")))
        .when(minutes < 480, F.concat(F.floor(minutes / 60).cast("string"), F.lit(" hours")))
        .otherwise(F.concat(F.floor(minutes / 480).cast("string"), F.lit(" days")))
    )


def migration_steps(summary: DataFrame) -> DataFrame:
    """Steps of an upgrade from a row of change counts; empty steps are left out."""
    entries = [
        F.struct(
            F.lit(order).alias("step"),
            F.lit(title).alias("title"),
            T.fill(about, n=F.col(count).cast("string")).alias("description"),
            F.concat((F.col(count) * MINUTES[count]).cast("string"), F.lit(" minutes")).alias("estimated_time"),
            F.col(count).alias("items"),
        )
        for order, (title, about, count) in enumerate(T.UPGRADE_STEPS, start=1)
    ]
    total = sum((F.col(c) * m for c, m in MINUTES.items()), F.lit(0))
    return (
        summary.select(effort(total).alias("estimated_effort"), F.inline(F.array(*entries)))
        .where(F.col("items") > 0)
        .drop("items")
    )


def onboarding_steps(items: DataFrame, focus: list[str] | None = None, per_step: int = 5) -> DataFrame:
    """What to read first: twenty top-level items by path, sorted into steps."""
    kinds = ["module", "struct", "trait", "function"]
    core = (
        items.where(F.col("item_type").isin(kinds) & F.col("parent_id").isNull())
        .select("item_path", "item_type", F.coalesce("header", F.lit("")).alias("description"))
        .distinct()
        .orderBy("item_path")
        .limit(20)
    )
    parts = [
        core.where(F.col("item_type").isin(step_kinds))
        .orderBy("item_path")
        .limit(per_step)
        .select(F.lit(order).alias("step"), F.lit(title).alias("title"), "item_path", "item_type", "description")
        for order, (title, step_kinds) in enumerate(T.READING_STEPS, start=1)
    ]
    for order, area in enumerate((focus or [])[:3], start=4):
        like = f"%{area}%"
        parts.append(
            items.where(F.col("item_path").ilike(like) | F.col("header").ilike(like))
            .orderBy("item_path")
            .limit(5)
            .select(
                F.lit(order).alias("step"),
                F.lit(f"Focus: {area.title()}").alias("title"),
                "item_path",
                "item_type",
                F.coalesce("header", F.lit("")).alias("description"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
