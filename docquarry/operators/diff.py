"""Comparing two versions of a crate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry import constants as C
from docquarry import texts as T
from docquarry.functions import signatures
from docquarry.operators.topn import first_per_group

FIELDS = [
    "header",
    "content",
    "item_type",
    "signature",
    "visibility",
    "deprecated",
    "generic_params",
    "trait_bounds",
]


def item_hash() -> Column:
    """16 hex digits over everything that makes an item what it is."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ["item_path", *FIELDS]]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def change_kind(item_type: Column) -> Column:
    """A known kind as it is; anything else, and null, counts as a function."""
    tidy = F.lower(F.trim(item_type))
    return F.when(tidy.isin(C.DIFF_KINDS), tidy).otherwise("function")


def _side(items: DataFrame, name: str) -> DataFrame:
    return items.where(F.col("item_path").isNotNull()).select(
        "item_path", item_hash().alias(f"{name}_hash"), *[F.col(c).alias(f"{name}_{c}") for c in FIELDS]
    )


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Every added, removed or modified item with severity and reasons.

    One full outer join on the path replaces the three set operations; each side
    hashes its text first, but the hash only decides, so the long text columns
    are not part of the shuffle.
    """
    a = _side(before, "a").drop("a_content", "a_header")
    b = _side(after, "b").drop("b_content", "b_header")
    joined = a.join(b, "item_path", "full_outer")
    gone, new = F.col("b_hash").isNull(), F.col("a_hash").isNull()
    kind = F.when(gone, "removed").when(new, "added").otherwise("modified")
    changed = joined.where(gone | new | (F.col("a_hash") != F.col("b_hash")))

    def differs(field: str) -> Column:
        return ~F.col(f"a_{field}").eqNullSafe(F.col(f"b_{field}"))

    newly_deprecated = ~F.coalesce("a_deprecated", F.lit(False)) & F.coalesce("b_deprecated", F.lit(False))
    hidden = differs("visibility") & (F.coalesce("b_visibility", F.lit("")) == "private")
    breaking = differs("signature") | hidden | differs("generic_params") | differs("trait_bounds")
    visible = F.coalesce("a_visibility", F.lit("public")) == "public"
    severity = (
        F.when(gone, F.when(visible, "breaking").otherwise("minor"))
        .when(new, "minor")
        .when(breaking, "breaking")
        .when(newly_deprecated, "minor")
        .otherwise("patch")
    )
    reasons = F.array_compact(
        F.array(
            F.when(differs("signature"), T.SIGNATURE_CHANGED),
            F.when(hidden, T.MADE_PRIVATE).when(
                differs("visibility"),
                T.fill(T.VISIBILITY_CHANGED, visibility=F.coalesce("b_visibility", F.lit("unknown"))),
            ),
            F.when(newly_deprecated, T.DEPRECATED),
            F.when(differs("generic_params"), T.GENERICS_CHANGED),
            F.when(differs("trait_bounds"), T.BOUNDS_CHANGED),
        )
    )
    return changed.select(
        F.col("item_path").alias("path"),
        change_kind(F.when(new, F.col("b_item_type")).otherwise(F.col("a_item_type"))).alias("kind"),
        kind.alias("change_type"),
        severity.alias("severity"),
        F.when(gone, F.array(F.lit(T.ITEM_REMOVED)))
        .when(new, F.array(F.lit(T.ITEM_ADDED)))
        .otherwise(reasons)
        .alias("semantic_changes"),
        F.when(~new, F.coalesce("a_signature", F.lit(""))).alias("signature_before"),
        F.when(~gone, F.coalesce("b_signature", F.lit(""))).alias("signature_after"),
        F.when(~new, F.coalesce("a_visibility", F.lit("public"))).alias("visibility_before"),
        F.when(~gone, F.coalesce("b_visibility", F.lit("public"))).alias("visibility_after"),
        F.when(~new, F.col("a_generic_params")).alias("generics_before"),
        F.when(~gone, F.col("b_generic_params")).alias("generics_after"),
        (newly_deprecated & ~gone & ~new).alias("newly_deprecated"),
    )


def categories() -> Column:
    """The lists a change belongs to; a breaking change is in two."""
    breaking = (F.col("severity") == "breaking") & F.col("change_type").isin("removed", "modified")
    return F.array_compact(
        F.array(
            F.col("change_type"),
            F.when(breaking, "breaking"),
            F.when(F.col("newly_deprecated"), "deprecated"),
        )
    )


def by_category(
    changes: DataFrame, wanted: list[str] | None = None, limit: int | None = None
) -> DataFrame:
    """One row per change and category, in path order up to ``limit`` per category."""
    listed = changes.withColumn("category", F.explode(categories()))
    if wanted is not None:
        listed = listed.where(F.col("category").isin(wanted))
    if limit is None:
        return listed
    return first_per_group(listed, ["category"], [F.asc("path")], limit)


def check_enough_items(before: DataFrame, after: DataFrame, tiers: tuple = (None, None)) -> None:
    """Refuse a comparison when a side has too little to compare."""
    for side, tier in zip((before, after), tiers):
        needed = C.TIER_MINIMUM_ITEMS.get(tier, C.DEFAULT_TIER_MINIMUM)
        found = side.limit(needed).count()
        if found < needed:
            raise ValueError(f"only {found} items to compare (ingested as {tier or 'unknown'})")


def migration_hints(changes: DataFrame, limit: int = 10) -> DataFrame:
    """What to do about the first breaking changes."""
    breaking = (F.col("severity") == "breaking") & F.col("change_type").isin("removed", "modified")
    first = changes.where(breaking).orderBy("path").limit(limit)
    reasons = F.lower(F.array_join("semantic_changes", " "))
    removed = F.col("change_type") == "removed"
    signature, private = reasons.contains("signature changed"), reasons.contains("private")

    def hint(part: int) -> Column:
        told = [T.fill(h[part], path=F.col("path")) for h in (T.HINT_REMOVED, T.HINT_SIGNATURE, T.HINT_PRIVATE)]
        return F.when(removed, told[0]).when(signature, told[1]).otherwise(told[2])

    return first.where(removed | signature | private).select(
        F.col("path").alias("affected_path"),
        hint(0).alias("issue"),
        hint(1).alias("suggested_fix"),
        F.lit("breaking").alias("severity"),
        F.when(~removed & signature, F.col("signature_before")).alias("example_before"),
        F.when(~removed & signature, F.col("signature_after")).alias("example_after"),
    )


def summary(changes: DataFrame) -> DataFrame:
    """Counts per category; the total counts a breaking change in each of its lists."""
    listed = changes.withColumn("category", F.explode(categories()))

    def n(name: str) -> Column:
        return F.count_if(F.col("category") == name)

    return listed.agg(
        F.count("*").alias("total_changes"),
        n("breaking").alias("breaking_changes"),
        n("deprecated").alias("deprecated_items"),
        n("added").alias("added_items"),
        n("removed").alias("removed_items"),
        n("modified").alias("modified_items"),
    )


def breaking_reasons(changes: DataFrame) -> DataFrame:
    """A second, stricter reading of what breaks users; adds ``reasons``.

    A signature breaks when parameters were added or the return type changed;
    dropped parameters alone do not count.
    """
    both = (F.col("change_type") == "modified") & (F.col("signature_before") != "") & (
        F.col("signature_after") != ""
    )
    more = F.size(signatures.parameters(F.col("signature_after"))) > F.size(
        signatures.parameters(F.col("signature_before"))
    )
    returns = ~signatures.return_type(F.col("signature_before")).eqNullSafe(
        signatures.return_type(F.col("signature_after"))
    )
    modified = F.col("change_type") == "modified"
    told = F.col("semantic_changes")

    def mentions(word: str) -> Column:
        return F.exists(told, lambda s: F.lower(s).contains(word) & F.lower(s).contains("added"))

    was_public = F.col("visibility_before") == "public"
    reasons = F.array_compact(
        F.array(
            F.when((F.col("change_type") == "removed") & was_public, T.BREAKS_REMOVED),
            F.when(both & (more | returns), T.BREAKS_SIGNATURE),
            F.when(
                modified & was_public & F.col("visibility_after").isin("private", "crate"),
                T.BREAKS_VISIBILITY,
            ),
            F.when(
                modified & ~F.col("generics_before").eqNullSafe(F.col("generics_after")),
                T.BREAKS_GENERICS,
            ),
            F.when(
                modified & (F.col("kind") == "enum") & mentions("variant"),
                T.BREAKS_ENUM,
            ),
            F.when(
                modified & (F.col("kind") == "struct") & mentions("field") & was_public,
                T.BREAKS_STRUCT,
            ),
            F.when(
                modified & (F.col("kind") == "trait") & mentions("method"), T.BREAKS_TRAIT
            ),
        )
    )
    return changes.withColumn("reasons", reasons).withColumn("is_breaking", F.size("reasons") > 0)


def change_advice(changes: DataFrame) -> DataFrame:
    """``action``, ``description`` and ``hint`` for changes that need one."""
    told = F.lower(F.array_join("semantic_changes", " "))
    modified = F.col("change_type") == "modified"
    cases = [
        (F.col("change_type") == "removed", T.ADVICE_REMOVED),
        (modified & told.contains("signature"), T.ADVICE_SIGNATURE),
        (modified & told.contains("private"), T.ADVICE_PRIVATE),
        (modified & told.contains("generic"), T.ADVICE_GENERIC),
    ]

    def pick(part: int) -> Column:
        return F.coalesce(*[F.when(c, T.fill(advice[part], path=F.col("path"))) for c, advice in cases])

    out = changes.select(
        "path", pick(0).alias("action"), pick(1).alias("description"), pick(2).alias("hint")
    )
    return out.where(F.col("action").isNotNull())


def migration_notes(change_type: Column, old: Column, new: Column) -> Column:
    cases = [
        ("removed", T.NOTE_REMOVED),
        ("added", T.NOTE_ADDED),
        ("moved", T.NOTE_MOVED),
        ("renamed", T.NOTE_RENAMED),
        ("modified", T.NOTE_MODIFIED),
    ]
    # a note whose paths are missing is null and gives way to the general one
    told = [F.when(change_type == kind, T.fill(note, old=old, new=new)) for kind, note in cases]
    return F.coalesce(*told, T.fill(T.NOTE_OTHER, change=change_type))


def suggest_migrations(before: DataFrame, after: DataFrame, limit: int | None = 100) -> DataFrame:
    """Old and new path of every item whose presence or signature changed."""
    a = before.select("item_path", F.col("signature").alias("a_sig"), F.lit(True).alias("in_a")).distinct()
    b = after.select("item_path", F.col("signature").alias("b_sig"), F.lit(True).alias("in_b")).distinct()
    joined = a.join(b, "item_path", "full_outer")
    kind = (
        F.when(F.col("in_b").isNull(), "removed")
        .when(F.col("in_a").isNull(), "added")
        .when(~F.col("a_sig").eqNullSafe(F.col("b_sig")), "modified")
    )
    changes = joined.withColumn("change_type", kind).where(F.col("change_type").isNotNull())
    out = changes.select(
        F.when(F.col("change_type") != "added", F.col("item_path")).alias("old_path"),
        F.when(F.col("change_type") != "removed", F.col("item_path")).alias("new_path"),
        "change_type",
        F.when(F.col("change_type") == "modified", 0.7).otherwise(0.9).alias("confidence"),
    ).distinct()
    out = out.withColumn(
        "notes", migration_notes(F.col("change_type"), F.col("old_path"), F.col("new_path"))
    )
    if limit is None:
        return out
    return out.orderBy(F.coalesce("old_path", "new_path"), "change_type").limit(limit)


def pattern_migrations(upgrades: DataFrame) -> DataFrame:
    """Likely moves for every major upgrade (``crate``, ``from_version``, ``to_version``)."""
    plain = r"^(\d+)\.(\d+)\.\d+$"
    major = upgrades.where(
        F.col("from_version").rlike(plain)
        & F.col("to_version").rlike(plain)
        & (F.split_part("from_version", F.lit("."), F.lit(1)) != F.split_part("to_version", F.lit("."), F.lit(1)))
    )
    moves = F.array(
        *[
            F.struct(F.lit(old).alias("old"), F.lit(new).alias("new"))
            for old, new in [("Error", "error::Error"), ("Result", "result::Result")]
        ]
    )
    moved = major.select("*", F.explode(moves).alias("m")).select(
        *upgrades.columns,
        F.concat_ws("::", "crate", "m.old").alias("old_path"),
        F.concat_ws("::", "crate", "m.new").alias("new_path"),
        F.lit("moved").alias("change_type"),
        F.lit(0.7).alias("confidence"),
    )
    return moved.withColumn(
        "notes", migration_notes(F.col("change_type"), F.col("old_path"), F.col("new_path"))
    )

