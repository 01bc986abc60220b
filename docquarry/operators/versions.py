"""Published versions, requirements and popularity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry import constants as C
from docquarry.functions import semver
from docquarry.operators.ranks import prefix_sums


def list_versions(published: DataFrame) -> DataFrame:
    """All versions of each crate, newest first, with the latest one marked.

    Latest is the one published last that was not yanked.  Semantic versions
    sort by precedence and come before anything else.
    """
    key = semver.sort_key(F.col("version"))
    when = F.struct(F.try_to_timestamp(F.col("created_at")), key, F.col("version"))
    latest = published.where(~F.col("yanked")).groupBy("crate").agg(F.max_by("version", when).alias("_latest"))
    return (
        published.select("crate", "version", "yanked")
        .distinct()
        .join(latest, "crate", "left")
        .withColumn("is_latest", F.coalesce(F.col("version") == F.col("_latest"), F.lit(False)))
        .withColumn("_key", key)
        .orderBy("crate", F.col("_key").desc_nulls_last(), F.desc("version"))
        .drop("_key", "_latest")
    )


def best_versions(requirements: DataFrame, published: DataFrame) -> DataFrame:
    """The published version that best meets each requirement (``crate``, ``spec``).

    Requirements with equal text are matched once.  Pre-releases count only for
    a crate with no stable release.  A requirement of a kind that is not
    understood gets the highest stable version; one that is understood but met
    by nothing does too, except for exact versions and unmatched prefixes.
    """
    wanted = requirements.select("crate", "spec").distinct()
    wanted = wanted.withColumn("_r", semver.parse_requirement(F.col("spec"))).select(
        "crate", "spec", "_r.kind", F.col("_r.version").alias("asked")
    )
    wanted = wanted.withColumn("_low", semver.sort_key(F.col("asked")))

    rows = published.select("crate", "version").distinct()
    rows = rows.withColumn("_key", semver.sort_key(F.col("version")))
    stable = F.col("_key").isNotNull() & F.col("_key.release")
    rows = rows.withColumn("_stable", F.coalesce(stable, F.lit(False)))
    any_stable = rows.groupBy("crate").agg(F.max("_stable").alias("_any_stable"))
    pool = rows.join(any_stable, "crate").where(F.col("_stable") | ~F.col("_any_stable"))

    joined = wanted.join(pool, "crate", "left")
    kind, key, low = F.col("kind"), F.col("_key"), F.col("_low")
    ranged = low.isNotNull() & key.isNotNull() & (key >= low)
    prefix = F.replace(F.col("asked"), F.lit("*"), F.lit(""))
    hit = (
        F.when(kind == "exact", F.startswith(F.col("version"), F.col("asked")))
        .when(kind == "caret", ranged & (key < semver.next_major(low)))
        .when(kind == "tilde", ranged & (key < semver.next_minor(low)))
        .when(kind == "wildcard", F.startswith(F.col("version"), prefix))
        .otherwise(False)
    )
    same = F.when(F.col("version") == F.col("asked"), F.col("version"))
    best = joined.groupBy("crate", "spec", "kind").agg(
        F.max(same).alias("_same"),
        F.max_by(F.when(hit, F.col("version")), F.when(hit, F.struct("_key", "version"))).alias("_hit"),
        F.max_by(
            F.when(F.col("_stable"), F.col("version")), F.when(F.col("_stable"), key)
        ).alias("_highest"),
    )
    exact = F.coalesce("_same", "_hit")
    matched = F.when(kind == "exact", exact).otherwise(F.coalesce("_hit", "_highest"))
    chosen = best.select("crate", "spec", "kind", matched.alias("matched_version"))
    return requirements.join(chosen, ["crate", "spec"], "left")


def resolve_requirements(requirements: DataFrame, published: DataFrame) -> DataFrame:
    """Replace understood requirements by the highest stable version of the crate.

    Falls back to the highest of all versions; a requirement with operators, or
    one of an unknown crate, stays as written.
    """
    rows = published.withColumn("_key", semver.sort_key(F.col("version")))
    stable = F.col("_key").isNotNull() & F.col("_key.release")
    tops = rows.groupBy("crate").agg(
        F.max_by(F.when(stable, F.col("version")), F.when(stable, F.col("_key"))).alias("_stable"),
        F.max_by("version", F.struct("_key", "version")).alias("_any"),
    )
    kind = semver.parse_requirement(F.col("spec"))["kind"]
    simple = kind.isin("caret", "tilde", "wildcard", "exact") & (F.col("spec") != "latest")
    target = F.coalesce("_stable", "_any", F.col("spec"))
    return requirements.join(tops, "crate", "left").select(
        *requirements.columns, F.when(simple, target).otherwise(F.col("spec")).alias("resolved")
    )


def ingestion_order(popularity: DataFrame) -> DataFrame:
    """Crates by priority: the standard library first, then by downloads."""
    std = F.col("crate").isin(C.STDLIB_CRATES)
    priority = F.when(std, float("-inf")).otherwise(-F.greatest("downloads", F.lit(0)).cast("double"))
    return popularity.withColumn("priority", priority).orderBy("priority", "crate")


def popular(popularity: DataFrame, count: int) -> DataFrame:
    """The most downloaded crates; the fixed list when there is no data."""
    found = popularity.orderBy(F.desc("downloads"), "crate").limit(count)
    if found.isEmpty():
        spark = popularity.sparkSession
        rows = [(name, len(C.POPULAR_FALLBACK) - i) for i, name in enumerate(C.POPULAR_FALLBACK)]
        return spark.createDataFrame(rows[:count], "crate string, downloads bigint")
    return found


def with_downloads(files: DataFrame, popularity: DataFrame) -> DataFrame:
    """Stored crates with their download count, 0 if unknown."""
    counts = popularity.select("crate", "downloads")
    return files.join(counts, "crate", "left").withColumn(
        "downloads", F.coalesce("downloads", F.lit(0))
    )


def evictions(files: DataFrame, popularity: DataFrame, limit_bytes: int = C.CACHE_LIMIT_BYTES) -> DataFrame:
    """Stored crates to remove until the rest fits: unpopular and old ones first.

    ``files`` has ``crate``, ``size_bytes``, ``mtime``.  No task sorts the whole
    table, and crates with one download count are split among tasks.
    """
    ranked = with_downloads(files, popularity).withColumn(
        "priority",
        F.when(F.col("downloads") > 0, F.log10(F.col("downloads") + 1)).otherwise(F.lit(0.0)),
    )
    running = prefix_sums(ranked, "size_bytes", ["priority", "mtime", "crate"], "removed_bytes")
    excess = files.agg(F.sum("size_bytes")).scalar() - limit_bytes
    return running.where(F.col("removed_bytes") - F.col("size_bytes") < excess)


def cache_size(files: DataFrame) -> DataFrame:
    return files.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"))


def age_days(files: DataFrame, now: float) -> DataFrame:
    return files.withColumn("age_days", (F.lit(float(now)) - F.col("mtime")) / 86400)
