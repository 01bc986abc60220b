"""Writing entity tables: upserts, insert-ignore, keys and derived rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry import constants as C
from docquarry import schemas
from docquarry.functions import code, paths


def keep_last(df: DataFrame, keys: list[str], order: list[str], copies: str | None = None) -> DataFrame:
    """The last row per key in ``order``; ``copies`` names a count of all of them.

    An aggregation rather than a window: copies of one key are reduced before
    the shuffle, so a key that fills a third of the table is no hot spot.
    """
    return _reduce(df, keys, order, F.max_by, copies)


def keep_first(df: DataFrame, keys: list[str], order: list[str], copies: str | None = None) -> DataFrame:
    """The first row per key in ``order``."""
    return _reduce(df, keys, order, F.min_by, copies)


def _reduce(df: DataFrame, keys: list[str], order: list[str], pick, copies: str | None) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(c) for c in order])
    aggregates = [pick(F.struct(*rest), rank).alias("_row")]
    if copies:
        aggregates.append(F.count("*").alias(copies))
    counted = [copies] if copies else []
    return df.groupBy(*keys).agg(*aggregates).select(*keys, "_row.*", *counted)


def header_or_fallback(header: Column, path: Column, kind: Column) -> Column:
    """A header for every item: its own, its path's end, its kind, or a constant."""

    def filled(value: Column) -> Column:
        return F.coalesce(value, F.lit("")) != ""

    return (
        F.when(filled(header), header)
        .when(filled(path), paths.last_segment(path))
        .when(filled(kind), F.concat(kind, F.lit(" item")))
        .otherwise("Unknown item")
    )


def item_key(path: Column, stored: Column) -> Column:
    """The stored path; with a hash of the given one where the two differ.

    Cutting and tidying make equal paths of different ones, so the hash keeps
    their items apart.  The key is not longer than a path may be.
    """
    given = F.coalesce(F.trim(path), F.lit(""))
    digest = F.concat(F.lit("_"), F.substring(F.sha2(given, 256), 1, C.KEY_HASH_LENGTH))
    room = F.substring(stored, 1, C.MAX_PATH_LENGTH - C.KEY_HASH_LENGTH - 1)
    return F.when((given == "") | (given == stored), stored).otherwise(
        F.concat(F.regexp_replace(room, ":+$", ""), digest)
    )


def prepare_items(chunks: DataFrame) -> DataFrame:
    """Rows ready for the item table: valid paths, headers, text never null.

    The text is in ``doc`` or, as in tables made from rustdoc files, in ``content``;
    rows whose text comes later have neither.
    """
    text = next((c for c in ("doc", "content") if c in chunks.columns), None)
    checked = chunks.withColumn(
        "_path",
        paths.valid_path(F.col("item_path"), F.col("item_id").cast("string"), F.col("item_type")),
    )
    return checked.withColumns(
        {
            "header": header_or_fallback(F.col("header"), F.col("item_path"), F.col("item_type")),
            "item_path": item_key(F.col("item_path"), F.col("_path.path")),
            "visibility": F.coalesce("visibility", F.lit("public")),
            "deprecated": F.coalesce("deprecated", F.lit(False)),
            **({"content": F.coalesce(text, F.lit(""))} if text else {}),
        }
    ).drop("_path", "doc")


def upsert_items(stored: DataFrame | None, chunks: DataFrame, order: str = "seq") -> DataFrame:
    """Item table after new rows replace old ones with the same path in a release."""
    keys = [k for k in schemas.KEYS["items"] if k in chunks.columns]
    fresh = keep_last(prepare_items(chunks), keys, [order])
    if stored is None:
        return fresh
    kept = stored.join(fresh.select(*keys), keys, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def insert_ignore(stored: DataFrame | None, rows: DataFrame, table: str, order: list[str]) -> DataFrame:
    """Rows whose key is new; the stored row, or the first of equals, stays.

    Null key parts never collide, as in a unique index.
    """
    keys = [k for k in schemas.KEYS[table] if k in rows.columns]
    complete = F.lit(True)
    for key in keys:
        complete = complete & F.col(key).isNotNull()
    first = keep_first(rows.where(complete), keys, order)
    fresh = first.unionByName(rows.where(~complete))
    if stored is None:
        return fresh
    seen = stored.select(*keys)
    return stored.unionByName(fresh.join(seen, keys, "left_anti"), allowMissingColumns=True)


def number_modules(modules: DataFrame, key: str = "raw_id", parent: str = "raw_parent") -> DataFrame:
    """Give modules stable ids and point parents at them.

    An id is a hash of the crate and path, so no table-wide counter is needed and
    a rerun numbers the same module the same way.
    """
    numbered = modules.withColumn("id", F.xxhash64("crate", "path"))
    scope = [c for c in ("crate", "version") if c in modules.columns]
    targets = numbered.select(*scope, F.col(key).alias(parent), F.col("id").alias("parent_id"))
    return numbered.join(targets, [*scope, parent], "left").drop(parent)


def dependency_edges(dependencies: DataFrame) -> DataFrame:
    """Edges of declared dependencies (``crate``, ``dependency``, ``requirement``)."""
    return dependencies.select(
        "crate",
        F.concat_ws("::", "crate", F.lit("__dependency"), "dependency").alias("alias_path"),
        F.col("dependency").alias("actual_path"),
        F.lit(False).alias("is_glob"),
        F.concat_ws("@", "dependency", "requirement").alias("link_text"),
        F.lit("dependency").alias("link_type"),
        F.lit(1.0).alias("confidence_score"),
    )


def without_crate(items: DataFrame, crate: str) -> DataFrame:
    """Items left after a crate is cleared for re-ingestion."""
    path = F.col("item_path")
    return items.where(~((path == crate) | paths.in_crate(path, crate)))


def extract_examples(items: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """One row per stored example with its hash and a piece of context."""
    keep = [c for c in ("crate", "version", "id", "item_path", *(extra or [])) if c in items.columns]
    single = items.where(F.col("examples").isNotNull()).select(
        *keep, F.substring("content", 1, 500).alias("context"), F.inline(code.parse_examples(F.col("examples")))
    )
    return single.select(
        *keep,
        code.example_hash(F.col("code"), F.col("language")).alias("example_hash"),
        F.col("code").alias("example_text"),
        "language",
        "context",
    )


def write_table(
    df: DataFrame, path: str, partitions: tuple[str, ...] = ("crate", "version"), compression: str | None = None
) -> None:
    """Replace exactly the crate/version partitions that ``df`` holds.

    Rows are not gathered by crate first, so a large crate is written by many
    tasks.  A table without these columns is replaced as a whole.
    """
    columns = [c for c in partitions if c in df.columns]
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer = writer.option("compression", compression) if compression else writer
    (writer.partitionBy(*columns) if columns else writer).parquet(path)


def _folder(spark, path: str):
    """A path with the file system it lies on, through Spark's own settings."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark, path: str) -> bool:
    place, system = _folder(spark, path)
    return system.exists(place)


def read_table(spark, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def unsynced(items: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, with the side they are on."""
    orphans = vectors.join(items, "id", "left_anti").select("id", F.lit("orphan vector").alias("issue"))
    missing = items.join(vectors, "id", "left_anti").select("id", F.lit("missing vector").alias("issue"))
    return orphans.unionByName(missing)


def consistency(items: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row of counts that tells whether items and vectors agree."""
    sides = items.select("id", F.lit(1).alias("i"), F.lit(0).alias("v")).unionByName(
        vectors.select("id", F.lit(0).alias("i"), F.lit(1).alias("v"))
    )
    per_id = sides.groupBy("id").agg(F.sum("i").alias("i"), F.sum("v").alias("v"))
    counts = per_id.agg(
        F.sum("i").alias("items"),
        F.sum("v").alias("vectors"),
        F.count_if((F.col("i") == 0)).alias("orphans"),
        F.count_if((F.col("v") == 0)).alias("missing"),
    )
    return counts.withColumn("consistent", (F.col("orphans") == 0) & (F.col("missing") == 0))
