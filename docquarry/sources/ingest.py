"""From rustdoc files to stored tables that a ``Library`` searches.

Files are parsed once; every entity table of a release is built from the staged
entries and merged with what is stored of that release.  Other releases are
neither read nor written: tables are partitioned by crate and version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docquarry import schemas
from docquarry.functions import code, paths
from docquarry.plans.library import TABLES
from docquarry.session import staged, staged_in_turn, temporary
from docquarry.sources import embedding, rustdoc, store

RELEASE = ["crate", "version"]
#: tables an ingestion writes, and the table of unique keys each one follows;
#: ``crates`` comes last: a release counts as stored once it is listed there
WRITTEN = {
    "modules": ["path"],
    "items": ["item_path"],
    "reexports": schemas.KEYS["reexports"][2:],
    "examples": schemas.KEYS["example_items"][2:],
    # a type may implement one trait with several arguments; the signature tells them apart
    "impls": schemas.KEYS["trait_impls"][2:] + ["impl_signature", "is_definition"],
    "methods": schemas.KEYS["methods"][2:],
    "associated": schemas.KEYS["associated_items"][2:],
    "constraints": schemas.KEYS["generic_constraints"][2:],
    "crates": [],
}

#: tables whose rows are built with one row per key
UNIQUE = ("items", "examples", "crates")
#: bytes of text that are shuffled at a time, and the most slices of all texts
SLICE_BYTES, MOST_SLICES = 128 << 20, 8
#: ``row_id`` has the number of the task that wrote a row above so many bits
TASK_BITS = 33


def shaped(df: DataFrame, schema: StructType) -> DataFrame:
    """Exactly the columns of a stored table; those ``df`` lacks are null."""
    have = set(df.columns)
    return df.select(
        *[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def item_rows(files: rustdoc.Parsed, places: DataFrame) -> DataFrame:
    """One row per item path of a release, without texts, with an id that a rerun gives again.

    Members lie under their container (``rustdoc.located_paths``).  Of items that
    still share a path the one with the largest item id stays.
    """
    rows = rustdoc.with_places(rustdoc.item_heads(files.entries), places)
    kept = store.upsert_items(None, rows, "item_id")
    return kept.withColumn("id", F.xxhash64("crate", "item_path"))


def slices(files: rustdoc.Parsed) -> list[Column]:
    """Conditions on ``row_id`` that deal out the index to a few slices of texts.

    A slice is what some neighbouring tasks have parsed, so a reader of it skips
    the row groups of all others.
    """
    task = F.shiftright("row_id", TASK_BITS).alias("task")
    found = files.index.groupBy(task).agg(F.sum(F.octet_length("docs")).alias("size")).collect()
    sizes = sorted((r["task"], r["size"] or 0) for r in found)
    step = max(SLICE_BYTES, -(-sum(size for _, size in sizes) // MOST_SLICES))
    starts, held = [], step
    for number, size in sizes:
        if held >= step:
            starts.append(number << TASK_BITS)
            held = 0
        held += size
    row = F.col("row_id")
    bounds = zip(starts, [*starts[1:], None])
    return [row >= start if end is None else (row >= start) & (row < end) for start, end in bounds] or [F.lit(True)]


def stored_items(files: rustdoc.Parsed, places: DataFrame, model: Callable | None = None) -> DataFrame:
    """The item table with texts and vectors, staged: examples start from it too.

    Texts stay behind until repeated paths are gone; then each moves once, to its
    row, one slice after the other.
    """
    heads = staged(item_rows(files, places), compression=rustdoc.CODEC)
    texts = files.index.where(F.coalesce("docs", F.lit("")) != "").select("row_id", "docs")

    def filled(within: Column) -> DataFrame:
        rows = rustdoc.with_texts(heads.where(within).join(texts.where(within), "row_id", "left"))
        return shaped(embedding.embed(rows, embedding.item_text(), model), TABLES["items"])

    return staged_in_turn(map(filled, slices(files)), compression=rustdoc.CODEC)


def tables(files: rustdoc.Parsed, model: Callable | None = None) -> dict[str, DataFrame]:
    """The entity tables of the given files, each with its stored columns."""
    places = staged(rustdoc.located_paths(files), compression=rustdoc.CODEC)
    return tables_of_entries(files, places) | tables_of_texts(stored_items(files, places, model), model)


def tables_of_entries(files: rustdoc.Parsed, places: DataFrame) -> dict[str, DataFrame]:
    """The tables that hold no texts."""
    modules = rustdoc.modules_table(files).withColumnsRenamed({"item_id": "raw_id", "parent_id": "raw_parent"})
    releases = files.index.select(*RELEASE).distinct()
    found = {
        "modules": store.number_modules(modules),
        "reexports": rustdoc.reexports(files).unionByName(_link_rows(files), allowMissingColumns=True),
        "impls": rustdoc.trait_rows(files),
        "methods": rustdoc.methods(files),
        "associated": rustdoc.associated_items(files),
        "constraints": rustdoc.generic_constraints(files, places),
        "crates": releases.withColumn("id", F.xxhash64(*RELEASE)),
    }
    return {name: shaped(df, TABLES[name]) for name, df in found.items()}


def tables_of_texts(items: DataFrame, model: Callable | None = None) -> dict[str, DataFrame]:
    """Items, and the examples in their texts."""
    examples = store.extract_examples(items)
    examples = store.keep_first(examples, [*RELEASE, "example_hash"], ["item_path", "example_text"])
    embedded = embedding.embed(
        examples.withColumnRenamed("id", "item_id"),
        code.embedding_text(F.col("example_text"), F.col("language"), F.col("context")),
        model,
    )
    return {"items": items, "examples": shaped(embedded, TABLES["examples"])}


def _link_rows(files: rustdoc.Parsed) -> DataFrame:
    """Documentation links in the columns of the table of re-exports."""
    return rustdoc.cross_references(files).select(
        *RELEASE,
        F.col("source_path").alias("alias_path"),
        F.col("target_path").alias("actual_path"),
        F.lit(False).alias("is_glob"),
        "link_text",
        F.lit("crossref").alias("link_type"),
        F.lit(1.0).alias("confidence_score"),
    )


def _once(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key; of several the smallest in all other plain columns."""
    rest = [f.name for f in rows.schema.fields if f.name not in keys and f.dataType.typeName() in ("string", "boolean")]
    # nulls of a key are values here, so that a rerun finds its own rows again
    return store.keep_first(rows, keys, rest or keys)


def _write(name: str, fresh: DataFrame, root: str, releases: DataFrame) -> None:
    """Swap in the partitions of one table: new rows, and the stored rows they leave."""
    spark, folder, keys = fresh.sparkSession, f"{root}/{name}", [*RELEASE, *WRITTEN[name]]
    rows = (fresh if name in UNIQUE else _once(fresh, keys)).select(*TABLES[name].fieldNames())
    with temporary(spark):
        if store.exists(spark, folder):
            rows = rows if name == "items" else staged(rows, compression=rustdoc.CODEC)  # items are staged already
            stored = store.read_table(spark, folder, TABLES[name])
            same = [F.col(f"s.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
            kept = stored.join(releases, RELEASE, "left_semi").alias("s").join(rows.alias("n"), same, "left_anti")
            rows = staged(rows.unionByName(kept.select(*rows.columns)), compression=rustdoc.CODEC)
        store.write_table(rows, folder, compression=rustdoc.CODEC)


def ingest(files: DataFrame, root: str, model: Callable | None = None) -> None:
    """Store the releases of ``files`` (``crate``, ``version``, ``text``) under ``root``.

    New rows take the place of stored ones with the same key in the same release;
    stored rows that the files do not mention stay.  A crate may come in several
    files if their item ids differ.  A file that is not JSON adds nothing.  A table's
    partitions are swapped in when all of them are written, so a run that dies leaves
    whole old or whole new partitions, and running it again ends in the same rows.

    Staged tables go as soon as no later step reads them: texts lie on disk as they
    were parsed and once in the rows of items, never in both and the stored table.
    """
    spark = files.sparkSession
    with temporary(spark) as parsing:
        parsed = rustdoc.parse(files)
        places = staged(rustdoc.located_paths(parsed), compression=rustdoc.CODEC)
        fresh = tables_of_entries(parsed, places)
        with temporary(spark):
            crates = staged(fresh.pop("crates"))
            releases = crates.select(*RELEASE)
            for name, rows in fresh.items():
                _write(name, rows, root, releases)
            items = stored_items(parsed, places, model)
            parsing.clear()
            for name, rows in tables_of_texts(items, model).items():
                _write(name, rows, root, releases)
            _write("crates", crates, root, releases)
    if not store.exists(spark, f"{root}/status"):
        # not from a Python list, which would start workers on every core for no rows
        store.write_table(shaped(spark.range(0), schemas.INGESTION_STATUS), f"{root}/status")
