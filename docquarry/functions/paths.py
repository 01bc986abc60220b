"""The ``crate::module::Name`` path algebra."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry import constants as C


def segments(path: Column) -> Column:
    return F.split(path, "::")


def last_segment(path: Column) -> Column:
    return F.split_part(path, F.lit("::"), F.lit(-1))


def crate_of(path: Column) -> Column:
    return F.split_part(path, F.lit("::"), F.lit(1))


def parent_of(path: Column) -> Column:
    """Everything before the last ``::``; null for a root."""
    parts = segments(path)
    return F.when(
        F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "::")
    )


def depth_of(path: Column) -> Column:
    """0 for a crate root."""
    return F.size(segments(path)) - 1


def in_crate(path: Column, crate: str) -> Column:
    return path.startswith(f"{crate}::")


def in_module(path: Column, module: str) -> Column:
    """The module itself or anything below it."""
    return (path == module) | path.startswith(f"{module}::")


def contains_module(path: Column, module: str) -> Column:
    """A module anywhere in the path, not the module itself."""
    return F.lower(path).contains(f"::{module}::".lower())


def join_path(parts: Column, name: Column) -> Column:
    """Join path parts; the name is appended only when the parts lack it."""
    has_parts = F.coalesce(F.size(parts), F.lit(0)) > 0
    named = F.coalesce(name, F.lit("")) != ""
    lacks = ~F.coalesce(F.array_contains(parts, name), F.lit(False))
    return (
        F.when(has_parts & named & lacks, F.concat_ws("::", parts, name))
        .when(has_parts, F.array_join(parts, "::"))
        .when(named, name)
        .otherwise("unknown")
    )


def normalize_parts(parts: Column) -> Column:
    """Trim parts, turn hyphens into underscores and drop empty ones."""
    tidy = F.transform(parts, lambda p: F.replace(F.trim(p), F.lit("-"), F.lit("_")))
    return F.filter(tidy, lambda p: p != "")


def sanitize(path: Column) -> Column:
    """Make a path out of free text: punctuation to underscores, tidy segments."""
    flat = F.regexp_replace(path, C.PATH_PUNCTUATION, "_")
    flat = F.regexp_replace(flat, "_{2,}", "_")
    parts = F.transform(F.split(flat, "::"), lambda s: F.regexp_replace(s, "^_+|_+$", ""))
    joined = F.array_join(F.filter(parts, lambda s: s != ""), "::")
    return F.when(joined.rlike("^[^\\p{L}_]"), F.concat(F.lit("_"), joined)).otherwise(joined)


def valid_path(path: Column, item_id: Column, kind: Column) -> Column:
    """``struct<path, used_fallback>``: a storable path for every row.

    Generated names hash with ``xxhash64``, so a rerun gives the same path.
    """
    text = F.trim(path)
    has_id = F.coalesce(F.trim(item_id), F.lit("")) != ""
    has_kind = F.coalesce(F.trim(kind), F.lit("")) != ""
    cut = F.when(
        F.length(text) > C.MAX_PATH_LENGTH,
        F.regexp_replace(F.substring(text, 1, C.MAX_PATH_LENGTH), ":$", ""),
    ).otherwise(text)
    clean = sanitize(cut)

    def made_up(prefix: str, *source: Column) -> Column:
        digest = F.regexp_replace(F.xxhash64(*source).cast("string"), "-", "")
        return F.concat(F.lit(prefix), digest)

    empty = (
        F.when(has_id & has_kind, F.concat_ws("::", kind, item_id))
        .when(has_id, F.concat(F.lit("item::"), item_id))
        .when(has_kind, F.concat(kind, made_up("::unknown_", path)))
        .otherwise(made_up("unknown::item_", path, item_id, kind))
    )
    broken = (
        F.when(has_id, F.concat(F.lit("sanitized::"), item_id))
        .when(has_kind, F.concat(kind, made_up("::path_", cut)))
        .otherwise(made_up("invalid::path_", cut))
    )

    def result(value: Column, fallback: bool) -> Column:
        return F.struct(value.alias("path"), F.lit(fallback).alias("used_fallback"))

    return (
        F.when(F.coalesce(text, F.lit("")) == "", result(empty, True))
        .when(text == "crate", result(text, False))
        .when(cut.rlike(C.VALID_PATH), result(cut, False))
        .when(clean.rlike(C.VALID_PATH), result(clean, True))
        .otherwise(result(broken, True))
    )


def kind_from_path(path: Column) -> Column:
    """Guess an item kind from words in its path."""
    lowered = F.lower(path)
    out = None
    for fragments, kind in C.PATH_KIND_FRAGMENTS:
        hit = lowered.contains(fragments[0])
        for other in fragments[1:]:
            hit = hit | lowered.contains(other)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("unknown")


def normalize_kind(kind: Column) -> Column:
    """Map a raw kind to the stored one; the first known fragment decides."""
    lowered = F.lower(kind)
    out = None
    for fragment, stored in C.KIND_FRAGMENTS:
        hit = lowered.contains(fragment)
        out = F.when(hit, stored) if out is None else out.when(hit, stored)
    return out.otherwise(lowered)
