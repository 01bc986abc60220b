"""Semantic versions as orderable Columns.

A version becomes a struct whose natural Spark ordering is semver precedence:
three numbers, a release flag, then pre-release identifiers in which numbers
sort before words.  ``max_by(version, key)`` then needs no Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry import constants as C


def is_semver(version: Column) -> Column:
    return version.rlike(C.SEMVER)


def _part(version: Column, group: int) -> Column:
    return F.regexp_extract(version, C.SEMVER, group)


def is_prerelease(version: Column) -> Column:
    return is_semver(version) & (_part(version, 4) != "")


def _key(major: Column, minor: Column, patch: Column, release: Column, labels: Column) -> Column:
    return F.struct(
        major.alias("major"),
        minor.alias("minor"),
        patch.alias("patch"),
        release.alias("release"),
        labels.alias("labels"),
    )


def _no_labels() -> Column:
    return F.array().cast("array<struct<word:boolean,number:bigint,text:string>>")


def sort_key(version: Column) -> Column:
    """Orderable precedence key; null for text that is no semantic version."""
    label = _part(version, 4)
    labels = F.transform(
        F.split(label, r"\."),
        lambda p: F.struct(
            (~p.rlike(r"^\d+$")).alias("word"),
            F.when(p.rlike(r"^\d+$"), p.cast("bigint")).otherwise(F.lit(0)).alias("number"),
            F.when(p.rlike(r"^\d+$"), "").otherwise(p).alias("text"),
        ),
    )
    numbers = [F.when(is_semver(version), _part(version, i)).try_cast("bigint") for i in (1, 2, 3)]
    return F.when(
        is_semver(version),
        _key(*numbers, (label == ""), F.when(label == "", _no_labels()).otherwise(labels)),
    )


def next_major(key: Column) -> Column:
    """The lowest release of the next major version."""
    zero = F.lit(0).cast("bigint")
    return F.when(
        key.isNotNull(), _key(key["major"] + 1, zero, zero, F.lit(True), _no_labels())
    )


def next_minor(key: Column) -> Column:
    zero = F.lit(0).cast("bigint")
    return F.when(
        key.isNotNull(), _key(key["major"], key["minor"] + 1, zero, F.lit(True), _no_labels())
    )


def parse_requirement(spec: Column) -> Column:
    """``struct<kind, version>`` of a dependency requirement."""
    text = F.trim(spec)
    rest = F.trim(F.substring(text, 2, 1000))
    full = (
        F.when(text.rlike(r"^\d+$"), F.concat(text, F.lit(".0.0")))
        .when(text.rlike(r"^\d+\.\d+$"), F.concat(text, F.lit(".0")))
        .otherwise(text)
    )

    def result(kind: str, version: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), version.alias("version"))

    return (
        F.when(text.startswith("^"), result("caret", rest))
        .when(text.startswith("~"), result("tilde", rest))
        .when(text.contains("*"), result("wildcard", text))
        .when(text.rlike("[<>,]"), result("complex", text))
        .when(is_semver(full), result("exact", full))
        .otherwise(result("unknown", text))
    )
