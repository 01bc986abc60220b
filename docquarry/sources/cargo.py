"""Dependencies declared in Cargo manifests and lock files."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECTIONS = ["dependencies", "dev-dependencies", "build-dependencies"]


def _requirement(spec) -> str:
    if isinstance(spec, str):
        return spec
    return str(spec["version"]) if isinstance(spec, dict) and "version" in spec else "latest"


def manifest_dependencies(text: str) -> list[tuple[str, str]]:
    """Names and requirements in all dependency sections of a manifest."""
    data = tomllib.loads(text)
    tables = [data.get(s, {}) for s in SECTIONS]
    tables.append(data.get("workspace", {}).get("dependencies", {}))
    tables += [t.get("dependencies", {}) for t in data.get("target", {}).values()]
    return sorted({(name, _requirement(spec)) for table in tables for name, spec in table.items()})


def lock_packages(text: str) -> list[tuple[str, str]]:
    """Names and exact versions of a lock file."""
    packages = tomllib.loads(text).get("package", [])
    return sorted({(p["name"], p["version"]) for p in packages if "name" in p and "version" in p})


READERS = {"cargo.toml": manifest_dependencies, "cargo.lock": lock_packages}


def reader_for(file: str):
    name = file.rsplit("/", 1)[-1].lower()
    if name not in READERS:
        raise ValueError(f"unsupported file {name!r}: expected Cargo.toml or Cargo.lock")
    return READERS[name]


def dependencies(files: DataFrame) -> DataFrame:
    """Distinct ``file``, ``dependency``, ``requirement`` of manifest rows (``file``, ``text``).

    The file name picks the reader; a file that cannot be read fails the job
    with its name.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file, text in zip(batch["file"], batch["text"]):
                try:
                    out += [(file, *pair) for pair in reader_for(file)(text)]
                except tomllib.TOMLDecodeError as problem:
                    raise ValueError(f"{file}: {problem}") from None
            yield pd.DataFrame(out, columns=["file", "dependency", "requirement"])

    rows = files.select("file", "text").mapInPandas(parse, "file string, dependency string, requirement string")
    return rows.distinct()


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Dependencies of all manifests under a path."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")
    )
    return dependencies(files)


def crate_specs(rows: DataFrame) -> DataFrame:
    """Distinct ``name@requirement`` texts in order."""
    return rows.select(F.concat_ws("@", "dependency", "requirement").alias("spec")).distinct().orderBy("spec")
