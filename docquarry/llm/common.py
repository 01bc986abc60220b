"""Reading inputs, word rules and small tables shared by the operators."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.catalog.registry import Query

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: one word: no blank, tab or line control
WORD = "[^\\x20\\x09-\\x0D]+"


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query of this subpackage, with its SQL where there is one."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % parts, F.lit(0))


def _give_back() -> None:
    """Return freed memory of this process to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def giving_back(work: Callable[[Iterator[Any]], Iterator[Any]]) -> Callable[[Iterator[Any]], Iterator[Any]]:
    """``work`` over the batches of a partition, whose memory goes back to the system at the end.

    A Python worker lives on after its task; what it keeps adds to the memory
    that the executor needs in all later steps.
    """

    @functools.wraps(work)
    def run(parts: Iterator[Any]) -> Iterator[Any]:
        yield from work(parts)
        _give_back()

    return run


def small_table(spark: SparkSession, rows: Iterable[tuple[int, ...]], names: list[str]) -> DataFrame:
    """A table of whole numbers from the driver, built on the JVM side.

    For tables with a proven size bound only.
    """
    packed = ";".join(":".join(map(str, r)) for r in rows)
    cells = F.split("row", ":")
    return (
        spark.range(1)
        .select(F.explode(F.split(F.lit(packed), ";")).alias("row"))
        .where(F.col("row") != "")
        .select(*[F.element_at(cells, i + 1).cast("long").alias(n) for i, n in enumerate(names)])
    )
