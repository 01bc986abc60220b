"""Pattern search through postings of trigrams.

A pattern that must contain some literal text can only match where all trigrams of
that text occur.  The postings give the ids of those items, and the pattern itself
runs on them alone.  Patterns without such a text are searched by a whole scan.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators.search import regex_search
from docquarry.plans.spread import pieces

try:
    from re import _constants as ops
    from re import _parser as parser
except ImportError:  # the parser is not a documented part of Python
    ops = parser = None

#: ids that become a list in the scan's filter, so that row groups are skipped; more are joined
LISTED_IDS = 10_000
#: text of the items whose ids are gathered in one row of a trigram
PIECE_BYTES = 4_000_000
#: files at most that the rows of one trigram are dealt out to
SPREAD = 16

#: ("all", parts), ("any", parts), ("text", literal); None where nothing is known
Needed = tuple | None


def needed_text(pattern: str) -> Needed:
    """What every match of ``pattern``, ignoring case, must contain.

    Only constructs that mean the same in both regex languages are read: literals,
    groups, alternatives and repetitions of at least one.  Anything else counts as
    unknown, and a pattern that could be read differently gives None.
    """
    differs = r"&&|\\[vhHRXQEGpPNk]|\(\?(?!:)|\[[^\]]*\["
    if parser is None or re.search(differs, pattern):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            tree = parser.parse(pattern)
    except Exception:  # Java may still accept it
        return None
    return _sequence(tree)


def _sequence(tree) -> Needed:
    parts, run = [], ""

    def close() -> None:
        nonlocal run
        if len(run) >= 3:
            parts.append(("text", _folded(run)))
        run = ""

    for op, value in tree:
        if op is ops.LITERAL:
            run += chr(value)
            continue
        close()
        if op is ops.SUBPATTERN:
            parts.append(_sequence(value[3]))
        elif op is ops.BRANCH:
            ways = [_sequence(way) for way in value[1]]
            parts.append(None if None in ways else ("any", ways))
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and value[0] >= 1:
            parts.append(_sequence(value[2]))
    close()
    parts = [p for p in parts if p is not None]
    return ("all", parts) if parts else None


def _folded(text: str) -> str:
    """Capitals A-Z as small letters, which is all that ignoring case means to the pattern."""
    return text.translate({c: c + 32 for c in range(65, 91)})


def grams(text: str) -> np.ndarray:
    """Distinct trigrams of the folded text; three code points of 21 bits in a long."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    codes = np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
    return np.unique((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]) if len(codes) > 2 else np.zeros(0, np.int64)


def wanted_grams(needed: tuple) -> set[int]:
    if needed[0] == "text":
        return set(grams(needed[1]).tolist())
    return set().union(*[wanted_grams(p) for p in needed[1]])


def _holds(needed: tuple) -> Column:
    """Whether the array ``found`` of trigrams satisfies what is needed."""
    if needed[0] == "text":
        own = grams(needed[1]).tolist()
        return F.size(F.array_intersect("found", F.array(*[F.lit(g) for g in own]))) == len(own)
    out = None
    for part in needed[1]:
        one = _holds(part)
        out = one if out is None else (out & one if needed[0] == "all" else out | one)
    return out


def _postings(numbers: list[int], texts: list[list[str | None]]) -> pa.RecordBatch:
    """One row per trigram of some items: the ids of those that have it."""
    own = [np.unique(np.concatenate([grams(t or "") for t in row])) for row in texts]
    found = np.concatenate([*own, np.zeros(0, np.int64)])
    ids = np.repeat(np.array(numbers, dtype=np.int64), [len(g) for g in own])
    order = np.argsort(found, kind="stable")
    found, ids = found[order], ids[order]
    starts = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1]))) if len(found) else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(found)).astype(np.int32)), pa.array(ids))
    return pa.record_batch({"gram": pa.array(found[starts]), "ids": lists})


@dataclass
class TrigramIndex:
    """Postings (gram, ids) in order of the grams, over path and text of each item."""

    spark: SparkSession
    path: str

    @classmethod
    def write(cls, items: DataFrame, path: str, files: int | None = None) -> TrigramIndex:
        """Postings of all items with an ``id``; null texts have none.

        A row has the ids of some thousand items at most, so a trigram that every
        item has is many rows.  They are dealt out by gram and first id: such a
        trigram lies in up to ``SPREAD`` files, and a search reads the row groups
        of its trigrams.  Texts are read and cut into trigrams once.
        """
        spark = items.sparkSession

        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in pieces(batches, "content", PIECE_BYTES):
                yield _postings(part.column(0).to_pylist(), list(zip(part.column(1).to_pylist(), part.column(2).to_pylist())))

        rows = items.where("id IS NOT NULL").select(F.col("id").cast("bigint"), "item_path", "content").mapInArrow(post, "gram bigint, ids array<bigint>")
        count = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        dealt = rows.repartition(count, F.col("gram"), F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(SPREAD)))
        dealt.sortWithinPartitions("gram").write.mode("overwrite").parquet(path)
        return cls(spark, path)

    def candidates(self, needed: tuple) -> DataFrame:
        """Ids of the items that have all trigrams they need."""
        wanted = wanted_grams(needed)
        postings = self.spark.read.schema("gram bigint, ids array<bigint>").parquet(self.path).where(F.col("gram").isin(sorted(wanted)))
        # at most as many trigrams as the pattern has
        single = postings.select("gram", F.explode("ids").alias("id"))
        return single.groupBy("id").agg(F.collect_set("gram").alias("found")).where(_holds(needed)).select("id")

    def narrowed(self, items: DataFrame, pattern: str) -> DataFrame:
        """The items a pattern can match at all."""
        needed = needed_text(pattern)
        if needed is None:
            return items
        ids = self.candidates(needed)
        some = [r.id for r in ids.limit(LISTED_IDS + 1).collect()]
        if len(some) <= LISTED_IDS:
            return items.where(F.col("id").isin(some)) if some else items.limit(0)
        return items.join(ids, "id", "left_semi")

    def search(self, items: DataFrame, pattern: str, k: int = 10, **options) -> DataFrame:
        """The rows of ``search.regex_search``."""
        return regex_search(self.narrowed(items, pattern), pattern, k, **options)
