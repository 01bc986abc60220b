"""Interaction of filters: truth-table survival words and carry-save positional popcounts."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import query, table, whole_text
from docquarry.session import staged

#: what stands between words
BLANKS = "[\\x20\\x09-\\x0D]+"
FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
FULL = (1 << SUBSETS) - 1
#: (part, quality, toxic) groups a task holds before it hands them on
HELD = 4_096


def truth_word(nth: int) -> int:
    """The truth table of "the subset lacks filter ``nth``": bit s is set when it does."""
    return sum(1 << s for s in range(SUBSETS) if not s >> nth & 1)


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many words have each of the 32 bits set.

    Carry-save adders take three words of one weight and leave a sum of that weight
    and a carry of twice the weight, in all lanes at once.  What is left, two short
    vectors per weight, is unpacked bit by bit.
    """
    totals = np.zeros(SUBSETS, dtype=np.int64)
    weight, level = 1, np.ascontiguousarray(words, dtype=np.uint32)
    while len(level):
        carries = []
        while len(level) >= 96:
            third = len(level) // 3
            a, b, c, rest = level[:third], level[third : 2 * third], level[2 * third : 3 * third], level[3 * third :]
            either = a ^ b
            carries.append((a & b) | (either & c))
            level = np.concatenate((either ^ c, rest))
        bits = np.unpackbits(level.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        totals += weight * bits.sum(axis=0, dtype=np.int64)
        level, weight = (np.concatenate(carries) if carries else level[:0]), weight * 2
    return totals


def fails(text: Column, words: Column) -> dict[str, Column]:
    """What fails the filters that see one text alone."""
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 3 * F.char_length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def survival_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Rows (id, part, word), one for each document: bit s of ``word`` says that it survives the subset s of the filters.

    Filter number f is in subset s when bit f of s is set; the word is the AND of
    the truth-table words of all filters the document fails.  Filter E fails when a
    smaller id has the identical text: texts meet as SHA-256, reduced to the
    smallest id before they are moved, and only hashes that several ids have are
    joined back; that join has no aggregation behind it, so Spark can split a hot
    hash.  A null id is neither smaller nor larger than another, rows that repeat
    an id don't fail for each other, a null part is the empty string.
    """
    text, words = F.col("text"), F.col("words")
    single = fails(text, words)
    word = F.lit(FULL).cast("long")
    for nth, name in enumerate(FILTERS[:4]):
        word = word.bitwiseAND(F.when(single[name], F.lit(truth_word(nth))).otherwise(F.lit(FULL)))
    texts = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), whole_text(text_col).alias("text")
    )
    # a split leaves empty strings at the ends only
    texts = texts.withColumn("words", F.array_remove(F.split("text", BLANKS), ""))
    rows = staged(texts.select("id", "part", F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), word.alias("word")))
    first = (
        rows.where(F.col("id").isNotNull())
        .groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"))
        .where(F.col("first") < F.col("last")).select(F.col("digest").alias("same"), "first")
    )
    later = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    return rows.join(first, F.col("digest") == F.col("same"), "left").select(
        "id", "part", F.when(later, F.col("word").bitwiseAND(F.lit(truth_word(4)))).otherwise(F.col("word")).alias("word")
    )


def subset_survivors(words: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows (part, subset, n, good, toxic): documents that survive a subset of filters, all and by label.

    Every task adds its words up by carry-save counters for each (part, label), so
    what is shuffled is a few numbers per task, whatever the size of a part.  Of
    several labels of one id the largest holds; without a label a document is
    neither good nor toxic.
    """
    marks = labels.groupBy(F.col(id_col).alias("label_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = words.join(marks, F.col("id") == F.col("label_id"), "left").select(
        "part", "word", (F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0)) + F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0)) * 2).alias("label")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}

        def out() -> pa.RecordBatch:
            keys, cells = list(held), np.stack(list(held.values()))
            n, label = len(keys), np.array([k[1] for k in keys])[:, None]
            return pa.record_batch(
                {
                    "part": pa.array([k[0] for k in keys for _ in range(SUBSETS)], pa.string()),
                    "subset": pa.array(np.tile(np.arange(SUBSETS, dtype=np.int32), n)),
                    "n": pa.array(cells.ravel()),
                    "good": pa.array((cells * (label & 1)).ravel()),
                    "toxic": pa.array((cells * (label >> 1)).ravel()),
                }
            )

        for batch in batches:
            parts = batch.column(0).dictionary_encode()
            names, code = parts.dictionary.to_pylist(), parts.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            group = code * 4 + batch.column(2).to_numpy(zero_copy_only=False)
            bits = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint32)
            order = np.argsort(group, kind="stable")
            group, bits = group[order], bits[order]
            starts = np.flatnonzero(np.diff(group, prepend=-1))
            for at, end in zip(starts, [*starts[1:], len(group)]):
                key = names[group[at] // 4], int(group[at] % 4)
                held[key] = held.get(key, 0) + positional_popcount(bits[at:end])
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    counted = rows.mapInArrow(count, "part string, subset int, n long, good long, toxic long")
    return counted.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def steps() -> list[tuple[str, int, int, int, int]]:
    """(filter_order, step, filter number, subset before, subset after) of all orders."""
    rows = []
    for order in itertools.permutations(range(len(FILTERS))):
        before = 0
        for step, nth in enumerate(order, 1):
            rows.append(("".join(FILTERS[i] for i in order), step, nth, before, before | 1 << nth))
            before |= 1 << nth
    return rows


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step, with counts of documents.

    kept, removed, redundant (fails, but removed earlier), unique_fails (fails this
    filter alone), good_lost and toxic_lost (removed here, by label), shapley (the
    filter's removals summed over all orders).  All of them are differences of
    subset survivors.  Empty tables give no rows; a part is one row for each step,
    also where nothing is removed.  Columns besides the three named are not read.
    """
    words = survival_words(docs, id_col, text_col, part_col)
    cells = subset_survivors(words, labels, id_col)
    # 32 rows a part, by construction
    parts = cells.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", "n", "good", "toxic"))).alias("c"))

    def lives(subset: Column | int, kind: str = "n") -> Column:
        return F.get("c", F.lit(subset) if isinstance(subset, int) else subset)[kind]

    def shapley(nth: int) -> Column:
        others = [s for s in range(SUBSETS) if not s >> nth & 1]
        times = {s: factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count()) for s in others}
        return sum((times[s] * (lives(s) - lives(s | 1 << nth)) for s in others), F.lit(0)).cast("long")

    parts = parts.select("part", "c", F.array(*[shapley(i) for i in range(len(FILTERS))]).alias("shapleys"))
    spark = docs.sparkSession
    packed = ";".join(":".join(map(str, row)) for row in steps())
    cell = F.split("row", ":")
    orders = spark.range(1).select(F.explode(F.split(F.lit(packed), ";")).alias("row")).select(
        cell[0].alias("filter_order"), *[cell[i].cast("int").alias(n) for i, n in enumerate(("step", "nth", "before", "after"), 1)]
    )
    steps_of = parts.select("part", "c", "shapleys", F.explode(F.array(*[F.lit(i) for i in range(len(FILTERS))])).alias("own")).join(
        F.broadcast(orders), F.col("own") == F.col("nth")
    )
    before, after = F.col("before"), F.col("after")
    removed = lives(before) - lives(after)
    single = F.element_at(F.array(*[F.lit(1 << i) for i in range(len(FILTERS))]), F.col("nth") + 1)
    failing = lives(0) - lives(single)
    rest = F.lit(SUBSETS - 1) - single
    return steps_of.select(
        "part", "filter_order", "step",
        lives(after).alias("kept"),
        removed.alias("removed"),
        (failing - removed).alias("redundant"),
        (lives(rest) - lives(SUBSETS - 1)).alias("unique_fails"),
        (lives(before, "good") - lives(after, "good")).alias("good_lost"),
        (lives(before, "toxic") - lives(after, "toxic")).alias("toxic_lost"),
        F.get("shapleys", F.col("nth")).alias("shapley"),
    )


ORACLE = r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS lo FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
f AS (SELECT doc_id, part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws),
    100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > lo, false)] AS fails FROM w),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, fails, list_sum(list_transform(fails, lambda x: CAST(x AS INTEGER))) AS many, count(*) AS n,
    count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
i AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT o, i AS step, o[i] AS f, o[1:i - 1] AS earlier FROM o, i),
r AS (SELECT part, o, step, f, n, good, toxic, fails[f] AS bad, many = 1 AS alone,
    len(list_filter(earlier, lambda x: fails[x])) > 0 AS gone FROM s, m),
g AS (SELECT part, o, step, f, sum(n) FILTER (WHERE NOT gone AND NOT bad) AS kept, sum(n) FILTER (WHERE NOT gone AND bad) AS removed,
    sum(n) FILTER (WHERE gone AND bad) AS redundant, sum(n) FILTER (WHERE bad AND alone) AS unique_fails,
    sum(good) FILTER (WHERE NOT gone AND bad) AS good_lost, sum(toxic) FILTER (WHERE NOT gone AND bad) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, CAST(step AS INTEGER) AS step,
  CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM g"""


@query("op13_filter_audit", ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))
