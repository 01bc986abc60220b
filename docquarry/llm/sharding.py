"""Shards of near-equal bytes by histogram sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.llm.common import query, small_table, table, whole_text
from docquarry.session import staged

#: a key has 28 bits of the text's hash, then 35 of the id's: equal texts lie together
TEXT_BITS, KEY_BITS = 28, 63
#: bits of the key that a probe fixes, by round
ROUNDS = (13, 21, 28, 36, 45, 54, 63)
#: a splitter may miss its target by this part of a shard
TOLERANCE = 0.01


def _prefix(bits: int) -> Column:
    return F.shiftright("key", KEY_BITS - bits)


def shard_by_bytes(
    docs: DataFrame,
    shards: int = 16,
    tolerance: float = TOLERANCE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot.

    ``size`` is the text's UTF-8 length plus 1 (a null text is empty).  Rows are
    sorted by a key of text hash and id hash and cut into ``shards`` runs of
    near-equal size: a splitter misses its target by at most ``tolerance`` of a
    shard or half of the one document it falls in.  Equal texts are neighbours,
    so a group is cut only where it weighs more than the tolerance.  Slots count
    from 0 in key order without gaps.  Null ids hash like any other value, rows
    that repeat in full have slots side by side, an empty table gives no rows,
    and other columns are ignored.

    Round 1 counts exact bytes and rows below 8,192 evenly spread probes.  Every
    later round puts finer probes only into intervals that hold a splitter's
    target and weigh more than the tolerance, or hold many more rows than their
    share (one hot text), so what the driver gathers is bounded by the number of
    probes and not by the rows.  Then one exchange sorts each interval by itself;
    the counts below an interval give its first slot.
    """
    spark = docs.sparkSession
    body = whole_text(text_col)
    rows = staged(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.shiftleft(F.shiftrightunsigned(F.xxhash64(body), 64 - TEXT_BITS), KEY_BITS - TEXT_BITS)
            .bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 64 - (KEY_BITS - TEXT_BITS)))
            .alias("key"),
        )
    )

    def counted(part: DataFrame, bits: int) -> list[tuple[int, int, int, int]]:
        found = part.groupBy(_prefix(bits).alias("p")).agg(F.sum("size").alias("b"), F.count("*").alias("n"))
        return [(r.p, bits, r.b, r.n) for r in found.collect()]

    intervals = counted(rows, ROUNDS[0])
    total = sum(b for _, _, b, _ in intervals)
    most_rows = max(100_000, 8 * sum(n for *_, n in intervals) // (1 << ROUNDS[0]))
    targets = [total * i / shards for i in range(1, shards)]

    def start(interval: tuple[int, int, int, int]) -> int:
        return interval[0] << (KEY_BITS - interval[1])

    for bits, finer in zip(ROUNDS, ROUNDS[1:]):
        intervals.sort(key=start)
        below, todo, at = 0, [], 0
        for interval in intervals:
            _, fixed, b, n = interval
            while at < len(targets) and targets[at] <= below:
                at += 1
            holds = at < len(targets) and targets[at] < below + b
            if fixed == bits and n > 1 and (holds and b > tolerance * total / shards or n > most_rows):
                todo.append(interval)
            below += b
        if not todo:
            continue
        chosen = small_table(spark, [(i[0],) for i in todo], ["chosen"])
        part = rows.join(F.broadcast(chosen), _prefix(bits) == F.col("chosen"))
        gone = set(todo)
        intervals = [i for i in intervals if i not in gone] + counted(part, finer)
    intervals.sort(key=start)

    # every target takes the nearer end of its interval
    ends, below = [], 0
    for interval in intervals:
        ends.append((start(interval), below))
        below += interval[2]
    ends.append((1 << KEY_BITS, below))
    splitters, at = [], 0
    for target in targets:
        while at + 1 < len(ends) and ends[at + 1][1] <= target:
            at += 1
        near = at + 1 if at + 1 < len(ends) and ends[at + 1][1] - target < target - ends[at][1] else at
        splitters.append(ends[near][0])

    by_level: dict[int, list[tuple[int, int, int, int]]] = {}
    shard, first = 0, 0
    for interval in intervals:
        at_key = start(interval)
        while shard < len(splitters) and splitters[shard] <= at_key:
            shard, first = shard + 1, 0
        by_level.setdefault(interval[1], []).append((interval[0], at_key, shard, first))
        first += interval[3]
    placed = rows
    names = []
    for bits, found in sorted(by_level.items()):
        leaf = small_table(spark, found, [f"{n}_{bits}" for n in ("prefix", "interval", "shard", "first")])
        placed = placed.join(F.broadcast(leaf), _prefix(bits) == F.col(f"prefix_{bits}"), "left")
        names.append(bits)
    pick = {n: F.coalesce(*[F.col(f"{n}_{b}") for b in names]) if names else F.lit(None).cast("long") for n in ("interval", "shard", "first")}
    placed = placed.select("id", "size", "text_crc32", "key", *[c.alias(n) for n, c in pick.items()])
    order = Window.partitionBy("interval").orderBy("key", "id", "text_crc32", "size")
    return placed.select(
        F.col("id").alias(id_col), "size", "text_crc32",
        F.col("shard").cast("int").alias("shard"),
        (F.col("first") + F.row_number().over(order) - 1).cast("long").alias("slot"),
    )


@query("op5_shards")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_by_bytes(table(spark, sf_dir, "documents"), 16)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
