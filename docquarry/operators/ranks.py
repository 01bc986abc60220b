"""Exact order statistics and running sums over tables of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.session import staged

#: steps an interval is divided into per round
STEPS = 1_024
#: rows of a group that are sorted at last; more are narrowed down first
FEW = 4_096


def value_at(rows: DataFrame, keys: list[str], value: str, share: float, few: int = FEW) -> DataFrame:
    """One row per group: keys, n, total and the value at index ``int(n * share)`` of the group's sorted values.

    Every round counts the values of each group in steps of its interval, with
    partial sums in every task, and goes on with the step that holds the wanted
    rank; its interval then runs from its least to its greatest value.  A group is
    done when these are equal, or when few enough values are left to sort.  No list
    of values is built and no group is sorted whole.  Null and NaN values do not
    count; a null key is a key; groups without values have no row.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    clean = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(
        *[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(value).cast("double").alias("_v")
    )
    state = staged(
        clean.groupBy(*names).agg(F.count("*").alias("n"), F.sum("_v").alias("total"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        .withColumns({"wanted": F.least(F.floor(F.col("n") * share).cast("bigint"), F.col("n") - 1), "before": F.lit(0).cast("bigint"), "inside": F.col("n")})
    )
    same = lambda left, right: [left[n].eqNullSafe(right[n]) for n in names]

    def inside_of(current: DataFrame) -> DataFrame:
        here = current.select(*names, "low", "high", "wanted", "before", "n", "total")
        found = clean.alias("r").join(here.alias("s"), _all(same(_of(clean, "r", names), _of(here, "s", names))))
        return found.where(F.col("_v").between(F.col("low"), F.col("high"))).select(*[F.col(f"s.{n}") for n in names], "_v", "low", "high", "wanted", "before", "n", "total")

    done: DataFrame | None = None
    while True:
        settled = (F.col("low") == F.col("high")) | (F.col("inside") <= few)
        ready, going = state.where(settled), state.where(~settled)
        done = ready if done is None else done.unionByName(ready)
        if going.isEmpty():
            break
        part = (F.col("_v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        counted = (
            inside_of(going).withColumn("step", F.least(F.floor(part * STEPS), F.lit(STEPS - 1)))
            .groupBy(*names, "wanted", "before", "n", "total", "step")
            .agg(F.count("*").alias("inside"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        )
        # at most 1,024 rows a group
        up_to = Window.partitionBy(*names).orderBy("step")
        placed = counted.withColumn("past", F.col("before") + F.sum("inside").over(up_to)).where((F.col("past") > F.col("wanted")) & (F.col("past") - F.col("inside") <= F.col("wanted")))
        state = staged(placed.withColumn("before", F.col("past") - F.col("inside")).select(*state.columns))
    equal = done.where("low = high").select(*names, "n", "total", F.col("low").alias("value"))
    nth = F.row_number().over(Window.partitionBy(*names).orderBy("_v"))
    sorted_ = inside_of(done.where("low < high")).withColumn("_nth", nth).where(F.col("_nth") == F.col("wanted") - F.col("before") + 1)
    out = equal.unionByName(sorted_.select(*names, "n", "total", F.col("_v").alias("value")))
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "n", "total", "value")


def _of(df: DataFrame, alias: str, names: list[str]) -> dict[str, Column]:
    return {n: F.col(f"{alias}.{n}") for n in names}


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for condition in conditions:
        out = out & condition
    return out


def prefix_sums(df: DataFrame, value: str, order: list[str], total: str = "running_total", parts: int | None = None) -> DataFrame:
    """Running sum of ``value`` over the whole table in ``order``.

    Rows are dealt out by ranges of the whole order, with splitters from a sample,
    so many equal leading values are split by what follows.  Each range is summed
    up in a task of its own and moved by the sum of the ranges before it; only one
    number per range reaches the driver, as many as there are tasks.
    """
    spark = df.sparkSession
    count = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = staged(df.repartitionByRange(count, *order).withColumn("_range", F.spark_partition_id()))
    sums = sorted((r["_range"], r["_sum"] or 0) for r in ranged.groupBy("_range").agg(F.sum(value).alias("_sum")).collect())
    before, moved = 0, []
    for number, size in sums:
        moved.append((number, before))
        before += size
    kind = ranged.select(F.sum(value).alias("s")).schema["s"].dataType.simpleString()
    offsets = spark.createDataFrame(moved, f"_range int, _before {kind}")
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(F.broadcast(offsets), "_range")  # a row per range
        .withColumn(total, F.col("_before") + F.col("_inside")).drop("_range", "_before", "_inside")
    )
