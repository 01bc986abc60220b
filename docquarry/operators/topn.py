"""First rows per group and ordered running totals that survive hot groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_per_group(
    df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None
) -> DataFrame:
    """The first ``n`` rows of every group, with their rank if a name is given.

    Spark trims each input partition to ``n`` rows per group before the shuffle
    as long as ``n`` stays within ``windowGroupLimitThreshold``; beyond that the
    same trimming is done here over salted groups, so one group holding a large
    part of the table is never sorted in one task.
    """
    name = rank or "_rank"
    threshold = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > threshold:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in _atomic(df)]), F.lit(256)))
        inner = W.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            salted.withColumn("_inner", F.row_number().over(inner))
            .where(F.col("_inner") <= n)
            .drop("_inner", "_salt")
        )
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    out = out.where(F.col(name) <= n)
    return out if rank else out.drop(name)


def _atomic(df: DataFrame) -> list[str]:
    plain = ("string", "bigint", "int", "double", "boolean", "timestamp", "date")
    return [name for name, kind in df.dtypes if kind in plain]


def running_total(
    df: DataFrame, value: str, order: list[str], bucket: Column, total: str = "running_total"
) -> DataFrame:
    """Running sum over the whole table in ``order``, without one global sort.

    ``bucket`` must grow with the order, such as the leading sort column rounded
    down.  Sums per bucket are small and get the offsets; rows are then sorted
    within their bucket only.
    """
    keyed = df.withColumn("_bucket", bucket)
    sums = keyed.groupBy("_bucket").agg(F.sum(value).alias("_sum"))
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset")
    )
    inside = W.partitionBy("_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        keyed.join(offsets, "_bucket")
        .withColumn(total, F.col("_offset") + F.sum(value).over(inside))
        .drop("_bucket", "_offset")
    )
