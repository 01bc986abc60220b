"""Exact nearest rows over a stored layout that lets most files stay unread.

Rows are stored by their nearest of some pivot vectors and by their distance to
it.  For a query at distance d from a pivot, the triangle inequality keeps every
row whose own distance to that pivot lies outside d - r .. d + r farther away than
r.  So with the radius r of the k-th best row of a few close files, all files and
rows outside these rings are left out, and the result is still exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import vectors as vector_columns
from docquarry.functions.vectors import _matrix

#: rows the pivots are chosen from, by hash; every row is stored
SAMPLE = 4_096
#: close files that are read first, for the radius
PROBED = 2
#: relative slack for rounding in distances
SLACK = 1e-9


def choose_pivots(sample: np.ndarray, cells: int, seed: int = 1, rounds: int = 8) -> np.ndarray:
    """Centres of the sample: far-apart starts, then a few rounds of means."""
    rng = np.random.default_rng(seed)
    pivots = sample[[int(rng.integers(len(sample)))]]
    gap = ((sample - pivots[0]) ** 2).sum(axis=1)
    while len(pivots) < cells and gap.max() > 0:
        at = int(rng.choice(len(sample), p=gap / gap.sum()))
        pivots = np.vstack((pivots, sample[at]))
        gap = np.minimum(gap, ((sample - sample[at]) ** 2).sum(axis=1))
    for _ in range(rounds):
        owner = _distances(sample, pivots).argmin(axis=1)
        sizes = np.bincount(owner, minlength=len(pivots))
        sums = np.zeros_like(pivots)
        np.add.at(sums, owner, sample)
        pivots = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], pivots)
    return pivots


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((rows - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


@dataclass
class PivotLayout:
    """A stored table of rows with ``cell`` and ``to_pivot``, its pivots, and the rings each file holds."""

    spark: SparkSession
    path: str
    vector: str

    # --- writing ----------------------------------------------------------------------

    @classmethod
    def write(cls, rows: DataFrame, path: str, cells: int = 64, files: int | None = None, vector: str = "embedding", key: str = "id") -> PivotLayout:
        """Store ``rows`` by pivot and distance.

        Pivots come from at most 4,096 rows chosen by hash of the key.  Files are
        ranges of (cell, distance, hash of the key), so a cell that holds a third of
        all rows, or one vector that repeats, is spread over many files.  Rows
        without a vector, or of another width than most, are kept in cell -1, which
        no search reads.
        """
        spark = rows.sparkSession
        whole = rows.where(F.col(vector).isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v)) & (F.size(vector) > 0))
        # widths are few; the most frequent one counts
        widths = whole.groupBy(F.size(vector).alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
        width = widths[0].width if widths else 0
        chosen = whole.where(F.size(vector) == width).orderBy(F.xxhash64(key), key).select(vector).limit(SAMPLE).collect()
        sample = np.array([r[0] for r in chosen], dtype=np.float64).reshape(len(chosen), width)
        pivots = choose_pivots(sample, cells) if len(sample) else np.zeros((0, width))

        @F.arrow_udf("cell int, to_pivot double")
        def place(given: pa.Array) -> pa.Array:
            cell, far = np.full(len(given), -1, dtype=np.int32), np.zeros(len(given))
            good, matrix = _matrix(given, width)
            fine = ~np.isnan(matrix).any(axis=1)
            good, matrix = good[fine], matrix[fine]
            if len(good) and len(pivots):
                gaps = _distances(matrix, pivots)
                cell[good] = gaps.argmin(axis=1)
                far[good] = gaps.min(axis=1)
            return pa.StructArray.from_arrays([pa.array(cell), pa.array(far)], ["cell", "to_pivot"])

        placed = rows.withColumn("_place", place(F.col(vector))).withColumns({"cell": F.col("_place.cell"), "to_pivot": F.col("_place.to_pivot")}).drop("_place")
        count = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        ordered = placed.repartitionByRange(count, "cell", "to_pivot", F.xxhash64(key)).sortWithinPartitions("cell", "to_pivot")
        ordered.write.mode("overwrite").parquet(f"{path}/rows")
        stored = spark.read.schema(placed.schema).parquet(f"{path}/rows")
        rings = stored.where("cell >= 0").groupBy(F.col("_metadata.file_path").alias("file"), "cell").agg(
            F.min("to_pivot").alias("low"), F.max("to_pivot").alias("high"), F.count("*").alias("n")
        )
        rings.write.mode("overwrite").parquet(f"{path}/rings")
        spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(pivots)], "cell int, pivot array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/pivots")
        return cls(spark, path, vector)

    # --- reading ----------------------------------------------------------------------

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def _bounds(self, query: Sequence[float]) -> tuple[DataFrame, dict[int, float]]:
        """Rings with the least distance any row in them can have, and the distance to each pivot."""
        pivots = self.spark.read.schema("cell int, pivot array<double>").parquet(f"{self.path}/pivots").collect()
        target = np.array(query, dtype=np.float64)
        away = {r.cell: float(math.sqrt(((np.array(r.pivot) - target) ** 2).sum())) for r in pivots if len(r.pivot) == len(target)}
        rings = self.spark.read.schema("file string, cell int, low double, high double, n bigint").parquet(f"{self.path}/rings")
        if not away:
            return rings.limit(0).withColumn("least", F.lit(0.0)), away
        far = _of_cell(away)
        return rings.where(far.isNotNull()).withColumn("least", F.greatest(far - F.col("high"), F.col("low") - far, F.lit(0.0))), away

    def files(self, query: Sequence[float], k: int, condition: Column | None = None) -> tuple[list[str], list[str], float]:
        """(files that can hold one of the ``k`` nearest rows, all files with vectors, radius).

        The radius is the distance of the k-th best row of the closest files, or
        infinite if they have fewer than ``k`` rows that meet the condition.
        """
        bounds, away = self._bounds(query)
        by_file = bounds.groupBy("file").agg(F.min("least").alias("least"), F.sum("n").alias("n"))
        first = by_file.orderBy("least", F.desc("n"), "file").limit(PROBED).collect()
        radius = math.inf
        if first:
            near = self._nearest([r.file for r in first], query, k, condition, away, math.inf).select("distance").collect()
            radius = near[-1].distance if len(near) == k else math.inf
        every = [r.file for r in by_file.select("file").collect()]
        reach = radius * (1 + SLACK) + SLACK
        wanted = by_file.where(F.col("least") <= reach).select("file").collect() if math.isfinite(radius) else []
        return ([r.file for r in wanted] if math.isfinite(radius) else every), every, radius

    def nearest(self, query: Sequence[float], k: int, condition: Column | None = None) -> DataFrame:
        """The ``k`` closest rows by Euclidean distance that meet the condition, ties by id; the same rows as ``search.nearest``."""
        _, away = self._bounds(query)
        wanted, _, radius = self.files(query, k, condition)
        return self._nearest(wanted, query, k, condition, away, radius)

    def _nearest(self, files: list[str], query: Sequence[float], k: int, condition: Column | None, away: dict[int, float], radius: float) -> DataFrame:
        stored = self.rows()
        if not files:
            return stored.drop("cell", "to_pivot").withColumn("distance", F.lit(0.0)).limit(0)
        rows = self.spark.read.schema(stored.schema).parquet(*files).where(F.col("cell") >= 0)
        rows = rows if condition is None else rows.where(condition)
        if math.isfinite(radius):
            reach = radius * (1 + SLACK) + SLACK
            rows = rows.where(F.abs(F.col("to_pivot") - _of_cell(away)) <= reach)
        measured = rows.withColumn("distance", vector_columns.l2_distance(self.vector, query))
        return measured.orderBy("distance", "id").limit(k).drop("cell", "to_pivot")


def _of_cell(values: dict[int, float]) -> Column:
    """The value of each cell as a literal array; cells are numbered from 0."""
    return F.get(F.array(*[F.lit(values[i]) for i in range(len(values))]), F.col("cell"))
