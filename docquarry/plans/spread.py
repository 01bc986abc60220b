"""Using all cores on small inputs, and little memory on large ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: text that a worker turns into Python objects at a time
PIECE_BYTES = 1 << 20


def pieces(batches: Iterator[pa.RecordBatch], sized: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of about ``most`` bytes in the column ``sized``, a row at least.

    A batch is cut by rows alone, so its texts may be large; a task that works on
    one piece after the other holds the objects of one piece.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(sized)), 0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if start < end:
                yield batch.slice(start, end - start)


def spread(df: DataFrame) -> DataFrame:
    """Deal out an input that is too small to give every core a split.

    Only for steps whose work per row outweighs moving the row.  The planner's
    size estimate decides and nothing is executed; a large input has splits for
    all cores and passes through untouched, so nothing is shuffled at scale.  An
    input that is dealt out already stays as it is.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    small = int(str(plan.stats().sizeInBytes())) < cores * split
    return df.repartition(cores) if small and "Repartition" not in plan.toString() else df
