"""Connected components of links between numbered nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.session import staged


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of the links (a, b); root is the smallest node reachable.

    Every round points each node to its smallest neighbour below it, follows the
    pointers twice and renames the ends of all links; links within one name
    vanish.  A path shrinks to a quarter or less by each round, so the rounds
    grow with the logarithm of the longest path.  Each round's tables are written
    to the shared folder; nothing is gathered but row counts.
    """
    renamed = staged(
        links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    roots = staged(renamed.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")))
    while not renamed.isEmpty():
        up = staged(renamed.groupBy(F.col("b").alias("low")).agg(F.min("a").alias("top")))
        for _ in range(2):
            higher = up.select(F.col("low").alias("mid"), F.col("top").alias("above"))
            up = up.join(higher, F.col("top") == F.col("mid"), "left").select("low", F.coalesce("above", "top").alias("top"))
        up = staged(up)
        for end in ("a", "b"):
            renamed = renamed.join(up, F.col(end) == F.col("low"), "left").withColumn(end, F.coalesce("top", end)).drop("low", "top")
        renamed = staged(
            renamed.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        )
        roots = staged(
            roots.join(up, F.col("root") == F.col("low"), "left").select("node", F.coalesce("top", "root").alias("root"))
        )
    return roots
