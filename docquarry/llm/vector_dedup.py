"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import query, table
from docquarry.llm.components import components
from docquarry.session import staged

THRESHOLD = 0.93
#: hash tables, rotations joined in one table's hash, and buckets probed in each table
TABLES, JOINED, PROBES = 8, 2, 3
SEED = 7


def rotated(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Three rounds of random signs and a fast Hadamard transform; rows are vectors."""
    for sign in signs:
        x = x * sign
        step = 1
        while step < x.shape[1]:
            pairs = x.reshape(len(x), -1, 2, step)
            x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(len(x), -1)
            step *= 2
        x /= np.sqrt(x.shape[1])
    return x


def polytope_probes(x: np.ndarray, tables: int = TABLES, joined: int = JOINED, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """Bucket numbers, shape (rows, tables, probes), the vector's own bucket first.

    A hash is the nearest signed axis in each of ``joined`` rotations.  Probes
    replace it by the next nearest axis in one rotation or in several, in the
    order of the distance lost.
    """
    width = 1 << max(int(x.shape[1] - 1).bit_length(), 2)  # three nearest axes
    padded = np.zeros((len(x), width))
    padded[:, : x.shape[1]] = x / np.linalg.norm(x, axis=1, keepdims=True)
    rng = np.random.default_rng(seed)
    out = np.empty((len(x), tables, probes), dtype=np.int64)
    choices = np.array(np.meshgrid(*[range(3)] * joined, indexing="ij")).reshape(joined, -1).T
    for t in range(tables):
        axes, losses = [], []
        for _ in range(joined):
            y = rotated(padded, rng.choice([-1.0, 1.0], size=(3, width)))
            top = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :3]
            near = np.take_along_axis(y, top, axis=1)
            axes.append(top * 2 + (near < 0))
            losses.append(np.abs(near[:, :1]) - np.abs(near))
        loss = sum(losses[k][:, choices[:, k]] for k in range(joined))
        number = np.zeros((len(x), len(choices)), dtype=np.int64)
        for k in range(joined):
            number = number * (2 * width) + axes[k][:, choices[:, k]]
        first = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        out[:, t] = np.take_along_axis(number, first, axis=1) * tables + t
    return out


def vector_links(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Rows of one label link when the cosine in double precision is at least
    ``threshold``.  A null id, null label, null, empty or zero vector, or one with
    null or non-finite parts, links with nothing: no links, its own component.
    Vectors of other lengths do not link.  Equal vectors are one node that counts
    as often as it occurs, so hot copies cost one comparison; rows that repeat an
    id count as other vectors.  Ties need no rule, an empty table gives no rows.

    Every node is stored in one bucket of each table and looks into a few more;
    pairs that meet are compared exactly, so no false link appears.  No bucket is
    capped.
    """
    v = F.col("vector")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label"))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)
    rows = rows.withColumn("node", F.when(usable, F.xxhash64("label", "vector")))
    nodes = staged(
        rows.where("node IS NOT NULL").groupBy("node").agg(
            F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("times"), F.min("id").alias("id")
        )
    )

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for size, part in frame.groupby(frame.vector.map(len)):
                slots = polytope_probes(np.stack(part.vector.to_numpy()))
                n = slots.shape[1] * slots.shape[2]
                yield pd.DataFrame({
                    "node": np.repeat(part.node.to_numpy(), n),
                    "label": np.repeat(part.label.to_numpy(), n),
                    "size": size,
                    "slot": slots.reshape(-1),
                    "own": np.tile(np.arange(slots.shape[2]) == 0, len(part) * slots.shape[1]),
                })

    label_type = dict(nodes.dtypes)["label"]
    buckets = staged(
        nodes.select("node", "label", "vector").mapInPandas(hashed, f"node long, label {label_type}, size int, slot long, own boolean")
    )
    met = (
        buckets.where("own").select("label", "size", "slot", F.col("node").alias("a"))
        .join(buckets.select("label", "size", "slot", F.col("node").alias("b")), ["label", "size", "slot"])
        .where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    sides = nodes.select("node", "vector")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                sizes = frame.x.map(len)
                for _, part in frame.groupby(sizes):
                    x, y = np.stack(part.x.to_numpy()), np.stack(part.y.to_numpy())
                    cosine = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
                    yield part.loc[cosine >= threshold, ["a", "b"]]

    links = staged(met.join(sides.toDF("a", "x"), "a").join(sides.toDF("b", "y"), "b").mapInPandas(compare, "a long, b long"))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(nodes.select(F.col("node").alias("b"), "times"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("times").alias("others"))
    roots = components(links)
    known = nodes.select("node", "times", "id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = known.groupBy("root").agg(F.min("id").alias("component_id"))
    facts = staged(
        known.join(names, "root").join(others, "node", "left")
        .select(F.col("node").alias("of"), (F.col("times") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    )
    found = rows.select("id", "node").join(facts, F.col("node") == F.col("of"), "left")
    component = F.when(F.col("of").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return found.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


@query("op10_vector_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(table(spark, sf_dir, "embeddings"))
