"""Vector arithmetic as Column expressions.

The query vector is a driver-side literal, so a search needs no join and no
broadcast.  Up to ``UNROLL_LIMIT`` dimensions the sum is written out term by
term: that stays inside whole-stage codegen and measured about twice as fast as
``aggregate(zip_with(...))``, which is interpreted.  Wider vectors would exceed
the JIT's method size, so they go to one Arrow batch at a time instead.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

UNROLL_LIMIT = 128


def _tree_sum(terms: list[str]) -> str:
    """Add pairwise, which keeps the expression tree shallow."""
    while len(terms) > 1:
        paired = [f"({terms[i]} + {terms[i + 1]})" for i in range(0, len(terms) - 1, 2)]
        terms = paired + terms[len(paired) * 2 :]
    return terms[0]


def _element(vector: str, i: int) -> str:
    return f"double(get({vector}, {i}))"


def _matrix(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold a full vector, and their vectors as one matrix."""
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    good = np.flatnonzero(lengths == width)
    flat = vectors.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False)
    return good, flat.astype(np.float64).reshape(len(good), width)


def _scatter(size: int, good: np.ndarray, values: np.ndarray) -> pa.Array:
    out, mask = np.zeros(size), np.ones(size, dtype=bool)
    out[good], mask[good] = values, False
    return pa.array(out, mask=mask)


def l2_distance(vector: str, query: Sequence[float]) -> Column:
    """Euclidean distance in double precision; null for a missing or short vector.

    The terms are one SQL text, which is parsed in a single call; building them
    as Column objects took longer than many searches.
    """
    query = [float(x) for x in query]
    if len(query) <= UNROLL_LIMIT:
        gaps = [f"({_element(vector, i)} - ({x!r}D))" for i, x in enumerate(query)]
        return F.expr(f"sqrt({_tree_sum([f'{gap} * {gap}' for gap in gaps])})")

    target = np.array(query)

    @F.arrow_udf(DoubleType())
    def distance(vectors: pa.Array) -> pa.Array:
        good, matrix = _matrix(vectors, len(target))
        gaps = matrix - target
        return _scatter(len(vectors), good, np.sqrt((gaps * gaps).sum(axis=1)))

    return distance(F.col(vector))


def dot(vector: Column, other: Column) -> Column:
    """Inner product of two vector columns."""
    products = F.zip_with(vector, other, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine_similarity(vector: str, query: Sequence[float]) -> Column:
    """Cosine against a literal; null where either side has no length."""
    query = [float(x) for x in query]
    size = float(np.linalg.norm(query))
    if len(query) <= UNROLL_LIMIT:
        parts = [_element(vector, i) for i in range(len(query))]
        inner = F.expr(_tree_sum([f"{p} * ({x!r}D)" for p, x in zip(parts, query)]))
        length = F.expr(f"sqrt({_tree_sum([f'{p} * {p}' for p in parts])})")
    else:
        literal = F.array(*[F.lit(x) for x in query])
        inner, length = dot(F.col(vector), literal), norm(F.col(vector))
    product = length * F.lit(size)
    return F.when(product > 0, inner / product)


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))
