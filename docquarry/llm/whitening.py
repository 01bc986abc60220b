"""Whitening of embeddings: Jacobi-Davidson on distributed centred products."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import query, table
from docquarry.session import staged

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
#: 1024 * entry below this is a whole number that doubles hold exactly
EXACT = float(1 << 52)
#: rows packed into one block; their sums stay inside a long
BLOCK_ROWS, BLOCK_CELLS = 1_024, 1 << 20
#: partial results that are added by the driver; more are added by tasks first
PARTS = 64
#: first directions, directions kept at a restart and largest search space, all times the wanted number
EXTRA, KEPT, SPACE = 3, 4, 8
#: steps of one inner solution, its relative residual, and rounds of the outer loop
INNER_STEPS, INNER_TOLERANCE, ROUNDS = 16, 0.1, 200
SEED = 11

Product = Callable[[np.ndarray], np.ndarray]


# --- the eigenvectors, given products with the covariance -------------------------


def minres(product: Product, rhs: np.ndarray, shifts: np.ndarray, away: np.ndarray, tolerance: float, steps: int) -> np.ndarray:
    """Solutions of (I - QQ') (V - shift I) (I - QQ') t = rhs, a column for each shift, Q = ``away``.

    All columns step together, so that one product serves them; a column that has
    reached its tolerance stands still.
    """

    def project(y: np.ndarray) -> np.ndarray:
        for _ in range(2):
            y = y - away @ (away.T @ y)
        return y

    r1 = r2 = project(rhs)
    beta = np.linalg.norm(r2, axis=0)
    start, phibar, live = beta.copy(), beta.copy(), beta > 0
    x, w, w2 = np.zeros_like(r2), np.zeros_like(r2), np.zeros_like(r2)
    old, dbar, epsln = np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    cs, sn = -np.ones_like(beta), np.zeros_like(beta)
    for step in range(steps):
        live &= (phibar > tolerance * start) & (beta > 1e-14 * np.abs(shifts))
        if not live.any():
            break
        at = np.flatnonzero(live)
        v = r2[:, at] / beta[at]
        y = project(product(v) - v * shifts[at])
        if step:
            y -= (beta[at] / old[at]) * r1[:, at]
        alfa = np.einsum("ij,ij->j", v, y)
        y -= (alfa / beta[at]) * r2[:, at]
        r1, r2 = r1.copy(), r2.copy()
        r1[:, at], r2[:, at] = r2[:, at], y
        old[at], beta[at] = beta[at], np.linalg.norm(y, axis=0)
        before, delta = epsln[at].copy(), cs[at] * dbar[at] + sn[at] * alfa
        gbar = sn[at] * dbar[at] - cs[at] * alfa
        epsln[at], dbar[at] = sn[at] * beta[at], -cs[at] * beta[at]
        gamma = np.maximum(np.hypot(gbar, beta[at]), np.finfo(float).tiny)
        cs[at], sn[at] = gbar / gamma, beta[at] / gamma
        phi = cs[at] * phibar[at]
        phibar[at] *= sn[at]
        new = (v - before * w2[:, at] - delta * w[:, at]) / gamma
        w2[:, at], w[:, at] = w[:, at], new
        x[:, at] += phi * new
    return x


def orthonormal(columns: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal base of what the columns add to the orthonormal ``against``."""
    for _ in range(2):
        columns = columns - against @ (against.T @ columns)
        sizes = np.linalg.norm(columns, axis=0)
        columns = columns[:, sizes > 0] / sizes[sizes > 0]
        if not columns.shape[1]:
            return columns
        u, s, _ = np.linalg.svd(columns, full_matrices=False)
        columns = u[:, s > 1e-8 * s[0]]
    return columns


def largest_eigenpairs(product: Product, width: int, wanted: int = COMPONENTS, tolerance: float | None = None, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric matrix and unit eigenvectors, by its products alone.

    Rayleigh-Ritz in a growing space gives the best pairs.  Pairs whose residual is
    at rounding level are locked, in order from the top; each other one adds the
    solution of its correction equation, which MINRES finds roughly.  The
    correction is projected away from all wanted directions, so neighbours among
    them do not slow it.  A space that is full is restarted from its best
    directions.  ``tolerance`` is relative to the largest eigenvalue, by default a
    few roundings of one product; a residual that stops to fall there is accepted
    up to a hundred times that, beyond it the call fails.
    """
    wanted = min(wanted, width)
    eps = np.finfo(float).eps
    tolerance = tolerance or 4 * eps * np.sqrt(width)
    rng = np.random.default_rng(seed)
    base = np.linalg.qr(rng.standard_normal((width, min(width, EXTRA * wanted))))[0]
    image = product(base)
    best, stale = np.full(wanted, np.inf), np.zeros(wanted, int)
    for _ in range(ROUNDS):
        h = base.T @ image
        values, turns = np.linalg.eigh((h + h.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        ritz, through = base @ turns[:, :wanted], image @ turns[:, :wanted]
        residual = through - ritz * values[:wanted]
        sizes = np.linalg.norm(residual, axis=0)
        top = max(abs(values[0]), np.finfo(float).tiny)
        stale = np.where(sizes < best / 2, 0, stale + 1)
        best = np.minimum(best, sizes)
        done = (sizes <= tolerance * top) | ((stale >= 2) & (sizes <= 100 * tolerance * top))
        locked = int(np.argmin(done)) if not done.all() else wanted
        if locked == wanted:
            return values[:wanted], ritz
        # the locked ones stay in the space, and out of every correction
        open_ = np.arange(locked, wanted)
        open_ = open_[~done[open_]]
        fixes = minres(product, -residual[:, open_], values[open_], ritz, INNER_TOLERANCE, INNER_STEPS)
        if base.shape[1] + len(open_) > max(SPACE * wanted, 2 * wanted) and base.shape[1] > KEPT * wanted:
            keep = turns[:, : KEPT * wanted]
            base, image = base @ keep, image @ keep
        more = orthonormal(fixes, base)
        if not more.shape[1]:  # the space can't grow: full, or all corrections lie in it
            more = orthonormal(rng.standard_normal((width, wanted)), base)
        if not more.shape[1]:
            # all directions are there: what is left is rounding
            return values[:wanted], ritz
        base, image = np.hstack((base, more)), np.hstack((image, product(more)))
    raise RuntimeError(f"residuals of {best / top} after {ROUNDS} rounds")


# --- vectors as blocks, and distributed sums over them ------------------------------


def whole_numbers(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """``vectors`` with a column ``x``, array<long>: floor(1024 * entry) + 100000 of every entry.

    Rows whose vector is null, empty or holds a null or non-finite entry are left
    out; so is an entry too large to be a whole number in double precision.
    """
    scaled = F.transform(F.col(vector_col), lambda c: F.floor(c.cast("double") * SCALE))
    fine = F.forall(F.col(vector_col), lambda c: c.isNotNull() & (F.abs(c.cast("double") * SCALE) < EXACT))  # NaN is above all
    kept = vectors.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.coalesce(fine, F.lit(False)))
    return kept.withColumn("x", F.transform(scaled, lambda c: c.cast("long") + OFFSET))


def _blocks_of(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the rows of each width, some at a time."""
    cells = batch.column(column)
    flat, ends = cells.flatten().to_numpy(zero_copy_only=False), cells.offsets.to_numpy()
    starts, widths = ends[:-1] - ends[0], np.diff(ends)
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        step = max(1, min(BLOCK_ROWS, BLOCK_CELLS // int(width)))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            yield some, flat[starts[some][:, None] + np.arange(width)]


def packed(rows: DataFrame) -> DataFrame:
    """Staged rows (width, n, long, cells): the ``x`` of up to 1,024 vectors as one binary value."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, x in _blocks_of(batch, 0):
                small = bool(np.abs(x).max() < 1 << 31)
                yield pa.record_batch(
                    {
                        "width": pa.array([x.shape[1]], pa.int32()), "n": pa.array([len(some)], pa.int64()), "long": pa.array([not small]),
                        "cells": pa.array([x.astype("<i4" if small else "<i8").tobytes()], pa.binary()),
                    }
                )

    return staged(rows.select("x").mapInArrow(pack, "width int, n long, long boolean, cells binary"))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for width, wide, cells in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
            yield np.frombuffer(cells, "<i8" if wide else "<i4").astype(np.int64).reshape(-1, width)


def from_mean(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S: longs where they fit, else Python's whole numbers."""
    reach = n * int(np.abs(x).max()) + max(map(abs, sums)) if x.size else 0
    if reach < 1 << 62:
        return x * n - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


class Centred:
    """Vectors in blocks, with their number, sums and products with their covariance.

    A product centres every entry before it multiplies and never forms the
    covariance: V u is the sum of y (y'u) / n over all rows y.  Tasks return one
    small matrix each; beyond 64 tasks other tasks add them up first, so the
    driver's share does not grow with the vectors.
    """

    def __init__(self, blocks: DataFrame):
        widths = blocks.groupBy("width").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("width")).limit(1).collect()
        self.width, self.n = (widths[0].width, widths[0].n) if widths else (0, 0)
        self.blocks = blocks.where(F.col("width") == self.width)
        self.tasks = self.blocks.rdd.getNumPartitions() if self.n else 0
        if not self.n:
            return
        width = self.width

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width, dtype=object)
            for x in _unpacked(batches):
                total = total + x.sum(axis=0).astype(object)
            yield pa.record_batch({"sums": pa.array([[str(v) for v in total]], pa.list_(pa.string()))})

        by_place = self.blocks.mapInArrow(add, "sums array<string>").select(F.posexplode("sums"))
        found = by_place.groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).collect()
        self.sums = [int(r.s) for r in sorted(found, key=lambda r: r.pos)]

    def __call__(self, u: np.ndarray) -> np.ndarray:
        n, sums, shape = self.n, self.sums, u.shape

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for x in _unpacked(batches):
                y = from_mean(x, n, sums).astype(np.float64) / n
                total += y.T @ (y @ u)
            yield pa.record_batch({"cells": pa.array([total.tobytes()], pa.binary())})

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                for cells in batch.column(0).to_pylist():
                    total += np.frombuffer(cells).reshape(shape)
            yield pa.record_batch({"cells": pa.array([total.tobytes()], pa.binary())})

        parts = self.blocks.mapInArrow(multiply, "cells binary")
        if self.tasks > PARTS:
            parts = parts.repartition(int(self.tasks**0.5)).mapInArrow(add, "cells binary")
        total = np.zeros(shape)
        for row in parts.collect():
            total += np.frombuffer(row.cells).reshape(shape)
        return total / n


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable vector and component: id, component, n, deviation, whitened, explained, identity_error.

    Vectors are read as whole numbers x (see ``whole_numbers``); n of them with sums
    S are left after unusable ones, and after those of another width than the most
    frequent one.  ``deviation`` is the sum of (n * x - S) squared over the
    dimensions, exact, null where no long holds it.  Components are eigenvectors of
    the covariance by falling eigenvalue, their largest entry positive;
    ``whitened`` is the centred vector on a component over the root of its
    eigenvalue, ``explained`` the eigenvalue over the trace, ``identity_error`` the
    largest absolute entry of the covariance of all ``whitened`` minus the identity.

    Components without variance can't be scaled and have no rows: one vector, or
    equal ones, give none, as does an empty table.  Repeated rows count each, ids
    may be null or repeat, other columns are not read.
    """
    rows = whole_numbers(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")), "vector")
    blocks = packed(rows)
    centred = Centred(blocks)
    n, width = centred.n, centred.width
    found, axes = (np.zeros(0), np.zeros((width, 0)))
    if n > 1:
        found, axes = largest_eigenpairs(centred, width, components)
        real = found > max(found[0], 0) * width * np.finfo(float).eps * 16
        found, axes = found[real], axes[:, real]
    k = len(found)
    if not k:
        return rows.select(
            F.col("id").alias(id_col), F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"),
            *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")],
        ).limit(0)
    axes = axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(axis=0)[None], axis=0)[0] < 0, -1, 1)
    scaled, sums = axes / np.sqrt(found), centred.sums

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, x in _blocks_of(batch, 1):
                far = from_mean(x, n, sums)
                z = (far.astype(np.float64) / n) @ scaled
                exact = far.dtype != object and width * int(np.abs(far).max()) ** 2 < 1 << 63
                squares = (far * far).sum(axis=1).tolist() if exact else [sum(int(v) ** 2 for v in row) for row in far]
                yield pa.record_batch(
                    {
                        "id": batch.column(0).take(pa.array(some)),
                        "deviation": pa.array([v if v < 1 << 63 else None for v in squares], pa.int64()),
                        "share": pa.array([float(v) for v in squares]),
                        "z": pa.array(list(z), pa.list_(pa.float64())),
                    }
                )

    kind = rows.schema["id"].dataType.simpleString()
    same_width = rows.where(F.size("x") == width).select("id", "x")
    out = staged(same_width.mapInArrow(project, f"id {kind}, deviation long, share double, z array<double>"))
    # the covariance of what is returned, centred again before multiplying
    first = out.agg(F.sum("share").alias("share"), *[F.avg(F.get("z", F.lit(i))).alias(f"m{i}") for i in range(k)]).first()
    off = [F.get("z", F.lit(i)) - F.lit(first[f"m{i}"]) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    second = out.agg(*[(F.sum(off[i] * off[j]) / n).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(second[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    trace = first.share / float(n) ** 3
    explained = F.element_at(F.array(*[F.lit(float(e / trace)) for e in found]), F.col("pos") + 1)
    return out.select("id", "deviation", F.posexplode("z")).select(
        F.col("id").alias(id_col), (F.col("pos") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.col("col").alias("whitened"), explained.alias("explained"), F.lit(float(error)).alias("identity_error"),
    )


@query("op11_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
