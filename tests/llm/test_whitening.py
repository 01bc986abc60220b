"""Whitening against a dense eigensolver, and its parts against plain sums."""

import math

import numpy as np
import pytest

from docquarry.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, id int, z string, component string, n string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, "z", "c", "n") for i, v in rows], SCHEMA).repartition(3)


def usable(rows, width):
    return [(i, v) for i, v in rows if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]


@pytest.fixture(scope="module")
def given():
    rng = np.random.default_rng(5)
    mixed = rng.standard_normal((300, 12)) @ rng.standard_normal((12, 12)) * 0.2
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(mixed)]
    rows += [(500, rows[0][1]), (500, rows[0][1]), (None, rows[1][1]), (501, None), (502, []), (503, [1.0] * 5), (504, [0.0] * 12)]
    rows += [(505, [float("nan")] + [0.0] * 11), (506, [None] + [0.0] * 11), (507, [float("-inf")] + [0.0] * 11), (508, [-3.0, 9000.0] + [0.0] * 10)]
    return rows


def test_equals_a_dense_solver(spark, given):
    rows = whitening.whiten(vectors(spark, given)).collect()
    kept = usable(given, 12)
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in kept], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    far = x * n - sums
    y = far.astype(float) / n
    v = y.T @ y / n
    values, axes = (a[..., ::-1] for a in np.linalg.eigh(v))
    assert len(rows) == 8 * n and {r.n for r in rows} == {n}
    assert sorted((r.vec_id is None, r.vec_id or 0, r.deviation) for r in rows if r.component == 1) == sorted(
        (i is None, i or 0, d) for (i, _), d in zip(kept, (far * far).sum(axis=1))
    )
    want = y @ axes[:, :8] / np.sqrt(values[:8])
    for c in range(8):
        got = {}
        for r in rows:
            if r.component == c + 1:
                got.setdefault(r.vec_id, []).append(r.whitened)
                assert r.explained == pytest.approx(values[c] / values.sum(), rel=1e-9) and r.identity_error < 1e-9
        place = max(range(n), key=lambda j: abs(want[j, c]))
        sign = np.sign(want[place, c] * got[kept[place][0]][0])
        for (i, _), z in zip(kept, want[:, c]):
            assert any(abs(sign * g - z) < 1e-9 for g in got[i])


def test_few_or_equal_vectors(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0])])).collect() == []
    assert whitening.whiten(vectors(spark, [(i, [1.0, 2.0]) for i in range(5)])).collect() == []
    # on a line there is one component
    line = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 7.0]) for i in range(5)])).collect()
    assert sorted((r.vec_id, round(r.whitened, 9)) for r in line) == [(i, round((i - 2) / math.sqrt(2), 9)) for i in range(5)]
    assert {(r.component, round(r.explained, 9)) for r in line} == {(1, 1.0)}


@pytest.mark.parametrize("entries", [(2.0**21, 1.5, 3.25, -0.125), (2.0**40, -(2.0**41), 3.25, 2.0**41)])
def test_large_entries_stay_exact(spark, entries):
    rows = [(i, [float(np.float32(c)), 0.5]) for i, c in enumerate(entries)]
    got = {r.vec_id: r.deviation for r in whitening.whiten(vectors(spark, rows), 1).collect()}
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    want = [sum((4 * row[k] - sum(r[k] for r in x)) ** 2 for k in range(2)) for row in x]
    assert got == {i: w if w < 1 << 63 else None for i, w in enumerate(want)}
    assert got[0] is None


def test_differences_beyond_longs():
    x = np.array([[1 << 51, -5], [3, 1 << 50]], dtype=np.int64)
    n, sums = 1 << 20, [7, -(1 << 80)]
    assert whitening.from_mean(x, n, sums).tolist() == [[n * int(v) - s for v, s in zip(row, sums)] for row in x]


def test_partial_sums_are_added_in_groups(spark, given, monkeypatch):
    monkeypatch.setattr(whitening, "PARTS", 1)
    centred = whitening.Centred(whitening.packed(whitening.whole_numbers(vectors(spark, given))))
    assert centred.tasks > 1
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in usable(given, 12)], dtype=float)
    assert centred.sums == x.sum(axis=0).astype(int).tolist()
    v = np.cov(x.T, bias=True)
    assert np.allclose(centred(np.eye(12)), v, rtol=1e-10, atol=1e-6)


@pytest.mark.parametrize("spectrum", [np.r_[1.0001, 1.0, 0.99999, np.linspace(0.99, 0.5, 197)], 0.8 ** np.arange(150), np.ones(40), np.r_[np.ones(3), np.zeros(60)], np.arange(5.0)])
def test_eigenpairs_of_hard_spectra(spectrum):
    turn = np.linalg.qr(np.random.default_rng(0).standard_normal((len(spectrum),) * 2))[0]
    matrix = (turn * spectrum) @ turn.T
    values, axes = whitening.largest_eigenpairs(lambda u: matrix @ u, len(spectrum))
    assert np.allclose(values, np.sort(spectrum)[::-1][: len(values)], atol=1e-12)
    assert np.abs(matrix @ axes - axes * values).max() < 1e-13 and np.abs(axes.T @ axes - np.eye(len(values))).max() < 1e-12
