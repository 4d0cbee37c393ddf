"""Whitening against exact fractions and a plain reference."""

import math
from fractions import Fraction

import numpy as np
import pytest

from rolecall.llm import whitening

ROWS = "vec_id long, embedding array<float>, x string, n int, slot string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, "x", 1, "s") for i, v in vectors], ROWS).repartition(3)


def reference(vectors):
    """(rows kept as (id, x), n, S, V as fractions over the distinct x)."""
    good = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, d = len(fit), len(fit[0])
    s = [sum(x[i] for x in fit) for i in range(d)]
    z = [[x[i] - Fraction(s[i], n) for i in range(d)] for x in fit]
    v = [[sum(a[i] * a[j] for a in z) / n for j in range(d)] for i in range(d)]
    return good, n, s, v


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    mixed = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) + 5
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(mixed)]
    rows += [(900, rows[0][1]), (901, rows[0][1]), (0, rows[0][1]), (None, rows[7][1])]
    odd = [(902, None), (903, []), (904, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (905, [float("nan")] * 6), (906, [float("inf")] + [0.0] * 5), (907, [1.0, 2.0])]
    return rows, odd


def test_against_fractions(spark, vectors):
    rows, odd = vectors
    good, n, s, v = reference(rows)
    got = whitening.whitened(table(spark, rows + odd)).collect()
    d = len(s)
    assert len(got) == len(rows) * d and all(r["n"] == n for r in got)
    exact = np.array([[float(c) for c in row] for row in v])
    values, axes = np.linalg.eigh(exact)
    values, axes = values[::-1], axes[:, ::-1]
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    signs = {}
    for i, x in good:
        deviation = sum((n * c - t) ** 2 for c, t in zip(x, s))
        for k in range(d):
            r = by[(i, k + 1)][0]
            assert r["deviation"] == deviation
            assert abs(r["explained"] - values[k] / np.trace(exact)) < 1e-9
            want = float(np.dot([float(c - Fraction(t, n)) for c, t in zip(x, s)], axes[:, k])) / math.sqrt(values[k])
            if abs(want) > 1e-3:
                assert signs.setdefault(k, np.sign(want) * np.sign(r["whitened"])) == np.sign(want) * np.sign(r["whitened"])
            assert abs(abs(r["whitened"]) - abs(want)) < 1e-8
    assert max(r["identity_error"] for r in got) < 1e-9
    assert len(by[(0, 1)]) == 2 and len(by[(None, 1)]) == 1


def test_polarisation_is_exact(spark, vectors):
    """Covariances equal the fractions, also for integers whose squares no long can hold."""
    rows, _ = vectors
    for scale in (1, 1e9, 1e14):
        big = [(i, [float(np.float32(c * scale)) for c in v]) for i, v in rows[:40]]
        _, n, s, v = reference(big)
        model = whitening.fitted(whitening.fit_list(whitening.integers(table(spark, big))))
        assert model.n == n and [model.n * q + r for q, r in zip(model.q, model.r)] == s
        assert all(model.covariance[i, j] == float(v[i][j]) for i in range(6) for j in range(6))


def test_few_components(spark):
    line = [(i, [float(i), 2.0 * i, 3.0]) for i in range(20)]
    got = whitening.whitened(table(spark, line)).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 20 and abs(got[0]["explained"] - 1) < 1e-12
    for empty in ([], [(1, [1.0, 2.0])] * 3, [(1, None)]):
        assert whitening.whitened(table(spark, empty)).count() == 0
    assert len({r["component"] for r in whitening.whitened(table(spark, [(i, [float((i * k) % 41) for k in range(1, 25)]) for i in range(41)])).collect()}) == 16
