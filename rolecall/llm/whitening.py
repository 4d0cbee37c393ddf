"""Embedding whitening: covariances by polarisation, from exact squares.

Entries become integers, x = floor(64 c) + 1000000.  The fit list holds each
distinct x vector once.  A first pass sums it; with n vectors, sums S and
S = n q + r (0 <= r < n), a second pass centres each entry on q and adds up squares
only: of every dimension, and of the sum of every two dimensions.  Squares and
sums are integers and exact, and so is what r corrects:

    n^2 Var(i) = n Q_i - r_i^2,   n^2 Var(i + j) = n Q_ij - (r_i + r_j)^2
    Cov(i, j) = (Var(i + j) - Var(i) - Var(j)) / 2

so each covariance is rounded once, when it becomes a double for ``eigh``.  Tasks
send one row for each dimension and pair, added up by Spark; the driver sees a
matrix of the dimensions, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import quoted, written

#: Scale and offset of the integers.
SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
#: Eigenvalues of at most this share of the largest are no components: rounding alone could make them.
RANK = 1e-13
#: Larger entries count as this one; its integers fit a long.
MOST = 2.0**56
_BLOCK = 4096
_LIMB = 40


def integers(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows whose vector is whole: not null, not empty, all entries there and finite."""
    v = F.col(quoted(vector_col)).cast("array<double>")
    whole = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform("v", lambda c: F.floor(F.greatest(F.least(c, F.lit(MOST)), F.lit(-MOST)) * SCALE) + OFFSET)
    return rows.select(F.col(quoted(id_col)).cast("long").alias("vec_id"), v.alias("v")).filter("size(v) > 0").filter(whole).select("vec_id", x.alias("x"))


def _blocks(batches: Iterator[pa.RecordBatch], d: int):
    """Matrices of at most ``_BLOCK`` rows of ``x``, and the rows they are of."""
    for batch in batches:
        for i in range(0, len(batch), _BLOCK):
            part = batch.slice(i, _BLOCK)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _limbs(slots: list[int], values: list[int]) -> pa.RecordBatch:
    """Integers of any size as four limbs, which Spark adds up one by one."""
    mask = (1 << _LIMB) - 1
    cut = [[(v >> _LIMB * k) & mask if k < 3 else v >> _LIMB * 3 for v in values] for k in range(4)]
    return pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), *(pa.array(c, pa.int64()) for c in cut)], ["slot", "a", "b", "c", "d"])


def _added(parts: DataFrame) -> dict[int, int]:
    """The sum of each slot; there are as many as dimensions and pairs of them."""
    found = parts.groupBy("slot").agg(*(F.sum(c).alias(c) for c in "abcd")).collect()
    return {r["slot"]: sum(r[c] << _LIMB * k for k, c in enumerate("abcd")) for r in found}


_LIMBS = "slot long, a long, b long, c long, d long"


def _sums(d: int):
    """Slot -1 the number of vectors, slot i the sum of dimension i."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for _, x in _blocks(batches, d):
            n += len(x)
            high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
            total = [t + (h << 32) + w for t, h, w in zip(total, high, low)]
        if n:
            yield _limbs([-1, *range(d)], [n, *total])

    return run


def squares(y: np.ndarray) -> np.ndarray:
    """Sums over rows of y_i^2 (on the diagonal) and of (y_i + y_j)^2 (above it), exact, as Python's integers."""
    d = y.shape[1]
    out = np.zeros((d, d), object)
    top = int(np.abs(y).max()) if y.size else 0
    kind = np.int64 if (2 * top) ** 2 * len(y) < 1 << 63 else object
    t = np.ascontiguousarray(y.T.astype(kind))
    for i in range(d):
        both = t[i + 1 :] + t[i]
        every = np.concatenate([t[i : i + 1], both])
        out[i, i:] = np.einsum("jm,jm->j", every, every) if kind is np.int64 else (every * every).sum(axis=1)
    return out


def _squares(d: int, q: list[int]):
    """Slot i * d + j: the squares of dimension i (i = j) or of the sum of i and j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, centre = np.zeros((d, d), object), np.array(q, np.int64)
        for _, x in _blocks(batches, d):
            total += squares(x - centre)
        i, j = np.triu_indices(d)
        if total.any():
            yield _limbs((i * d + j).tolist(), [int(v) for v in total[i, j]])

    return run


class Whitening:
    """n, q, r (S = n q + r), and the components: unit columns of ``axes`` by falling ``values``."""

    def __init__(self, n: int, total: list[int], found: dict[int, int], components: int):
        d = len(total)
        self.n, self.q, self.r = n, [s // n for s in total], [s % n for s in total]
        alone = [n * found.get(i * d + i, 0) - self.r[i] ** 2 for i in range(d)]
        v = np.zeros((d, d))
        for i in range(d):
            v[i, i] = alone[i] / n**2
            for j in range(i + 1, d):
                pair = n * found.get(i * d + j, 0) - (self.r[i] + self.r[j]) ** 2
                v[i, j] = v[j, i] = (pair - alone[i] - alone[j]) / (2 * n**2)
        values, axes = np.linalg.eigh(v)
        values, axes = values[::-1], axes[:, ::-1]
        keep = int((values[:components] > RANK * max(values[0], 0.0)).sum()) if values[0] > 0 else 0
        self.covariance, self.values, axes = v, values[:keep], axes[:, :keep]
        self.axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(keep)] < 0, -1, 1)
        self.explained = self.values / (sum(alone) / n**2) if keep else self.values

    def projection(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(q, r / n, axes over the roots of their values): whitened = (x - q - r / n) @ the last."""
        return np.array(self.q, np.int64), np.array([r / self.n for r in self.r]), self.axes / np.sqrt(self.values)


def fit_list(rows: DataFrame) -> DataFrame:
    """Each distinct x once, as a table; copies meet before the shuffle."""
    return written(rows.select("x").distinct())


def fitted(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a fit list (x, all of one length); None if it is empty."""
    first = vectors.first()
    if first is None:
        return None
    d = len(first["x"])
    total = _added(vectors.mapInArrow(_sums(d), _LIMBS))
    n, total = total[-1], [total[i] for i in range(d)]
    found = _added(vectors.mapInArrow(_squares(d, [s // n for s in total]), _LIMBS))
    return Whitening(n, total, found, components)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity."""
    q, rest, axes = model.projection()
    k, d = axes.shape[1], len(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = np.zeros(k), np.zeros((k, k))
        for _, x in _blocks(batches, d):
            w = ((x - q) - rest) @ axes
            one += w.sum(axis=0)
            two += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k + k * k), pa.int64()), pa.array(np.append(one, two.ravel()))], ["slot", "value"])

    sums = {r["slot"]: r["value"] for r in vectors.mapInArrow(run, "slot long, value double").groupBy("slot").agg(F.sum("value").alias("value")).collect()}
    mean = np.array([sums[i] for i in range(k)]) / model.n
    second = np.array([sums[k + i] for i in range(k * k)]).reshape(k, k) / model.n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def whitened(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each whole vector and component: vec_id, component (from 1), n,
    deviation, whitened, explained, identity_error.

    Rows whose vector is null or empty, or holds nulls or entries that are not finite,
    are dropped, as are rows whose vector has another length than most (of equally
    many, the longer).  Repeated rows get their rows each and count once in the fit; a
    null vec_id is kept; other columns are not looked at.  A component needs an
    eigenvalue over ``RANK`` of the largest: without any (an empty table, or one
    distinct vector) there are no rows.  A deviation that no long can hold is null.
    """
    found = integers(rows, id_col, vector_col)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    length = found.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    found = found.filter(F.size("x") == (length["d"] if length else 0))
    vectors = fit_list(found)
    model = fitted(vectors, components)
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(vectors, model)
    (q, rest, axes), n, r, explained = model.projection(), model.n, np.array(model.r, np.int64), model.explained
    k, d = axes.shape[1], len(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, d):
            y = x - q
            top = n * (int(np.abs(y).max()) + 1)
            z = y * n - r if top * top * d < 1 << 63 else y.astype(object) * n - r
            deviation = [v if v < 1 << 63 else None for v in map(int, (z * z).sum(axis=1))]
            w = (y - rest) @ axes
            m = len(part)
            at = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), pa.array(deviation, pa.int64()).take(at),
                    pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return found.mapInArrow(run, schema)
