"""Whitening of embeddings by matrix-free block subspace iteration.

The covariance is never formed. One Spark pass takes a block Q of directions (dimension times block size numbers, sent
to all tasks) and adds up X'(XQ) over the centred rows; the driver does the rest on arrays of that size: a Rayleigh-Ritz
step in the block, the residuals |V u - e u| of the leading pairs, and a QR step to the next block. The iteration ends when
the residuals certify all components wanted. Where the residuals fall too slowly, because the eigenvalues beyond the
block are as large as those wanted, the block doubles, up to the dimension, at which the step is exact.

Rows are first made integers, so that equal vectors are told exactly and sums over them are exact; the fit takes every
distinct vector once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.common import materialise
from cladeframe.llm.vectors import halves, integers, long_or_null, matrix, summed, whole

SCALE = 256
#: Residuals relative to the largest eigenvalue that certify a component.
CERTIFIED = 1e-12
#: A block that would need more passes than this doubles.
PASSES = 6
#: Directions of the first block.
BLOCK = 16
#: Eigenvalues below this share of the largest are none.
RANK = 1e-11
#: Rows that are multiplied at a time.
ROWS = 8192


def _centred(batches: Iterator[pa.RecordBatch], column: int, mean: np.ndarray) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield matrix(batch.column(column).slice(at, ROWS)).astype(np.float64) - mean


class Fit:
    """n, S, components (as columns), their eigenvalues, trace and identity error of the distinct rows x of a table."""

    def __init__(self, x: DataFrame, d: int, k: int):
        def sums(batches):
            out, n = np.zeros((2, d), np.int64), 0
            for batch in batches:
                out += halves(matrix(batch.column(0))).sum(1)
                n += batch.num_rows
            return np.append(out.ravel(), n)

        found = summed(x, sums, 2 * d + 1, np.int64)
        self.n, self.sums = int(found[-1]), whole(found[:-1].reshape(2, d))
        self.mean = np.array([s / max(1, self.n) for s in self.sums], np.float64)  # of Python integers, so rounded once
        self.passes = 0
        self._iterate(x, d, min(k, d))
        self._certify(x)

    def _apply(self, x: DataFrame, q: np.ndarray) -> np.ndarray:
        """V q, and the trace of V besides, from one pass over the rows."""
        d, b, mean = *q.shape, self.mean

        def partial(batches):
            out, square = np.zeros((d, b)), 0.0
            for y in _centred(batches, 0, mean):
                out += y.T @ (y @ q)
                square += float((y * y).sum())
            return np.append(out.ravel(), square)

        found = summed(x, partial, d * b + 1, np.float64) / max(1, self.n)
        self.passes += 1
        self.trace = float(found[-1])
        return found[:-1].reshape(d, b)

    def _iterate(self, x: DataFrame, d: int, k: int) -> None:
        random = np.random.default_rng(0)
        q = np.linalg.qr(random.standard_normal((d, min(d, max(2 * k, BLOCK)))))[0]
        before, whole_block = None, False
        while True:
            z = self._apply(x, q)
            projected = q.T @ z
            e, w = np.linalg.eigh((projected + projected.T) / 2)
            e, w = e[::-1], w[:, ::-1]
            u, vu = q @ w, z @ w
            scale = max(float(e[0]), np.finfo(float).tiny)
            worst = float(np.linalg.norm(vu[:, :k] - u[:, :k] * e[:k], axis=0).max()) / scale
            if worst <= CERTIFIED or whole_block:
                break
            rate = worst / before if before else 0.5
            slow = rate >= 1 or np.log(CERTIFIED / worst) / np.log(rate) > PASSES
            block = vu
            whole_block = q.shape[1] == d  # one more step of a block that spans everything leaves rounding alone
            if before and slow and q.shape[1] < d:
                block = np.hstack([vu, random.standard_normal((d, min(q.shape[1], d - q.shape[1])))])
                worst = None
            # directions of no variance would leave the block short of rank
            norm = np.linalg.norm(block, axis=0)
            block = np.where(norm > RANK * scale, block / np.where(norm > 0, norm, 1), random.standard_normal(block.shape))
            q, before = np.linalg.qr(block)[0], worst
        if worst > 1e-9:
            raise ArithmeticError(f"residuals of {worst} after {self.passes} passes")
        kept = e[:k] > RANK * scale
        self.values, self.components = e[:k][kept], u[:, :k][:, kept]
        sign = np.sign(self.components[np.abs(self.components).argmax(0), np.arange(kept.sum())])
        self.components = self.components * sign

    def _certify(self, x: DataFrame) -> None:
        """The largest entry of the whitened rows' covariance less the identity, measured on the rows."""
        k, mean, to = len(self.values), self.mean, self.components / np.sqrt(self.values)

        def partial(batches):
            square, total = np.zeros((k, k)), np.zeros(k)
            for y in _centred(batches, 0, mean):
                w = y @ to
                square += w.T @ w
                total += w.sum(0)
            return np.append(square.ravel(), total)

        found = summed(x, partial, k * k + k, np.float64) / max(1, self.n) if k else np.zeros(0)
        centre = found[k * k :]
        self.identity_error = float(np.abs(found[: k * k].reshape(k, k) - np.outer(centre, centre) - np.eye(k)).max()) if k else 0.0


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """Per row and component: id, component (from 1), n (distinct vectors), deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, or holds null or non-finite entries are left out, as are vectors of another length
    than the commonest. Rows that repeat are returned each, and counted once in the fit; a null id is kept. There are as
    many components as asked for, or as the distinct vectors have variance along; a table of equal vectors has none, and
    gives no row, like an empty one. Deviations are exact, null beyond a long. Other columns are not read.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)[id_col]
    out = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, d = integers(vectors, {"id": id_col}, vector_col, SCALE)
    if not d:
        return spark.createDataFrame([], out)
    rows = materialise(rows, "integers")
    fit = Fit(materialise(rows.select("x").distinct(), "distinct"), d, components)
    n, sums, mean = fit.n, fit.sums, fit.mean
    to = fit.components / np.sqrt(fit.values) if len(fit.values) else fit.components
    k, explained = to.shape[1], fit.values / fit.trace if fit.trace else fit.values
    error = fit.identity_error
    largest = max((abs(int(s)) for s in sums), default=0)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                x = matrix(some.column(1))
                if not k or not len(x):
                    continue
                top = n * max(abs(int(x.max())), abs(int(x.min()))) + largest
                if d * top * top < 1 << 63:
                    far = n * x - sums.astype(np.int64)
                    far = (far * far).sum(1)
                else:
                    far = n * x.astype(object) - sums
                    far = (far * far).sum(1)
                w, m = (x.astype(np.float64) - mean) @ to, len(x)
                each = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), long_or_null(far.tolist()).take(pa.array(each)),
                        pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(project, out)
