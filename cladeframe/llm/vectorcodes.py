"""Compression of vectors to short codes, with annular norm pruning in every nearest-entry search.

Vectors become integers and are cut into parts; each part position has a codebook, learned by rounds over all rows. The
entries of a codebook lie sorted by norm. An entry whose norm differs from a part's by more than the best distance found
so far is farther away, so a part looks at the entries next to its own norm first, and its best distance then bounds an
annulus of norms: a binary search finds the entries in it, ends included, and these are compared, exactly. Parts are taken
in the order of their norms, a group of neighbours at a time, whose annuli are nearly one. Distances are exact integers, so
that ties are told and go to the lower index.

A round is one pass over the rows: codebooks (a fixed size) go to all tasks, sums and counts of the same size come back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.common import materialise
from cladeframe.llm.vectors import halves, integers, long_or_null, matrix, summed, whole

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Entries on either side of a part's norm that are looked at first.
FIRST = 2
#: Parts of neighbouring norms that share the entries of their annuli.
GROUP = 256
#: Rows whose codes are looked for at a time.
ROWS = 8192


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


class Codebook:
    """Entries by rising norm, for searches of the nearest one."""

    def __init__(self, entries: np.ndarray):
        entries = entries.astype(np.int64)
        norm = np.sqrt((entries.astype(np.float64) ** 2).sum(1))
        self.index = np.argsort(norm, kind="stable")
        self.norm, self.entries = norm[self.index], entries[self.index]
        # up to this size of components doubles hold every sum exactly; larger ones are integers of any size
        self.small = isqrt((1 << 51) // max(1, entries.shape[1]))
        self.large = _largest(entries) > self.small

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry to each row."""
        kind = object if self.large or _largest(x) > self.small else np.float64
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        order = np.argsort(norm, kind="stable")
        x, norm, entries = x[order].astype(kind), norm[order], self.entries.astype(kind)
        square, squares = (x * x).sum(1), (entries * entries).sum(1)
        middle, k = np.searchsorted(self.norm, norm), len(self.index)
        best = None
        for step in range(-FIRST, FIRST):
            far = x - entries[np.clip(middle + step, 0, k - 1)]
            far = (far * far).sum(1)
            best = far if best is None else np.minimum(best, far)
        reach = np.sqrt(best.astype(np.float64))
        reach += 1e-9 * (1 + reach + norm)  # rounding of norms must not leave an entry out
        low, high = np.searchsorted(self.norm, norm - reach), np.searchsorted(self.norm, norm + reach, side="right")
        code, error = np.zeros(len(x), np.int64), np.zeros(len(x), object if kind is object else np.int64)
        for at in range(0, len(x), GROUP):
            some = slice(at, at + GROUP)
            a, b = int(low[some].min()), int(high[some].max())
            far = square[some, None] + squares[None, a:b] - 2 * (x[some] @ entries[a:b].T)
            least = far.min(1)
            code[order[some]] = np.where(far == least[:, None], self.index[None, a:b], k).min(1)  # of ties the lower
            error[order[some]] = least
        return code, error


def _pieces(d: int, parts: int) -> list[slice]:
    return [slice(k * d // parts, (k + 1) * d // parts) for k in range(parts)]


def _round(rows: DataFrame, books: list[np.ndarray], d: int) -> list[np.ndarray]:
    """The codebooks after a round: every entry the floor of its parts' mean, unused ones as they are."""
    pieces, entries = _pieces(d, len(books)), len(books[0])
    sizes = [entries * (2 * (p.stop - p.start) + 1) for p in pieces]

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        held, out = [Codebook(b) for b in books], [np.zeros((entries, s // entries), np.int64) for s in sizes]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = matrix(batch.column(0).slice(at, ROWS))
                for book, piece, sums in zip(held, pieces, out, strict=True):
                    code = book.nearest(x[:, piece])[0]
                    order = np.argsort(code, kind="stable")
                    used, begin = np.unique(code[order], return_index=True)
                    width = piece.stop - piece.start
                    parts = np.hstack([*halves(x[:, piece]), np.ones((len(x), 1), np.int64)])[order]
                    if len(used) and width:
                        sums[used] += np.add.reduceat(parts, begin)
        return np.concatenate([s.ravel() for s in out])

    found, out = summed(rows.select("x"), partial, sum(sizes), np.int64), []
    for book, piece, part in zip(books, pieces, np.split(found, np.cumsum(sizes)[:-1]), strict=True):
        part, width = part.reshape(entries, -1), piece.stop - piece.start
        count = part[:, -1]
        total = whole(np.stack([part[:, :width], part[:, width : 2 * width]]))
        mean = [[int(s) // int(n) for s in row] if n else old for row, n, old in zip(total.tolist(), count.tolist(), book.tolist(), strict=True)]
        out.append(np.array(mean, np.int64).reshape(book.shape))
    return out


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Per row: id, code (two hexadecimal digits for each part), error, label_error, codebooks_sha256.

    Rows whose vector is null, empty, or holds null or non-finite components are left out, as are vectors of another length
    than the commonest. Codebooks start from the rows of smallest id (null ids last, equal ids by their vectors); fewer
    rows than entries give as many entries. A length that does not divide evenly is cut as evenly as it can be. Repeated
    rows count as often as they come, ties go to the lower entry, and null labels are one label. Errors beyond a long are
    null. Other columns are not read. An empty table gives an empty table.
    """
    if entries > 256:
        raise ValueError("a code has two hexadecimal digits for each part")
    spark = vectors.sparkSession
    kinds = dict(vectors.dtypes)
    out = f"`{id_col}` {kinds[id_col]}, code string, error long, label_error long, codebooks_sha256 string"
    rows, d = integers(vectors, {"id": id_col, "label": label_col}, vector_col, SCALE)
    if not d:
        return spark.createDataFrame([], out)
    rows = materialise(rows, "integers")
    first = rows.orderBy(F.asc_nulls_last("id"), "x").limit(entries).select("x").collect()  # ENTRIES vectors
    start = np.array([r.x for r in first], np.int64)
    pieces = _pieces(d, parts)
    books = [start[:, p] for p in pieces]
    for _ in range(rounds):
        books = _round(rows, books, d)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Codebook(b) for b in books]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                x = matrix(some.column(2))
                found = [book.nearest(x[:, p]) for book, p in zip(held, pieces, strict=True)]
                codes = np.stack([f[0] for f in found], 1).astype(np.uint8)
                error = sum(f[1].astype(object) if f[1].dtype == object else f[1] for f in found)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([r.tobytes().hex() for r in codes], pa.string()), long_or_null(error.tolist())], names=["id", "label", "code", "error"])

    coded = materialise(rows.select("id", "label", "x").mapInArrow(code, f"id {kinds[id_col]}, label {kinds[label_col]}, code string, error long"), "coded")
    labels = coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    met = coded.join(labels, F.col("label").eqNullSafe(F.col("of")))
    return met.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
