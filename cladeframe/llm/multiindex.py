"""Nearest neighbours by an inverted multi-index.

Each half of the vectors is quantised by its own K centroids (k-means on a bounded sample); a cell is a pair of
centroids, so there are K * K cells. A query walks the cells by rising sum of its two half-distances, with a heap over
the two sorted lists, until the cells it has met hold the share `visit` of all distinct vectors (k + 1 at least); those
entries are reranked by exact Euclidean distance in double precision. Every vector is indexed; K * K cell sizes are all
that the driver sees of them.

Equal vectors, told by a 64-bit hash, are one entry that keeps its k + 1 smallest ids, which is all that k nearest can need
of it; ids and hashes alone are sorted for that, a vector moves once. The cells of one first centroid are a group, cut into
blocks of about BLOCK entries. A query goes once to each block of each group in which it has cells, and takes with it
which; a block's entries are held by one task while its queries stream past.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.llm.common import BATCH_ROWS, materialise

K = 32
SAMPLE = 10_000
BLOCK = 4096
VISIT = 0.6
SALTS = 64
ROUNDS = 12


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)


def k_means(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centroids by Lloyd's rounds from distinct sampled starts; fewer distinct rows than k give as many centroids."""
    start = np.unique(sample, axis=0)
    centre = start[np.random.default_rng(seed).permutation(len(start))[:k]].copy()
    for _ in range(ROUNDS):
        near = squared(sample, centre).argmin(1)
        size = np.bincount(near, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, near, sample)
        centre[size > 0] = total[size > 0] / size[size > 0, None]
    return centre


def walk(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, wanted: float) -> list[int]:
    """Cells (i * len(right) + j, non-empty ones) by rising left[i] + right[j] until they hold `wanted` entries."""
    a, b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    heap, met, out, held = [(left[a[0]] + right[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(b) + int(b[j])
        if sizes[cell]:
            out.append(cell)
            held += int(sizes[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in met:
                met.add((x, y))
                heapq.heappush(heap, (left[a[x]] + right[b[y]], x, y))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _nearest(entries: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int):
    """For each query the rows of its k nearest entries and their exact distances; ties to smaller ids."""
    rough = squared(queries, entries)
    cut = np.partition(rough, k - 1, axis=1)[:, k - 1] if len(ids) > k else rough.max(1)
    slack = 1e-9 * (1 + np.abs(cut) + (queries * queries).sum(1))
    for q in range(len(queries)):
        some = np.flatnonzero(rough[q] <= cut[q] + slack[q])
        exact = np.sqrt(((entries[some] - queries[q]) ** 2).sum(1))
        order = np.lexsort((ids[some], exact))[:k]
        yield some[order], exact[order]


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", visit: float = VISIT) -> DataFrame:
    """Rows (query_id, rank, id, score): each query's k nearest other rows, nearest first, ties to the smaller id.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with a null id, nor
    vectors of another length than the most frequent one (no distance to them is defined). A query with fewer than k candidates gets them all. Rows that
    repeat an id with an equal vector count once. Other columns are not read. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    v = F.col("v")
    ok = v.isNotNull() & F.col("id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    every = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0)).alias("v"), is_query.alias("asks")).where(ok)
    out = "query_id long, rank int, vec_id long, score double".replace("vec_id", id_col)
    length = every.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None:
        return spark.createDataFrame([], out)
    every = every.where(F.size("v") == length.n)

    every = every.withColumn("h", F.xxhash64("v"))
    few = every.select("id", "h", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")).distinct()
    for key in (["h", "salt"], ["h"]):  # the smallest ids of each vector; a hot one first in shares
        few = few.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("id"))).where(F.col("nth") <= k + 1)
    ids = few.groupBy("h").agg(F.min("id").alias("entry"), F.array_sort(F.collect_list("id")).alias("ids"))
    one = every.groupBy("h").agg(F.first("v").alias("v"))  # one vector of each, first within tasks
    entries = materialise(ids.join(one, "h"), "entries")

    half = length.n // 2 or 1
    sample = _matrix(pa.array([r.v for r in entries.orderBy(F.xxhash64("entry"), "entry").limit(SAMPLE).select("v").collect()]))  # a bounded sample
    centres = k_means(sample[:, :half], K, 0), k_means(sample[:, half:], K, 1) if length.n > 1 else np.zeros((1, 0))
    cells = len(centres[0]) * len(centres[1])

    def halves(batch):
        x = _matrix(batch.column(batch.schema.get_field_index("v")))
        return x, squared(x[:, :half], centres[0]), squared(x[:, half:], centres[1])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, a, b = halves(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((a.argmin(1) * len(centres[1]) + b.argmin(1)).astype(np.int32))], names=[*batch.schema.names, "cell"])

    placed = materialise(entries.select("entry", "h", "v").mapInArrow(place, "entry long, h long, v array<double>, cell int"), "cells")
    sizes = np.zeros(cells, np.int64)
    for r in placed.groupBy("cell").count().collect():  # at most K * K rows
        sizes[r.cell] = r["count"]
    width = len(centres[1])
    blocks = -(-sizes.reshape(-1, width).sum(1) // BLOCK)

    asking = every.where("asks").select(F.col("id").alias("query_id"), "h").distinct()
    asked = placed.join(asking.groupBy("h").agg(F.min("query_id").alias("query")), "h").select("query", "v")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = max(visit * sizes.sum(), k + 1)
        for batch in batches:
            _, a, b = halves(batch)
            row, group, block, cell = [], [], [], []
            for q in range(batch.num_rows):
                met: dict[int, list[int]] = {}
                for c in walk(a[q], b[q], sizes, wanted):
                    met.setdefault(c // width, []).append(c % width)
                for g, found in met.items():
                    for x in range(int(blocks[g])):
                        row.append(q)
                        group.append(g)
                        block.append(x)
                        cell.append(found)
            for at in range(0, len(row), BATCH_ROWS):
                some = batch.take(pa.array(row[at : at + BATCH_ROWS]))
                upto = at + some.num_rows
                columns = [pa.array(group[at:upto], pa.int32()), pa.array(block[at:upto], pa.int32()), pa.array([True] * some.num_rows), pa.array(cell[at:upto], pa.list_(pa.int32())), some.column(0), some.column(1)]
                yield pa.RecordBatch.from_arrays(columns, names=["group", "block", "asks", "cells", "key", "v"])

    probes = asked.mapInArrow(probe, "group int, block int, asks boolean, cells array<int>, key long, v array<double>")
    group = F.floor(F.col("cell") / width).cast("int")
    counts = F.array(*(F.lit(int(x)) for x in np.maximum(blocks, 1)))
    stored = placed.select(group.alias("group"), F.pmod(F.xxhash64("entry"), F.get(counts, group)).cast("int").alias("block"), F.lit(False).alias("asks"), F.array(F.col("cell") % width).cast("array<int>").alias("cells"), F.col("entry").alias("key"), "v")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, table = None, [], None
        for batch in batches:
            group, block, asks, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2, 4))
            some, x = batch.column(3), _matrix(batch.column(5))
            cuts = np.flatnonzero((np.diff(group) != 0) | (np.diff(block) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(group)], strict=True):
                if (group[a], block[a]) != now:
                    now, held, table = (group[a], block[a]), [], None
                if not asks[a]:
                    held.append((x[a:b], key[a:b], some.slice(a, b - a).flatten().to_numpy()))
                    continue
                if not held:
                    continue
                if table is None:
                    table = [np.concatenate(part) for part in zip(*held, strict=True)]
                query, entry, far = [], [], []
                for q in range(a, b):
                    inside = np.zeros(width, bool)
                    inside[some[q].as_py()] = True
                    there = np.flatnonzero(inside[table[2]])
                    for near, exact in _nearest(table[0][there], table[1][there], x[q : q + 1], k + 1) if len(there) else ():
                        query.append(np.full(len(near), key[q]))
                        entry.append(table[1][there[near]])
                        far.append(exact)
                if query:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in (query, entry, far)], names=["query", "entry", "score"])

    met = probes.union(stored).repartition("group", "block").sortWithinPartitions("group", "block", "asks").mapInArrow(rerank, "query long, entry long, score double")
    best = met.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy("score", "entry"))).where(F.col("nth") <= k + 1)
    named = best.join(entries.select("entry", "ids"), "entry").select("query", F.explode("ids").alias("id"), "score")
    lists = named.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "id"))), 1, k + 1).alias("near"))  # at most (k + 1) ** 2
    answered = asking.join(asking.groupBy("h").agg(F.min("query_id").alias("query")), "h").select("query_id", "query").join(lists, "query")
    own = F.slice(F.filter("near", lambda n: n["id"] != F.col("query_id")), 1, k)
    rows = answered.select("query_id", F.posexplode(own).alias("pos", "n"))
    return rows.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("n.id").alias(id_col), F.col("n.score").alias("score"))
