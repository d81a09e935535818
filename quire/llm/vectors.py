"""Integer vectors, chunks of bounded size, blocks of queries and top lists: what the two metric trees have in common."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import stored

#: Rows of one tree; a task keeps one tree while it builds and one batch of them while it searches.
TREE_ROWS = 4096
#: Rows of a building task.
TASK_ROWS = 4 * TREE_ROWS
#: Reference vectors by which the rows are brought together before trees are built.
PIVOTS = 64
#: Bytes of vectors in a block of queries, which is broadcast.
BLOCK_BYTES = 16 << 20
#: Below every score. Inner products stay under 2^62 in size.
NONE = -(1 << 62)


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, as an array of int; null where a component is null or not finite, or where the
    integer norm is 2^30 or more (its inner products need not fit a long)."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * scale) < float(1 << 30)))
    norm = F.aggregate(vector, F.lit(0.0), lambda a, x: a + F.pow(x.cast("double") * scale, F.lit(2.0)))
    numbers = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int"))
    return F.when(fine, F.when(norm < float(1 << 60), numbers))


def matrix(column: pa.Array) -> np.ndarray:
    """A column of integer lists as a matrix; shorter lists end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    width = int(sizes.max(initial=0))
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def lists(rows: np.ndarray) -> pa.Array:
    """A matrix as a column of integer lists."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.astype(np.int32).ravel()))


def widened(rows: np.ndarray, width: int) -> np.ndarray:
    return rows if rows.shape[1] >= width else np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in doubles where no sum can pass 2^53, else in longs."""
    width = max(a.shape[1], b.shape[1])
    a, b = widened(a, width), widened(b, width)
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * width
    if most < float(1 << 53):
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


class Lifted:
    """Integer rows with one more coordinate that makes all norms equal. A query gets 0 there, so the nearest row by Euclidean distance
    is the one with the largest inner product, and inner products follow from distances."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        norms = products_of_self(rows)
        #: the square of the common norm
        self.square = float(norms.max(initial=0))
        self.extra = np.sqrt(np.maximum(self.square - norms, 0.0))

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of the rows numbered ``a`` to those numbered ``b``."""
        inner = products(self.rows[a], self.rows[b]) + self.extra[a][:, None] * self.extra[b]
        return np.sqrt(np.maximum(2 * self.square - 2 * inner, 0.0))


def products_of_self(rows: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", rows.astype(np.float64), rows.astype(np.float64))


@dataclass
class Queries:
    """A block of queries: numbers, ids, integer vectors, squared norms and labels (0 where there are none)."""

    number: np.ndarray
    id: np.ndarray
    rows: np.ndarray
    label: np.ndarray

    def __post_init__(self) -> None:
        self.norm = products_of_self(self.rows)

    def distance(self, score: np.ndarray, square: float, who: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The distance to a lifted row that has this inner product."""
        norm = self.norm[who].reshape(-1, *[1] * (score.ndim - 1))
        return np.sqrt(np.maximum(norm + square - 2.0 * score, 0.0))

    def slack(self, square: float) -> np.ndarray:
        """More than rounding can add to a distance."""
        return 1e-6 * (np.sqrt(self.norm) + math.sqrt(square) + 1)


class Best:
    """The ``k`` highest scores of each list with their ids; equal scores by smaller id. ``low``: what a score has to reach still."""

    def __init__(self, n: int, k: int, low: np.ndarray):
        self.k = k
        self.score = np.full((n, k), NONE, np.int64)
        self.id = np.zeros((n, k), np.int64)
        self.low = low.astype(np.int64).copy()

    def offer(self, of: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Scores of candidates for the lists ``of``; a candidate is offered to a list once."""
        fit = score >= self.low[of]
        of, score, ids = of[fit], score[fit], ids[fit]
        if not len(of):
            return
        touched = np.unique(of)
        had = self.score[touched] > NONE
        of = np.concatenate([of, np.repeat(touched, had.sum(1))])
        score = np.concatenate([score, self.score[touched][had]])
        ids = np.concatenate([ids, self.id[touched][had]])
        order = np.lexsort((ids, -score, of))
        of, score, ids = of[order], score[order], ids[order]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        keep = rank < self.k
        self.score[touched] = NONE
        self.score[of[keep], rank[keep]], self.id[of[keep], rank[keep]] = score[keep], ids[keep]
        self.low[touched] = np.maximum(self.low[touched], self.score[touched, -1])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, id, score) of all that is held."""
        of, at = np.nonzero(self.score > NONE)
        return of, self.id[of, at], self.score[of, at]


def together(rows: DataFrame, *first: str) -> DataFrame:
    """``rows`` (id, v, ...) stored once, with ``cell``, the nearest of some reference vectors, and dealt to tasks in ranges of (``first``, cell,
    hash of the id): near vectors meet, and a crowded cell or label is spread over as many tasks as it needs.

    The reference vectors are a bounded sample. They decide how close the rows of a tree lie, never what is found.
    """
    spark = rows.sparkSession
    chosen = rows.select("v").orderBy(F.xxhash64("id", F.lit(5))).limit(PIVOTS).collect()
    pivots = matrix(pa.array([r["v"] for r in chosen], pa.list_(pa.int32()))) if chosen else np.zeros((0, 0), np.int64)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norms = products_of_self(pivots)
        for batch in batches:
            if batch.num_rows and len(pivots):
                at = np.argmin(norms - 2.0 * products(matrix(batch.column("v")), pivots), axis=1)
                yield batch.append_column("cell", pa.array(at.astype(np.int32)))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    kept = stored(rows.mapInArrow(nearest, f"{kinds}, cell int"))
    n = kept.count()
    tasks = max(math.ceil(n / TASK_ROWS), min(spark.sparkContext.defaultParallelism, math.ceil(n / TREE_ROWS)), 1)
    return kept.repartitionByRange(tasks, *first, "cell", F.xxhash64("id")).sortWithinPartitions(*first, "cell")


def chunks(batches: Iterator[pa.RecordBatch], rows: int = TREE_ROWS) -> Iterator[pa.Table]:
    """The rows of a task in tables of at most ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - size)
            held.append(part)
            size += part.num_rows
            batch = batch.slice(part.num_rows)
            if size == rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def in_blocks(queries: DataFrame, width: int, rows: int | None = None) -> list[DataFrame]:
    """``queries`` (stored) in blocks by a hash of the id, each of a size that may be broadcast."""
    n = queries.count()
    blocks = max(1, math.ceil(n / (rows or max(1, BLOCK_BYTES // (8 * max(width, 1))))))
    return [queries.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)) == b) for b in range(blocks)] if n else []


def searched(trees: DataFrame, payload, search: Callable[[Iterator[pa.RecordBatch], object], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``search`` over the trees with a broadcast block of queries; the result is stored and the block released."""
    sent = trees.sparkSession.sparkContext.broadcast(payload)
    try:
        return stored(trees.mapInArrow(lambda batches: search(batches, sent.value), schema))
    finally:
        sent.destroy()


def ranked(found: DataFrame, of: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The ``k`` first of each list, with ``rank`` from 1. Tasks send ``k`` rows a list at most."""
    order = Window.partitionBy(*of).orderBy(F.col(score).desc(), F.col(tie).asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
