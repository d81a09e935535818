"""Exact top-k search by inner product with M-trees.

The rows are brought near each other and cut into chunks of bounded size; each becomes an M-tree, one row of a stored table: its pages
hold routing objects with covering radii and the distance to the parent's routing object, its leaf pages the rows with theirs. Inner
product becomes Euclidean distance by one more coordinate (``Lifted``). A block of queries descends a tree together, the most promising
page first. Before a distance is computed, the stored distance to the parent and the triangle inequality tell which queries can
need it at all.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import fresh, stored
from quire.llm.vectors import NONE, Best, Lifted, Queries, chunks, in_blocks, lists, matrix, products, ranked, searched, together, whole

#: Rows of a leaf page and entries of an inner one.
LEAF, FAN = 128, 16


@dataclass
class MTree:
    """Rows in the order of the leaf pages, and pages by number, the children of a page side by side.

    Page p holds ``first[p]`` to ``last[p]``: rows if ``leaf[p]``, else pages. ``router[p]`` is the row it is routed by, ``radius[p]`` covers all
    below, ``up[p]`` is the distance to the parent's router; ``to_router`` that of a row to its leaf page's router.
    """

    ids: np.ndarray
    rows: np.ndarray
    to_router: np.ndarray
    first: np.ndarray
    last: np.ndarray
    leaf: np.ndarray
    router: np.ndarray
    radius: np.ndarray
    up: np.ndarray

    def __post_init__(self) -> None:
        self.square = float(np.einsum("ij,ij->i", self.rows.astype(float), self.rows.astype(float)).max(initial=0))

    def search(self, queries: Queries, best: Best) -> None:
        """Offer ``best`` every row that may be among the best of a query; a row with the query's own id never is."""
        square, slack = self.square, queries.slack(self.square)
        everyone = np.arange(len(queries.id))

        def reach(who: np.ndarray) -> np.ndarray:
            """Rows farther away than this are worse than the k-th found."""
            low = best.low[who]
            return np.where(low > NONE, queries.distance(low, square, who) + slack[who], np.inf)

        def away(who: np.ndarray, pages: np.ndarray) -> np.ndarray:
            return queries.distance(products(queries.rows[who], self.rows[self.router[pages]]), square, who)

        start = away(everyone, np.array([0]))[:, 0]
        heap = [(0.0, 0, everyone, start)]
        while heap:
            _, page, who, d = heapq.heappop(heap)
            far = reach(who)
            keep = d - self.radius[page] <= far
            who, d, far = who[keep], d[keep], far[keep]
            if not len(who):
                continue
            a, b = self.first[page], self.last[page]
            if self.leaf[page]:
                needed = np.abs(d[:, None] - self.to_router[a:b]) <= far[:, None]
                some, rows = np.flatnonzero(needed.any(1)), a + np.flatnonzero(needed.any(0))
                score = products(queries.rows[who[some]], self.rows[rows])
                good = (score >= best.low[who[some]][:, None]) & (queries.id[who[some]][:, None] != self.ids[rows])
                of, at = np.nonzero(good)
                best.offer(who[some][of], score[of, at], self.ids[rows][at])
                continue
            needed = np.abs(d[:, None] - self.up[a:b]) - self.radius[a:b] <= far[:, None]
            pages = a + np.flatnonzero(needed.any(0))
            if not len(pages):
                continue
            needed = needed[:, pages - a]
            distance = away(who, pages)
            nearest = distance - self.radius[pages]
            needed &= nearest <= far[:, None]
            for j, child in enumerate(pages.tolist()):
                at = np.flatnonzero(needed[:, j])
                if len(at):
                    heapq.heappush(heap, (float(nearest[at, j].min()), child, who[at], distance[at, j]))


def build(ids: np.ndarray, rows: np.ndarray) -> MTree:
    """A tree by repeated assignment to the nearest of a few routing objects, top down."""
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    space = Lifted(rows)
    # pages in the order of their numbers: members, router, distance of the router to the parent's
    members: list[np.ndarray] = [np.arange(len(ids))]
    router, up, radius, leaf, first, last = [0], [0.0], [0.0], [], [], []
    kept: list[np.ndarray] = []
    to_router: list[np.ndarray] = []
    placed = page = 0
    while page < len(members):
        mine = members[page]
        own = space.between(mine, np.array([router[page]]))[:, 0]
        radius[page] = float(own.max(initial=0.0))
        leaf.append(len(mine) <= LEAF)
        if leaf[-1]:
            kept.append(mine)
            to_router.append(own)
            first.append(placed)
            placed += len(mine)
            last.append(placed)
        else:
            fan = min(FAN, math.ceil(len(mine) / LEAF))
            routers = mine[np.linspace(0, len(mine) - 1, fan).astype(int)]
            nearest = space.between(mine, routers).argmin(1)
            if np.bincount(nearest).max() > 0.9 * len(mine):
                # copies of few vectors: distances cannot part them evenly
                nearest = np.arange(len(mine)) * fan // len(mine)
            first.append(len(members))
            for j in np.unique(nearest).tolist():
                part = mine[nearest == j]
                centre = int(routers[j]) if routers[j] in part else int(part[0])
                members.append(part)
                router.append(centre)
                radius.append(0.0)
                up.append(float(space.between(np.array([centre]), np.array([router[page]]))[0, 0]))
            last.append(len(members))
        page += 1
    order = np.concatenate(kept)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return MTree(ids[order], rows[order], np.concatenate(to_router), np.array(first), np.array(last), np.array(leaf), place[router], np.array(radius), np.array(up))


_KINDS = {"ids": "array<bigint>", "rows": "array<array<int>>", "to_router": "array<double>", "first": "array<bigint>", "last": "array<bigint>",
          "leaf": "array<boolean>", "router": "array<bigint>", "radius": "array<double>", "up": "array<double>"}


def _row(tree: MTree) -> dict[str, pa.Array]:
    one = {}
    for f in fields(MTree):
        value = getattr(tree, f.name)
        column = lists(value) if f.name == "rows" else pa.array(value)
        one[f.name] = pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
    return one


def read_trees(batch: pa.RecordBatch) -> Iterator[MTree]:
    for i in range(batch.num_rows):
        one = {f.name: batch.column(f.name)[i].values for f in fields(MTree)}
        yield MTree(**{k: matrix(v) if k == "rows" else v.to_numpy(zero_copy_only=False) for k, v in one.items()})


def index(rows: DataFrame, is_query: str, k: int) -> DataFrame:
    """One row per tree over ``rows`` (id, v, ``is_query``), with ``asked``, the queries among its rows: their vectors and the ``k``-th score that they
    find in this tree, which every other tree has to reach."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            chunk = chunk.combine_chunks()
            ids, v = chunk.column("id").to_numpy(), matrix(chunk.column("v"))
            tree = build(ids, v)
            at = np.flatnonzero(chunk.column(is_query).to_numpy(zero_copy_only=False))
            queries = Queries(at, ids[at], v[at], np.zeros(len(at), np.int64))
            best = Best(len(at), k, np.full(len(at), NONE))
            if len(at):
                tree.search(queries, best)
            asked = pa.StructArray.from_arrays([pa.array(ids[at]), lists(v[at]), pa.array(best.low)], ["id", "v", "low"])
            row = _row(tree) | {"asked": pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), asked)}
            yield pa.RecordBatch.from_arrays(list(row.values()), list(row))

    kinds = ", ".join(f"{k} {v}" for k, v in _KINDS.items())
    return stored(together(rows).mapInArrow(grow, f"{kinds}, asked array<struct<id: bigint, v: array<int>, low: bigint>>"))


def top(
    df: DataFrame, is_query, k: int = 10, scale: int = 1024, key: str = "vec_id", vector: str = "embedding", block_rows: int | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of highest integer inner product for every row where the column ``is_query`` holds,
    equal scores by smaller id. Exact: a page is skipped only where no row of it can reach the k-th score.

    Null ids, null vectors and vectors with a null or non-finite component take no part, neither do those of a norm of 2^30 / ``scale`` or more.
    Rows equal in id and vector count once; a query meets no row of its own id, and of an id with several vectors each is a query and a
    candidate. Shorter vectors end in zeros, an empty one scores 0. An empty table gives none. Other columns are not read.
    """
    ask, = fresh(df, "is_query")
    rows = df.select(F.col(key).cast("long").alias("id"), whole(F.col(vector), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias(ask))
    rows = rows.filter("id is not null and v is not null").distinct().select("id", "v", F.col(ask).alias("ask"))
    trees = index(rows, "ask", k)
    asked = stored(trees.select(F.explode("asked").alias("q")).select("q.*"))
    width = asked.agg(F.max(F.size("v"))).first()[0] or 1
    pages = trees.drop("asked")

    def search(batches: Iterator[pa.RecordBatch], block: tuple[Queries, np.ndarray]) -> Iterator[pa.RecordBatch]:
        queries, low = block
        best = Best(len(low), k, low)
        for batch in batches:
            for tree in read_trees(batch):
                tree.search(queries, best)
        of, ids, score = best.found()
        yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int64)), pa.array(queries.id[of]), pa.array(ids), pa.array(score)], ["number", "query_id", "vec_id", "score"])

    found = []
    for block in in_blocks(asked, width, block_rows):
        got = block.toArrow()
        queries = Queries(np.arange(got.num_rows), got.column("id").to_numpy(), matrix(got.column("v")), np.zeros(got.num_rows, np.int64))
        part = searched(pages, (queries, got.column("low").to_numpy()), search, "number long, query_id long, vec_id long, score long")
        found.append(part.withColumn("block", F.lit(len(found))))
    if not found:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return ranked(out, ["block", "number"], "score", "vec_id", k).select("query_id", "rank", "vec_id", "score")
