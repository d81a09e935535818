"""Hard negatives by windows of the inner product, found with cover trees over norm-augmented rows.

The rows are sorted by label and nearness and cut into chunks of bounded size; each becomes a cover tree, one row of a stored table. A node
of level i covers all below it within BASE^i; its children, at most BASE^(i-1) wide, are rows more than BASE^(i-1) apart. The augmented
coordinate gives all rows of a tree one norm, so the radius of a node bounds the inner products below it from both sides. The first pass
finds the positives of each anchor (best of the same label), the second the best of other labels within each positive's window:
a block of anchors descends a tree together, best bound first, and passes by nodes that lie outside of every window.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import stored
from quire.llm.vectors import NONE, Best, Lifted, Queries, chunks, in_blocks, lists, matrix, products, products_of_self, ranked, searched, together, whole

#: Ratio of the radii of neighbouring levels.
BASE = 1.25
#: A node of so many rows or fewer is a leaf, and one whose rows are too far apart to be grouped.
LEAF = 64
#: An anchor without a further window asks for scores from here on, which no pair reaches.
NEVER = 1 << 62


@dataclass
class CoverTree:
    """Rows in the order of the leaves, and nodes by number. Node i is centred on the row ``centre[i]``, is of ``level[i]`` and holds nodes ``first[i]``
    to ``last[i]``, or rows if ``leaf[i]``. ``radius[i]``: the distance of the farthest row below, BASE ^ level at most."""

    ids: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    first: np.ndarray
    last: np.ndarray
    leaf: np.ndarray
    level: np.ndarray
    centre: np.ndarray
    radius: np.ndarray

    def __post_init__(self) -> None:
        self.square = float(products_of_self(self.rows).max(initial=0))
        self.one_label = int(self.labels[0]) if len(self.labels) and (self.labels == self.labels[0]).all() else None

    def search(self, queries: Queries, same: bool, low: np.ndarray, high: np.ndarray, best: Best) -> None:
        """Offer ``best`` the rows of the same label (or of other labels) whose score lies in the window j of a query, ``low[q, j]`` to ``high[q, j]``;
        list q * windows + j takes them. A row of the query's own id is no candidate."""
        square, slack, windows = self.square, queries.slack(self.square), low.shape[1]
        who = np.flatnonzero((low <= high).any(1))
        if self.one_label is not None:
            who = who[(queries.label[who] == self.one_label) == same]
        if not len(who):
            return

        def bounds(d: np.ndarray, who: np.ndarray, radius) -> tuple[np.ndarray, np.ndarray]:
            """The lowest and the highest inner product within ``radius`` of a node's centre that is ``d`` away."""
            shape = (-1, *[1] * (d.ndim - 1))
            mean, gap = (queries.norm[who] + square).reshape(shape), slack[who].reshape(shape)
            return (mean - (d + radius + gap) ** 2) / 2, (mean - np.maximum(d - radius - gap, 0) ** 2) / 2

        def open_to(worst: np.ndarray, most: np.ndarray, who: np.ndarray) -> np.ndarray:
            """Has the node room in a window that its list could still use?"""
            lows = np.maximum(low[who], best.low.reshape(-1, windows)[who])
            return ((most[:, None] >= lows) & (worst[:, None] <= high[who]) & (lows <= high[who])).any(1)

        def away(who: np.ndarray, nodes: np.ndarray) -> np.ndarray:
            return queries.distance(products(queries.rows[who], self.rows[self.centre[nodes]]), square, who)

        heap = [(0.0, 0, who, away(who, np.array([0]))[:, 0])]
        while heap:
            _, node, who, d = heapq.heappop(heap)
            keep = open_to(*bounds(d, who, self.radius[node]), who)
            who = who[keep]
            if not len(who):
                continue
            a, b = self.first[node], self.last[node]
            if self.leaf[node]:
                score = products(queries.rows[who], self.rows[a:b])
                fit = ((queries.label[who][:, None] == self.labels[a:b]) == same) & (queries.id[who][:, None] != self.ids[a:b])
                for j in range(windows):
                    least = np.maximum(low[who, j], best.low.reshape(-1, windows)[who, j])
                    of, at = np.nonzero(fit & (score >= least[:, None]) & (score <= high[who, j][:, None]))
                    best.offer(who[of] * windows + j, score[of, at], self.ids[a:b][at])
                continue
            children = np.arange(a, b)
            distance = away(who, children)
            worst, most = bounds(distance, who, self.radius[children])
            for j, child in enumerate(children.tolist()):
                at = np.flatnonzero(open_to(worst[:, j], most[:, j], who))
                if len(at):
                    heapq.heappush(heap, (-float(most[at, j].max()), child, who[at], distance[at, j]))


def _net(space: Lifted, mine: np.ndarray, centre: int, width: float, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Rows more than ``width`` apart that cover ``mine`` within it, and the nearest of them for each; None where they would be over ``most``."""
    near = space.between(mine, np.array([centre]))[:, 0]
    owner, chosen = np.zeros(len(mine), np.int64), [centre]
    while (far := int(near.argmax())) is not None and near[far] > width:
        if len(chosen) == most:
            return None
        chosen.append(int(mine[far]))
        other = space.between(mine, mine[far : far + 1])[:, 0]
        closer = other < near
        owner[closer], near[closer] = len(chosen) - 1, other[closer]
    return np.array(chosen), owner


def build(ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> CoverTree:
    """A cover tree, top down: a node's rows are parted by the widest level at which more than one centre is needed."""
    order = np.argsort(ids, kind="stable")
    ids, labels, rows = ids[order], labels[order], rows[order]
    space = Lifted(rows)
    members, centre = [np.arange(len(ids))], [0]
    first, last, leaf, level, radius = [], [], [], [], []
    kept: list[np.ndarray] = []
    placed = node = 0
    while node < len(members):
        mine = members[node]
        wide = float(space.between(mine, np.array([centre[node]]))[:, 0].max(initial=0.0))
        radius.append(wide)
        level.append(math.ceil(math.log(wide, BASE)) if wide > 0 else 0)
        net = None
        if len(mine) > LEAF and wide > 1:
            i = level[-1] - 1
            while BASE**i >= wide:
                i -= 1
            net = _net(space, mine, centre[node], BASE**i, max(2, len(mine) // 4))
        leaf.append(net is None)
        if net is None:
            kept.append(mine)
            first.append(placed)
            placed += len(mine)
            last.append(placed)
        else:
            first.append(len(members))
            for j, c in enumerate(net[0].tolist()):
                members.append(mine[net[1] == j])
                centre.append(c)
            last.append(len(members))
        node += 1
    order = np.concatenate(kept)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return CoverTree(ids[order], labels[order], rows[order], np.array(first), np.array(last), np.array(leaf), np.array(level), place[centre], np.array(radius))


_KINDS = {"ids": "array<bigint>", "labels": "array<bigint>", "rows": "array<array<int>>", "first": "array<bigint>", "last": "array<bigint>", "leaf": "array<boolean>",
          "level": "array<bigint>", "centre": "array<bigint>", "radius": "array<double>"}


def read_trees(batch: pa.RecordBatch) -> Iterator[CoverTree]:
    for i in range(batch.num_rows):
        one = {f.name: batch.column(f.name)[i].values for f in fields(CoverTree)}
        yield CoverTree(**{k: matrix(v) if k == "rows" else v.to_numpy(zero_copy_only=False) for k, v in one.items()})


def index(rows: DataFrame, k: int) -> DataFrame:
    """One row per tree over ``rows`` (id, v, label, ask), with ``asked``, the anchors among its rows and the ``k``-th score of their label in this tree."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            chunk = chunk.combine_chunks()
            ids, labels, v = chunk.column("id").to_numpy(), chunk.column("label").to_numpy(), matrix(chunk.column("v"))
            tree = build(ids, labels, v)
            at = np.flatnonzero(chunk.column("ask").to_numpy(zero_copy_only=False))
            best = Best(len(at), k, np.full(len(at), NONE))
            if len(at):
                tree.search(Queries(at, ids[at], v[at], labels[at]), True, np.full((len(at), 1), NONE), np.full((len(at), 1), NEVER - 1), best)
            row = {}
            for f in fields(CoverTree):
                value = getattr(tree, f.name)
                column = lists(value) if f.name == "rows" else pa.array(value)
                row[f.name] = pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
            asked = pa.StructArray.from_arrays([pa.array(ids[at]), lists(v[at]), pa.array(labels[at]), pa.array(best.low)], ["id", "v", "label", "low"])
            row["asked"] = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), asked)
            yield pa.RecordBatch.from_arrays(list(row.values()), list(row))

    kinds = ", ".join(f"{k} {v}" for k, v in _KINDS.items())
    return stored(together(rows, "label").mapInArrow(grow, f"{kinds}, asked array<struct<id: bigint, v: array<int>, label: bigint, low: bigint>>"))


def _search(same: bool, k: int):
    def search(batches: Iterator[pa.RecordBatch], block: tuple[Queries, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        queries, low, high = block
        windows = low.shape[1]
        best = Best(low.size, k, low.ravel())
        for batch in batches:
            for tree in read_trees(batch):
                tree.search(queries, same, low, high, best)
        of, ids, score = best.found()
        columns = [of // windows, of % windows, ids, score]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["number", "slot", "other", "score"])

    return search


def mine(
    df: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256,
    key: str = "vec_id", vector: str = "embedding", label: Column | str = "label", block_rows: int | None = None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row where ``is_anchor`` holds and each of its
    ``positives`` best rows of the same label, the ``negatives`` best rows of other labels whose score is ``least`` to ``most`` per cent of the positive's.

    Scores are integer inner products, equal ones go by smaller id. Exact: a node is passed by only where no row below can lie in a window
    or reach its list. Null ids, labels and vectors and vectors with a null or non-finite component take no part, neither do those of a
    norm of 2^30 / ``scale`` or more. Rows equal in id, label and vector count once; rows of the anchor's own id are no candidates. Positive scores under 0
    have empty windows, shorter vectors end in zeros, an empty table gives none. Other columns are not read.
    """
    kind = F.col(label) if isinstance(label, str) else label
    rows = df.select(
        F.col(key).cast("long").alias("id"), whole(F.col(vector), scale).alias("v"), kind.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("ask"),
    )
    rows = rows.filter("id is not null and v is not null and label is not null").distinct()
    trees = index(rows, positives)
    asked = stored(trees.select(F.explode("asked").alias("q")).select("q.*"))
    width = asked.agg(F.max(F.size("v"))).first()[0] or 1
    nodes = trees.drop("asked")
    schema = "number long, slot long, other long, score long"
    found = []
    for block in in_blocks(asked, width, block_rows):
        got = block.toArrow()
        queries = Queries(np.arange(got.num_rows), got.column("id").to_numpy(), matrix(got.column("v")), got.column("label").to_numpy())
        low = got.column("low").to_numpy()[:, None]
        near = searched(nodes, (queries, low, np.full(low.shape, NEVER - 1)), _search(True, positives), schema)
        own = ranked(near, ["number"], "score", "other", positives).orderBy("number", "rank").toArrow()
        number, slot, score = own.column("number").to_numpy(), own.column("rank").to_numpy() - 1, own.column("score").to_numpy()
        low, high = np.full((got.num_rows, positives), NEVER), np.full((got.num_rows, positives), NONE)
        chosen, scores = np.zeros((2, got.num_rows, positives), np.int64)
        low[number, slot], high[number, slot] = -((-least * score) // 100), (most * score) // 100
        chosen[number, slot], scores[number, slot] = own.column("other").to_numpy(), score
        part = searched(nodes, (queries, low, high), _search(False, negatives), schema)
        # ids and scores of the positives travel with the block's answer, not through a join
        lists_ = part.sparkSession.createDataFrame(
            pa.table({"number": pa.array(number), "slot": pa.array(slot.astype(np.int64)), "anchor_id": pa.array(queries.id[number]),
                      "positive_id": pa.array(chosen[number, slot]), "positive_score": pa.array(scores[number, slot])})
        ) if len(number) else None
        if lists_ is not None:
            found.append(part.join(F.broadcast(lists_), ["number", "slot"]).withColumn("block", F.lit(len(found))))
    if not found:
        return df.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    out = ranked(out, ["block", "number", "slot"], "score", "other", negatives)
    return out.select("anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
