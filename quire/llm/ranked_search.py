"""Ranked lexical search: the best documents of every item, by posting lists with range-maximum tables.

One scan of the documents turns each task's rows into shards of bounded size: posting lists of the terms that the items ask for, and
the sums that the weights need. Over a shard every posting list has a sparse table (the place of the highest impact in any run of 2^j
postings). A search starts with the interval of all documents of the shard, takes the intervals of the highest bound first,
scores the document of the highest impact in each exactly, and goes on with what lies left and right of it; the bound of an
interval is the sum of its lists' range maxima. It ends when no interval can reach the k-th score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import ALNUM, pieces, stored, words_of
from quire.llm.vectors import ranked

#: Postings of a shard (the documents at its end are taken whole) and bytes of item texts in a block, which is broadcast.
POSTINGS, BLOCK_BYTES = 1 << 19, 32 << 20
#: Intervals that are split at once: few at first, so that the k-th score is known soon.
FEWEST, MOST = 4, 512
#: Fixed values of the weights: document lengths count for 75 in 100, and scores are whole numbers.
FLAT, SCALE, TF_SCALE, LENGTH_SCALE = 75, 1_000_000_000, 1000, 8


@dataclass
class Items:
    """A block of items: their rows in it, the sorted hashes of all their terms, and per item the terms' places there with their counts."""

    hashes: np.ndarray
    terms: list[tuple[np.ndarray, np.ndarray]]


def items_of(texts: pa.Array) -> Items:
    words = words_of(texts, ALNUM)
    hashes, place = np.unique(words.hash, return_inverse=True)
    return Items(hashes, [np.unique(place[a:b], return_counts=True) for a, b in zip(words.first[:-1], words.first[1:])])


def postings(words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) of the terms of a batch that stand in ``hashes``, in the order of documents and terms."""
    if not len(hashes) or not len(words.hash):
        return (np.zeros(0, np.int64),) * 3
    at = np.minimum(np.searchsorted(hashes, words.hash), len(hashes) - 1)
    hit = np.flatnonzero(hashes[at] == words.hash)
    key, count = np.unique(words.doc[hit] * len(hashes) + at[hit], return_counts=True)
    return key // len(hashes), key % len(hashes), count


@dataclass
class Shard:
    """Posting lists side by side: ``start[t]`` to ``start[t + 1]`` are the postings of term t, by document."""

    start: np.ndarray
    doc: np.ndarray
    impact: np.ndarray
    n_docs: int

    def __post_init__(self) -> None:
        n = len(self.doc)
        longest = int(np.diff(self.start).max(initial=1))
        # peak[j][i] is the place of the highest impact among the 2^j postings from i on; a run that passes the end of a list is never asked for
        self.peak = np.empty((max(longest, 1).bit_length(), n), np.int32)
        self.peak[0] = np.arange(n)
        for j in range(1, len(self.peak)):
            half = 1 << (j - 1)
            self.peak[j] = self.peak[j - 1]
            left, right = self.peak[j - 1][: n - half], self.peak[j - 1][half:]
            self.peak[j][: n - half] = np.where(self.impact[left] >= self.impact[right], left, right)
        self.key = np.repeat(np.arange(len(self.start) - 1), np.diff(self.start)) * self.n_docs + self.doc
        self.log = np.frexp(np.arange(longest + 1))[1] - 1

    def highest(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and size of the highest impact between ``low`` and ``high``; size 0 where there is nothing."""
        some = high > low
        level = self.log[np.where(some, high - low, 1)]
        low = np.where(some, low, 0)
        left, right = self.peak[level, low], self.peak[level, np.where(some, high - (1 << level), 0)]
        place = np.where(self.impact[left] >= self.impact[right], left, right)
        return place, np.where(some, self.impact[place], 0)

    def search(self, terms: np.ndarray, counts: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the ``k`` highest scores of ``least`` and more, over 0; equal scores by document."""
        held = self.start[terms + 1] > self.start[terms]
        terms, counts = terms[held], counts[held]
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        least = max(least, 1)
        after = self.n_docs
        if not len(terms):
            return docs, scores
        base = terms * self.n_docs
        low, high = self.start[terms][None], self.start[terms + 1][None]
        place, size = self.highest(low, high)
        size = size * counts
        begin, bound, width = np.zeros(1, np.int64), size.sum(1), FEWEST
        while len(bound):
            # the rest can't reach the k-th score, or only equal it with a later document
            keep = np.flatnonzero((bound > least) | ((bound == least) & (begin < after)))
            if len(keep) > width:
                order = np.argpartition(-bound[keep], width)
                keep, rest = keep[order[:width]], keep[order[width:]]
            else:
                rest = keep[:0]
            if not len(keep):
                break
            top = size[keep].argmax(1)
            split = self.doc[place[keep, top]].astype(np.int64)
            at = np.searchsorted(self.key, base + split[:, None])
            there = (at < high[keep]) & (self.key[np.minimum(at, len(self.key) - 1)] == base + split[:, None])
            score = np.where(there, self.impact[np.minimum(at, len(self.key) - 1)] * counts, 0).sum(1)
            docs, scores = np.concatenate([docs, split]), np.concatenate([scores, score])
            best = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[best], scores[best]
            if len(docs) == k and scores[-1] >= least:
                least, after = int(scores[-1]), int(docs[-1])
            # left and right of the split
            new_low, new_high = np.concatenate([low[keep], at + there]), np.concatenate([at, high[keep]])
            new_begin = np.concatenate([begin[keep], split + 1])
            new_place, new_size = self.highest(new_low, new_high)
            new_size = new_size * counts
            new_bound = new_size.sum(1)
            alive = new_bound >= least
            low, high = np.concatenate([low[rest], new_low[alive]]), np.concatenate([high[rest], new_high[alive]])
            place, size = np.concatenate([place[rest], new_place[alive]]), np.concatenate([size[rest], new_size[alive]])
            begin, bound = np.concatenate([begin[rest], new_begin[alive]]), np.concatenate([bound[rest], new_bound[alive]])
            width = min(2 * width, MOST)
        good = scores >= least
        return docs[good], scores[good]


def _shards(docs: DataFrame, hashes: np.ndarray) -> DataFrame:
    """(docs, ids, lengths, terms, term, doc, tf): a row per shard. ``docs`` and ``terms`` count the documents with a term and all their terms, ``ids``
    the documents that hold a term of the items, in their order."""
    kind = docs.schema["id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(hashes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, totals, size = [], [0, 0], 0

        def row() -> pa.RecordBatch:
            ids = pa.concat_arrays([h[0] for h in held])
            lengths = np.concatenate([h[1] for h in held])
            order = pc.sort_indices(ids, sort_keys=[("", "ascending")], null_placement="at_end").to_numpy()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            before = np.cumsum([0, *[len(h[0]) for h in held]])
            doc = place[np.concatenate([h[2] + b for h, b in zip(held, before)])]
            term, tf = np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held])
            by = np.lexsort((doc, term))
            values = {"ids": ids.take(pa.array(order)), "lengths": pa.array(lengths[order]), "term": pa.array(term[by].astype(np.int32)),
                      "doc": pa.array(doc[by].astype(np.int32)), "tf": pa.array(tf[by])}
            lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in values.values()]
            return pa.RecordBatch.from_arrays([pa.array([totals[0]]), pa.array([totals[1]]), *lists], ["docs", "terms", *values])

        for batch in batches:
            for piece in pieces(batch):
                words = words_of(piece.column("text"), ALNUM)
                lengths = np.diff(words.first)
                totals[0] += int((lengths > 0).sum())
                totals[1] += int(lengths.sum())
                doc, term, tf = postings(words, sent.value)
                own, place = np.unique(doc, return_inverse=True)
                held.append((piece.column("id").take(pa.array(own)), lengths[own], place.astype(np.int64), term, tf))
                size += len(term)
                if size >= POSTINGS:
                    yield row()
                    held, totals, size = [], [0, 0], 0
        if held:
            yield row()

    schema = f"docs long, terms long, ids array<{kind}>, lengths array<long>, term array<int>, doc array<int>, tf array<long>"
    try:
        return stored(docs.mapInArrow(write, schema))
    finally:
        sent.destroy()


def _frequencies(shards: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The terms of the items that documents hold, and in how many; bounded by the block of items."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, n = np.unique(batch.column("term").flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(n)], ["term", "n"])

    got = shards.select("term").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    return got.column("term").to_numpy(), got.column("n").to_numpy()


def impacts(term: np.ndarray, tf: np.ndarray, length: np.ndarray, weight: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a posting adds to a score, by its term, its count and the length of its document."""
    # FLAT * length * n can pass a long, so the few different lengths are done in Python's numbers
    lengths, at = np.unique(length, return_inverse=True)
    m = np.array([100 - FLAT + (FLAT * x * n) // total for x in lengths.tolist()], np.int64)[at]
    return weight[term] * ((SCALE * tf) // (TF_SCALE * tf + LENGTH_SCALE * m))


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(item, rank, key, score): for every item the ``k`` documents of the highest score over 0, equal scores by ascending key (null last).

    Exact: an interval of documents is left out only where the sum of its maxima cannot reach the k-th score. Terms are told apart by 64-bit
    hashes. Null and empty texts have no terms: such documents don't count, such items find nothing. Every row is a document of its own,
    repeated keys and copies too; rows equal in item and text are one item, and of an item id with several texts each is ranked by itself. An
    item whose terms no document holds has no rows. Other columns are not read. The items are read in blocks of ``block_bytes`` of text,
    one scan of the documents for each.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    asked = stored(items.select(F.col(item).alias("id"), F.coalesce(item_text, F.lit("")).alias("text")).distinct())
    kind, item_kind = rows.schema["id"].dataType.simpleString(), asked.schema["id"].dataType.simpleString()
    schema = f"block int, number long, item {item_kind}, id {kind}, score long"
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    out = spark.createDataFrame([], schema)
    for b in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).toArrow().combine_chunks()
        if not block.num_rows:
            continue
        texts, names = (block.column(c).combine_chunks() for c in ("text", "id"))
        wanted = items_of(texts)
        shards = _shards(rows, wanted.hashes)
        n, total = shards.agg(F.sum("docs"), F.sum("terms")).first()
        if not total:
            continue
        term, df = _frequencies(shards)
        weight = np.zeros(len(wanted.hashes), np.int64)
        weight[term] = [math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()]
        sent = spark.sparkContext.broadcast((wanted.terms, names, weight))

        def rank(batches: Iterator[pa.RecordBatch], b: int = b, n: int = n, total: int = total, sent=sent) -> Iterator[pa.RecordBatch]:
            terms, names, weight = sent.value
            seen = np.zeros((len(terms), k), np.int64)
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, lengths, term, doc, tf = (batch.column(c)[i].values for c in ("ids", "lengths", "term", "doc", "tf"))
                    lengths, term, doc, tf = (c.to_numpy() for c in (lengths, term, doc, tf))
                    if not len(term):
                        continue
                    impact = impacts(term, tf, lengths[doc], weight, n, total)
                    shard = Shard(np.searchsorted(term, np.arange(len(weight) + 1)), doc, impact, len(lengths))
                    of, found, scores = [], [], []
                    for number, (wanted, counts) in enumerate(terms):
                        documents, score = shard.search(wanted, counts, k, int(seen[number, -1]))
                        seen[number] = -np.sort(-np.concatenate([seen[number], score]))[:k]
                        of.append(np.full(len(score), number))
                        found.append(documents)
                        scores.append(score)
                    number = pa.array(np.concatenate(of).astype(np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(number), b, np.int32)), number, names.take(number), ids.take(pa.array(np.concatenate(found))), pa.array(np.concatenate(scores))],
                        ["block", "number", "item", "id", "score"],
                    )

        out = out.unionByName(stored(shards.drop("docs", "terms").mapInArrow(rank, schema)))
        sent.destroy()
    best = ranked(out, ["block", "number"], "score", "id", k)
    return best.select(F.col("item").alias(item), "rank", F.col("id").alias(key), "score")
