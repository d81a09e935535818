"""Benchmark decontamination by winnowing.

Of every six neighbouring five-grams the one with the smallest hash is kept as a fingerprint, so two texts that share ten
words share a fingerprint. Fingerprints of documents are joined with those of the benchmark; each match is extended to the
ten-word windows around it, which are compared whole (64-bit hashes of the words). Items shorter than a window are looked
up as runs of their own length.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import ALNUM, fresh, grams, in_one_text, pieces, words_of

WINDOW, GRAM = 10, 5
#: Bytes of benchmark text per block. A block's windows (24 bytes a word) are sent to every executor; a larger benchmark
#: takes several passes over the documents, one a block.
BLOCK_BYTES = 32 << 20


def fingerprints(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the five-grams that are smallest in one of the windows of ten words they lie in."""
    five = grams(hashes, GRAM)
    inside = np.flatnonzero(in_one_text(first, WINDOW))
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    span = WINDOW - GRAM + 1
    least = five[inside].copy()
    for j in range(1, span):
        np.minimum(least, five[inside + j], out=least)
    chosen = np.zeros(len(five), bool)
    for j in range(span):
        chosen[inside[five[inside + j] == least] + j] = True
    places = np.flatnonzero(chosen)
    return places, five[places]


class Block:
    """What the benchmark items of one block look like: fingerprints, windows and the items that hold each."""

    def __init__(self, items: list[tuple[str, str]]):
        words = words_of(pa.array([t for _, t in items], pa.string()), ALNUM)
        owner = words.doc
        counts = np.diff(words.first)
        self.prints = np.unique(fingerprints(words.hash, words.first)[1])
        # a cheap first test by 20 bits of the hash
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.prints >> np.uint64(44)).astype(np.int64)] = True
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in sorted({min(int(c), WINDOW) for c in counts if c}):
            places = np.flatnonzero(in_one_text(words.first, length))
            fits = counts[owner[places]] >= WINDOW if length == WINDOW else counts[owner[places]] == length
            places = places[fits]
            keys, owners = grams(words.hash, length)[places], owner[places]
            order = np.lexsort((owners, keys))
            keys, owners = keys[order], owners[order]
            unique, begin = np.unique(keys, return_index=True)
            self.tables[length] = (unique, np.append(begin, len(keys)), owners)
        self.names = [n for n, _ in items]

    def hits(self, words) -> dict[int, tuple[set[str], list[tuple[int, int]]]]:
        """By document: the items that occur in it, and the runs of words (from, to) where they do."""
        found: dict[int, tuple[set[str], list[tuple[int, int]]]] = defaultdict(lambda: (set(), []))
        owner = words.doc
        for length, (keys, begin, owners) in self.tables.items():
            whole = in_one_text(words.first, length)
            if length == WINDOW:
                places, prints = fingerprints(words.hash, words.first)
                near = self.sieve[(prints >> np.uint64(44)).astype(np.int64)]
                places, prints = places[near], prints[near]
                places = places[_index(self.prints, prints) >= 0]
                places = np.unique((places[:, None] - np.arange(WINDOW - GRAM + 1)).ravel())
                places = places[(places >= 0) & (places < len(whole))]
                places = places[whole[places]]
                values = np.zeros(len(places), np.uint64)
                for j in range(0, len(places), 1 << 16):
                    runs = places[j : j + (1 << 16), None] + np.arange(WINDOW)
                    values[j : j + (1 << 16)] = _gram_rows(words.hash[runs])
            else:
                places = np.flatnonzero(whole)
                values = grams(words.hash, length)[places]
            at = _index(keys, values)
            for place, row in zip(places[at >= 0].tolist(), at[at >= 0].tolist()):
                items, runs = found[int(owner[place])]
                items.update(self.names[o] for o in owners[begin[row] : begin[row + 1]].tolist())
                runs.append((place, place + length))
        return found


def _gram_rows(rows: np.ndarray) -> np.ndarray:
    """``grams`` of rows of words."""
    flat = grams(rows.ravel(), rows.shape[1])
    return flat[:: rows.shape[1]]


def _index(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where ``values`` stand in the sorted ``keys``, or -1."""
    if not len(keys):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, at, -1)


def _blocks(benchmark: DataFrame, key: str, text: str, size: int):
    """Blocks of whole items, read one partition at a time."""
    rows, used = [], 0
    items = benchmark.select(F.col(key).cast("string"), F.coalesce(F.col(text), F.lit("")))
    for name, words in items.toLocalIterator():
        rows.append(("" if name is None else name, words))
        used += len(words)
        if used >= size:
            yield rows
            rows, used = [], 0
    if rows:
        yield rows


def _union(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    block_bytes: int = BLOCK_BYTES, out: str = "leak",
) -> DataFrame:
    """``docs`` with a struct ``out``: ``n_words``, ``runs`` (from, to: words that lie in an occurring window, disjoint, in order)
    and ``items`` (ids of items with an occurring window, as strings, sorted by code point).

    Rows are judged one by one and nothing is shuffled: copies agree, an empty table stays empty. Null texts and items have no
    words. An item without words matches nothing; repeated item ids count once, a null id is ''. A column named like ``out`` is replaced.
    """
    spark: SparkSession = docs.sparkSession
    rest = [c for c in docs.columns if c != out]
    state = docs.select(*[F.col(f"`{c}`") for c in rest])
    kind = "n_words long, runs array<struct<a: int, b: int>>, items array<string>"
    (got,) = fresh(state, "leak_so_far")
    state = state.withColumn(got, F.lit(None).cast(f"struct<{kind}>"))
    schema = state.schema
    for rows in _blocks(benchmark, item, item_text, block_bytes) if benchmark.take(1) else [[]]:
        sent = spark.sparkContext.broadcast(rows)

        def run(batches, sent=sent):
            block = Block(sent.value)
            for batch in batches:
                for piece in pieces(batch, text):
                    words = words_of(piece.column(text), ALNUM)
                    found = block.hits(words)
                    counts = np.diff(words.first).tolist()
                    before = piece.column(got)
                    values = [None] * piece.num_rows if before.null_count == piece.num_rows else before.to_pylist()
                    for i, old in enumerate(values):
                        items, runs = found.get(i, ((), ()))
                        begin = int(words.first[i])
                        runs = [(a - begin, b - begin) for a, b in runs]
                        if old:
                            items, runs = {*items, *old["items"]}, runs + [(r["a"], r["b"]) for r in old["runs"]]
                        values[i] = {
                            "n_words": counts[i], "runs": [{"a": a, "b": b} for a, b in _union(runs)],
                            "items": sorted(items),
                        }
                    index = piece.schema.get_field_index(got)
                    column = pa.array(values, piece.schema.field(index).type)
                    yield piece.set_column(index, piece.schema.field(index), column)

        state = state.mapInArrow(run, schema)
    return state.withColumnRenamed(got, out)


def digest(found: DataFrame, leak: str = "leak") -> list:
    """Columns of the report: n_words, n_hit, n_items, items_sha256 and contaminated."""
    hit = F.aggregate(F.col(leak)["runs"], F.lit(0).cast("long"), lambda a, r: a + (r["b"] - r["a"]).cast("long"))
    return [
        F.col(leak)["n_words"].alias("n_words"), hit.alias("n_hit"), F.size(F.col(leak)["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.col(leak)["items"], ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    ]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows in which no item occurs, with the columns they came with."""
    (leak,) = fresh(docs, "leak")
    clean = find(docs, benchmark, text, out=leak).filter(F.size(F.col(leak)["items"]) == 0)
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns])


