"""Helpers shared by the operators: names that cannot clash, lookups of a checked size, words as numpy arrays."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
SPACES = "[\\x20\\x09-\\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def split_words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def stored(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read from there: it is computed once, its
    columns can be pruned, and it is still there when an executor is lost."""
    from quire.session import checkpoint_dir

    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """A hint to broadcast ``df`` where it has at most ``rows`` rows; beyond that the join shuffles. ``df`` must be stored."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


# ---------------------------------------------------------------------------------------------- words in numpy

_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes of the white-space rule, and of the rule that also cuts at ASCII punctuation (after lower-casing).
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)[LOWER]


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = _POWERS[base] = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text begins (and the last ends); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """The words of a batch of texts: where they begin and end, a 64-bit hash of each (A-Z as a-z), and the number of
    the first word of each text (with the total at the end)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    total: np.ndarray

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of parts of the batch; that of a whole word is its ``hash``."""
        return mix((self.total[end] - self.total[start]) * _powers(_P_INVERSE, len(self.total))[start])

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words_of(column: pa.Array, is_word: np.ndarray = NOT_SPACE) -> Words:
    data, offsets = raw_text(column)
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = is_word[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside[1:-1] & (edge[:-1] | ~inside[:-2]))
    end = np.flatnonzero(inside[1:-1] & (edge[1:] | ~inside[2:])) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_P, n), out=total[1:])
    hashes = mix((total[end] - total[start]) * _powers(_P_INVERSE, n + 1)[start])
    return Words(data, start, end, hashes, np.searchsorted(start, offsets), total)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` neighbours; there are ``k - 1`` fewer than words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(_P) + hashes[j : j + n]
    return mix(out)


def in_one_text(first: np.ndarray, k: int) -> np.ndarray:
    """For each run of ``k`` neighbours of the batch: does it lie in one text?"""
    n = int(first[-1]) - k + 1
    ok = np.ones(max(n, 0), bool)
    for b in first[1:-1]:
        ok[max(0, b - k + 1) : b] = False
    return ok


def pieces(batch: pa.RecordBatch, column: str = "text", size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text each: memory does not grow with the length of a batch."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(lengths) - lengths) // size
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield batch.slice(a, b - a)


def map_pieces(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, column: str = "text") -> DataFrame:
    """``fn`` on slices of the Arrow batches of ``df``."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, column):
                yield fn(piece)

    return df.mapInArrow(run, schema)
