"""Quality classifier: a linear-chain conditional random field labels the lines of a text good or bad.

Each line is described by counts of its own and of its neighbours. Forward-backward sums give the probability that a line is
good; their mean, weighted by the length of the lines, is the quality of the text. Lines are trained with the label of
their document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import NOT_SPACE, grams, in_one_text, map_pieces, mix, stored, words_of
from quire.llm.labels import labelled, remainder, sample

#: At most so many labelled documents are learnt from, a longer one in blocks of BLOCK lines; MOST bounds the lines of all (60 bytes each on the
#: driver): beyond it blocks are drawn by a hash.
SAMPLE, BLOCK, MOST = 8_000, 2_000, 2_000_000
OWN = 15


class Lines:
    """The lines with a word of a batch of texts: ``first`` per text (total at the end), their features and lengths."""

    def __init__(self, column: pa.Array):
        words = words_of(column, NOT_SPACE)
        data, n_docs = words.data, len(words.first) - 1
        total = lambda flags: np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        breaks = total(data == 0x0A)
        doc = words.doc
        # a word begins a line when it begins a text or a line break stands between it and the word before
        starts = np.ones(len(words.start), bool)
        starts[1:] = (doc[1:] != doc[:-1]) | (breaks[words.start[1:]] > breaks[words.end[:-1]])
        a = np.flatnonzero(starts)
        b = np.append(a[1:], len(words.start)) if len(a) else a
        owner = doc[a]
        self.first = np.searchsorted(owner, np.arange(n_docs + 1))
        n = (b - a).astype(float)
        low, high = (words.start[a], words.end[b - 1]) if len(a) else (a, a)
        size = np.maximum(high - low, 1).astype(float)
        count = lambda flags: (lambda t: (t[high] - t[low]).astype(float))(total(flags))
        over = lambda flags: (lambda t: (t[b] - t[a]).astype(float))(total(flags))
        letter = np.zeros(256, bool)
        letter[65:91] = letter[97:123] = True
        symbol = np.zeros(256, bool)
        symbol[list(b"#*$%&|<>")] = True
        same = np.zeros(len(words.start), bool)
        same[1:] = (words.hash[1:] == words.hash[:-1]) & (doc[1:] == doc[:-1])
        letters = np.maximum(count(letter[data]), 1)
        # lines and three-word runs that the text holds more than once
        body = np.add.reduceat(mix(words.hash) * _odd(len(a), a, len(words.hash)), a) if len(a) else np.zeros(0, np.uint64)
        again = _repeated(mix(body ^ mix(owner.astype(np.uint64))))
        runs = grams(words.hash, 3)
        twice = np.zeros(len(words.start), bool)
        if len(runs):
            inside = in_one_text(words.first, 3)
            keys = mix(runs ^ mix(doc[: len(runs)].astype(np.uint64)))
            places = np.flatnonzero(inside)
            twice[places[_repeated(keys[places])]] = True
        self.length = (over((words.end - words.start)) if len(a) else np.zeros(0)) + 0.0
        last = data[high - 1] if len(a) else np.zeros(0, np.uint8)
        begins = data[low] if len(a) else np.zeros(0, np.uint8)
        self.own = np.column_stack([
            np.minimum(count(symbol[data]) / n, 2), np.minimum(count(data == 0x21) / n, 2), count((data >= 65) & (data <= 90)) / letters,
            count((data >= 48) & (data <= 57)) / size, np.minimum(count(data == 0x7C) / n, 1), over(same) / n, again.astype(float), over(twice) / n,
            np.minimum(n, 60) / 60, np.log1p(n) / 5, (n < 3).astype(float), np.minimum(self.length / n, 30) / 10,
            np.isin(last, np.frombuffer(b".!?:", np.uint8)).astype(float), ((begins >= 65) & (begins <= 90)).astype(float),
            np.minimum(count((data == 0x2C) | (data == 0x2E)) / n, 1),
        ]) if len(a) else np.zeros((0, OWN))

    def described(self) -> np.ndarray:
        """Each line's features, those of the line before and after (zeros at the ends of a text), the ends themselves and a constant."""
        x = self.own
        n = len(x)
        begins, ends = np.zeros(n, bool), np.zeros(n, bool)
        real = self.first[:-1][np.diff(self.first) > 0]
        begins[real] = True
        ends[np.append(real[1:], n)[: len(real)] - 1] = True
        before, after = np.zeros_like(x), np.zeros_like(x)
        before[1:], after[:-1] = x[:-1], x[1:]
        before[begins], after[ends] = 0, 0
        return np.column_stack([x, before, after, begins, ends, np.ones(n)])


def _odd(n: int, a: np.ndarray, words: int) -> np.ndarray:
    """A factor for each place in its line, so that the order of words counts."""
    at = np.arange(words) - np.repeat(a, np.diff(np.append(a, words)))
    return mix(at.astype(np.uint64)) | np.uint64(1)


def _repeated(keys: np.ndarray) -> np.ndarray:
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return counts[inverse] > 1


def forward_backward(node: np.ndarray, step: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability that each line is good, summed pair probabilities (2 x 2) and log of the sum over all labellings of each text.

    ``node``: score of good against bad per line; ``step``: score of (label, next label). All texts move on together, one line a
    round: those still running are the first of the texts sorted by length.
    """
    n_docs, lines = len(first) - 1, np.diff(first)
    order = np.argsort(-lines, kind="stable")
    longest = int(lines.max()) if n_docs else 0
    running = np.searchsorted(-lines[order], -np.arange(1, longest + 1), "right") if longest else np.zeros(0, int)
    begin = first[:-1][order]
    alpha, beta = np.zeros((len(node), 2)), np.zeros((len(node), 2))
    for t in range(longest):
        at = begin[: running[t]] + t
        if t:
            back = alpha[at - 1]
            for y in (0, 1):
                alpha[at, y] = np.logaddexp(back[:, 0] + step[0, y], back[:, 1] + step[1, y])
        alpha[at, 1] += node[at]
    for t in range(longest - 2, -1, -1):
        at = begin[: running[t + 1]] + t
        ahead = beta[at + 1].copy()
        ahead[:, 1] += node[at + 1]
        for y in (0, 1):
            beta[at, y] = np.logaddexp(ahead[:, 0] + step[y, 0], ahead[:, 1] + step[y, 1])
    both = alpha + beta
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -60, 60)))
    total = np.zeros(n_docs)
    some = lines > 0
    ends = first[1:][some] - 1
    total[some] = np.logaddexp(alpha[ends, 0], alpha[ends, 1])
    pairs = np.zeros((2, 2))
    follows = np.ones(len(node), bool)
    follows[first[:-1][some]] = False
    nxt = np.flatnonzero(follows)
    z = np.repeat(total, lines)[nxt]
    for u in (0, 1):
        for v in (0, 1):
            pairs[u, v] = np.exp(alpha[nxt - 1, u] + step[u, v] + (node[nxt] if v else 0) + beta[nxt, v] - z).sum()
    return good, pairs, total


def train(x: np.ndarray, first: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, ridge: float = 1e-4) -> dict:
    """Maximum likelihood by Adam's method. ``y``: label per line."""
    mean, scale = x.mean(0), x.std(0) + 1e-3
    mean[-1], scale[-1] = 0, 1
    z = (x - mean) / scale
    w, step = np.zeros(x.shape[1]), np.zeros((2, 2))
    follows = np.ones(len(y), bool)
    follows[first[:-1][np.diff(first) > 0]] = False
    nxt = np.flatnonzero(follows)
    observed = np.zeros((2, 2))
    np.add.at(observed, (y[nxt - 1], y[nxt]), 1)
    n = max(len(y), 1)
    m1, m2 = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for i in range(1, rounds + 1):
        good, pairs, _ = forward_backward(z @ w, step, first)
        g = np.concatenate([z.T @ (good - y) / n + ridge * w, (pairs - observed).ravel() / n + ridge * step.ravel()])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        move = rate * (m1 / (1 - 0.9**i)) / (np.sqrt(m2 / (1 - 0.999**i)) + 1e-8)
        w, step = w - move[:-4], step - move[-4:].reshape(2, 2)
    return {"w": w / scale, "shift": -(mean / scale) @ w, "step": step}


def text_scores(model: dict, column: pa.Array) -> np.ndarray:
    lines = Lines(column)
    out = np.full(len(column), model["prior"])
    if len(lines.own):
        good, _, _ = forward_backward(lines.described() @ model["w"] + model["shift"], model["step"], lines.first)
        some = np.diff(lines.first) > 0
        owner = np.repeat(np.arange(len(column)), np.diff(lines.first))
        weight = np.bincount(owner, lines.length, len(column))
        out[some] = np.bincount(owner, lines.length * good, len(column))[some] / weight[some]
    return out


def learn(rows: DataFrame, most: int = MOST) -> dict:
    """The model from (text, label): features of the sampled texts come to the driver, a few numbers a line, of about ``most`` lines at most."""

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines = Lines(batch.column("text"))
        labels = batch.column("label").to_numpy(zero_copy_only=False)
        x, y, heads = [], [], []
        for i, (a, b) in enumerate(zip(lines.first[:-1].tolist(), lines.first[1:].tolist())):
            cuts = range(a, max(b, a + 1), BLOCK)
            x += [lines.own[c : min(c + BLOCK, b)].astype(np.float32).tobytes() for c in cuts]
            y += [int(labels[i])] * len(cuts)
            heads += [c == a for c in cuts]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.int32()), pa.array(heads, pa.bool_())], ["x", "y", "head"])

    blocks = stored(map_pieces(rows, describe, "x binary, y int, head boolean"))
    total = blocks.agg(F.coalesce(F.sum(F.octet_length("x")), F.lit(0))).first()[0] // (4 * OWN)
    if total > most:
        blocks = blocks.filter(F.pmod(F.xxhash64("x", F.lit(7)), F.lit(total)) < most)
    # the order of the rows must not depend on that of the tasks
    got = blocks.toPandas().sort_values(["x", "y", "head"], ignore_index=True)
    labels = got["y"].to_numpy(int)
    prior = float(labels[got["head"].to_numpy(bool)].mean()) if got["head"].any() else 0.5
    blocks = [np.frombuffer(x, np.float32).reshape(-1, OWN) for x in got["x"]]
    lines = Lines.__new__(Lines)
    lines.first = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype(int)
    lines.own = np.concatenate(blocks).astype(float) if blocks else np.zeros((0, OWN))
    x = lines.described()
    if not len(x) or prior in (0.0, 1.0):
        share = min(max(prior, 1e-6), 1 - 1e-6)
        return {"w": np.zeros(3 * OWN + 3), "shift": float(np.log(share / (1 - share))), "step": np.zeros((2, 2)), "prior": prior}
    return train(x, lines.first, np.repeat(labels, np.diff(lines.first))) | {"prior": prior}


def score(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    fold: int = 2, folds: int = 4, bound: int = SAMPLE,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; ``score``: length-weighted probability that its lines are good.

    Learns from at most about ``bound`` labelled rows whose fold is not ``fold`` (and MOST of their lines). Lines without a word are no lines. Null and empty texts get the
    share of label 1 among the training rows. Rows are scored one by one, without a shuffle: copies agree, an empty table stays empty; other
    columns are not read.
    """
    model = learn(labelled(docs, sample(labels, label, fold, folds, bound, key), key, text))

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = text_scores(model, batch.column("text"))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.7).astype(np.int32))],
            ["doc_id", "held_out", "score", "predicted"],
        )

    asked = docs.select(F.col(key).alias("doc_id"), (remainder(F.col(key), folds) == fold).alias("held_out"), F.col(text).alias("text"))
    kind = asked.schema["doc_id"].dataType.simpleString()
    return map_pieces(asked, judge, f"doc_id {kind}, held_out boolean, score double, predicted int")
