"""LM scoring: a small causal self-attention model in numpy over public subword ids.

A text is its words (A-Z as a-z) joined by single spaces, cut into subwords, and one end. Subwords fall into classes by the company they
keep; the probability of a subword is that of its class, given the window, times its share of the class behind the subword before
(smoothed by its share in all training tokens). The class comes from one attention layer and a hidden layer, added to a bigram. Windows
of 32 subwords overlap by half: each scores its last 16, so every subword is scored once with 16 to 31 before it (fewer only at the
start of a text).

Word and subword counts and the training windows grow with the corpus; every window is learnt from. Equal windows are merged and weigh as often
as they occur; each task passes once over the windows dealt to it, and the weights of all tasks are averaged.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import LOWER, Words, pieces, stored, words_of
from quire.llm.labels import remainder

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How the public vocabulary cuts a text before its merges (plain pattern).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space but the plain space.
ODD = re.compile(r"[^\S ]")
STEP = 16
WINDOW = 2 * STEP
#: Windows of one step, and its rate at the start (a tenth at the end).
BATCH, RATE = 128, 0.01
#: Windows that one task learns from: few large parts average better than many small ones.
PER_TASK = 131_072
#: A window that occurs more often is dealt out in several shares, so no step is one window's and no task has all its copies.
SHARE = 32
DIM, HEAD, HIDDEN, CLASSES, BUCKETS = 16, 8, 32, 64, 256
#: Rows of the bigram: the most frequent subwords, then the classes of the others. PRIOR: weight of the overall shares in a row.
ROWS, PRIOR = BUCKETS - 1 + CLASSES, 4.0
#: Counts of at most so many frequent words are sent to every executor (16 bytes each); rarer words are looked up by a join.
FREQUENT = 1_000_000
_ENCODINGS: dict[int, object] = {}


class Subwords:
    """The public vocabulary; ``end`` is the id after its last."""

    def __init__(self, ranks: bytes):
        import base64

        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line)
        table = {base64.b64decode(a): int(b) for a, b in pairs}
        self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.end = max(table.values()) + 1
        self.length = np.zeros(self.end + 1, np.int64)
        self.begins = np.zeros(self.end + 1, bool)
        for token, i in table.items():
            self.length[i] = len(token)
            self.begins[i] = token.startswith(b" ")

    @classmethod
    def of(cls, ranks: bytes) -> Subwords:
        key = hash(ranks)
        if key not in _ENCODINGS:
            _ENCODINGS[key] = cls(ranks)
        return _ENCODINGS[key]

    def cut(self, text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the subwords of all words and where each word's begin (and the last end). ``text``: the words, each with a space before it;
        ``sizes``: their bytes, the space included."""
        if ODD.search(text):
            return self._cut_odd(text, sizes)
        ids = np.asarray(self.encoding.encode_to_numpy(text), np.int64)
        ends = np.cumsum(self.length[ids])
        return ids, np.concatenate([[0], np.searchsorted(ends, np.cumsum(sizes)) + 1]).astype(np.int64) if len(sizes) else np.zeros(1, np.int64)

    def _cut_odd(self, text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """White space that is no ASCII could join with the space between two words: such words are cut on their own."""
        data, ends = text.encode(), np.cumsum(sizes)
        words = [data[e - n : e].decode() for e, n in zip(ends.tolist(), sizes.tolist())]
        odd = np.array([ODD.search(w) is not None for w in words])
        plain = np.flatnonzero(~odd)
        ids, begin = self.cut("".join(words[i] for i in plain), sizes[plain])
        parts: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        for k, i in enumerate(plain.tolist()):
            parts[i] = ids[begin[k] : begin[k + 1]]
        for i in np.flatnonzero(odd).tolist():
            parts[i] = np.array(self.encoding.encode_ordinary(words[i]), np.int64)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)


@dataclass
class Stream:
    """The subwords of a batch of texts, every text padded to whole steps: ``inputs`` and ``targets`` (-1: padding), the text of each
    step and whether it begins one."""

    inputs: np.ndarray
    targets: np.ndarray
    owner: np.ndarray
    begins: np.ndarray


def distinct(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.unique(words.hash, return_index=True, return_inverse=True)


def spelled(words: Words, which: np.ndarray) -> tuple[str, np.ndarray]:
    """The words at ``which`` in lower case (A-Z), each with a space before it, and their bytes, the space included."""
    sizes = words.end[which] - words.start[which] + 1
    ends = np.cumsum(sizes)
    out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
    inside = np.ones(len(out), bool)
    inside[ends - sizes] = False
    source = np.repeat(words.start[which] - (ends - sizes) - 1, sizes) + np.arange(len(out))
    out[inside] = LOWER[words.data[source[inside]]]
    return out.tobytes().decode("utf-8", "replace"), sizes


def stream_of(words: Words, inverse: np.ndarray, ids: np.ndarray, begin: np.ndarray, end: int) -> Stream:
    n_docs = len(words.first) - 1
    sizes = np.diff(begin)[inverse]
    total = np.concatenate([[0], np.cumsum(sizes)])
    per_doc = total[words.first[1:]] - total[words.first[:-1]] + 1
    padded = -(-per_doc // STEP) * STEP
    starts = np.concatenate([[0], np.cumsum(padded)])
    # a word's subwords go behind those before it in its text
    place = np.repeat(begin[:-1][inverse] - total[:-1], sizes) + np.arange(total[-1])
    shift = np.repeat(starts[:-1] - total[words.first[:-1]], per_doc - 1)
    targets = np.full(starts[-1], -1, np.int32)
    targets[np.arange(total[-1]) + shift] = ids[place]
    targets[starts[:-1] + per_doc - 1] = end
    inputs = np.empty_like(targets)
    inputs[1:] = targets[:-1]
    inputs[starts[:-1]] = end
    inputs[inputs < 0] = end
    steps = padded // STEP
    begins = np.zeros(starts[-1] // STEP, bool)
    begins[starts[:-1] // STEP] = True
    return Stream(inputs, targets, np.repeat(np.arange(n_docs), steps), begins)


# ------------------------------------------------------------------------------------------------------- the model

SHAPES = {
    "q": (DIM, HEAD), "k": (DIM, HEAD), "v": (DIM, HEAD), "far": (WINDOW,), "x": (DIM, HIDDEN), "o": (HEAD, HIDDEN), "b": (HIDDEN,),
    "w": (HIDDEN, CLASSES), "pair": (ROWS, CLASSES),
}
_FAR = (np.arange(STEP)[:, None] + STEP) - np.arange(WINDOW)[None, :]
_AHEAD = _FAR < 0
_BEFORE = np.broadcast_to(np.arange(WINDOW)[None, :] < STEP, _FAR.shape)


def start_weights(pair: np.ndarray) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(7)
    out = {k: (rng.standard_normal(s) * (0.3 / math.sqrt(s[0]))).astype(np.float32) for k, s in SHAPES.items()}
    out["far"][:] = 0
    out["b"][:] = 0
    out["w"][:] = 0
    out["pair"] = pair.astype(np.float32)
    return out


def forward(p: dict, emb: np.ndarray, row: np.ndarray, inputs: np.ndarray, begins: np.ndarray) -> dict:
    """``inputs``: windows of 32 ids; the last 16 positions are scored. Positions before the text's begin are masked."""
    n = len(inputs)
    x = emb[inputs]
    own = np.ascontiguousarray(x[:, STEP:])
    q, k, v = own @ p["q"], x @ p["k"], x @ p["v"]
    a = q @ k.transpose(0, 2, 1)
    a += p["far"][np.maximum(_FAR, 0)]
    np.clip(a, -30, 30, out=a)
    np.exp(a, out=a)
    a *= ~_AHEAD
    a[begins] *= ~_BEFORE
    a /= a.sum(2, keepdims=True)
    o = a @ v
    flat, att = own.reshape(-1, DIM), o.reshape(-1, HEAD)
    r = np.maximum(flat @ p["x"] + att @ p["o"] + p["b"], 0)
    logits = r @ p["w"]
    logits += p["pair"][row[inputs[:, STEP:].ravel()]]
    np.clip(logits, -30, 30, out=logits)
    return {"n": n, "x": x, "own": own, "q": q, "k": k, "v": v, "a": a, "att": att, "flat": flat, "r": r, "logits": logits}


def gradients(
    p: dict, emb: np.ndarray, cls: np.ndarray, row: np.ndarray, inputs: np.ndarray, targets: np.ndarray, begins: np.ndarray,
    weight: np.ndarray | None = None,
) -> tuple[dict, float]:
    """Gradients of the mean loss over the classes of the targets (-1: none), and the loss. ``weight``: of each window, 1 if not given."""
    f = forward(p, emb, row, inputs, begins)
    t = targets.ravel()
    real = t >= 0
    e = np.exp(f["logits"])
    s = e / e.sum(1, keepdims=True)
    rows = np.flatnonzero(real)
    aim = cls[t[rows]]
    n = max(len(rows), 1)
    each = ((real if weight is None else np.repeat(weight, STEP) * real) / n).astype(s.dtype)
    loss = -(np.log(s[rows, aim] + 1e-30) * each[rows]).sum()
    s[rows, aim] -= 1
    s *= each[:, None]
    g = {"w": f["r"].T @ s, "pair": np.zeros(SHAPES["pair"], np.float32)}
    behind = row[inputs[:, STEP:].ravel()]
    order = np.argsort(behind, kind="stable")
    behind = behind[order]
    begin = np.flatnonzero(np.concatenate([[True], behind[1:] != behind[:-1]]))
    g["pair"][behind[begin]] = np.add.reduceat(s[order], begin)
    dr = (s @ p["w"].T) * (f["r"] > 0)
    g["x"], g["o"], g["b"] = f["flat"].T @ dr, f["att"].T @ dr, dr.sum(0)
    do = (dr @ p["o"].T).reshape(f["n"], STEP, HEAD)
    da = do @ f["v"].transpose(0, 2, 1)
    ds = f["a"] * (da - (da * f["a"]).sum(2, keepdims=True))
    g["far"] = np.bincount(np.maximum(_FAR, 0).ravel(), ds.sum(0).ravel(), WINDOW).astype(np.float32)
    dq, dk, dv = ds @ f["k"], ds.transpose(0, 2, 1) @ f["q"], f["a"].transpose(0, 2, 1) @ do
    g["q"] = f["own"].reshape(-1, DIM).T @ dq.reshape(-1, HEAD)
    x = f["x"].reshape(-1, DIM)
    g["k"], g["v"] = x.T @ dk.reshape(-1, HEAD), x.T @ dv.reshape(-1, HEAD)
    return g, float(loss)


def descend(p: dict, emb: np.ndarray, cls: np.ndarray, row: np.ndarray, windows: np.ndarray, counts: np.ndarray, rate: float = RATE) -> dict:
    """One pass of Adam over windows (rows of 32 inputs, 16 targets, one flag), each weighed by its count."""
    p = {k: v.copy() for k, v in p.items()}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    weight = counts / counts.mean()
    for i, a in enumerate(range(0, len(windows), BATCH), 1):
        w = windows[a : a + BATCH]
        g, _ = gradients(p, emb, cls, row, w[:, :WINDOW], w[:, WINDOW : WINDOW + STEP], w[:, -1] > 0, weight[a : a + BATCH])
        now = rate * (1 - 0.9 * a / len(windows))
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            s[k] = 0.99 * s[k] + 0.01 * g[k] * g[k]
            p[k] -= (now * (m[k] / (1 - 0.9**i)) / (np.sqrt(s[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
    return p


def pack(p: dict) -> bytes:
    return np.concatenate([p[k].ravel() for k in SHAPES]).astype(np.float32).tobytes()


def unpack(data: bytes) -> dict:
    flat, out, at = np.frombuffer(data, np.float32), {}, 0
    for k, shape in SHAPES.items():
        n = math.prod(shape)
        out[k], at = flat[at : at + n].reshape(shape).copy(), at + n
    return out


class Behind:
    """log of a subword's share of its class behind a row of the bigram: counted shares, smoothed by those in all training tokens."""

    def __init__(self, count: np.ndarray, cls: np.ndarray, pairs: np.ndarray):
        count = count + 0.5  # every subword counts half a time more
        self.share = PRIOR * count / np.bincount(cls, count, CLASSES)[cls]
        used = np.flatnonzero(pairs.sum(1))
        self.at = np.zeros(len(count), np.int64)
        self.at[used] = np.arange(1, len(used) + 1)
        self.pairs = np.concatenate([np.zeros((1, ROWS)), pairs[used]]).astype(np.float32)
        self.total = np.zeros((CLASSES, ROWS))
        np.add.at(self.total, cls, pairs)
        self.total += PRIOR
        self.cls = cls

    def log(self, t: np.ndarray, row: np.ndarray) -> np.ndarray:
        return np.log((self.pairs[self.at[t], row] + self.share[t]) / self.total[self.cls[t], row])


@dataclass
class Model:
    weights: dict
    emb: np.ndarray
    cls: np.ndarray
    row: np.ndarray
    behind: Behind

    def log10(self, stream: Stream, n_docs: int, rows: int = 1_024) -> np.ndarray:
        """log10 probability of each text of a stream: ``forward`` for scoring, with keys and values computed once per position."""
        p, out = self.weights, np.zeros(n_docs)
        inputs, targets = stream.inputs.reshape(-1, STEP), stream.targets.reshape(-1, STEP)
        far = np.where(_AHEAD, np.float32(-1e9), p["far"][np.maximum(_FAR, 0)])
        first = np.where(_BEFORE, np.float32(-1e9), far)
        qkv = np.concatenate([p["q"], p["k"], p["v"]], 1)
        last, ones = np.zeros((1, STEP, 2 * HEAD), np.float32), np.ones(max(WINDOW, CLASSES), np.float32)
        for a in range(0, len(inputs), rows):
            own, begins = inputs[a : a + rows], stream.begins[a : a + rows]
            n = len(own)
            x = np.take(self.emb, own.ravel(), axis=0)
            here = (x @ qkv).reshape(n, STEP, 3 * HEAD)
            kv = here[:, :, HEAD:]
            window = np.empty((n, WINDOW, 2 * HEAD), np.float32)
            window[:, STEP:] = kv
            window[1:, :STEP] = kv[:-1]
            window[:1, :STEP] = last
            last = kv[-1:].copy()
            scores = np.matmul(here[:, :, :HEAD], window[:, :, :HEAD].transpose(0, 2, 1))
            scores += far
            scores[begins] += first - far
            np.minimum(scores, 30, out=scores)
            np.exp(scores, out=scores)
            o = np.matmul(scores, window[:, :, HEAD:])
            o /= scores @ ones[:WINDOW, None]
            r = x @ p["x"]
            r += o.reshape(-1, HEAD) @ p["o"]
            r += p["b"]
            np.maximum(r, 0, out=r)
            logits = r @ p["w"]
            row = self.row[own.ravel()]
            logits += np.take(p["pair"], row, axis=0)
            np.clip(logits, -30, 30, out=logits)
            t = targets[a : a + rows].ravel()
            real = np.flatnonzero(t >= 0)
            t, row = t[real], row[real]
            hit = logits[real, self.cls[t]]
            np.exp(logits, out=logits)
            value = hit - np.log((logits @ ones[:CLASSES])[real]) + self.behind.log(t, row)
            out += np.bincount(np.repeat(stream.owner[a : a + rows], STEP)[real], value, n_docs)
        return out / math.log(10)


def classes(count: np.ndarray, begins: np.ndarray, prev: np.ndarray, nxt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and classes of subwords from counts of their neighbours (subword x bucket, before and after).

    Square roots of the neighbours' shares are reduced to their main directions; weighted k-means makes the classes. The end has
    class 0; subwords hardly met share the last two, one for those that begin a word.
    """
    end = len(count) - 1
    seen = np.flatnonzero(prev.sum(1) + nxt.sum(1) >= 8)
    seen = seen[seen != end]
    cls = np.where(begins, CLASSES - 2, CLASSES - 1).astype(np.int64)
    cls[end] = 0
    emb = np.zeros((len(count), DIM), np.float32)
    emb[:, -1] = 1
    if not len(seen):
        return emb, cls
    both = np.concatenate([seen, [end]])
    share = lambda m: np.sqrt(m / np.maximum(m.sum(1, keepdims=True), 1))
    x = np.concatenate([share(prev[both]), share(nxt[both])], 1)
    weight = np.maximum(prev[both].sum(1), 1.0) ** 0.75
    x = x - (x * weight[:, None]).sum(0) / weight.sum()
    values, vectors = np.linalg.eigh((x * weight[:, None]).T @ x / weight.sum())
    top = vectors[:, ::-1][:, : DIM - 1]
    top *= np.sign(top[np.abs(top).argmax(0), np.arange(top.shape[1])])
    low = x @ top
    spread = np.sqrt((low * low * weight[:, None]).sum(0) / weight.sum()) + 1e-6
    emb[both, : low.shape[1]] = np.clip(low / np.maximum(spread, 0.02), -4, 4)
    # whether a word begins matters more than any neighbour
    point = np.concatenate([low[:-1], 0.5 * begins[seen, None]], 1)
    w = weight[:-1]
    k = min(CLASSES - 3, len(seen))
    rng = np.random.default_rng(3)
    centres = [point[int(w.argmax())]]
    near = ((point - centres[0]) ** 2).sum(1)
    for _ in range(k - 1):
        odds = near * w
        centres.append(point[rng.choice(len(point), p=odds / odds.sum()) if odds.sum() > 0 else 0])
        near = np.minimum(near, ((point - centres[-1]) ** 2).sum(1))
    centre = np.array(centres)
    for _ in range(15):
        far = (point**2).sum(1)[:, None] - 2 * point @ centre.T + (centre**2).sum(1)
        group = far.argmin(1)
        total = np.bincount(group, w, k)
        for j in range(point.shape[1]):
            centre[:, j] = np.where(total > 0, np.bincount(group, w * point[:, j], k) / np.maximum(total, 1e-9), centre[:, j])
    cls[seen] = group + 1
    return emb, cls


# ---------------------------------------------------------------------------------------------- the Spark side


class Tally:
    """Counts by key, summed in a task up to a bounded number of keys."""

    def __init__(self, most: int = 1_000_000):
        self.most, self.keys, self.counts, self.held = most, [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """What has to be passed on, if there are too many keys."""
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held <= 2 * self.most:
            return None
        keys, counts = self.merged()
        if len(keys) > self.most:
            self.keys, self.counts, self.held = [], [], 0
            return keys, counts
        self.keys, self.counts, self.held = [keys], [counts], len(keys)
        return None

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, inverse = np.unique(np.concatenate(self.keys), return_inverse=True)
        return keys, np.bincount(inverse, np.concatenate(self.counts), len(keys)).astype(np.int64)


def gather(docs: DataFrame, ranks: bytes) -> DataFrame:
    """(kind, key, value) of training texts: word counts (kind 0, by hash), subword counts (1), the number of windows (2) and
    of texts (3), and counts of neighbouring subwords (4)."""

    def rows(kind, key, value):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(key), kind, np.int8)), pa.array(key.astype(np.int64)), pa.array(value.astype(np.int64))], ["kind", "key", "value"]
        )

    def run(batches):
        sub = Subwords.of(ranks)
        tallies = {0: Tally(), 4: Tally()}
        tokens, n_docs, n_windows = np.zeros(sub.end + 1, np.int64), 0, 0
        for batch in batches:
            for piece in pieces(batch, "text", 2 << 20):
                words = words_of(piece.column("text"))
                keys, where, inverse = distinct(words)
                ids, begin = sub.cut(*spelled(words, where))
                count = np.bincount(inverse, minlength=len(keys))
                tokens += np.bincount(ids, np.repeat(count, np.diff(begin)), len(tokens)).astype(np.int64)
                n_docs += piece.num_rows
                stream = stream_of(words, inverse, ids, begin, sub.end)
                real = stream.targets >= 0
                pairs = stream.inputs[real].astype(np.int64) << 20 | stream.targets[real]
                for kind, found in ((0, (keys.view(np.int64), count)), (4, np.unique(pairs, return_counts=True))):
                    full = tallies[kind].add(*found)
                    if full:
                        yield rows(kind, *full)
                n_windows += len(stream.owner)
        for kind, tally in tallies.items():
            yield rows(kind, *tally.merged())
        used = np.flatnonzero(tokens)
        yield rows(1, used, tokens[used])
        yield rows(2, np.zeros(1), np.array([n_windows]))
        yield rows(3, np.zeros(1), np.array([n_docs]))

    return docs.select("text").mapInArrow(run, "kind tinyint, key long, value long")


def _id(end: int) -> type:
    return np.uint16 if end < 1 << 16 else np.int32


def packed(stream: Stream, end: int) -> pa.Array:
    """Each step's window in short: its 32 inputs and its last target (the other targets are inputs). What lies before a text is the end, so
    equal windows of different texts are equal."""
    inputs, targets = stream.inputs.reshape(-1, STEP), stream.targets.reshape(-1, STEP)
    n = len(inputs)
    short = np.empty((n, WINDOW + 1), _id(end))
    short[1:, :STEP] = inputs[:-1]
    short[stream.begins, :STEP] = end
    short[:, STEP:WINDOW] = inputs
    short[:, WINDOW] = np.where(targets[:, -1] < 0, end, targets[:, -1])
    offsets = np.arange(n + 1, dtype=np.int32) * (short.itemsize * (WINDOW + 1))
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(short)])


def unpacked(payloads: list[bytes], end: int) -> np.ndarray:
    """Rows of 32 inputs, 16 targets (-1 behind the end) and one flag: whether the text begins here."""
    short = np.frombuffer(b"".join(payloads), _id(end)).reshape(-1, WINDOW + 1).astype(np.int32)
    targets = short[:, STEP + 1 :].copy()
    ends = np.cumsum(targets == end, 1)
    targets[(ends > 1) | ((ends == 1) & (targets != end))] = -1
    return np.concatenate([short[:, :WINDOW], targets, short[:, STEP : STEP + 1] == end], 1)


def dealt(docs: DataFrame, ranks: bytes, parts: int) -> DataFrame:
    """(payload, n): every training window once per share of at most SHARE occurrences, dealt out and ordered by a hash of window and share, so
    that every run learns from the same windows in the same order and shares of one window meet by chance only. The texts are cut a second
    time, which is less work than keeping the windows."""

    def run(batches):
        sub = Subwords.of(ranks)
        for batch in batches:
            for piece in pieces(batch, "text", 2 << 20):
                words = words_of(piece.column("text"))
                _, where, inverse = distinct(words)
                ids, begin = sub.cut(*spelled(words, where))
                yield pa.RecordBatch.from_arrays([packed(stream_of(words, inverse, ids, begin, sub.end), sub.end)], ["payload"])

    merged = docs.select("text").mapInArrow(run, "payload binary").groupBy("payload").agg(F.count("*").alias("n"))
    shares = F.ceil(F.col("n") / SHARE)
    rows = merged.select("payload", "n", shares.alias("k"), F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("i"))
    each = F.floor(F.col("n") / F.col("k")) + F.when(F.col("i") < F.col("n") % F.col("k"), 1).otherwise(0)
    rows = rows.select("payload", each.cast("int").alias("n"), F.xxhash64("payload", "i").alias("h"))
    return rows.repartition(parts, "h").sortWithinPartitions("h").select("payload", "n")


def neighbours(pairs: DataFrame, rows: np.ndarray, n_rows: int, sides: int = 2) -> list[np.ndarray]:
    """Counts (subword x row of the one before, then of the one after) from ``pairs`` (before << 20 | after, n) of all training tokens. At
    most vocabulary x rows numbers reach the driver, whatever the input."""
    size = len(rows)

    def run(batches):
        for batch in batches:
            key, n = batch.column("key").to_numpy(), batch.column("n")
            before, after = key >> 20, key & ((1 << 20) - 1)
            for side, at in enumerate((after * n_rows + rows[before], before * n_rows + rows[after])[:sides]):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), side)), pa.array(at), n], ["side", "at", "n"])

    got = pairs.mapInArrow(run, "side long, at long, n long").groupBy("side", "at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((sides, size * n_rows))
    out[got.column("side").to_numpy(), got.column("at").to_numpy()] = got.column("n").to_numpy()
    return [side.reshape(size, n_rows) for side in out]


def bigram(pairs: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """log probability of the next class behind each row."""
    total = np.zeros((CLASSES, ROWS))
    np.add.at(total, cls, pairs)
    share = (total.sum(1) + 0.5) / (total.sum() + 0.5 * CLASSES)
    return np.log((total.T + 4 * share) / (total.sum(0)[:, None] + 4))


def trained(windows: DataFrame, weights: dict, emb: np.ndarray, cls: np.ndarray, row: np.ndarray, end: int) -> dict:
    """One pass over all windows; the weights of all tasks are averaged in two steps, 64 rows reach the driver."""
    sent = windows.sparkSession.sparkContext.broadcast((weights, emb, cls, row))

    def run(batches):
        start, emb, cls, row = sent.value
        parts = [(unpacked(b.column("payload").to_pylist(), end), b.column("n").to_numpy()) for b in batches if b.num_rows]
        if parts:
            counts = np.concatenate([n for _, n in parts]).astype(float)
            p = descend(start, emb, cls, row, np.concatenate([w for w, _ in parts]), counts)
            task = TaskContext.get().partitionId() % 64
            yield pa.RecordBatch.from_arrays([pa.array([task]), pa.array([counts.sum()]), pa.array([pack(p)], pa.binary())], ["task", "n", "p"])

    def average(table: pa.Table) -> pa.Table:
        n = table.column("n").to_numpy()
        mean = sum(np.frombuffer(b, np.float32) * (m / n.sum()) for b, m in zip(table.column("p").to_pylist(), n))
        return pa.table({"n": [float(n.sum())], "p": [mean.astype(np.float32).tobytes()]})

    got = windows.mapInArrow(run, "task long, n double, p binary").groupBy("task").applyInArrow(average, "n double, p binary").collect()
    total = sum(r["n"] for r in got)
    return unpack(sum(np.frombuffer(r["p"], np.float32) * (r["n"] / total) for r in got).astype(np.float32).tobytes()) if total else weights


def score(
    docs: DataFrame, key: str = "doc_id", text: str = "text", fold: int = 1, folds: int = 5, tokenizer: str = TOKENIZER,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Texts whose fold is not ``fold`` are learnt from. Null and empty texts are one end token. Rows are scored one by one, so copies agree and repeated ids
    are kept; an empty table gives an empty result; other columns are not read. ``tokenizer``: the vocabulary file, read on the driver.
    Counts of frequent words are sent to the executors (FREQUENT at most); the others are summed by a join on the word's hash.
    """
    with open(tokenizer, "rb") as file:
        ranks = file.read()
    sub = Subwords.of(ranks)
    rows = docs.select(F.col(key).alias("doc_id"), (remainder(F.col(key), folds) == fold).alias("held_out"), F.col(text).alias("text"))
    raw = stored(gather(rows.filter(~F.col("held_out")), ranks))
    words = stored(raw.filter("kind = 0").groupBy(F.col("key").alias("word")).agg(F.sum("value").alias("c")))
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_windows, n_docs = (raw.filter(F.col("kind") == k).agg(F.coalesce(F.sum("value"), F.lit(0)).alias("n")).first()["n"] for k in (2, 3))
    tokens = raw.filter("kind = 1").groupBy("key").agg(F.sum("value").alias("n")).toArrow()
    count = np.zeros(sub.end + 1)
    count[tokens.column("key").to_numpy()] = tokens.column("n").to_numpy()
    count[sub.end] = n_docs
    order = np.argsort(-count, kind="stable")
    bucket = np.full(len(count), BUCKETS - 1, np.int64)
    bucket[order[: BUCKETS - 1]] = np.arange(BUCKETS - 1)
    pairs = stored(raw.filter("kind = 4").groupBy("key").agg(F.sum("value").alias("n")))
    emb, cls = classes(count, sub.begins, *neighbours(pairs, bucket, BUCKETS))
    row = np.where(bucket < BUCKETS - 1, bucket, BUCKETS - 1 + cls)
    (pairs,) = neighbours(pairs, row, ROWS, 1)
    windows = dealt(rows.filter(~F.col("held_out")), ranks, max(1, n_windows // PER_TASK))
    weights = trained(windows, start_weights(bigram(pairs, cls)), emb, cls, row, sub.end)
    model = Model(weights, emb, cls, row, Behind(count, cls, pairs))

    train_tokens, kinds = sums["n"] + n_docs, sums["v"] + (1 if n_docs else 0)
    below = math.log10(train_tokens + 0.5 * (kinds + 1))
    least = _least_count(words)
    common = words.filter(F.col("c") >= least).toArrow()
    at = np.argsort(common.column("word").to_numpy())
    table = common.column("word").to_numpy()[at], common.column("c").to_numpy()[at]
    sent = docs.sparkSession.sparkContext.broadcast((model, table))
    kind = rows.schema["doc_id"].dataType.simpleString()
    id_type = rows.limit(0).toArrow().schema.field("doc_id").type

    def run(batches):
        model, (known, counts) = sent.value
        sub = Subwords.of(ranks)
        task, done = TaskContext.get().partitionId() << 40, 0
        end = math.log10(n_docs + 0.5) - below
        for batch in batches:
            for piece in pieces(batch, "text", 2 << 20):
                words = words_of(piece.column("text"))
                keys, where, inverse = distinct(words)
                ids, begin = sub.cut(*spelled(words, where))
                n = piece.num_rows
                value = model.log10(stream_of(words, inverse, ids, begin, sub.end), n)
                c = np.zeros(len(keys))
                if len(known):
                    i = np.minimum(np.searchsorted(known, keys.view(np.int64)), len(known) - 1)
                    c = np.where(known[i] == keys.view(np.int64), counts[i], 0)
                owner = words.doc
                c_of = c[inverse]
                found = c_of > 0
                base = np.bincount(owner[found], np.log10(c_of[found] + 0.5) - below, n) + end
                n_known = np.bincount(owner[found], minlength=n) + (n_docs > 0)
                rid = task + done + np.arange(n)
                done += n
                none = lambda size, type_: pa.nulls(size, type_)
                yield pa.RecordBatch.from_arrays([
                    pa.array(rid), piece.column("doc_id"), piece.column("held_out"), pa.array(np.diff(words.first) + 1), pa.array(n_known.astype(np.int64)),
                    pa.array(base), pa.array(value), none(n, pa.int64()), none(n, pa.int64()),
                ], names)
                rare = np.flatnonzero(~found)
                if len(rare):
                    pair = owner[rare].astype(np.int64) * len(keys) + inverse[rare]
                    pair, times = np.unique(pair, return_counts=True)
                    m = len(pair)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(rid[pair // len(keys)]), none(m, id_type), none(m, pa.bool_()), none(m, pa.int64()), none(m, pa.int64()),
                        none(m, pa.float64()), none(m, pa.float64()), pa.array(keys.view(np.int64)[pair % len(keys)]), pa.array(times.astype(np.int64)),
                    ], names)

    names = ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "word", "times"]
    schema = f"rid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, word long, times long"
    out = stored(rows.mapInArrow(run, schema))
    rare = out.filter("word IS NOT NULL").select("rid", "word", "times").join(words.filter(F.col("c") < least), "word", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    rare = rare.groupBy("rid").agg(
        F.sum((F.log10(c + 0.5) - F.lit(below)) * F.col("times")).alias("rare_base"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known")
    )
    return out.filter("word IS NULL").drop("word", "times").join(rare, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), "score",
    )


def _least_count(words: DataFrame) -> int:
    """The smallest count such that at most FREQUENT words are that frequent. The table of counts has few rows: as many as there are different
    counts up to 10,000, larger ones together."""
    table = words.groupBy(F.least("c", F.lit(10_000)).alias("c")).count().collect()
    left = FREQUENT
    for c, n in sorted(((r["c"], r["count"]) for r in table), reverse=True):
        if n > left:
            return c + 1
        left -= n
    return 1
