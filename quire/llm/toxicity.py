"""Toxicity: a learnt lexicon, misspelled terms by Levenshtein automata, and context windows.

The lexicon is stored as a trie. A word's Levenshtein automaton (a bit per state, all states of as many edits in one number; two letters
exchanged are one edit) walks the trie and leaves a branch as soon as no term below it can be near enough. Every hit is weighed by its neighbourhood:
quotation marks and words of reporting lower it, a direct address and further hits raise it; quoted, reported and addressed hits are
summed apart as well, so that a logistic model, which turns the sums into a score, can weigh them anew.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import ALNUM, Words, checked_broadcast, grams, map_pieces, mix, stored, words_of
from quire.llm.labels import labelled, logistic, remainder, sample

#: Words of reporting, and of direct address (plain values).
REPORTING = "said says wrote writes quote quoted quotes called word words term sagte schrieb zitat wort dit écrit mot dijo palabra".split()
ADDRESS = "you your yours yourself du dich dir dein deine ihr euch tu te toi ton vous votre tú ti usted eres".split()
WINDOW = 5
#: At most so many labelled documents are learnt from.
SAMPLE = 60_000
#: A term is held by so many families of toxic texts at least. Its share of toxic families among those that hold it (both labels weighed
#: alike) is RATE at least, and the lower end of the share's 95 % interval (Wilson) is SURE at least.
LEAST, RATE, SURE, Z = 5, 0.9, 0.55, 1.96
FEATURES = 9
#: A task remembers the outcome of the walk for so many words.
MET = 200_000


#: Quotation marks and other punctuation beyond ASCII, which the word class would take for letters.
QUOTES = "[\u00ab\u00bb\u201c-\u201f\u2039\u203a\u300c-\u300f\uff02]"
SIGNS = "[\u00a0\u00a1\u00b7\u00bf\u2000-\u206f\u3000-\u303f\uff01-\uff0f\uff1a\uff1b\uff1f]"


def cleaned(texts: pa.Array) -> pa.Array:
    """Texts in which typographic quotation marks are straight ones and other signs beyond ASCII are blanks; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    for pattern, plain in ((QUOTES, '"'), (SIGNS, " ")):
        if pc.any(pc.match_substring_regex(texts, pattern)).as_py():
            texts = pc.replace_substring_regex(texts, pattern, plain)
    return texts


class Trie:
    """Terms by letter, with the automaton walk."""

    def __init__(self, terms: list[str]):
        self.root: dict = {}
        for term in terms:
            node = self.root
            for letter in term:
                node = node.setdefault(letter, {})
            node[""] = term

    def near(self, word: str, limit: int) -> str | None:
        """The term with the fewest edits to ``word``, ``limit`` at most; ties by code point."""
        places: dict[str, int] = {}
        for i, letter in enumerate(word):
            places[letter] = places.get(letter, 0) | 1 << i
        end = 1 << len(word)
        best: tuple[int, str] | None = None
        # bit i of states[k]: with k edits, the letters so far may stand for the first i of the word; turned[k]: those i behind which the letter
        # read last stands second, so that an exchange may follow
        start = [(1 << k + 1) - 1 for k in range(limit + 1)]
        stack = [(self.root, start, [0] * limit)]
        while stack:
            node, states, turned = stack.pop()
            for letter, below in node.items():
                if letter == "":
                    edits = next((k for k in range(limit + 1) if states[k] & end), None)
                    if edits is not None and (best is None or (edits, below) < best):
                        best = edits, below
                    continue
                here = places.get(letter, 0)
                after = [(states[0] & here) << 1]
                for k in range(1, limit + 1):
                    less = states[k - 1]
                    after.append((states[k] & here) << 1 | less | less << 1 | after[-1] << 1 | (turned[k - 1] & here) << 2)
                if after[-1] & 2 * end - 1:
                    stack.append((below, after, [s & here >> 1 for s in states[:limit]]))
        return best[1] if best else None


#: Terms of so many letters are found with one edit; shorter ones only as they are, since most of their neighbours are other words.
EDITED = 5


def edits(length: int) -> int:
    """Edits allowed for a written word of so many letters: a term may have lost one."""
    return 0 if length < EDITED - 1 else 1


def text_of(words: Words, i: int) -> str:
    return words.data[words.start[i] : words.end[i]].tobytes().decode("utf-8", "replace").translate(_ASCII_LOWER)


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def hash_of(terms: list[str]) -> np.ndarray:
    """The hashes that ``words_of`` gives the terms."""
    return words_of(pa.array(terms, pa.string()), ALNUM).hash if terms else np.zeros(0, np.uint64)


def hash_bytes(parts: list[bytes]) -> np.ndarray:
    """The hashes that ``span_hash`` gives these bytes."""
    ends = np.cumsum([len(p) for p in parts])
    column = pa.array([b"".join(parts).decode()], pa.string())
    return words_of(column, ALNUM).span_hash(np.concatenate([[0], ends[:-1]]), ends)


def _both(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    return mix(head * np.uint64(0x9E3779B97F4A7C15) + tail)


@dataclass
class Lexicon:
    """Terms with their weights; ``seen`` holds variants met in training, with weights of their own."""

    weights: dict[str, float]
    seen: dict[str, float] = field(default_factory=dict)
    unseen: float = 0.0

    def __post_init__(self) -> None:
        self.trie = Trie(sorted(t for t in self.weights if len(t) >= EDITED))
        known = {**self.weights, **self.seen}
        names = sorted(known)
        hashes = hash_of(names)
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], np.array([known[n] for n in names])[order]
        self.exact = np.array([n in self.weights for n in names], bool)[order]
        # cut in three, a term keeps two of its parts through one edit: by their lengths and its own, the hashes of the
        # bytes that a word must begin and end with
        wanted: dict[tuple[int, int, int], set[tuple[bytes, bytes]]] = {}
        for term in self.weights:
            if len(term) >= EDITED:
                x, y = len(term) // 3, len(term) - len(term) // 3
                parts = [(term[:y], ""), ("", term[x:]), (term[:x], term[y:])]
                # letters exchanged across a cut damage two parts
                parts += [(term[: k - 1] + term[k] + term[k - 1] + term[k + 1 :], "") for k in (x, y)]
                for head, tail in ((h.encode(), t.encode()) for h, t in parts):
                    wanted.setdefault((len(head), len(tail), len(term)), set()).add((head, tail))
        self.frames = {k: np.sort(_both(hash_bytes([h for h, _ in v]), hash_bytes([t for _, t in v]))) for k, v in wanted.items()}
        self.met: dict[int, str] = {}
        self.report, self.address = np.sort(hash_of(REPORTING)), np.sort(hash_of(ADDRESS))

    def variants(self, words: Words, which: np.ndarray) -> dict[int, str]:
        """By hash: words among ``which`` (places of distinct words) that are near a term but not a term."""
        if not self.frames:
            return {}
        start, end = words.start[which], words.end[which]
        size = end - start
        begun = np.concatenate([[0], np.cumsum(words.data & 0xC0 != 0x80)])
        letters = begun[end] - begun[start]
        possible = np.zeros(len(which), bool)
        by_length = {n: np.flatnonzero(np.abs(letters - n) <= 1) for n in {k[2] for k in self.frames}}
        for (head, tail, length), found in self.frames.items():
            # an edit changes the length by one letter
            fits = by_length[length]
            fits = fits[(size[fits] >= head + tail) & ~possible[fits]]
            keys = _both(words.span_hash(start[fits], start[fits] + head), words.span_hash(end[fits] - tail, end[fits]))
            at = np.minimum(np.searchsorted(found, keys), len(found) - 1)
            possible[fits[found[at] == keys]] = True
        out = {}
        if len(self.met) > MET:
            self.met.clear()
        for i in which[possible].tolist():
            key = int(words.hash[i])
            if key not in self.met:
                word = text_of(words, i)
                near = word not in self.weights and edits(len(word)) and self.trie.near(word, edits(len(word)))
                self.met[key] = word if near else ""
            if self.met[key]:
                out[key] = self.met[key]
        return out

    def look_up(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, weights and exactness of the words of a batch that are terms or near one."""
        distinct, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        weight, exact = np.zeros(len(distinct)), np.zeros(len(distinct), bool)
        at = np.minimum(np.searchsorted(self.hashes, distinct), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == distinct if len(self.hashes) else np.zeros(len(distinct), bool)
        weight[known], exact[known] = self.values[at[known]], self.exact[at[known]]
        if self.frames:
            for h in self.variants(words, first[~known]):
                weight[np.searchsorted(distinct, np.uint64(h))] = self.unseen
        places = np.flatnonzero(weight[inverse] != 0)
        return places, weight[inverse][places], exact[inverse][places]


def features(lexicon: Lexicon, words: Words) -> np.ndarray:
    """Per text: sum of weights of distinct terms, hits, hits per hundred words, distinct terms, weight after context, near misses, and the
    weights of quoted, reported and addressed terms."""
    n_docs = len(words.first) - 1
    out = np.zeros((n_docs, FEATURES))
    if not len(words.hash):
        return out
    places, weight, exact = lexicon.look_up(words)
    if not len(places):
        return out
    doc = np.searchsorted(words.first, places, "right") - 1
    quote = np.zeros(len(words.data) + 1, np.int64)
    np.cumsum(words.data == 0x22, out=quote[1:])
    begin = words.start[np.minimum(words.first[doc], len(words.start) - 1)]
    quoted = (quote[words.start[places]] - quote[begin]) % 2 == 1
    low = np.maximum(places - WINDOW, words.first[doc])
    high = np.minimum(places + WINDOW + 1, words.first[doc + 1])

    def near(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[high] - total[low]

    reported = near(np.isin(words.hash, lexicon.report)) > 0
    addressed = near(np.isin(words.hash, lexicon.address)) > 0
    hit = np.zeros(len(words.hash), bool)
    hit[places] = True
    others = np.minimum(near(hit) - 1, 3)
    # quotation halves a hit, a report near it takes a quarter; an address and other hits add
    context = weight * (1 - 0.5 * quoted - 0.25 * reported) * (1 + 0.25 * addressed + 0.1 * others)
    _, firsts = np.unique(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ mix(words.hash[places]), return_index=True)
    first = np.zeros(len(places), bool)
    first[firsts] = True
    add = lambda v: np.bincount(doc, v, n_docs)
    counts = np.maximum(np.diff(words.first), 1)
    hits, distinct = add(np.ones(len(doc))), add(first.astype(float))
    out[:, 0] = np.clip(add(weight * first), -10, 30)
    out[:, 1] = np.log1p(hits)
    out[:, 2] = np.log1p(100 * hits / counts)
    out[:, 3] = np.log1p(distinct)
    out[:, 4] = np.clip(add(context * first), -10, 30)
    out[:, 5] = np.log1p(add((~exact).astype(float)))
    for j, flag in enumerate((quoted, reported, addressed)):
        out[:, 6 + j] = np.clip(add(weight * first * flag), -10, 30)
    return out


def families(words: Words) -> np.ndarray:
    """Per text the smallest hash of its five-word runs: near copies mostly agree and count once when terms are chosen."""
    out = np.zeros(len(words.first) - 1, np.uint64)
    runs = grams(words.hash, 5)
    for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:])):
        part = runs[a : b - 4] if b - a >= 5 else words.hash[a:b]
        out[i] = part.min() if len(part) else 0
    return out


def sampled(rows: DataFrame) -> DataFrame:
    """The labelled rows (text, label) stored once: text without typographic signs, label, family, and whether the row speaks for its family."""
    prints = map_pieces(rows, lambda b: pa.RecordBatch.from_arrays(
        [clean := cleaned(b.column("text")), b.column("label"), pa.array(families(words_of(clean, ALNUM)).view(np.int64))], ["text", "label", "family"]
    ), "text string, label int, family long")
    held = stored(prints.withColumn("row", F.monotonically_increasing_id()))
    # a row number per family of a bounded sample
    first = held.groupBy("label", "family").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("speaks"))
    return held.join(checked_broadcast(stored(first), SAMPLE), "row", "left").select("text", "label", F.coalesce("speaks", F.lit(False)).alias("speaks"))


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Terms from ``sampled`` rows: words that families of toxic texts hold and clean ones hardly do, as many as are certain. A family counts by one
    of its texts. The rows are a bounded sample and a term takes LEAST of their families, which bounds the terms.

    First the words of toxic texts are counted, then those that LEAST families hold in clean texts. Words near a term are counted in a third pass: those that clean texts hold too are no misspellings.
    """
    rows = rows.filter("speaks")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.array_distinct(F.array_remove(F.split(lower, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), ""))
    size = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic or not clean:
        return Lexicon({})
    each = rows.filter("label = 1").select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("t"))
    wanted = stored(each.filter(F.col("t") >= LEAST))
    other = rows.filter("label = 0").select(F.explode(words).alias("word")).join(checked_broadcast(wanted.select("word")), "word")
    other = other.groupBy("word").agg(F.count("*").alias("c"))
    both = wanted.join(other, "word", "left").select("word", "t", F.coalesce("c", F.lit(0)).alias("c"))
    # the families that hold a word, as if there were as many clean ones as toxic ones
    n = F.col("t") + F.col("c") * F.lit(toxic / clean)
    rate = F.col("t") / n
    sure = (rate + Z * Z / (2 * n) - Z * F.sqrt(rate * (1 - rate) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)
    found = both.filter((rate >= RATE) & (sure >= SURE)).collect()

    def odds(t: int, c: int) -> float:
        return math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))

    lexicon = Lexicon({r["word"]: odds(r["t"], r["c"]) for r in sorted(found, key=lambda r: r["word"])})
    if not found:
        return lexicon

    def variants(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = words_of(batch.column("text"), ALNUM)
        _, first = np.unique(found.hash, return_index=True)
        near = lexicon.variants(found, first)
        keep = np.flatnonzero(np.isin(found.hash, np.array(list(near), np.uint64)))
        owner = np.searchsorted(found.first, keep, "right") - 1
        labels = batch.column("label").to_numpy(zero_copy_only=False)
        pairs = {(int(o), near[int(found.hash[k])]) for o, k in zip(owner, keep)}
        return pa.RecordBatch.from_arrays(
            [pa.array([w for _, w in pairs], pa.string()), pa.array([int(labels[o]) for o, _ in pairs], pa.int32())], ["word", "label"]
        )

    counts = map_pieces(rows, variants, "word string, label int").groupBy("word").agg(
        F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("t"), F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).alias("c")
    )
    seen = {r["word"]: odds(r["t"], r["c"]) for r in counts.collect()}
    # a variant not met before is worth a fraction of an average term
    return Lexicon(lexicon.weights, {w: v for w, v in seen.items()}, 0.4 * float(np.mean(list(lexicon.weights.values()))))


def score(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    fold: int = 0, folds: int = 5, bound: int = SAMPLE,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; ``score`` is the probability of label 1.

    Learns from at most about ``bound`` labelled rows whose fold is not ``fold``. Rows are scored one by one, without a shuffle: null and empty
    texts have no hits and get the model's score for that, copies agree, an empty table stays empty; without labels of both kinds every score
    is the share of label 1 (0.5 with none). Other columns are not read.
    """
    rows = sampled(labelled(docs, sample(labels, label, fold, folds, bound, key), key, text))
    lexicon = learn_lexicon(rows)
    measured = map_pieces(rows, lambda b: pa.RecordBatch.from_arrays(
        [pa.array(list(features(lexicon, words_of(b.column("text"), ALNUM)))), b.column("label")], ["x", "y"]
    ), "x array<double>, y int").toPandas()
    y = measured["y"].to_numpy(float)
    if len(y) and 0 < y.mean() < 1:
        weights, mean, scale = logistic(np.stack(measured["x"].to_numpy()), y)
    else:
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        weights, mean, scale = np.append(np.zeros(FEATURES), math.log(share / (1 - share))), np.zeros(FEATURES), np.ones(FEATURES)

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = (features(lexicon, words_of(cleaned(batch.column("text")), ALNUM)) - mean) / scale
        p = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
            ["doc_id", "held_out", "score", "predicted"],
        )

    asked = docs.select(F.col(key).alias("doc_id"), (remainder(F.col(key), folds) == fold).alias("held_out"), F.col(text).alias("text"))
    kind = asked.schema["doc_id"].dataType.simpleString()
    return map_pieces(asked, judge, f"doc_id {kind}, held_out boolean, score double, predicted int")
