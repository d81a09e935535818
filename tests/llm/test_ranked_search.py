"""Ranked search against scoring every document."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fixtures_llm import ALNUM, LOWER, documents, edge_rows
from quire.llm import ranked_search
from quire.llm.common import words_of


def brute(docs, items, k=10):
    """{(item, rank, doc, score)} of rows (id, text); null ids stand last."""
    counts = [(i, Counter(ALNUM.findall((t or "").translate(LOWER)))) for i, t in docs]
    n = sum(1 for _, c in counts if c)
    total = sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for item, text in set(items):
        terms = Counter(ALNUM.findall((text or "").translate(LOWER)))
        scored = []
        for i, c in counts:
            s = 0
            for w, q in terms.items():
                if c[w]:
                    weight = math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1)))
                    s += q * weight * ((10**9 * c[w]) // (1000 * c[w] + 8 * (25 + (75 * sum(c.values()) * n) // total)))
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


ITEMS = [(1, "one TWO three"), (2, "w1 w2 w2 w3 w17 w400"), (3, None), (4, ""), (5, "never-seen words_only"), (6, "a line"), (6, "a line"), (None, "é ü w5"), (7, "..."),
         (8, " ".join(f"w{i}" for i in range(200)))]


def table(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("postings, block", [(1 << 19, 1 << 20), (40, 1 << 20), (1 << 19, 64)])
def test_against_every_document(spark, monkeypatch, postings, block):
    monkeypatch.setattr(ranked_search, "POSTINGS", postings)
    rows = edge_rows() + [(100 + i, f"w{i % 7} w{i % 11} " + "w2 " * (i % 4), "en", "a", 1) for i in range(300)] + [(50, "w1 w2 w3", "en", "a", 1)] * 40
    got = ranked_search.search(documents(spark, rows, clashing=True).repartition(3), table(spark, ITEMS), block_bytes=block).collect()
    assert sorted(map(tuple, got), key=str) == brute([r[:2] for r in rows], ITEMS)


def test_nothing_to_search(spark):
    docs, items = documents(spark), table(spark, ITEMS)
    assert ranked_search.search(docs.filter("false"), items).count() == 0
    assert ranked_search.search(docs, items.filter("false")).count() == 0
    assert ranked_search.search(docs.filter("text is null"), items).count() == 0
    assert ranked_search.search(docs, table(spark, [(1, "zzz")])).count() == 0


def test_text_keys(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("é", "x"), (None, "x y"), ("c", None)], "name string, body string")
    items = spark.createDataFrame([("q", "x")], "item_id string, text string")
    got = ranked_search.search(docs, items, key="name", text="body").orderBy("rank").collect()
    assert [r["name"] for r in got] == ["é", "a", "b", None]


def shard_of(docs, asked):
    """A shard over lists of words, with impacts drawn at random."""
    words = words_of(pa.array([" ".join(d) for d in docs]), np.array([c not in (32,) for c in range(256)]))
    doc, term, _ = ranked_search.postings(words, asked)
    by = np.lexsort((doc, term))
    impact = np.random.default_rng(2).integers(1, 50, len(doc))
    return ranked_search.Shard(np.searchsorted(term[by], np.arange(len(asked) + 1)), doc[by], impact, len(docs))


def test_range_maxima():
    rng = np.random.default_rng(0)
    docs = [[f"t{j}" for j in range(20) if rng.random() < 0.3] for _ in range(400)]
    asked = ranked_search.items_of(pa.array([" ".join(f"t{j}" for j in range(20))])).hashes
    shard = shard_of(docs, asked)
    for _ in range(300):
        t = rng.integers(0, 20)
        a, b = np.sort(rng.integers(shard.start[t], shard.start[t + 1] + 1, 2))
        place, size = shard.highest(np.array([a]), np.array([b]))
        assert size[0] == (shard.impact[a:b].max() if b > a else 0)
        assert a == b or (a <= place[0] < b and shard.impact[place[0]] == size[0])


def test_search_scores_few_documents(monkeypatch):
    """Where a few documents stand out, most are never scored, and ties go to the first documents."""
    docs = [["a", "b"] if i % 500 == 3 else ["a"] if i % 2 else ["c"] for i in range(20_000)]
    asked = ranked_search.items_of(pa.array(["a b"]))
    shard = shard_of(docs, asked.hashes)
    shard.impact[:] = 10
    shard = ranked_search.Shard(shard.start, shard.doc, shard.impact, shard.n_docs)
    calls = []
    real = ranked_search.Shard.highest
    monkeypatch.setattr(ranked_search.Shard, "highest", lambda self, low, high: calls.append(len(low)) or real(self, low, high))
    found, scores = shard.search(*asked.terms[0], 10, 0)
    assert scores.tolist() == [20] * 10 and found.tolist() == [3 + 500 * i for i in range(10)]
    assert sum(calls) < 6_000
