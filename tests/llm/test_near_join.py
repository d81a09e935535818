import random

import numpy as np
import pytest
from fixtures_llm import CLASHES, documents, edge_rows, groups, sentence, shingle_set

from quire.llm import near_join


def family(rng, size, copies, edits):
    base = sentence(rng, size, 3_000).split()
    out = []
    for _ in range(copies):
        words = list(base)
        for _ in range(edits):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def corpus():
    rng = random.Random(11)
    passage = sentence(rng, 55, 3_000)
    texts = []
    for size, copies, edits in ((8, 6, 1), (30, 8, 1), (60, 10, 2), (75, 10, 2), (90, 10, 3), (200, 12, 4), (400, 8, 9), (700, 6, 14)):
        texts += family(rng, size, copies, edits)
    texts += [f"{sentence(rng, rng.randrange(5, 120), 3_000)} {passage} {sentence(rng, rng.randrange(5, 120), 3_000)}" for _ in range(40)]
    texts += [texts[3]] * 5 + ["one", "one", "one two", "a b c d", "A B c D"]
    # a chain: each drops a little more of the text, so that only neighbours are similar
    words = sentence(rng, 300, 3_000).split()
    texts += [" ".join(words[15 * k : 15 * k + 150]) for k in range(10)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, texts[k], "en", "a", 1) for i, k in enumerate(order)]


@pytest.mark.parametrize("block", [4_096, 8])
def test_groups_equal_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(near_join, "BLOCK", block)
    rows = corpus() + [(None if i is None else i + 1_000, *rest) for i, *rest in edge_rows()]
    got = near_join.near_copies(documents(spark, rows)).collect()
    want = groups([r[:2] for r in rows])
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    sizes = {r[0]: len(shingle_set(r[1])) for r in rows}
    assert all(r["n_shingles"] == sizes[r["doc_id"]] for r in got)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]


def test_similar_sets_share_a_part():
    rng = np.random.default_rng(3)
    for a in [1, 3, 7, 20, 63, 64, 70, 81, 95, 96, 120, 300, 1_000, 4_000]:
        for _ in range(6):
            small = rng.integers(1, 1 << 62, a).astype(np.uint64)
            b = int(rng.integers(a, int(1.25 * a) + 1))
            keep = -(-4 * (a + b) // 9)
            if keep > a:
                continue
            large = np.concatenate([small[:keep], rng.integers(1, 1 << 62, b - keep).astype(np.uint64)])
            doc = np.repeat([0, 1], [a, b])
            value = np.concatenate([small, large])
            assert 100 * keep >= 80 * (a + b - keep)
            counts = np.array([a, b])
            own, low = near_join.band(counts), near_join.band((4 * counts + 4) // 5)
            found = [set(), set()]
            for group in (own, np.where(low < own, low, -1)):
                owner, sig = near_join.parts(doc, value, group, 0)
                for o, s in zip(owner, sig):
                    found[o].add(int(s))
            for i in (0, 1):
                if own[i] == 0 or low[i] == 0:
                    found[i] |= {("single", int(v)) for v in value[doc == i]}
            assert found[0] & found[1], (a, b)
            x, y = (np.frombuffer(s, np.uint64) for s in near_join.sketches(doc, value, 2))
            assert near_join._near(x, y, a, b)


def test_stage_keeps_one_of_each_group(spark):
    rows = corpus() + [(r[0] and r[0] + 1_000, *r[1:]) for r in edge_rows()]
    docs = documents(spark, rows, clashing=True)
    kept = near_join.keep_one(docs)
    assert kept.columns == docs.columns and set(CLASHES.split()) <= set(kept.columns)
    want = groups([r[:2] for r in rows])
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert ids == sorted(i for i, c in want.items() if i == c)
    assert near_join.near_copies(documents(spark, [])).count() == 0
    assert near_join.keep_one(documents(spark, [])).count() == 0
