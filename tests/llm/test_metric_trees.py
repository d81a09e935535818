"""M-tree search and hard negatives against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import hard_negatives, m_tree, vectors
from quire.llm.vectors import NONE, Best, Queries

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<double>, label int"


def rows(n=300, width=6, copies=100, seed=3, few=False):
    """Vectors with groups of copies and many equal scores; every case that takes no part is among them."""
    rng = np.random.default_rng(seed)
    x = rng.integers(-2, 3, (n, width)) / 4 if few else rng.normal(size=(n, width))
    x[n - copies :] = x[n - copies]
    out = [(i, x[i].tolist(), int(rng.integers(0, 4))) for i in range(n)]
    out += [(5, x[5].tolist(), out[5][2]), (n, None, 1), (n + 1, [None, *[1.0] * (width - 1)], 1), (n + 2, [NAN] * width, 1), (n + 3, [INF] * width, 2),
            (None, [1.0] * width, 1), (n + 4, [0.5, 0.25], 2), (n + 5, [], 3), (n + 6, x[0].tolist(), None), (n + 7, [1e30] * width, 2)]
    return out


def whole(data, scale):
    """{id: integer vector} of the rows that take part."""
    width = max((len(v) for _, v, _ in data if v), default=0)
    fine = {}
    for i, v, label in data:
        if i is not None and v is not None and all(c is not None and math.isfinite(c) and abs(c) < 1e6 for c in v):
            fine[i] = ([math.floor(scale * c) for c in v] + [0] * (width - len(v)), label)
    return fine


def dot(a, b):
    return sum(p * q for p, q in zip(a, b))


def brute_top(data, every, k, scale=1024):
    have = whole(data, scale)
    out = set()
    for q in have:
        if q % every == 0:
            best = sorted(((-dot(have[q][0], v), i) for i, (v, _) in have.items() if i != q))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def brute_negatives(data, every, positives=5, negatives=10, scale=256):
    have = {i: v for i, v in whole(data, scale).items() if v[1] is not None}
    out = set()
    for a in have:
        if a % every == 0:
            order = sorted((-dot(have[a][0], v), i) for i, (v, _) in have.items() if i != a)
            for s, p in [x for x in order if have[x[1]][1] == have[a][1]][:positives]:
                fit = [x for x in order if have[x[1]][1] != have[a][1] and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
                out |= {(a, p, r + 1, i, -s, -n) for r, (n, i) in enumerate(fit)}
    return out


def table(spark, data, clashing=False):
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate("id v ask cell rank score number block is_query".split())]) if clashing else df


@pytest.mark.parametrize("few", [False, True])
def test_top_against_all_pairs(spark, few, monkeypatch):
    monkeypatch.setattr(vectors, "TREE_ROWS", 150)
    data = rows(few=few)
    got = m_tree.top(table(spark, data, clashing=few), F.col("vec_id") % 10 == 0, k=7, block_rows=9).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == brute_top(data, 10, 7)


@pytest.mark.parametrize("few", [False, True])
def test_negatives_against_all_pairs(spark, few):
    data = rows(few=few, seed=4)
    got = hard_negatives.mine(table(spark, data, clashing=few), F.col("vec_id") % 10 == 0, block_rows=9).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == brute_negatives(data, 10)


def test_few_rows_and_none(spark):
    for data in ([], [(0, [1.0], 1)], [(0, None, 1)], [(3, [1.0], 1), (4, [1.0], 2)], [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.0], 2)]):
        df = spark.createDataFrame(data, SCHEMA)
        assert set(map(tuple, m_tree.top(df, F.col("vec_id") % 100 == 0).collect())) == brute_top(data, 100, 10)
        assert set(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 100 == 0).collect())) == brute_negatives(data, 100)


def clustered(n=4000, width=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(40, width))[rng.integers(0, 40, n)] + 0.05 * rng.normal(size=(n, width))
    return np.floor(1000 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)


def below(tree, p):
    if tree.leaf[p]:
        return list(range(tree.first[p], tree.last[p]))
    return [r for c in range(tree.first[p], tree.last[p]) for r in below(tree, c)]


def test_pages_cover_their_rows():
    x = clustered()
    tree = m_tree.build(np.arange(len(x)), x)
    space = vectors.Lifted(tree.rows)
    assert sorted(below(tree, 0)) == list(range(len(x)))
    for p in range(len(tree.first)):
        d = space.between(np.array(below(tree, p)), np.array([tree.router[p]]))[:, 0]
        assert d.max() <= tree.radius[p] + 1e-6
        if tree.leaf[p]:
            assert tree.last[p] - tree.first[p] <= m_tree.LEAF
            assert np.allclose(d, tree.to_router[tree.first[p] : tree.last[p]], atol=1e-6)
        else:
            assert np.allclose(space.between(tree.router[tree.first[p] : tree.last[p]], np.array([tree.router[p]]))[:, 0], tree.up[tree.first[p] : tree.last[p]], atol=1e-6)


def test_levels_cover_and_part_their_rows():
    x = clustered()
    tree = hard_negatives.build(np.arange(len(x)), np.zeros(len(x), np.int64), x)
    space = vectors.Lifted(tree.rows)
    assert sorted(below(tree, 0)) == list(range(len(x)))
    for p in range(len(tree.first)):
        d = space.between(np.array(below(tree, p)), np.array([tree.centre[p]]))[:, 0]
        assert d.max() <= tree.radius[p] + 1e-6 and tree.radius[p] <= hard_negatives.BASE ** tree.level[p] * (1 + 1e-9)
        if not tree.leaf[p]:
            children = np.arange(tree.first[p], tree.last[p])
            apart = space.between(tree.centre[children], tree.centre[children])
            assert tree.level[children].max() < tree.level[p] and apart[~np.eye(len(children), dtype=bool)].min() > hard_negatives.BASE ** (tree.level[children].max())


def counted(monkeypatch, module):
    seen = []
    monkeypatch.setattr(module, "products", lambda a, b: seen.append(len(a) * len(b)) or vectors.products(a, b))
    return seen


def test_bounds_save_distances(monkeypatch):
    """On rows in clusters most are never compared with a query."""
    x = clustered()
    ids, label = np.arange(len(x)), np.arange(len(x)) % 2
    queries = Queries(np.arange(40), ids[:4000:100], x[::100], label[::100])
    tree = m_tree.build(ids, x)
    seen = counted(monkeypatch, m_tree)
    best = Best(40, 10, np.full(40, NONE))
    tree.search(queries, best)
    assert sum(seen) < 0.5 * 40 * len(x)
    # as in the trees that a query meets after its own: it comes with a score to reach
    seen.clear()
    tree.search(queries, Best(40, 10, best.low))
    assert sum(seen) < 0.25 * 40 * len(x)
    cover = hard_negatives.build(ids, label, x)
    seen = counted(monkeypatch, hard_negatives)
    score = (x[::100] @ x.T).astype(np.int64)
    peak = np.sort(score, axis=1)[:, -300][:, None]
    cover.search(queries, False, peak * 70 // 100, peak, Best(40, 10, (peak * 70 // 100).ravel()))
    assert sum(seen) < 0.5 * 40 * len(x)


def test_large_components_stay_exact():
    a, b = np.array([[2**28, 1], [3, 2**28]]), np.array([[2**28, 3], [1, 1]])
    assert vectors.products(a, b).tolist() == [[2**56 + 3, 2**28 + 1], [3 * 2**28 + 3 * 2**28, 2**28 + 3]]
