import random

from fixtures_llm import SPACE, documents, edge_rows, sentence
from pyspark.sql import functions as F

from quire.llm import mixing


def aims(sizes, cap=3):
    """Targets by handing out the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(cap * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return {s: float(cap * sizes[s]) if s in full else share[s] for s in names}
        full |= over


def corpus():
    rng = random.Random(4)
    rows = [(i, sentence(rng, rng.randrange(0, 90)), "en", rng.choice(["a", "b", "ü", "hot", "hot", "hot", "hot", None]), 1) for i in range(700)]
    return rows + [(900, "tiny one", "en", "z", 1), (901, None, "en", "nothing", 1)] + [(r[0] and r[0] + 1_000, *r[1:]) for r in edge_rows()]


def test_targets_and_taken(spark):
    rows = corpus()
    got = mixing.mix(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len(SPACE.findall(text or ""))
    want = aims(sizes)
    taken, largest = {}, {}
    for r in got:
        s, n = r["source"], len(SPACE.findall(r["text"] or ""))
        assert r["size"] == n and r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * (1 + want[s])
        assert 0 <= r["taken"] <= 3 * n and (not n or r["taken"] % n == 0)
        taken[s] = taken.get(s, 0) + r["taken"]
        largest[s] = max(largest.get(s, 0), n)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s], (s, taken[s], want[s])
    again = mixing.mix(documents(spark, rows).repartition(5, F.rand(1))).collect()
    assert sorted((r["doc_id"] or 0, r["taken"]) for r in got) == sorted((r["doc_id"] or 0, r["taken"]) for r in again)


def test_a_smaller_budget_takes_a_part(spark):
    docs = documents(spark, [r for r in corpus() if r[0] is not None and r[0] < 900]).cache()
    few, many = ({r["doc_id"]: r["taken"] for r in mixing.mix(docs, budget=b).collect()} for b in (4_000, 9_000))
    assert all(few[i] <= many[i] for i in few) and sum(few.values()) < sum(many.values())
    assert abs(sum(few.values()) - 4_000) < 300


def test_clashing_names_and_empty(spark):
    docs = documents(spark, clashing=True)
    mixed = mixing.mix(docs)
    assert sorted(mixed.columns) == sorted(docs.columns)
    assert mixed.count() == docs.count() and mixing.mix(documents(spark, [])).count() == 0
