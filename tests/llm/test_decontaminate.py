import hashlib
import random

import pytest
from fixtures_llm import ALNUM, CLASHES, LOWER, documents, edge_rows, sentence

from quire.llm import decontaminate


def words(text):
    return ALNUM.findall((text or "").translate(LOWER))


def brute(text, items):
    w = words(text)
    hit, found = set(), set()
    for name, item in items:
        x = words(item)
        m = min(len(x), 10)
        if not m:
            continue
        wanted = {tuple(x[i : i + m]) for i in range(len(x) - m + 1)}
        for i in range(len(w) - m + 1):
            if tuple(w[i : i + m]) in wanted:
                hit.update(range(i, i + m))
                found.add("" if name is None else str(name))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_hits_equal_brute_force(spark, block):
    rng = random.Random(2)
    items = [(i, sentence(rng, n, 300)) for i, n in enumerate([40, 12, 10, 9, 5, 3, 1, 25, 60, 10])]
    items += [(100, None), (101, "!!"), (102, items[0][1]), (2, items[7][1]), (103, "W1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1"), (None, sentence(rng, 14, 300))]
    rows = edge_rows()
    for i in range(60):
        name, item = rng.choice([x for x in items if x[1]])
        part = item.split()
        a = rng.randrange(len(part))
        piece = " ".join(part[a : a + rng.randrange(1, 30)])
        rows.append((200 + i, f"{sentence(rng, rng.randrange(0, 40), 300)}, {piece.upper()}! {sentence(rng, rng.randrange(0, 40), 300)}", "en", "a", 1))
    rows.append((300, "w1 " * 40, "en", "a", 1))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find(documents(spark, rows), benchmark, block_bytes=block)
    got = got.select("doc_id", "text", "leak", *decontaminate.digest(got)).collect()
    assert len(got) == len(rows)
    for r in got:
        n, hit, names = brute(r["text"], items)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(names), hit > 0), r["doc_id"]
        assert r["items_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()


def test_drop(spark):
    benchmark = spark.createDataFrame([(1, "One two THREE, four")], "item_id long, text string")
    docs = documents(spark, clashing=True)
    left = decontaminate.drop_contaminated(docs, benchmark)
    assert left.columns == docs.columns and set(CLASHES.split()) <= set(left.columns)
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == sorted(r[0] or 0 for r in edge_rows() if r[0] not in (8, 9))
    assert decontaminate.find(documents(spark, []), benchmark).count() == 0
    assert decontaminate.drop_contaminated(docs, benchmark.limit(0)).count() == docs.count()
