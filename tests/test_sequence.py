import random

import numpy as np
from pyspark.sql import functions as F

from quire.operators import ordered as od
from quire.operators import segment as sg
from quire.operators import sequence as sq
from quire.operators.ordered import BLOCK, Neighbour, Running, Total, global_rank, ordered

S = "work_id string, number int, title string, content string, word_count int, publish_status string"


def sections(spark, works):
    """works: {id: [(number, short, status)]}; short texts have one word, long ones three."""
    rows = [(w, n, f"t{n}", f" {w}{n} " if short else f" {w}{n} b c ", 1 if short else 3, status) for w, items in works.items() for n, short, status in items]
    return spark.createDataFrame(rows, S)


def merged_in_order(items):
    """The merge one step at a time: numbers downwards, k into k-1, number 1 into 2."""
    alive = {n: [n] for n, _, _ in items}
    ok = failed = 0
    for n in sorted((n for n, short, status in items if short and status == "published"), reverse=True):
        target = 2 if n == 1 else n - 1
        if n not in alive or target not in alive:
            failed += 1
            continue
        alive[target] = alive.pop(n) + alive[target] if n == 1 else alive[target] + alive.pop(n)
        ok += 1
    return alive, ok, failed


def test_merge_equals_step_by_step(spark):
    rng = random.Random(5)
    works = {}
    for i in range(120):
        numbers = sorted(rng.sample(range(1, 15), rng.randint(1, 12)))
        works[f"w{i}"] = [(n, rng.random() < 0.6, "pending" if rng.random() < 0.15 else "published") for n in numbers]
    s = sections(spark, works)
    open_works = spark.createDataFrame([(w, "published") for w in works], "work_id string, publish_status string")
    plan = sq.merge_plan(open_works, s, 2, width=4).collect()
    heads, counts = {}, {}
    for r in plan:
        heads.setdefault(r["work_id"], {}).setdefault(r["head"], []).append(r["number"])
        c = counts.setdefault(r["work_id"], [0, 0])
        c[0] += r["short"] and r["head"] != r["number"]
        c[1] += r["short"] and r["head"] == r["number"]
    for w, items in works.items():
        alive, ok, failed = merged_in_order(items)
        assert {k: sorted(v) for k, v in alive.items()} == {k: sorted(v) for k, v in heads[w].items()}, (w, items)
        assert counts[w] == [ok, failed]
    out = sq.merge_short(open_works, s, 2, width=4)
    assert out.agg(F.sum("word_count")).first()[0] == s.agg(F.sum("word_count")).first()[0]
    kept = {(r["work_id"], r["number"]): r for r in out.collect()}
    for w, items in works.items():
        alive, ok, failed = merged_in_order(items)
        touched = any(short and status == "published" for _, short, status in items)
        for i, head in enumerate(sorted(alive), 1):
            row = kept[(w, i if touched else head)]
            if len(alive[head]) > 1:
                assert row["title"] == f"t{head}" and row["content"].strip().split("\n\n")[0].split()[0] == f"{w}{min(alive[head])}"


def test_merged_text(spark):
    s = spark.createDataFrame([("w", 1, "a", "a ", 9, "published"), ("w", 2, "b", " b ", 1, "published"), ("w", 3, "c", " c", 1, "published")], S)
    works = spark.createDataFrame([("w", "published")], "work_id string, publish_status string")
    assert [r["content"] for r in sq.merge_short(works, s, 5).collect()] == ["a\n\nb\n\nc"]


def test_ordered_blocks(spark):
    rng = random.Random(1)
    rows = [(f"w{i}", n, rng.randint(0, 9)) for i in range(5) for n in sorted(rng.sample(range(1, 60), 25))]
    df = spark.createDataFrame(rows, "work_id string, number int, v int")
    out = ordered(df, "work_id", "number", 7, s=Running(F.col("v")), x=Running(F.col("v"), inclusive=False), m=Running(F.col("v"), "max"),
                  p=Neighbour(F.col("v")), n=Neighbour(F.col("v"), 1), t=Total(F.col("v")))
    got = {(r["work_id"], r["number"]): r for r in out.collect()}
    for w in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == w]
        for i, (_, n, v) in enumerate(mine):
            r, before = got[(w, n)], [x[2] for x in mine[: i + 1]]
            assert (r["s"], r["x"], r["m"], r["t"]) == (sum(before), sum(before) - v, max(before), sum(x[2] for x in mine))
            assert r["p"] == (mine[i - 1][2] if i else None) and r["n"] == (mine[i + 1][2] if i + 1 < len(mine) else None)


def test_ordered_by_hashed_numbers(spark, monkeypatch):
    """A work of 10**5 rows under hashed 64-bit numbers: no window holds more than a block or FAN blocks."""
    monkeypatch.setattr(od, "FAN", 1 << 11)
    n = 100_000
    rows = spark.range(n).select(F.lit("w").alias("work_id"), F.xxhash64("id").alias("number"), (F.col("id") % 7).alias("v"))
    rows = rows.unionByName(spark.createDataFrame([("x", -(2**63), 1), ("x", 2**63 - 1, 2), ("x", 0, 3)], rows.schema)).cache()
    seen = []
    real = Running.local
    monkeypatch.setattr(Running, "local", lambda self, group, order: seen.append(tuple(group)) or real(self, group, order))
    out = ordered(rows, "work_id", "number", 1 << 10, s=Running(F.col("v")), p=Neighbour(F.col("v")), t=Total(F.col("v"), "max"))
    got = out.filter("work_id = 'w'").orderBy("number").toPandas()
    want = rows.filter("work_id = 'w'").orderBy("number").toPandas()
    assert (got["number"] == want["number"]).all() and (got["v"] == want["v"]).all()
    assert (got["s"] == want["v"].cumsum()).all() and (got["t"] == 6).all()
    assert got["p"].isna()[0] and (got["p"][1:].to_numpy() == want["v"][:-1].to_numpy()).all()
    assert [(r["s"], r["p"], r["t"]) for r in out.filter("work_id = 'x'").orderBy("number").collect()] == [(1, None, 3), (4, 1, 3), (6, 3, 3)]
    assert seen[0] == ("work_id",) and seen[-1] == ("work_id", "_block0") and len(seen) == 6
    # what the windows hold: the numbers of a block, and its blocks at every level
    blocks = rows.select("work_id", od.block_of("number", 1 << 10).alias("b"))
    assert rows.groupBy("work_id", od.block_of("number", 1 << 10)).count().agg(F.max("count")).first()[0] <= 1 << 10
    for _ in range(4):
        assert blocks.distinct().groupBy("work_id", od.block_of("b", od.FAN)).count().agg(F.max("count")).first()[0] <= od.FAN
        blocks = blocks.select("work_id", od.block_of("b", od.FAN).alias("b"))


def test_runs_by_large_numbers(spark):
    base = 2**40
    rows = [("w", base + n, n % 10 != 0) for n in range(0, 200) if n % 37] + [("w", -5, True), ("w", -4, True), ("w", -3, False)]
    df = spark.createDataFrame(rows, "work_id string, number long, joins boolean")
    got = {r["number"]: r["head"] for r in od.run_heads(df, "work_id", "number", F.col("joins"), width=4).collect()}
    head, last = None, None
    for _, n, joins in sorted(rows, key=lambda r: r[1]):
        head = head if joins and last == n - 1 else n
        assert got[n] == head, n
        last = n


def test_global_rank(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("k"), F.concat(F.lit("x"), F.col("id") % 3).alias("g"))
    rows = sorted((r["g"], r["k"], r["rank"]) for r in global_rank(df, ["g", "k"]).collect())
    assert [r[2] for r in rows] == list(range(500))


def pack(lengths, limit):
    parts, part, size, open_ = [], 0, 0, False
    for n in lengths:
        if not open_ or size + n > limit:
            part, size, open_ = part + 1, 0, True
        size += n
        parts.append(part)
    return parts


def test_packing(spark):
    assert pack([30, 40, 50, 70, 10], 60) == [1, 2, 3, 4, 5]
    rng = random.Random(9)
    rows, want = [], {}
    for i in range(40):
        lengths = [rng.choice([0, 0, 5, 10, 30, 61, 200, rng.randint(0, 60)]) for _ in range(rng.randint(1, 40))]
        for n, (size, part) in enumerate(zip(lengths, pack(lengths, 60)), 1):
            rows.append((f"w{i}", n, size))
            want[(f"w{i}", n)] = part
    df = spark.createDataFrame(rows, "work_id string, number int, length int")
    for width in (3, 8, 1000):
        got = {(r["work_id"], r["number"]): r["part"] for r in sg.pack_sections(df, 60, width).collect()}
        assert got == want, width


def test_packing_a_long_work(spark, monkeypatch):
    """One work of many one-character sections, under numbers far apart, and one of mixed lengths."""
    monkeypatch.setattr(sg, "FOLD", 4)
    rng = random.Random(2)
    mixed = [rng.choice([0, 1, 7, 30, 61, 200]) for _ in range(3_000)]
    rows = [("long", i * 19_997, 1) for i in range(100_000)] + [("mixed", i, n) for i, n in enumerate(mixed)]
    df = spark.createDataFrame(rows, "work_id string, number int, length int")
    groups = []
    real = sg._entries
    monkeypatch.setattr(sg, "_entries", lambda f, top, limit: groups.append(f.groupBy("work_id", F.floor(F.col(BLOCK) / 4)).count().agg(F.max("count")).first()[0]) or real(f, top, limit))
    got = sg.pack_sections(df, 60, 1_000).orderBy("work_id", "number").collect()
    assert [r["part"] for r in got] == [i // 60 + 1 for i in range(100_000)] + pack(mixed, 60)
    assert len(groups) == 4 and max(groups) <= 4


def test_steps_compose():
    rng = random.Random(4)
    for _ in range(300):
        limit = rng.choice([1, 10, 60])
        a, b, c = ([rng.choice([0, 0, 1, 5, 30, 61, 90]) for _ in range(rng.randint(1, 12))] for _ in range(3))
        f, g, h = (sg.steps_of(np.array(x), limit) for x in (a, b, c))
        left, right, whole = f.then(g, limit).then(h, limit), f.then(g.then(h, limit), limit), sg.steps_of(np.array(a + b + c), limit)
        for chars in range(limit + 40):
            want = tuple(int(x) for x in whole.after(chars, 2, limit))
            assert tuple(int(x) for x in left.after(chars, 2, limit)) == tuple(int(x) for x in right.after(chars, 2, limit)) == want


def allocate(words, target, piece):
    total = sum(words)
    if total < target * piece:
        return None
    out = [min(max(1, round(target * w / total)), max(1, w // piece)) for w in words]
    diff, order, i = target - sum(out), sorted(range(len(words)), key=lambda i: -words[i]), 0
    while diff and i < len(order):
        k = order[i]
        if diff > 0 and words[k] >= (out[k] + 1) * piece:
            out[k], diff = out[k] + 1, diff - 1
        elif diff < 0 and out[k] > 1:
            out[k], diff = out[k] - 1, diff + 1
        else:
            i += 1
    return out


def test_allocation(spark):
    assert allocate([4000, 4000], 5, 400) == [3, 2] and allocate([300, 8000], 10, 400) == [1, 9]
    rng = random.Random(2)
    works = {f"w{i}": [rng.randint(1, 60) for _ in range(rng.randint(1, 8))] for i in range(60)}
    df = spark.createDataFrame([(w, n, "x " * k) for w, ks in works.items() for n, k in enumerate(ks, 1)], "work_id string, number int, content string")
    got = {}
    for r in sg.allocate(df, 9, 7).collect():
        got.setdefault(r["work_id"], {})[r["number"]] = r["pieces"]
    for w, ks in works.items():
        want = allocate(ks, 9, 7)
        assert got.get(w) == (None if want is None else dict(enumerate(want, 1))), (w, ks)


def test_paragraphs_and_cuts(spark, value):
    assert value(lambda c: sg.paragraphs(c, 5), " a \n\n\n\n b") == ["a", "b"]
    told = " ".join(f"câu {i}." for i in range(40))
    assert [len(x.split(".")) - 1 for x in value(lambda c: sg.paragraphs(c, 5), told)] == [3] * 13 + [1]
    df = spark.createDataFrame([(20, 3)], "n int, k int")
    assert df.select(sg.even_cuts(F.col("n"), F.col("k"))).first()[0] == [6, 12]
    parts = "|".join(str(i) for i in range(20))
    cut = value(lambda c: sg.cut_pieces(F.split(c, r"\|"), F.array(F.lit(6), F.lit(12))), parts)
    assert [len(x["content"].split("\n\n")) for x in cut] == [6, 6, 8] and cut[2]["title"] == "Phần 3"


def test_supplied_cuts(spark):
    df = spark.createDataFrame([("w", 1, "t", "\n".join(f"p{i} x" for i in range(8)))], "work_id string, number int, title string, content string")
    cuts = spark.createDataFrame([("w", 1, [2], ["one", ""])], "work_id string, number int, splits array<int>, titles array<string>")
    out = {r["number"]: (r["title"], r["word_count"]) for r in sg.split_to_target(df, 2, 2, cuts).collect()}
    assert out == {1: ("one", 4), 2: ("Phần 2", 12)}


def test_chunks(value):
    assert value(lambda c: sg.text_chunks(c, 5), "aaa\n\nbb\n\ncccccccc\n\nd") == ["aaa\n\nbb", "cccccccc", "d"]
    assert value(lambda c: sg.text_chunks(c, 100), "a\n\nb") == ["a\n\nb"]


def test_stop_rule(spark):
    rows = [("w", i, n, False) for i, n in enumerate([80, 10, 10, 10, 90])] + [("v", i, n, i == 2) for i, n in enumerate([80, 10, 10, 10, 90])]
    df = spark.createDataFrame(rows, "work_id string, pos int, length int, loaded boolean")
    assert sorted((r["work_id"], r["pos"]) for r in sq.usable_fetches(df).collect()) == [("v", 0), ("v", 2), ("v", 4), ("w", 0)]


def test_attempts(spark):
    rows = [("a", 1, "x" * 20, "good end."), ("b", 1, "x" * 20, "cut off here"), ("b", 2, "x" * 20, "second one."), ("c", 1, "x" * 20, "cut off here"),
            ("c", 2, "x" * 20, "cut again yes"), ("d", 1, "x" * 50, "short.")]
    df = spark.createDataFrame(rows, "chunk_id string, attempt int, source_text string, text string")
    out = {r["chunk_id"]: (r["chosen"], r["text"]) for r in sq.choose_attempts(df, F.lit(0.0)).collect()}
    assert out == {"a": (1, "good end."), "b": (2, "second one."), "c": (0, "x" * 20), "d": (0, "x" * 50)}


def test_margin(spark):
    df = spark.createDataFrame([("x", "a", 5.0), ("x", "b", 3.0), ("y", "a", 5.0), ("y", "b", 4.0), ("z", "a", 5.0)], "bad string, cand string, score double")
    assert [tuple(r) for r in sq.top_by_margin(df).collect()] == [("x", "a")]
