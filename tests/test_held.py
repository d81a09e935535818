import random

from pyspark.sql import functions as F

from quire.operators import changes as ch
from quire.operators import held as hd
from quire.streaming import incremental as inc

S = "work_id string, number int, v string"


def numbers_of(rng):
    return [rng.choice([rng.randint(1, 40), rng.randint(32_760, 32_780), rng.randint(65_530, 65_545), 2**31 - 1, 0, -1, -32_768, -2**31]) for _ in range(60)]


def test_bits_against_sets(spark):
    rng = random.Random(1)
    rows = [(f"w{i}", n, "s") for i in range(6) for n in numbers_of(rng)] + [("w0", None, "s"), (None, 3, "s")]
    stored = spark.createDataFrame(rows, S)
    asked = [(f"w{i}", n, "a") for i in range(7) for n in {*numbers_of(rng), *(r[1] for r in rows if r[0] == f"w{i}" and r[1] is not None)}] + [("w1", None, "a"), (None, 3, "a")]
    table = hd.held(stored).cache()
    got = {(r["work_id"], r["number"]): r["held"] for r in hd.with_held(spark.createDataFrame(asked, S), table).collect()}
    have = {(r[0], r[1]) for r in rows if r[0] is not None and r[1] is not None}
    assert got == {(a[0], a[1]): (a[0], a[1]) in have for a in asked}
    counts = {r["work_id"]: r["n"] for r in table.groupBy("work_id").agg(F.sum("n").alias("n")).collect()}
    assert all(counts[f"w{i}"] == len({n for w, n in have if w == f"w{i}"}) for i in range(6))
    assert table.filter(F.octet_length("bits") > 4096).count() == 0
    assert hd.held(spark.createDataFrame([("w", n, "") for n in (1, 9, 17)], S)).select(F.octet_length("bits")).first()[0] == 3


def test_merge_is_the_union(spark):
    rng = random.Random(2)
    parts = [spark.createDataFrame([("w", n, "") for n in numbers_of(rng)] + [("x", 5, "")], S) for _ in range(3)]
    whole = {tuple(r) for r in hd.held(parts[0].unionByName(parts[1]).unionByName(parts[2])).collect()}
    bytes_of = lambda rows: {(w, b, bytes(x), n) for w, b, x, n in rows}
    assert bytes_of(tuple(r) for r in hd.merged(*[hd.held(p) for p in parts]).collect()) == bytes_of(whole)


def test_resume_joins_bitmaps(spark):
    stored = spark.range(100_000).select(F.lit("w").alias("work_id"), (F.col("id") + 1).cast("int").alias("number"), F.lit("old").alias("v"))
    incoming = spark.createDataFrame([("w", 7, "b"), ("w", 100_001, "b"), ("w", 100_001, "a"), ("x", 7, "c")], S)
    assert sorted(tuple(r) for r in ch.resume_inserts(stored, incoming, "v").collect()) == [("w", 100_001, "a"), ("x", 7, "c")]
    assert hd.held(stored).count() == 4


def test_streamed_numbers_are_merged(spark, tmp_path):
    root = str(tmp_path / "t")
    write = inc.resume_writer(root, S, "v", spark.createDataFrame([("w", 3, "old")], S), most=3)
    sent = {}
    for i in range(9):
        rows = [("w", n, f"b{i}") for n in range(i, i + 4)]
        for _ in range(1 + (i % 2)):
            write(spark.createDataFrame(rows, S), i)
        for _, n, v in rows:
            if n != 3:
                sent.setdefault(n, v)
    got = {r["number"]: r["v"] for r in inc.read_batches(spark, root, S).collect()}
    assert got == sent
    rows, top, batches = inc.held_numbers(spark, root)
    assert top >= 3 and len(batches) < 9 and {r["number"] for r in hd.with_held(spark.range(30).select(F.lit("w").alias("work_id"), F.col("id").alias("number")), hd.merged(rows)).filter("held").collect()} == set(sent)
    # a batch that the merge holds already is done
    write(spark.createDataFrame([("w", 500, "late")], S), 0)
    assert inc.read_batches(spark, root, S).count() == len(sent)
