import random
import re

import pytest
from pyspark.sql import functions as F

from quire.operators import phrases as ph


def brute(text, pairs, bounded=True):
    """One walk over the text, the longest phrase that fits at each place."""
    table = {}
    for p, r in pairs:
        table.setdefault(p.lower(), r)
    low, out, i = text.lower(), [], 0
    word = re.compile(r"[\w\u0300-\u036f]").match
    while i < len(text):
        best = None
        for p in sorted(table, key=len, reverse=True):
            j = i + len(p)
            if p and low.startswith(p, i):
                edges = bounded and " " not in p and ((i and word(p[0]) and word(low[i - 1])) or (j < len(low) and word(p[-1]) and word(low[j])))
                if not edges:
                    best = p
                    break
        if best is None:
            out.append(text[i])
            i += 1
        else:
            r = table[best]
            out.append(r[:1].upper() + r[1:] if text[i] != text[i].lower() else r)
            i += len(best)
    return "".join(out)


def test_phrases(value):
    pairs = (("máu", "huyết"), ("máu lạnh", "tàn nhẫn"), ("uống máu", "hút"), ("vlog", "vi lóc"), ("-x", "y"), ("", "never"))
    run = lambda t: value(lambda c: ph.replace_phrases(c, pairs), t)
    assert run("Máu lạnh, máu. uống máu lạnh MÁUX vlogs Vlog -x a-x") == "Tàn nhẫn, huyết. hút lạnh MÁUX vlogs Vi lóc y ay"
    assert run("") == "" and run(None) is None and run("İ máu") == "İ huyết"
    assert value(lambda c: ph.replace_phrases(c, ()), "as it is") == "as it is"
    assert value(lambda c: ph.replace_phrases(c, (("a", "b"), ("b", "c"), ("A", "z"))), "a b A") == "b c B"


def test_foreign_words(value):
    run = lambda t: value(lambda c: ph.replace_foreign_words(c, (("system", "hệ thống"), ("boss", "trùm"))), t)
    assert run("System mở. hệ thống system chạy, boss trùm, Hệ thống (system) systems") == "Hệ thống mở. hệ thống chạy, trùm, Hệ thống (hệ thống) systems"


def test_terms(spark, value):
    assert value(lambda c: ph.holds_any(c, ("naked", "Blood")), "a BLOODY thing") is True
    assert value(lambda c: ph.holds_any(c, ("naked", "blood"), bounded=True), "a bloody thing") is False
    assert value(lambda c: ph.holds_any(c, ()), "x") is False and value(lambda c: ph.holds_any(c, ("x",)), None) is None
    assert value(lambda c: ph.phrase_counts(c, ("a b", "a", "b")), "a b A b. b ab") == {"a b": 2, "b": 1}


@pytest.mark.parametrize("bounded", [True, False])
def test_against_a_walk(spark, bounded):
    rng = random.Random(8)
    letters = "abé -"
    some = lambda n: "".join(rng.choice(letters) for _ in range(n))
    pairs = [(some(rng.randint(1, 4)).strip() or "a", f"<{i}>") for i in range(30)]
    texts = [some(rng.randint(0, 60)) for _ in range(200)] + [some(30).upper() for _ in range(50)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r["id"]: r["out"] for r in df.select("id", ph.replace_phrases("text", pairs, bounded).alias("out")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t, pairs, bounded), (t, pairs)


def test_a_long_list_is_one_pass(spark):
    """5,000 phrases cost about what 50 do."""
    import time

    words = [f"w{i}" for i in range(5_000)]
    df = spark.range(2_000).select(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(200)), lambda i: F.concat(F.lit("w"), ((F.col("id") * 31 + i * 17) % 9_000).cast("string"))), " ").alias("text")).cache()
    df.count()

    def timed(n):
        start = time.time()
        out = df.select(ph.replace_phrases("text", [(w, w[::-1]) for w in words[:n]]).alias("t"))
        total = out.agg(F.sum(F.size(F.filter(F.split("t", " "), lambda x: ~F.startswith(x, F.lit("w")))))).first()[0]
        return total, time.time() - start

    timed(50)
    (few, short), (many, long) = timed(50), timed(5_000)
    assert many > 50 * few > 0 and long < 5 * short + 2


def test_a_capital_is_one_letter(value):
    run = lambda t: value(lambda c: ph.replace_foreign_words(c, (("heit", "ßung"), ("keit", "ﬁn"))), t)
    assert run("Heit heit Keit") == "ẞung ßung ﬁn"
    assert value(lambda c: ph.replace_phrases(c, (("heit", "ßung"),)), "Heit") == "ẞung"
