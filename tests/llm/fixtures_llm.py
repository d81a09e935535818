"""Small tables with the cases every operator has to survive."""

import random
import re

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASHES = "size taken target source_size quality leak entities verdict print pieces gaps w m s_ p_ n_ q_ word dropped_id again_id"


def sentence(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edge_rows():
    rng = random.Random(5)
    long = sentence(rng, 30_000, 5_000)
    body = sentence(rng, 80, 400)
    copy = " ".join(body.split()[:-1] + ["other"])
    return [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, "   \n\t ", None, None, 5), (4, long, "en", "b", len(long)),
        (5, body, "en", "a", len(body)), (6, body, "de", None, len(body)), (7, copy, "en", "a", len(copy)), (7, copy, "en", "a", len(copy)),
        (None, body, "en", "b", 1), (8, "One two three four.", "en", "c", 19), (9, "ONE two THREE four.", "en", "c", 19),
        (10, "a line\n" * 30, "en", "c", 210), (11, "é ü   ñ ❤ " * 10, "fr", "b", 120),
        (12, "Mail Me.X1@Mail7.example.com or +1 (017) 555-7713; me.x1@mail7.example.com", "en", "c", 70),
    ]


def documents(spark, rows=None, clashing=False):
    df = spark.createDataFrame(edge_rows() if rows is None else rows, SCHEMA)
    if clashing:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES.split())])
    return df


def shingle_set(text):
    words = SPACE.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def groups(rows):
    """{id: smallest id reachable} by comparing all pairs; null ids and texts without words link nothing."""
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    label = {i: i for i, _ in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((root(sets[a][0]), root(sets[b][0])))
                label[q] = p
    return {i: root(i) for i in label}
