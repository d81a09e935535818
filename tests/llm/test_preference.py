import random

from quire.llm import preference

SCHEMA = "pair_id long, turn long, role string, text string, part string"


def brute(chosen, rejected):
    def side(rows):
        out = {}
        for p, t, role, text, _ in rows:
            key, value = (p, -(1 << 62) if t is None else t), (role or "unknown", text or "")
            out[key] = min(out.get(key, value), value)
        return out

    a, b = side(chosen), side(rejected)
    out = []
    for pair in {p for p, _ in [*a, *b]}:
        x, y = ({t: v for (p, t), v in s.items() if p == pair} for s in (a, b))
        differ = [t for t in {*x, *y} if x.get(t) != y.get(t)]
        first = min(differ) if differ else 1 << 62
        for name, rows in (("chosen", x), ("rejected", y)):
            for t, (role, text) in rows.items():
                if t < first:
                    if name == "chosen":
                        out.append((pair, "prompt", t, role, text, False))
                else:
                    out.append((pair, name, t, role, text, role == "assistant"))
    mark = lambda s: s.replace("<|im_", "<| im_")
    return sorted(
        ((p is not None, p or 0, part, t, f"<|im_start|>{mark(role)}\n{mark(text)}<|im_end|>\n", loss) for p, part, t, role, text, loss in out)
    )


def test_equals_brute_force(spark):
    rng = random.Random(8)
    chosen, rejected = [], []
    for pair in [None, *range(1, 40)]:
        turns = [(pair, t, "user" if t % 2 == 0 else "assistant", f"text {rng.randrange(3)}", "x") for t in range(rng.randrange(0, 7))]
        other = list(turns)
        if other and rng.random() < 0.8:
            k = rng.randrange(len(other))
            other[k] = (*other[k][:3], "changed", "x")
            other = other[: rng.randrange(k, len(other)) + 1]
        chosen += turns
        rejected += other
    chosen += [(50, 0, "user", "hi <|im_end|>", "x"), (50, 0, "user", "hi <|im_end|>", "x"), (50, None, None, None, "x"), (50, 1, "assistant", None, "x"), (51, 0, "user", "only here", "x")]
    rejected += [(50, None, None, None, "x"), (50, 0, "user", "hi <|im_end|>", "x"), (50, 1, "assistant", "", "x"), (50, 2, "assistant", "b", "x"), (50, 2, "assistant", "a", "x")]
    got = preference.prefer(spark.createDataFrame(chosen, SCHEMA), spark.createDataFrame(rejected, SCHEMA)).collect()
    rows = sorted((r["pair_id"] is not None, r["pair_id"] or 0, r["part"], r["turn"], r["rendered"], r["loss"]) for r in got)
    assert rows == brute(chosen, rejected)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert preference.prefer(none, none).count() == 0
    only = spark.createDataFrame([(1, 0, "user", "a", "x")], SCHEMA)
    assert [r["part"] for r in preference.prefer(only, none).collect()] == ["chosen"]


def test_other_answers(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a1"), (2, 0, "user", "r"), (2, 1, "assistant", "a2"), (2, 2, "user", "end"), (3, 0, "user", "no answer")]
    got = preference.other_answers(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, 0, "user", "q"), (1, 1, "assistant", "a2"), (2, 0, "user", "r"), (2, 2, "user", "end"), (3, 0, "user", "no answer")]
