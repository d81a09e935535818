import collections
import math
import zlib

import numpy as np
import pytest
from fixtures_llm import LOWER, SPACE, documents, edge_rows

from quire.llm import lm_score as lm
from quire.llm.common import words_of


@pytest.fixture(scope="module")
def sub():
    with open(lm.TOKENIZER, "rb") as f:
        return lm.Subwords.of(f.read())


def small(seed=1):
    rng = np.random.default_rng(seed)
    v = 40
    cls = rng.integers(0, lm.CLASSES, v)
    cls[:2] = 0
    row = rng.integers(0, lm.ROWS, v)
    emb = rng.standard_normal((v, lm.DIM))
    p = {k: rng.standard_normal(s) * 0.3 for k, s in lm.SHAPES.items()}
    inputs, targets = rng.integers(0, v, (3, lm.WINDOW)), rng.integers(0, v, (3, lm.STEP))
    targets[2, 9:] = -1
    return p, emb, cls, row, inputs, targets, np.array([True, False, False])


def test_gradients_match_differences():
    p, emb, cls, row, inputs, targets, begins = small()
    g, _ = lm.gradients(p, emb, cls, row, inputs, targets, begins)
    rng = np.random.default_rng(2)
    for name, shape in lm.SHAPES.items():
        for _ in range(4):
            at = tuple(int(rng.integers(0, n)) for n in shape)
            if name == "pair":
                at = (int(row[inputs[0, lm.STEP + 1]]), at[1])
            losses = []
            for step in (1e-5, -1e-5):
                q = {k: v.copy() for k, v in p.items()}
                q[name][at] += step
                losses.append(lm.gradients(q, emb, cls, row, inputs, targets, begins)[1])
            assert abs((losses[0] - losses[1]) / 2e-5 - g[name][at]) < 1e-4, name


def test_attention_sees_only_the_past_of_its_text():
    p, emb, cls, row, inputs, _, begins = small()
    base = lm.forward(p, emb, row, inputs, begins)["logits"].reshape(3, lm.STEP, -1)
    later, earlier = inputs.copy(), inputs.copy()
    later[:, lm.STEP + 8] = (later[:, lm.STEP + 8] + 1) % 40
    earlier[:, 3] = (earlier[:, 3] + 1) % 40
    assert np.allclose(base[:, :8], lm.forward(p, emb, row, later, begins)["logits"].reshape(3, lm.STEP, -1)[:, :8])
    moved = lm.forward(p, emb, row, earlier, begins)["logits"].reshape(3, lm.STEP, -1)
    assert np.allclose(base[0], moved[0]) and not np.allclose(base[1], moved[1])


def test_probabilities_sum_to_one():
    p, emb, cls, row, inputs, _, begins = small()
    rng = np.random.default_rng(3)
    pairs = rng.integers(0, 5, (40, lm.ROWS)).astype(float)
    model = lm.Model(p, emb, cls, row, lm.Behind(rng.integers(0, 50, 40).astype(float), cls, pairs))
    # classes without a subword take some of the probability; give every class one
    shares = np.zeros((40, lm.ROWS))
    for r in range(lm.ROWS):
        shares[:, r] = np.exp(model.behind.log(np.arange(40), np.full(40, r)))
    for c in np.unique(cls):
        assert np.allclose(shares[cls == c].sum(0), 1)


def test_subwords_of_words_do_not_depend_on_neighbours(sub):
    words = ["hello", "don't", "a\u00a0b", "\u00a0", "日本語", "é.", "12,34", "\u2028x", "##", "x" * 300, "y\u00a0", "\u00a0z"]
    for some in (words, [w for w in words if not lm.ODD.search(w)], []):
        text, sizes = lm.spelled(*all_words(some))
        ids, begin = sub.cut(text, sizes)
        for i, w in enumerate(some):
            assert ids[begin[i] : begin[i + 1]].tolist() == sub.encoding.encode_ordinary(" " + w)


def all_words(some):
    import pyarrow as pa

    words = words_of(pa.array([" ".join(some)], pa.string()))
    return words, np.arange(len(words.start))


def test_scoring_equals_the_plain_forward_pass(sub):
    """``Model.log10``, which computes keys and values once per position, against ``forward`` on whole windows."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    size = sub.end + 1
    cls, row = rng.integers(0, lm.CLASSES, size), rng.integers(0, lm.ROWS, size)
    emb = rng.standard_normal((size, lm.DIM)).astype(np.float32)
    p = {k: (rng.standard_normal(s) * 0.3).astype(np.float32) for k, s in lm.SHAPES.items()}
    behind = lm.Behind(rng.integers(0, 9, size).astype(float), cls, rng.integers(0, 3, (size, lm.ROWS)).astype(float))
    texts = ["", None, "short one", "a long text of several windows " * 20, "the end"]
    words = words_of(pa.array(texts))
    keys, where, inverse = lm.distinct(words)
    s = lm.stream_of(words, inverse, *sub.cut(*lm.spelled(words, where)), sub.end)
    got = lm.Model(p, emb, cls, row, behind).log10(s, len(texts), rows=7)
    inputs, targets = s.inputs.reshape(-1, lm.STEP), s.targets.reshape(-1, lm.STEP)
    before = np.concatenate([np.full((1, lm.STEP), sub.end), inputs[:-1]])
    before[s.begins] = sub.end
    logits = lm.forward(p, emb, row, np.concatenate([before, inputs], 1), s.begins)["logits"]
    logp = logits - np.log(np.exp(logits).sum(1, keepdims=True))
    want = np.zeros(len(texts))
    for i, (t, behind_row) in enumerate(zip(targets.ravel(), row[inputs.ravel()])):
        if t >= 0:
            want[s.owner[i // lm.STEP]] += logp[i, cls[t]] + behind.log(np.array([t]), np.array([behind_row]))[0]
    assert np.allclose(got, want / math.log(10), rtol=1e-4, atol=1e-3)


def test_stream_holds_every_subword_once(sub):
    import pyarrow as pa

    texts = ["", "one", None, "Some words and MORE words " * 30, "end"]
    words = words_of(pa.array(texts))
    keys, where, inverse = lm.distinct(words)
    ids, begin = sub.cut(*lm.spelled(words, where))
    s = lm.stream_of(words, inverse, ids, begin, sub.end)
    for i, text in enumerate(texts):
        mine = np.repeat(s.owner, lm.STEP) == i
        want = [t for w in (text or "").lower().split() for t in sub.encoding.encode_ordinary(" " + w)] + [sub.end]
        assert s.targets[mine][s.targets[mine] >= 0].tolist() == want
        assert s.inputs[mine][: len(want)].tolist() == [sub.end, *want[:-1]]


def check(rows, got):
    tokens = [[*SPACE.findall((r[1] or "").translate(LOWER)), None] for r in rows]
    fold = [zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 5 == 1 for r in rows]
    c = collections.Counter(t for ts, held in zip(tokens, fold) if not held for t in ts)
    n, v = sum(c.values()), len(c)
    want = sorted(
        (r[0] or 0, held, len(ts), sum(c[t] > 0 for t in ts), round(sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts), 6))
        for r, ts, held in zip(rows, tokens, fold)
    )
    assert sorted((r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)


@pytest.mark.parametrize("frequent", [1_000_000, 20])
def test_base_equals_brute_force(spark, frequent, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    rows = edge_rows() + [(30 + i, f"word{i % 7} the the of word{i}", "en", "a", 1) for i in range(40)]
    got = lm.score(documents(spark, rows, clashing=True)).collect()
    check(rows, got)
    same = {}
    for r, row in ((r, next(x for x in rows if x[0] == r["doc_id"])) for r in got):
        same.setdefault((row[1] or "").lower(), set()).add(round(r["score"], 4))
    assert all(len(s) == 1 for s in same.values())
    # other columns, whatever they are called, change nothing
    plain = lm.score(documents(spark, rows)).collect()
    key = lambda rows: sorted((r["doc_id"] or 0, r["n_known"], round(r["base_score"], 6), round(r["score"], 3)) for r in rows)
    assert key(plain) == key(got)


def test_windows_of_all_texts_are_learnt_from(spark, sub):
    import pyarrow as pa

    texts = [f"{i} some words of text {i} and more of them " * 9 for i in range(30)] + ["the same text again and again " * 9] * 100 + ["", None]
    words = words_of(pa.array(texts))
    keys, where, inverse = lm.distinct(words)
    ids, begin = sub.cut(*lm.spelled(words, where))
    s = lm.stream_of(words, inverse, ids, begin, sub.end)
    inputs, targets = s.inputs.reshape(-1, lm.STEP), s.targets.reshape(-1, lm.STEP)
    want = collections.Counter(
        (*([sub.end] * lm.STEP if s.begins[i] else inputs[i - 1]), *inputs[i], *targets[i], int(s.begins[i])) for i in range(len(inputs))
    )
    with open(lm.TOKENIZER, "rb") as f:
        shares = lm.dealt(documents(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)]), f.read(), 3).collect()
    got = collections.Counter()
    for r in shares:
        got[tuple(lm.unpacked([bytes(r["payload"])], sub.end)[0].tolist())] += r["n"]
    assert got == want and max(r["n"] for r in shares) <= lm.SHARE < max(want.values())
    assert len(shares) == sum(-(-n // lm.SHARE) for n in want.values())


def test_counts_weigh_like_copies():
    p, emb, cls, row, inputs, targets, begins = small()
    twice = [0, 0, 1, 2]
    g, loss = lm.gradients(p, emb, cls, row, inputs[twice], targets[twice], begins[twice])
    h, merged = lm.gradients(p, emb, cls, row, inputs, targets, begins, np.array([2.0, 1, 1]))
    share = (targets >= 0).sum() / (targets[twice] >= 0).sum()
    assert np.isclose(loss, merged * share) and all(np.allclose(g[k], h[k] * share, atol=1e-6) for k in g)


def test_empty_table(spark):
    assert lm.score(documents(spark, [])).count() == 0


def test_learns_from_context(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [r for r in lm.score(docs).collect() if r["held_out"]]
    tokens = sum(r["n_tokens"] for r in held)
    # far better than subwords on their own (5.9 digits a word)
    assert sum(r["score"] for r in held) / tokens > -4.7
