import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from fixtures_llm import documents, edge_rows

from quire.llm import line_quality, toxicity
from quire.llm.common import ALNUM, words_of
from quire.llm.labels import logistic

LABELS = "doc_id long, quality int, toxic int"


def distance(a, b):
    """Edits from ``a`` to ``b``; two neighbouring letters exchanged are one, and stay as they are."""
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_equals_edit_distance():
    rng = random.Random(6)
    letters = "abcé"
    terms = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(5, 9))) for _ in range(40)})
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 10))) for _ in range(3_000)]
    words += ["".join(c for i, c in enumerate(t) if i != k) for t in terms for k in (0, 2, len(t) - 1)]
    words += [t[:k] + "x" + t[k + j :] for t in terms for k in (0, 3, len(t)) for j in (0, 1)]
    words += [t[: k - 1] + t[k] + t[k - 1] + t[k + 1 :] for t in terms for k in range(1, len(t))]
    trie = toxicity.Trie(terms)
    lexicon = toxicity.Lexicon({t: 1.0 for t in terms}, {}, 0.4)
    found = words_of(pa.array([" ".join(words)]), ALNUM)
    near = set(lexicon.variants(found, np.arange(len(words))).values())
    for w in words:
        best = min((distance(w, t), t) for t in terms)
        assert trie.near(w, 1) == (best[1] if best[0] <= 1 else None)
        assert (w in near) == (toxicity.edits(len(w)) > 0 and best[0] == 1), w


def test_edits_go_by_the_length_of_the_term():
    lexicon = toxicity.Lexicon({"idiot": 4.0, "scum": 4.0}, {}, 1.0)
    x = toxicity.features(lexicon, words_of(pa.array(["an idot here", "an idiots here", "idt", "scam scums", "scum"]), ALNUM))
    assert x[:, 0].tolist() == [1.0, 1.0, 0.0, 0.0, 4.0]


def test_rare_terms_are_learnt_however_many_labels(spark):
    # 1,500 families of toxic texts; six of them hold a term that the others do not
    own = lambda i: " ".join(f"x{i}y{j}" for j in range(6))
    toxic = [(f"{own(i)} {'rarely' if i < 6 else 'often'} even", 1) for i in range(1_500)]
    clean = [(f"{own(i)} even {'once' if i % 2 else 'twice'}", 0) for i in range(1_500, 4_500)]
    terms = toxicity.learn_lexicon(toxicity.sampled(spark.createDataFrame(toxic + clean, "text string, label int"))).weights
    assert set(terms) == {"rarely", "often"}


def test_context_lowers_quotation_and_raises_address():
    lexicon = toxicity.Lexicon({"idiot": 4.0, "moron": 4.0}, {}, 1.0)
    texts = ["he said \"idiot\" there", "the idiot there", "you idiot there", "you idiot moron there", "the idoit there", "the idiiot there", "", None, "nothing"]
    x = toxicity.features(lexicon, words_of(pa.array(texts), ALNUM))
    assert x[0, 4] < x[1, 4] < x[2, 4] < x[3, 4]
    assert x[5, 5] > 0 and x[5, 0] == 1.0 and not x[6:].any()


def test_typographic_signs_end_words():
    lexicon = toxicity.Lexicon({"idiot": 4.0}, {}, 1.0)
    texts = ["he meant “idiot” there", "il dit «idiot» et", "er ist „idiot“ hier", "an idiot—there", "the idoit… here", "¡idiot!", None, "x\u00a0idiot"]
    x = toxicity.features(lexicon, words_of(toxicity.cleaned(pa.array(texts)), ALNUM))
    assert x[:, 0].tolist() == [4.0, 4.0, 4.0, 4.0, 1.0, 4.0, 0.0, 4.0]
    assert x[:, 6].tolist() == [4.0, 4.0, 4.0, 0.0, 0.0, 0.0, 0.0, 0.0]


def test_copies_count_once(spark):
    own = lambda i: " ".join(f"x{i}y{j}" for j in range(6))
    rows = [(f"{own(1)} copied", 1)] * 50 + [(f"{own(i)} told", 1) for i in range(10, 40)] + [(own(i), 0) for i in range(100, 200)]
    terms = toxicity.learn_lexicon(toxicity.sampled(spark.createDataFrame(rows, "text string, label int").repartition(4))).weights
    assert set(terms) == {"told"}


def test_logistic_separates():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 2))
    y = (x[:, 0] - 0.5 * x[:, 1] > 0.3).astype(float)
    w, mean, scale = logistic(x, y)
    assert (((x - mean) / scale @ w[:-1] + w[-1] > 0) == (y > 0)).mean() > 0.97


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    first = np.array([0, 3, 3, 4, 9])
    node, step = rng.standard_normal(9), rng.standard_normal((2, 2))
    good, pairs, total = line_quality.forward_backward(node, step, first)
    want_pairs = np.zeros((2, 2))
    for a, b in zip(first[:-1], first[1:]):
        if a == b:
            continue
        mass, each, both = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in itertools.product([0, 1], repeat=b - a):
            p = np.exp(sum(node[a + i] for i in range(b - a) if y[i]) + sum(step[u, v] for u, v in zip(y, y[1:])))
            mass += p
            each += p * np.array(y)
            for u, v in zip(y, y[1:]):
                both[u, v] += p
        assert np.allclose(good[a:b], each / mass)
        want_pairs += both / mass
    assert np.allclose(pairs, want_pairs)


def test_lines_do_not_depend_on_the_batch():
    texts = ["one two\n\n  \nthree", None, "", "x", "same line\nsame line\nother", "A B C!\n| d |", "\n", "three three three"]
    together = line_quality.Lines(pa.array(texts))
    x = together.described()
    for i, t in enumerate(texts):
        alone = line_quality.Lines(pa.array([t], pa.string()))
        a, b = together.first[i], together.first[i + 1]
        assert b - a == sum(bool(s.strip()) for s in (t or "").split("\n"))
        assert np.allclose(x[a:b], alone.described())


def labelled(spark, rows):
    return spark.createDataFrame(rows, LABELS)


@pytest.mark.parametrize("module", [toxicity, line_quality])
def test_edges(spark, module):
    docs = documents(spark, clashing=True)
    some = labelled(spark, [(5, 1, 0), (6, 1, 0), (7, 1, 0), (7, 1, 1), (8, 1, None), (10, 0, 1), (None, 1, 1), (4, None, 0), (99, 0, 1)])
    for labels in (some, some.limit(0)):
        got = module.score(docs, labels).collect()
        assert sorted(r["doc_id"] or 0 for r in got) == sorted(r[0] or 0 for r in edge_rows())
        assert all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["doc_id"] == 7}) == 1
        # other columns, whatever they are called, change nothing
        plain = module.score(documents(spark), labels).collect()
        assert sorted((r["doc_id"] or 0, r["score"]) for r in plain) == sorted((r["doc_id"] or 0, r["score"]) for r in got)
    assert module.score(documents(spark, []), some).count() == 0


@pytest.mark.parametrize("module,label,least", [(toxicity, "toxic", 0.97), (line_quality, "quality", 0.98)])
def test_held_out_accuracy(spark, module, label, least):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = module.score(spark.read.parquet(f"{sf}/documents.parquet"), labels).filter("held_out").join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r[label] for r in got) / len(got) >= least


def test_long_texts_are_learnt_in_blocks(spark, monkeypatch):
    """A labelled text of many lines counts like its blocks do, and the bound on lines draws among blocks."""
    good, bad = "A clear line of plain words, told in order.\n", "BUY $$$ now!!! ### click\n"
    rows = [(good * 5_000, 1), (bad * 5_000, 0), ("", 1), (None, 0)]
    model = line_quality.learn(spark.createDataFrame(rows, "text string, label int"))
    scores = line_quality.text_scores(model, pa.array([good * 4, bad * 4, good * 3_000]))
    assert scores[0] > 0.9 and scores[1] < 0.1 and scores[2] > 0.9
    few = line_quality.learn(spark.createDataFrame([(good * (i + 1), 1) for i in range(60)] + [(bad * (i + 1), 0) for i in range(60)], "text string, label int"), 1_500)
    assert line_quality.text_scores(few, pa.array([good * 4]))[0] > line_quality.text_scores(few, pa.array([bad * 4]))[0]
