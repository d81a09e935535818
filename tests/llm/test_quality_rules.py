from fixtures_llm import CLASHES, SPACE, documents, edge_rows

from quire.llm import quality_rules


def brute(text):
    text = text or ""
    words = SPACE.findall(text)
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {p for i, r in enumerate(runs) if runs.count(r) > 1 for p in range(i, i + 5)} if len(runs) < 2_000 else set()
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_exclaims": text.count("!"), "n_lines": len(lines),
        "n_adjacent": sum(a == b for a, b in zip(words, words[1:])),
    }


def test_measures(spark):
    extra = [
        (20, "x y z a b x y z a b x y z a b", "en", "a", 1), (21, "same same same same", "en", "a", 1), (22, "<a>|b|# $5 100%!!", "en", "a", 1),
        (23, "one two three four five six one two three four five", "en", "a", 1), (24, "l1 a\nl1 a\n\nl2\nl1 a", "en", "a", 1),
    ]
    got = quality_rules.judge(documents(spark, edge_rows() + extra)).collect()
    assert len(got) == len(edge_rows() + extra)
    for r in got:
        want = brute(r["text"])
        assert {k: r["quality"][k] for k in want} == want, r["doc_id"]
        q = r["quality"]
        assert q["base_failed"] == (q["n_words"] < 10 or 100 * q["n_repeat_words"] > 20 * q["n_words"])
        assert q["kept"] == (not q["failed"]) and not (q["base_failed"] and q["kept"])


def test_rejects_junk_and_keeps_prose(spark):
    good = "The men of the house and the sea were on the way to the old town, and it was late in the year."
    rows = [
        (1, good, "en", "a", 1), (2, good.upper().replace(" ", "!! "), "en", "a", 1), (3, good.replace(" ", "*** "), "en", "a", 1),
        (4, "a b c\n" * 20, "en", "a", 1), (5, " ".join(w for w in good.split() for _ in range(3)), "en", "a", 1), (6, "short", "en", "a", 1),
    ]
    kept = quality_rules.keep_good(documents(spark, rows)).collect()
    assert [r["doc_id"] for r in kept] == [1]


def test_names_and_empty_table(spark):
    docs = documents(spark, clashing=True)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and set(CLASHES.split()) <= set(kept.columns)
    assert [r["w"] for r in kept.limit(1).collect()] == [CLASHES.split().index("w")]
    assert quality_rules.judge(documents(spark, [])).count() == 0
