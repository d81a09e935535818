import itertools
import math
from collections import Counter

from pyspark.sql import functions as F

from quire.llm import url_filter


def cases():
    urls = [
        None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?q#f", "http://example.com/en/1", "https://m.example.com/en/2.html", "http://a.com", "http://a.com/",
        "http://x.com?y=/en/", "http://xcom/", "http://b.net/es/1", "http://b.net/fr/", "http://b.net/en/12", "http://net/es/", "http://c.org/de/12345#t", "http://é.org/ü/1",
        "ftp://u:p@h.net:80/fr/a://b/", "http://goodshop.net/en/1", "http://badcasino.org/es/777", "http://badcasino.net/es/777", "http://badshop.org/es/1",
    ]
    return [(i, u, "<p>good shop bad casino good bad</p>", 1) for i, u in enumerate(urls)] + [(5, urls[5], None, 1), (None, urls[20], "", 1)]


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    fits = [
        (len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fits)[1:] if fits else (None, None)


def test_rules_and_parts(spark):
    rows = cases()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n int").withColumn("verdict", F.lit("x")).withColumn("host_", F.lit("y"))
    got = url_filter.judge(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path = parse(r["url"])
        rule, verdict = rule_of(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), r["url"]
        assert r["verdict"] == (verdict or ("block" if r["block_score"] > 0 else "allow")) and r["host_"] == "y"
    score = {r["url"]: r["block_score"] for r in got}
    assert score["http://badcasino.org/es/777"] > score["http://c.org/de/12345#t"]


def test_scores_equal_brute_force(spark):
    rows = cases()
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string, n int")).collect()
    counts = Counter()
    for _, _, html, _ in rows:
        counts.update("good shop bad casino good bad".split() if html else [])
    total = sum(counts.values())
    import re

    def tokens(host, path):
        out = []
        for label in host.split("."):
            for run in re.findall("[a-z]+|[^a-z]+", label):
                if run[0].isascii() and run.isalpha():
                    words = {(a, b): math.log(counts[run[a:b]] / total) for a in range(len(run)) for b in range(a + 1, len(run) + 1) if counts[run[a:b]]}
                    out += [f"h:{w}" for w in url_filter.viterbi(run, words, -math.log(total) - 3.0)]
                else:
                    out.append(f"h:{run}")
        return out, [f"p:{t}" for t in re.split(r"[\W_]+", path.lower()) if t]

    seen = {"block": Counter(), "allow": Counter()}
    urls = Counter()
    for _, url, _, _ in rows:
        host, path = parse(url)
        verdict = rule_of(host, path)[1]
        if verdict:
            a, b = tokens(host, path)
            seen[verdict].update(a + b)
            urls[verdict] += 1
    vocabulary = set(seen["block"]) | set(seen["allow"])
    size = {k: sum(c.values()) + len(vocabulary) + 1 for k, c in seen.items()}
    for r in got:
        a, b = tokens(r["host"], r["path"])
        want = math.log((urls["block"] + 1) / (urls["allow"] + 1))
        for t in a + b:
            if t in vocabulary:
                want += math.log((seen["block"][t] + 1) / size["block"]) - math.log((seen["allow"][t] + 1) / size["allow"])
        assert abs(want - r["block_score"]) < 1e-6, r["url"]


def test_numbers_and_letters_are_told_apart(spark):
    got = spark.createDataFrame([("/4chan/mp3/18Plus-über.html",)], "p string").select(url_filter.path_tokens(F.col("p")).alias("t")).first()["t"]
    assert got == ["p:4chan", "p:mp3", "p:18plus", "p:über", "p:html"]
    html = spark.createDataFrame([("<b>für</b> Straße the <i>the</i> " + "x" * 40 + " a1b",), (None,)], "html string")
    assert {r["word"]: r["count"] for r in url_filter.word_counts(html, "html").collect()} == {"the": 2, "x" * 40: 1, "a": 1, "b": 1}
    long = "shop" * 100
    rows = [(1, f"http://{long}.net/es/1", "<p>shop</p>"), (2, f"http://{long}.org/", "shop")]
    scored = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(scored) == 2 and all(r["host"].startswith(long) for r in scored)


def test_viterbi_is_the_best_split():
    words = {"th": 5, "the": 9, "er": 4, "there": 2, "in": 3, "rein": 1, "ing": 2}
    total = sum(words.values())
    for label in ("therein", "thering", "xxing", "theq", "q"):
        known = {(a, b): math.log(words[label[a:b]] / total) for a in range(len(label)) for b in range(a + 1, len(label) + 1) if label[a:b] in words}
        best = -math.inf
        for cut in itertools.product([0, 1], repeat=len(label) - 1):
            ends = [i + 1 for i, c in enumerate(cut) if c] + [len(label)]
            value = 0.0
            for a, b in zip([0, *ends], ends):
                value += known.get((a, b), -9.0 if b - a == 1 else -math.inf)
            best = max(best, value)
        split = url_filter.viterbi(label, known, -9.0)
        at, mine = 0, 0.0
        for w in split:
            mine += known.get((at, at + len(w)), -9.0 * len(w))
            at += len(w)
        assert "".join(split) == label and abs(mine - best) < 1e-9


def test_empty(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
