"""URL filters: allow and block rules first, then words in the name.

Host labels are concatenated words. A unigram model (word counts of the pages' texts) splits them by Viterbi's algorithm, and a
multinomial naive Bayes model scores the tokens of host and path. The model learns from the urls that a rule decides.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import checked_broadcast, fresh, stored

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
)
#: Letters of a label that are split together. DNS labels have at most 63; a longer run than this is split in blocks.
BLOCK = 253
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; empty for null and where there is no ``://``."""
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    value = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(value, pattern, 1), UPPER, LOWER), F.regexp_extract(value, pattern, 2)


def path_tokens(path: Column) -> Column:
    """The runs of letters and digits of a path, as they are but for their case."""
    return F.transform(F.array_remove(F.split(F.lower(path), "[^\\p{L}\\p{N}]+"), ""), lambda t: F.concat(F.lit("p:"), t))


def word_counts(html: DataFrame, column: str) -> DataFrame:
    """How often each word of ASCII letters occurs in the texts of ``html``; a word with any other letter is none."""
    text = F.regexp_replace(F.lower(F.coalesce(F.col(column), F.lit(""))), "<[^>]*>", " ")
    words = html.select(F.explode(F.regexp_extract_all(text, F.lit(r"(?<!\p{L})[a-z]++(?!\p{L})"), F.lit(0))).alias("word"))
    return words.groupBy("word").count()


def viterbi(label: str, words: dict[tuple[int, int], float], unknown: float) -> list[str]:
    """The split with the highest probability; a letter outside any word costs ``unknown``. Ties go to the longer last word."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(label) + 1):
        options = [(best[end - 1][0] + unknown, -(end - 1))]
        options += [
            (best[begin][0] + words[begin, end], -begin)
            for begin in range(end) if (begin, end) in words
        ]
        score, begin = max(options)
        best.append((score, -begin))
    out: list[str] = []
    end = len(label)
    known: list[bool] = []
    while end:
        begin = best[end][1]
        hit = (begin, end) in words
        if not hit and known and not known[-1]:
            out[-1] = label[begin:end] + out[-1]  # neighbouring unknown letters form one token
        else:
            out.append(label[begin:end])
            known.append(hit)
        end = begin
    return out[::-1]


def segment(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """(label, words): distinct host labels split by the unigram model. Only counts of strings inside a label are looked up."""
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")).first()["n"]
    n = F.length("label")
    begins = labels.select("label", F.explode(F.sequence(F.lit(1), n)).alias("begin"))
    ends = begins.select("label", "begin", F.explode(F.sequence(F.col("begin"), n)).alias("end"))
    spans = ends.select("label", "begin", "end", F.expr("substring(label, begin, end - begin + 1)").alias("word"))
    known = spans.join(counts, "word").groupBy("label").agg(F.collect_list(F.struct("begin", "end", "count")).alias("found"))
    unknown = -math.log(max(total, 1)) - 3.0

    @F.pandas_udf("array<string>")
    def split(label: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for text, spans in zip(label, found):
            words = {} if spans is None else {(s["begin"] - 1, s["end"]): math.log(s["count"] / total) for s in spans}
            out.append(viterbi(text, words, unknown))
        return pd.Series(out)

    return labels.join(known, "label", "left").select("label", split("label", "found").alias("words"))


def host_tokens(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, token): one row per token of each distinct host."""
    labels = hosts.select("host", F.posexplode(F.array_remove(F.split("host", "\\."), "")).alias("at", "label"))
    # digits and other signs cut a label; they form tokens of their own
    runs = labels.select("host", "at", F.posexplode(F.regexp_extract_all("label", F.lit(f"[a-z]{{1,{BLOCK}}}|[^a-z]+"), F.lit(0))).alias("run", "label"))
    is_name = F.col("label").rlike("^[a-z]")
    named, other = runs.filter(is_name), runs.filter(~is_name).select("host", F.col("label").alias("token"))
    words = segment(named.select("label").distinct(), counts)
    split = named.join(words, "label").select("host", F.explode("words").alias("token"))
    return split.unionByName(other).select("host", F.concat(F.lit("h:"), "token").alias("token"))


def fitting(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): the rules whose host is the host or one of its parent domains, longest first."""
    names = F.split("host", "\\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, i, F.size(names)), "."))
    asked = hosts.select("host", F.explode(suffix).alias("rule_host"))
    got = asked.join(rules, "rule_host").groupBy("host").agg(
        F.sort_array(F.collect_list(F.struct((-F.length("rule")).alias("n"), "rule", "rule_path", "rule_verdict"))).alias("rules")
    )
    return hosts.join(got, "host", "left")


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url", html: str = "html", smoothing: float = 1.0,
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (like ``net/``; null if none fits), ``block_score`` (log odds for block) and ``verdict``.

    A rule fits its host and all subdomains where the path starts with the rule's; the longest rule wins, ties by code point. Urls
    without a rule are blocked when their log odds are above 0. Null urls, and those without ``://``, have an empty host and path, fit no rule
    and are judged by the prior alone. Copies agree; an empty table stays empty; columns named like the new ones are replaced, the html is only
    counted. Scores are kept per distinct host and per distinct path (A-Z and other letters in lower case), so a host with a third of all pages
    is scored once; the join of its pages with that one row is split by the adaptive planner, or broadcast where the table of hosts is small.
    """
    spark = pages.sparkSession
    new = ("host", "path", "rule", "block_score", "verdict")
    rest = [c for c in pages.columns if c.lower() not in new]
    h, p, s, hk, hv, sk, sw = fresh(pages, "host_", "path_", "low_path_", "host_key", "host_got", "path_key", "path_got")
    host, path = parts(F.col(url))
    rows = pages.select(*[F.col(f"`{c}`") for c in rest], host.alias(h), path.alias(p)).withColumn(s, F.lower(p))
    table = spark.createDataFrame(
        [(a, b, v, a + b) for a, b, v in rules], "rule_host string, rule_path string, rule_verdict string, rule string"
    )
    seen = stored(rows.groupBy(F.col(h).alias("host"), F.col(s).alias("low"), F.substring(F.col(p), 1, 64).alias("start")).count())
    hosts = fitting(seen.select("host").distinct(), table)
    # counted once: the segmentation needs the total and the counts of strings inside labels
    counts = stored(word_counts(pages, html))
    tokens = stored(host_tokens(seen.select("host").distinct(), counts))

    longest = max([len(b) for _, b, _ in rules] or [0])
    if longest > 64:
        raise ValueError("rule paths have at most 64 characters")

    def first_rule(path: Column) -> Column:
        fits = F.filter(F.col("rules"), lambda r: F.startswith(path, r["rule_path"]))
        return F.get(fits, F.lit(0))

    hosts = stored(hosts)
    labelled = seen.join(hosts, "host").withColumn("verdict", first_rule(F.col("start"))["rule_verdict"]).filter("verdict IS NOT NULL")
    per_host = labelled.groupBy("host", "verdict").agg(F.sum("count").alias("n"))
    per_path = labelled.groupBy("low", "verdict").agg(F.sum("count").alias("n"))
    learnt = per_host.join(tokens, "host").select("token", "verdict", "n").unionByName(
        per_path.select(F.explode(path_tokens(F.col("low"))).alias("token"), "verdict", "n")
    )
    n = lambda v: F.coalesce(F.sum(F.when(F.col("verdict") == v, F.col("n"))), F.lit(0))
    learnt = stored(learnt.groupBy("token").agg(n("block").alias("block"), n("allow").alias("allow")))
    sums = learnt.agg(F.count("*").alias("v"), F.coalesce(F.sum("block"), F.lit(0)).alias("b"), F.coalesce(F.sum("allow"), F.lit(0)).alias("a")).first()
    urls = per_host.groupBy().agg(n("block").alias("b"), n("allow").alias("a")).first()
    prior = math.log((urls["b"] + smoothing) / (urls["a"] + smoothing))
    scale = math.log((sums["a"] + smoothing * (sums["v"] + 1)) / (sums["b"] + smoothing * (sums["v"] + 1)))
    weights = checked_broadcast(learnt).select("token", (F.log((F.col("block") + smoothing) / (F.col("allow") + smoothing)) + scale).alias("w"))

    def scored(asked: DataFrame, key: str) -> DataFrame:
        # tokens that many names share are looked up on both sides of the adaptive planner's splits, or broadcast where they are few
        return asked.join(weights, "token").groupBy(key).agg(F.sum("w").alias("w"))

    by_host = hosts.join(scored(tokens, "host"), "host", "left").select(
        F.col("host").alias(hk), F.struct("rules", F.coalesce("w", F.lit(0.0)).alias("w")).alias(hv)
    )
    paths = seen.select("low").distinct()
    by_path = scored(paths.select("low", F.explode(path_tokens(F.col("low"))).alias("token")), "low").select(
        F.col("low").alias(sk), F.col("w").alias(sw)
    )
    by_host, by_path = checked_broadcast(stored(by_host)), checked_broadcast(stored(by_path))
    joined = rows.join(by_host, F.col(h) == F.col(hk), "left").join(by_path, F.col(s) == F.col(sk), "left")
    rule = F.get(F.filter(F.col(hv)["rules"], lambda r: F.startswith(F.col(p), r["rule_path"])), F.lit(0))
    score = F.round(F.lit(prior) + F.coalesce(F.col(hv)["w"], F.lit(0.0)) + F.coalesce(F.col(sw), F.lit(0.0)), 9)
    return joined.select(
        *[F.col(f"`{c}`") for c in rest], F.col(h).alias("host"), F.col(p).alias("path"), rule["rule"].alias("rule"), score.alias("block_score"),
        F.coalesce(rule["rule_verdict"], F.when(score > 0, "block").otherwise("allow")).alias("verdict"),
    )
