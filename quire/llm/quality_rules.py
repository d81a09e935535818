"""Quality rules: a table of thresholds compiled into one projection of counts and ratios, without user functions.

Each rule compares 100 times a count with a percentage of another count (or with a plain number), in whole numbers, so
nothing depends on rounding. A document is kept when no rule fails.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import fresh, let, split_words

#: Frequent function words of English, German, French and Spanish (plain values).
STOP_WORDS = """the of and to in a is that it for on was be with as by this are from or an at not
der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch
de la le et les des en un du une que est pour qui dans sur pas par au avec
el y los las del se por con para su lo como más""".split()


@dataclass(frozen=True)
class Rule:
    """Fails when ``measure`` is under ``low`` or over ``high`` per cent of ``per`` (or, without ``per``, as a number);
    looked at only where ``per`` is at least ``least``."""

    name: str
    measure: str
    per: str | None
    low: int | None = None
    high: int | None = None
    least: int = 0


BASE = (Rule("few_words", "n_words", None, low=10), Rule("repeats", "n_repeat_words", "n_words", high=20))
RULES = (
    *BASE,
    Rule("word_length", "word_chars", "n_words", low=150, high=3000),
    Rule("symbols", "n_symbols", "n_words", high=10),
    Rule("exclamations", "n_exclaims", "n_words", high=10),
    Rule("capitals", "n_capitals", "n_words", high=50),
    Rule("adjacent", "n_adjacent", "n_words", high=20),
    Rule("dup_lines", "n_dup_lines", "n_lines", high=40),
    Rule("stop_words", "n_stop_words", "n_words", low=2, least=100),
)
MEASURES = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words n_exclaims n_capitals n_adjacent n_stop_words n_lines".split()
)


def _repeat_words(words: Column) -> Column:
    """Words in five-word windows that the text holds more than once."""
    n = F.size(words)

    def covered(runs: Column) -> Column:
        # (hash, place), sorted: places of windows that have an equal neighbour, then the words these windows cover
        equal = F.filter(
            runs, lambda x, i: F.coalesce(F.get(runs, i - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(runs, i + 1)["h"] == x["h"], F.lit(False))
        )
        places = F.sort_array(F.transform(equal, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("c"), F.lit(-5).alias("last"))
        return F.aggregate(
            places, start, lambda a, i: F.struct((a["c"] + F.least(F.lit(5), i - a["last"])).alias("c"), i.alias("last")),
            lambda a: a["c"],
        )

    def of(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(ordered, covered))

    def windows(hashes: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(5)])
        )

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(n < 5, F.lit(0)).otherwise(let(let(hashed, windows), of))


def _count(values: Column, test) -> Column:
    return F.size(F.filter(values, test))


def measures(words: Column, text: Column) -> dict[str, Column]:
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike("[^\\x20\\x09-\\x0D]"))
    both = let(lines, lambda s: F.struct(F.size(s).alias("n"), F.size(F.array_distinct(s)).alias("d")))
    return {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")),
        "n_repeat_words": _repeat_words(words),
        "n_exclaims": F.regexp_count(text, F.lit("!")),
        "n_capitals": _count(words, lambda w: (F.upper(w) == w) & (F.lower(w) != w)),
        "n_adjacent": _count(words, lambda w, i: F.coalesce(F.get(words, i - 1) == w, F.lit(False))),
        "n_stop_words": _count(words, lambda w: F.lower(w).isin(STOP_WORDS)),
        "lines": both,
    }


def _fails(rule: Rule, value) -> Column:
    measure = value(rule.measure).cast("long") * (100 if rule.per else 1)
    per = value(rule.per).cast("long") if rule.per else F.lit(1).cast("long")
    tests = []
    if rule.low is not None:
        tests.append(measure < per * rule.low)
    if rule.high is not None:
        tests.append(measure > per * rule.high)
    failed = tests[0] if len(tests) == 1 else tests[0] | tests[1]
    return failed & (per >= rule.least) if rule.least else failed


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", out: str = "quality") -> DataFrame:
    """``docs`` with a struct column ``out``: the measures (long), ``base_failed``, ``failed`` (names of all failed rules)
    and ``kept``.

    No shuffle and no user function; rows are judged one by one, so copies, ties and repeated ids agree and an empty table
    stays empty. Null and empty texts have no words and fail ``few_words``. A column named like ``out`` is replaced; other
    columns, whatever their names, pass through.
    """
    rest = [c for c in docs.columns if c != out]
    w, m = fresh(docs, "w", "m")
    raw = F.coalesce(F.col(text), F.lit(""))
    counted = docs.select(*[F.col(f"`{c}`") for c in rest], split_words(F.col(text)).alias(w))
    # as a generator's result: a filter on the verdict must not take the measures apart and compute them once for every rule
    counted = counted.select(
        *[F.col(f"`{c}`") for c in rest],
        F.explode(F.array(F.struct(*[c.alias(k) for k, c in measures(F.col(w), raw).items()]))).alias(m),
    )

    def value(name: str) -> Column:
        lines = F.col(m)["lines"]
        if name == "n_lines":
            return lines["n"]
        return lines["n"] - lines["d"] if name == "n_dup_lines" else F.col(m)[name]

    failed = F.filter(
        F.array(*[F.when(_fails(r, value), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull()
    )
    base = F.lit(False)
    for r in BASE:
        base = base | _fails(r, value)
    fields = [value(k).cast("long").alias(k) for k in MEASURES]
    return counted.select(
        *[F.col(f"`{c}`") for c in rest],
        F.struct(*fields, base.alias("base_failed"), failed.alias("failed"), (~base & (F.size(failed) == 0)).alias("kept")).alias(out),
    )


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows that no rule rejects, with the columns they came with."""
    (verdict,) = fresh(docs, "verdict")
    return judge(docs, rules, text, verdict).filter(F.col(verdict)["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])
