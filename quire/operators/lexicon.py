"""Vocabulary jobs: token counts, the lexicon and per-text quality. Text is reduced map-side before any shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.functions import syllable as sy
from quire.functions.text import col, let


def token_counts(sections: DataFrame, *columns: str) -> DataFrame:
    """(token, n) over the given text columns, lowercased. Partial counts leave each task, not tokens."""
    texts = F.concat(*[sy.tokens(F.coalesce(col(c), F.lit(""))) for c in columns])
    return sections.select(F.explode(texts).alias("token")).groupBy(F.lower("token").alias("token")).agg(F.count(F.lit(1)).alias("n"))


def lexicon_of(counts: DataFrame, min_count: int = 2) -> DataFrame:
    """(syllable): tokens seen ``min_count`` times that are valid syllables."""
    # the one-element explode keeps the verdict above the count: pushed below, it would be passed on every token of the texts
    often = counts.filter(F.col("n") >= min_count)
    return often.select("token", F.explode(F.array(sy.is_valid("token"))).alias("_valid")).filter("_valid").select(F.col("token").alias("syllable"))


def verdicts(tokens: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """Per distinct token whether it is valid, suspicious, has a doubled vowel and, with a lexicon, is real."""
    out = tokens.select("token").distinct().select(
        "token", sy.is_valid("token").alias("valid"), sy.is_suspicious("token").alias("suspicious"),
        sy.has_doubled_vowel("token").alias("doubled"),
    )
    if lexicon is None:
        return out.withColumn("real", F.col("valid"))
    known = lexicon.select(F.col("syllable").alias("_low"), F.lit(True).alias("_known"))
    out = out.withColumn("_low", F.lower("token")).join(known, "_low", "left")
    return out.withColumn("real", F.col("valid") & F.col("_known").isNotNull()).drop("_low", "_known")


def quality(sections: DataFrame, key: list[str], text: str = "content") -> DataFrame:
    """A10: per text total and damaged words, their ratio and the damaged words in order. One projection, no shuffle.

    The one-element explode keeps a later filter from being pushed below and judging every word again.
    """

    def judged(found):
        return F.struct(F.size(found).alias("total"), F.filter(found, sy.is_damaged).alias("words"))

    rows = sections.select(*key, F.explode(F.array(let(sy.tokens(text), judged))).alias("_q"))
    total, words = F.col("_q.total"), F.col("_q.words")
    return rows.select(
        *key, total.alias("total"), F.size(words).alias("invalid"),
        F.when(total == 0, F.lit(0.0)).otherwise(F.size(words) / total).alias("ratio"), words.alias("words"),
    )
