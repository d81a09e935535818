"""Tiered repair of damaged words.

The tiers work on the distinct damaged words of the corpus, not on texts: each tier takes the words the one before it
could not repair. The resulting fixes are applied in one pass over the texts that hold a damaged word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quire.functions import syllable as sy
from quire.operators.sequence import top_by_margin
from quire.session import checkpoint


def marked_words(sections: DataFrame, key: list[str], text: str = "content") -> DataFrame:
    """(key, words): the distinct damaged words of each text that has any."""
    found = F.filter(F.array_distinct(sy.marked_tokens(text)), sy.is_damaged)
    # exploding a one-element array keeps the filter from judging the words a second time
    return sections.select(*key, F.explode(F.array(found)).alias("words")).filter(F.size("words") > 0)


def damaged_words(sections: DataFrame, text: str = "content") -> DataFrame:
    """Distinct damaged words (bad). Tokens are made distinct per text before they leave the row, and a word is judged once for all texts."""
    words = sections.select(F.explode(F.array_distinct(sy.marked_tokens(text))).alias("bad")).distinct()
    # out of a one-element explode, so that no filter on it, here or later, is pushed below and judges every occurrence
    return words.select(F.explode(F.array(F.when(sy.is_damaged("bad"), F.col("bad")))).alias("bad")).filter("bad is not null")


def _spread_words(words: DataFrame) -> DataFrame:
    """Words over all slots: judging one costs far more than its bytes suggest, so sizes alone would gather them."""
    spark = words.sparkSession
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return words.repartition(slots, "bad")


def collapse_fixes(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """C5, tier 1: (bad, good).

    The first valid collapse candidate wins. Else deleting one of two neighbouring vowels is accepted when exactly one
    result stands in the lexicon or, if none does, exactly one is valid.
    """
    # each step in a projection of its own, so that a candidate is made and judged once; one pass for both kinds
    rows = words.select("bad", F.lower("bad").alias("_low"))
    names = [f"_c{i}" for i in range(7)]
    made = F.struct(*[c.alias(n) for c, n in zip(sy.collapse_candidates(F.col("_low")), names)])
    rows = rows.select("bad", "_low", F.explode(F.array(made)).alias("_m")).select("bad", "_low", "_m.*")
    safe_pick = F.coalesce(*[F.when(sy.is_valid(n), F.col(n)) for n in names])
    rows = rows.select("bad", "_low", F.explode(F.array(safe_pick)).alias("_safe"))
    cands = F.when(F.col("_safe").isNotNull(), F.array("_safe")).otherwise(sy.deletion_candidates(F.col("_low")))
    rest = rows.select("bad", F.col("_safe").isNotNull().alias("_is_safe"), F.explode(cands).alias("_cand"))
    known = lexicon.select(F.col("syllable").alias("_cand"), F.lit(True).alias("_known"))
    tried = rest.join(known, "_cand", "left").withColumn("_real", F.col("_known").isNotNull()).withColumn("_valid", sy.is_valid("_cand"))
    votes = tried.groupBy("bad").agg(
        F.max(F.when(F.col("_is_safe"), F.col("_cand"))).alias("_one_safe"),
        F.count_if("_real").alias("_n_real"), F.max(F.when(F.col("_real"), F.col("_cand"))).alias("_one_real"),
        F.count_if("_valid").alias("_n_valid"), F.max(F.when(F.col("_valid"), F.col("_cand"))).alias("_one_valid"),
    )
    pick = F.when(F.col("_one_safe").isNotNull(), F.col("_one_safe")).when(F.col("_n_real") == 1, F.col("_one_real")).when((F.col("_n_real") == 0) & (F.col("_n_valid") == 1), F.col("_one_valid"))
    fixes = votes.select("bad", pick.alias("_fix")).filter("_fix is not null and _fix <> ''")
    return fixes.select("bad", sy.restore_case("bad", "_fix").alias("good")).filter("good <> bad")


def _variants(word):
    """A word and every form of it with one letter left out."""
    return F.array_distinct(
        F.concat(
            F.array(word),
            F.transform(
                F.sequence(F.lit(1), F.length(word)),
                lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))),
            ),
        )
    )


def _swapped(a, b):
    """``b`` is ``a`` with two neighbouring letters exchanged."""
    return F.exists(
        F.sequence(F.lit(1), F.length(a) - 1),
        lambda i: F.concat(
            F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))
        ) == b,
    )


def fuzzy_candidates(words: DataFrame, lexicon: DataFrame, min_ratio: float = 75.0, min_length: int = 3, top: int = 8) -> DataFrame:
    """J11 + L7: (bad, cand, ratio, ed): lexicon syllables one edit or neighbour swap away with the same onset.

    Two words one edit apart share a form with one letter left out, so the search is an equi-join on such forms and
    never compares a word with a whole onset class.
    """
    bad = words.filter(F.length("bad") >= min_length).select("bad", F.lower("bad").alias("_low")).filter(~sy.is_valid("bad"))
    left = bad.withColumn("_form", F.explode(_variants(F.col("_low"))))
    right = lexicon.select(F.col("syllable").alias("cand")).withColumn("_form", F.explode(_variants(F.col("cand"))))
    pairs = left.join(right, "_form").select("bad", "_low", "cand").distinct()
    pairs = pairs.filter(sy.onset("_low") == sy.onset("cand"))
    a, b = F.col("_low"), F.col("cand")
    lev = F.levenshtein(a, b)
    same = F.length(a) == F.length(b)
    one = (lev == 1) | (same & (lev == 2) & _swapped(a, b))
    ratio = F.when(same, 100 * (1 - 1 / F.length(a))).otherwise(100 * (1 - 1 / (F.length(a) + F.length(b))))
    found = pairs.filter(one).select("bad", "cand", ratio.alias("ratio"), F.lit(1).alias("ed")).filter(F.col("ratio") >= min_ratio)
    # a word has few syllables one edit away, so the rank sees a handful of rows per word
    rank = F.row_number().over(Window.partitionBy("bad").orderBy("ed", F.desc("ratio"), "cand"))
    return found.withColumn("_rank", rank).filter(F.col("_rank") <= top).drop("_rank")


def fuzzy_fixes(candidates: DataFrame) -> DataFrame:
    """C6, tier 2: (bad, good) where exactly one candidate is nearest."""
    per = candidates.groupBy("bad", "ed").agg(F.count(F.lit(1)).alias("_n"), F.max("cand").alias("_cand"))
    one = per.groupBy("bad").agg(F.min_by(F.struct("_n", "_cand"), "ed").alias("_p")).select("bad", "_p.*").filter("_n = 1")
    one = one.filter(sy.is_valid("_cand") & (F.col("_cand") != F.lower("bad")))
    return one.select("bad", sy.restore_case("bad", "_cand").alias("good"))


def scored_fixes(candidates: DataFrame, scores: DataFrame, margin: float = 1.5) -> DataFrame:
    """C7, tier 3: (bad, good) from supplied scores of tied candidates, when the best leads by ``margin``."""
    many = candidates.groupBy("bad").agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2").select("bad")
    ranked = scores.join(candidates.select("bad", "cand"), ["bad", "cand"], "left_semi").join(many, "bad", "left_semi")
    best = top_by_margin(ranked, margin).filter(sy.is_valid("cand"))
    return best.select("bad", sy.restore_case("bad", "cand").alias("good"))


def supplied_fixes(words: DataFrame, fixes: DataFrame) -> DataFrame:
    """C8, tier 4: supplied (bad, good) pairs for words that are still damaged; ``good`` must be valid and differ."""
    ok = (F.coalesce(F.col("good"), F.lit("")) != "") & (F.col("good") != F.col("bad")) & sy.is_valid("good")
    usable = fixes.filter(ok).join(words.select("bad"), "bad", "left_semi")
    return usable.groupBy("bad").agg(F.min("good").alias("good"))


def cascade(words: DataFrame, lexicon: DataFrame, scores: DataFrame | None = None, supplied: DataFrame | None = None) -> DataFrame:
    """(bad, good, tier) for every damaged word; ``good`` and ``tier`` are null where no tier could repair it."""
    words = checkpoint(_spread_words(words.select("bad").distinct()))
    lexicon = checkpoint(lexicon.select("syllable").distinct())
    first = checkpoint(collapse_fixes(words, lexicon))
    left = words.join(first, "bad", "left_anti")
    candidates = checkpoint(fuzzy_candidates(left, lexicon))
    second = fuzzy_fixes(candidates)
    fixed = first.withColumn("tier", F.lit(1)).unionByName(second.withColumn("tier", F.lit(2)))
    if scores is not None:
        fixed = fixed.unionByName(scored_fixes(candidates, scores).withColumn("tier", F.lit(3)))
    if supplied is not None:
        still = words.join(fixed.select("bad"), "bad", "left_anti")
        fixed = fixed.unionByName(supplied_fixes(still, supplied).withColumn("tier", F.lit(4)))
    return words.join(fixed, "bad", "left")


def tier_coverage(repairs: DataFrame, tiers: int = 4) -> DataFrame:
    """Per tier the words it repaired, the words left after it and the share of its input it repaired."""
    tier = F.col("tier")
    one = repairs.agg(
        *[F.count_if(tier == k).alias(f"_f{k}") for k in range(1, tiers + 1)],
        *[F.count_if(tier.isNull() | (tier > k)).alias(f"_r{k}") for k in range(1, tiers + 1)],
    )
    per = [F.struct(F.lit(k).alias("tier"), F.col(f"_f{k}").alias("fixed"), F.col(f"_r{k}").alias("remaining")) for k in range(1, tiers + 1)]
    out = one.select(F.explode(F.array(*per)).alias("_t")).select("_t.*")
    given = F.col("fixed") + F.col("remaining")
    return out.withColumn("percent", F.when(given == 0, F.lit(0.0)).otherwise(F.round(100 * F.col("fixed") / given, 6)))


def residuals(repairs: DataFrame) -> DataFrame:
    """Distinct damaged words no tier repaired."""
    return repairs.filter("good is null").select("bad").distinct()


def agreement(chosen: DataFrame, variants: DataFrame) -> DataFrame:
    """Per damaged word whether the chosen repair is among the variants seen, and whether those disagree.

    ``chosen``: bad, good; ``variants``: bad, variant.
    """
    seen = variants.select("bad", "variant").distinct().join(chosen, "bad")
    return seen.groupBy("bad", "good").agg(
        (F.count_if(F.col("variant") == F.col("good")) == 0).alias("mismatch"), (F.count(F.lit(1)) > 1).alias("inconsistent")
    )


def apply_fixes(sections: DataFrame, fixes: DataFrame, key: list[str], text: str = "content", marked: DataFrame | None = None) -> DataFrame:
    """Replace damaged words, keep everything between tokens.

    Texts without a damaged word pass by. For the others the distinct (text, word) pairs meet the fixes, come back as
    one small map per text, and only these texts are shuffled. ``marked`` is a stored result of ``marked_words``.
    """
    marked = marked_words(sections, key, text) if marked is None else marked
    pairs = marked.select(*key, F.explode("words").alias("bad")).join(fixes.select("bad", "good"), "bad")
    maps = pairs.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("bad", "good"))).alias("_map"))
    is_dirty = F.coalesce(F.exists(sy.marked_tokens(text), sy.is_damaged), F.lit(False))
    # as in ``marked_words``, and not below a repartitioning either
    rows = sections.select("*", F.explode(F.array(is_dirty)).alias("_dirty"))
    clean = rows.filter(~F.col("_dirty")).drop("_dirty")
    joined = rows.filter("_dirty").drop("_dirty").join(maps, key, "left")
    fixed = F.array_join(F.transform(sy.segments(text), lambda s: F.coalesce(F.try_element_at(F.col("_map"), s), s)), "")
    joined = joined.withColumn(text, F.when(F.col("_map").isNull(), F.col(text)).otherwise(fixed))
    return clean.unionByName(joined.select(*sections.columns))
