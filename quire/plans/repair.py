"""Clean and repair: NFC, the tier cascade over the vocabulary, one rewrite pass, then the punctuation chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.functions import syllable as sy
from quire.functions import text as t
from quire.operators import correct
from quire.operators import phrases as ph
from quire.operators.normalise import nfc
from quire.session import checkpoint


def repair_words(sections: DataFrame, lexicon: DataFrame, key: list[str], text: str = "content", scores=None, supplied=None):
    """(repaired sections, repairs): damaged words replaced by the first tier that knows a repair."""
    composed = nfc(sections, text)
    # keys and damaged words only: the vocabulary and the fix maps both start from here
    marked = checkpoint(correct.marked_words(composed, key, text))
    words = marked.select(F.explode("words").alias("bad")).distinct()
    repairs = correct.cascade(words, lexicon, scores, supplied)
    return correct.apply_fixes(composed, repairs.filter("good is not null"), key, text, marked), repairs


def clean_and_repair(sections: DataFrame, lexicon: DataFrame, key: list[str], text: str = "content", phrases=(), foreign=(),
                     body_lexicon=(), collapse: bool = False) -> DataFrame:
    """The whole section cleaner; phrase and word lists are the caller's."""
    # the repair reads the cleaned text three times
    body = checkpoint(sections.withColumn(text, t.clean_body(text, body_lexicon)))
    fixed, _ = repair_words(body, lexicon, key, text)
    fixed = fixed.withColumn(text, sy.drop_corrupted_words(text)).withColumn(text, t.repair_punctuation(text))
    if collapse:
        fixed = fixed.withColumn(text, t.collapse_repeats(text))
    fixed = fixed.withColumn(text, t.remove_hesitation(t.normalise_quotes(text)))
    if phrases:
        fixed = fixed.withColumn(text, ph.replace_phrases(text, phrases))
    if foreign:
        fixed = fixed.withColumn(text, ph.replace_foreign_words(text, foreign))
    return fixed.withColumn(text, t.sub(t.col(text), r"(?dm)^[ \t]+$"))
