"""Unicode normalisation."""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import DataFrame, functions as F


def _class(runs: list[list[int]], negated: bool = False) -> str:
    parts = (rf"\x{{{a:x}}}" if a == b else rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in runs)
    return "[" + "^" * negated + "".join(parts) + "]"


#: Where nearly all letters and signs of Latin texts lie, and the least run of safe characters that is worth a part of its own.
LATIN, LONG = ([0x0, 0x2FF], [0x1E00, 0x1EFF], [0x2002, 0x20CF]), 128


@functools.cache
def _patterns() -> tuple[str, str, str]:
    """Three classes, each dearer than the one before. The last holds the code points that a composed text cannot be sure to hold: marks, and
    all that change on their own or may combine with what stands before them (jamo among them). It has hundreds of parts, and a
    character outside is compared with each. The first two find the texts with anything outside of LATIN, and outside of the long safe runs."""
    doubtful: list[list[int]] = []
    safe = [[0, 0x2FF]]
    for c in range(0x300, sys.maxunicode + 1):
        kind = doubtful if 0xD800 <= c <= 0xDFFF or _may_change(chr(c)) else safe
        if kind[-1:] and kind[-1][1] == c - 1:
            kind[-1][1] = c
        else:
            kind.append([c, c])
    doubtful = [[a, b] for a, b in doubtful if not 0xD800 <= a <= 0xDFFF]
    latin = [[a, b] for a, b in LATIN if any(x <= a and b <= y for x, y in safe)]
    return _class(latin, negated=True), _class([r for r in safe if r[1] - r[0] >= LONG], negated=True), _class(doubtful)


def _may_change(c: str) -> bool:
    hangul = "\u1161" <= c <= "\u1175" or "\u11a8" <= c <= "\u11c2"
    return hangul or unicodedata.category(c)[0] == "M" or unicodedata.normalize("NFC", c) != c


def nfc(df: DataFrame, column: str) -> DataFrame:
    """T4: NFC form of ``column``, by the Unicode library that Spark's collations use. Only texts with a code point that may not be composed are
    handed to it."""
    text = F.col(column)
    marked = functools.reduce(lambda a, b: a & b, [text.rlike(p) for p in _patterns()])
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    return df.withColumn(column, F.when(marked, composed).otherwise(text))
