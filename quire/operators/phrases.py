"""Long phrase lists in one pass: an Aho-Corasick automaton finds every phrase of a list wherever it ends, however many there are.

A task builds the automaton once and runs it over its Arrow batches. Of overlapping phrases the leftmost counts, of those that start
together the longest. Replacements are not searched again, so the order of a list plays no part.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, functions as F

from quire.functions.text import capitalised, col

Match = tuple[int, int, str]


def folded(text: str) -> str:
    """Lower case, letter by letter: places stay where they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _is_word(c: str) -> bool:
    return c == "_" or c.isalnum() or unicodedata.category(c)[0] == "M"


def automaton(phrases: Iterable[str]) -> ahocorasick.Automaton:
    """The automaton of some phrases, in any case; empty ones are left out."""
    built = ahocorasick.Automaton()
    for phrase in phrases:
        if phrase:
            built.add_word(folded(phrase), folded(phrase))
    built.make_automaton()
    return built


def matches(built: ahocorasick.Automaton, low: str, bounded: bool) -> list[Match]:
    """(start, end, phrase) of the phrases in a folded text that count, in order. With ``bounded``, a phrase without a blank matches whole words."""
    found = []
    for last, phrase in built.iter(low):
        start, end = last + 1 - len(phrase), last + 1
        if bounded and " " not in phrase:
            if start and _is_word(phrase[0]) and _is_word(low[start - 1]):
                continue
            if end < len(low) and _is_word(phrase[-1]) and _is_word(low[end]):
                continue
        found.append((start, end, phrase))
    found.sort(key=lambda m: (m[0], -m[1]))
    out, free = [], 0
    for m in found:
        if m[0] >= free:
            out.append(m)
            free = m[1]
    return out


def _rewrite(phrases: list[str], bounded: bool, put: Callable[[str, str, Match], str]):
    """A column function that replaces every match by what ``put`` makes of (text, folded text, match)."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        built = automaton(phrases)

        def one(text: str) -> str:
            low = folded(text)
            found = matches(built, low, bounded) if len(built) else []
            if not found:
                return text
            out, free = [], 0
            for m in found:
                out += [text[free : m[0]], put(text, low, m)]
                free = m[1]
            return "".join(out) + text[free:]

        for texts in batches:
            yield texts.map(one, na_action="ignore")

    return run


def _cased(text: str, start: int, replacement: str) -> str:
    c = text[start]
    return capitalised(replacement) if c != c.lower() and c == c.upper() else replacement


def _table(pairs) -> dict[str, str]:
    """The replacement of each phrase; the first of a phrase counts."""
    table: dict[str, str] = {}
    for phrase, replacement in pairs:
        table.setdefault(folded(phrase), replacement)
    return table


def replace_phrases(c, pairs, bounded: bool = True) -> Column:
    """Phrases of a list replaced, in any case; a match that starts with a capital keeps it."""
    table = _table(pairs)
    return _rewrite(list(table), bounded, lambda text, low, m: _cased(text, m[0], table[m[2]]))(col(c))


def replace_foreign_words(c, pairs) -> Column:
    """Foreign words replaced by native ones, or by nothing where the native word stands next to them in the text."""
    table = {w: (n, folded(n)) for w, n in _table(pairs).items()}

    def put(text: str, low: str, m: Match) -> str:
        start, end, word = m
        native, plain = table[word]
        before = low.endswith((plain, plain + " "), 0, start)
        return "" if before or low.startswith((plain, " " + plain), end) else _cased(text, start, native)

    return F.regexp_replace(_rewrite(list(table), True, put)(col(c)), "  +", " ")


def holds_any(c, terms, bounded: bool = False) -> Column:
    """does one of the terms occur, in any case? Null stays null."""
    terms = list(dict.fromkeys(folded(t) for t in terms))

    @F.pandas_udf("boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        built = automaton(terms)
        for texts in batches:
            yield texts.map(lambda t: bool(len(built)) and bool(matches(built, folded(t), bounded)), na_action="ignore")

    return run(col(c))


def phrase_counts(c, terms, bounded: bool = True) -> Column:
    """How often each term of a list occurs in a text, as a map of those that do; overlapping terms as in ``replace_phrases``."""
    terms = list(dict.fromkeys(folded(t) for t in terms))

    @F.pandas_udf("map<string,long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        built = automaton(terms)

        def one(text: str) -> dict[str, int]:
            out: dict[str, int] = {}
            for *_, phrase in matches(built, folded(text), bounded) if len(built) else ():
                out[phrase] = out.get(phrase, 0) + 1
            return out

        for texts in batches:
            yield texts.map(one, na_action="ignore")

    return run(col(c))
