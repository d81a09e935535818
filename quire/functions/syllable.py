"""Verdicts and repair candidates for Vietnamese syllables, as column expressions.

A syllable is a tone over onset + rhyme. The toneless forms are finite (a few thousand, fixed by phonology, not by
data), so validity is one pattern test that stays inside the projection: no join, no shuffle.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, functions as F

from quire.functions import rules
from quire.functions.text import col, let, sub

_TONED = "".join(row[1:] for row in rules.TONES.values())
_BASES = "".join(base * 5 for base in rules.TONES)
_VOWELS = "".join(rules.TONES.values())
_VOWEL_BASES = "".join(base * 6 for base in rules.TONES)
_VOWEL_RANGES = "aeiouyAEIOUYÀ-ÃÈ-ÊÌÍÒ-ÕÙÚÝà-ãè-êìíò-õùúýĂăĨĩŨũƠơƯưẠ-ỹ"
_BEYOND = rules.TOKEN[1:-2].removeprefix("A-Za-z")
_TONE_DIGITS = "012345" * len(rules.TONES)
FRONT = ("e", "ê", "i")


def strip_tones(c) -> Column:
    """The toneless form, case kept."""
    return F.translate(col(c), _TONED + _TONED.upper(), _BASES + _BASES.upper())


def tone_marks(c) -> Column:
    """Number of letters that carry a tone mark."""
    return F.length(col(c)) - F.length(F.translate(col(c), _TONED + _TONED.upper(), ""))


def fits(onset: str, rhyme: str) -> bool:
    """Spelling rules between an onset and the vowel that follows it."""
    front = rhyme[0] in FRONT
    needs = {
        "gh": front, "ngh": front, "ng": not front, "g": not front, "c": not front,
        "k": front or rhyme[0] == "y", "qu": rhyme[0] != "u",
    }
    return needs.get(onset, True)


@lru_cache(maxsize=1)
def valid_bases() -> tuple[str, ...]:
    """Every toneless syllable the spelling allows."""
    spelled = {o + r for o in rules.ONSETS for r in rules.RHYMES if fits(o, r)}
    # after "gi" a rhyme that starts with i loses it: gi + iêng is written giêng
    merged = {"gi" + r[1:] for r in rules.RHYMES if r[0] == "i" and len(r) > 1}
    return tuple(sorted(spelled | merged | {"gi"}))


@lru_cache(maxsize=1)
def _base_pattern() -> str:
    """The valid bases as one prefix-tree pattern: a single node in the plan, a few character tests per word."""
    tree: dict = {}
    for word in valid_bases():
        node = tree
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = {}

    def render(node) -> str:
        branches = [ch + render(sub_node) for ch, sub_node in sorted(node.items()) if ch]
        if not branches:
            return ""
        return "(?:" + "|".join(branches) + ")" + ("?" if "" in node else "")

    return rf"\A{render(tree)}\z"


def is_valid(c) -> Column:
    """Phonotactically valid; anything that is not purely letters passes, the empty string does not."""
    c = col(c)
    return (c != "") & (
        ~c.rlike(r"\A\p{L}+\z") | ((tone_marks(c) <= 1) & strip_tones(F.lower(c)).rlike(_base_pattern()))
    )


def is_suspicious(c) -> Column:
    """C4: two or more letters, at least one with a tone mark or a Vietnamese vowel or đ."""
    marks = _TONED + _TONED.upper() + "ăâđêôơưĂÂĐÊÔƠƯ"
    # most words are ASCII and leave at the first test
    return (
        col(c).rlike(r"[^\x00-\x7f]")
        & col(c).rlike(r"\A\p{L}{2,}\z")
        & (F.length(F.translate(col(c), marks, "")) < F.length(col(c)))
    )


def has_doubled_vowel(c) -> Column:
    """C4: two neighbours with the same base vowel, apart from the rhyme oong."""
    low = F.replace(strip_tones(F.lower(col(c))), F.lit("oong"), F.lit(""))
    return low.rlike("([" + "".join(rules.TONES) + r"])\1")


def is_damaged(c) -> Column:
    return is_suspicious(c) & ~is_valid(c)


def tokens(c) -> Column:
    """Maximal letter runs."""
    return F.regexp_extract_all(col(c), F.lit(rules.TOKEN), F.lit(0))


def marked_tokens(c) -> Column:
    """The tokens with a letter outside ASCII, found by the pattern itself: the others cannot be damaged, and most words are such."""
    return F.regexp_extract_all(col(c), F.lit(f"[A-Za-z]*+[{_BEYOND}]{rules.TOKEN[:-1]}*+"), F.lit(0))


def segments(c) -> Column:
    """Tokens and what lies between them; joined together they give the text back."""
    return F.regexp_extract_all(col(c), F.lit(f"{rules.TOKEN}|[^{rules.TOKEN[1:-2]}]+"), F.lit(0))


def onset(c) -> Column:
    """Longest onset the toneless word starts with."""
    longest_first = sorted((o for o in rules.ONSETS if o), key=lambda o: -len(o))
    return F.regexp_extract(strip_tones(F.lower(col(c))), "^(" + "|".join(longest_first) + ")", 1)


def collapse_runs(c: Column) -> Column:
    return sub(c, r"(.)\1+", "$1")


def collapse_blocks(c: Column) -> Column:
    return sub(sub(c, r"(.{2})\1+", "$1"), r"(.{3})\1+", "$1")


def collapse_same_base(c: Column) -> Column:
    """Left to right, two neighbours of one base vowel become the one with the higher tone (the first on a tie)."""
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("open"))

    def base(x):
        return F.translate(x, _VOWELS, _VOWEL_BASES)

    def tone(x):
        return F.translate(x, _VOWELS, _TONE_DIGITS)

    def step(state, ch):
        opened = state["open"]
        pair = (opened != "") & F.contains(F.lit(_VOWELS), opened) & (base(opened) == base(ch))
        keep = F.when(tone(opened) >= tone(ch), opened).otherwise(ch)
        return F.struct(
            F.concat(state["done"], F.when(pair, keep).otherwise(opened)).alias("done"),
            F.when(pair, F.lit("")).otherwise(ch).alias("open"),
        )

    letters = F.filter(F.split(c, ""), lambda x: x != "")
    folded = F.aggregate(letters, start, step, lambda s: F.concat(s["done"], s["open"]))
    pairs = "([" + "".join(rules.TONES) + r"])\1"
    return F.when(base(c).rlike(pairs), folded).otherwise(c)


def collapse_candidates(low: Column) -> list[Column]:
    """The seven safe candidates in the order they are tried."""
    same, runs, blocks = collapse_same_base(low), collapse_runs(low), collapse_blocks(low)
    return [
        same, runs, blocks, collapse_runs(same), collapse_same_base(runs), collapse_blocks(same),
        collapse_same_base(blocks),
    ]


def deletion_candidates(low: Column) -> Column:
    """For neighbouring vowels of different base, the word without the left and without the right one."""
    return let(low, _deletions)


def _deletions(low: Column) -> Column:
    def at(i):
        return F.substring(low, i, F.lit(1))

    def base(x):
        return F.translate(x, _VOWELS, _VOWEL_BASES)

    def pair(i):
        vowels = F.contains(F.lit(_VOWELS), at(i)) & F.contains(F.lit(_VOWELS), at(i + 1))
        return vowels & (base(at(i)) != base(at(i + 1)))

    def without(i):
        return F.concat(F.substring(low, F.lit(1), i - 1), F.substring(low, i + 1, F.length(low)))

    places = F.when(F.length(low) >= 2, F.sequence(F.lit(1), F.length(low) - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.array_distinct(
        F.flatten(F.transform(F.filter(places, pair), lambda i: F.array(without(i), without(i + 1))))
    )


def restore_case(original, replacement) -> Column:
    """The replacement with a capital first letter where the original had one."""
    replacement = col(replacement)
    upper_first = F.concat(F.upper(F.substring(replacement, 1, 1)), F.substring(replacement, F.lit(2), F.length(replacement)))
    return F.when(F.substring(col(original), 1, 1).rlike(r"\p{Lu}"), upper_first).otherwise(replacement)


def is_corrupted_word(c) -> Column:
    """Three or more characters, not ASCII, with a vowel cluster no syllable has.

    The vowel of the onsets gi and qu is not counted as a vowel. A run of vowels fails when two of them carry tone
    marks, or when neither it nor its first three or two vowels (with at most one left over) form a known cluster.
    """
    c = col(c)
    before_gi = "".join(row for base, row in rules.TONES.items() if base not in "iy")
    plain = sub(c, rf"(?iu)(?<=g)i(?=[{before_gi}])|(?<=q)u", "-")
    runs = F.regexp_extract_all(plain, F.lit(f"[{_VOWEL_RANGES}]{{2,}}"), F.lit(0))
    known = "|".join(sorted(rules.VOWEL_CLUSTERS, key=lambda x: -len(x)))
    two = "|".join(x for x in rules.VOWEL_CLUSTERS if len(x) == 2)
    three = "|".join(x for x in rules.VOWEL_CLUSTERS if len(x) == 3)
    bad = F.exists(
        runs,
        lambda r: (tone_marks(r) >= 2)
        | ~strip_tones(F.lower(r)).rlike(rf"\A(?:{known}|(?:{three}).?|(?:{two}).?)\z"),
    )
    return c.rlike(r"[^\x00-\x7f]") & (F.length(c) >= 3) & bad


def drop_corrupted_words(c) -> Column:
    """Remove stray scripts and corrupted words, then the blanks they leave."""
    c = sub(col(c), r"[\x{0900}-\x{097F}\x{4E00}-\x{9FFF}\x{3000}-\x{303F}]+")
    pieces = F.regexp_extract_all(c, F.lit(r"(?sU)\b[\wÀ-ỹ]{3,}\b|\b[\wÀ-ỹ]{1,2}\b|[^\wÀ-ỹ]+|."), F.lit(0))
    kept = F.array_join(F.filter(pieces, lambda p: ~is_corrupted_word(p)), "")
    return sub(sub(kept, "  +", " "), r"(?dm)^ +")


def invalid_tokens(c) -> Column:
    """A10: the damaged tokens of a text, in order, repeats included."""
    return F.filter(tokens(c), is_damaged)
