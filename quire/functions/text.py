"""Column expressions over text. All run inside the JVM; patterns are Java regular expressions."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from quire.functions import rules

# the code points Python's str.split() and str.strip() treat as blank
SPACE = (
    r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
BLANKS = "".join(chr(cp) for cp in range(0x3001) if chr(cp).isspace())
# the complement; the ASCII part comes first because it decides for most characters
WORD = rf"[!-~[^{SPACE}]]+"
# the Vietnamese alphabet as ranges: a class of single characters is tested one by one
LETTERS = "a-zA-ZÀ-ÃÈ-ÊÌÍÒ-ÕÙÚÝà-ãè-êìíò-õùúýĂăĐđĨĩŨũƠơƯưẠ-ỹ"
UPPER = r"A-ZÀ-ÃÈ-ÊÌÍÒ-ÕÙÚÝĂĐĨŨƠƯ[Ạ-ỹ&&\p{Lu}]"
LOWER = r"a-zà-ãè-êìíò-õùúýăđĩũơư[Ạ-ỹ&&\p{Ll}]"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` applied to ``value``, computed once: a lambda would compute an outer expression again per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sub(c: Column, pattern: str, replacement: str = "") -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(replacement))


def chain(c: Column, steps) -> Column:
    for pattern, replacement in steps:
        c = sub(c, pattern, replacement)
    return c


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def capitalised(word: str) -> str:
    """``word`` with its first letter in upper case; one letter stays one letter, as in Unicode's simple case mapping."""
    first = "ẞ" if word[:1] == "ß" else word[:1].upper()
    return word if len(first) > 1 else first + word[1:]


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(BLANKS))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(BLANKS))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def word_count(c) -> Column:
    """Number of blank-separated words."""
    return F.coalesce(F.regexp_count(col(c), F.lit(WORD)), F.lit(0))


def lines(c: Column) -> Column:
    """The trimmed, non-empty lines."""
    return F.filter(F.transform(F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"), strip), lambda x: x != "")


def last_index(c: Column, piece: str) -> Column:
    """0-based position of the last ``piece`` or -1."""
    found = F.locate(piece[::-1], F.reverse(c))
    return F.when(found == 0, F.lit(-1)).otherwise(F.length(c) - found - (len(piece) - 1))


def _accent_table() -> tuple[str, str]:
    """Every letter that decomposes to an ASCII letter plus marks, and that ASCII letter."""
    marked, plain = [], []
    for cp in range(0xC0, sys.maxunicode + 1):
        parts = unicodedata.normalize("NFD", chr(cp))
        if len(parts) >= 1 and parts != chr(cp) and parts[0].isascii() and parts[0].isalpha():
            if all(unicodedata.combining(m) for m in parts[1:]):
                marked.append(chr(cp))
                plain.append(parts[0])
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = _accent_table()


def unaccent(c: Column) -> Column:
    return sub(F.translate(c, _MARKED, _PLAIN), r"\p{Mn}+")


def slug(c) -> Column:
    """URL slug; punctuation disappears, blanks become one dash."""
    c = F.translate(F.lower(unaccent(col(c))), "đ", "d")
    return chain(c, [(rf"[^a-z0-9{SPACE}-]+", ""), (rf"[{SPACE}]+", "-"), ("-+", "-"), (r"\A-|-\z", "")])


def file_slug(c, limit: int = 80) -> Column:
    """File-name slug; every other character becomes a dash."""
    c = F.translate(F.lower(col(c)), rules.FILE_ACCENTS_FROM, rules.FILE_ACCENTS_TO)
    return F.substring(chain(c, [("[^a-z0-9]+", "-"), (r"\A-|-\z", "")]), 1, limit)


def repair_mojibake(c) -> Column:
    """T5: undo UTF-8 read as Latin-1, kept when enough of the text survives."""
    c = F.replace(col(c), F.lit("\x00"), F.lit(""))
    latin = F.encode(sub(c, r"[^\x00-\x{ff}]+"), "ISO-8859-1").cast("string")
    fixed = F.replace(F.make_valid_utf8(latin), F.lit("�"), F.lit(""))
    broken = c.rlike("|".join(rules.MOJIBAKE_MARKS))
    return F.when(broken & (F.length(fixed) > F.length(c) * 0.3), fixed).otherwise(c)


def strip_foreign(c) -> Column:
    """Remove CJK, Cyrillic, Hangul, Kana and runs of four or more ASCII words."""
    c = sub(col(c), r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}\x{3000}-\x{303f}]+")
    c = sub(c, r"[\x{0400}-\x{04ff}]+")
    c = sub(c, r"[\x{ac00}-\x{d7af}\x{1100}-\x{11ff}]+")
    c = sub(c, r"[\x{3040}-\x{30ff}]+")
    # possessive, so that a long run is matched without recursion
    c = sub(c, rf"(?<![a-zA-Z])[a-zA-Z]++(?:[{SPACE}]++[a-zA-Z]++){{3,}}+")
    return strip(chain(c, [("  +", " "), (r"(?dm)^ +| +$", ""), (r"\n{3,}", "\n\n")]))


def reflow(c) -> Column:
    """Put dialogue that was glued together on lines of its own."""
    s = rf"[{SPACE}]"
    capital = "[A-ZÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚĂĐĨŨƠƯẠ-Ỹ]"
    c = chain(col(c), [(r"\r\n|\r", "\n"), (r"\n{3,}", "\n\n")])
    c = sub(c, rf'([.?!…]["»]){s}*([^\n"«{SPACE}])', "$1\n$2")
    c = sub(c, rf'([:：]){s}*(["«])', "$1\n$2")
    c = sub(c, rf'(?U)(?<=[\wÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚĂĐĨŨƠƯạ-ỹ])(["»]){s}+({capital})', "$1\n$2")
    c = sub(c, r'([.?!…"»])\n([^\n])', "$1\n\n$2")
    c = sub(c, rf'\n{s}*(["«»]){s}*\n+', "\n$1")
    return strip(sub(c, r"\n{3,}", "\n\n"))


def undot(c) -> Column:
    """Drop the dots inside spelled-out words such as ``T.i.ế.n``."""
    dotted = rf"(?U)\b[{LETTERS}]+\.[{LETTERS}.]+\b"
    piece = rf"(?sU)\b[{LETTERS}]+\.[{LETTERS}.]+\b|.+?(?=\b[{LETTERS}]+\.[{LETTERS}]|\z)"

    def join(x):
        fixed = F.transform(
            F.regexp_extract_all(x, F.lit(piece), F.lit(0)),
            lambda p: F.when(p.rlike(rf"\A{dotted}\z"), F.replace(p, F.lit("."), F.lit(""))).otherwise(p),
        )
        return F.when(x.rlike(dotted), F.array_join(fixed, "")).otherwise(x)

    return let(col(c), join)


def clean_body(c, lexicon=(), drop_unknown: bool = False) -> Column:
    """Drop headings, end marks, numbering and rule lines, undot words, apply ``lexicon`` and split glued sentences.

    ``lexicon`` holds (phrase, replacement) pairs and is applied longest phrase first. ``drop_unknown`` also removes
    characters outside letters, digits, blanks and common punctuation.
    """
    h = r"[^\S\n]*"
    c = sub(col(c), rf"(?dimU)^[^\S\r\n]*chương[^\S\n]+([IVXLCDM]+|\d+)({h}[:\-–—.]?{h}[^\n]*)?$")
    c = sub(c, rf"(?dimU)^[^\S\r\n]*[-–—~*\[\](【】]?{h}H[EÉẾ]T{h}[-–—~*\[\](【】]?{h}$")
    c = sub(c, rf"(?dm)^[{SPACE}]*\d+[{SPACE}]+(?=[{UPPER}][{LOWER}])")
    c = sub(c, rf"(?dm)^[^\S\r\n]*[-_─—═=]{{3,}}{h}$")
    c = sub(c, rf"(?dm)^[^\S\r\n]*\d+\.[{UPPER}].*$")
    c = undot(sub(c, r"\n{3,}", "\n\n"))
    starred = rf"[{SPACE}]*\*{{3}}g[{SPACE}]*"
    c = let(c, lambda x: F.when(F.contains(x, F.lit("***g")), sub(x, starred, " ")).otherwise(x))
    c = sub(c, r"[\x{1D400}-\x{1D7FF}\x{1F300}-\x{1FAFF}]")
    for phrase, replacement in sorted(lexicon, key=lambda pair: -len(pair[0])):
        c = sub(c, rf"(?iU)\b{re.escape(phrase)}\b", replacement)
    c = sub(c, rf"([{LOWER}])([{UPPER}])", "$1\n$2")
    if drop_unknown:
        c = sub(c, rf"""[^{LETTERS}0-9_{SPACE}.,!?'"“”‘’…\-–—:;()\[\]{{}}]+""")
    return strip(chain(c, [(r"[^\S\n]+", " "), (r"\n+", "\n")]))


def replace_phrases(c, pairs, bounded: bool = True) -> Column:
    """Case-insensitive phrase replacement; a match that starts with a capital keeps it."""
    c = col(c)
    for phrase, replacement in pairs:
        edge = r"\b" if bounded and " " not in phrase else ""
        first, rest = phrase[0], re.escape(phrase[1:])
        capital = capitalised(replacement)
        if first.upper() != first.lower():
            c = sub(c, rf"(?U){edge}{re.escape(first.upper())}(?i){rest}{edge}", capital)
        c = sub(c, rf"(?iU){edge}{re.escape(phrase)}{edge}", replacement)
    return c


def replace_foreign_words(c, pairs) -> Column:
    """Foreign word to native word, or nothing when the native word already stands next to it."""
    c = col(c)
    for word, native in pairs:
        w, n = re.escape(word), re.escape(native)
        c = sub(c, rf"(?iU)(?<={n} )\b{w}\b|(?<={n})\b{w}\b|\b{w}\b(?= ?{n})")
        capital = capitalised(native)
        if word[0].upper() != word[0].lower():
            c = sub(c, rf"(?U)\b{re.escape(word[0].upper())}(?i){re.escape(word[1:])}\b", capital)
        c = sub(c, rf"(?iU)\b{w}\b", native)
    return sub(c, "  +", " ")


def repair_punctuation(c) -> Column:
    """Blanks round marks, doubled marks and orphan commas."""
    s = rf"[{SPACE}]"
    return chain(
        col(c),
        [
            (rf"([.!?,:;])([{LETTERS}])", "$1 $2"),
            (r"([.!?,;:])\1+", "$1"),
            (rf",{s}*\.", "."),
            (rf",{s}*,+", ","),
            (rf"{s}+,({s}*\n)", "$1"),
            (rf"(\n){s}*,{s}*", "$1"),
            (rf"{s}+([.!?,:;])", "$1"),
        ],
    )


def collapse_repeats(c) -> Column:
    """A word said twice in a row, in any case, is kept once."""
    return sub(col(c), rf"(?iU)\b([\wÀ-ỹ]{{2,}})[{SPACE}]+\1\b", "$1")


def normalise_quotes(c) -> Column:
    return F.translate(col(c), "“”「」『』", '"' * 6)


def remove_hesitation(c) -> Column:
    """Cap dots, drop hesitation words, restore words whose first letters were cut at a line start."""
    s, hes = rf"[{SPACE}]", "(?:" + "|".join(rules.HESITATIONS) + ")"
    c = chain(
        col(c),
        [
            (r"\.{4,}", "..."),
            (rf"(?iu)\.{{2,3}}{s}*{hes}{s}*\.{{2,3}}", "..."),
            (rf'(?iu)(?<="){s}*{hes}{s}*\.{{2,3}}{s}*', ""),
            (rf"(?iu),{s}*{hes}{s}*,", ","),
        ],
    )
    for cut, whole in rules.CUT_LINE_HEADS.items():
        c = sub(c, rf"(?dmU)^{cut}\b", whole)
    return c


def sentences(c) -> Column:
    """Split after . ? ! … and at line breaks."""
    return F.split(col(c), rf"(?<=[.?!…])[{SPACE}]+|\n+")


def truncate_at_sentence(c, limit: int = 200) -> Column:
    """Cut at the last sentence end, trying the separators in their listed order, then at a blank."""
    c = col(c)
    head = F.substring(c, 1, limit)
    out = F.when(F.length(c) <= limit, c)
    for mark in rules.SENTENCE_MARKS:
        at = last_index(head, mark)
        out = out.when(at > limit * 0.3, rstrip(F.substring(head, F.lit(1), at + len(mark))))
    at = last_index(head, " ")
    out = out.when(at > limit * 0.3, F.concat(rstrip(F.substring(head, F.lit(1), at)), F.lit("…")))
    return out.otherwise(F.concat(rstrip(head), F.lit("…")))


def strip_emoji(c) -> Column:
    """Emoji, zero-width characters and the script range between them."""
    return sub(col(c), rules.EMOJI_CLASS + "+")


def sanitise_description(c, limit: int = 200) -> Column:
    """Drop blocked and call-to-action sentences, strip emoji, squeeze blanks, cut to ``limit``."""
    from quire.functions.predicates import is_blocked_sentence, is_call_to_action

    kept = F.filter(
        F.transform(sentences(c), strip),
        lambda s: (s != "") & ~is_blocked_sentence(s) & ~is_call_to_action(s),
    )
    joined = strip(sub(strip_emoji(F.array_join(kept, " ")), rf"[{SPACE}]+", " "))
    return truncate_at_sentence(joined, limit)


def latin_punctuation(c) -> Column:
    """CJK punctuation to its Latin counterpart."""
    return F.translate(col(c), rules.CJK_PUNCTUATION_FROM, rules.CJK_PUNCTUATION_TO)


def head_tail(c, limit: int = 2500, marker: str = "\n[... lược bớt giữa chương ...]\n") -> Column:
    """First and last half of a long text with a marker between."""
    c = strip(F.coalesce(col(c), F.lit("")))
    tail = F.substring(c, F.length(c) - (limit - limit // 2) + 1, F.lit(limit))
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, limit // 2), F.lit(marker), tail))


def sentence_excerpt(c, limit) -> Column:
    """The first ``limit`` characters, cut after the last sentence mark when it lies beyond 70 %."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    head = F.substring(col(c), F.lit(1), limit)
    last = F.greatest(*[last_index(head, m) for m in ".!?"])
    return F.when(last > limit * 0.7, F.substring(head, F.lit(1), last + 1)).otherwise(head)


def contexts(c, terms: Column, window: int = 150, marker: str = "\n…\n") -> Column:
    """``window`` characters round the first hit of each term; overlapping snippets are merged."""
    return let(col(c), lambda x: _contexts(x, terms, window, marker))


def _contexts(c: Column, terms: Column, window: int, marker: str) -> Column:
    hits = F.filter(
        F.transform(F.array_distinct(terms), lambda t: F.struct(F.instr(c, t).alias("at"), F.length(t).alias("n"))),
        lambda h: h["at"] > 0,
    )
    spans = F.array_sort(
        F.transform(
            hits,
            lambda h: F.struct(
                F.greatest(F.lit(0), h["at"] - 1 - window).alias("s"),
                F.least(F.length(c), h["at"] - 1 + h["n"] + window).alias("e"),
            ),
        )
    )
    empty = F.array().cast("array<struct<s:int,e:int>>")

    def merge(done, span):
        tail = F.element_at(done, -1)
        joined = F.struct(tail["s"].alias("s"), F.greatest(tail["e"], span["e"]).alias("e"))
        return F.when(F.size(done) == 0, F.array(span)).when(
            span["s"] <= tail["e"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))
        ).otherwise(F.concat(done, F.array(span)))

    merged = F.aggregate(spans, empty, merge)
    return F.array_join(F.transform(merged, lambda p: F.substring(c, p["s"] + 1, p["e"] - p["s"])), marker)


def masked_context(c, term, mask: str = "<mask>", window: int = 80) -> Column:
    """The neighbourhood of the first hit with the hit replaced by ``mask``; null without a hit."""
    c, term = col(c), col(term)
    at = F.instr(c, term)
    start = F.greatest(F.lit(1), at - window)
    return F.when(
        at > 0,
        F.concat(
            F.substring(c, start, at - start), F.lit(mask), F.substring(c, at + F.length(term), F.lit(window))
        ),
    )


def word_bounded_at(limit: int, floor: int, dots: bool = True):
    """Shorten a headline at a blank before ``limit``; hard cut when the blank lies at ``floor`` or earlier."""

    def cut(hook: Column) -> Column:
        at = last_index(F.substring(hook, 1, limit), " ")
        short = F.when(at > floor, sub(F.substring(hook, F.lit(1), at), r"[.,;:!? ]+\z")).otherwise(
            rstrip(F.substring(hook, 1, limit))
        )
        return F.when(F.length(hook) > limit, F.concat(short, F.lit("..."))).otherwise(hook)

    return cut


def title_line(c, prefix: str, suffix: str, limit: int = 100) -> Column:
    """``a | b | c`` keeps ``a`` plus the suffix and fits ``limit`` at a word boundary.

    A leading list number or ``# `` is kept; lines without ``prefix`` pass unchanged.
    """
    return let(col(c), lambda x: F.when(F.contains(x, F.lit(prefix)), _titled(x, prefix, suffix, limit)).otherwise(x))


def _titled(c: Column, prefix: str, suffix: str, limit: int) -> Column:
    def fitted(s):
        hook = let(sub(F.substring(s["b"], F.lit(1), s["at"]), r"[. ]+\z"), word_bounded_at(limit - len(prefix) - len(suffix), len(prefix)))
        return F.when((F.length(s["b"]) > limit) & (s["at"] > 0), F.concat(hook, F.lit(suffix))).otherwise(s["b"])

    def body(lead):
        rest = F.substring(c, F.length(lead) + 1, F.length(c))
        first = let(F.transform(F.split(rest, r"\|"), strip), lambda parts: F.when(F.size(parts) >= 3, F.concat(parts[0], F.lit(suffix))).otherwise(rest))
        return F.concat(lead, let(let(first, lambda b: F.struct(b.alias("b"), last_index(b, suffix).alias("at"))), fitted))

    return let(F.regexp_extract(c, rf"\A(\d+\.[{SPACE}]+|# )", 1), body)


def short_title(c, suffix: str, brand: str, limit: int = 100) -> Column:
    """T31, quoted form: the text between quotes or brackets, with the work's name dropped and the suffix added."""
    c = col(c)
    quoted = r'["\[](.*?)["\]]'
    raw = strip(F.regexp_extract(c, quoted, 1))
    parts = F.transform(F.split(raw, r"\|"), strip)
    n = F.size(parts)
    raw = (
        F.when(n >= 3, F.concat(parts[0], F.lit(" | "), F.element_at(parts, -1)))
        .when((n == 2) & ~F.contains(F.element_at(parts, -1), F.lit(brand)), F.concat(parts[0], F.lit(suffix)))
        .when(n == 1, F.concat(parts[0], F.lit(suffix)))
        .otherwise(raw)
    )
    at = last_index(raw, suffix)
    hook = word_bounded_at(limit - len(suffix), 10)(sub(F.substring(raw, F.lit(1), at), r"[. ]+\z"))
    raw = F.when((F.length(raw) > limit) & (at > 0), F.concat(hook, F.lit(suffix))).otherwise(raw)
    return F.when(c.rlike(quoted), raw).otherwise(c)


def wrap_title(c, limit: int = 28) -> Column:
    """Break a long title after the first ``...``, else at the blank nearest its middle."""
    return let(col(c), lambda x: _wrapped(x, limit))


def _wrapped(c: Column, limit: int) -> Column:
    dots = F.instr(c, "...")
    at_dots = F.concat(
        strip(F.substring(c, F.lit(1), dots - 1)), F.lit("...\n"), strip(F.substring(c, dots + 3, F.length(c)))
    )
    # the blanks next to the middle on both sides, one search each: a test of every place would count the letters before it again
    mid = F.floor(F.length(c) / 2).cast("int")
    left = last_index(F.substring(c, F.lit(1), mid + 1), " ") + 1
    right = F.coalesce(F.nullif(F.instr(F.substring(c, mid + 2, F.length(c)), " "), F.lit(0)) + mid + 1, F.lit(0))
    best = F.when((left > 0) & ((right == 0) | (mid + 1 - left <= right - 1 - mid)), left).otherwise(right)
    return (
        F.when(F.contains(c, F.lit("\n")) | (F.length(c) <= limit), c)
        .when(dots > 0, at_dots)
        .when(best > 1, F.concat(F.substring(c, F.lit(1), best - 1), F.lit("\n"), F.substring(c, best + 1, F.length(c))))
        .otherwise(c)
    )


def first_label(c, rule_list) -> Column:
    """Label of the first rule that has a keyword in the lowercased text, else ''."""
    def label(low):
        out = F.when(F.lit(False), F.lit(""))
        for keywords, name in rule_list:
            # a search of bytes per keyword: alternatives of a pattern are tried at every letter
            out = out.when(reduce(or_, [F.contains(low, F.lit(k)) for k in keywords]), F.lit(name))
        return out.otherwise(F.lit(""))

    return let(F.lower(col(c)), label)


def visual_sentence(c, limit: int = 250, min_length: int = 40) -> Column:
    """First long line with a cue word, else the first long line, else the head of the text."""
    c = col(c)
    long_lines = F.filter(lines(c), lambda x: F.length(x) > min_length)
    cue = "|".join(re.escape(w) for w in rules.VISUAL_CUES)
    cued = F.filter(long_lines, lambda x: F.lower(x).rlike(cue))
    return F.substring(F.coalesce(F.get(cued, F.lit(0)), F.get(long_lines, F.lit(0)), c), 1, limit)


def srt_time(ms: Column) -> Column:
    """Whole milliseconds as HH:MM:SS,mmm."""
    sec = F.floor(ms / 1000)
    return F.format_string(
        "%02d:%02d:%02d,%03d", F.floor(sec / 3600), F.floor(sec / 60) % 60, sec % 60, (ms % 1000).cast("bigint")
    )


def speech_text(title, content) -> Column:
    """Title line, then the body with split quotes glued and lines trimmed."""
    s = rf"[{SPACE}]"
    body = chain(
        F.coalesce(col(content), F.lit("")),
        [(rf'"{s}*\n{s}*\n{s}*', '"'), (rf'\n{s}*\n{s}*"', '"'), (r"\n{3,}", "\n\n")],
    )
    body = strip(F.array_join(F.transform(F.split(body, r"\r\n|[\n\r]"), strip), "\n"))
    title = strip(F.coalesce(col(title), F.lit("")))
    return F.when((title != "") & (body != ""), F.concat(title, F.lit(".\n\n"), body)).otherwise(
        F.when(body != "", body).otherwise(title)
    )


def seed31(c) -> Column:
    """Stable 31-bit seed of a text."""
    return F.conv(F.substring(F.md5(col(c)), 1, 8), 16, 10).cast("bigint") % F.lit(2**31)


def default_if_blank(c, value: str) -> Column:
    """T42."""
    return F.coalesce(F.nullif(col(c), F.lit("")), F.lit(value))


def substitute_seeded(c, key, synonyms: dict[str, list[str]], seed: int = 0) -> Column:
    """About half of the listed words become a synonym; the choice hangs on (seed, key, position) only."""
    words_by_length = sorted(synonyms, key=lambda w: -len(w))
    listed = "|".join(re.escape(w) for w in words_by_length)
    pieces = F.regexp_extract_all(
        col(c), F.lit(rf"(?sU)(?<!\w)(?:{listed})(?!\w)|.+?(?=(?<!\w)(?:{listed})(?!\w)|\z)"), F.lit(0)
    )
    table = F.create_map(*[x for w in words_by_length for x in (F.lit(w), F.array(*[F.lit(s) for s in synonyms[w]]))])

    def pick(piece, i):
        draw = F.pmod(F.xxhash64(F.lit(seed), col(key), i), F.lit(1 << 20))
        options = F.element_at(table, piece)
        chosen = F.get(options, F.floor(draw / 2) % F.size(options))
        return F.when(options.isNotNull() & (draw % 2 == 0), chosen).otherwise(piece)

    return F.coalesce(F.array_join(F.transform(pieces, pick), ""), col(c))
