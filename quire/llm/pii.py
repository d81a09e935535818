"""PII: found entities are replaced by keyed surrogates of the same kind, format, script and gender.

A surrogate is made from a keyed hash of the entity's normal form, so all its mentions agree. Surrogates are checked against one
another and against the real entities; those that clash are made anew from the next round of the hash, so different
entities stay different. The names of a person with a title are replaced wherever they stand in the same text, with the surrogates
of the titled mention. Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import fresh, let, stored

# What is found (plain patterns). A mention must not touch letters or digits.
_LEFT, _RIGHT = "(?<![\\p{L}\\p{N}])", "(?![\\p{L}\\p{N}])"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
MALE = "Mr|Herr|Monsieur|Señor|Sr|Don|г-н|господин"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Sra|Doña|г-жа|госпожа"
# an apostrophe or hyphen belongs to a name if two letters follow (not in a genitive)
_NAME = "\\p{Lu}(?:\\p{L}|['’-](?=\\p{L}{2}))+"
KINDS = {
    "email": "(?<![\\p{L}\\p{N}._%+-])[\\p{L}\\p{N}._%+-]++@(?:[\\p{L}\\p{N}-]+\\.)+\\p{L}{2,}",
    "secret": f"{_LEFT}(?:[0-9a-f]{{32,128}}|[0-9A-F]{{32,128}}|AKIA[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{36}}|sk-[A-Za-z0-9]{{20,}}){_RIGHT}",
    "ip": f"(?<![\\p{{L}}\\p{{N}}.]){_OCTET}(?:\\.{_OCTET}){{3}}(?!\\.?[\\p{{L}}\\p{{N}}])",
    "phone": f"{_LEFT}\\+[0-9]{{1,3}}[ .-]?(?:\\([0-9]{{2,4}}\\)|[0-9]{{2,4}})[ .-]?[0-9]{{3,4}}[ .-]?[0-9]{{3,4}}{_RIGHT}"
    # groups of two digits at the end, abroad and at home; an area code and a number in one piece
    f"|{_LEFT}\\+[0-9]{{1,3}}[ .-]?(?:\\(0\\) ?)?[0-9]{{1,3}}(?:[ .-]?[0-9]{{2}}){{3,4}}{_RIGHT}"
    f"|{_LEFT}(?:\\+7|8)[ -]?(?:\\([0-9]{{3}}\\)|[0-9]{{3}})[ -]?[0-9]{{3}}(?:[ -][0-9]{{2}}){{2}}{_RIGHT}"
    f"|{_LEFT}[6-9][0-9]{{2}}(?: [0-9]{{2}}){{3}}{_RIGHT}(?! [0-9]{{2}}{_RIGHT})|{_LEFT}0[1-9](?:[ .-][0-9]{{2}}){{4}}{_RIGHT}"
    f"|{_LEFT}\\+[0-9]{{1,3}}[ .-]?(?:\\(0\\) ?)?[0-9]{{2,4}}[ .-]?[0-9]{{5,8}}{_RIGHT}|{_LEFT}0[1-9][0-9]{{1,3}}[ /-][0-9]{{5,8}}{_RIGHT}"
    f"|{_LEFT}\\([0-9]{{3}}\\) ?[0-9]{{3}}[ .-][0-9]{{4}}{_RIGHT}|{_LEFT}[0-9]{{3}}[.-][0-9]{{3}}[.-][0-9]{{4}}{_RIGHT}",
    "card": f"{_LEFT}(?:[0-9]{{13,19}}|[0-9]{{4}}(?: [0-9]{{4}}){{3}}|[0-9]{{4}}(?:-[0-9]{{4}}){{3}}){_RIGHT}",
    "ssn": f"{_LEFT}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_RIGHT}",
    "person": f"{_LEFT}(?:{MALE}|{FEMALE})\\.? {_NAME}(?: {_NAME})*",
}
PATTERN = "|".join(KINDS.values())
#: A text without any of these holds no entity; this is much quicker to test.
TITLED = f"{_LEFT}(?:{MALE}|{FEMALE})\\.? "
HINT = f"[0-9@]|{TITLED}"
# Syllables and endings of surrogate names, by script and gender (plain values).
SYLLABLES = {
    "latin": "ba be bo da do fe ga ka ko la le lo ma mi mo na ne ni no ra re ri ro sa se si ta te ti to va vi".split(),
    "cyrillic": "ба бе бо да до фе га ка ко ла ле ло ма ми мо на не ни но ра ре ри ро са се си та те ти то ва ви".split(),
}
ENDINGS = {
    "given:latin:m": "n", "given:latin:f": "na", "given:cyrillic:m": "н", "given:cyrillic:f": "на",
    "surname:latin": "l", "surname:cyrillic:m": "ов", "surname:cyrillic:f": "ова",
}
ROUNDS = 12


def _kind(mention: Column) -> Column:
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(KINDS.items()):
        kind = F.when(mention.rlike(f"^(?:{pattern})$"), name).otherwise(kind)
    return kind


def _unit(kind: Column, raw: Column, norm: Column) -> Column:
    return F.struct(kind.alias("kind"), raw.alias("raw"), norm.alias("norm"))


def _units(mention: Column, names: Column | None = None) -> Column:
    """What a mention consists of: one unit, or for a person the title (no kind) and the names, so that a surname alone and after given
    names is replaced alike. A mention of no kind is one of ``names``."""
    none = F.lit(None).cast("string")

    def person(words: Column) -> Column:
        gender = F.when(words[0].rlike(f"^(?:{FEMALE})\\.?$"), "f").otherwise("m")
        script = F.when(mention.rlike("\\p{IsCyrillic}"), "cyrillic").otherwise("latin")
        given = F.concat(F.lit("given:"), script, F.lit(":"), gender)
        surname = F.when(script == "latin", "surname:latin").otherwise(F.concat(F.lit("surname:cyrillic:"), gender))
        last = F.element_at(words, -1)
        head = F.array(_unit(none, words[0], none))
        tail = F.array(_unit(surname, last, F.lower(last)))
        middle = F.transform(F.slice(words, F.lit(2), F.size(words) - 2), lambda w: _unit(given, w, F.lower(w)))
        return F.concat(head, middle, tail)

    def one(kind: Column) -> Column:
        norm = (
            F.when(kind == "email", F.lower(mention))
            .when(kind.isin("phone", "card", "ssn"), F.regexp_replace(mention, "[^0-9]", ""))
            .otherwise(mention)
        )
        out = F.when(kind == "person", let(F.split(mention, " "), person))
        if names is not None:
            again = F.get(F.filter(names, lambda n: (n["raw"] == mention) | (F.upper(n["raw"]) == mention)), F.lit(0))
            out = out.when(kind.isNull(), F.array(_unit(again["kind"], mention, again["norm"])))
        return out.otherwise(F.array(_unit(kind, mention, norm)))

    return let(_kind(mention), one)


def _names(value: Column) -> Column:
    """The names of the persons with a title in a text, as units."""
    titled = F.flatten(F.transform(F.regexp_extract_all(value, F.lit(KINDS["person"]), F.lit(0)), lambda m: _units(m)))
    found = F.array_distinct(F.filter(titled, lambda u: u["kind"].isNotNull()))
    return F.when(value.rlike(TITLED), found).otherwise(F.filter(titled, lambda u: F.lit(False)))


def _pattern(names: Column) -> Column:
    """What is found in a text with these names: they are found again, as written or in capitals."""
    raw = F.array_distinct(F.flatten(F.transform(names, lambda n: F.array(n["raw"], F.upper(n["raw"])))))
    # longer names first, as one may begin another
    raw = F.transform(F.sort_array(F.transform(raw, lambda r: F.struct(F.length(r), r.alias("r"))), asc=False), lambda x: x["r"])
    again = F.concat(F.lit(f"{PATTERN}|{_LEFT}(?:"), F.array_join(raw, "|"), F.lit(f"){_RIGHT}"))
    return F.when(F.size(names) > 0, again).otherwise(F.lit(PATTERN))


def luhn(digits: Column) -> Column:
    """The checksum of a card number, 0 if it is valid."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)
    ))
    return F.aggregate(F.filter(values, lambda v: v.isNotNull()), F.lit(0), lambda a, v: a + v) % 10


def _by_class(value: Column, stream: Column, digits: Column) -> Column:
    """Letters for letters and digits for digits, from the hash; other signs stay."""
    letters = F.translate(stream, "0123456789abcdef", "abcdefghijklmnop")
    at = lambda s, i: F.substr(s, (i % 128 + 1).cast("int"), F.lit(1))
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike("^[0-9]$"), at(digits, i)).when(
        c.rlike("^\\p{Lu}$"), F.upper(at(letters, i))
    ).when(c.rlike("^\\p{L}$"), at(letters, i)).otherwise(c)), "")


def surrogate(kind: Column, norm: Column, key: str, turn: int) -> Column:
    """The normal form of a surrogate from round ``turn`` of the hash; later rounds of names and addresses are longer."""
    seed = F.concat_ws("\x01", F.lit(key), kind, norm, F.lit(str(turn)))
    stream = F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("\x01")), 256))

    def of(h: Column) -> Column:
        digits = F.translate(h, "abcdef", "012345")
        plain = F.substr(digits, F.lit(1), F.length(norm))
        # the last digit is set so that a valid number gives a valid one
        body = F.substr(plain, F.lit(1), F.length(norm) - 1)
        check = (10 - luhn(F.concat(body, F.lit("0")))) % 10
        card = F.when(luhn(norm) == 0, F.concat(body, check.cast("string"))).otherwise(plain)
        octet = lambda i: (F.conv(F.substring(h, 1 + 2 * i, 2), 16, 10).cast("int") % 254 + 1).cast("string")
        ip = F.concat_ws(".", *[octet(i) for i in range(4)])
        box, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
        host = F.sha2(F.concat_ws("\x01", F.lit(key), domain), 256)
        host = F.concat(host, host)
        top = F.substring_index(domain, ".", -1)
        inner = F.substr(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
        email = F.concat(
            _by_class(box, h, digits), F.substring(digits, 100, turn), F.lit("@"), _by_class(inner, host, F.translate(host, "abcdef", "012345")), F.lit("."), top
        )
        mark = F.regexp_extract(norm, "^(AKIA|gh[pousr]_|sk-)", 1)
        rest = F.substr(norm, F.length(mark) + 1, F.length(norm))
        hexes = F.substr(h, F.lit(1), F.length(norm))
        secret = F.when(norm.rlike("^[0-9a-f]+$"), hexes).when(norm.rlike("^[0-9A-F]+$"), F.upper(hexes)).otherwise(
            F.concat(mark, _by_class(rest, h, digits))
        )

        def name(script: str) -> Column:
            parts = F.array(*[F.lit(s) for s in SYLLABLES[script]])
            number = lambda i: F.conv(F.substring(h, 1 + 2 * i, 2), 16, 10).cast("int") % len(SYLLABLES[script])
            return F.concat(*[F.get(parts, number(i)) for i in range(3 + turn // 2)])

        names = F.lit(None).cast("string")
        for which, ending in ENDINGS.items():
            names = F.when(kind == which, F.concat(name(which.split(":")[1]), F.lit(ending))).otherwise(names)
        return (
            F.when(kind == "email", email).when(kind == "secret", secret).when(kind == "ip", ip).when(kind == "card", card)
            .when(kind.isin("phone", "ssn"), plain).otherwise(names)
        )

    return let(stream, of)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, surrogate): different entities of a kind get different surrogates, none of which is an entity itself.

    ``entities``: distinct (kind, norm), stored. Of those that clash the first by code point keeps its surrogate, the others go
    on to the next round; what is left after the last round (a kind whose format has no room) gets a tag with its hash.
    """
    real = entities.select("kind", F.col("norm").alias("surrogate"))
    pending, parts = entities, []
    for turn in range(ROUNDS):
        made = pending.select("kind", "norm", surrogate(F.col("kind"), F.col("norm"), key, turn).alias("surrogate"))
        free = made.join(real, ["kind", "surrogate"], "left_anti")
        for part in parts:
            free = free.join(part, ["kind", "surrogate"], "left_anti")
        won = stored(free.groupBy("kind", "surrogate").agg(F.min("norm").alias("norm")))
        parts.append(won)
        pending = stored(pending.join(won, ["kind", "norm"], "left_anti"))
        if not pending.take(1):
            break
    tag = F.concat(F.lit("["), F.col("kind"), F.lit("-"), F.sha2(F.concat_ws("\x01", F.lit(key), "norm"), 256), F.lit("]"))
    out = pending.select("kind", "norm", tag.alias("surrogate"))
    for part in parts:
        out = out.unionByName(part)
    return out


def _shown(kind: Column, raw: Column, made: Column) -> Column:
    """The surrogate in the format of the mention: punctuation of numbers, capitals of names and addresses."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(a: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(
            F.concat(a["out"], F.when(digit, F.substr(made, a["at"], F.lit(1))).otherwise(c)).alias("out"),
            (a["at"] + F.when(digit, 1).otherwise(0)).alias("at"),
        )

    numbers = F.aggregate(F.split(raw, ""), start, step, lambda a: a["out"])
    named = F.when(F.upper(raw) == raw, F.upper(made)).otherwise(F.initcap(made))
    return (
        F.when(made.startswith("["), made)
        .when(kind.isin("phone", "card", "ssn"), numbers)
        .when(kind == "email", F.when(F.upper(raw) == raw, F.upper(made)).otherwise(made))
        .when(kind.startswith("given") | kind.startswith("surname"), named)
        .otherwise(made)
    )


def replace(docs: DataFrame, key: str, text: str = "text", out: str = "entities") -> DataFrame:
    """``docs`` with entities replaced in ``text``, and ``out``: array<struct<kind, surrogate>> in order (empty if there are none).

    Null and empty texts, and texts without an entity, stay as they are and are not shuffled. Equal texts are replaced alike; a mention that many texts
    share is assigned once. Only texts with entities move, keyed by their hash: a group of copies is one row on the other side of the
    join, so the planner can split it. Rows are neither dropped nor added, an empty table stays empty, a column named like ``out`` is replaced.
    """
    rest = [c for c in docs.columns if c != out]
    kind = "array<struct<kind: string, surrogate: string>>"
    value = F.col(f"`{text}`")
    has = F.coalesce(value.rlike(HINT) & value.rlike(PATTERN), F.lit(False))
    clean = docs.filter(~has).select(*[F.col(f"`{c}`") for c in rest], F.array().cast(kind).alias(out))
    found = docs.filter(has)
    print_ = F.md5(value)
    mentions = let(_names(value), lambda names: F.transform(F.regexp_extract_all(value, _pattern(names), F.lit(0)), lambda m: _units(m, names)))
    kept = stored(found.select(print_.alias("print"), mentions.alias("mentions")).groupBy("print").agg(F.any_value("mentions").alias("mentions")))
    flat = kept.select("print", F.posexplode("mentions").alias("at", "units")).select(
        "print", "at", F.posexplode("units").alias("part", "unit")
    ).select("print", "at", "part", "unit.kind", "unit.raw", "unit.norm")
    entities = stored(flat.filter("kind IS NOT NULL").select("kind", "norm").distinct())
    made = stored(assign(entities, key))
    shown = flat.join(made, ["kind", "norm"], "left").select(
        "print", F.struct("at", "part", F.when(F.col("kind").isNull(), F.col("raw")).otherwise(
            _shown(F.col("kind"), F.col("raw"), F.col("surrogate"))
        ).alias("shown"), "kind").alias("piece")
    )
    p, r, g = fresh(docs, "print", "pieces", "gaps")
    pieces = shown.groupBy(F.col("print").alias(p)).agg(F.sort_array(F.collect_list("piece")).alias(r))
    joined = found.withColumn(p, print_).join(pieces, p).withColumn(g, let(_names(value), lambda names: F.split(value, _pattern(names), -1)))
    gaps = F.col(g)
    new = F.concat(
        F.array_join(F.transform(F.col(r), lambda x: F.concat(F.when(x["part"] == 0, F.get(gaps, x["at"])).otherwise(" "), x["shown"])), ""),
        F.element_at(gaps, -1),
    )
    listed = F.transform(F.filter(F.col(r), lambda x: x["kind"].isNotNull()), lambda x: F.struct(x["kind"].alias("kind"), x["shown"].alias("surrogate")))
    changed = joined.select(*[(new.alias(c) if c == text else F.col(f"`{c}`")) for c in rest], listed.cast(kind).alias(out))
    return clean.unionByName(changed)
