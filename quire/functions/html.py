"""Extraction from raw HTML as column expressions; no page leaves the JVM."""

from __future__ import annotations

import re
from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

from quire.functions.text import SPACE, col, let, lines, strip, sub

NOISE = ("script", "style", "iframe", "button", "ins")
# the named references, from the standard table: one node in the plan, folded to a literal
_NAMED = " ".join(f"{name}={chr(cp)}" for name, cp in name2codepoint.items() if name != "amp")


def without(html, tags=NOISE) -> Column:
    """Comments and whole elements of the given tags removed, with all that is nested in them."""
    html = sub(col(html), r"(?s)<!--.*?-->")
    plain = [t for t in tags if t in RAW]
    if plain:
        html = sub(html, rf"(?is)<({'|'.join(plain)})\b[^>]*>.*?</\1\s*>")
    for tag in tags:
        if tag not in RAW:
            html = without_elements(html, tag)
    return html


#: Elements whose content is no markup: the first end tag closes them.
RAW = ("script", "style", "iframe")


def _parts(html: Column, tag: str) -> Column:
    """A page cut before every start tag of ``tag`` and round every end tag."""
    closed = sub(html, rf"(?i)</{tag}\s*>", f"</{tag}>")
    return F.split(closed, rf"(?=<(?i:{tag})[\s/>])|(?=</{tag}>)|(?<=</{tag}>)")


def _step(part: Column, tag: str) -> Column:
    """What a part adds to the depth; a tag that closes itself adds nothing."""
    opens = part.rlike(rf"(?is)\A<{tag}[\s/>]") & ~part.rlike(rf"(?is)\A<{tag}(?:\s[^>]*)?/>")
    return F.when(part == f"</{tag}>", F.lit(-1)).when(opens, F.lit(1)).otherwise(F.lit(0))


def without_elements(html, tag: str, marked: str = "") -> Column:
    """Whole elements of ``tag`` removed whose start tag matches ``marked``, however deep elements of that tag are nested in them. One that
    is never closed goes to the end of the page."""
    start = rf"(?is)\A<{tag}(?=[\s/>])[^>]*{marked}[^>]*>"

    def cut(parts: Column) -> Column:
        marks = F.transform(parts, lambda p, i: F.struct(i.alias("i"), _step(p, tag).alias("step"), p.rlike(start).alias("hit")))
        # only the runs of parts that stay are collected; ``begin`` is where the open one starts
        empty = F.array().cast("array<struct<a:int,n:int>>")
        first = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("begin"), empty.alias("runs"))

        def walk(at: Column, m: Column) -> Column:
            outside, depth = at["depth"] == 0, at["depth"] + m["step"]
            enters = outside & m["hit"] & (m["step"] == 1)
            run = F.struct((at["begin"] + 1).alias("a"), (m["i"] - at["begin"]).alias("n"))
            return F.struct(
                F.when(outside, F.when(enters, F.lit(1)).otherwise(F.lit(0))).otherwise(depth).alias("depth"),
                F.when(~outside & (depth == 0), m["i"] + 1).otherwise(at["begin"]).alias("begin"),
                F.when(enters, F.concat(at["runs"], F.array(run))).otherwise(at["runs"]).alias("runs"),
            )

        def close(at: Column) -> Column:
            last = F.struct((at["begin"] + 1).alias("a"), (F.size(parts) - at["begin"]).alias("n"))
            return F.when(at["depth"] == 0, F.concat(at["runs"], F.array(last))).otherwise(at["runs"])

        kept = F.aggregate(marks, first, walk, close)
        return F.array_join(F.transform(kept, lambda r: F.array_join(F.slice(parts, r["a"], r["n"]), "")), "")

    return let(col(html), lambda x: F.when(x.rlike(start.replace(r"\A", "")), let(_parts(x, tag), cut)).otherwise(x))


def until_closed(html, tag: str) -> Column:
    """A page that begins inside an element of ``tag``, up to the end tag that closes it; all of it where none does."""

    def cut(parts: Column) -> Column:
        steps = F.transform(parts, lambda p, i: F.struct(i.alias("i"), _step(p, tag).alias("step")))
        first = F.struct(F.lit(1).alias("depth"), F.size(parts).alias("end"))

        def walk(at: Column, m: Column) -> Column:
            depth = F.when(at["depth"] == 0, F.lit(0)).otherwise(at["depth"] + m["step"])
            return F.struct(depth.alias("depth"), F.when((at["depth"] > 0) & (depth == 0), m["i"]).otherwise(at["end"]).alias("end"))

        return F.array_join(F.slice(parts, F.lit(1), F.aggregate(steps, first, walk, lambda at: at["end"])), "")

    # most elements hold no other of their tag: the first end tag is theirs
    near = F.regexp_extract(col(html), rf"(?is)\A(.*?)(?:</{tag}\s*>|\z)", 1)
    return let(F.struct(near.alias("near"), col(html).alias("all")), lambda x: F.when(
        ~x["near"].rlike(rf"(?i)<{tag}[\s/>]"), x["near"]).otherwise(let(_parts(x["all"], tag), cut)))


def without_blocks(html, css_class: str, tag: str = "div") -> Column:
    """Elements of a class removed (ad and read-more blocks), with all that is nested in them."""
    return without_elements(html, tag, rf"""class=["'][^"']*\b{re.escape(css_class)}\b[^"']*["']""")


def unescape(c) -> Column:
    """Character references decoded, each once."""
    return let(col(c), lambda x: F.when(F.contains(x, F.lit("&")), _decoded(x)).otherwise(x))


def _decoded(c: Column) -> Column:
    table = F.str_to_map(F.lit(_NAMED), F.lit(" "), F.lit("="))
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"), F.lit(0)))
    found = F.filter(found, lambda e: e != "&amp;")

    def char(code):
        # what is no character, a surrogate or beyond the last one, reads as the replacement character
        bad = (code <= 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        return F.decode(F.unhex(F.lpad(F.hex(F.when(bad, F.lit(0xFFFD).cast("bigint")).otherwise(code)), 8, "0")), "UTF-32")

    def value(e):
        name = F.substring(e, F.lit(2), F.length(e) - 2)
        return (
            F.when(F.lower(F.substring(name, 1, 2)) == "#x", char(F.conv(F.substring(name, F.lit(3), F.length(name)), 16, 10).cast("bigint")))
            .when(F.substring(name, 1, 1) == "#", char(F.substring(name, F.lit(2), F.length(name)).cast("bigint")))
            .otherwise(F.coalesce(F.try_element_at(table, name), e))
        )

    # a decoded ampersand must not form a new reference, so it goes last
    return F.replace(F.aggregate(found, c, lambda acc, e: F.replace(acc, e, value(e))), F.lit("&amp;"), F.lit("&"))


def inner_text(c) -> Column:
    """Text of a fragment: every text node stripped, tags gone, references decoded."""
    return strip(unescape(strip(sub(col(c), rf"[{SPACE}]*<[^>]+>[{SPACE}]*"))))


def elements(html, tag: str) -> Column:
    """Inner HTML of every ``tag`` element, in order."""
    return F.regexp_extract_all(col(html), F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>"), F.lit(1))


#: Elements that hold others of their kind.
NESTING = ("div", "section", "article", "ul", "ol", "span", "table")


def first_element(html, tag: str, attribute: str | None = None) -> Column:
    """Inner HTML of the first ``tag`` element whose start tag matches ``attribute``; '' when there is none."""
    if tag in NESTING:
        return region(html, rf"(?i:<{tag}(?=[\s>])[^>]*{attribute or ''}[^>]*>)", f"</{tag}>")
    inside = rf"\s[^>]*{attribute}[^>]*" if attribute else r"(?:\s[^>]*)?"
    return F.regexp_extract(col(html), rf"(?is)<{tag}{inside}>(.*?)</{tag}\s*>", 1)


def attribute_of(html, tag: str, name: str, marked: str = "") -> Column:
    """Attribute of the first ``tag`` whose start tag matches ``marked``; '' when there is none."""
    start = F.regexp_extract(col(html), rf"(?is)<{tag}\b(?=[^>]*{marked})[^>]*>", 0)
    return unescape(F.regexp_extract(start, rf"""(?is)\b{name}\s*=\s*["']([^"']*)["']""", 1))


def meta(html, key: str) -> Column:
    """H2: content of a meta tag by property or name."""
    return strip(attribute_of(html, "meta", "content", rf"""(?:property|name)\s*=\s*["']{re.escape(key)}["']"""))


def paragraph_texts(
    html, min_length: int = 0, no_urls: bool = False, skip: str | None = None, numbering: str = r"\A\d+[.)]?\s*\z"
) -> Column:
    """H8 / H9: texts of the paragraphs. Numbering-only ones go, so do those of ``min_length`` or less, with a URL,
    or whose inner HTML matches ``skip`` (an emphasis tag, a class)."""
    blocks = elements(without(html), "p")
    if skip:
        blocks = F.filter(blocks, lambda b: ~b.rlike(skip))
    texts = F.transform(blocks, lambda b: strip(sub(inner_text(b), numbering)))
    keep = lambda x: F.length(x) > min_length
    if no_urls:
        return F.filter(texts, lambda x: keep(x) & ~x.rlike(r"https?://"))
    return F.filter(texts, keep)


def section_text(html, **rules) -> Column:
    """H8: paragraphs joined by a blank line; without paragraphs, the lines of the text."""
    paras = paragraph_texts(html, **rules)
    plain = lines(unescape(sub(without(html), r"<[^>]+>", "\n")))
    return let(paras, lambda x: F.when(F.size(x) > 0, F.array_join(x, "\n\n")).otherwise(F.array_join(plain, "\n\n")))


def region(html, start: str, end: str) -> Column:
    """What lies between two markers (patterns), to the end when the second is missing. Where the second is an end tag, the one
    that closes the element in which the region begins, not that of an element within it."""
    tag = re.fullmatch(r"</([a-z][a-z0-9]*)>", end)
    if tag:
        return until_closed(F.regexp_extract(col(html), rf"(?s){start}(.*)\z", 1), tag[1])
    return F.regexp_extract(col(html), rf"(?s){start}(.*?)(?:{end}|\z)", 1)


def hrefs(html, pattern: str = "", base: str = "") -> Column:
    """H5: link targets matching ``pattern``, made absolute, each once, in page order."""
    found = F.regexp_extract_all(col(html), F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1))
    found = F.filter(F.transform(found, lambda h: strip(unescape(h))), lambda h: (h != "") & h.rlike(pattern))
    return F.array_distinct(F.transform(found, lambda h: F.when(F.startswith(h, F.lit("http")), h).otherwise(F.concat(F.lit(base), h))))


def cards(html, pattern: str = "", base: str = "", suffix: str = r"\z") -> Column:
    """H6: (url, title) of every link with text, a trailing ``suffix`` cut off the title."""
    found = F.regexp_extract_all(col(html), F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["'][^"']*["'][^>]*>.*?</a\s*>"""), F.lit(0))
    pairs = F.transform(
        found,
        lambda a: F.struct(
            strip(unescape(F.regexp_extract(a, r"""(?is)href\s*=\s*["']([^"']*)["']""", 1))).alias("url"),
            strip(sub(inner_text(a), suffix)).alias("title"),
        ),
    )
    kept = F.filter(pairs, lambda x: (x["url"] != "") & (x["title"] != "") & x["url"].rlike(pattern))
    return F.transform(
        kept,
        lambda x: F.struct(
            F.when(F.startswith(x["url"], F.lit("http")), x["url"]).otherwise(F.concat(F.lit(base), x["url"])).alias("url"), x["title"].alias("title")
        ),
    )


def json_ld(html, path: str) -> Column:
    """H3: first non-empty value at ``path`` in the JSON-LD scripts. A script may hold one object, a list of them or a graph, and an object may tell of
    its main entity; what is no JSON is passed by."""
    scripts = F.regexp_extract_all(col(html), F.lit(r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))

    def objects(script: Column) -> Column:
        whole = F.try_parse_json(script)
        none = F.array().cast("array<variant>")
        listed = F.coalesce(F.try_variant_get(whole, "$", "array<variant>"), none)
        graph = F.coalesce(F.try_variant_get(whole, '$["@graph"]', "array<variant>"), none)
        top = F.concat(F.array(whole), graph, listed)
        return F.concat(top, F.transform(top, lambda o: F.try_variant_get(o, "$.mainEntity", "variant")))

    found = F.transform(F.flatten(F.transform(scripts, objects)), lambda o: F.try_variant_get(o, path, "string"))
    return F.get(F.filter(found, lambda v: v.isNotNull() & (v != "")), F.lit(0))


def next_data(html) -> Column:
    """H4: the embedded page data."""
    return F.regexp_extract(col(html), r"""(?is)<script[^>]*id=["']__NEXT_DATA__["'][^>]*>(.*?)</script>""", 1)


def next_data_sections(html, base: str, book) -> Column:
    """H4: section URLs from the id and name pairs in the page data; generic pairs when there are no section pairs."""

    def pairs(id_key, name_key):
        return F.regexp_extract_all(next_data(html), F.lit(rf'"{id_key}"\s*:\s*"\d+"[^}}]*?"{name_key}"\s*:\s*"[^"]+"'), F.lit(0))

    def link(id_key, name_key):
        def build(p):
            name = F.lower(F.regexp_extract(p, rf'"{name_key}"\s*:\s*"([^"]+)"\z', 1))
            slug = sub(sub(name, "[^a-z0-9]+", "-"), r"\A-+|-+\z")
            slug = F.when(slug == "", F.lit("chapter")).otherwise(slug)
            book_part = F.coalesce(F.concat(col(book), F.lit("_book")), F.lit("book"))
            return F.concat(F.lit(f"{base}/book/"), book_part, F.lit("/"), F.regexp_extract(p, r'"(\d+)"', 1), F.lit("_"), slug)

        return build

    own = F.transform(pairs("chapterId", "chapterName"), link("chapterId", "chapterName"))
    return F.when(F.size(own) > 0, own).otherwise(F.transform(pairs("id", "name"), link("id", "name")))


def next_data_text(html) -> Column:
    """H4: section text in the page data: the first of the known keys with fifty or more characters."""
    data = next_data(html)
    value = None
    for key in ("content", "chapterContent", "text"):
        raw = F.nullif(F.regexp_extract(data, rf'"{key}"\s*:\s*"([^"\\]*+(?:\\.[^"\\]*+)*+)"', 1), F.lit(""))
        raw = F.when(F.length(raw) >= 50, raw)
        value = raw if value is None else F.coalesce(value, raw)
    text = F.get_json_object(F.concat(F.lit('{"v":"'), value, F.lit('"}')), "$.v")
    paras = F.filter(F.transform(elements(text, "p"), inner_text), lambda x: x != "")
    return F.coalesce(F.when(F.size(elements(text, "p")) > 0, F.array_join(paras, "\n\n")).otherwise(inner_text(text)), F.lit(""))


def option_numbers(html) -> Column:
    """H7: numeric values of the options."""
    found = F.regexp_extract_all(col(html), F.lit(r"""(?is)<option[^>]*\bvalue=["'](\d+)["']"""), F.lit(1))
    return F.filter(F.transform(found, lambda x: x.try_cast("int")), lambda x: x.isNotNull())


def canonical(html) -> Column:
    return attribute_of(html, "link", "href", r"""rel\s*=\s*["']canonical["']""")
