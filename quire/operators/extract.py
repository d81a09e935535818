"""Pages to tables: work info, section links and section texts. Each page is handled where it is read."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions import html as h
from quire.functions import rules, urls
from quire.functions.text import let, strip, sub


@dataclass(frozen=True)
class InfoRules:
    """Where a site keeps the facts of a work: expressions over the page, tried in order."""

    title: tuple = (lambda x: h.first_element(x, "h1"), lambda x: h.first_element(x, "h3", r'class="[^"]*\btitle\b'))
    author: tuple = (lambda x: h.first_element(x, "a", r'href="[^"]*tac-gia'), lambda x: h.first_element(x, "a", r'itemprop="author"'))
    description: tuple = (lambda x: h.meta(x, "description"), lambda x: h.meta(x, "og:description"))
    cover: tuple = (lambda x: h.meta(x, "og:image"), lambda x: h.attribute_of(x, "img", "src"))
    genre_links: str = r"/category/|/the-loai/"
    min_description: int = 1
    ongoing: str = r"đang\s*(ra|cập\s*nhật)|ongoing|updating"
    status_in: str = r"\A"  # where the element begins that tells the status; the whole page by default
    base: str = ""
    default_author: str = "Đang cập nhật"
    extra: dict = field(default_factory=dict)


def _first(page: Column, tries, ok) -> Column:
    return F.coalesce(*[let(h.inner_text(t(page)), lambda v: F.when(ok(v), v)) for t in tries])


def info_fields(x: Column, site: InfoRules) -> dict[str, Column]:
    """H1: the facts of a work as expressions over its page."""
    page_title = strip(F.substring_index(h.inner_text(h.first_element(x, "title")), "|", 1))
    title = F.coalesce(_first(x, site.title, lambda v: (F.length(v) >= 3) & (F.length(v) <= 199)), F.nullif(page_title, F.lit("")))
    cover = _first(x, site.cover, lambda v: v != "")
    told = x if site.status_in == r"\A" else h.region(x, site.status_in, "</div>")
    return {
        "title": title,
        "author": F.coalesce(_first(x, site.author, lambda v: v != ""), F.lit(site.default_author)),
        "description": F.coalesce(_first(x, site.description, lambda v: F.length(v) >= site.min_description), F.lit("")),
        "cover_image": F.coalesce(F.when(F.startswith(cover, F.lit("http")), cover).otherwise(F.concat(F.lit(site.base), cover)), F.lit("")),
        "status": F.when(F.lower(h.inner_text(h.without(told))).rlike("(?U)" + site.ongoing), F.lit("ongoing")).otherwise(F.lit("completed")),
        "genres_raw": F.transform(F.filter(h.cards(x), lambda c: c["url"].rlike(site.genre_links)), lambda c: F.lower(c["title"])),
    }


def work_info(pages: DataFrame, site: InfoRules = InfoRules(), html: str = "html") -> DataFrame:
    """H1: title, author, description, cover, status and genres; pages without a usable title drop out."""
    out = pages.select(*[c for c in pages.columns if c != html], *[v.alias(k) for k, v in info_fields(F.col(html), site).items()])
    return out.filter("title is not null")


def meta_info(pages: DataFrame, html: str = "html") -> DataFrame:
    """H2: title, description and cover from meta tags."""
    x = F.col(html)
    return pages.select(
        *[c for c in pages.columns if c != html],
        strip(F.regexp_extract(h.meta(x, "og:title"), r"\A(.*?)(?:\s*[-|]|\z)", 1)).alias("title"),
        F.coalesce(F.nullif(h.meta(x, "description"), F.lit("")), h.meta(x, "og:description")).alias("description"),
        h.meta(x, "og:image").alias("cover_image"),
    )


def section_links(pages: DataFrame, pattern: str = "", base: str = "", html: str = "html", newest_first: bool = False) -> DataFrame:
    """H5: (…, pos, section_url, number): links of a page in reading order, each once."""
    found = h.hrefs(html, pattern, base)
    found = F.reverse(found) if newest_first else found
    rows = pages.select(*[c for c in pages.columns if c != html], F.posexplode(found).alias("pos", "section_url"))
    return rows.withColumn("number", urls.section_number("section_url", "pos"))


def listing_cards(pages: DataFrame, pattern: str = "", base: str = "", suffix: str = r"\z", html: str = "html") -> DataFrame:
    """H6: (url, title) cards of a page, the first card of each URL."""
    def first_of_each(cards):
        by_url = F.array_sort(F.transform(cards, lambda c, i: F.struct(c["url"].alias("url"), i.alias("i"), c["title"].alias("title"))))
        firsts = let(by_url, lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["url"] != x["url"], F.lit(True))))
        return F.array_sort(F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), x["url"].alias("url"), x["title"].alias("title"))))

    seen = first_of_each(h.cards(html, pattern, base, suffix))
    rows = pages.select(*[c for c in pages.columns if c != html], F.posexplode(seen).alias("pos", "_c"))
    return rows.select(*[c for c in pages.columns if c != html], "pos", F.col("_c.url").alias("card_url"), F.col("_c.title").alias("card_title"))


def generated_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """H7: section URLs 1..max from the dropdown, under the slug of the canonical link.

    A page that claims more than a hundred thousand sections gives one row without number and URL.
    """
    top = F.coalesce(F.array_max(h.option_numbers(html)), F.lit(1))
    top = F.when(top <= 100_000, top)
    real = F.nullif(urls.work_slug(h.canonical(html)), F.lit(""))
    slug = F.coalesce(real, urls.work_slug(url))
    site = F.regexp_extract(url, r"\A(https?://[^/]+)", 1)
    rows = pages.select(*[c for c in pages.columns if c != html], site.alias("_s"), slug.alias("_g"), F.explode_outer(F.sequence(F.lit(1), top)).alias("number"))
    return rows.withColumn("section_url", F.concat("_s", F.lit("/"), "_g", F.lit("/chuong-"), F.col("number").cast("string"))).drop("_s", "_g")


def section_texts(pages: DataFrame, html: str = "html", **rules_) -> DataFrame:
    """H8 / H9: one text per page."""
    return pages.select(*[c for c in pages.columns if c != html], h.section_text(html, **rules_).alias("content"))


def region_texts(pages: DataFrame, start: str, end: str, html: str = "html") -> DataFrame:
    """Paragraphs between two markers."""
    inside = h.region(html, start, end)
    texts = F.transform(h.elements(inside, "p"), lambda p: sub(h.inner_text(h.without(p, ("script", "style"))), r"\s{2,}", " "))
    kept = F.filter(texts, lambda x: F.length(x) > 1)
    return pages.select(*[c for c in pages.columns if c != html], F.array_join(kept, "\n\n").alias("content"))
