"""Extraction by site: the rule set of a page is chosen by its source (J10) inside one projection, so pages of all sites are read
in one scan and no page is moved."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions import html as h
from quire.functions import urls
from quire.operators import catalog
from quire.operators.extract import InfoRules, info_fields


@dataclass(frozen=True)
class Site:
    """Where a site keeps what: facts of a work, the list of sections, the text of a section.

    ``links``: start and end of the list (patterns), what a link must look like, the base of relative links and whether the newest
    comes first. ``container``: start tag of the text (pattern); ``blocks``: (tag, class) of what is cut out of it before.
    """

    info: InfoRules = InfoRules()
    list_start: str = r"\A"
    list_end: str = r"\z"
    links: str = ""
    base: str = ""
    newest_first: bool = False
    container: str = r"\A"
    blocks: tuple[tuple[str, str], ...] = ()
    paragraphs: dict = field(default_factory=dict)
    fallback_lines: bool = True


def _classed(tag: str, name: str):
    return lambda x: h.first_element(x, tag, rf'class="[^"]*\b{name}\b[^"]*"')


def _author(x: Column) -> Column:
    return h.first_element(x, "a", r'href="[^"]*tac-gia')


def _cover(name: str):
    return lambda x: h.attribute_of(h.region(x, rf'<[a-z]+\s[^>]*class="[^"]*\b{name}\b[^"]*"[^>]*>', "</div>"), "img", "src")


# --- fixed values: the kinds of sites that are known, by the marks of their pages ------------------------------------
SITES = {
    "plain": Site(
        InfoRules(title=(_classed("h3", "title"),), author=(_author,), description=(_classed("div", "desc-text"),), cover=(_cover("book"),),
                  ongoing=r"đang ra|ongoing", status_in=r'<div\s[^>]*class="[^"]*\binfo\b[^"]*"[^>]*>'),
        list_start=r'<ul\s[^>]*class="[^"]*\blist-chapter\b[^"]*"[^>]*>', list_end="</ul>", container=r'<div\s[^>]*id="chapter-c"[^>]*>', blocks=(("div", "ads"),),
    ),
    "reader": Site(
        InfoRules(title=(_classed("h1", "truyen-title"), lambda x: h.first_element(x, "h1")), author=(_author, _classed("div", "info-author")), min_description=11,
                  description=(_classed("div", "description"), _classed("div", "summary-content"), _classed("div", "desc-text")), cover=(_cover("book-cover"), _cover("thumb")),
                  ongoing=r"đang ra|ongoing|chưa hoàn", status_in=r'<div\s[^>]*class="[^"]*\binfo\b[^"]*"[^>]*>'),
        links=r"/chuong-|/chapter-", list_start=r'<div\s[^>]*class="[^"]*\bchapter-list\b[^"]*"[^>]*>', list_end="</div>",
        container=r'<div\s[^>]*class="[^"]*\bchapter-content\b[^"]*"[^>]*>', blocks=(("div", "ads"), ("div", "read-more")),
    ),
    "newest_first": Site(
        InfoRules(title=(_classed("h3", "title"), lambda x: h.first_element(x, "h1")), author=(_author,), min_description=11, description=(_classed("div", "desc-text"),),
                  cover=(_cover("book"), _cover("thumb")), ongoing=r"đang ra|ongoing|chưa hoàn", status_in=r'<div\s[^>]*class="[^"]*\binfo\b[^"]*"[^>]*>'),
        links=r"/chuong-|/chapter-", list_start=r'<ul\s[^>]*class="[^"]*\blist-chapter\b[^"]*"[^>]*>', list_end="</ul>", newest_first=True,
        container=r'<div\s[^>]*id="chapter-content"[^>]*>', paragraphs={"min_length": 5, "no_urls": True, "numbering": r"\A\z"},
    ),
    "episodes": Site(
        InfoRules(title=(lambda x: h.first_element(x, "h1"), lambda x: h.first_element(x, "h2")), author=(_author,), min_description=11, description=(_classed("div", "summary"),),
                  cover=(_cover("book-cover"),), ongoing=r"\A\b\B"),
        list_start=r'<div\s[^>]*class="[^"]*\bepisode-title\b[^"]*"[^>]*>', list_end=r"</section>", container=r'<div\s[^>]*class="[^"]*\bcontent-container\b[^"]*"[^>]*>',
        paragraphs={"min_length": 10, "no_urls": True, "skip": r"<em\b", "numbering": r"\A\z"}, fallback_lines=False,
    ),
}


def with_source(pages: DataFrame, domains: DataFrame) -> DataFrame:
    """Pages with the ``source`` that J10 finds for their host; those of unknown hosts drop out."""
    return catalog.match_domains(pages, domains).filter("source is not null").drop("host")


def _by_source(sites: dict[str, Site], source: str, make) -> Column:
    out = None
    for name, site in sites.items():
        value, here = make(site), F.col(source) == name
        out = F.when(here, value) if out is None else out.when(here, value)
    return out


def work_info(pages: DataFrame, sites: dict[str, Site] = SITES, source: str = "source", html: str = "html") -> DataFrame:
    """H1 by site: title, author, description, cover, status and genres; pages of an unknown source or without a title drop out."""
    fields = {name: info_fields(F.col(html), site.info) for name, site in sites.items()}
    names = list(next(iter(fields.values())))
    rest = [c for c in pages.columns if c != html]
    picked = F.struct(*[_by_source(sites, source, lambda s, n=n: next(f[n] for k, f in fields.items() if sites[k] is s)).alias(n) for n in names])
    # the one-element explode keeps the filter below from computing the facts a second time
    out = pages.filter(F.col(source).isin(*sites)).select(*rest, F.explode(F.array(picked)).alias("_info"))
    return out.select(*rest, "_info.*").filter("title is not null")


def section_links(pages: DataFrame, sites: dict[str, Site] = SITES, source: str = "source", html: str = "html") -> DataFrame:
    """H5 by site: (…, pos, section_url, number), first section first."""

    def links(site: Site) -> Column:
        found = h.hrefs(h.region(html, site.list_start, site.list_end), site.links, site.base)
        return F.reverse(found) if site.newest_first else found

    rest = [c for c in pages.columns if c != html]
    rows = pages.filter(F.col(source).isin(*sites)).select(*rest, F.posexplode(_by_source(sites, source, links)).alias("pos", "section_url"))
    return rows.withColumn("number", urls.section_number("section_url", "pos"))


def section_texts(pages: DataFrame, sites: dict[str, Site] = SITES, source: str = "source", html: str = "html") -> DataFrame:
    """H8 / H9 by site: the text in the container, without ad and read-more blocks; '' where there is no container."""

    def body(site: Site) -> Column:
        inside = h.col(html)
        for tag, name in site.blocks:
            inside = h.without_blocks(inside, name, tag)
        inside = h.region(inside, site.container, "</div>")
        if site.fallback_lines:
            return h.section_text(inside, **site.paragraphs)
        return F.array_join(h.paragraph_texts(inside, **site.paragraphs), "\n\n")

    rest = [c for c in pages.columns if c != html]
    return pages.filter(F.col(source).isin(*sites)).select(*rest, _by_source(sites, source, body).alias("content"))
