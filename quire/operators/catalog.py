"""Audit, lookup and matching over works and sections.

Sections are reduced to one row per work before they meet the works table, so the joins here carry counts, not texts;
where section rows themselves join their work, the works side is the small one and the adaptive planner broadcasts it
by its measured size or splits the hot work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.functions import predicates as p
from quire.functions import urls
from quire.operators.held import held, without_held


def section_counts(sections: DataFrame, name: str = "sections") -> DataFrame:
    """A5."""
    return sections.groupBy("work_id").agg(F.count(F.lit(1)).alias(name))


def with_counts(works: DataFrame, sections: DataFrame, name: str = "sections") -> DataFrame:
    """Every work with its number of sections, 0 where it has none."""
    counted = works.join(section_counts(sections, name), "work_id", "left")
    return counted.withColumn(name, F.coalesce(name, F.lit(0)))


def thin_works(works: DataFrame, sections: DataFrame, limit: int = 5) -> DataFrame:
    """A1: published works with fewer than ``limit`` published sections."""
    counted = with_counts(works.filter(p.is_published()), sections.filter(p.is_published()))
    return counted.filter(F.col("sections") < limit)


def few_sections(works: DataFrame, sections: DataFrame, limit: int = 5) -> DataFrame:
    """Works with at least one and fewer than ``limit`` published sections."""
    counted = with_counts(works, sections.filter(p.is_published()))
    return counted.filter((F.col("sections") > 0) & (F.col("sections") < limit))


def unenriched_works(works: DataFrame) -> DataFrame:
    """Published works that miss review, analysis or FAQ, with what they have."""
    return works.filter(p.is_published() & p.work_unenriched()).select(
        "slug", "title",
        (~p.is_blank("editorial_review")).alias("has_review"),
        (~p.is_blank("character_analysis")).alias("has_analysis"),
        (~p.is_blank("faq")).alias("has_faq"),
    )


def weak_descriptions(works: DataFrame, limit: int = 80) -> DataFrame:
    return works.filter(p.is_published() & p.is_weak_description(limit)).select(
        "slug", "title", F.length(F.coalesce("description", F.lit(""))).alias("description_length")
    )


def _named(works: DataFrame) -> DataFrame:
    return works.select("work_id", F.col("slug").alias("work_slug"), F.col("title").alias("work_title"))


def unenriched_sections(works: DataFrame, sections: DataFrame) -> DataFrame:
    """Published sections without summary or highlight."""
    rows = sections.filter(p.is_published() & p.section_unenriched())
    return rows.select("section_id", "work_id", "number", "title", "word_count").join(_named(works), "work_id")


def short_sections(works: DataFrame, sections: DataFrame, min_words: int = 300) -> DataFrame:
    """Published sections below ``min_words``; the status of the work is not considered."""
    rows = sections.filter(p.is_published() & p.is_short(min_words))
    return rows.select("work_id", "number", "title", "word_count").join(_named(works), "work_id")


def shortest(works: DataFrame, sections: DataFrame, min_words: int = 300, limit: int = 200) -> DataFrame:
    """L1: the report lists the ``limit`` shortest."""
    return short_sections(works, sections, min_words).orderBy("word_count", "work_slug", "number").limit(limit)


def missing_fields(works: DataFrame) -> DataFrame:
    """Names of the enrichments a published work lacks."""
    missing = F.array_compact(
        F.array(
            F.when(p.is_blank("editorial_review"), F.lit("review")),
            F.when(p.is_blank("character_analysis"), F.lit("analysis")),
            F.when(p.is_blank("faq"), F.lit("faq")),
        )
    )
    return works.filter(p.is_published()).select("slug", missing.alias("missing")).filter(F.size("missing") > 0)


def find_work(works: DataFrame, sections: DataFrame, keyword: str) -> DataFrame:
    """F8: the work whose id, slug or title matches, the id first, then the slug, then the title."""
    k = keyword.lower()
    hit = (
        F.when(F.col("work_id") == keyword, 1)
        .when(F.col("slug") == keyword, 2)
        .when(F.contains(F.lower("title"), F.lit(k)), 3)
    )
    best = works.withColumn("_rank", hit).filter("_rank is not null").orderBy("_rank", "slug").limit(1)
    return best.drop("_rank")


def with_any(works: DataFrame, qualifying: DataFrame) -> DataFrame:
    """Works that own at least one of the qualifying sections."""
    return works.join(qualifying.select("work_id").distinct(), "work_id", "left_semi")


def new_listings(listing: DataFrame, works: DataFrame) -> DataFrame:
    """Listed (slug, title) pairs known neither by slug nor by title."""
    titles = works.select(F.lower(F.trim("title")).alias("_t")).distinct()
    unseen = listing.join(works.select("slug").distinct(), "slug", "left_anti")
    return unseen.join(titles, F.lower(F.trim(F.col("title"))) == F.col("_t"), "left_anti")


def missing_sections(incoming: DataFrame, sections: DataFrame) -> DataFrame:
    """Incoming rows whose (work, number) is not stored."""
    return without_held(incoming, held(sections))


def match_works(incoming: DataFrame, works: DataFrame) -> DataFrame:
    """The stored work of each incoming row by source URL, else slug, else title."""

    def by(key, name):
        return works.filter(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(F.col(key).alias(f"_{name}")).agg(
            F.min("work_id").alias(f"_by_{name}")
        )

    out = incoming.join(by("source_url", "url"), urls.trimmed(F.col("source_url")) == F.col("_url"), "left")
    out = out.join(by("slug", "slug"), F.col("slug") == F.col("_slug"), "left")
    out = out.join(by("title", "title"), F.col("title") == F.col("_title"), "left")
    return out.select(*incoming.columns, F.coalesce("_by_url", "_by_slug", "_by_title").alias("matched_work_id"))


def match_domains(pages: DataFrame, domains: DataFrame, url: str = "url") -> DataFrame:
    """The first registered source whose domain equals the host or is a dotted suffix of it, or the reverse.

    The theta condition becomes an equi-join on suffixes: each side offers itself and all its dotted suffixes, and a
    pair matches when the whole of one is among those of the other.
    """

    def suffixes(c):
        parts = F.split(c, r"\.")
        return F.transform(
            F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")
        )

    hosts = pages.select(urls.host(url).alias("host")).distinct().filter("host <> ''")
    doms = domains.select(
        F.regexp_replace(F.lower("domain"), r"\Awww\.", "").alias("domain"), "source", "reg_order"
    )
    down = hosts.withColumn("domain", F.explode(suffixes(F.col("host")))).join(doms, "domain")
    up = doms.withColumn("host", F.explode(suffixes(F.col("domain")))).join(hosts, "host")
    pairs = down.select("host", "source", "reg_order").unionByName(up.select("host", "source", "reg_order"))
    first = pairs.groupBy("host").agg(F.min_by("source", "reg_order").alias("source"))
    return pages.withColumn("host", urls.host(url)).join(first, "host", "left")


def conserved(before: DataFrame, after: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Per work the words before and after, and whether they differ by at most ``tolerance``."""
    old = before.groupBy("work_id").agg(F.sum("word_count").alias("words_before"))
    new = after.groupBy("work_id").agg(F.sum("word_count").alias("words_after"))
    both = old.join(new, "work_id", "left").withColumn("words_after", F.coalesce("words_after", F.lit(0)))
    return both.withColumn(
        "conserved", F.abs(F.col("words_after") - F.col("words_before")) <= F.col("words_before") * tolerance
    )


def status_totals(outcomes: DataFrame) -> DataFrame:
    """Rows and words per outcome status."""
    return outcomes.groupBy("status").agg(F.count(F.lit(1)).alias("rows"), F.sum("amount").alias("amount"))


def newest_copy(copies: DataFrame) -> DataFrame:
    """K3: per slug the flat copy if there is one, else the copy of the latest day; and whether days compete.

    ``copies``: slug, path, day (null for a flat copy).
    """
    rank = F.struct(F.col("day").isNull().alias("flat"), F.coalesce("day", F.lit("")).alias("day"), "path")
    return copies.groupBy("slug").agg(
        F.max_by("path", rank).alias("path"),
        ((F.count_if(F.col("day").isNull()) == 0) & (F.count(F.lit(1)) > 1)).alias("ambiguous"),
    )
