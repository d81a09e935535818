"""Boolean column expressions (filters)."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from quire.functions import rules
from quire.functions.text import SPACE, col


def is_blank(c) -> Column:
    """Null and the empty string both mean missing."""
    return col(c).isNull() | (col(c) == "")


def is_published(c="publish_status") -> Column:
    """F1."""
    return col(c) == "published"


def section_unenriched() -> Column:
    """summary or highlight missing; the preview is not considered."""
    return is_blank("summary") | is_blank("highlight")


def work_unenriched() -> Column:
    """F3, audit form: any of the three missing."""
    return is_blank("editorial_review") | is_blank("character_analysis") | is_blank("faq")


def work_needs_enriching() -> Column:
    """F3, stricter form: an empty FAQ list also counts as missing."""
    return work_unenriched() | (F.col("faq") == "[]")


def has_any(*columns) -> Column:
    """at least one of the columns is filled."""
    out = ~is_blank(columns[0])
    for c in columns[1:]:
        out = out | ~is_blank(c)
    return out


def is_short(limit: int, c="word_count") -> Column:
    """F5."""
    return col(c) < limit


def is_weak_description(limit: int = 80, c="description") -> Column:
    """F6."""
    return F.length(F.coalesce(col(c), F.lit(""))) < limit


def is_generic_title(c="title") -> Column:
    """F7."""
    return col(c).rlike(r"^Phần [0-9]")


def contains_text(c, needle: str) -> Column:
    """case-insensitive substring."""
    return F.contains(F.lower(col(c)), F.lit(needle.lower()))


def long_enough(c="content", limit: int = 50) -> Column:
    """F11."""
    return F.length(F.coalesce(col(c), F.lit(""))) >= limit


def within_hours(c, as_of: Column, hours: int) -> Column:
    """trailing window before ``as_of``."""
    return (col(c) > as_of - F.make_interval(hours=F.lit(hours))) & (col(c) <= as_of)


def is_work_url(c, base: str, stop=rules.NON_WORK_PATHS) -> Column:
    """``base`` plus exactly one path segment that is not in the stop list."""
    path = F.regexp_extract(col(c), rf"\A{re.escape(base)}/([^/]+)/*\z", 1)
    return (path != "") & ~path.isin(*stop)


def is_safe_prompt(c, terms=rules.UNSAFE_PROMPT_TERMS) -> Column:
    """none of the terms occurs."""
    return ~F.lower(col(c)).rlike("|".join(re.escape(t) for t in terms))


def is_blocked_sentence(c) -> Column:
    """one of the block-list patterns matches."""
    return col(c).rlike("(?diU)" + "|".join(f"(?:{p})" for p in rules.BLOCKED_SENTENCES))


def is_call_to_action(c) -> Column:
    """F16: asks the reader to listen on; three patterns."""
    c = col(c)
    return c.rlike("(?diU)" + rules.CTA_START) | c.rlike("(?diU)" + rules.CTA_FULL) | c.rlike("(?diU)" + rules.CTA_END)


def has_cjk(c) -> Column:
    """F17."""
    return F.coalesce(col(c).rlike(rules.CJK_CLASS), F.lit(False))


def is_truncated(c) -> Column:
    """does not end in a closing mark; empty counts as truncated."""
    marks = "".join("\\" + m if m in "\"')" else m for m in rules.CLOSING_MARKS).replace(".", r"\.")
    return ~F.coalesce(col(c).rlike(rf"[{marks}][{SPACE}]*\z"), F.lit(False))


def is_date_name(c) -> Column:
    """a valid YYYY-MM-DD."""
    return col(c).rlike(r"\A\d{4}-\d{2}-\d{2}\z") & F.try_to_date(col(c), "yyyy-MM-dd").isNotNull()
