"""URL canonical forms (T37) and section numbers in URLs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quire.functions.text import col, sub


def trimmed(c) -> Column:
    """Trailing slashes removed."""
    return sub(col(c), r"/+\z")


def absolute(c, base: str) -> Column:
    return F.when(F.startswith(col(c), F.lit("http")), col(c)).otherwise(F.concat(F.lit(base), col(c)))


def host(c) -> Column:
    """Lowercased host without a leading www."""
    return sub(F.lower(F.regexp_extract(col(c), r"\A[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"\Awww\.")


def with_host(c, new_host: str) -> Column:
    return sub(col(c), r"\A(https?://)[^/]+", f"$1{new_host}")


def path(c) -> Column:
    return F.regexp_extract(col(c), r"\A[a-z]+://[^/?#]*([^?#]*)", 1)


def work_slug(c, detail_prefix: str = "truyen/", section_mark: str = "/chuong-") -> Column:
    """Work slug of a detail or section URL."""
    p = sub(sub(path(trimmed(col(c))), r"\A/+"), r"/+\z")
    return F.when(F.startswith(p, F.lit(detail_prefix)), F.substr(p, F.lit(len(detail_prefix) + 1))).otherwise(
        F.substring_index(p, section_mark, 1)
    )


def book_id(c) -> Column:
    """Numeric id after ``/book/``, else null."""
    return F.nullif(F.regexp_extract(col(c), r"/book/(\d+)", 1), F.lit(""))


def section_number(c, index) -> Column:
    """Number in the URL, else (none, or one above int) the 0-based index plus one."""
    c = col(c)
    found = F.coalesce(
        F.nullif(F.regexp_extract(c, r"chuong[- ]?(\d+)", 1), F.lit("")),
        F.nullif(F.regexp_extract(c, r"chapter[- ]?(\d+)", 1), F.lit("")),
    )
    return F.coalesce(found.try_cast("int"), (col(index) + 1).cast("int"))
