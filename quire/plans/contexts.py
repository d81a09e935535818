"""The text an external writer gets about a section or a work, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.functions import text as t
from quire.operators.catalog import with_counts
from quire.operators.ordered import Neighbour, ordered
from quire.operators.sequence import quartile_excerpt


def section_contexts(works: DataFrame, sections: DataFrame, limit: int = 2500, marker: str | None = None) -> DataFrame:
    """(work_id, number, context): work fields, the section's head and tail and the next section's title."""
    args = {} if marker is None else {"marker": marker}
    rows = sections.select("work_id", "number", "title", t.head_tail("content", limit, **args).alias("_excerpt"))
    rows = ordered(rows, "work_id", "number", next_title=Neighbour(F.col("title"), 1))
    about = works.select("work_id", F.col("title").alias("work_title"), t.default_if_blank("genres", "(unknown)").alias("genres"))
    context = F.concat_ws(
        "\n", "work_title", "genres", F.concat(F.col("number").cast("string"), F.lit(": "), "title"), "_excerpt",
        F.concat(F.lit("next: "), t.default_if_blank("next_title", "-")),
    )
    return rows.join(about, "work_id").select("work_id", "number", context.alias("context"))


def work_contexts(works: DataFrame, sections: DataFrame, limit: int = 5000) -> DataFrame:
    """(work_id, sections, context): work fields and the excerpt from its quartile sections."""
    out = with_counts(works, sections).join(quartile_excerpt(sections, limit), "work_id", "left")
    context = F.concat_ws(
        "\n", "title", t.default_if_blank("author", "(unknown)"), t.default_if_blank("genres", "(unknown)"),
        F.substring(t.default_if_blank("description", "(none)"), 1, 500), F.col("sections").cast("string"), "excerpt",
    )
    return out.select("work_id", "sections", context.alias("context"))
