"""Works and sections derived from the driver tables by plain arithmetic, so SQL can derive them too."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.functions.text import word_count
from quire.operators.ordered import row_number

RAW_GENRES = ("Ngôn tình,Hiện đại,abc", "Tiên hiệp,xyz", "", "Romance, Urban", "Ngược")

_WORK_COLUMNS = (
    "work_id",
    "work_id AS slug",
    "concat('Work ', work_id) AS title",
    "CASE w % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('Author ', w % 7) END AS author",
    "CASE w % 4 WHEN 0 THEN NULL WHEN 1 THEN substr(first_text, 1, 60) ELSE first_text END AS description",
    "element_at(array(" + ", ".join(f"'{g}'" for g in RAW_GENRES) + "), int(w % 5) + 1) AS genres",
    "'' AS tags",
    "CASE w % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'ongoing' ELSE '' END AS status",
    "CASE w % 6 WHEN 5 THEN 'pending' ELSE 'published' END AS publish_status",
    "concat('https://site', w % 3, '.example/work/', work_id, '/') AS source_url",
    "CASE w % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'review' END AS editorial_review",
    "CASE w % 2 WHEN 0 THEN NULL ELSE 'analysis' END AS character_analysis",
    """CASE w % 5 WHEN 0 THEN NULL WHEN 1 THEN '[]' ELSE '[{"q":"x","a":"y"}]' END AS faq""",
    "'' AS cover_image",
    "timestamp_millis(1704067200000 + w * 3600000) AS created_at",
    "timestamp_millis(1704067200000 + w * 7200000) AS updated_at",
)
_SECTION_COLUMNS = (
    "concat('s', sid) AS section_id",
    "work_id",
    "int(number) AS number",
    "concat(CASE WHEN r % 4 = 0 THEN 'Phần ' ELSE 'Section ' END, number) AS title",
    "content",
    "word_count",
    "CASE WHEN r % 3 = 0 THEN NULL WHEN r % 7 = 0 THEN '' ELSE substr(content, 1, 40) END AS summary",
    "CASE WHEN r % 5 = 0 THEN NULL WHEN r % 11 = 0 THEN '' ELSE substr(content, 1, 30) END AS highlight",
    "CASE WHEN r % 2 = 0 THEN NULL WHEN r % 13 = 0 THEN '' ELSE substr(content, 1, 20) END AS next_preview",
    "CASE WHEN r % 6 = 0 THEN concat('audio/chapter_', number, '.mp3') END AS audio_url",
    "CASE WHEN r % 10 = 9 THEN 'pending' ELSE 'published' END AS publish_status",
    "timestamp_millis(1704067200000 + r * 60000) AS created_at",
    "timestamp_millis(1704067200000 + r * 120000) AS updated_at",
)


def _works(base: DataFrame) -> DataFrame:
    """``base``: work_id, w (a number), first_text."""
    return base.selectExpr(*_WORK_COLUMNS)


def _sections(base: DataFrame) -> DataFrame:
    """``base``: work_id, r (a number), sid (unique over all rows), number, content, word_count."""
    return base.selectExpr(*_SECTION_COLUMNS)


def document_sections(documents: DataFrame) -> DataFrame:
    """A work per source; sections numbered by document id. Long texts."""
    base = documents.select(
        F.col("source").alias("work_id"), F.col("doc_id").alias("r"), F.col("doc_id").cast("string").alias("sid"), F.col("text").alias("content"),
        word_count("text").alias("word_count"),
    )
    return _sections(row_number(base, "work_id", "r"))


def document_works(documents: DataFrame) -> DataFrame:
    first = documents.groupBy(F.col("source").alias("work_id")).agg(
        F.min("doc_id").alias("w"), F.min_by(F.substring("text", 1, 120), "doc_id").alias("first_text")
    )
    return _works(first)


def conversation_sections(conversations: DataFrame) -> DataFrame:
    """A work per conversation; sections are its turns. Short texts."""
    base = conversations.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("work_id"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("r"),
        F.concat_ws("_", "conv_id", "turn").alias("sid"),
        (F.col("turn") + 1).alias("number"),
        F.col("text").alias("content"),
        word_count("text").alias("word_count"),
    )
    return _sections(base)


def conversation_works(conversations: DataFrame) -> DataFrame:
    first = conversations.groupBy(F.col("conv_id").alias("w")).agg(
        F.min_by(F.substring("text", 1, 120), "turn").alias("first_text")
    )
    return _works(first.select(F.concat(F.lit("c"), F.col("w").cast("string")).alias("work_id"), "w", "first_text"))
