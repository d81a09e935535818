"""Pages to stored sections, all works at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.functions import text as t
from quire.functions import urls
from quire.functions.predicates import is_generic_title
from quire.functions.responses import picked_title
from quire.operators import catalog, changes as ch, extract
from quire.operators.sequence import usable_fetches


def new_sections(pages: DataFrame, stored: DataFrame, domains: DataFrame, min_length: int = 50) -> DataFrame:
    """Rows to insert. ``pages``: work_id, pos (0-based, without gaps), url, html.

    Source by host, text, number, stop rule, what is not stored yet, dialogue reflow.
    """
    known = catalog.match_domains(pages.select("work_id", "pos", "url", "html"), domains).filter("source is not null")
    texts = extract.section_texts(known).withColumn("number", urls.section_number("url", "pos"))
    have = stored.select("work_id", "number", F.lit(True).alias("_have"))
    lengths = texts.select("work_id", "pos", "number", F.length("content").alias("length")).join(have, ["work_id", "number"], "left")
    fetches = lengths.select("work_id", "pos", "length", F.col("_have").isNotNull().alias("loaded"))
    wanted = usable_fetches(fetches, min_length).filter("not loaded").select("work_id", "pos")
    body = t.reflow("content")
    rows = texts.join(wanted, ["work_id", "pos"], "left_semi").select("work_id", "number", "pos", F.explode(F.array(body)).alias("content"))
    rows = rows.select(
        ch.section_id().alias("section_id"), "work_id", "number", F.concat(F.lit("Chương "), F.col("number").cast("string")).alias("title"),
        "content", t.word_count("content").alias("word_count"), F.lit("published").alias("publish_status"), "pos",
    )
    return ch.resume_inserts(stored, rows, "pos").drop("pos")


def retitle(sections: DataFrame, answers: DataFrame) -> DataFrame:
    """Sections with a generic title get the title picked from their answer, if any.

    ``answers``: section_id, text.
    """
    generic = sections.filter(is_generic_title()).select("section_id")
    picked = answers.join(generic, "section_id", "left_semi").select("section_id", picked_title("text").alias("title")).filter("title is not null")
    return ch.update_filled(sections, picked, ["section_id"], ["title"])
