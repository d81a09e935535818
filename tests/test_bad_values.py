"""No value aborts a job, loses rows or doubles them."""

import pytest
from pyspark.sql import functions as F

from quire import schemas
from quire.functions import html as h
from quire.functions import urls
from quire.operators import changes as ch
from quire.operators import extract, normalise, sequence
from quire.sources import readers as rd
from quire.sources import sinks


def test_character_references(value):
    assert value(h.unescape, "&#9999999; &#xD800; &#x10FFFF; &#0; &#233; &#xE9;") == "\ufffd \ufffd \U0010ffff \ufffd é é"


def test_numbers_above_int(spark, value):
    assert value(lambda c: urls.section_number(c, F.lit(4)), "https://x/chuong-99999999999") == 5
    assert value(h.option_numbers, '<option value="99999999999"><option value="7">') == [7]
    listing = spark.createDataFrame([("a/chapter_99999999999.mp3", 5), ("a/chapter_2.mp3", 6)], "path string, length long")
    assert sorted(r["number"] or 0 for r in rd.audio_files(listing).collect()) == [0, 2]
    pages = spark.createDataFrame([("https://x/w", '<option value="2000000000">'), ("https://x/v", '<option value="2">')], "url string, html string")
    got = sorted((r["url"], r["number"] or 0) for r in extract.generated_links(pages).collect())
    assert got == [("https://x/v", 1), ("https://x/v", 2), ("https://x/w", 0)]


def test_scene_numbers_are_only_padded(spark):
    scenes = spark.createDataFrame([("w", 1234, None), ("w", 7, None), ("w", 123, None)], "work_id string, scene int, image string")
    listing = spark.createDataFrame([("w/images/scene_1234.jpg",), ("w/images/scene_007.jpg",)], "path string")
    got = sorted((r["scene"], r["image"]) for r in rd.scenes_with_images(scenes, listing).collect())
    assert got == [(7, "w/images/scene_007.jpg"), (1234, "w/images/scene_1234.jpg")]


def test_composed_form(spark):
    texts = ["\u212b \uf900 \u1100\u1161\u11a8 e\u0301", "plain é", None]
    rows = [(i, x) for i, x in enumerate(texts)]
    got = normalise.nfc(spark.createDataFrame(rows, "i int, x string"), "x").orderBy("i").collect()
    assert [r["x"] for r in got] == ["\u00c5 \u8c48 \uac01 \u00e9", "plain é", None]


def test_repeats_have_one_winner(spark):
    stored = spark.createDataFrame([("w", 1, "old", 0)], "work_id string, number int, title string, v int")
    sent = spark.createDataFrame([("w", 1, "b", 2), ("w", 1, "a", 1), ("w", 2, "d", 2), ("w", 2, "c", 1)], stored.schema)
    rows = lambda df: sorted((r["number"], r["title"]) for r in df.collect())
    assert rows(ch.upsert(stored, sent, version="v")) == [(1, "b"), (2, "d")]
    assert rows(ch.resume(stored, sent, "v")) == [(1, "old"), (2, "c")]
    assert rows(ch.update_filled(stored, sent, ["work_id", "number"], ["title"], "v")) == [(1, "b")]


def test_staging_needs_what_the_folder_holds(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x", 1), ("a", 1, "y", 2), ("b", 1, "z", 1)], "slug string, number int, title string, sent int")
    path = str(tmp_path / "staged")
    sinks.stage_sections(None, rows, path, "sent")
    assert sorted((r["slug"], r["title"]) for r in spark.read.json(path).collect()) == [("a", "y"), ("b", "z")]
    with pytest.raises(ValueError):
        sinks.stage_sections(None, rows, path, "sent")


def test_seeds_that_share_a_section_are_refused(spark):
    columns = spark.createDataFrame([], schemas.SECTIONS).columns
    rows = [{"section_id": f"s{n}", "work_id": "w", "number": n, "title": f"t{n}", "content": f"c{n}", "word_count": 1} for n in range(1, 8)]
    sections = spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], schemas.SECTIONS)
    seeds = spark.createDataFrame([("w", 2, "prev"), ("w", 3, "prev"), ("w", 6, "next"), ("w", 6, "next")], "work_id string, number int, direction string")
    merged, status = sequence.merge_one(sections, seeds)
    assert sorted((r["number"], r["status"]) for r in status.collect()) == [(2, "overlap"), (3, "overlap"), (6, "ok")]
    text = "|".join(r["content"] for r in merged.orderBy("number").collect())
    assert all(text.count(f"c{n}") == 1 for n in range(1, 8)) and merged.count() == 6
