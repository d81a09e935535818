import json

from pyspark.sql import functions as F

from quire import schemas
from quire.operators import catalog, changes as ch
from quire.sources import readers as rd
from quire.sources import sinks


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_staged_sections(spark, tmp_path):
    for n in (2, 10, 1):
        put(tmp_path / "work-a" / "chapters" / f"{n:04d}.json", json.dumps({"number": n, "title": f"t{n}", "content": "x\ny"}, indent=2))
    put(tmp_path / "work-a" / "chapters" / "0003.json", '{"number": 3, ')
    good, bad = rd.staged_sections(spark, str(tmp_path))
    assert [(r["slug"], r["number"]) for r in good.orderBy("number").collect()] == [("work-a", 1), ("work-a", 2), ("work-a", 10)]
    assert [(r["slug"], r["file"]) for r in bad.collect()] == [("work-a", "0003.json")]


def test_mixed_sections(spark, tmp_path):
    put(tmp_path / "0001.json", json.dumps({"number": 7, "title": "j", "content": "json"}))
    put(tmp_path / "0001.txt", "text loses")
    put(tmp_path / "0002.json", json.dumps({"title": "k", "content": "by stem"}))
    put(tmp_path / "0003.txt", "plain\ntext")
    put(tmp_path / "intro.txt", "hello")
    rows = {r["stem"]: (r["number"], r["title"], r["content"]) for r in rd.mixed_sections(spark, str(tmp_path)).collect()}
    assert rows == {"0001": (7, "j", "json"), "0002": (2, "k", "by stem"), "0003": (3, "", "plain\ntext"), "intro": (0, "intro", "hello")}


def test_lists_feeds_logs(spark, tmp_path):
    put(tmp_path / "list.json", json.dumps({"stories": [{"url": "https://a"}, {"url": ""}, {"x": 1}]}, indent=1))
    assert [r["url"] for r in rd.url_list(spark, str(tmp_path / "list.json")).collect()] == ["https://a"]
    items = "".join(f"<item><title>T{i}</title><link>{u}</link><guid>https://g/{i}</guid></item>" for i, u in enumerate(["/a", "/a", "", "https://b"]))
    put(tmp_path / "feed.xml", f"<rss><channel>{items}</channel></rss>")
    assert sorted(tuple(r) for r in rd.feed(spark, str(tmp_path / "feed.xml"), "https://s").collect()) == [("https://b", "T3"), ("https://g/2", "T2"), ("https://s/a", "T0")]
    put(tmp_path / "run.log", "a: 2 âm tiết không tự sửa được (ví dụ: ['tôài', \"mộọng\"])\nx\nb: sửa thêm 1 âm tiết bằng M (ví dụ: [('tôài', 'tôi'), ('a', 'b')])\n")
    residuals, repairs = rd.quality_log(spark, str(tmp_path / "run.log"))
    assert sorted(r["bad"] for r in residuals.collect()) == ["mộọng", "tôài"]
    assert sorted(tuple(r) for r in repairs.collect()) == [("a", "b"), ("tôài", "tôi")]
    put(tmp_path / "lex.txt", "Người\n\n những \nngười\n")
    assert sorted(r["syllable"] for r in rd.lexicon(spark, str(tmp_path / "lex.txt")).collect()) == ["người", "những"]


def test_sidecars_and_audio(spark, tmp_path):
    put(tmp_path / "ten-hay" / "seo.txt", "=== A ===\n# b\nThe loai: x\n")
    put(tmp_path / "khac" / "seo.txt", "# b\n Tên Thật \nThe loai: drama | Tac gia: Bà A | z\n")
    put(tmp_path / "rong-tuech" / "seo.txt", "=== A ===\n")
    rows = {r["slug"]: (r["title"], r["genres"], r["author"]) for r in rd.sidecars(spark, f"{tmp_path}/*/seo.txt").collect()}
    assert rows == {"ten-hay": ("The loai: x", "x", ""), "khac": ("Tên Thật", "drama", "Bà A"), "rong-tuech": ("Rong Tuech", "", "")}
    for name, text in (("chapter_1.mp3", "abc"), ("chapter_1.mp3.uploaded", ""), ("chapter_02.mp3", "abcd"), ("x.mp3", "a")):
        put(tmp_path / "audio" / name, text)
    assert rd.audio_files(rd.file_listing(spark, f"{tmp_path}/audio/*")).count() == 2
    listing = rd.folder_listing(spark.createDataFrame([(f"file:{tmp_path}/audio",), (f"file:{tmp_path}/none",)], "folder string"))
    audio = rd.audio_files(listing)
    assert sorted((r["number"], r["bytes"]) for r in audio.collect()) == [(1, 3), (2, 4)]
    assert [r["number"] for r in rd.pending_uploads(audio, listing).collect()] == [2]
    assert rd.pending_uploads(audio, listing, force=True).count() == 2


def test_text_export(spark, tmp_path):
    works = spark.createDataFrame([("w", "w-slug", "Tên", "Ai"), ("v", "v-slug", "Hai", None)], "work_id string, slug string, title string, author string")
    rows = [("w", n, "y" * 30 + "\n\n z ") for n in (1, 2, 3)] + [("v", 1, "một")]
    sections = spark.createDataFrame(rows, "work_id string, number int, content string")
    out = sinks.export_texts(works, sections, 70, "Kênh", clean=lambda c: c)
    got = {r["file"]: r["text"] for r in out.collect()}
    line = "y" * 30
    assert got["w-slug_p1.txt"] == ("Chào mừng các bạn đến với Kênh. Chúc các bạn nghe truyện vui vẻ. (Phần 1/2)\n\n" + f"{line}\n\nz\n\n" * 2
                                    + "Hết phần 1. Mời các bạn nghe tiếp phần 2. Nhớ like và đăng ký kênh Kênh.")
    assert got["v-slug.txt"].endswith("một\n\nHoàn văn. Nhớ like và đăng ký kênh Kênh để nghe nhiều chuyện ngôn tình hay.")
    sinks.write_texts(out, str(tmp_path / "out"))
    assert "w-slug_p2.txt" in {p.name.split("=")[1] for p in (tmp_path / "out").glob("file=*")}


def test_versions(spark, tmp_path):
    root = str(tmp_path / "table")
    sinks.snapshot(spark.range(3).toDF("n"), root)
    sinks.snapshot(sinks.current(spark, root).filter("n > 0"), root)
    assert (sinks.current(spark, root).count(), sinks.current(spark, root, 1).count()) == (2, 3)


def test_dated_layout(spark, tmp_path):
    df = spark.createDataFrame([("a", "2024-01-02 03:04:05"), ("b", "2024-01-03 00:00:00")], "slug string, updated_at string")
    df = df.withColumn("updated_at", F.to_timestamp("updated_at"))
    sinks.write_dated(df, str(tmp_path / "d"), key="slug")
    more = df.filter("slug = 'a'").withColumn("slug", F.lit("c")).unionByName(df.withColumn("updated_at", F.expr("updated_at + interval 1 minute")))
    sinks.write_dated(more, str(tmp_path / "d"), key="slug")
    rows = sorted((str(r["load_date"]), r["slug"], str(r["updated_at"])[-5:]) for r in spark.read.parquet(str(tmp_path / "d")).collect())
    assert rows == [("2024-01-02", "a", "04:05"), ("2024-01-02", "c", "04:05"), ("2024-01-03", "b", "00:00")]
    assert sorted(p.name for p in (tmp_path / "d").glob("load_date=*")) == ["load_date=2024-01-02", "load_date=2024-01-03"]


def test_imports(spark):
    s = "work_id string, number int, audio_url string, summary string, highlight string, next_preview string"
    stored = spark.createDataFrame([("w", 1, "a", "", None, None), ("w", 2, None, None, None, None), ("v", 1, None, None, None, None)], s)
    sent = spark.createDataFrame([("w", 2, None, None, None, None), ("w", 3, None, None, None, None), ("w", 3, None, None, None, None)], s)
    assert [tuple(r) for r in ch.resume_counts(stored, sent).collect()] == [("w", 1, 1)]
    once = ch.resume(stored, sent, "number")
    assert once.count() == 4 and ch.resume(once, sent, "number").count() == 4
    sent = sent.distinct()
    assert [tuple(r) for r in ch.replace_counts(stored, sent).collect()] == [("w", 2, 2, 1)]
    assert sorted((r["work_id"], r["number"]) for r in ch.replace_works(stored, sent).collect()) == [("v", 1), ("w", 2), ("w", 3)]


def test_domains(spark):
    pages = spark.createDataFrame([("https://www.read.io/x",), ("https://xread.io/x",), ("https://m.read.io",), ("https://io/",), ("none",)], "url string")
    doms = spark.createDataFrame([("read.io", "A", 1), ("m.read.io", "B", 2)], "domain string, source string, reg_order int")
    got = {r["url"]: r["source"] for r in catalog.match_domains(pages, doms).collect()}
    assert got == {"https://www.read.io/x": "A", "https://xread.io/x": None, "https://m.read.io": "A", "https://io/": "A", "none": None}


def test_schemas_read_back(spark, tmp_path):
    spark.createDataFrame([], schemas.SECTIONS).write.parquet(str(tmp_path / "s"))
    assert rd.catalogue_table(spark, str(tmp_path / "s"), schemas.SECTIONS).columns[:3] == ["section_id", "work_id", "number"]


def test_totals_come_from_the_writing_pass(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([("ok", 3), ("ok", 4), ("failed", None), (None, 1), ("odd", 2)], "status string, amount int")
    rows = rows.coalesce(1).mapInArrow(counted, rows.schema)
    got = {r["status"]: (r["rows"], r["amount"]) for r in sinks.write_outcomes(rows, str(tmp_path / "o")).collect()}
    assert got == {"ok": (2, 7), "failed": (1, None), "other": (2, 3)} and reads.value == 5
    assert spark.read.parquet(str(tmp_path / "o")).count() == 5
    words = spark.createDataFrame([(50,), (1,), (None,)], "word_count int").coalesce(1)
    words = words.mapInArrow(counted, words.schema)
    done = sinks.write_conserved(words, F.col("word_count") > 1, str(tmp_path / "w"))
    assert done == {"rows_before": 3, "rows_after": 1, "words_before": 51, "words_after": 50, "conserved": True} and reads.value == 8
    none = sinks.write_conserved(words.filter("false"), F.lit(True), str(tmp_path / "n"))
    assert none["rows_before"] == none["words_after"] == 0 and none["conserved"]


def test_section_files_are_listed_by_folder_and_read_once(spark, tmp_path):
    for n in range(40):
        put(tmp_path / f"work {n}" / "chapters" / "1.json", json.dumps({"number": n, "title": "t", "content": "x"}))
    put(tmp_path / "odd" / "chapters" / "list.json", json.dumps([{"number": 1}, {"title": "two, [3]"}]))
    put(tmp_path / "odd" / "chapters" / "bom.json", "\ufeff" + json.dumps({"number": 5}))
    put(tmp_path / "odd" / "chapters" / "type.json", '{"number": "many"}')
    put(tmp_path / "odd" / "chapters" / "deep" / "2.json", json.dumps({"number": 9}))
    for name, text in (("cut.json", '[{"number": 1}, {'), ("empty.json", ""), ("blank.json", " \n"), ("x.txt", "no")):
        put(tmp_path / "odd" / "chapters" / name, text)
    rows = rd.staged_files(spark, f"file://{tmp_path}")
    assert len(rows.inputFiles()) == 40 + 6 + 1  # found by their folders; the deeper one is not read
    assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    odd = sorted(((r["number"], r["title"], r["file"]) for r in rows.filter("slug = 'odd'").collect()), key=str)
    assert odd == [(0, "two, [3]", None), (1, None, None), (5, None, None), (None, None, "blank.json"), (None, None, "cut.json")]  # Spark passes over files of no bytes
    assert rows.filter("slug like 'work %' and file is null").count() == 40


def test_mixed_sections_read_every_file_once(spark, tmp_path):
    put(tmp_path / "1.json", '{"number": 7, "ti')
    put(tmp_path / "1.txt", "hidden by broken JSON")
    put(tmp_path / "2.json", "")
    put(tmp_path / "2.txt", "beside an empty file")
    put(tmp_path / "3.json", json.dumps([{"title": "a"}, {"number": 8, "title": "b"}]))
    put(tmp_path / "x.json", json.dumps({"title": "no number"}))
    put(tmp_path / "sub" / "9.txt", "deeper")
    out = rd.mixed_sections(spark, str(tmp_path))
    assert sorted(tuple(r) for r in out.collect()) == [("2", 2, "", "beside an empty file"), ("3", 3, "a", None), ("3", 8, "b", None)]
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
