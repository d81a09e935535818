"""Export, payload, versioning and reader queries."""

from pyspark.sql import functions as F

from quire.functions import predicates as p
from quire.queries.base import sections_c, sections_v, works_c, works_v
from quire.queries.sql import on_c, on_v, strip
from quire.registry import query, table
from quire.sources import readers as rd
from quire.sources import sinks


@query("K1_stage_sections", on_v("""SELECT work_id AS slug, number, CASE WHEN number IN (2, 3) THEN 'new ' || title ELSE title END AS title FROM sections_v"""))
def _(spark, d):
    path = sinks.scratch(spark, "staged")
    s = sections_v(spark, d).select(F.col("work_id").alias("slug"), "number", "title")
    s = s.withColumn("sent", F.lit(1)).unionByName(s.withColumn("title", F.lit("sent before")).withColumn("sent", F.lit(0)))  # every number twice
    sinks.stage_sections(None, s.filter("number <> 3"), path, "sent")
    ddl = "number INT, title STRING, slug STRING"
    stored = spark.read.schema(ddl).json(path)
    before = sinks.snapshot(stored, sinks.scratch(spark, "staged-copy"))
    sinks.stage_sections(spark.read.parquet(before), s.filter("number in (2, 3)").withColumn("title", F.concat(F.lit("new "), "title")), path, "sent")
    return spark.read.schema(ddl).json(path).select("slug", "number", "title")


def _parts_sql(limit, head, on, tail, file):
    """Texts by work and part: sections packed by a walk over their positions, lines trimmed, a blank line behind each."""
    return on_v(f"""SELECT work_id, CASE WHEN chars > {limit} THEN part END AS part, parts, {file} AS file, md5(concat_ws(chr(10), {head} || CASE WHEN chars > {limit} THEN ' (Phần ' || part || '/' || parts || ')' ELSE '' END, '', body,
  CASE WHEN chars > {limit} AND part < parts THEN {on} ELSE {tail} END)) AS digest
FROM (SELECT work_id, part, string_agg(line || chr(10), chr(10) ORDER BY number, j) AS body FROM (SELECT work_id, part, number, j, ls[j] AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS j FROM (
  SELECT work_id, part, number, list_filter(list_transform(string_split(replace(coalesce(content, ''), chr(13), chr(10)), chr(10)), lambda x: {strip('x')}), lambda x: x <> '') AS ls FROM walk JOIN seq USING (work_id, number)))) GROUP BY work_id, part)
RIGHT JOIN (SELECT DISTINCT work_id, part FROM walk) USING (work_id, part) JOIN (SELECT work_id, max(part) AS parts, sum(length) AS chars FROM walk GROUP BY work_id) USING (work_id) JOIN works_v USING (work_id)""", f"""
seq AS (SELECT work_id, number, content, length(coalesce(content, '')) AS length, row_number() OVER (PARTITION BY work_id ORDER BY number) AS i FROM sections_v),
walk AS (SELECT work_id, number, length, i, 1 AS part, length AS open FROM seq WHERE i = 1 UNION ALL
  SELECT s.work_id, s.number, s.length, s.i, CASE WHEN w.open + s.length > {limit} THEN w.part + 1 ELSE w.part END, CASE WHEN w.open + s.length > {limit} THEN s.length ELSE w.open + s.length END
  FROM walk w JOIN seq s ON s.work_id = w.work_id AND s.i = w.i + 1)""").replace("WITH ", "WITH RECURSIVE ", 1)


_NEXT = "'Hết phần ' || part || '. Mời các bạn nghe tiếp phần ' || (part + 1) || '.'"


@query("K4_text_export", _parts_sql(60_000, "title || ' — ' || coalesce(author, '')", _NEXT, "'Hoàn văn.'", "slug || CASE WHEN chars > 60000 THEN '_p' || part ELSE '' END || '.txt'"))
def _(spark, d):
    out = sinks.export_texts(works_v(spark, d), sections_v(spark, d), clean=lambda c: c)
    return out.select("work_id", "part", "parts", "file", F.md5("text").alias("digest"))


@query("K4_channel_parts", _parts_sql(
    6_000, "'Chào mừng các bạn đến với Q. Chúc các bạn nghe truyện vui vẻ.'", _NEXT + " || ' Nhớ like và đăng ký kênh Q.'",
    "'Hoàn văn. Nhớ like và đăng ký kênh Q để nghe nhiều chuyện ngôn tình hay.'", "slug || CASE WHEN chars > 6000 THEN '_p' || part ELSE '' END || '.txt'"))
def _(spark, d):
    out = sinks.export_texts(works_v(spark, d), sections_v(spark, d), 6_000, "Q", clean=lambda c: c)
    return out.select("work_id", "part", "parts", "file", F.md5("text").alias("digest"))


@query("K4_text_export_parts")
def _(spark, d):
    out = sinks.export_texts(works_v(spark, d), sections_v(spark, d), 60_000, "Q")
    return out.select("work_id", "part", "parts", "file", F.md5("text").alias("digest"))


@query("K6_batches", on_v("""SELECT batch, count(*) AS rows, md5('[' || string_agg(j, ',' ORDER BY slug, number) || ']') AS digest FROM (
SELECT slug, number, (row_number() OVER (ORDER BY slug, number) - 1) // 100 AS batch, to_json(struct_pack(slug := slug, number := number, summary := summary, highlight := highlight))::VARCHAR AS j FROM (
SELECT w.slug, s.number, coalesce(s.summary, '') AS summary, coalesce(s.highlight, '') AS highlight FROM sections_v s JOIN works_v w USING (work_id) WHERE coalesce(summary, '') <> '' OR coalesce(highlight, '') <> '')) GROUP BY batch"""))
def _(spark, d):
    s = sections_v(spark, d).filter(p.has_any("summary", "highlight")).select(
        "work_id", "number", F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("highlight", F.lit("")).alias("highlight"))
    rows = s.join(works_v(spark, d).select("work_id", "slug"), "work_id").select("slug", "number", "summary", "highlight")
    return sinks.batches(rows, ["slug", "number"]).select("batch", "rows", F.md5("payload").alias("digest"))


@query("K7_import_payloads", on_c("""SELECT w.slug, coalesce(piece, 0)::INT AS piece, coalesce(n, 0)::INT AS sections, md5('{"novel":' || to_json(struct_pack(title := w.title, author := coalesce(nullif(author, ''), 'Đang cập nhật'), description := coalesce(description, ''), genres := coalesce(nullif(genres, ''), 'ngon-tinh'), tags := coalesce(tags, ''),
  status := coalesce(nullif(status, ''), 'completed'), source_url := regexp_replace(source_url, '/+$', ''), cover_image := coalesce(cover_image, '')))::VARCHAR || ',"chapters":[' || coalesce(js, '') || '],"replace_chapters":' || (coalesce(piece, 0) = 0) || '}') AS digest
FROM works_c w LEFT JOIN (SELECT work_id, piece, count(*) AS n, string_agg(to_json(struct_pack(number := number, title := title, content := content))::VARCHAR, ',' ORDER BY number) AS js FROM (
  SELECT *, (row_number() OVER (PARTITION BY work_id ORDER BY number) - 1) // 3 AS piece FROM sections_c WHERE publish_status = 'published') GROUP BY work_id, piece) USING (work_id)"""))
def _(spark, d):
    out = sinks.import_payloads(works_c(spark, d), sections_c(spark, d), 3)
    return out.select("slug", "piece", "sections", F.md5("payload").alias("digest"))


@query("K8_versions", on_c("SELECT work_id, number, 'second' AS label FROM sections_c WHERE number > 1 UNION ALL SELECT work_id, number, 'first' FROM sections_c"))
def _(spark, d):
    root = sinks.scratch(spark, "versions")
    s = sections_c(spark, d).select("work_id", "number")
    sinks.snapshot(s, root)
    sinks.snapshot(sinks.current(spark, root).filter("number > 1"), root)
    return sinks.current(spark, root).withColumn("label", F.lit("second")).unionByName(sinks.current(spark, root, 1).withColumn("label", F.lit("first")))


@query("S4_url_list", "SELECT url FROM pages")
def _(spark, d):
    lists = table(spark, d, "pages").select(F.from_json(
        F.concat(F.lit('{"stories":[{"url":"'), "url", F.lit('"},{"url":""},{}]}')), "stories ARRAY<STRUCT<url: STRING>>").alias("x")).select("x.stories")
    return rd.listed_urls(lists)


@query("S5_feed_rows", "SELECT CASE WHEN page_id % 3 = 0 THEN 'https://f.example/g/' || (page_id % 50) ELSE 'https://f.example/l/' || (page_id % 40) END AS url, min(page_id) AS pos, min_by('t' || page_id, page_id) AS title FROM pages WHERE page_id % 11 <> 0 GROUP BY 1")
def _(spark, d):
    k = F.col("page_id")
    link = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("/l/"), (k % 40).cast("string")))
    xml = F.concat(
        F.lit("<item><title>"), F.when(k % 11 == 0, "").otherwise(F.concat(F.lit(" t"), k.cast("string"))), F.lit("</title><link>"), link,
        F.lit("</link><guid>https://f.example/g/"), (k % 50).cast("string"), F.lit("</guid></item>"))
    items = table(spark, d, "pages").select(k.alias("pos"), F.from_xml(xml, "title STRING, link STRING, guid STRING").alias("x")).select("pos", "x.*")
    return rd.feed_rows(items, "https://f.example")


WORDS_OF = "(SELECT unnest(list_distinct(regexp_extract_all(text, '[A-Za-zÀ-ỹ]+'))) AS w FROM documents)"


def _log(spark, d):
    w = F.col("w")
    bad = F.concat(F.lit("12:00 WARN q: 2 âm tiết không tự sửa được (ví dụ: ['"), w, F.lit("', \""), w, F.lit("x\"])"))
    fix = F.concat(F.lit("12:01 INFO r: sửa thêm 1 âm tiết bằng model (ví dụ: [('"), w, F.lit("', '"), F.lower(w), F.lit("')])"))
    rows = table(spark, d, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-zÀ-ỹ]+"), F.lit(0)))).alias("w"))
    return rows.select(F.explode(F.array(bad, fix, F.lit("noise"))).alias("value"))


@query("S6_log_residuals", f"SELECT w AS bad FROM {WORDS_OF} UNION ALL SELECT w || 'x' FROM {WORDS_OF}")
def _(spark, d):
    return rd.log_residuals(_log(spark, d))


@query("S6_log_repairs", f"SELECT w AS bad, lower(w) AS variant FROM {WORDS_OF}")
def _(spark, d):
    return rd.log_repairs(_log(spark, d))


@query("S8_header_fields", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Title ' || doc_id ELSE 'Work ' || doc_id END AS title, 'drama' AS genres, source AS author FROM documents")
def _(spark, d):
    k = F.col("doc_id").cast("string")
    head = F.concat(
        F.lit("=== x ===\n# y\n"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("  Title "), k, F.lit(" \n"))).otherwise(""),
        F.lit("# The loai: drama | Tac gia: "), "source", F.lit(" | z\n"))
    rows = table(spark, d, "documents").select("doc_id", head.alias("h"), F.concat(F.lit("work-"), k).alias("slug"))
    return rows.select("doc_id", *rd.header_fields("h", "slug"))


def _audio(spark, d):
    s = sections_c(spark, d)
    name = F.concat(F.lit("out/"), "work_id", F.when(F.col("number") % 5 == 0, F.lit("/cover_")).otherwise(F.lit("/chapter_")), F.col("number").cast("string"), F.lit(".mp3"))
    files = s.select(name.alias("path"), (F.col("word_count") * 100).cast("bigint").alias("length"), "number")
    marks = files.filter("number % 3 = 0").select(F.concat("path", F.lit(".uploaded")).alias("path"), F.lit(0).cast("bigint").alias("length"))
    return files.drop("number").unionByName(marks)


@query("S9_audio_files", on_c("SELECT 'out/' || work_id || '/chapter_' || number || '.mp3' AS path, number, word_count * 100 AS bytes FROM sections_c WHERE number % 5 <> 0"))
def _(spark, d):
    return rd.audio_files(_audio(spark, d))


@query("J8_pending_uploads", on_c("SELECT number, count(*) AS files, sum(word_count * 100)::BIGINT AS bytes FROM sections_c WHERE number % 5 <> 0 AND number % 3 <> 0 GROUP BY number"))
def _(spark, d):
    listing = _audio(spark, d)
    return rd.pending_uploads(rd.audio_files(listing), listing).groupBy("number").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


@query("J15_scenes_with_images", on_c("""SELECT work_id, scene, CASE WHEN number % 3 = 1 THEN work_id || '/own.jpg' ELSE work_id || '/images/scene_' || CASE WHEN scene > 999 THEN scene::VARCHAR ELSE lpad(scene::VARCHAR, 3, '0') END || '.jpg' END AS image
FROM (SELECT *, CASE WHEN number > 4 THEN number * 1000 + 234 ELSE number END AS scene FROM sections_c) WHERE number % 3 = 1 OR number % 2 = 0"""))
def _(spark, d):
    s = sections_c(spark, d).withColumn("scene", F.when(F.col("number") > 4, F.col("number") * 1000 + 234).otherwise(F.col("number")))
    scenes = s.select("work_id", "scene", F.when(F.col("number") % 3 == 1, F.concat("work_id", F.lit("/own.jpg"))).otherwise(F.lit("gone.jpg")).alias("image"))
    listing = s.select(F.concat("work_id", F.lit("/own.jpg")).alias("path")).unionByName(
        s.filter("number % 2 = 0").select(F.concat("work_id", F.lit("/images/scene_"), F.format_string("%03d", "scene"), F.lit(".jpg")).alias("path")))
    return rd.scenes_with_images(scenes, listing)


def _write_files(rows):
    """Small files from rows (folder, name, value) on the shared storage, each written by the task that has its row."""

    def written(frames):
        from functools import lru_cache

        from pyarrow import fs

        @lru_cache(1_024)
        def made(folder):
            store, path = fs.FileSystem.from_uri(folder.replace("file:///", "/").replace("file:/", "/"))
            store.create_dir(path)
            return store, path

        for frame in frames:
            for folder, name, value in zip(frame["folder"], frame["name"], frame["value"]):
                store, path = made(folder)
                with store.open_output_stream(f"{path}/{name}") as out:
                    out.write(value.encode())
            yield frame[["name"]]

    rows.select("folder", "name", "value").mapInPandas(written, "name string").agg(F.count("*")).collect()


STAGED = "f AS (SELECT work_id AS slug, number, title, content, number % 4 = 3 AS broken FROM sections_c)"


@query("S2_staged_sections", on_c("""SELECT slug, number, title, content, NULL AS file FROM f WHERE NOT broken
UNION ALL SELECT slug, NULL, NULL, NULL, 'chapter_' || number || '.json' FROM f WHERE broken""", STAGED))
def _(spark, d):
    root = sinks.scratch(spark, "novels")
    s = sections_c(spark, d)
    whole = F.to_json(F.struct("number", "title", "content"))
    value = F.when(F.col("number") % 4 == 3, F.expr("substr(j, 1, length(j) div 2)")).otherwise(F.col("j"))
    _write_files(s.withColumn("j", whole).select(
        F.concat(F.lit(f"{root}/"), "work_id", F.lit("/chapters")).alias("folder"),
        F.concat(F.lit("chapter_"), F.col("number").cast("string"), F.lit(".json")).alias("name"), value.alias("value")))
    return rd.staged_files(spark, root).select("slug", "number", "title", "content", "file")


@query("S3_mixed_sections", """SELECT stem, CASE WHEN k = 4 THEN 0 ELSE page_id END::INT AS number, CASE k WHEN 0 THEN 'json' WHEN 1 THEN 'json' WHEN 4 THEN stem ELSE '' END AS title, CASE WHEN k <= 1 THEN url ELSE url || ' text' END AS content FROM (
SELECT page_id, url, page_id % 5 AS k, CASE page_id % 5 WHEN 4 THEN 'extra ' || page_id ELSE page_id::VARCHAR END AS stem FROM pages) WHERE k <> 2""")
def _(spark, d):
    # by the key: JSON with a number, JSON without one, broken JSON beside a text, a text, a text without a number in its name
    folder = sinks.scratch(spark, "mixed")
    k, n = F.col("page_id") % 5, F.col("page_id").cast("string")
    stem = F.when(k == 4, F.concat(F.lit("extra "), n)).otherwise(n)
    rows = table(spark, d, "pages").withColumn("title", F.lit("json")).withColumn("number", F.when(k == 0, F.col("page_id")))
    good = F.to_json(F.struct("number", "title", F.col("url").alias("content")))
    documents = rows.filter(k <= 2).select(F.concat(stem, F.lit(".json")).alias("name"), F.when(k == 2, '{"number": 7, "ti').otherwise(good).alias("value"))
    plain = rows.filter((k >= 2) | (k == 1)).select(F.concat(stem, F.lit(".txt")).alias("name"), F.concat("url", F.lit(" text")).alias("value"))
    _write_files(documents.unionByName(plain).withColumn("folder", F.lit(folder)))
    return rd.mixed_sections(spark, folder)
