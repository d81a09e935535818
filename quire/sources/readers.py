"""Readers for the files round the catalogue. Each scan has its parsing step as a function of its own, so that it works
on any DataFrame of the raw rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, StructType

from quire import schemas
from quire.functions.text import col, lines, strip


def _section() -> StructType:
    return StructType.fromDDL(schemas.SECTION_JSON)


def _file(part: str) -> Column:
    # Spark shows paths with blanks and other signs as %-references
    return F.url_decode(F.replace(F.col(f"_metadata.{part}"), F.lit("+"), F.lit("%2B")))


def _dir_name(levels_up: int) -> Column:
    return F.element_at(F.split(_file("file_path"), "/"), -1 - levels_up)


def catalogue_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A catalogue table with its declared schema."""
    return spark.read.schema(schema).parquet(path)


def _section_files(spark: SparkSession, folders: str, names: str) -> DataFrame:
    """(value) of every file of these ``names`` right in the ``folders``, one row each. The folders are listed, not one path per file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folders)
    depth = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).depth()
    files = spark.read.option("pathGlobFilter", names).option("recursiveFileLookup", True).text(folders, wholetext=True)
    below = F.regexp_replace("_metadata.file_path", r"\A[^/]*:(//[^/]*)?/", "")
    return files.filter(F.size(F.split(below, "/")) == depth + 1)


def _section_documents(value: Column) -> Column:
    """The sections of a JSON text, an array: of one object, or of a list of them; none of a blank text. What cannot be read has ``_corrupt_record``."""
    value = F.regexp_replace(value, r"\A\x{FEFF}", "")
    listed = F.when(value.rlike(r"\A\s*\["), F.from_json(value, "array<string>"))
    parsed = F.transform(F.coalesce(listed, F.array(value)), lambda x: F.from_json(x, _section(), {"columnNameOfCorruptRecord": "_corrupt_record"}))
    return F.when(value.rlike(r"\A\s*\z"), F.array().cast(ArrayType(_section()))).otherwise(parsed)


def staged_files(spark: SparkSession, root: str, slug: str = "*", day: str | None = None) -> DataFrame:
    """(slug, the columns of a section, file) of ``root/[day/]slug/chapters/*.json``, every file read once: its sections or, where
    it is unreadable, its name as ``file``, which is null elsewhere."""
    rows = _section_files(spark, f"{root}/{day}/{slug}/chapters" if day else f"{root}/{slug}/chapters", "*.json")
    rows = rows.select("value", _dir_name(2).alias("slug"), _file("file_name").alias("_name"), F.explode_outer(_section_documents(F.col("value"))).alias("_f"))
    bad = F.col("_f").isNull() | F.col("_f._corrupt_record").isNotNull()
    rows = rows.filter(~bad | F.get_json_object("value", "$").isNull())
    section = [F.when(~bad, F.col(f"_f.{c}")).alias(c) for c in _section().names if c not in ("number", "_corrupt_record")]
    return rows.select("slug", F.when(~bad, F.coalesce("_f.number", F.lit(0))).alias("number"), *section, F.when(bad, F.col("_name")).alias("file"))


def staged_sections(spark: SparkSession, root: str, slug: str = "*", day: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(sections, unreadable files); ``staged_files`` has both from one scan."""
    rows = staged_files(spark, root, slug, day)
    return rows.filter("file is null").select(*[c for c in _section().names if c != "_corrupt_record"], "slug"), rows.filter("file is not null").select("slug", "file")


def _stem_number(stem: Column) -> Column:
    digits = F.regexp_extract(stem, r"\A\s*(\d+)\s*\z", 1)
    return F.when(digits != "", digits.try_cast("int"))


def mixed_sections(spark: SparkSession, folder: str) -> DataFrame:
    """S3: (stem, number, title, content) of a folder of .json and .txt sections; JSON wins where both exist."""
    stem = F.regexp_replace(_file("file_name"), r"\.[^.]+\z", "")
    is_json = F.endswith(_file("file_name"), F.lit(".json"))
    rows = _section_files(spark, folder, "*.{json,txt}").select("value", stem.alias("stem"), is_json.alias("_json"))
    none = F.array(F.lit(None).cast(_section()))
    rows = rows.select("stem", "_json", F.when(~F.col("_json"), F.col("value")).alias("value"), F.explode(F.when(F.col("_json"), _section_documents(F.col("value"))).otherwise(none)).alias("_f"))
    # a stem has one file of each kind
    rows = rows.withColumn("_wins", F.max("_json").over(Window.partitionBy("stem"))).filter(F.col("_json") == F.col("_wins"))
    rows = rows.filter(F.col("_f._corrupt_record").isNull())
    by_stem, is_json = _stem_number(F.col("stem")), F.col("_json")
    rows = rows.withColumn("number", F.when(is_json, F.coalesce("_f.number", by_stem)).otherwise(F.coalesce(by_stem, F.lit(0)))).filter("number is not null")
    return rows.select(
        "stem", "number", F.when(is_json, F.col("_f.title")).when(by_stem.isNull(), F.col("stem")).otherwise("").alias("title"),
        F.when(is_json, F.col("_f.content")).otherwise(F.col("value")).alias("content"),
    )


def listed_urls(documents: DataFrame) -> DataFrame:
    """The non-empty ``stories[].url`` of list documents."""
    return documents.select(F.explode("stories").alias("_s")).select(F.col("_s.url").alias("url")).filter("coalesce(url, '') <> ''")


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """S4."""
    return listed_urls(spark.read.schema(schemas.URL_LIST).option("multiLine", True).json(path))


def feed_rows(items: DataFrame, base: str, order: str = "pos") -> DataFrame:
    """(pos, url, title) of feed items (title, link, guid): the guid stands in for a missing link, each URL once."""
    link = strip(F.coalesce("link", F.lit("")))
    href = F.when(link != "", link).otherwise(strip(F.coalesce("guid", F.lit(""))))
    rows = items.select(F.col(order).alias("pos"), href.alias("_h"), strip(F.coalesce("title", F.lit(""))).alias("title")).filter("_h <> '' and title <> ''")
    rows = rows.withColumn("url", F.when(F.startswith("_h", F.lit("http")), F.col("_h")).otherwise(F.concat(F.lit(base), "_h")))
    return rows.groupBy("url").agg(F.min("pos").alias("pos"), F.min_by("title", "pos").alias("title"))


def feed(spark: SparkSession, path: str, base: str, limit: int = 80) -> DataFrame:
    """The first ``limit`` works of an RSS feed."""
    items = spark.read.format("xml").option("rowTag", "item").schema("title STRING, link STRING, guid STRING").load(path)
    place = F.struct(_file("file_path"), _file("file_block_start"), F.monotonically_increasing_id())
    return feed_rows(items.withColumn("pos", place), base).orderBy("pos").limit(limit).select("url", "title")


# --- fixed values: the two log line formats -------------------------------------------------------------------------
RESIDUAL_LINE = r"\w+: \d+ âm tiết không tự sửa được \(ví dụ: (\[.*?\])\)"
REPAIR_LINE = r"\w+: sửa thêm \d+ âm tiết bằng \S+ \(ví dụ: (\[.*?\])\)"


def log_residuals(log: DataFrame) -> DataFrame:
    """(bad) words the log lists as not repairable, one row per mention."""
    listed = F.regexp_extract("value", RESIDUAL_LINE, 1)
    return log.select(F.explode(F.regexp_extract_all(listed, F.lit("""'([^']*)'|"([^"]*)\""""), F.lit(0))).alias("_q")).select(
        F.expr("substring(_q, 2, length(_q) - 2)").alias("bad")
    )


def log_repairs(log: DataFrame) -> DataFrame:
    """(bad, variant) repairs the log reports; a line of the first kind is not read as one of the second."""
    listed = F.when(~F.col("value").rlike(RESIDUAL_LINE), F.regexp_extract("value", REPAIR_LINE, 1))
    pair = r"\('([^']*)', '([^']*)'\)"
    rows = log.select(F.explode(F.regexp_extract_all(listed, F.lit(pair), F.lit(0))).alias("_p"))
    return rows.select(F.regexp_extract("_p", pair, 1).alias("bad"), F.regexp_extract("_p", pair, 2).alias("variant"))


def quality_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    log = spark.read.text(path)
    return log_residuals(log), log_repairs(log)


def lexicon_lines(rows: DataFrame) -> DataFrame:
    """One syllable per line, trimmed and lowercased, blank lines dropped."""
    word = F.lower(strip(F.col("value")))
    return rows.select(word.alias("syllable")).filter("syllable <> ''")


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """S7."""
    return lexicon_lines(spark.read.text(path)).distinct()


def header_fields(text, slug) -> list[Column]:
    """Title, genres and author of a sidecar text; the title falls back to the slug in words."""
    rows = lines(col(text))
    titles = F.filter(rows, lambda x: ~F.startswith(x, F.lit("=")) & ~F.startswith(x, F.lit("#")))

    def last(pattern):
        hits = F.filter(F.transform(rows, lambda x: strip(F.regexp_extract(x, pattern, 1))), lambda x: x != "")
        return F.coalesce(F.get(hits, F.size(hits) - 1), F.lit(""))

    return [
        F.coalesce(F.get(titles, F.lit(0)), F.initcap(F.replace(col(slug), F.lit("-"), F.lit(" ")))).alias("title"),
        last(r"(?i)The loai[:\s]+([^\s|]+)").alias("genres"),
        last(r"(?i)Tac gia[:\s]+([^|]+)").alias("author"),
    ]


def sidecars(spark: SparkSession, pattern: str) -> DataFrame:
    """(slug, title, genres, author) of the sidecar files, the slug being the folder's name."""
    raw = spark.read.text(pattern, wholetext=True).withColumn("slug", _dir_name(1))
    return raw.select("slug", *header_fields("value", "slug"))


def audio_files(listing: DataFrame) -> DataFrame:
    """(path, number, bytes) of files named chapter_N.mp3; ``listing``: path, length. A number above int is null."""
    n = F.regexp_extract("path", r"(?:\A|/)chapter_(\d+)\.mp3\z", 1)
    return listing.filter(n != "").select("path", n.try_cast("int").alias("number"), F.col("length").alias("bytes"))


def file_listing(spark: SparkSession, pattern: str) -> DataFrame:
    """Paths and sizes of non-empty files; the contents are not read."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length")


def folder_listing(folders: DataFrame) -> DataFrame:
    """Paths and sizes of all files, empty ones included, in the given folders; every task lists its share of them."""

    def listed(frames):
        import pandas as pd
        from pyarrow import fs

        for frame in frames:
            rows = []
            for folder in frame["folder"]:
                store, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))
                found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
                rows += [(f"{folder.rstrip('/')}/{f.base_name}", f.size) for f in found if f.is_file]
            yield pd.DataFrame(rows, columns=["path", "length"])

    return folders.select("folder").mapInPandas(listed, "path string, length bigint")


def pending_uploads(audio: DataFrame, listing: DataFrame, force: bool = False, marker: str = ".uploaded") -> DataFrame:
    """Audio files without a marker file beside them; all of them with ``force``.

    Markers are empty files, so ``listing`` has to come from ``folder_listing``.
    """
    if force:
        return audio
    marked = listing.filter(F.endswith("path", F.lit(marker))).select(F.expr(f"substring(path, 1, length(path) - {len(marker)})").alias("path")).distinct()
    return audio.join(marked, "path", "left_anti")


def scenes_with_images(scenes: DataFrame, listing: DataFrame, folder: str = "images") -> DataFrame:
    """Scenes whose named image exists, else their conventional one; the others drop out.

    ``scenes``: work_id, scene, image; ``listing``: path, relative to the work's folder as ``work_id/...``.
    """
    paths = listing.select("path").distinct()
    usual = F.concat("work_id", F.lit(f"/{folder}/scene_"), F.format_string("%03d", F.col("scene")), F.lit(".jpg"))
    out = scenes.join(paths.select(F.col("path").alias("_named")), F.col("image") == F.col("_named"), "left")
    out = out.withColumn("_u", usual).join(paths.select(F.col("path").alias("_usual")), F.col("_u") == F.col("_usual"), "left")
    return out.withColumn("image", F.coalesce("_named", "_usual")).filter("image is not null").select(*scenes.columns)
