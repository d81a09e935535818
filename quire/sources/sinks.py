"""Writers and the layouts they write."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from quire.functions import text as t
from quire.functions import urls
from quire.functions.predicates import is_published
from quire.operators.changes import latest
from quire.operators.ordered import WIDTH, Running, global_rank, ordered
from quire.operators.segment import pack_sections
from quire.session import checkpoint, checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path on the shared storage."""
    return f"{checkpoint_dir(spark)}/quire/{name}-{uuid.uuid4().hex}"


def stage_sections(stored: DataFrame | None, incoming: DataFrame, path: str, order: str) -> None:
    """K1: sections as JSON under ``path/slug=…``; the same (slug, number) is overwritten, untouched works stay.

    ``stored`` is what the folder holds now, read from an earlier version of it; None is for a new folder only. Of a number sent
    twice the last by ``order`` is written; ``order`` itself is not.
    """
    spark = incoming.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if stored is None and folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        raise ValueError("the folder exists: pass what it holds, or its sections would be lost")
    rows = latest(incoming, ["slug", "number"], order).drop(order)
    if stored is not None:
        touched = stored.join(incoming.select("slug").distinct(), "slug", "left_semi")
        rows = touched.join(rows.select("slug", "number"), ["slug", "number"], "left_anti").unionByName(rows.select(*touched.columns))
    # a work's rows meet in few files, a very long work in one file per block of numbers
    rows = rows.repartition("slug", F.floor(F.col("number") / WIDTH))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slug").json(path)


def dated_layout(works: DataFrame, stamp: str = "updated_at") -> DataFrame:
    """K2: each work under the day it last changed; a row that already carries a day keeps it."""
    day = F.date_format(stamp, "yyyy-MM-dd")
    if "load_date" in works.columns:
        return works.withColumn("load_date", F.coalesce("load_date", day))
    return works.withColumn("load_date", day)


def write_dated(works: DataFrame, path: str, stamp: str = "updated_at", key: str = "work_id") -> None:
    """K2: partitioned by day. What is there stays: a work is added to a day that does not hold it yet, as its latest row."""
    spark = works.sparkSession
    rows = dated_layout(works, stamp)
    rows = latest(rows, ["load_date", key], stamp)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(folder) and fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/load_date=*")):
        held = spark.read.schema(rows.schema).parquet(path).select("load_date", key)
        # files are added, none is replaced, so the folder can be read while the rows are written
        rows = rows.join(held, ["load_date", key], "left_anti")
    # a day's rows meet in one file, not in one per shuffle partition; the adaptive planner splits a day of very many
    rows = rows.hint("rebalance", "load_date")
    rows.write.mode("append").partitionBy("load_date").parquet(path)


# --- totals from the pass that writes --------------------------------------------------------------------------------


def write_counted(df: DataFrame, path: str, mode: str = "overwrite", **totals: Column) -> dict:
    """Write ``df`` as Parquet and return ``totals`` (aggregates over all its rows) as that same pass saw them."""
    seen = Observation()
    df.observe(seen, *[value.alias(name) for name, value in totals.items()]).write.mode(mode).parquet(path)
    return seen.get


def write_outcomes(outcomes: DataFrame, path: str, statuses: tuple[str, ...] = ("ok", "skipped", "failed")) -> DataFrame:
    """The rows written, and (status, rows, amount) of each status met, counted on the way; null statuses and others count as ``other``."""
    status = F.when(F.col("status").isin(*statuses), F.col("status")).otherwise("other")
    names = (*statuses, "other")
    per = {f"n{i}": F.count_if(status == s) for i, s in enumerate(names)} | {f"a{i}": F.sum(F.when(status == s, F.col("amount"))) for i, s in enumerate(names)}
    got = write_counted(outcomes, path, **per)
    rows = [(s, got[f"n{i}"], got[f"a{i}"]) for i, s in enumerate(names) if got[f"n{i}"]]
    return outcomes.sparkSession.createDataFrame(rows, "status string, rows long, amount long")


def write_conserved(sections: DataFrame, keep: Column, path: str, tolerance: float = 0.02) -> dict:
    """The sections that ``keep`` keeps are written; rows and words before and after, and whether the words differ by at most
    ``tolerance``, come from the one scan that reads and writes them. A null ``keep`` drops the row."""
    before = Observation()
    words = F.coalesce(F.sum("word_count"), F.lit(0))
    read = sections.observe(before, F.count(F.lit(1)).alias("rows"), words.alias("words"))
    after = write_counted(read.filter(keep), path, rows=F.count(F.lit(1)), words=words)
    was = before.get
    return {
        "rows_before": was["rows"], "rows_after": after["rows"], "words_before": was["words"], "words_after": after["words"],
        "conserved": abs(after["words"] - was["words"]) <= was["words"] * tolerance,
    }


# --- fixed values: opening and closing lines of an export -----------------------------------------------------------
GREETING = "Chào mừng các bạn đến với %s. Chúc các bạn nghe truyện vui vẻ."
GREETING_PART = " (Phần %d/%d)"
END_PART = "Hết phần %d. Mời các bạn nghe tiếp phần %d."
END_PART_CHANNEL = " Nhớ like và đăng ký kênh %s."
END = "Hoàn văn."
END_CHANNEL = "Hoàn văn. Nhớ like và đăng ký kênh %s để nghe nhiều chuyện ngôn tình hay."


def _frame(channel: str, part: Column, total: Column) -> tuple[Column, Column]:
    many = part.isNotNull()
    suffix = F.when(many, F.format_string(GREETING_PART, part, total)).otherwise("")
    if channel:
        head = F.concat(F.lit(GREETING % channel), suffix)
    else:
        head = F.concat("title", F.lit(" — "), F.coalesce("author", F.lit("")), suffix)
    on = F.concat(F.format_string(END_PART, part, part + 1), F.lit(END_PART_CHANNEL % channel if channel else ""))
    last = F.lit(END_CHANNEL % channel if channel else END)
    return head, F.when(many & (part < total), on).otherwise(last)


def export_texts(works: DataFrame, sections: DataFrame, limit: int = 60_000, channel: str = "", clean=t.clean_body) -> DataFrame:
    """K4: (work_id, part, parts, file, text): one text per work or, above ``limit`` characters, per part.

    A part holds at most ``limit`` characters or one longer section, so a group below is bounded.
    """
    # four narrow columns that are used three times below
    packed = checkpoint(pack_sections(sections.select("work_id", "number", F.length(F.coalesce("content", F.lit(""))).alias("length")), limit))
    totals = packed.groupBy("work_id").agg(F.max("part").alias("parts"), F.sum("length").alias("_chars"))
    body = F.flatten(F.transform(t.lines(clean(F.coalesce("content", F.lit("")))), lambda x: F.array(x, F.lit(""))))
    # the one-element explode keeps the filter below from cleaning every text a second time
    rows = sections.select("work_id", "number", F.explode(F.array(body)).alias("_lines")).join(packed.select("work_id", "number", "part"), ["work_id", "number"])
    filled = rows.filter(F.size("_lines") > 0).groupBy("work_id", "part").agg(F.array_sort(F.collect_list(F.struct("number", "_lines"))).alias("_s"))
    parts = packed.select("work_id", "part").distinct().join(filled, ["work_id", "part"], "left").join(totals, "work_id")
    parts = parts.join(works.select("work_id", "slug", "title", "author"), "work_id")
    part = F.when(F.col("_chars") > limit, F.col("part"))
    head, tail = _frame(channel, part, F.col("parts"))
    middle = F.coalesce(F.flatten(F.transform("_s", lambda s: s["_lines"])), F.array().cast("array<string>"))
    text = F.array_join(F.concat(F.array(head, F.lit("")), middle, F.array(tail)), "\n")
    file = F.concat("slug", F.coalesce(F.concat(F.lit("_p"), part.cast("string")), F.lit("")), F.lit(".txt"))
    return parts.select("work_id", part.alias("part"), "parts", file.alias("file"), text.alias("text"))


def write_texts(texts: DataFrame, path: str) -> None:
    """One folder per file name, each holding one text."""
    texts.select("file", "text").write.mode("overwrite").partitionBy("file").option("lineSep", "\n").text(path)


def batches(rows: DataFrame, keys: list[str], size: int = 100) -> DataFrame:
    """K6: (batch, rows, payload): consecutive rows in the order of ``keys``, ``size`` to a JSON payload."""
    ranked = global_rank(rows, keys, "_rank")
    packed = F.struct("_rank", F.struct(*rows.columns).alias("row"))
    out = ranked.groupBy(F.floor(F.col("_rank") / size).alias("batch")).agg(F.array_sort(F.collect_list(packed)).alias("_r"))
    payload = F.to_json(F.transform("_r", lambda r: r["row"]), {"ignoreNullFields": "false"})
    return out.select("batch", F.size("_r").alias("rows"), payload.alias("payload"))


def import_payloads(works: DataFrame, sections: DataFrame, size: int = 500) -> DataFrame:
    """K7: (slug, piece, payload): the work with defaulted fields and its published sections in order.

    A work of many sections is sent in pieces of ``size`` sections; only the first asks to replace what is stored, the
    others add to it.
    """
    rows = ordered(
        sections.filter(is_published()).select("work_id", "number", "title", "content"), "work_id", "number", _rank=Running(F.lit(1), inclusive=False)
    )
    rows = rows.withColumn("piece", F.floor(F.col("_rank") / size).cast("int"))
    pieces = rows.groupBy("work_id", "piece").agg(F.array_sort(F.collect_list(F.struct("number", "title", "content"))).alias("chapters"))
    out = works.join(pieces, "work_id", "left").withColumn("piece", F.coalesce("piece", F.lit(0)))
    novel = F.struct(
        "title",
        t.default_if_blank("author", "Đang cập nhật").alias("author"),
        F.coalesce("description", F.lit("")).alias("description"),
        t.default_if_blank("genres", "ngon-tinh").alias("genres"),
        F.coalesce("tags", F.lit("")).alias("tags"),
        t.default_if_blank("status", "completed").alias("status"),
        urls.trimmed(F.coalesce("source_url", F.lit(""))).alias("source_url"),
        F.coalesce("cover_image", F.lit("")).alias("cover_image"),
    )
    chapters = F.coalesce("chapters", F.array().cast("array<struct<number:int,title:string,content:string>>"))
    payload = F.to_json(F.struct(novel.alias("novel"), chapters.alias("chapters"), (F.col("piece") == 0).alias("replace_chapters")), {"ignoreNullFields": "false"})
    return out.select("slug", "piece", F.size(chapters).alias("sections"), payload.alias("payload"))


# --- versions of a table --------------------------------------------------------------------------------------------


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions below ``root``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/version=*/_SUCCESS")) if fs.exists(path) else None
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in (found or []))


def snapshot(df: DataFrame, root: str) -> str:
    """K8: write the next version of a table; the versions before it stay and can still be read while it is written."""
    known = _versions(df.sparkSession, root)
    path = f"{root}/version={(known[-1] if known else 0) + 1:06d}"
    df.write.mode("overwrite").parquet(path)
    return path


def current(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """K8: the newest complete version, or the given one."""
    known = _versions(spark, root)
    if not known:
        raise FileNotFoundError(f"no complete version below {root}")
    return spark.read.parquet(f"{root}/version={version or known[-1]:06d}")
