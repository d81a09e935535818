"""Incremental work: new-section detection, idempotent loading, change feeds and a quality monitor."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from quire.functions import syllable as sy
from quire.functions import urls
from quire.operators.changes import earliest
from quire.operators.held import SCHEMA, held, merged, without_held

KEY = ["work_id", "number"]


# --- I1: sections beyond a stored high-water mark -------------------------------------------------------------------


def new_sections(listing: DataFrame, state: DataFrame) -> DataFrame:
    """(url, number) listed above the mark of a watched URL. ``listing``: url, number; ``state``: url, last_number."""
    marks = state.select(urls.trimmed("url").alias("_u"), "last_number")
    rows = listing.select("url", urls.trimmed("url").alias("_u"), "number").join(marks, "_u")
    return rows.filter(F.col("number") > F.col("last_number")).select("url", "number").distinct()


def checked_state(listing: DataFrame, state: DataFrame) -> DataFrame:
    """The state after a check: known sections and how many are new. The mark moves only on acknowledgement."""
    counts = listing.select(urls.trimmed("url").alias("_u"), "number").groupBy("_u").agg(F.count(F.lit(1)).alias("_known"))
    fresh = new_sections(listing, state).groupBy(urls.trimmed("url").alias("_u")).agg(
        F.count(F.lit(1)).alias("_new"), F.min("number").alias("first_new"), F.max("number").alias("last_new")
    )
    out = state.withColumn("_u", urls.trimmed("url")).join(counts, "_u", "left").join(fresh, "_u", "left")
    return out.select(
        "url", "last_number", F.coalesce("_known", "known_sections").alias("known_sections"), F.coalesce("_new", F.lit(0)).alias("new_sections"),
        "first_new", "last_new",
    )


def acknowledge(state: DataFrame, loaded: DataFrame) -> DataFrame:
    """Move the mark to the highest loaded number. ``loaded``: url, number."""
    top = loaded.groupBy(urls.trimmed("url").alias("_u")).agg(F.max("number").alias("_top"))
    out = state.withColumn("_u", urls.trimmed("url")).join(top, "_u", "left")
    return out.withColumn("last_number", F.greatest("last_number", "_top")).select(*state.columns)


class Watch(StatefulProcessor):
    """The mark of a watched URL, the numbers sent and not acknowledged yet, and when the URL is forgotten."""

    def __init__(self, forget_ms: int):
        self.forget_ms = forget_ms

    def init(self, handle) -> None:
        # every call of a state goes to the JVM and back: a key makes a fixed number of them in a batch, however many its numbers
        self.handle = handle
        self.mark = handle.getValueState("mark", "mark bigint, wake bigint")
        self.open = handle.getListState("open", "number bigint")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._store(int(initialState["last_number"].max()), None, timerValues.getCurrentWatermarkInMs() if self.forget_ms else 0)

    def _store(self, mark: int, wake: int | None, since: int) -> None:
        """Keep the mark, and move the timer from ``wake`` to where it belongs after an event at ``since``."""
        at = max(since, 0) + self.forget_ms if self.forget_ms else None
        if at != wake:
            if wake is not None:
                self.handle.deleteTimer(wake)
            self.handle.registerTimer(at)
        self.mark.update((mark, at))

    def handleInputRows(self, key, rows, timerValues):
        known = self.mark.get()
        mark, wake = (int(known[0]), known[1]) if known is not None else (0, None)
        top, newest, sent = mark, 0, set()
        for frame in rows:
            acked = frame.loc[frame["kind"] == "ack", "number"]
            top = max(top, int(acked.max()) if len(acked) else top)
            if self.forget_ms:
                newest = max(newest, int(frame["at"].max()))
            listed = set(frame.loc[(frame["kind"] == "listing") & (frame["number"] > mark), "number"].tolist()) - sent
            sent |= listed
            if listed:
                yield pd.DataFrame({"url": key[0], "number": sorted(listed), "mark": mark, "forgotten": False})
        before = {int(n) for (n,) in self.open.get()} if known is not None else set()
        after = {int(n) for n in before | sent if n > top}
        if before - after:
            self.open.put([(n,) for n in sorted(after)]) if after else self.open.clear()
        elif after - before:
            self.open.appendList([(n,) for n in sorted(after - before)])
        self._store(top, wake, newest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = self.mark.get()
        numbers = sorted(int(n) for (n,) in self.open.get())
        self.mark.clear()
        self.open.clear()
        yield pd.DataFrame({"url": key[0], "number": pd.array(numbers or [None], "Int64"), "mark": int(mark[0]) if mark is not None else 0, "forgotten": True})


#: The store that Spark's stateful processors keep their state in.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def watch_stream(events: DataFrame, marks: DataFrame | None = None, stamp: str | None = None, late: str = "1 hour", forget_hours: int = 0) -> DataFrame:
    """I1 as a stream. ``events``: url, kind (listing / ack), number. Emits (url, number, mark, forgotten) for listed numbers above
    the mark of their URL, each once a batch; an acknowledgement moves the mark for the batches after it. ``marks`` (url,
    last_number), a static table, is the state that URLs begin with.

    With ``stamp``, the time of an event, and ``forget_hours``, a URL without an event for so long is forgotten: its state goes, and the numbers
    sent and never acknowledged come out once more as ``forgotten`` (one null where there are none). Start it with ``run_to_folder``
    or under the settings of STORE.
    """
    keyed = events.withWatermark(stamp, late) if stamp else events
    columns = [urls.trimmed("url").alias("url"), F.col("kind"), F.col("number").cast("bigint").alias("number")]
    if stamp:
        columns += [F.col(stamp), F.unix_millis(stamp).alias("at")]
    start = None
    if marks is not None:
        start = marks.groupBy(urls.trimmed("url").alias("url")).agg(F.max("last_number").cast("bigint").alias("last_number")).groupBy("url")
    return keyed.select(*columns).groupBy("url").transformWithStateInPandas(
        Watch(forget_hours * 3_600_000 if stamp else 0), "url string, number bigint, mark bigint, forgotten boolean", "append", "EventTime" if stamp else "None", start,
    )


# --- I3 / I4: replay-safe loading -----------------------------------------------------------------------------------
#
# A section table that streams write to is a folder with one sub-folder per micro-batch. A batch that is run again
# overwrites its own sub-folder only, so a replay leaves the table as it was.


def read_batches(spark: SparkSession, root: str, schema) -> DataFrame:
    """All rows of a streamed table with the batch that wrote them; empty when nothing was written."""
    folders = list(_complete(spark, root, "batch").values())
    if not folders:
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("bigint"))
    return spark.read.schema(schema).option("basePath", root).parquet(*folders).withColumn("batch", F.regexp_extract("_metadata.file_path", r"batch=(\d+)", 1).cast("bigint"))


def _complete(spark: SparkSession, root: str, name: str) -> dict[int, str]:
    """The complete folders ``name``=N below ``root`` by N."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}=*/_SUCCESS")) if fs.exists(path) else None
    folders = [s.getPath().getParent() for s in (found or [])]
    return {int(f.getName().split("=")[1]): f.toString() for f in folders}


def held_numbers(spark: SparkSession, root: str, before: int | None = None, but: int | None = None) -> tuple[DataFrame, int, list[int]]:
    """The numbers a streamed table holds, as bitmaps (a work's may come in several rows), from the newest merged folder and the batches
    after it; that folder's batch (-1 without one) and those batches. ``but``: a batch that is left out."""
    top = max(_complete(spark, f"{root}/numbers", "upto"), default=-1)
    batches = {i: f for i, f in _complete(spark, f"{root}/numbers", "batch").items() if i > top and i != but and (before is None or i < before)}
    folders = ([f"{root}/numbers/upto={top}"] if top >= 0 else []) + list(batches.values())
    rows = spark.read.schema(SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], SCHEMA)
    return rows, top, sorted(batches)


def resume_writer(root: str, schema, order: str, stored: DataFrame | None = None, most: int = 32):
    """foreachBatch function that adds the (work, number) pairs the table does not have; of one sent twice in a batch
    the first by ``order``.

    Beside its rows a batch leaves bitmaps of their numbers, and the next ones read those only, never the rows. After ``most`` batches the
    bitmaps are merged. A batch that runs again overwrites what it left; one before the last merge is done and passes by.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known, top, batches = held_numbers(spark, root, but=batch_id)
        if batch_id <= top:
            return
        if stored is not None:
            if not _complete(spark, f"{root}/numbers", "stored"):
                held(stored).write.mode("overwrite").parquet(f"{root}/numbers/stored=0")
            known = known.unionByName(spark.read.schema(SCHEMA).parquet(f"{root}/numbers/stored=0"))
        fresh = earliest(without_held(batch, merged(known)), KEY, order)
        fresh.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")
        added = spark.read.schema(fresh.schema).parquet(f"{root}/batch={batch_id}")
        held(added).write.mode("overwrite").parquet(f"{root}/numbers/batch={batch_id}")
        if len(batches) >= most:
            earlier, _, done = held_numbers(spark, root, before=batch_id)
            if done:
                merged(earlier).write.mode("overwrite").parquet(f"{root}/numbers/upto={done[-1]}")

    return write


def replace_writer(root: str):
    """I4: foreachBatch function for replacing imports; the newest batch of a work is the work."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    return write


def replaced_sections(spark: SparkSession, root: str, schema) -> DataFrame:
    """I4: the table replacing imports leave behind."""
    rows = read_batches(spark, root, schema)
    newest = rows.groupBy("work_id").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["work_id", "batch"], "left_semi").drop("batch")


# --- I5 - I7 --------------------------------------------------------------------------------------------------------


def change_feed(changes: DataFrame, stamp: str, width: str, slide: str, late: str | None = None, *keys: str) -> DataFrame:
    """Changes per sliding window; ``late`` sets the watermark on a stream."""
    rows = changes.withWatermark(stamp, late) if late else changes
    out = rows.groupBy(F.window(stamp, width, slide), *keys).agg(F.count(F.lit(1)).alias("changes"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "changes")


def first_arrivals(rows: DataFrame, stamp: str, late: str) -> DataFrame:
    """The first arrival of each (work, number) on a stream, within the watermark."""
    return rows.withWatermark(stamp, late).dropDuplicatesWithinWatermark(KEY)


def quality_monitor(sections: DataFrame, stamp: str, width: str, key: str, text: str = "content", late: str | None = None,
                    warn: float = 0.02, reject: float = 0.10) -> DataFrame:
    """Share of damaged words per window and key against two thresholds."""
    rows = sections.withWatermark(stamp, late) if late else sections
    found = sy.tokens(text)
    rows = rows.select(stamp, key, F.size(found).alias("_t"), F.size(sy.invalid_tokens(text)).alias("_i"))
    out = rows.groupBy(F.window(stamp, width), key).agg(F.sum("_t").alias("total"), F.sum("_i").alias("invalid"))
    ratio = F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.col("invalid") / F.col("total"))
    return out.select(
        F.col("window.start").alias("window_start"), key, "total", "invalid", F.round(ratio, 6).alias("ratio"),
        F.when(ratio > reject, "reject").when(ratio > warn, "retry").otherwise("ok").alias("verdict"),
    )


def told_rows(job) -> dict[str, int]:
    """How many rows a stream has read, and how many came too late and were dropped, by the progress of its last batches (Spark keeps
    spark.sql.streaming.numRecentProgressUpdates of them)."""
    progress = [p for p in job.recentProgress]
    late = sum(o.numRowsDroppedByWatermark for p in progress for o in p.stateOperators)
    return {"read": sum(max(p.numInputRows, 0) for p in progress), "late": late}


def run_to_folder(stream: DataFrame, folder: str, mode: str = "append", settings: dict[str, str] | None = None, told: dict[str, int] | None = None) -> DataFrame:
    """Run a stream over what is there now and return what it wrote. ``settings`` hold for this stream only; ``told`` gets ``told_rows``."""
    spark = stream.sparkSession
    out = f"{folder}/out"
    before = {k: spark.conf.get(k, None) for k in settings or {}}
    for k, v in (settings or {}).items():
        spark.conf.set(k, v)
    try:
        job = (
            stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", f"{folder}/state")
            .trigger(availableNow=True).start()
        )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    job.awaitTermination()
    if told is not None:
        told |= told_rows(job)
    return spark.read.schema(stream.schema).parquet(out)
