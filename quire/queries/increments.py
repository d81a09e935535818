"""Incremental queries: batch forms against SQL and streams run over the given files."""

from pyspark.sql import functions as F

from quire.functions import rules
from quire.operators import changes as ch
from quire.queries.repair import BASES, _vocab
from quire.queries.base import sections_c
from quire.registry import query, table
from quire.session import is_folder
from quire.sources.sinks import scratch
from quire.streaming import incremental as inc


def stream(spark, d, name):
    """A file stream over one of the tables, which comes as one file or as a folder of files."""
    path = f"{d}/{name}.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema)
    if is_folder(spark, path):
        return rows.parquet(path)
    return rows.option("pathGlobFilter", f"{name}.parquet").parquet(d)


STATE = """listing AS (SELECT 'https://w.example/' || conv_id || CASE WHEN turn % 2 = 0 THEN '/' ELSE '' END AS url, (turn + 1)::INT AS number FROM conversations),
state AS (SELECT DISTINCT 'https://w.example/' || conv_id AS url, (conv_id % 6)::INT AS last_number, 1 AS known_sections FROM conversations WHERE conv_id % 5 <> 0)"""


def _listing(spark, d):
    c = table(spark, d, "conversations")
    listing = c.select(
        F.concat(F.lit("https://w.example/"), F.col("conv_id").cast("string"), F.when(F.col("turn") % 2 == 0, "/").otherwise("")).alias("url"),
        (F.col("turn") + 1).cast("int").alias("number"))
    state = c.filter("conv_id % 5 <> 0").select("conv_id").distinct().select(
        F.concat(F.lit("https://w.example/"), F.col("conv_id").cast("string")).alias("url"), (F.col("conv_id") % 6).cast("int").alias("last_number"), F.lit(1).alias("known_sections"))
    return listing, state


@query("I1_new_sections", f"WITH {STATE} SELECT DISTINCT l.url, number FROM listing l JOIN state s ON regexp_replace(l.url, '/+$', '') = s.url WHERE number > last_number")
def _(spark, d):
    return inc.new_sections(*_listing(spark, d))


@query("I1_checked_state", f"""WITH {STATE} SELECT s.url, last_number, count(*) AS known_sections, (count(*) FILTER (number > last_number))::BIGINT AS new_sections, min(number) FILTER (number > last_number) AS first_new, max(number) FILTER (number > last_number) AS last_new
FROM state s JOIN listing l ON regexp_replace(l.url, '/+$', '') = s.url GROUP BY ALL""")
def _(spark, d):
    return inc.checked_state(*_listing(spark, d))


@query("I1_acknowledge", f"""WITH {STATE} SELECT s.url, greatest(last_number, coalesce((SELECT max(number) FROM listing l WHERE number <= 4 AND regexp_replace(l.url, '/+$', '') = s.url), 0)) AS last_number, known_sections FROM state s""")
def _(spark, d):
    listing, state = _listing(spark, d)
    return inc.acknowledge(state, listing.filter("number <= 4"))


@query("I1_watch_stream", """SELECT 'https://w.example/' || conv_id AS url, turn + 1 AS number, (conv_id % 4)::BIGINT AS mark FROM conversations
WHERE role = 'user' AND turn + 1 > conv_id % 4""")
def _(spark, d):
    c = stream(spark, d, "conversations")
    events = c.select(
        F.concat(F.lit("https://w.example/"), F.col("conv_id").cast("string"), F.lit("/")).alias("url"),
        F.when(F.col("role") == "user", "listing").otherwise("ack").alias("kind"), (F.col("turn") + 1).alias("number"))
    events = events.unionByName(events)  # every listing twice
    marks = table(spark, d, "conversations").select(
        F.concat(F.lit("https://w.example/"), F.col("conv_id").cast("string")).alias("url"), (F.col("conv_id") % 4).alias("last_number")).distinct()
    folder = scratch(spark, "watch")
    inc.run_to_folder(inc.watch_stream(events, marks), folder, settings=inc.STORE)
    # once more from its checkpoint: nothing is sent again
    return inc.run_to_folder(inc.watch_stream(events, marks), folder, settings=inc.STORE).select("url", "number", "mark")


# a user who is silent for twelve hours is forgotten
@query("I1_forgotten", """SELECT 'u' || user_id AS url, (max(event_id) FILTER (event_type <> 'click'))::BIGINT AS last_open FROM events GROUP BY user_id
HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def _(spark, d):
    e = stream(spark, d, "events").withColumn("at_", F.col("ts").cast("timestamp"))
    events = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), F.lit("listing").alias("kind"), F.when(F.col("event_type") == "click", F.lit(-1)).otherwise(F.col("event_id")).alias("number"), "at_")
    out = inc.run_to_folder(inc.watch_stream(events, stamp="at_", forget_hours=12), scratch(spark, "forgotten"), settings=inc.STORE)
    return out.filter("forgotten").groupBy("url").agg(F.max("number").alias("last_open"))


@query("I2_watch_add", f"""WITH {STATE} SELECT min(url) AS url FROM listing WHERE regexp_replace(url, '/+$', '') NOT IN (SELECT url FROM state) GROUP BY regexp_replace(url, '/+$', '')""")
def _(spark, d):
    listing, state = _listing(spark, d)
    return ch.watch_add(state, listing.select("url"))


@query("I2_watch_remove", f"WITH {STATE} SELECT url FROM state WHERE url NOT LIKE '%7'")
def _(spark, d):
    listing, state = _listing(spark, d)
    return ch.watch_remove(state, listing.filter(F.col("url").rlike(r"7/?\z")).select("url")).select("url")


@query("I3_incremental_load", "SELECT 'c' || conv_id AS work_id, turn + 1 AS number, 1 AS sent FROM conversations WHERE NOT (turn % 3 = 1)")
def _(spark, d):
    root = scratch(spark, "load")
    rows = stream(spark, d, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("work_id"), (F.col("turn") + 1).alias("number"))
    stored = sections_c(spark, d).filter((F.col("number") - 1) % 3 == 1)
    rows = rows.withColumn("sent", F.explode(F.array(F.lit(2), F.lit(1))))  # every number twice
    job = rows.writeStream.foreachBatch(inc.resume_writer(f"{root}/table", rows.schema, "sent", stored)).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    return inc.read_batches(spark, f"{root}/table", rows.schema).select("work_id", "number", "sent")


@query("I4_replace_stream", "SELECT 'c' || conv_id AS work_id, turn + 1 AS number FROM conversations WHERE turn <= 2")
def _(spark, d):
    root = scratch(spark, "replace")
    rows = stream(spark, d, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("work_id"), (F.col("turn") + 1).alias("number"))
    # a first import of everything, then a smaller one of the same works
    inc.replace_writer(f"{root}/table")(sections_c(spark, d).select("work_id", F.col("number").cast("bigint").alias("number")), 0)
    write = inc.replace_writer(f"{root}/table")
    job = rows.filter("number <= 3").writeStream.foreachBatch(lambda b, i: write(b, i + 1)).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    return inc.replaced_sections(spark, f"{root}/table", rows.schema)


WINDOWS = """SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS changes FROM (
SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR, time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 2 HOUR]) AS s FROM events){where} GROUP BY s, event_type"""


@query("I5_change_feed", WINDOWS.replace("{where}", ""))
def _(spark, d):
    feed = inc.change_feed(table(spark, d, "events"), "ts", "3 hours", "1 hour", None, "event_type")
    return feed.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "changes")


@query("I5_change_feed_stream", WINDOWS.replace("{where}", " WHERE s + INTERVAL 3 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"))
def _(spark, d):
    events = stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    feed = inc.change_feed(events, "ts", "3 hours", "1 hour", "10 minutes", "event_type")
    out = inc.run_to_folder(feed, scratch(spark, "feed"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "changes")


@query("I6_first_arrivals", "SELECT DISTINCT 'u' || user_id AS work_id, event_id % 7 AS number FROM events")
def _(spark, d):
    rows = stream(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("work_id"), (F.col("event_id") % 7).alias("number"))
    out = inc.run_to_folder(inc.first_arrivals(rows, "ts", "30 days"), scratch(spark, "arrivals"))
    return out.select("work_id", "number")


QUALITY = "WITH " + BASES + ", " + _vocab() + f""", occ AS (SELECT source, time_bucket(INTERVAL 6 HOUR, TIMESTAMP '2024-01-01' + to_minutes(doc_id)) AS w, unnest(regexp_extract_all(text, '{rules.TOKEN}')) AS token FROM documents)
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, source, total, invalid, round(invalid / total, 6) AS ratio, CASE WHEN invalid / total > 0.1 THEN 'reject' WHEN invalid / total > 0.02 THEN 'retry' ELSE 'ok' END AS verdict FROM (
SELECT w, source, count(*) AS total, (count(*) FILTER (suspicious AND NOT valid))::BIGINT AS invalid FROM occ JOIN tok_v USING (token) GROUP BY w, source)"""


def _stamped(docs):
    return docs.select("source", "text", F.timestamp_millis(F.lit(1704067200000) + F.col("doc_id") * 60000).alias("at"))


@query("I7_quality_monitor", QUALITY)
def _(spark, d):
    out = inc.quality_monitor(_stamped(table(spark, d, "documents")), "at", "6 hours", "source", "text")
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("I7_quality_monitor_stream", QUALITY + " WHERE w + INTERVAL 6 HOUR <= (SELECT TIMESTAMP '2024-01-01' + to_minutes(max(doc_id)) - INTERVAL 10 MINUTE FROM documents)")
def _(spark, d):
    monitor = inc.quality_monitor(_stamped(stream(spark, d, "documents")), "at", "6 hours", "source", "text", "10 minutes")
    out = inc.run_to_folder(monitor, scratch(spark, "monitor"))
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))
