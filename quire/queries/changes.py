"""Change application: upserts, resume and replace imports, partial updates, deletes."""

from pyspark.sql import functions as F

from quire.functions import text as t
from quire.operators import changes as ch
from quire.queries.base import sections_c, sections_v, works_c, works_v
from quire.queries.sql import on_c, on_v
from quire.registry import query, table


@query("X1_first_seen_links", """SELECT href, min(pos) AS pos, arg_min(page_id, pos) AS page_id FROM (
SELECT page_id, 'https://h.example' || regexp_extract(url, '^[a-z]+://[^/]+(/[a-z]+)', 1) AS href, page_id AS pos FROM pages) GROUP BY href""")
def _(spark, d):
    listed = table(spark, d, "pages").select(
        "page_id", F.concat(F.lit("https://h.example"), F.regexp_extract("url", r"\A[a-z]+://[^/]+(/[a-z]+)", 1)).alias("href"),
        F.col("page_id").alias("pos"))
    return ch.first_seen(listed, "href", "pos").select("href", "pos", "page_id")


INCOMING_V = """incoming AS (SELECT work_id, number + 30 AS number, 'new ' || title AS title, row_number() OVER (PARTITION BY work_id, number + 30 ORDER BY section_id) AS v FROM sections_v WHERE number % 2 = 0),
twice AS (SELECT work_id, number, title, v FROM incoming UNION ALL SELECT work_id, number, title || ' again', v + 1 FROM incoming WHERE number % 4 = 0)"""


def _incoming(s):
    base = s.filter("number % 2 = 0").select(
        "work_id", (F.col("number") + 30).alias("number"), F.concat(F.lit("new "), "title").alias("title"), F.lit(1).alias("v"))
    again = base.filter("number % 4 = 0").withColumn("title", F.concat("title", F.lit(" again"))).withColumn("v", F.col("v") + 1)
    return base.unionByName(again)


@query("X2_upsert_sections", on_v("""SELECT work_id, number, title FROM sections_v s WHERE NOT EXISTS (SELECT 1 FROM twice i WHERE i.work_id = s.work_id AND i.number = s.number)
UNION ALL SELECT work_id, number, arg_max(title, v) FROM twice GROUP BY work_id, number""", INCOMING_V))
def _(spark, d):
    s = sections_v(spark, d).select("work_id", "number", "title")
    return ch.upsert(s, _incoming(s), version="v").orderBy("work_id", "number")


@query("X3_resume_import", on_v("""SELECT work_id, number, title FROM sections_v UNION ALL SELECT work_id, number, arg_min(title, v) FROM twice i
WHERE NOT EXISTS (SELECT 1 FROM sections_v s WHERE i.work_id = s.work_id AND i.number = s.number) GROUP BY work_id, number""", INCOMING_V))
def _(spark, d):
    s = sections_v(spark, d).select("work_id", "number", "title")
    incoming = _incoming(s)
    return ch.resume(s, incoming, "v")


@query("X3_resume_counts", on_v("""SELECT work_id, count(*) FILTER (NOT known) AS inserted, count(*) FILTER (known) AS skipped FROM (
SELECT DISTINCT work_id, number, EXISTS (SELECT 1 FROM sections_v s WHERE i.work_id = s.work_id AND i.number = s.number) AS known FROM twice i) GROUP BY work_id""", INCOMING_V))
def _(spark, d):
    s = sections_v(spark, d).select("work_id", "number", "title")
    return ch.resume_counts(s, _incoming(s))


PAYLOAD = "payload AS (SELECT work_id, number, 'again ' || title AS title FROM sections_c WHERE work_id LIKE '%7' AND number <= 3)"


def _payload(s):
    return s.filter(F.col("work_id").endswith("7") & (F.col("number") <= 3)).withColumn("title", F.concat(F.lit("again "), "title"))


@query("X4_replace_import", on_c("""SELECT work_id, number, title FROM sections_c WHERE work_id NOT IN (SELECT work_id FROM payload)
UNION ALL SELECT work_id, number, title FROM payload""", PAYLOAD))
def _(spark, d):
    s = sections_c(spark, d).select("work_id", "number", "title")
    return ch.replace_works(s, _payload(s))


@query("X4_replace_counts", on_c("""SELECT p.work_id, deleted, inserted, lost_extras FROM (SELECT work_id, count(*) AS inserted FROM payload GROUP BY work_id) p JOIN
(SELECT work_id, count(*) AS deleted, (count(*) FILTER (coalesce(audio_url, '') <> '' OR coalesce(summary, '') <> '' OR coalesce(highlight, '') <> '' OR coalesce(next_preview, '') <> ''))::BIGINT AS lost_extras
FROM sections_c GROUP BY work_id) USING (work_id)""", PAYLOAD))
def _(spark, d):
    s = sections_c(spark, d)
    return ch.replace_counts(s, _payload(s.select("work_id", "number", "title")))


FRESH = """fresh AS (SELECT work_id, CASE WHEN length(work_id) % 2 = 0 THEN '' ELSE 'fresh review' END AS editorial_review, CASE WHEN work_id LIKE '%3' THEN NULL ELSE 'fresh faq' END AS faq
FROM works_c WHERE work_id LIKE '%3' OR work_id LIKE '%5')"""


def _fresh(works):
    return works.filter(F.col("work_id").rlike("[35]$")).select(
        "work_id", F.when(F.length("work_id") % 2 == 0, "").otherwise("fresh review").alias("editorial_review"),
        F.when(~F.col("work_id").endswith("3"), F.lit("fresh faq")).alias("faq"))


@query("X5_update_filled", on_c("""SELECT w.work_id, coalesce(nullif(f.editorial_review, ''), w.editorial_review) AS editorial_review, w.character_analysis,
coalesce(nullif(f.faq, ''), w.faq) AS faq FROM works_c w LEFT JOIN fresh f USING (work_id)""", FRESH))
def _(spark, d):
    works = works_c(spark, d).select("work_id", "editorial_review", "character_analysis", "faq")
    return ch.update_filled(works, _fresh(works), ["work_id"], ["editorial_review", "faq"])


@query("X6_update_report", on_c("""SELECT work_id, number, CASE WHEN EXISTS (SELECT 1 FROM sections_c s WHERE s.work_id = i.work_id AND s.number = i.number) THEN 'updated' ELSE 'not_found' END AS status
FROM (SELECT work_id, number + 2 AS number FROM sections_c) i"""))
def _(spark, d):
    s = sections_c(spark, d)
    return ch.update_report(s, s.select("work_id", (F.col("number") + 2).alias("number")), ["work_id", "number"])


@query("X7_cascading_delete", on_v("""SELECT 'work' AS kind, work_id, 0 AS number FROM works_v WHERE work_id NOT LIKE '%1' UNION ALL
SELECT 'section', work_id, number FROM sections_v WHERE work_id NOT LIKE '%1'"""))
def _(spark, d):
    works, sections = works_v(spark, d), sections_v(spark, d)
    w, s = ch.delete_works(works, sections, works.filter(F.col("work_id").endswith("1")))
    return w.select(F.lit("work").alias("kind"), "work_id", F.lit(0).alias("number")).unionByName(
        s.select(F.lit("section").alias("kind"), "work_id", "number"))


@query("X8_unseen_works", on_c("""SELECT slug FROM (SELECT DISTINCT 'c' || (doc_id % 500) AS slug FROM documents) EXCEPT SELECT slug FROM works_c"""))
def _(spark, d):
    listed = table(spark, d, "documents").select(F.concat(F.lit("c"), (F.col("doc_id") % 500).cast("string")).alias("slug")).distinct()
    return listed.join(works_c(spark, d).select("slug"), "slug", "left_anti")


NEW_WORKS = """new_works AS (SELECT 'n' || doc_id AS work_id, 'c' || (doc_id % 150) AS slug, TIMESTAMP '2024-05-01' + to_hours(doc_id % 7) AS created_at FROM documents)"""


@query("X9_unique_slugs", on_c("""SELECT work_id, CASE WHEN rn > 1 OR slug IN (SELECT slug FROM works_c) THEN slug || '-' || substr(sha256(work_id), 1, 8) ELSE slug END AS slug FROM (
SELECT *, row_number() OVER (PARTITION BY slug ORDER BY created_at, work_id) AS rn FROM new_works)""", NEW_WORKS))
def _(spark, d):
    k = F.col("doc_id")
    incoming = table(spark, d, "documents").select(
        F.concat(F.lit("n"), k.cast("string")).alias("work_id"), F.concat(F.lit("c"), (k % 150).cast("string")).alias("slug"),
        (F.lit("2024-05-01 00:00:00").cast("timestamp") + F.make_interval(hours=(k % 7).cast("int"))).alias("created_at"))
    return ch.unique_slugs(incoming, works_c(spark, d)).select("work_id", "slug")


def _slug_sql(k):
    return "slug" if not k else "slug || '-' || substr(sha256(work_id), 1, 8)" + (f" || '-{k}'" if k > 1 else "")


def _rounds(n):
    """The rounds of X9, written out: who asks in round k and who gets the slug."""
    out = []
    for k in range(n):
        lost = "".join(f" AND work_id NOT IN (SELECT work_id FROM won{j})" for j in range(k))
        free = "".join(f" AND t NOT IN (SELECT t FROM won{j})" for j in range(k))
        out.append(f"""won{k} AS (SELECT work_id, t FROM (SELECT work_id, t, row_number() OVER (PARTITION BY t ORDER BY created_at, work_id) AS rn FROM (SELECT *, {_slug_sql(k)} AS t FROM new_works WHERE true{lost}))
  WHERE rn = 1 AND t NOT IN (SELECT slug FROM stored_slugs){free})""")
    return ", ".join(out)


# stored works own the first suffix of every tenth new one, and the second of every twentieth
PLANTED = """stored_slugs AS (SELECT slug FROM works_c UNION SELECT slug || '-' || substr(sha256(work_id), 1, 8) FROM new_works WHERE doc_id % 10 = 3
  UNION SELECT slug || '-' || substr(sha256(work_id), 1, 8) || '-2' FROM new_works WHERE doc_id % 20 = 3)"""


@query("X9_slugs_until_free", on_c("SELECT work_id, t AS slug FROM won0 UNION ALL SELECT work_id, t FROM won1 UNION ALL SELECT work_id, t FROM won2 UNION ALL SELECT work_id, t FROM won3",
                                   f"{NEW_WORKS.replace('SELECT ', 'SELECT doc_id, ', 1)}, {PLANTED}, {_rounds(4)}"))
def _(spark, d):
    k = F.col("doc_id")
    new = table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("n"), k.cast("string")).alias("work_id"), F.concat(F.lit("c"), (k % 150).cast("string")).alias("slug"),
        (F.lit("2024-05-01 00:00:00").cast("timestamp") + F.make_interval(hours=(k % 7).cast("int"))).alias("created_at"))
    name = lambda i: ch.slug_candidate(F.col("slug"), F.col("work_id"), i).alias("slug")
    stored = works_c(spark, d).select("slug").unionByName(new.filter("doc_id % 10 = 3").select(name(1))).unionByName(new.filter("doc_id % 20 = 3").select(name(2)))
    return ch.unique_slugs(new, stored).select("work_id", "slug")


@query("K10_change_log", on_v("""SELECT slug, before, after FROM (SELECT slug, description AS before,
CASE WHEN length(description) <= 40 THEN description ELSE substr(description, 1, 40) END AS after FROM works_v) WHERE before IS DISTINCT FROM after"""))
def _(spark, d):
    return ch.change_log(works_v(spark, d), ["slug"], "description", F.substring("description", 1, 40))


@query("T42_defaults", on_c("SELECT slug, coalesce(nullif(author, ''), 'unknown') AS author, coalesce(nullif(status, ''), 'completed') AS status FROM works_c"))
def _(spark, d):
    return works_c(spark, d).select("slug", t.default_if_blank("author", "unknown").alias("author"), t.default_if_blank("status", "completed").alias("status"))


MIXED = "CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') END"


@query("F12_mixed_timestamps", """SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS at FROM events""")
def _(spark, d):
    e = table(spark, d, "events")
    even = F.col("event_id") % 2 == 0
    ts = F.col("ts").cast("timestamp")
    iso = F.when(even, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
    ms = F.when(~even, F.unix_millis(ts))
    return e.select("event_id", F.date_format(ch.normal_time(iso, ms), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("T43_retitle", on_v("""SELECT section_id, CASE WHEN title GLOB 'Phần [0-9]*' AND number % 3 <> 0 THEN 'New name ' || number ELSE title END AS title FROM sections_v"""))
def _(spark, d):
    from quire.plans.ingest import retitle

    s = sections_v(spark, d).select("section_id", "number", "title")
    n = F.col("number").cast("string")
    answers = s.select("section_id", F.when(F.col("number") % 3 == 0, F.lit("word " * 16)).otherwise(F.concat(F.lit('"New name '), n, F.lit('."'))).alias("text"))
    return retitle(s, answers).select("section_id", "title")


@query("ingest_new_sections")
def _(spark, d):
    from quire.operators.ordered import Running, ordered
    from quire.plans.ingest import new_sections

    pages = table(spark, d, "pages").withColumn("work_id", F.concat(F.lit("h"), (F.col("page_id") % 7).cast("string")))
    pages = ordered(pages, "work_id", "page_id", pos=Running(F.lit(1), inclusive=False)).withColumn("pos", F.col("pos").cast("int"))
    pages = pages.withColumn("url", F.concat("url", F.lit("/chuong-"), (F.col("pos") + 1).cast("string")))
    stored = pages.filter("pos % 4 = 0").select("work_id", (F.col("pos") + 1).alias("number"))
    domains = spark.createDataFrame([("example.com", "a", 1), ("example.net", "b", 2)], "domain string, source string, reg_order int")
    out = new_sections(pages, stored, domains)
    return out.select("work_id", "number", "word_count", F.md5("content").alias("digest"))
