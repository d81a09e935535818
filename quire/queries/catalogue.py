"""Scans, filters, joins, aggregations and limits over the catalogue."""

from pyspark.sql import functions as F

from quire.functions import predicates as p
from quire.functions import rules
from quire.functions import text as t
from quire.functions import urls
from quire.operators import catalog
from quire.plans.audit import Thresholds, audit_rows, audit_summary
from quire.queries.base import sections_c, sections_v, works_c, works_v
from quire.queries.sql import on_c, on_v, strip
from quire.queries.texts import SENTENCES
from quire.registry import query, table
from quire.sources import sinks

SHORT_WORKS = Thresholds(min_words=30)

THIN = """SELECT slug, title, sections FROM (
  SELECT w.slug, w.title, coalesce(n, 0) AS sections FROM {w} w LEFT JOIN (
    SELECT work_id, count(*) AS n FROM {s} WHERE publish_status = 'published' GROUP BY work_id) c USING (work_id)
  WHERE w.publish_status = 'published') WHERE sections < {k}"""
UNENRICHED_W = """SELECT slug, title, editorial_review IS NOT NULL AND editorial_review <> '' AS has_review,
  character_analysis IS NOT NULL AND character_analysis <> '' AS has_analysis, faq IS NOT NULL AND faq <> '' AS has_faq
FROM {w} WHERE publish_status = 'published' AND (coalesce(editorial_review, '') = ''
  OR coalesce(character_analysis, '') = '' OR coalesce(faq, '') = '')"""
WEAK = """SELECT slug, title, length(coalesce(description, '')) AS description_length FROM {w}
WHERE publish_status = 'published' AND length(coalesce(description, '')) < 80"""
UNENRICHED_S = """SELECT section_id, number, s.title, word_count, w.slug AS work_slug, w.title AS work_title
FROM {s} s JOIN {w} w USING (work_id)
WHERE s.publish_status = 'published' AND (coalesce(summary, '') = '' OR coalesce(highlight, '') = '')"""
SHORT_S = """SELECT number, s.title, word_count, w.slug AS work_slug, w.title AS work_title
FROM {s} s JOIN {w} w USING (work_id) WHERE s.publish_status = 'published' AND word_count < {m}"""
SHORTEST = SHORT_S + " ORDER BY word_count, work_slug, number LIMIT 200"


def _audit_sql(w, s, m):
    f = dict(w=w, s=s, m=m, k=5)
    parts = [("thin_works", THIN, "slug"), ("unenriched_works", UNENRICHED_W, "slug"), ("weak_description", WEAK, "slug"),
             ("unenriched_sections", UNENRICHED_S, "work_slug"), ("short_sections", SHORTEST, "work_slug")]
    return " UNION ALL ".join(
        f"SELECT '{n}' AS signal, {c} AS work_slug, count(*) AS findings FROM ({q.format(**f)}) GROUP BY {c}"
        for n, q, c in parts
    )


@query("A2_audit_summary", on_c(_audit_sql("works_c", "sections_c", 30)))
def _(spark, d):
    return audit_summary(works_c(spark, d), sections_c(spark, d), SHORT_WORKS)


@query("A2_audit_summary_documents", on_v(_audit_sql("works_v", "sections_v", 300)))
def _(spark, d):
    return audit_summary(works_v(spark, d), sections_v(spark, d))


@query("A1_thin_works", on_c(THIN.format(w="works_c", s="sections_c", k=5)))
def _(spark, d):
    return catalog.thin_works(works_c(spark, d), sections_c(spark, d)).select("slug", "title", "sections")


@query("F3_unenriched_works", on_c(UNENRICHED_W.format(w="works_c")))
def _(spark, d):
    return catalog.unenriched_works(works_c(spark, d))


@query("F3_works_needing_enrichment", on_c("""SELECT slug FROM works_c WHERE coalesce(editorial_review, '') = ''
 OR coalesce(character_analysis, '') = '' OR coalesce(faq, '') IN ('', '[]')"""))
def _(spark, d):
    return works_c(spark, d).filter(p.work_needs_enriching()).select("slug")


@query("F6_weak_descriptions", on_c(WEAK.format(w="works_c")))
def _(spark, d):
    return catalog.weak_descriptions(works_c(spark, d))


@query("F2_unenriched_sections", on_v(UNENRICHED_S.format(w="works_v", s="sections_v")))
def _(spark, d):
    return catalog.unenriched_sections(works_v(spark, d), sections_v(spark, d)).drop("work_id")


@query("F5_short_sections", on_c(SHORT_S.format(w="works_c", s="sections_c", m=30)))
def _(spark, d):
    return catalog.short_sections(works_c(spark, d), sections_c(spark, d), 30).drop("work_id")


@query("L1_shortest_sections", on_v(SHORTEST.format(w="works_v", s="sections_v", m=300)))
def _(spark, d):
    return catalog.shortest(works_v(spark, d), sections_v(spark, d)).drop("work_id")


@query("K9_audit_report", on_c(f"""SELECT signal, work_slug, number::INT AS number, item FROM (
  SELECT 'thin_works' AS signal, slug AS work_slug, NULL AS number, '{{"slug":"' || slug || '","title":"' || title || '","sections":' || sections || '}}' AS item FROM ({THIN.format(w="works_c", s="sections_c", k=5)})
  UNION ALL SELECT 'unenriched_works', slug, NULL, '{{"slug":"' || slug || '","title":"' || title || '","has_review":' || has_review || ',"has_analysis":' || has_analysis || ',"has_faq":' || has_faq || '}}' FROM ({UNENRICHED_W.format(w="works_c")})
  UNION ALL SELECT 'weak_description', slug, NULL, '{{"slug":"' || slug || '","title":"' || title || '","description_length":' || description_length || '}}' FROM ({WEAK.format(w="works_c")})
  UNION ALL SELECT 'unenriched_sections', work_slug, number, '{{"section_id":"' || section_id || '","number":' || number || ',"title":"' || title || '","word_count":' || word_count || ',"work_slug":"' || work_slug || '","work_title":"' || work_title || '"}}' FROM ({UNENRICHED_S.format(w="works_c", s="sections_c")})
  UNION ALL SELECT 'short_sections', work_slug, number, '{{"number":' || number || ',"title":"' || title || '","word_count":' || word_count || ',"work_slug":"' || work_slug || '","work_title":"' || work_title || '"}}' FROM ({SHORTEST.format(w="works_c", s="sections_c", m=30)})
  UNION ALL SELECT 'thresholds', NULL, NULL, '{{"min_sections":5,"min_words":30,"min_description":80}}')"""))
def _(spark, d):
    return audit_rows(works_c(spark, d), sections_c(spark, d), SHORT_WORKS)


@query("S1_catalogue_scan", on_v("SELECT work_id, slug, title, status, publish_status, source_url FROM works_v"))
def _(spark, d):
    from quire import schemas
    from quire.sources.readers import catalogue_table
    from quire.sources.sinks import scratch

    path = scratch(spark, "catalogue")
    works_v(spark, d).write.parquet(path)
    return catalogue_table(spark, path, schemas.WORKS).select("work_id", "slug", "title", "status", "publish_status", "source_url")


@query("F1_published_sections", on_v("SELECT work_id, number FROM sections_v WHERE publish_status = 'published'"))
def _(spark, d):
    return sections_v(spark, d).filter(p.is_published()).select("work_id", "number")


@query("F4_sections_with_enrichment", on_v("""SELECT s.work_id, number, summary, highlight, next_preview FROM sections_v s
JOIN works_v w USING (work_id) WHERE coalesce(summary, '') <> '' OR coalesce(highlight, '') <> '' OR coalesce(next_preview, '') <> ''"""))
def _(spark, d):
    rows = sections_v(spark, d).filter(p.has_any("summary", "highlight", "next_preview"))
    return rows.join(works_v(spark, d).select("work_id"), "work_id").select(
        "work_id", "number", "summary", "highlight", "next_preview")


@query("F4_works_with_enrichment", on_v("""SELECT slug, editorial_review, character_analysis, faq FROM works_v
WHERE coalesce(editorial_review, '') <> '' OR coalesce(character_analysis, '') <> '' OR coalesce(faq, '') <> ''"""))
def _(spark, d):
    return works_v(spark, d).filter(p.has_any("editorial_review", "character_analysis", "faq")).select(
        "slug", "editorial_review", "character_analysis", "faq")


@query("F7_generic_titles", on_v("SELECT work_id, number, title FROM sections_v WHERE title GLOB 'Phần [0-9]*'"))
def _(spark, d):
    return sections_v(spark, d).filter(p.is_generic_title()).select("work_id", "number", "title")


@query("F8_find_work", on_c("""SELECT work_id, slug, title FROM works_c WHERE work_id = 'c1' OR slug = 'c1' OR lower(title) LIKE '%c1%'
ORDER BY CASE WHEN work_id = 'c1' THEN 1 WHEN slug = 'c1' THEN 2 ELSE 3 END, slug LIMIT 1"""))
def _(spark, d):
    return catalog.find_work(works_c(spark, d), sections_c(spark, d), "c1").select("work_id", "slug", "title")


@query("F8_find_work_by_title", on_c("""SELECT work_id, slug, title FROM works_c WHERE lower(title) LIKE '%work c2%' ORDER BY slug LIMIT 1"""))
def _(spark, d):
    return catalog.find_work(works_c(spark, d), sections_c(spark, d), "WORK c2").select("work_id", "slug", "title")


@query("F9_slug_contains", on_v("SELECT slug, title FROM works_v WHERE lower(slug) LIKE '%c1%'"))
def _(spark, d):
    return works_v(spark, d).filter(p.contains_text("slug", "C1")).select("slug", "title")


@query("F10_chosen_numbers", on_c("SELECT work_id, number FROM sections_c WHERE number IN (2, 3, 7)"))
def _(spark, d):
    return sections_c(spark, d).filter(F.col("number").isin(2, 3, 7)).select("work_id", "number")


@query("F11_long_enough", on_c("SELECT work_id, number, length(content) AS chars FROM sections_c WHERE length(content) >= 100"))
def _(spark, d):
    return sections_c(spark, d).filter(p.long_enough("content", 100)).select("work_id", "number", F.length("content").alias("chars"))


@query("F12_recent_works", on_c("""SELECT slug FROM works_c WHERE created_at > TIMESTAMP '2024-01-02 06:00:00' - INTERVAL 24 HOUR AND created_at <= TIMESTAMP '2024-01-02 06:00:00'"""))
def _(spark, d):
    return works_c(spark, d).filter(p.within_hours("created_at", F.lit("2024-01-02 06:00:00").cast("timestamp"), 24)).select("slug")


@query("F13_work_urls", """WITH u AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages)
SELECT page_id, url FROM (SELECT *, regexp_extract(url, '^(https?://[^/]+)/([^/]+)/*$', 2) AS seg FROM u)
WHERE seg <> '' AND seg NOT IN ('about', 'contact', 'tag', 'category')
UNION ALL SELECT page_id, url || '#cut' FROM u WHERE regexp_matches(url, '^https?://[^/]+/[a-z]+/[0-9]+$')
  AND regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) = 'fr'""")
def _(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("url"))
    one = F.regexp_extract("url", r"\Ahttps?://[^/]+/([^/]+)/*\z", 1)
    base = "https://x.example"
    # hosts differ per page, so the predicate is applied to the path under one base
    moved = pages.withColumn("moved", F.regexp_replace("url", r"\Ahttps?://[^/]+", base))
    works = moved.filter(p.is_work_url("moved", base, ("about", "contact", "tag", "category")) & (one != "")).select("page_id", "url")
    french = moved.withColumn("under", F.regexp_replace("moved", r"\Ahttps://x\.example/fr/([0-9]+)\z", base + "/fr/$1"))
    french = french.filter(p.is_work_url("under", base + "/fr", ())).filter(F.col("url").rlike(r"/fr/[0-9]+\z"))
    return works.unionByName(french.select("page_id", F.concat("url", F.lit("#cut")).alias("url")))


# the sample texts are invented and hold none of the words looked for; every few documents get some at the end
HINTS = {1: " A NUDE scene.", 2: " Bộ ngực đầy đặn! Số đo 90-60-90 đây…", 3: " Hãy nghe tiếp. Nghe truyện để biết thêm chuyện gì!", 4: " 漢字 kana ひ.", 5: " 😀 ok 🚀."}
HINTED = "(SELECT doc_id, text || CASE doc_id % 9 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in HINTS.items()) + " ELSE '' END AS text FROM documents)"


def hinted(spark, d):
    rest = F.lit("")
    for k, v in HINTS.items():
        rest = F.when(F.col("doc_id") % 9 == k, v).otherwise(rest)
    return table(spark, d, "documents").select("doc_id", F.concat("text", rest).alias("text"))


@query("F14_safe_prompts", f"""SELECT doc_id FROM {HINTED} WHERE NOT regexp_matches(lower(text),
'nude|nudity|naked|sex|sexual|erotic|porn|breast|nipples|genitals|nsfw|lingerie|topless|seductive|bare skin|exposed skin|undressed|revealing outfit|cleavage|sensual|provocative|explicit|intimate pose|undress|shirtless|bikini|underwear')""")
def _(spark, d):
    return hinted(spark, d).filter(p.is_safe_prompt("text")).select("doc_id")


def _any(patterns):
    return " OR ".join("regexp_matches(x, '(?i)" + q.replace("'", "''") + "')" for q in patterns)


def _counted(patterns, name):
    return f"SELECT doc_id, count(*) FILTER ({_any(patterns)}) AS {name}, count(*) AS sentences FROM (SELECT doc_id, unnest({SENTENCES}) AS x FROM {HINTED}) GROUP BY doc_id"


@query("F15_blocked_sentences", _counted(rules.BLOCKED_SENTENCES, "blocked"))
def _(spark, d):
    docs = hinted(spark, d).select("doc_id", F.posexplode(t.sentences("text")).alias("pos", "sentence"))
    return docs.groupBy("doc_id").agg(F.count_if(p.is_blocked_sentence("sentence")).alias("blocked"), F.count(F.lit(1)).alias("sentences"))


@query("F16_call_to_action_sentences", _counted((rules.CTA_START, rules.CTA_FULL, rules.CTA_END), "calls"))
def _(spark, d):
    docs = hinted(spark, d).select("doc_id", F.explode(t.sentences("text")).alias("sentence"))
    return docs.groupBy("doc_id").agg(F.count_if(p.is_call_to_action("sentence")).alias("calls"), F.count(F.lit(1)).alias("sentences"))


@query("F17_cjk_texts", r"SELECT doc_id, regexp_matches(text, '[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]') AS has_cjk FROM " + HINTED)
def _(spark, d):
    return hinted(spark, d).select("doc_id", p.has_cjk("text").alias("has_cjk"))


@query("F18_truncated_texts", f"""SELECT 'd' || doc_id AS id, s = '' OR strpos('.!?…。！？"”'')’', right(s, 1)) = 0 AS truncated
FROM (SELECT doc_id, {strip('text')} AS s FROM documents)
UNION ALL SELECT 'b' || item_id, s = '' OR strpos('.!?…。！？"”'')’', right(s, 1)) = 0 FROM (SELECT item_id, {strip('text')} AS s FROM benchmark)""")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), p.is_truncated("text").alias("truncated"))
    cut = table(spark, d, "benchmark").select(
        F.concat(F.lit("b"), "item_id").alias("id"), p.is_truncated("text").alias("truncated"))
    return docs.unionByName(cut)


@query("F19_date_names", """SELECT o_orderkey, name, regexp_matches(name, '^\\d{4}-\\d{2}-\\d{2}$') AND try_cast(name AS DATE) IS NOT NULL AS is_date FROM (
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-3%d') ELSE strftime(o_orderdate, '%Y-02-%d') END AS name FROM orders)""")
def _(spark, d):
    k = F.col("o_orderkey") % 3
    name = (F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-'3'dd"))
            .otherwise(F.date_format("o_orderdate", "yyyy-'02'-dd")))
    return table(spark, d, "orders").select("o_orderkey", name.alias("name")).withColumn("is_date", p.is_date_name("name"))


@query("J1_sections_with_work", on_v("SELECT w.slug, s.number, s.title, w.title AS work_title FROM sections_v s JOIN works_v w USING (work_id)"))
def _(spark, d):
    s = sections_v(spark, d).select("work_id", "number", "title")
    w = works_v(spark, d).select("work_id", "slug", F.col("title").alias("work_title"))
    return s.join(w, "work_id").select("slug", "number", "title", "work_title")


@query("J2_all_works_with_counts", on_c("""SELECT w.slug, w.title, coalesce(n, 0) AS sections FROM works_c w LEFT JOIN
(SELECT work_id, count(*) AS n FROM sections_c WHERE word_count >= 200 GROUP BY work_id) USING (work_id)"""))
def _(spark, d):
    long = sections_c(spark, d).filter("word_count >= 200")
    return catalog.with_counts(works_c(spark, d), long).select("slug", "title", "sections")


@query("J3_few_sections", on_c("""SELECT w.slug, n AS sections FROM works_c w LEFT JOIN
(SELECT work_id, count(*) AS n FROM sections_c WHERE publish_status = 'published' GROUP BY work_id) USING (work_id) WHERE n > 0 AND n < 5"""))
def _(spark, d):
    return catalog.few_sections(works_c(spark, d), sections_c(spark, d)).select("slug", "sections")


@query("J4_count_lookup", on_c("""SELECT w.slug, coalesce(n, 0) AS pending FROM works_c w LEFT JOIN
(SELECT work_id, count(*) AS n FROM sections_c WHERE publish_status = 'pending' GROUP BY work_id) USING (work_id)"""))
def _(spark, d):
    pending = sections_c(spark, d).filter(F.col("publish_status") == "pending")
    return catalog.with_counts(works_c(spark, d), pending, "pending").select("slug", "pending")


@query("J5_works_with_open_sections", on_c("""SELECT slug FROM works_c WHERE work_id IN
(SELECT work_id FROM sections_c WHERE coalesce(summary, '') = '' OR coalesce(highlight, '') = '')"""))
def _(spark, d):
    return catalog.with_any(works_c(spark, d), sections_c(spark, d).filter(p.section_unenriched())).select("slug")


LISTING = """listing AS (SELECT DISTINCT 'c' || (doc_id * 3) AS slug, CASE WHEN doc_id % 5 = 0 THEN ' WORK C' || doc_id || ' ' ELSE 'New ' || doc_id END AS title FROM documents)"""


def _listing(spark, d):
    k = F.col("doc_id")
    return table(spark, d, "documents").select(
        F.concat(F.lit("c"), (k * 3).cast("string")).alias("slug"),
        F.when(k % 5 == 0, F.concat(F.lit(" WORK C"), k.cast("string"), F.lit(" "))).otherwise(F.concat(F.lit("New "), k.cast("string"))).alias("title"),
    ).distinct()


@query("J6_new_listings", on_c("""SELECT slug, title FROM listing l WHERE NOT EXISTS (SELECT 1 FROM works_c w WHERE w.slug = l.slug)
AND NOT EXISTS (SELECT 1 FROM works_c w WHERE lower(trim(w.title)) = lower(trim(l.title)))""", LISTING))
def _(spark, d):
    return catalog.new_listings(_listing(spark, d), works_c(spark, d)).select("slug", "title")


@query("J7_missing_sections", on_v("""SELECT work_id, number FROM (SELECT source AS work_id, doc_id % 90 AS number FROM documents GROUP BY ALL) i
WHERE NOT EXISTS (SELECT 1 FROM sections_v s WHERE s.work_id = i.work_id AND s.number = i.number)"""))
def _(spark, d):
    incoming = table(spark, d, "documents").select(F.col("source").alias("work_id"), (F.col("doc_id") % 90).cast("int").alias("number")).distinct()
    return catalog.missing_sections(incoming, sections_v(spark, d))


INCOMING = """incoming AS (SELECT work_id AS key, CASE WHEN w % 3 = 0 THEN 'https://site' || (w % 3) || '.example/work/' || work_id || '//' ELSE 'https://none.example/' END AS source_url,
CASE WHEN w % 2 = 0 THEN work_id ELSE 'zz' END AS slug, CASE WHEN w % 5 = 0 THEN 'none' ELSE 'Work ' || work_id END AS title FROM (SELECT DISTINCT 'c' || conv_id AS work_id, conv_id AS w FROM conversations)),
stored AS (SELECT work_id, slug, title, regexp_replace(source_url, '/+$', '') AS source_url FROM works_c)"""


@query("J9_match_works", on_c("""SELECT i.key, coalesce((SELECT min(work_id) FROM stored s WHERE s.source_url = regexp_replace(i.source_url, '/+$', '')),
(SELECT min(work_id) FROM stored s WHERE s.slug = i.slug), (SELECT min(work_id) FROM stored s WHERE s.title = i.title)) AS matched_work_id FROM incoming i""", INCOMING))
def _(spark, d):
    works = works_c(spark, d)
    stored = works.withColumn("source_url", urls.trimmed("source_url"))
    w = F.regexp_extract("work_id", r"(\d+)", 1).cast("bigint")
    incoming = works.select(
        F.col("work_id").alias("key"),
        F.when(w % 3 == 0, F.concat(F.lit("https://site"), (w % 3).cast("string"), F.lit(".example/work/"), "work_id", F.lit("//"))).otherwise(F.lit("https://none.example/")).alias("source_url"),
        F.when(w % 2 == 0, F.col("work_id")).otherwise(F.lit("zz")).alias("slug"),
        F.when(w % 5 == 0, F.lit("none")).otherwise(F.concat(F.lit("Work "), "work_id")).alias("title"),
    )
    return catalog.match_works(incoming, stored).select("key", "matched_work_id")


DOMAINS = [("example.com", "com_site", 1), ("www.Example.net", "net_site", 2), ("m.ththth.example.net", "mobile_site", 3), ("deep.m.ththth.example.net", "deep_site", 4), ("example.com", "late_site", 5)]


@query("J10_match_domains", """WITH dom(domain, source, reg_order) AS (VALUES ('example.com', 'com_site', 1), ('example.net', 'net_site', 2), ('m.ththth.example.net', 'mobile_site', 3), ('deep.m.ththth.example.net', 'deep_site', 4), ('example.com', 'late_site', 5)),
p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', '') AS host FROM pages)
SELECT page_id, host, (SELECT arg_min(source, reg_order) FROM dom WHERE p.host = domain OR p.host LIKE '%.' || domain OR domain LIKE '%.' || p.host) AS source FROM p""")
def _(spark, d):
    domains = spark.createDataFrame(DOMAINS, "domain string, source string, reg_order int")
    return catalog.match_domains(table(spark, d, "pages"), domains).select("page_id", "host", "source")


@query("A3_unenriched_per_work", on_v("""SELECT w.slug, count(*) AS open_sections FROM sections_v s JOIN works_v w USING (work_id)
WHERE s.publish_status = 'published' AND (coalesce(summary, '') = '' OR coalesce(highlight, '') = '') GROUP BY w.slug"""))
def _(spark, d):
    rows = catalog.unenriched_sections(works_v(spark, d), sections_v(spark, d))
    return rows.groupBy(F.col("work_slug").alias("slug")).agg(F.count(F.lit(1)).alias("open_sections")).orderBy(F.desc("open_sections"), "slug")


@query("A4_catalogue_totals", on_v("SELECT (SELECT count(*) FROM works_v) AS works, (SELECT count(*) FROM sections_v) AS sections"))
def _(spark, d):
    both = works_v(spark, d).select(F.lit(1).alias("w"), F.lit(0).alias("s")).unionAll(sections_v(spark, d).select(F.lit(0).alias("w"), F.lit(1).alias("s")))
    return both.agg(F.sum("w").alias("works"), F.sum("s").alias("sections"))


@query("A5_sections_per_work", on_v("SELECT work_id, count(*) AS sections FROM sections_v GROUP BY work_id"))
def _(spark, d):
    return catalog.section_counts(sections_v(spark, d))


OUTCOME = "CASE WHEN length(content) < 200 THEN 'failed' WHEN coalesce(summary, '') <> '' THEN 'skipped' ELSE 'ok' END"


@query("A11_run_totals", on_v(f"SELECT {OUTCOME} AS status, count(*) AS rows, sum(word_count)::BIGINT AS amount FROM sections_v GROUP BY 1"))
def _(spark, d):
    status = F.when(F.length("content") < 200, "failed").when(~p.is_blank("summary"), "skipped").otherwise("ok")
    return catalog.status_totals(sections_v(spark, d).select(status.alias("status"), F.col("word_count").alias("amount")))


@query("A12_word_conservation", on_v("""SELECT work_id, b AS words_before, a AS words_after, abs(a - b) <= b * 0.02 AS conserved FROM
(SELECT work_id, sum(word_count)::BIGINT AS b, coalesce(sum(word_count) FILTER (word_count >= 60 AND NOT (work_id LIKE '%7' AND number % 2 = 0)), 0)::BIGINT AS a FROM sections_v GROUP BY work_id)"""))
def _(spark, d):
    s = sections_v(spark, d)
    return catalog.conserved(s, s.filter("word_count >= 60 AND NOT (work_id LIKE '%7' AND number % 2 = 0)"))


@query("A11_totals_while_writing", on_v(f"SELECT {OUTCOME} AS status, count(*) AS rows, sum(word_count)::BIGINT AS amount FROM sections_v GROUP BY 1"))
def _(spark, d):
    status = F.when(F.length("content") < 200, "failed").when(~p.is_blank("summary"), "skipped").otherwise("ok")
    return sinks.write_outcomes(sections_v(spark, d).select("work_id", "number", status.alias("status"), F.col("word_count").alias("amount")), sinks.scratch(spark, "outcomes"))


@query("A12_conserved_while_writing", on_v("""SELECT *, abs(words_after - words_before) <= words_before * 0.02 AS conserved FROM (
SELECT count(*) AS rows_before, count(*) FILTER (word_count >= 60) AS rows_after, sum(word_count)::BIGINT AS words_before, coalesce(sum(word_count) FILTER (word_count >= 60), 0)::BIGINT AS words_after FROM sections_v)"""))
def _(spark, d):
    s = sections_v(spark, d).select("work_id", "number", "word_count")
    got = sinks.write_conserved(s, F.col("word_count") >= 60, sinks.scratch(spark, "conserved"))
    return spark.createDataFrame([tuple(got.values())], "rows_before long, rows_after long, words_before long, words_after long, conserved boolean")


@query("A13_highest_numbers", """SELECT 'https://list.example/' || conv_id AS url, max(turn + 1) AS highest, count(*) AS known FROM conversations GROUP BY 1""")
def _(spark, d):
    s = sections_c(spark, d).withColumn("url", F.concat(F.lit("https://list.example/"), F.substring("work_id", 2, 20)))
    return s.groupBy("url").agg(F.max("number").alias("highest"), F.count(F.lit(1)).alias("known"))


@query("A14_works_per_day", on_c("SELECT strftime(created_at, '%Y-%m-%d') AS load_date, count(*) AS works FROM works_c GROUP BY 1"))
def _(spark, d):
    return works_c(spark, d).groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("load_date")).agg(F.count(F.lit(1)).alias("works"))


@query("A15_missing_fields", on_c("""SELECT slug, concat_ws(',', CASE WHEN coalesce(editorial_review, '') = '' THEN 'review' END,
CASE WHEN coalesce(character_analysis, '') = '' THEN 'analysis' END, CASE WHEN coalesce(faq, '') = '' THEN 'faq' END) AS missing FROM works_c
WHERE publish_status = 'published' AND (coalesce(editorial_review, '') = '' OR coalesce(character_analysis, '') = '' OR coalesce(faq, '') = '')"""))
def _(spark, d):
    return catalog.missing_fields(works_c(spark, d)).withColumn("missing", F.array_join("missing", ","))


@query("A15_action_counts", on_c("""SELECT (count(*) FILTER (coalesce(editorial_review, '') = ''))::BIGINT AS review, (count(*) FILTER (coalesce(character_analysis, '') = ''))::BIGINT AS analysis,
(count(*) FILTER (coalesce(faq, '') = ''))::BIGINT AS faq FROM works_c WHERE publish_status = 'published'"""))
def _(spark, d):
    m = catalog.missing_fields(works_c(spark, d))
    return m.agg(*[F.count_if(F.array_contains("missing", n)).alias(n) for n in ("review", "analysis", "faq")])


@query("L2_ordered_sections", on_v("SELECT work_id, number, title FROM sections_v ORDER BY work_id, number"))
def _(spark, d):
    return sections_v(spark, d).select("work_id", "number", "title").orderBy("work_id", "number")


@query("L3_newest_first", on_c("SELECT slug, title, CAST(created_at AS VARCHAR) AS created FROM works_c ORDER BY created_at DESC"))
def _(spark, d):
    return works_c(spark, d).orderBy(F.desc("created_at")).select("slug", "title", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"))


@query("L4_first_works", on_c("""SELECT work_id, number FROM sections_c WHERE word_count < 30 AND work_id IN
(SELECT DISTINCT work_id FROM sections_c WHERE word_count < 30 ORDER BY work_id LIMIT 10)"""))
def _(spark, d):
    short = sections_c(spark, d).filter(p.is_short(30)).select("work_id", "number")
    return short.join(short.select("work_id").distinct().orderBy("work_id").limit(10), "work_id", "left_semi")


@query("L5_top_counts", on_v("""SELECT w.slug, count(*) AS open_sections FROM sections_v s JOIN works_v w USING (work_id)
WHERE coalesce(summary, '') = '' GROUP BY w.slug ORDER BY open_sections DESC, slug LIMIT 15"""))
def _(spark, d):
    counts = sections_v(spark, d).filter(p.is_blank("summary")).groupBy("work_id").agg(F.count(F.lit(1)).alias("open_sections"))
    return counts.join(works_v(spark, d).select("work_id", "slug"), "work_id").select("slug", "open_sections").orderBy(F.desc("open_sections"), "slug").limit(15)


@query("L6_seeded_pick", on_c("""SELECT slug, title FROM listing l WHERE NOT EXISTS (SELECT 1 FROM works_c w WHERE w.slug = l.slug)
AND NOT EXISTS (SELECT 1 FROM works_c w WHERE lower(trim(w.title)) = lower(trim(l.title))) ORDER BY md5('42' || slug), slug LIMIT 20""", LISTING))
def _(spark, d):
    unseen = catalog.new_listings(_listing(spark, d), works_c(spark, d))
    return unseen.orderBy(F.md5(F.concat(F.lit("42"), "slug")), "slug").limit(20).select("slug", "title")


@query("L9_first_sections", on_v("SELECT work_id, number FROM sections_v WHERE number <= 3"))
def _(spark, d):
    from quire.operators.sequence import first_rows

    return first_rows(sections_v(spark, d).select("work_id", "number"), "number", 3)


@query("L8_by_url_number", """SELECT url, CAST(regexp_extract(url, '/(\\d+)', 1) AS INT) AS number FROM pages WHERE regexp_matches(url, '/\\d+')""")
def _(spark, d):
    n = F.regexp_extract("url", r"/(\d+)", 1)
    return table(spark, d, "pages").filter(n != "").select("url", n.cast("int").alias("number")).orderBy("number", "url")


@query("K2_date_layout", on_c("SELECT strftime(updated_at, '%Y-%m-%d') AS load_date, count(*) AS works, min(slug) AS first_slug, max(slug) AS last_slug FROM works_c GROUP BY 1"))
def _(spark, d):
    from quire.sources.sinks import dated_layout

    return dated_layout(works_c(spark, d)).groupBy("load_date").agg(
        F.count(F.lit(1)).alias("works"), F.min("slug").alias("first_slug"), F.max("slug").alias("last_slug")).orderBy(F.desc("load_date"))


@query("K2_write_dated", on_c("""SELECT load_date, work_id, title FROM (SELECT strftime(updated_at, '%Y-%m-%d') AS load_date, work_id, 'first ' || title AS title FROM works_c WHERE w_odd
UNION ALL SELECT strftime(updated_at, '%Y-%m-%d'), work_id, title FROM works_c WHERE NOT w_odd)""".replace("w_odd", "right(work_id, 1) IN ('1', '3', '5', '7', '9')")))
def _(spark, d):
    from quire.sources.sinks import scratch, write_dated

    path, works = scratch(spark, "dated"), works_c(spark, d).select("work_id", "title", "updated_at")
    # the second load meets days and works that are there already; they stay as they are
    write_dated(works.filter(F.col("work_id").rlike("[13579]$")).withColumn("title", F.concat(F.lit("first "), "title")), path)
    write_dated(works, path)
    return spark.read.parquet(path).select(F.date_format("load_date", "yyyy-MM-dd").alias("load_date"), "work_id", "title")


COPIES = """copies AS (SELECT 'c' || conv_id AS slug, CASE WHEN turn = 3 AND conv_id % 4 = 0 THEN NULL ELSE '2024-01-0' || turn END AS day, 'out/' || turn || '/c' || conv_id AS path FROM conversations)"""


@query("K3_newest_copy", "WITH " + COPIES + """ SELECT slug, arg_max(path, coalesce(day, '9999')) AS path, bool_and(day IS NOT NULL) AND count(*) > 1 AS ambiguous FROM copies GROUP BY slug""")
def _(spark, d):
    c = table(spark, d, "conversations")
    flat = (F.col("turn") == 3) & (F.col("conv_id") % 4 == 0)
    copies = c.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("slug"),
        F.when(~flat, F.concat(F.lit("2024-01-0"), F.col("turn").cast("string"))).alias("day"),
        F.concat(F.lit("out/"), F.col("turn").cast("string"), F.lit("/c"), F.col("conv_id").cast("string")).alias("path"),
    )
    return catalog.newest_copy(copies)
