"""Ordered-sequence queries."""

from pyspark.sql import Window, functions as F

from quire.functions import text as t
from quire.functions import urls
from quire.functions.syllable import invalid_tokens, tokens
from quire.operators import sequence as sq
from quire.operators.ordered import Running, ordered
from quire.queries.base import sections_c, sections_v, works_c, works_v
from quire.queries.sql import on_c, on_v, strip, wc
from quire.registry import query, table


@query("W1_renumber", on_v("""SELECT work_id, number, row_number() OVER (PARTITION BY work_id ORDER BY number) AS new_number FROM sections_v WHERE publish_status = 'published'"""))
def _(spark, d):
    return sq.renumbered(sections_v(spark, d).filter("publish_status = 'published'"))


@query("W1_renumber_counts", on_v("""SELECT work_id, count(*) AS sections, (count(*) FILTER (number <> n))::BIGINT AS renumbered FROM (
SELECT work_id, number, row_number() OVER (PARTITION BY work_id ORDER BY number) AS n FROM sections_v WHERE publish_status = 'published') GROUP BY work_id"""))
def _(spark, d):
    return sq.renumber_counts(sections_v(spark, d).filter("publish_status = 'published'"))


def _merge_ctes(w, s, m):
    return f"""flags AS (SELECT s.*, coalesce(s.publish_status = 'published' AND w.publish_status = 'published' AND s.word_count < {m}, false) AS short,
  lag(number) OVER (PARTITION BY work_id ORDER BY number) AS before FROM {s} s JOIN {w} w USING (work_id)),
joins AS (SELECT *, short AND number <> 1 AND coalesce(before = number - 1, false) AS joins FROM flags),
heads AS (SELECT *, max(CASE WHEN NOT joins THEN number END) OVER (PARTITION BY work_id ORDER BY number) AS h0 FROM joins),
plan AS (SELECT *, CASE WHEN number = 1 AND short AND EXISTS (SELECT 1 FROM joins j WHERE j.work_id = heads.work_id AND j.number = 2 AND NOT j.joins) THEN 2 ELSE h0 END AS head FROM heads)"""


@query("W2_merge_plan", on_c("SELECT work_id, number, short, head FROM plan", _merge_ctes("works_c", "sections_c", 30)))
def _(spark, d):
    return sq.merge_plan(works_c(spark, d), sections_c(spark, d), 30)


@query("W2_merge_counts", on_c("""SELECT work_id, count(*) FILTER (short AND head <> number) AS merged, count(*) FILTER (short AND head = number) AS failed, count(*) FILTER (head = number) AS left
FROM plan GROUP BY work_id HAVING bool_or(short)""".replace("AS left", 'AS "left"'), _merge_ctes("works_c", "sections_c", 30)))
def _(spark, d):
    return sq.merge_counts(sq.merge_plan(works_c(spark, d), sections_c(spark, d), 30))


def _merged_sql(space=None):
    from quire.queries.sql import SPACE

    rs, ls = f"regexp_replace(content, '[{SPACE}]+$', '')", f"regexp_replace(content, '^[{SPACE}]+', '')"
    both = strip("content")
    return f"""SELECT work_id, row_number() OVER (PARTITION BY work_id ORDER BY head) AS new_number, head AS number, title, content, touched FROM (
  SELECT work_id, head, max(CASE WHEN number = head THEN title END) AS title, bool_or(tt) AS touched,
    string_agg(CASE WHEN n = 1 THEN content WHEN i = 1 THEN {rs} WHEN i = n THEN {ls} ELSE {both} END, chr(10) || chr(10) ORDER BY number) AS content
  FROM (SELECT *, row_number() OVER (PARTITION BY work_id, head ORDER BY number) AS i, count(*) OVER (PARTITION BY work_id, head) AS n, bool_or(short) OVER (PARTITION BY work_id) AS tt FROM plan)
  GROUP BY work_id, head)"""


@query("W2_merge_short", on_c(f"SELECT work_id, CASE WHEN touched THEN new_number ELSE number END AS number, title, md5(content) AS digest, {wc('content')} AS word_count FROM ({_merged_sql()})", _merge_ctes("works_c", "sections_c", 30)))
def _(spark, d):
    out = sq.merge_short(works_c(spark, d), sections_c(spark, d).select("work_id", "number", "title", "content", "word_count", "publish_status"), 30)
    return out.select("work_id", "number", "title", F.md5("content").alias("digest"), "word_count")


@query("W2_merge_short_documents", on_v(f"SELECT work_id, CASE WHEN touched THEN new_number ELSE number END AS number, title, md5(content) AS digest, {wc('content')} AS word_count FROM ({_merged_sql()})", _merge_ctes("works_v", "sections_v", 300)))
def _(spark, d):
    out = sq.merge_short(works_v(spark, d), sections_v(spark, d).select("work_id", "number", "title", "content", "word_count", "publish_status"), 300)
    return out.select("work_id", "number", "title", F.md5("content").alias("digest"), "word_count")


SEEDS = "seeds AS (SELECT work_id, CASE WHEN length(work_id) % 2 = 0 THEN 1 ELSE 3 END AS number, CASE WHEN work_id LIKE '%4' OR work_id LIKE '%8' THEN 'next' ELSE 'prev' END AS direction FROM works_c)"


def _seeds(works):
    return works.select(
        "work_id", F.when(F.length("work_id") % 2 == 0, 1).otherwise(3).alias("number"),
        F.when(F.col("work_id").rlike("[48]$"), "next").otherwise("prev").alias("direction"))


@query("W3_merge_one_status", on_c("""SELECT work_id, number, direction, CASE WHEN direction = 'prev' AND number <= 1 THEN 'no_previous'
WHEN NOT EXISTS (SELECT 1 FROM sections_c s WHERE s.work_id = seeds.work_id AND s.number = seeds.number) THEN 'missing_source'
WHEN NOT EXISTS (SELECT 1 FROM sections_c s WHERE s.work_id = seeds.work_id AND s.number = seeds.number + CASE direction WHEN 'prev' THEN -1 ELSE 1 END) THEN 'missing_target' ELSE 'ok' END AS status FROM seeds""", SEEDS))
def _(spark, d):
    return sq.merge_one(sections_c(spark, d), _seeds(works_c(spark, d)))[1]


@query("W3_merge_one", on_c("""SELECT work_id, target AS number, max(CASE WHEN number = target THEN title END) AS title, sum(word_count)::BIGINT AS word_count FROM (
SELECT s.work_id, s.number, s.title, s.word_count, coalesce(q.number + CASE q.direction WHEN 'prev' THEN -1 ELSE 1 END, s.number) AS target
FROM sections_c s LEFT JOIN (SELECT * FROM seeds WHERE NOT (direction = 'prev' AND number <= 1) AND EXISTS (SELECT 1 FROM sections_c s WHERE s.work_id = seeds.work_id AND s.number = seeds.number + CASE direction WHEN 'prev' THEN -1 ELSE 1 END)) q
ON q.work_id = s.work_id AND q.number = s.number) GROUP BY work_id, target""", SEEDS))
def _(spark, d):
    return sq.merge_one(sections_c(spark, d), _seeds(works_c(spark, d)))[0].select("work_id", "number", "title", "word_count")


@query("W4_neighbours", on_v("""SELECT work_id, number, lag(title) OVER w AS previous_title, lead(title) OVER w AS next_title FROM sections_v WINDOW w AS (PARTITION BY work_id ORDER BY number)"""))
def _(spark, d):
    return sq.neighbours(sections_v(spark, d))


@query("J13_next_title", on_c("SELECT work_id, number, lead(title) OVER (PARTITION BY work_id ORDER BY number) AS next_title FROM sections_c"))
def _(spark, d):
    return sq.neighbours(sections_c(spark, d)).select("work_id", "number", "next_title")


FETCHES = "fetches AS (SELECT work_id, number - 1 AS pos, length(content) AS length, number % 7 = 3 AS loaded FROM sections_{x})"


@query("W5_stop_rule", on_c("""SELECT work_id, pos FROM (SELECT *, min(CASE WHEN s AND s1 AND s2 THEN pos END) OVER (PARTITION BY work_id) AS stop FROM (
SELECT *, lag(s, 1, false) OVER w AS s1, lag(s, 2, false) OVER w AS s2 FROM (SELECT *, NOT loaded AND length < 320 AS s FROM fetches) WINDOW w AS (PARTITION BY work_id ORDER BY pos)))
WHERE NOT s AND (stop IS NULL OR pos < stop)""", FETCHES.format(x="c")))
def _(spark, d):
    f = sections_c(spark, d).select("work_id", (F.col("number") - 1).alias("pos"), F.length("content").alias("length"), (F.col("number") % 7 == 3).alias("loaded"))
    return sq.usable_fetches(f, 320).select("work_id", "pos")


@query("W6_url_numbers", """SELECT page_id, coalesce(try_cast(nullif(regexp_extract(u, 'chuong[- ]?(\\d+)', 1), '') AS INT), try_cast(nullif(regexp_extract(u, 'chapter[- ]?(\\d+)', 1), '') AS INT), page_id + 1)::INT AS number
FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN replace(url, '/en/', '/chuong-') WHEN 1 THEN replace(url, '/en/', '/chapter ') ELSE url END AS u FROM pages)""")
def _(spark, d):
    k = F.col("page_id") % 3
    u = F.when(k == 0, F.replace("url", F.lit("/en/"), F.lit("/chuong-"))).when(k == 1, F.replace("url", F.lit("/en/"), F.lit("/chapter "))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", urls.section_number(u, "page_id").alias("number"))


def _placed(s):
    return ordered(s.select("work_id", "number"), "work_id", "number", pos=Running(F.lit(1), inclusive=False))


@query("W8_even_positions", on_v("""SELECT work_id, slot, CASE WHEN n >= 20 THEN CAST(floor(slot * (n - 1) / 19.0) AS INT) ELSE slot % n END AS pos, 1 + CASE WHEN n >= 20 THEN CAST(floor(slot * (n - 1) / 19.0) AS INT) ELSE slot % n END AS number
FROM (SELECT work_id, count(*)::INT AS n FROM sections_v GROUP BY work_id), (SELECT unnest(range(20))::INT AS slot)"""))
def _(spark, d):
    return sq.even_positions(_placed(sections_v(spark, d)), 20).select("work_id", "slot", "pos", "number")


@query("W9_quartile_sections", on_v("""SELECT work_id, number FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY number) - 1 AS pos, count(*) OVER (PARTITION BY work_id) AS n FROM sections_v)
WHERE pos IN (0, n // 3, 2 * n // 3, n - 1)"""))
def _(spark, d):
    return sq.quartile_rows(sections_v(spark, d).select("work_id", "number")).select("work_id", "number")


def excerpt_sql():
    last = "greatest(" + ", ".join(f"CASE WHEN strpos(reverse(sn), '{m}') = 0 THEN -1 ELSE length(sn) - strpos(reverse(sn), '{m}') END" for m in ".!?") + ")"
    return f"""SELECT work_id, string_agg('[Chương ' || number || ']' || chr(10) || CASE WHEN {last} > per * 0.7 THEN substr(sn, 1, {last} + 1) ELSE sn END, chr(10) || chr(10) ORDER BY number) AS excerpt FROM (
SELECT *, substr(c, 1, per) AS sn FROM (SELECT work_id, number, {strip('content')} AS c, (5000 // count(*) OVER (PARTITION BY work_id))::INT AS per FROM (
SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY number) - 1 AS pos, count(*) OVER (PARTITION BY work_id) AS n FROM sections_v) WHERE pos IN (0, n // 3, 2 * n // 3, n - 1)) WHERE c <> '') GROUP BY work_id"""


@query("W9_quartile_excerpt", on_v(excerpt_sql()))
def _(spark, d):
    return sq.quartile_excerpt(sections_v(spark, d))


@query("W10_budget_prefix", on_c(f"""SELECT work_id, string_agg(substr(c, 1, (3000 - used)::INT), chr(10) || chr(10) ORDER BY number) AS sample FROM (
SELECT *, coalesce(sum(length(c)) OVER (PARTITION BY work_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM (
SELECT work_id, number, {strip('content')} AS c FROM sections_c WHERE number <= 5) WHERE c <> '') WHERE used < 3000 GROUP BY work_id"""))
def _(spark, d):
    return sq.budget_prefix(sections_c(spark, d))


@query("W11_story_digest", on_c("""SELECT w.work_id, nullif(substr(concat_ws(chr(10) || chr(10), CASE WHEN coalesce(description, '') <> '' THEN 'Mô tả: ' || description END, p), 1, 4000), '') AS digest
FROM works_c w LEFT JOIN (SELECT work_id, string_agg('--- Chương ' || number || ' ---' || chr(10) || substr(content, 1, 800), chr(10) || chr(10) ORDER BY number) AS p FROM sections_c WHERE number <= 3 AND content <> '' GROUP BY work_id) USING (work_id)"""))
def _(spark, d):
    return sq.story_digest(works_c(spark, d), sections_c(spark, d))


LENGTHS = "lengths AS (SELECT work_id, sum(word_count) / 3.0 AS total, count(*) AS n FROM sections_c GROUP BY work_id)"


def _lengths(s):
    return s.groupBy("work_id").agg((F.sum("word_count") / 3.0).alias("total"))


@query("W12_cyclic_slots", on_c("""SELECT work_id, slot::INT AS slot, 'img' || (slot % n) AS item FROM (SELECT work_id, n, unnest(range(0, CAST(ceil(total / 20.0) AS BIGINT) + 1)) AS slot FROM lengths)""", LENGTHS))
def _(spark, d):
    s = sections_c(spark, d)
    items = s.select("work_id", (F.col("number") - 1).alias("pos"), F.concat(F.lit("img"), (F.col("number") - 1).cast("string")).alias("item"))
    return sq.cyclic_slots(items, _lengths(s), 20.0).select("work_id", "slot", "item")


@query("W13_equal_timeline", on_c("""SELECT work_id, number - 1 AS pos, round(total / n + CASE WHEN number = n THEN 0.5 ELSE 0 END, 6) AS duration,
round(CASE WHEN number > 1 THEN greatest(0.01, (number - 1) * (total / n) - 0.4) END, 6) AS fade_offset FROM sections_c JOIN lengths USING (work_id)""", LENGTHS))
def _(spark, d):
    s = sections_c(spark, d)
    out = sq.equal_timeline(s.select("work_id", (F.col("number") - 1).alias("pos")), _lengths(s))
    return out.select("work_id", "pos", F.round("duration", 6).alias("duration"), F.round("fade_offset", 6).alias("fade_offset"))


EMOTION = "['shock','Fear','love','betrayal','hope','anger','sadness','panic','joy','calm','']"


@query("W14_shot_types", on_c(f"""SELECT work_id, number, CASE WHEN number = 1 THEN 'medium' WHEN number = n THEN 'close_up' ELSE coalesce(
CASE lower(e) WHEN 'shock' THEN 'close_up' WHEN 'fear' THEN 'atmospheric' WHEN 'love' THEN 'two_shot' WHEN 'betrayal' THEN 'detail' WHEN 'hope' THEN 'wide' WHEN 'anger' THEN 'action' WHEN 'sadness' THEN 'atmospheric' WHEN 'panic' THEN 'action' WHEN 'joy' THEN 'wide' END,
['medium','close_up','back_view','atmospheric','detail','wide','back_view','close_up'][((number - 1) % 8 + 1)::INT]) END AS shot
FROM (SELECT *, count(*) OVER (PARTITION BY work_id) AS n, {EMOTION}[(word_count % 11 + 1)::INT] AS e FROM sections_c)"""))
def _(spark, d):
    names = F.array(*[F.lit(e) for e in ("shock", "Fear", "love", "betrayal", "hope", "anger", "sadness", "panic", "joy", "calm", "")])
    s = sections_c(spark, d).select("work_id", "number", (F.col("number") - 1).alias("pos"), F.element_at(names, (F.col("word_count") % 11 + 1).cast("int")).alias("emotion"))
    return sq.shots(s).select("work_id", "number", "shot")


@query("W15_choose_attempts")
def _(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    chunk = F.concat_ws("-", "conv_id", F.floor(F.col("turn") / 2))
    attempts = c.select(chunk.alias("chunk_id"), (F.col("turn") % 2 + 1).alias("attempt"), F.col("text").alias("source_text"), "text")
    ratio = F.size(invalid_tokens("text")) / F.greatest(F.size(tokens("text")), F.lit(1))
    return sq.choose_attempts(attempts, ratio, 0.02, 0.5).select("chunk_id", "chosen", F.length("text").alias("chars"))


SCORES = "scores AS (SELECT user_id AS bad, event_type AS cand, round(avg(value), 3) AS score FROM events GROUP BY 1, 2)"


@query("W16_top_by_margin", f"""WITH {SCORES} SELECT bad, cand FROM (SELECT *, lead(score) OVER w AS nxt, row_number() OVER w AS rn FROM scores WINDOW w AS (PARTITION BY bad ORDER BY score DESC, cand)) WHERE rn = 1 AND score - nxt >= 1.5""")
def _(spark, d):
    scores = table(spark, d, "events").groupBy(F.col("user_id").alias("bad"), F.col("event_type").alias("cand")).agg(F.round(F.avg("value"), 3).alias("score"))
    return sq.top_by_margin(scores)


@query("W17_listing_order", on_c("""SELECT work_id, number, CASE WHEN length(work_id) % 2 = 0 THEN n - p0 - 1 ELSE p0 END AS pos FROM (
SELECT work_id, number, count(*) OVER (PARTITION BY work_id) AS n, CASE WHEN length(work_id) % 2 = 0 THEN count(*) OVER (PARTITION BY work_id) - number ELSE number - 1 END AS p0 FROM sections_c)"""))
def _(spark, d):
    s = sections_c(spark, d).select("work_id", "number")
    n = s.groupBy("work_id").agg(F.count(F.lit(1)).alias("n"))
    backwards = F.length("work_id") % 2 == 0
    listing = s.join(n, "work_id").select("work_id", F.when(backwards, F.col("n") - F.col("number")).otherwise(F.col("number") - 1).alias("pos"), "number")
    return sq.listing_order(listing)
