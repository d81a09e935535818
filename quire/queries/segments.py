"""Segmentation and packing queries."""

from pyspark.sql import functions as F

from quire.functions import text as t
from quire.operators import catalog, segment as sg
from quire.operators import sequence as sq
from quire.queries.base import sections_c, sections_v, works_c, works_v
from quire.queries.orderings import excerpt_sql
from quire.queries.sql import SPACE, cascade, on_c, on_v, strip, wc
from quire.registry import query, table


def _alloc(s, target, piece):
    return f"""base AS (SELECT work_id, number, {wc('content')} AS words, count(*) OVER (PARTITION BY work_id) AS n, sum({wc('content')}) OVER (PARTITION BY work_id) AS total FROM {s}),
p0 AS (SELECT *, least(greatest(1, CAST(round_even({target} * words::DOUBLE / total, 0) AS INT)), greatest(1, words // {piece})) AS p FROM base WHERE n < {target} AND total >= {target * piece}),
d0 AS (SELECT *, {target} - sum(p) OVER (PARTITION BY work_id) AS diff FROM p0),
r0 AS (SELECT *, CASE WHEN diff > 0 THEN greatest(0, words // {piece} - p) ELSE p - 1 END AS room FROM d0),
u0 AS (SELECT *, coalesce(sum(room) OVER (PARTITION BY work_id ORDER BY words DESC, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM r0),
alloc AS (SELECT work_id, number, words, (p + sign(diff) * least(room, greatest(0, abs(diff) - used)))::INT AS pieces FROM u0)"""


@query("W7_allocation", on_c("SELECT work_id, number, words, pieces FROM alloc", _alloc("sections_c", 12, 20)))
def _(spark, d):
    return sg.allocate(sections_c(spark, d), 12, 20)


@query("W7_allocation_documents", on_v("SELECT work_id, number, words, pieces FROM alloc", _alloc("sections_v", 600, 20)))
def _(spark, d):
    return sg.allocate(sections_v(spark, d), 600, 20)


def trimmed_list(c, sep):
    return f"list_filter(list_transform(string_split({c}, {sep}), lambda x: {strip('x')}), lambda x: x <> '')"


# the sample texts have no blank lines inside a turn and no turn is long enough for the reflow step at this min_words
PARTS = f"CASE WHEN contains(content, chr(10) || chr(10)) THEN {trimmed_list('content', 'chr(10) || chr(10)')} ELSE {trimmed_list('content', 'chr(10)')} END"


@query("G1_line_paragraphs", on_c(f"SELECT work_id, number, len({PARTS}) AS n, md5(array_to_string({PARTS}, '|')) AS digest FROM sections_c"))
def _(spark, d):
    parts = sg.paragraphs("content", 10**6)
    return sections_c(spark, d).select("work_id", "number", F.size(parts).alias("n"), F.md5(F.array_join(parts, "|")).alias("digest"))


@query("G1_paragraph_cascade", f"WITH {cascade('cas', 'documents', 'doc_id', 'text', 100)} SELECT doc_id, len(ps) AS n, md5(array_to_string(ps, '|')) AS digest FROM cas")
def _(spark, d):
    docs = table(spark, d, "documents").withColumn("parts", sg.paragraphs("text", 100))
    return docs.select("doc_id", F.size("parts").alias("n"), F.md5(F.array_join("parts", "|")).alias("digest"))


@query("G2_even_cuts", on_c(f"""SELECT work_id, number, n, (n // 3) || ',' || (2 * (n // 3)) AS cuts FROM (SELECT work_id, number, len({PARTS}) AS n FROM sections_c)"""))
def _(spark, d):
    s = sections_c(spark, d).withColumn("n", F.size(sg.paragraphs("content", 10**6)))
    return s.select("work_id", "number", "n", F.array_join(sg.even_cuts(F.col("n"), F.lit(3)).cast("array<string>"), ",").alias("cuts"))


SPLIT = f"""parts AS (SELECT a.work_id, a.number, s.title, s.content, a.pieces, CASE WHEN a.pieces > 1 THEN {PARTS.replace('content', 's.content')} END AS ps FROM alloc a JOIN sections_c s USING (work_id, number)),
sized AS (SELECT *, CASE WHEN pieces > 1 AND len(ps) >= 2 * pieces THEN pieces ELSE 1 END AS k FROM parts),
cut AS (SELECT work_id, number, piece, CASE WHEN k = 1 THEN title ELSE 'Phần ' || (piece + 1) END AS title,
  CASE WHEN k = 1 THEN content ELSE array_to_string(ps[piece * (len(ps) // k) + 1 : CASE WHEN piece = k - 1 THEN len(ps) ELSE (piece + 1) * (len(ps) // k) END], chr(10) || chr(10)) END AS content
  FROM (SELECT *, unnest(range(k)) AS piece FROM sized))"""


@query("G2_even_cuts_documents", f"WITH {cascade('cas', 'documents', 'doc_id', 'text', 800)} SELECT doc_id, len(ps) AS n, (len(ps) // 3) || ',' || (2 * (len(ps) // 3)) AS cuts FROM cas")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.size(sg.paragraphs("text")).alias("n"))
    return docs.select("doc_id", "n", F.array_join(sg.even_cuts(F.col("n"), F.lit(3)).cast("array<string>"), ",").alias("cuts"))


def split_documents(least):
    """The cut pieces of the document works, all branches of the paragraphs on."""
    return _alloc("sections_v", 600, 20) + f""", {cascade('cas', 'sections_v', 'work_id, number', 'content', least)},
sized AS (SELECT a.work_id, a.number, s.title, s.content, ps, CASE WHEN a.pieces > 1 AND len(ps) >= 2 * a.pieces THEN a.pieces ELSE 1 END AS k FROM alloc a JOIN sections_v s USING (work_id, number) JOIN cas USING (work_id, number)),
cut AS (SELECT work_id, number, piece, CASE WHEN k = 1 THEN title ELSE 'Phần ' || (piece + 1) END AS title,
  CASE WHEN k = 1 THEN content ELSE array_to_string(ps[piece * (len(ps) // k) + 1 : CASE WHEN piece = k - 1 THEN len(ps) ELSE (piece + 1) * (len(ps) // k) END], chr(10) || chr(10)) END AS content
  FROM (SELECT *, unnest(range(k)) AS piece FROM sized)),
whole AS (SELECT work_id FROM (SELECT work_id, sum({wc('content')}) AS a FROM cut GROUP BY 1) JOIN (SELECT work_id, sum(words) AS b FROM alloc GROUP BY 1) USING (work_id) WHERE abs(a - b) <= b * 0.02)"""


@query("G3_split_documents", on_v("SELECT work_id, number, piece::INT AS piece, title, md5(content) AS digest FROM cut", split_documents(800)))
def _(spark, d):
    s = sections_v(spark, d)
    return sg.split_pieces(s, sg.allocate(s, 600, 20)).select("work_id", "number", "piece", "title", F.md5("content").alias("digest"))


@query("G3_split_pieces", on_c(f"SELECT work_id, number, piece::INT AS piece, title, md5(content) AS digest FROM cut", _alloc("sections_c", 12, 20) + ", " + SPLIT))
def _(spark, d):
    s = sections_c(spark, d)
    return sg.split_pieces(s, sg.allocate(s, 12, 20), 10**5).select("work_id", "number", "piece", "title", F.md5("content").alias("digest"))


@query("G4_split_to_target", on_c(f"""SELECT work_id, row_number() OVER (PARTITION BY work_id ORDER BY number, piece) AS number, title, md5(content) AS digest, {wc('content')} AS word_count FROM cut
WHERE work_id IN (SELECT work_id FROM (SELECT c.work_id, sum({wc('c.content')}) AS a FROM cut c GROUP BY 1) JOIN (SELECT work_id, sum(words) AS b FROM alloc GROUP BY 1) USING (work_id) WHERE abs(a - b) <= b * 0.02)""", _alloc("sections_c", 12, 20) + ", " + SPLIT))
def _(spark, d):
    out = sg.split_to_target(sections_c(spark, d), 12, 20, min_split=10**5)
    return out.select("work_id", "number", "title", F.md5("content").alias("digest"), "word_count")


@query("G4_split_status", on_c(f"SELECT work_id, CASE WHEN count(*) >= 5 THEN 'already_enough' WHEN sum({wc('content')}) < 5 * 40 THEN 'too_short' ELSE 'ok' END AS status FROM sections_c GROUP BY work_id"))
def _(spark, d):
    return sg.split_status(sections_c(spark, d), 5, 40)


@query("G4_split_documents", on_v(f"""SELECT work_id, row_number() OVER (PARTITION BY work_id ORDER BY number, piece) AS number, title, md5(content) AS digest, {wc('content')} AS word_count
FROM cut WHERE work_id IN (SELECT work_id FROM whole)""", split_documents(40)))
def _(spark, d):
    out = sg.split_to_target(sections_v(spark, d), 600, 20)
    return out.select("work_id", "number", "title", F.md5("content").alias("digest"), "word_count")


@query("G5_split_thin_works", on_c("""SELECT work_id, row_number() OVER (PARTITION BY work_id ORDER BY number, piece) AS number, title, md5(content) AS digest FROM cut
WHERE work_id IN (SELECT work_id FROM sections_c WHERE publish_status = 'published' GROUP BY 1 HAVING count(*) < 5) AND work_id IN (SELECT work_id FROM works_c WHERE publish_status = 'published')""", _alloc("sections_c", 12, 20) + ", " + SPLIT))
def _(spark, d):
    out = sg.split_thin(works_c(spark, d), sections_c(spark, d), 5, 12, 20, min_split=10**5)
    return out.select("work_id", "number", "title", F.md5("content").alias("digest"))


@query("G5_split_thin_documents", on_v("""SELECT work_id, row_number() OVER (PARTITION BY work_id ORDER BY number, piece) AS number, title, md5(content) AS digest FROM cut
WHERE work_id IN (SELECT work_id FROM whole) AND work_id IN (SELECT work_id FROM sections_v WHERE publish_status = 'published' GROUP BY 1 HAVING count(*) < 600) AND work_id IN (SELECT work_id FROM works_v WHERE publish_status = 'published')""", split_documents(40)))
def _(spark, d):
    out = sg.split_thin(works_v(spark, d), sections_v(spark, d), 600, 600, 20)
    return out.select("work_id", "number", "title", F.md5("content").alias("digest"))


def _cue_sql(size, wps):
    return f"""SELECT doc_id, (k + 1)::INT AS idx, k * {size} / {wps} AS s, least(n, (k + 1) * {size}) / {wps} AS e, array_to_string(w[k * {size} + 1 : (k + 1) * {size}], ' ') AS text
FROM (SELECT doc_id, w, len(w) AS n, unnest(range((len(w) + {size} - 1) // {size})) AS k FROM (SELECT doc_id, regexp_extract_all(text, '[^{SPACE}]+') AS w FROM documents))"""


def _stamp(x):
    return f"printf('%02d:%02d:%02d,%03d', CAST(floor({x} / 3600) AS BIGINT), CAST(floor({x} / 60) AS BIGINT) % 60, CAST(floor({x}) AS BIGINT) % 60, CAST(floor(({x} - floor({x})) * 1000) AS BIGINT))"


@query("G6_cues", f"SELECT doc_id, idx, round(s, 6) AS s, round(e, 6) AS e, md5(text) AS digest FROM ({_cue_sql(60, '3.0::DOUBLE')})")
def _(spark, d):
    q = table(spark, d, "documents").select("doc_id", F.explode(sg.cues("text")).alias("q"))
    return q.select("doc_id", "q.idx", F.round("q.start", 6).alias("s"), F.round("q.end", 6).alias("e"), F.md5("q.text").alias("digest"))


@query("K5_subtitles", f"""SELECT doc_id, md5(string_agg(idx || chr(10) || {_stamp('s')} || ' --> ' || {_stamp('e')} || chr(10) || text || chr(10) || chr(10), '' ORDER BY idx)) AS digest
FROM ({_cue_sql(5, '0.25::DOUBLE')}) GROUP BY doc_id""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(sg.srt("text", 20.0, 0.25)).alias("digest"))


@query("T38_srt_times", f"SELECT event_id, {_stamp('(value * 37)')} AS at FROM events WHERE value >= 0")
def _(spark, d):
    return table(spark, d, "events").filter("value >= 0").select("event_id", sg.srt_stamp(F.col("value") * 37).alias("at"))


def _pack_sql(source, limit, lengths="length(content)"):
    """Greedy packing by a recursive walk over row positions."""
    return f"""WITH RECURSIVE {source},
seq AS (SELECT work_id, number, {lengths} AS length, row_number() OVER (PARTITION BY work_id ORDER BY number) AS i FROM base),
walk AS (SELECT work_id, number, length, i, 1 AS part, length AS open FROM seq WHERE i = 1 UNION ALL
  SELECT s.work_id, s.number, s.length, s.i, CASE WHEN w.open + s.length > {limit} THEN w.part + 1 ELSE w.part END, CASE WHEN w.open + s.length > {limit} THEN s.length ELSE w.open + s.length END
  FROM walk w JOIN seq s ON s.work_id = w.work_id AND s.i = w.i + 1)
SELECT work_id, number, length, part FROM walk"""


DOCS = "base AS (SELECT source AS work_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS number, text AS content FROM documents)"
TURNS = "base AS (SELECT 'c' || conv_id AS work_id, turn + 1 AS number, text AS content FROM conversations)"


@query("P1_pack_sections", _pack_sql(DOCS, 6000))
def _(spark, d):
    s = sections_v(spark, d).select("work_id", "number", F.length("content").alias("length"))
    return sg.pack_sections(s, 6000)


@query("P1_pack_turns", _pack_sql(TURNS, 700))
def _(spark, d):
    s = sections_c(spark, d).select("work_id", "number", F.length("content").alias("length"))
    return sg.pack_sections(s, 700)


@query("P2_pack_paragraphs", """WITH RECURSIVE p AS (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)) AS ps, text FROM documents WHERE length(replace(text, chr(10), chr(10) || chr(10))) > 1200)),
rowsp AS (SELECT doc_id, i, ps[i] AS para, length(ps[i]) AS n FROM p),
walk AS (SELECT doc_id, i, para, 1 AS part, n AS open FROM rowsp WHERE i = 1 UNION ALL
  SELECT r.doc_id, r.i, r.para, CASE WHEN w.open + r.n > 1200 THEN w.part + 1 ELSE w.part END, CASE WHEN w.open + r.n > 1200 THEN r.n ELSE w.open + r.n END FROM walk w JOIN rowsp r ON r.doc_id = w.doc_id AND r.i = w.i + 1)
SELECT doc_id, (part - 1)::INT AS pos, md5(string_agg(para, chr(10) || chr(10) ORDER BY i)) AS digest FROM walk GROUP BY doc_id, part
UNION ALL SELECT doc_id, 0, md5(replace(text, chr(10), chr(10) || chr(10))) FROM documents WHERE length(replace(text, chr(10), chr(10) || chr(10))) <= 1200""")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return docs.select("doc_id", F.posexplode(sg.text_chunks("text", 1200)).alias("pos", "chunk")).select("doc_id", "pos", F.md5("chunk").alias("digest"))


@query("P3_numbered_paragraphs", on_c(f"""SELECT work_id, number, md5(array_to_string(list_transform({PARTS}, lambda x, i: '[Đoạn ' || i || '] ' || x), chr(10) || chr(10))) AS digest FROM sections_c"""))
def _(spark, d):
    return sections_c(spark, d).select("work_id", "number", F.md5(sg.numbered_paragraphs(sg.paragraphs("content", 10**6))).alias("digest"))


@query("P3_numbered_documents", f"WITH {cascade('cas', 'documents', 'doc_id', 'text', 100)} SELECT doc_id, md5(array_to_string(list_transform(ps, lambda x, i: '[Đoạn ' || i || '] ' || x), chr(10) || chr(10))) AS digest FROM cas")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(sg.numbered_paragraphs(sg.paragraphs("text", 100))).alias("digest"))


@query("P4_section_contexts", on_c(f"""SELECT s.work_id, s.number, md5(concat_ws(chr(10), w.title, coalesce(nullif(w.genres, ''), '(unknown)'), s.number || ': ' || s.title, CASE WHEN length(c) <= 500 THEN c ELSE substr(c, 1, 250) || chr(10) || chr(91) || ' cut ' || chr(93) || chr(10) || right(c, 250) END,
coalesce('next: ' || nxt, 'next: -'))) AS digest FROM (SELECT *, {strip('content')} AS c, lead(title) OVER (PARTITION BY work_id ORDER BY number) AS nxt FROM sections_c) s JOIN works_c w USING (work_id)"""))
def _(spark, d):
    from quire.plans.contexts import section_contexts

    out = section_contexts(works_c(spark, d), sections_c(spark, d), 500, "\n[ cut ]\n")
    return out.select("work_id", "number", F.md5("context").alias("digest"))


@query("P4_work_contexts", on_v("""SELECT work_id, coalesce(n, 0) AS sections, md5(concat_ws(chr(10), title, coalesce(nullif(author, ''), '(unknown)'), coalesce(nullif(genres, ''), '(unknown)'),
  substr(coalesce(nullif(description, ''), '(none)'), 1, 500), coalesce(n, 0)::VARCHAR, excerpt)) AS digest
FROM works_v LEFT JOIN (SELECT work_id, count(*) AS n FROM sections_v GROUP BY work_id) USING (work_id) LEFT JOIN ex USING (work_id)""", f"ex AS ({excerpt_sql()})"))
def _(spark, d):
    from quire.plans.contexts import work_contexts

    return work_contexts(works_v(spark, d), sections_v(spark, d)).select("work_id", "sections", F.md5("context").alias("digest"))
