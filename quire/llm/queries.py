"""One query per operator over its whole table, and the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, hard_negatives, line_quality, lm_score, m_tree, mixing, near_join, pii, preference, quality_rules, ranked_search, toxicity, url_filter
from quire.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op2_decontaminate", r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)
), iw AS (
  SELECT item_id, regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM benchmark)
), iwin AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS run
  FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i
        FROM (SELECT item_id, w, least(len(w), 10) AS m FROM iw WHERE len(w) > 0))
), lengths AS (SELECT DISTINCT m FROM iwin
), dwin AS (
  SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS run
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, lengths WHERE len(w) >= m)
), hits AS (SELECT doc_id, item_id, m, i FROM dwin JOIN iwin USING (m, run)
), hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", *decontaminate.digest(found))


STOP_SQL = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
QUALITY_SQL = rf"""
SELECT *, failed_rules = '' AND NOT base_failed AS kept FROM (
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  concat_ws(',',
    CASE WHEN n_words < 10 THEN 'few_words' END, CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 'repeats' END,
    CASE WHEN 100 * word_chars < 150 * n_words OR 100 * word_chars > 3000 * n_words THEN 'word_length' END,
    CASE WHEN 100 * n_symbols > 10 * n_words THEN 'symbols' END, CASE WHEN 100 * n_exclaims > 10 * n_words THEN 'exclamations' END,
    CASE WHEN 100 * n_capitals > 50 * n_words THEN 'capitals' END, CASE WHEN 100 * n_adjacent > 20 * n_words THEN 'adjacent' END,
    CASE WHEN 100 * n_dup_lines > 40 * n_lines THEN 'dup_lines' END,
    CASE WHEN n_words >= 100 AND 100 * n_stop_words < 2 * n_words THEN 'stop_words' END) AS failed_rules
FROM (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_exclaims,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(list_filter(w, lambda x: upper(x) = x AND lower(x) <> x)) AS BIGINT) AS n_capitals,
    CAST(len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS BIGINT) AS n_adjacent,
    CAST(len(list_filter(w, lambda x: lower(x) IN ({STOP_SQL}))) AS BIGINT) AS n_stop_words,
    CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words
  FROM (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents)
  LEFT JOIN (
    SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (
      SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (
        SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS c FROM (
          SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS run FROM (
            SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i
            FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents) WHERE len(w) >= 5)))
      WHERE c > 1) GROUP BY doc_id) USING (doc_id)))
"""


@query("op4_quality_rules", QUALITY_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("quality")
    judged = quality_rules.judge(read(spark, sf_dir, "documents").select("doc_id", "text"))
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    return judged.select("doc_id", *[q[n].alias(n) for n in names], F.array_join(q["failed"], ",").alias("failed_rules"))


MIX_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-') || chr(1) || md5(coalesce(text, ''))), 1, 12) AS BIGINT) AS place
  FROM documents
), src AS (
  SELECT source, source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source)
), ordered AS (
  SELECT *, sum(source_size) OVER () AS total, sum(cap) OVER o - cap AS before,
    sum(weight) OVER () - sum(weight) OVER o + weight AS weight_left
  FROM src WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), filled AS (SELECT *, cap * weight_left <= (total - before) * weight AS is_full FROM ordered
), aimed AS (
  SELECT source, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE)
    ELSE CAST((total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ()) * weight AS DOUBLE)
      / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () END AS target
  FROM filled
), budget AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM aimed
), places AS (
  SELECT source, place, sum(size) AS s, sum(sum(size)) OVER (PARTITION BY source ORDER BY place) AS through FROM docs GROUP BY source, place
), extra AS (
  SELECT p.source, p.place, through <= r OR (through - s <= r AND 2 * (r - (through - s)) >= s) AS more
  FROM places p JOIN (SELECT *, target - whole * source_size AS r FROM budget) b ON p.source IS NOT DISTINCT FROM b.source
)
SELECT d.doc_id, d.size, b.source_size, b.target, CAST(d.size * (b.whole + CASE WHEN e.more THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM docs d JOIN budget b ON d.source IS NOT DISTINCT FROM b.source
JOIN extra e ON d.source IS NOT DISTINCT FROM e.source AND d.place = e.place
"""


@query("op7_mix_sources", MIX_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


CHAT_SQL = r"""
WITH last AS (SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id
), answers AS (SELECT conv_id - 1 AS conv_id, text AS answer FROM conversations JOIN last USING (conv_id, turn)
), rejected AS (
  SELECT c.conv_id, c.turn, role, CASE WHEN l.conv_id IS NULL THEN text ELSE answer END AS text
  FROM conversations c LEFT JOIN last l ON c.conv_id = l.conv_id AND c.turn = l.turn LEFT JOIN answers a ON l.conv_id = a.conv_id
  WHERE l.conv_id IS NULL OR answer IS NOT NULL
), differ AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, min(coalesce(c.turn, r.turn)) AS first
  FROM conversations c FULL JOIN rejected r ON c.conv_id = r.conv_id AND c.turn = r.turn
  WHERE c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text GROUP BY 1
), parts AS (
  SELECT c.conv_id, CASE WHEN first IS NULL OR turn < first THEN 'prompt' ELSE 'chosen' END AS part, turn, role, text
  FROM conversations c LEFT JOIN differ USING (conv_id)
  UNION ALL
  SELECT r.conv_id, 'rejected', turn, role, text FROM rejected r JOIN differ USING (conv_id) WHERE turn >= first
)
SELECT conv_id AS pair_id, part, turn, '<|im_start|>' || role || chr(10) || replace(text, '<|im_', '<| im_') || '<|im_end|>' || chr(10) AS rendered,
  part <> 'prompt' AND role = 'assistant' AS loss FROM parts
"""


@query("op5_preference_format", CHAT_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = read(spark, sf_dir, "conversations")
    return preference.prefer(chosen, preference.other_answers(chosen), pair="conv_id")


@query("op8_url_filter")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "block_score")


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op10_line_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))

#: The key of the surrogates; a production job passes its own secret.
PII_KEY = "surrogates of the sample tables"


@query("op9_pii_surrogates")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.replace(read(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    kinds = F.array_join(F.transform("entities", lambda e: e["kind"]), ",")
    return done.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), kinds.alias("kinds"))


NEAR_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * shared >= 80 * (p.n + q.n - shared)
), edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM words
  UNION
  SELECT r.a, e.y FROM reach r JOIN edges e ON e.x = r.b
)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM words w LEFT JOIN sizes USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) ON a = w.doc_id
"""


@query("op3_near_join", NEAR_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_copies(read(spark, sf_dir, "documents"))


@query("op1_lm_score")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(read(spark, sf_dir, "documents"))


def _vectors(scale: int) -> str:
    return f"""SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


TOP_SQL = f"""
WITH v AS ({_vectors(1024)}
), pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 10
"""


@query("op11_m_tree_search", TOP_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m_tree.top(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


RANKED_SQL = r"""
WITH dt AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), qt AS (
  SELECT item_id, term, count(*) AS q FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY ALL
), lengths AS (SELECT doc_id, count(*) AS n FROM dt GROUP BY doc_id
), totals AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM lengths
), m AS (SELECT doc_id, 100 - 75 + ((75 * n * n_docs) // all_terms) AS m FROM lengths, totals
), tf AS (SELECT doc_id, term, count(*) AS tf FROM dt WHERE term IN (SELECT term FROM qt) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals
), scores AS (
  SELECT item_id, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM qt JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
"""


@query("op12_ranked_search", RANKED_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


NEGATIVES_SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, e FROM ({_vectors(256)}) WHERE label IS NOT NULL
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS r FROM pairs WHERE same) WHERE r <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
  FROM positives p JOIN pairs n ON p.anchor_id = n.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
) WHERE rank <= 10
"""


@query("op13_hard_negatives", NEGATIVES_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)
