"""Vocabulary, quality and word repair queries."""

from pyspark.sql import functions as F

from quire.functions import rules
from quire.functions import syllable as sy
from quire.functions import text as t
from quire.operators import correct, lexicon as lx
from quire.plans.repair import clean_and_repair, repair_words
from quire.queries.texts import docs
from quire.registry import query, table
from quire.session import checkpoint

TONED = "".join(row[1:] for row in rules.TONES.values())
PLAIN = "".join(b * 5 for b in rules.TONES)
FRONT = "substr(r, 1, 1) IN ('e', 'ê', 'i')"
BASES = f"""onsets(o) AS (VALUES {', '.join(f"('{o}')" for o in rules.ONSETS)}),
rhymes(r) AS (VALUES {', '.join(f"('{r}')" for r in rules.RHYMES)}),
bases AS (SELECT DISTINCT o || r AS b FROM onsets, rhymes WHERE CASE WHEN o IN ('gh', 'ngh') THEN {FRONT} WHEN o IN ('ng', 'g', 'c') THEN NOT {FRONT}
  WHEN o = 'k' THEN {FRONT} OR substr(r, 1, 1) = 'y' WHEN o = 'qu' THEN substr(r, 1, 1) <> 'u' ELSE true END
  UNION SELECT 'gi' || substr(r, 2) FROM rhymes WHERE r LIKE 'i%' AND length(r) > 1 UNION SELECT 'gi')"""


def _vocab(source="SELECT text FROM documents", name="tok"):
    """Distinct tokens with their verdicts."""
    return f"""{name}_all AS (SELECT unnest(regexp_extract_all(text, '{rules.TOKEN}')) AS token FROM ({source})),
{name} AS (SELECT token, lower(token) AS low, count(*) AS n, translate(lower(token), '{TONED}', '{PLAIN}') AS base,
  length(regexp_replace(token, '[^{TONED}{TONED.upper()}]+', '', 'g')) AS marks FROM {name}_all GROUP BY token),
{name}_v AS (SELECT *, NOT regexp_matches(token, '^\\p{{L}}+$') OR (marks <= 1 AND base IN (SELECT b FROM bases)) AS valid,
  regexp_matches(token, '^\\p{{L}}{{2,}}$') AND (marks > 0 OR regexp_matches(token, '[ăâđêôơưĂÂĐÊÔƠƯ]')) AS suspicious FROM {name})"""


VOCAB = "WITH " + BASES + ", " + _vocab()
TEXTS = "SELECT text FROM documents UNION ALL SELECT text FROM conversations"
BENCH = _vocab(f"SELECT text FROM benchmark UNION ALL {TEXTS}", "btok")
LEXICON = BENCH + ", lex AS (SELECT low AS syllable FROM (SELECT low, sum(n) AS n, bool_and(valid) AS valid FROM btok_v GROUP BY low) WHERE n >= 2 AND valid)"
LEX = "WITH " + BASES + ", " + LEXICON


def lexicon(spark, d):
    """The lexicon of all text tables."""
    return lx.lexicon_of(lx.token_counts(table(spark, d, "benchmark").select("text").unionByName(all_texts(spark, d)), "text"))


def all_texts(spark, d):
    return table(spark, d, "documents").select("text").unionByName(table(spark, d, "conversations").select("text"))


@query("A6_token_counts", VOCAB + " SELECT low AS token, sum(n)::BIGINT AS n FROM tok GROUP BY low")
def _(spark, d):
    return lx.token_counts(docs(spark, d), "text")


@query("A7_lexicon", LEX + " SELECT syllable FROM lex ORDER BY syllable")
def _(spark, d):
    return lexicon(spark, d).orderBy("syllable")


@query("S7_lexicon_rows", "SELECT DISTINCT lower(trim(w)) AS syllable FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE trim(w) <> ''")
def _(spark, d):
    from quire.sources.readers import lexicon_lines

    lines = table(spark, d, "benchmark").select(F.explode(F.split("text", " ")).alias("value"))
    return lexicon_lines(lines).distinct()


@query("C1_tones", VOCAB + f" SELECT token, translate(token, '{TONED}{TONED.upper()}', '{PLAIN}{PLAIN.upper()}') AS base, marks FROM tok")
def _(spark, d):
    words = docs(spark, d).select(F.explode(sy.tokens("text")).alias("token")).distinct()
    return words.select("token", sy.strip_tones("token").alias("base"), sy.tone_marks("token").alias("marks"))


@query("C2_verdicts", VOCAB + " SELECT token, valid, suspicious FROM tok_v")
def _(spark, d):
    words = docs(spark, d).select(F.explode(sy.tokens("text")).alias("token"))
    return lx.verdicts(words).select("token", "valid", "suspicious")


@query("C3_real_syllables", VOCAB + ", " + LEXICON + " SELECT token, valid AND low IN (SELECT syllable FROM lex) AS real FROM tok_v")
def _(spark, d):
    words = docs(spark, d).select(F.explode(sy.tokens("text")).alias("token"))
    return lx.verdicts(words, lexicon(spark, d)).select("token", "real")


DOUBLED = "(" + "|".join(v + v for v in rules.TONES) + ")"


@query("C4_doubled_vowels", VOCAB + f" SELECT token, suspicious, regexp_matches(replace(base, 'oong', ''), '{DOUBLED}') AS doubled FROM tok_v")
def _(spark, d):
    words = docs(spark, d).select(F.explode(sy.tokens("text")).alias("token"))
    return lx.verdicts(words).select("token", "suspicious", "doubled")


@query("A10_text_quality", "WITH " + BASES + ", " + _vocab() + f""", occ AS (SELECT doc_id, unnest(regexp_extract_all(nfc_normalize(text), '{rules.TOKEN}')) AS token FROM documents)
SELECT d.doc_id, coalesce(total, 0) AS total, coalesce(invalid, 0) AS invalid, round(coalesce(invalid / total, 0), 6) AS ratio FROM documents d LEFT JOIN
(SELECT doc_id, count(*) AS total, (count(*) FILTER (suspicious AND NOT valid))::BIGINT AS invalid FROM occ JOIN tok_v USING (token) GROUP BY doc_id) USING (doc_id)""")
def _(spark, d):
    from quire.operators.normalise import nfc

    out = lx.quality(nfc(docs(spark, d), "text"), ["doc_id"], "text")
    return out.select("doc_id", "total", "invalid", F.round("ratio", 6).alias("ratio"))


@query("A10_uncorrectable_words", "WITH " + BASES + ", " + _vocab() + f""", occ AS (SELECT doc_id, i, ts[i] AS token FROM (SELECT doc_id, ts, unnest(range(1, len(ts) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(nfc_normalize(text), '{rules.TOKEN}') AS ts FROM documents)))
SELECT doc_id, md5(string_agg(token, ' ' ORDER BY i)) AS words FROM occ JOIN tok_v USING (token) WHERE suspicious AND NOT valid GROUP BY doc_id""")
def _(spark, d):
    out = lx.quality(docs(spark, d), ["doc_id"], "text").filter("invalid > 0")
    return out.select("doc_id", F.md5(F.array_join("words", " ")).alias("words"))


def damaged(spark, d):
    """The damaged words of documents and conversations, stored: most queries use them more than once."""
    return checkpoint(correct.damaged_words(all_texts(spark, d), "text"))


_ONSETS = "|".join(sorted((o for o in rules.ONSETS if o), key=lambda o: -len(o)))


def _onset(x):
    return f"regexp_extract(translate({x}, '{TONED}', '{PLAIN}'), '^({_ONSETS})', 1)"


def _fuzzy(source):
    """CTEs: the damaged words of some texts (bad) and the lexicon words one edit away (cands)."""
    return LEX + f""", {_vocab(source, 'ctok')}, bad AS (SELECT token AS bad, low FROM ctok_v WHERE suspicious AND NOT valid AND length(token) >= 3),
bo AS (SELECT *, {_onset('low')} AS o FROM bad), lo AS (SELECT syllable AS cand, {_onset('syllable')} AS o FROM lex),
cands AS (SELECT bad, low, cand, CASE WHEN length(low) = length(cand) THEN 100 * (1 - 1.0::DOUBLE / length(low)) ELSE 100 * (1 - 1.0::DOUBLE / (length(low) + length(cand))) END AS ratio
  FROM bo JOIN lo ON bo.o = lo.o AND abs(length(low) - length(cand)) <= 1 AND CASE WHEN length(low) = length(cand) THEN len(list_filter(range(1, length(low) + 1), lambda i: substr(low, i, 1) <> substr(cand, i, 1))) = 1
  OR (low <> cand AND len(list_filter(range(1, length(low)), lambda i: substr(low, 1, i - 1) || substr(low, i + 1, 1) || substr(low, i, 1) || substr(low, i + 2) = cand)) > 0)
  WHEN length(low) > length(cand) THEN len(list_filter(range(1, length(low) + 1), lambda i: substr(low, 1, i - 1) || substr(low, i + 1) = cand)) > 0
  ELSE len(list_filter(range(1, length(cand) + 1), lambda i: substr(cand, 1, i - 1) || substr(cand, i + 1) = low)) > 0 END)"""


FUZZY = _fuzzy(TEXTS)
VOWELS = "".join(rules.TONES.values())
VOWEL_BASES = "".join(b * 6 for b in rules.TONES)
TONE_DIGITS = "012345" * len(rules.TONES)
SAME_BASE = "|".join(v + v for v in rules.TONES)


def _same(e):
    """Two neighbours of one base vowel become the one with the higher tone, left to right, by a fold over the letters."""
    base, tone = (lambda x: f"translate({x}, '{VOWELS}', '{VOWEL_BASES}')"), (lambda x: f"translate({x}, '{VOWELS}', '{TONE_DIGITS}')")
    fold = f"""list_reduce(list_transform(string_split({e}, ''), lambda ch: {{'done': '', 'open': ch}}), lambda a, x:
  CASE WHEN a.open <> '' AND contains('{VOWELS}', a.open) AND {base('a.open')} = {base('x.open')} THEN {{'done': a.done || CASE WHEN {tone('a.open')} >= {tone('x.open')} THEN a.open ELSE x.open END, 'open': ''}}
  ELSE {{'done': a.done || a.open, 'open': x.open}} END)"""
    return f"CASE WHEN regexp_matches({base(e)}, '{SAME_BASE}') THEN ({fold}).done || ({fold}).open ELSE {e} END"


def _runs(e):
    return f"array_to_string(list_filter(string_split({e}, ''), lambda ch, i: i = 1 OR substr({e}, i, 1) <> substr({e}, i - 1, 1)), '')"


def _repeated(e, k):
    """Repeats of a block of ``k`` letters are dropped, left to right."""
    times = f"coalesce(list_max(list_filter(range(1, (length({e}) - x.skip + 1) // {k} + 1), lambda j: substr({e}, x.skip, j * {k}) = repeat(substr({e}, x.skip, {k}), j))), 0)"
    return f"""(list_reduce(list_prepend({{'done': '', 'skip': 0::BIGINT}}, list_transform(range(1, length({e}) + 1), lambda i: {{'done': '', 'skip': i::BIGINT}})), lambda a, x:
  CASE WHEN a.skip > 0 THEN {{'done': a.done, 'skip': a.skip - 1}} WHEN {times} >= 2 THEN {{'done': a.done || substr({e}, x.skip, {k}), 'skip': ({times} * {k} - 1)::BIGINT}}
  ELSE {{'done': a.done || substr({e}, x.skip, 1), 'skip': 0::BIGINT}} END)).done"""


def _valid(c):
    return f"""({c} <> '' AND (NOT regexp_matches({c}, '^\\p{{L}}+$') OR (length(regexp_replace({c}, '[^{TONED}{TONED.upper()}]+', '', 'g')) <= 1 AND translate(lower({c}), '{TONED}', '{PLAIN}') IN (SELECT b FROM bases))))"""


CASED = "CASE WHEN regexp_matches(substr(bad, 1, 1), '\\p{Lu}') THEN upper(substr(c, 1, 1)) || substr(c, 2) ELSE c END"
IS_VOWEL = f"contains('{VOWELS}', substr(low, i, 1)) AND contains('{VOWELS}', substr(low, i + 1, 1)) AND translate(substr(low, i, 1), '{VOWELS}', '{VOWEL_BASES}') <> translate(substr(low, i + 1, 1), '{VOWELS}', '{VOWEL_BASES}')"
#: CTEs after ``_fuzzy``: words (all damaged ones), first (tier 1), second (tier 2).
TIERS = f""", words AS (SELECT token AS bad, low FROM ctok_v WHERE suspicious AND NOT valid),
one AS (SELECT *, {_same('low')} AS same, {_runs('low')} AS runs, {_repeated('low', 2)} AS twos FROM words),
two AS (SELECT *, {_repeated('twos', 3)} AS blocks, {_repeated('same', 2)} AS same_twos FROM one),
safe AS (SELECT bad, arg_min(c, k) AS c FROM (SELECT bad, unnest(list_value(same, runs, blocks, {_runs('same')}, {_same('runs')}, {_repeated('same_twos', 3)}, {_same('blocks')})) AS c, unnest(range(1, 8)) AS k FROM two)
  WHERE {_valid('c')} GROUP BY bad),
deleted AS (SELECT DISTINCT bad, unnest(list_value(substr(low, 1, i - 1) || substr(low, i + 1), substr(low, 1, i) || substr(low, i + 2))) AS c
  FROM (SELECT bad, low, unnest(range(1, length(low))) AS i FROM words WHERE bad NOT IN (SELECT bad FROM safe)) WHERE {IS_VOWEL}),
votes AS (SELECT bad, count(*) FILTER (is_real) AS n_real, max(c) FILTER (is_real) AS one_real, count(*) FILTER (is_valid) AS n_valid, max(c) FILTER (is_valid) AS one_valid
  FROM (SELECT bad, c, c IN (SELECT syllable FROM lex) AS is_real, {_valid('c')} AS is_valid FROM deleted) GROUP BY bad),
picked AS (SELECT bad, c FROM safe UNION ALL SELECT bad, CASE WHEN n_real = 1 THEN one_real ELSE one_valid END AS c FROM votes WHERE n_real = 1 OR (n_real = 0 AND n_valid = 1)),
first AS (SELECT bad, {CASED} AS good FROM picked WHERE c <> '' AND {CASED} <> bad),
second AS (SELECT bad, {CASED} AS good FROM (SELECT bad, max(cand) AS c FROM cands WHERE ratio >= 75 AND bad NOT IN (SELECT bad FROM first) GROUP BY bad HAVING count(*) = 1))"""
CASCADE = FUZZY + TIERS + f""", tiers AS (SELECT bad, good, 1 AS tier FROM first UNION ALL SELECT bad, good, 2 FROM second),
given AS (SELECT bad, translate(low, '{TONED}', '{PLAIN}') AS good FROM words WHERE bad NOT IN (SELECT bad FROM tiers)),
fixes AS (SELECT * FROM tiers UNION ALL SELECT bad, good, 4 FROM given WHERE good <> bad AND {_valid('good')}),
cascade AS (SELECT bad, good, tier FROM words LEFT JOIN fixes USING (bad))"""


@query("J11_fuzzy_candidates", FUZZY + """ SELECT bad, cand, round(ratio, 6) AS ratio, 1 AS ed FROM (SELECT *, row_number() OVER (PARTITION BY bad ORDER BY ratio DESC, cand) AS k FROM cands WHERE ratio >= 75) WHERE k <= 8""")
def _(spark, d):
    out = correct.fuzzy_candidates(damaged(spark, d), lexicon(spark, d))
    return out.withColumn("ratio", F.round("ratio", 6))


@query("C5_collapse_fixes", FUZZY + TIERS + " SELECT bad, good FROM first")
def _(spark, d):
    return correct.collapse_fixes(damaged(spark, d), lexicon(spark, d))


@query("C6_fuzzy_fixes", FUZZY + f" SELECT bad, {CASED} AS good FROM (SELECT bad, max(cand) AS c FROM cands WHERE ratio >= 75 GROUP BY bad HAVING count(*) = 1)")
def _(spark, d):
    return correct.fuzzy_fixes(correct.fuzzy_candidates(damaged(spark, d), lexicon(spark, d)))


@query("L7_top_candidates", FUZZY + """ SELECT bad, count(*) AS kept, min(cand) AS first_cand FROM (SELECT *, row_number() OVER (PARTITION BY bad ORDER BY ratio DESC, cand) AS k FROM cands WHERE ratio >= 75) WHERE k <= 2 GROUP BY bad""")
def _(spark, d):
    out = correct.fuzzy_candidates(damaged(spark, d), lexicon(spark, d), top=2)
    return out.groupBy("bad").agg(F.count(F.lit(1)).alias("kept"), F.min("cand").alias("first_cand"))


@query("C7_scored_fixes", FUZZY + f""", top8 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bad ORDER BY ratio DESC, cand) AS k FROM cands WHERE ratio >= 75) WHERE k <= 8),
scored AS (SELECT bad, cand, (('0x' || substr(md5(bad || cand), 1, 6))::BIGINT % 1000) / 100.0 AS score, count(*) OVER (PARTITION BY bad) AS n FROM top8),
ranked AS (SELECT *, lead(score) OVER w AS nxt, row_number() OVER w AS rn FROM scored WHERE n >= 2 WINDOW w AS (PARTITION BY bad ORDER BY score DESC, cand))
SELECT bad, {CASED} AS good FROM (SELECT bad, cand AS c FROM ranked WHERE rn = 1 AND score - nxt >= 1.5)""")
def _(spark, d):
    cands = checkpoint(correct.fuzzy_candidates(damaged(spark, d), lexicon(spark, d)))
    score = (F.conv(F.substring(F.md5(F.concat("bad", "cand")), 1, 6), 16, 10).cast("bigint") % 1000) / 100.0
    return correct.scored_fixes(cands, cands.select("bad", "cand", score.alias("score")))


@query("C8_supplied_fixes", LEX + f""", {_vocab(TEXTS, 'ctok')}, v AS (SELECT token AS bad, replace(replace(base, 'ç', 'c'), 'ôô', 'ô') AS good FROM ctok_v WHERE suspicious AND NOT valid)
SELECT bad, good FROM v WHERE good <> '' AND good <> bad AND (NOT regexp_matches(good, '^\\p{{L}}+$') OR good IN (SELECT b FROM bases))""")
def _(spark, d):
    words = damaged(spark, d)
    good = F.replace(F.replace(sy.strip_tones(F.lower("bad")), F.lit("ç"), F.lit("c")), F.lit("ôô"), F.lit("ô"))
    return correct.supplied_fixes(words, words.select("bad", good.alias("good")))


def _cascade(spark, d):
    words = damaged(spark, d)
    supplied = words.select("bad", sy.strip_tones(F.lower("bad")).alias("good"))
    return correct.cascade(words, lexicon(spark, d), supplied=supplied)


@query("C9_cascade", CASCADE + " SELECT bad, good, tier FROM cascade")
def _(spark, d):
    return _cascade(spark, d)


@query("A9_tier_coverage", CASCADE + """ SELECT k::INT AS tier, fixed, remaining, CASE WHEN fixed + remaining = 0 THEN 0.0 ELSE round(100 * fixed / (fixed + remaining), 6) END AS percent
FROM (SELECT k, count(*) FILTER (tier = k) AS fixed, count(*) FILTER (tier IS NULL OR tier > k) AS remaining FROM cascade, (SELECT unnest([1, 2, 3, 4]) AS k) GROUP BY k)""")
def _(spark, d):
    return correct.tier_coverage(_cascade(spark, d))


@query("A8_residual_words", CASCADE + " SELECT bad FROM cascade WHERE good IS NULL ORDER BY bad")
def _(spark, d):
    return correct.residuals(_cascade(spark, d)).orderBy("bad")


@query("J14_agreement", FUZZY + f""", pick AS (SELECT bad, max(cand) AS good FROM cands WHERE ratio >= 75 GROUP BY bad HAVING count(*) = 1),
seen AS (SELECT bad, cand AS variant FROM cands UNION SELECT bad, translate(low, '{TONED}', '{PLAIN}') FROM bad WHERE length(bad) % 2 = 0)
SELECT p.bad, p.good, count(*) FILTER (variant = good) = 0 AS mismatch, count(DISTINCT variant) > 1 AS inconsistent FROM pick p JOIN seen USING (bad) GROUP BY ALL""")
def _(spark, d):
    words = damaged(spark, d)
    cands = checkpoint(correct.fuzzy_candidates(words, lexicon(spark, d), min_ratio=0.0, top=10**6))
    strict = cands.filter("ratio >= 75")
    pick = strict.groupBy("bad").agg(F.count(F.lit(1)).alias("n"), F.max("cand").alias("good")).filter("n = 1").drop("n")
    other = words.filter((F.length("bad") % 2 == 0) & (F.length("bad") >= 3)).select("bad", sy.strip_tones(F.lower("bad")).alias("variant"))
    seen = cands.select("bad", F.col("cand").alias("variant")).unionByName(other)
    return correct.agreement(pick, seen)


@query("T14_token_rewrite", _fuzzy("SELECT nfc_normalize(text) AS text FROM conversations") + TIERS + f""", fix AS (SELECT * FROM first UNION ALL SELECT * FROM second),
seg AS (SELECT conv_id, turn, segs, unnest(range(1, len(segs) + 1)) AS i FROM (SELECT conv_id, turn, regexp_extract_all(nfc_normalize(text), '{rules.TOKEN}|[^A-Za-zÀ-ỹĐđ]+') AS segs FROM conversations))
SELECT conv_id, turn, md5(string_agg(coalesce(good, segs[i]), '' ORDER BY i)) AS digest FROM seg LEFT JOIN fix ON fix.bad = segs[i] GROUP BY conv_id, turn""")
def _(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text")
    fixed, _ = repair_words(rows, lexicon(spark, d), ["conv_id", "turn"], "text")
    return fixed.select("conv_id", "turn", F.md5("text").alias("digest"))


@query("T25_apply_supplied_fixes", LEX + f""", {_vocab(TEXTS, 'ctok')}, fix AS (SELECT token AS bad, base AS good FROM ctok_v WHERE suspicious AND NOT valid AND base IN (SELECT b FROM bases) AND base <> token),
seg AS (SELECT conv_id, turn, segs, unnest(range(1, len(segs) + 1)) AS i FROM (SELECT conv_id, turn, regexp_extract_all(text, '{rules.TOKEN}|[^A-Za-zÀ-ỹĐđ]+') AS segs FROM conversations))
SELECT conv_id, turn, md5(string_agg(coalesce(good, segs[i]), '' ORDER BY i)) AS digest FROM seg LEFT JOIN fix ON fix.bad = segs[i] GROUP BY conv_id, turn""")
def _(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text")
    words = correct.damaged_words(rows, "text")
    fixes = correct.supplied_fixes(words, words.select("bad", sy.strip_tones(F.lower("bad")).alias("good")))
    return correct.apply_fixes(rows, fixes, ["conv_id", "turn"], "text").select("conv_id", "turn", F.md5("text").alias("digest"))


@query("T15_drop_corrupted_words")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.md5(sy.drop_corrupted_words("text")).alias("digest"))


@query("T15_corrupted_vocabulary", VOCAB + """ SELECT token, length(token) >= 3 AND regexp_matches(token, '[^\\x00-\\x7f]') AND len(list_filter(regexp_extract_all(plain, '["""
       + "".join(rules.TONES.values()) + """]{2,}'), lambda r: length(regexp_replace(r, '[^""" + TONED + """]', '', 'g')) >= 2 OR NOT regexp_matches(translate(r, '"""
       + TONED + "', '" + PLAIN + """'), '^(""" + "|".join(rules.VOWEL_CLUSTERS) + "|(" + "|".join(x for x in rules.VOWEL_CLUSTERS if len(x) == 3) + ").?|("
       + "|".join(x for x in rules.VOWEL_CLUSTERS if len(x) == 2) + """).?)$'))) > 0 AS corrupted FROM (SELECT token, regexp_replace(regexp_replace(low, 'g(i)(["""
       + "".join(row for b, row in rules.TONES.items() if b not in "iy") + """])', 'g-\\2', 'g'), 'qu', 'q-', 'g') AS plain FROM tok)""")
def _(spark, d):
    words = docs(spark, d).select(F.explode(sy.tokens("text")).alias("token")).distinct()
    return words.select("token", sy.is_corrupted_word("token").alias("corrupted"))


@query("T8_clean_and_repair")
def _(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text")
    out = clean_and_repair(rows, lexicon(spark, d), ["conv_id", "turn"], "text", foreign=(("the", "le"),))
    return out.select("conv_id", "turn", F.md5("text").alias("digest"))
