"""Text functions over whole documents and over texts built from them."""

from pyspark.sql import functions as F

from quire.functions import genres as g
from quire.functions import responses as r
from quire.functions import rules
from quire.functions import text as t
from quire.functions import urls
from quire.operators import phrases as ph
from quire.operators.normalise import nfc
from quire.queries.base import sections_c, works_v
from quire.queries.sql import SPACE, on_c, on_v, reflow, strip, wc
from quire.registry import query, table


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def digest(name, sql_expr, column):
    """A query that hashes one expression over every document."""
    query(name, None if sql_expr is None else f"SELECT doc_id, md5({sql_expr}) AS digest FROM documents")(
        lambda spark, d: docs(spark, d).select("doc_id", F.md5(column()).alias("digest"))
    )


@query("T1_word_count", f"SELECT doc_id, {wc('text')} AS words FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", t.word_count("text").alias("words"))


TABLED = "lower(text)"
digest("T2_slug", rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower(strip_accents(text)), 'đ', 'd'), '[^a-z0-9{SPACE}-]+', '', 'g'), '[{SPACE}]+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')""", lambda: t.slug("text"))
digest("T3_file_slug", f"""substr(regexp_replace(regexp_replace(translate(lower(text), '{rules.FILE_ACCENTS_FROM}', '{rules.FILE_ACCENTS_TO}'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 80)""", lambda: t.file_slug("text"))


@query("T4_nfc", "SELECT doc_id, md5(nfc_normalize(text)) AS digest FROM documents")
def _(spark, d):
    apart = docs(spark, d).withColumn("text", F.replace(F.replace("text", F.lit("é"), F.lit("é")), F.lit("ô"), F.lit("ô")))
    return nfc(apart, "text").select("doc_id", F.md5("text").alias("digest"))


digest("T5_repair_mojibake", "text", lambda: t.repair_mojibake(F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")))
digest("T6_strip_foreign", rf"""{strip(rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x{{4e00}}-\x{{9fff}}\x{{3400}}-\x{{4dbf}}\x{{f900}}-\x{{faff}}\x{{3000}}-\x{{303f}}\x{{0400}}-\x{{04ff}}\x{{ac00}}-\x{{d7af}}\x{{1100}}-\x{{11ff}}\x{{3040}}-\x{{30ff}}]+', '', 'g'), '(?:[a-zA-Z]+[{SPACE}]+){{3,}}[a-zA-Z]+', '', 'g'), '  +', ' ', 'g'), '(?m)^ +| +$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")}""", lambda: t.strip_foreign("text"))
digest("T7_reflow", reflow("""replace(text, '. ', '."')"""), lambda: t.reflow(F.replace("text", F.lit(". "), F.lit('."'))))
LEXICON = (("the", "le"), ("the of", "du"), ("une", "un"))
digest("T8_clean_body", None, lambda: t.clean_body("text", LEXICON))
digest("T9_replace_phrases", None, lambda: t.replace_phrases("text", (("the", "le"), ("un la", "une"))))
digest("T10_replace_foreign", None, lambda: t.replace_foreign_words("text", (("the", "le"), ("of", "de"))))


# phrase lists from a table: every word of `benchmark`, with a replacement made from it or the word that follows it there
WORD = r"[\p{L}\p{M}\p{N}_]"
LISTED = f"""dict AS (SELECT w, min(n) AS n FROM (SELECT ws[i] AS w, ws[i % len(ws) + 1] AS n FROM (SELECT ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT regexp_extract_all(lower(text), '{WORD}+') AS ws FROM benchmark))) GROUP BY w),
seg AS (SELECT doc_id, segs, i, segs[i] AS s FROM (SELECT doc_id, segs, unnest(range(1, len(segs) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{WORD}+|[^{WORD[1:-1]}]+') AS segs FROM documents)))"""


def _capital(c):
    return f"CASE WHEN lower(substr(s, 1, 1)) <> substr(s, 1, 1) AND upper(substr(s, 1, 1)) = substr(s, 1, 1) THEN upper(substr({c}, 1, 1)) || substr({c}, 2) ELSE {c} END"


def _listed(spark, d):
    """(word, the first of those that follow it) in `benchmark`; the first word follows the last."""
    words = table(spark, d, "benchmark").select(F.regexp_extract_all(F.lower("text"), F.lit(WORD + "+"), F.lit(0)).alias("ws")).filter(F.size("ws") > 0)
    pairs = words.select(F.explode(F.transform("ws", lambda w, i: F.struct(w.alias("w"), F.element_at(F.col("ws"), (i + 1) % F.size("ws") + 1).alias("n")))).alias("p"))
    return [(r["w"], r["n"]) for r in pairs.groupBy("p.w").agg(F.min("p.n").alias("n")).collect()]


@query("T9_phrase_list", f"""WITH {LISTED} SELECT d.doc_id, md5(coalesce(out, '')) AS digest FROM documents d LEFT JOIN (
SELECT doc_id, string_agg(CASE WHEN w IS NULL THEN s ELSE {_capital("('q' || w)")} END, '' ORDER BY i) AS out FROM seg LEFT JOIN dict ON lower(s) = w GROUP BY doc_id) USING (doc_id)""")
def _(spark, d):
    pairs = [(w, "q" + w) for w, _ in _listed(spark, d)]
    return docs(spark, d).select("doc_id", F.md5(F.coalesce(ph.replace_phrases("text", pairs), F.lit(""))).alias("digest"))


@query("T10_foreign_list", f"""WITH {LISTED} SELECT d.doc_id, md5(regexp_replace(coalesce(out, ''), '  +', ' ', 'g')) AS digest FROM documents d LEFT JOIN (
SELECT doc_id, string_agg(CASE WHEN w IS NULL THEN s WHEN coalesce(segs[i - 1] = ' ' AND ends_with(lower(segs[i - 2]), n), false) OR coalesce(segs[i + 1] = ' ' AND starts_with(lower(segs[i + 2]), n), false) THEN ''
  ELSE {_capital('n')} END, '' ORDER BY i) AS out FROM seg LEFT JOIN dict ON lower(s) = w GROUP BY doc_id) USING (doc_id)""")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.md5(F.coalesce(ph.replace_foreign_words("text", _listed(spark, d)), F.lit(""))).alias("digest"))


@query("F14_listed_terms", f"""WITH {LISTED} SELECT d.doc_id, coalesce(n_found, 0) AS n_found, coalesce(n_found, 0) > 0 AS found FROM documents d LEFT JOIN (
SELECT doc_id, count(*) AS n_found FROM seg JOIN dict ON lower(s) = w WHERE length(w) >= 12 GROUP BY doc_id) USING (doc_id)""")
def _(spark, d):
    terms = [w for w, _ in _listed(spark, d) if len(w) >= 12]
    n = F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda a, x: a + x)
    rows = docs(spark, d).select("doc_id", ph.holds_any("text", terms, bounded=True).alias("found"), ph.phrase_counts("text", terms).alias("counts"))
    return rows.select("doc_id", F.coalesce(n, F.lit(0)).alias("n_found"), F.coalesce("found", F.lit(False)).alias("found"))


def _nested(expr, steps):
    for pattern, to in steps:
        expr = f"regexp_replace({expr}, '{pattern}', {to}, 'g')"
    return expr


S = f"[{SPACE}]"
digest("T11_repair_punctuation", _nested("text", [
    (rf"([.!?,:;])([{t.LETTERS}])", r"'\1 \2'"), *[(rf"[{m}][{m}]+", f"'{m}'") for m in ".!?,;:"],
    (rf",{S}*\.", "'.'"), (rf",{S}*,+", "','"), (rf"{S}+,({S}*\n)", r"'\1'"), (rf"(\n){S}*,{S}*", r"'\1'"), (rf"{S}+([.!?,:;])", r"'\1'")]),
    lambda: t.repair_punctuation("text"))
# a fold over words and what lies between them: ``pend`` is the word that the next one may repeat, empty once it has been repeated
REPEATS = f"""list_reduce(list_prepend({{'done': '', 'pend': '', 'sep': ''}}, list_transform(regexp_extract_all(text, '{WORD}+|[^{WORD[1:-1]}]+'), lambda s: {{'done': '', 'pend': s, 'sep': ''}})), lambda a, x:
  CASE WHEN NOT regexp_matches(x.pend, '^{WORD}') THEN {{'done': a.done, 'pend': a.pend, 'sep': x.pend}}
  WHEN length(a.pend) >= 2 AND lower(a.pend) = lower(x.pend) AND regexp_matches(a.sep, '^[{SPACE}]+$') THEN {{'done': a.done || a.pend, 'pend': '', 'sep': ''}}
  ELSE {{'done': a.done || a.pend || a.sep, 'pend': x.pend, 'sep': ''}} END)"""
digest("T12_collapse_repeats", f"({REPEATS}).done || ({REPEATS}).pend || ({REPEATS}).sep", lambda: t.collapse_repeats("text"))
digest("T13_remove_hesitation", None, lambda: t.remove_hesitation("text"))
SENTENCES = rf"""string_split(regexp_replace(regexp_replace(text, '([.?!…])[{SPACE}]+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1))"""


@query("T16_sentences", f"SELECT doc_id, len({SENTENCES}) AS n, md5(array_to_string({SENTENCES}, '|')) AS digest FROM documents")
def _(spark, d):
    s = docs(spark, d).withColumn("s", t.sentences("text"))
    return s.select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


def _last(x, m):
    return f"(CASE WHEN strpos(reverse({x}), '{m[::-1]}') = 0 THEN -1 ELSE length({x}) - strpos(reverse({x}), '{m[::-1]}') - {len(m) - 1} END)"


def _rstrip(x):
    return f"regexp_replace({x}, '[{SPACE}]+$', '')"


def _truncated(x, n):
    h = f"substr({x}, 1, {n})"
    marks = " ".join(f"WHEN {_last(h, m)} > {n * 0.3} THEN {_rstrip(f'substr({h}, 1, {_last(h, m)} + {len(m)})')}" for m in (". ", ".\n", ".", "? ", "?", "! ", "!", "… ", "…"))
    return f"CASE WHEN length({x}) <= {n} THEN {x} {marks} WHEN {_last(h, ' ')} > {n * 0.3} THEN {_rstrip(f'substr({h}, 1, {_last(h, chr(32))})')} || '…' ELSE {_rstrip(h)} || '…' END"


digest("T18_truncate", _truncated("text", 200), lambda: t.truncate_at_sentence("text", 200))
digest("T18_truncate_short", _truncated("text", 20), lambda: t.truncate_at_sentence("text", 20))
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FAFF}\x{2600}-\x{26FF}\x{FE00}-\x{FE0F}\x{200B}-\x{200F}]+"
digest("T19_strip_emoji", f"regexp_replace(replace(text, '. ', ' 😀🚀 '), '{EMOJI}', '', 'g')", lambda: t.strip_emoji(F.replace("text", F.lit(". "), F.lit(" 😀🚀 "))))


@query("T17_sanitise_description", f"""SELECT doc_id, {_truncated('s', 200)} AS description FROM (SELECT doc_id, {strip(f"regexp_replace(regexp_replace(array_to_string(list_filter(list_transform({SENTENCES}, lambda x: {strip('x')}), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)sex|nude|erotic')), ' '), '{EMOJI}', '', 'g'), '{S}+', ' ', 'g')")} AS s FROM documents)""")
def _(spark, d):
    return docs(spark, d).select("doc_id", t.sanitise_description("text").alias("description"))


digest("T20_latin_punctuation", "translate(replace(text, '.', '。'), '。，、；：！？「」『』《》（）', '.,,;:!?\"\"\"\"\"\"()')", lambda: t.latin_punctuation(F.replace("text", F.lit("."), F.lit("。"))))
digest("T21_head_tail", f"CASE WHEN length({strip('text')}) <= 500 THEN {strip('text')} ELSE substr({strip('text')}, 1, 250) || ' (cut) ' || right({strip('text')}, 250) END", lambda: t.head_tail("text", 500, " (cut) "))
digest("T22_sentence_excerpt", f"""CASE WHEN greatest({', '.join(_last('substr(text, 1, 300)', m) for m in '.!?')}) > 210 THEN substr(substr(text, 1, 300), 1, greatest({', '.join(_last('substr(text, 1, 300)', m) for m in '.!?')}) + 1) ELSE substr(text, 1, 300) END""", lambda: t.sentence_excerpt("text", 300))


@query("T23_contexts", f"""WITH hits AS (SELECT doc_id, text, greatest(0, strpos(text, w) - 31) AS s, least(length(text), strpos(text, w) - 1 + length(w) + 30) AS e
  FROM (SELECT doc_id, text, unnest(list_distinct(regexp_extract_all(text, '[^{SPACE}]+'))) AS w FROM documents) WHERE length(w) >= 14),
marked AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM hits),
spans AS (SELECT doc_id, any_value(text) AS text, min(s) AS s, max(e) AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM marked) GROUP BY doc_id, g)
SELECT doc_id, string_agg(substr(text, s + 1, e - s), chr(10) || '…' || chr(10) ORDER BY s) AS context FROM spans GROUP BY doc_id""")
def _(spark, d):
    terms = F.filter(F.array_distinct(t.words("text")), lambda w: F.length(w) >= 14)
    return docs(spark, d).select("doc_id", t.contexts("text", terms, 30).alias("context")).filter("context <> ''")


@query("T24_masked_context", f"""SELECT doc_id, CASE WHEN strpos(text, term) > 0 AND term <> '' THEN substr(text, greatest(1, strpos(text, term) - 80), strpos(text, term) - greatest(1, strpos(text, term) - 80)) || '<mask>' || substr(text, strpos(text, term) + length(term), 80) END AS masked
FROM (SELECT doc_id, text, coalesce(regexp_extract_all(text, '[^{SPACE}]+')[9], '') AS term FROM documents)""")
def _(spark, d):
    rows = docs(spark, d).withColumn("term", F.nullif(F.coalesce(F.get(t.words(F.col("text")), F.lit(8)), F.lit("")), F.lit("")))
    return rows.select("doc_id", t.masked_context("text", "term").alias("masked"))


@query("T26_marked_response", f"""SELECT doc_id, {strip('substr(text, 1, length(text) // 2)')} AS summary, {strip('substr(text, length(text) // 2 + 1)')} AS highlight, '' AS next_preview FROM documents""")
def _(spark, d):
    answer = F.concat(F.lit("noise\n=== SUMMARY ===\n"), F.expr("substr(text, 1, length(text) div 2)"), F.lit("\n===HIGHLIGHT===\n"), F.expr("substr(text, length(text) div 2 + 1)"))
    rows = docs(spark, d).withColumn("a", answer)
    return rows.select("doc_id", *[r.marked("a", k.upper()).alias(k) for k in ("summary", "highlight", "next_preview")])


LINE = f"{strip(f'regexp_replace(text, {chr(39)}[{SPACE}]+{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')}"


@query("T27_faq", f"""SELECT doc_id, pos::INT AS pos, CASE pos WHEN 0 THEN 'why ' || l || '?' ELSE 'w?' END AS q, CASE pos WHEN 0 THEN 'y ' || l ELSE 'v' END AS a FROM (SELECT doc_id, {LINE} AS l FROM documents), (SELECT unnest([0, 1]) AS pos)""")
def _(spark, d):
    line = t.strip(t.sub(F.col("text"), f"[{t.SPACE}]+", " "))
    rows = docs(spark, d).withColumn("l", line)
    # the line goes on below the answer, or beside it where it would be read as a question or an answer of its own
    gap = F.when(F.col("l").rlike(rf"(?i)\A[QA][{t.SPACE}]*[:.]"), " ").otherwise("\n")
    answer = F.concat(F.lit("Q: why "), "l", F.lit("?\nA: y"), gap, "l", F.lit("\n\nQ. w?\nA. v\nQ: open"))
    return rows.select("doc_id", F.posexplode(r.faq(answer)).alias("pos", "x")).select("doc_id", "pos", "x.q", "x.a")


@query("T28_split_plan", """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN (doc_id % 9 + 1) || ',' || (doc_id % 9 + 3) END AS cuts, CASE WHEN doc_id % 4 = 0 THEN 'a|b|c' END AS titles FROM documents""")
def _(spark, d):
    k = F.col("doc_id")
    a, b = (k % 9 + 1).cast("string"), (k % 9 + 3).cast("string")
    good = F.concat(F.lit('ok ```json\n{"splits":['), a, F.lit(","), b, F.lit('],"titles":["a "," b","c"]}\n```'))
    bad = F.when(k % 4 == 1, F.concat(F.lit('{"splits":['), b, F.lit(","), a, F.lit('],"titles":["a","b","c"]}'))).when(
        k % 4 == 2, F.lit('{"splits":[1],"titles":["a","b","c"]}')).otherwise(F.lit("no json"))
    plan = r.split_plan(F.when(k % 4 == 0, good).otherwise(bad), F.lit(20), F.lit(3))
    rows = docs(spark, d).select("doc_id", plan.alias("p"))
    return rows.select("doc_id", F.array_join(F.col("p.splits").cast("array<string>"), ",").alias("cuts"), F.array_join("p.titles", "|").alias("titles"))


@query("T29_scene_script", f"""SELECT doc_id, 'thap-nien' AS era, 'An' AS name, scene::INT AS scene, CASE scene WHEN 1 THEN l ELSE 'two' END AS text, CASE scene WHEN 1 THEN 'fear' ELSE 'neutral' END AS emotion, CASE scene WHEN 1 THEN 'runs' ELSE '' END AS action, CASE scene WHEN 1 THEN 'hall' ELSE '' END AS setting
FROM (SELECT doc_id, 'x ' || replace(replace({LINE}, ':', ''), '=', '') AS l FROM documents), (SELECT unnest([1, 2]) AS scene)""")
def _(spark, d):
    line = t.strip(t.sub(F.col("text"), f"[{t.SPACE}]+", " "))
    line = F.concat(F.lit("x "), F.replace(F.replace(line, F.lit(":"), F.lit("")), F.lit("="), F.lit("")))
    script = F.concat(
        F.lit("===CHARACTER===\nNAME: An\nERA: retro-90\nDECADE: 1990S\nAPPEARANCE: tall\n  more\n===HOOK_STORY===\nstory.\n===SCENES===\nSCENE 1\nTEXT: "),
        line, F.lit("\nEMOTION: Fear\nACTION: runs\nSETTING: hall\nSCENE 2\nTEXT: two\nSCENE 3\nACTION: none"))
    rows = docs(spark, d).select("doc_id", r.scene_script(script).alias("s"))
    rows = rows.select("doc_id", "s.character.era", "s.character.name", F.explode("s.scenes").alias("x"))
    return rows.select("doc_id", "era", "name", "x.scene", "x.text", "x.emotion", "x.action", "x.setting")


@query("T30_bracketed_prompts", f"""SELECT doc_id, nullif(regexp_replace(regexp_replace(l, '^[()]+', ''), '[()]+$', ''), '') AS modern, 'b' AS retro, NULL AS old FROM (SELECT doc_id, {LINE} AS l FROM documents)""")
def _(spark, d):
    line = t.strip(t.sub(F.col("text"), f"[{t.SPACE}]+", " "))
    answer = F.concat(F.lit("[HIEN_DAI]\n("), line, F.lit(")\n[THAP_NIEN] \nb\n"))
    rows = docs(spark, d).withColumn("a", answer)
    return rows.select("doc_id", r.bracketed("a", "HIEN_DAI").alias("modern"), r.bracketed("a", "THAP_NIEN").alias("retro"), r.bracketed("a", "CO_TRANG").alias("old"))


HOOK = f"""(SELECT doc_id, l, '>>' || regexp_replace(l || ' tail', '[. ]+$', '') AS h, '>>' || l || ' tail' AS raw FROM (SELECT doc_id, replace({LINE}, '|', '') AS l FROM documents))"""


@query("T31_title_line", f"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN l ELSE (CASE doc_id % 3 WHEN 1 THEN '1. ' ELSE '# ' END) ||
  CASE WHEN length(raw || ' | Brand') <= 58 THEN raw WHEN length(h) <= 48 THEN h WHEN {_last('substr(h, 1, 48)', ' ')} > 2 THEN regexp_replace(substr(h, 1, {_last('substr(h, 1, 48)', ' ')}), '[.,;:!? ]+$', '') || '...'
  ELSE {_rstrip('substr(h, 1, 48)')} || '...' END || ' | Brand' END AS title FROM {HOOK}""")
def _(spark, d):
    line = F.replace(t.strip(t.sub(F.col("text"), f"[{t.SPACE}]+", " ")), F.lit("|"), F.lit(""))
    k = F.col("doc_id") % 3
    headline = F.concat(F.when(k == 1, "1. ").otherwise("# "), F.lit(">>"), "l", F.lit(" tail | Work | Brand"))
    rows = docs(spark, d).withColumn("l", line).withColumn("raw", F.when(k == 0, F.col("l")).otherwise(headline))
    return rows.select("doc_id", t.title_line("raw", ">>", " | Brand", 58).alias("title"))


@query("T32_wrap_title", f"""SELECT doc_id, CASE WHEN length(l) <= 28 THEN l WHEN strpos(l, '...') > 0 THEN {strip("substr(l, 1, strpos(l, '...') - 1)")} || '...' || chr(10) || {strip("substr(l, strpos(l, '...') + 3)")}
 WHEN best > 1 THEN substr(l, 1, best - 1) || chr(10) || substr(l, best + 1) ELSE l END AS wrapped
FROM (SELECT doc_id, l, list_min(list_transform(list_filter(range(1, length(l) + 1), lambda i: substr(l, i, 1) = ' '), lambda i: abs(i - 1 - length(l) // 2) * 1000000 + i)) % 1000000 AS best FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN replace({LINE}, ' ', '... ') WHEN 1 THEN substr({LINE}, 1, 20) ELSE {LINE} END AS l FROM documents))""")
def _(spark, d):
    line = t.strip(t.sub(F.col("text"), f"[{t.SPACE}]+", " "))
    k = F.col("doc_id") % 5
    line = F.when(k == 0, F.replace(line, F.lit(" "), F.lit("... "))).when(k == 1, F.substring(line, 1, 20)).otherwise(line)
    return docs(spark, d).withColumn("l", line).select("doc_id", t.wrap_title("l").alias("wrapped"))


def _case(rule_list, x):
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({x}, '{k}')" for k in ks) + f" THEN '{label}'" for ks, label in rule_list) + " ELSE '' END"


# the sample texts are not Vietnamese: a rule list over their own syllables classifies them as well
SYLLABLES = ((("tion", "ation"), "latin"), (("sch", "ung"), "german"), (("th", "wh"), "english"), (("eau",), "french"))


@query("T33_first_label", f"SELECT doc_id, {_case(rules.SETTINGS, 'lower(text)')} AS setting, {_case(rules.EMOTIONS, 'lower(text)')} AS emotion, {_case(SYLLABLES, 'lower(text)')} AS label FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", t.first_label("text", rules.SETTINGS).alias("setting"), t.first_label("text", rules.EMOTIONS).alias("emotion"), t.first_label("text", SYLLABLES).alias("label"))


CUES = "(" + " OR ".join(f"contains(lower(x), '{w}')" for w in rules.VISUAL_CUES) + ")"
LONG = f"list_filter(list_transform(string_split(replace(text, chr(13), chr(10)), chr(10)), lambda x: {strip('x')}), lambda x: length(x) > 40)"


@query("T34_visual_sentence", f"SELECT doc_id, substr(coalesce(list_filter({LONG}, lambda x: {CUES})[1], ({LONG})[1], text), 1, 250) AS sentence FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", t.visual_sentence("text").alias("sentence"))


GENRE_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in rules.GENRES.items()) + "}"
ERA_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in rules.ERAS.items()) + "}"


@query("T35_map_genres", on_v(f"""SELECT work_id, coalesce(string_agg(slug, ',' ORDER BY i) FILTER (fresh), 'ngon-tinh') AS genres, coalesce(string_agg(trim(name), ',' ORDER BY i) FILTER (NOT fresh), '') AS tags FROM (
SELECT work_id, i, name, slug, coalesce(slug IS NOT NULL AND row_number() OVER (PARTITION BY work_id, slug ORDER BY i) = 1, false) AS fresh FROM (SELECT work_id, i, names[i] AS name, {GENRE_MAP}[lower(trim(names[i]))] AS slug FROM (
SELECT work_id, names, unnest(range(1, len(names) + 1)) AS i FROM (SELECT work_id, CASE WHEN genres = '' THEN [''] ELSE string_split(genres, ',') END AS names FROM works_v)))) GROUP BY work_id"""))
def _(spark, d):
    w = works_v(spark, d).withColumn("m", g.map_genres(F.split("genres", ",")))
    return w.select("work_id", "m.genres", "m.tags")


@query("T36_era", on_v(f"""SELECT work_id, slugs, coalesce(list_filter(list_transform(string_split(slugs, ','), lambda x: {ERA_MAP}[trim(x)]), lambda x: x IS NOT NULL)[1], 'co-trang') AS era,
CASE WHEN {ERA_MAP}[string_split(slugs, ',')[1]] IS NOT NULL AND stored <> 'thap-nien' THEN {ERA_MAP}[string_split(slugs, ',')[1]] ELSE coalesce(nullif(stored, ''), {ERA_MAP}[string_split(slugs, ',')[1]], 'co-trang') END AS chosen
FROM (SELECT work_id, CASE length(title) % 4 WHEN 0 THEN 'zz,do-thi' WHEN 1 THEN 'tien-hiep' WHEN 2 THEN '' ELSE 'dam-my,co-trang' END AS slugs, CASE status WHEN 'ongoing' THEN 'thap-nien' WHEN 'completed' THEN 'hien-dai' ELSE '' END AS stored FROM works_v)"""))
def _(spark, d):
    n = F.length("title") % 4
    slugs = F.when(n == 0, "zz,do-thi").when(n == 1, "tien-hiep").when(n == 2, "").otherwise("dam-my,co-trang")
    stored = F.when(F.col("status") == "ongoing", "thap-nien").when(F.col("status") == "completed", "hien-dai").otherwise("")
    w = works_v(spark, d).select("work_id", slugs.alias("slugs"), stored.alias("stored"))
    return w.select("work_id", "slugs", g.first_era("slugs").alias("era"), g.chosen_era("slugs", "stored").alias("chosen"))


@query("J12_genre_rows", on_v(f"""SELECT work_id, trim(name) AS name, {GENRE_MAP}[lower(trim(name))] AS genre FROM (SELECT work_id, unnest(string_split(genres, ',')) AS name FROM works_v) WHERE {GENRE_MAP}[lower(trim(name))] IS NOT NULL"""))
def _(spark, d):
    # the rule table is a fixed list of a few dozen rows
    rows = spark.createDataFrame(list(rules.GENRES.items()), "raw string, genre string")
    names = works_v(spark, d).select("work_id", F.explode(F.split("genres", ",")).alias("name"))
    names = names.select("work_id", F.trim("name").alias("name"), F.lower(F.trim("name")).alias("raw"))
    return names.join(F.broadcast(rows), "raw").select("work_id", "name", "genre")


@query("T37_urls", r"""SELECT page_id, regexp_replace(url, '/+$', '') AS trimmed, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '') AS host, regexp_replace(url, '^(https?://)[^/]+', '\1new.example') AS moved,
CASE WHEN starts_with(p, 'fr/') THEN substr(p, 4) ELSE string_split(p, '/825')[1] END AS slug FROM (SELECT *, regexp_replace(regexp_replace(regexp_extract(regexp_replace(url, '/+$', ''), '^[a-z]+://[^/?#]*([^?#]*)', 1), '^/+', ''), '/+$', '') AS p FROM pages)""")
def _(spark, d):
    return table(spark, d, "pages").select(
        "page_id", urls.trimmed("url").alias("trimmed"), urls.host("url").alias("host"), urls.with_host("url", "new.example").alias("moved"),
        urls.work_slug("url", "fr/", "/825").alias("slug"))


digest("T39_speech_text", f"""CASE WHEN b <> '' THEN 'T' || doc_id || '.' || chr(10) || chr(10) || b ELSE 'T' || doc_id END) AS digest FROM (SELECT doc_id, {strip(f"array_to_string(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(replace(text, '. ', {chr(39)}.{chr(34)}{chr(39)} || chr(10) || chr(10)), '{chr(34)}{S}*\n{S}*\n{S}*', '{chr(34)}', 'g'), '\n{S}*\n{S}*{chr(34)}', '{chr(34)}', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)), lambda x: {strip('x')}), chr(10))")} AS b FROM documents) --""", lambda: t.speech_text(F.concat(F.lit("T"), "doc_id"), F.replace("text", F.lit(". "), F.lit('."\n\n'))))


@query("T40_seed", "SELECT doc_id, ('0x' || substr(md5(text), 1, 8))::BIGINT % 2147483648 AS seed FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", t.seed31("text").alias("seed"))


WORDS = {"the": ["le", "la"], "of": ["du"], "une": ["un"], "der": ["die", "das"], "por": ["para"]}
digest("T41_substitute_seeded", None, lambda: t.substitute_seeded("text", "doc_id", WORDS))


@query("T43_picked_title", f"""SELECT doc_id, CASE WHEN {wc('l')} <= 15 THEN regexp_replace(l, '\\.+$', '') ELSE 'spare' END AS title FROM (SELECT doc_id, {strip("regexp_replace(l, '^x+', '')")} AS l FROM (SELECT doc_id, 'T ' || replace(replace({LINE}, '*', ''), '"', '') AS l FROM documents))""")
def _(spark, d):
    line = t.strip(t.sub(F.col("text"), f"[{t.SPACE}]+", " "))
    answer = F.concat(F.lit('\n"**Title: T '), F.replace(F.replace(line, F.lit("*"), F.lit("")), F.lit('"'), F.lit("")), F.lit('**"\nspare'))
    return docs(spark, d).select("doc_id", r.picked_title(answer).alias("title"))


@query("T44_section_lines", f"""SELECT doc_id, {strip("'one ' || l")} AS first, 2 AS n FROM (SELECT doc_id, replace({LINE}, '|', '') AS l FROM documents)""")
def _(spark, d):
    line = F.replace(t.strip(t.sub(F.col("text"), f"[{t.SPACE}]+", " ")), F.lit("|"), F.lit(""))
    text = F.concat(F.lit("=== OTHER ===\nx\n=== TITLES ===\n\nPre one "), line, F.lit(" | Brand\ntwo\n=== END ===\nthree"))
    rows = docs(spark, d).withColumn("s", r.section_lines(text, "TITLES", r"Pre\s+", r"\s*\| Brand"))
    return rows.select("doc_id", F.get("s", F.lit(0)).alias("first"), F.size("s").alias("n"))


@query("T45_without_section", f"""SELECT doc_id, {strip("'head ' || l || chr(10) || '=== KEEP === z'")} AS kept FROM (SELECT doc_id, replace({LINE}, '=', '') AS l FROM documents)""")
def _(spark, d):
    line = F.replace(t.strip(t.sub(F.col("text"), f"[{t.SPACE}]+", " ")), F.lit("="), F.lit(""))
    text = F.concat(F.lit("head "), line, F.lit("\n=== thumbnail ===\ndrop "), line, F.lit("=== KEEP === z"))
    return docs(spark, d).select("doc_id", r.without_section(text, "THUMBNAIL").alias("kept"))
