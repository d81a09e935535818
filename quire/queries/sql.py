"""Shared pieces of the DuckDB counterparts: the derived views and text helpers, written for RE2."""

SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def wc(c: str) -> str:
    return f"len(regexp_extract_all({c}, '[^{SPACE}]+'))"


def strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^[{SPACE}]+', ''), '[{SPACE}]+$', '')"


def blank(c: str) -> str:
    return f"({c} IS NULL OR {c} = '')"


def _works(name: str, base: str) -> str:
    return f"""{name} AS (
  SELECT work_id, work_id AS slug, 'Work ' || work_id AS title,
    CASE w % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Author ' || (w % 7) END AS author,
    CASE w % 4 WHEN 0 THEN NULL WHEN 1 THEN substr(first_text, 1, 60) ELSE substr(first_text, 1, 120) END AS description,
    CASE w % 5 WHEN 0 THEN 'Ngôn tình,Hiện đại,abc' WHEN 1 THEN 'Tiên hiệp,xyz' WHEN 2 THEN '' WHEN 3 THEN 'Romance, Urban' ELSE 'Ngược' END AS genres,
    '' AS tags, CASE w % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'ongoing' ELSE '' END AS status,
    CASE WHEN w % 6 = 5 THEN 'pending' ELSE 'published' END AS publish_status,
    'https://site' || (w % 3) || '.example/work/' || work_id || '/' AS source_url,
    CASE w % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'review' END AS editorial_review,
    CASE w % 2 WHEN 0 THEN NULL ELSE 'analysis' END AS character_analysis,
    CASE w % 5 WHEN 0 THEN NULL WHEN 1 THEN '[]' ELSE '[{{"q":"x","a":"y"}}]' END AS faq,
    '' AS cover_image,
    TIMESTAMP '2024-01-01' + to_hours(w) AS created_at, TIMESTAMP '2024-01-01' + to_hours(w * 2) AS updated_at
  FROM ({base}))"""


def _sections(name: str, base: str) -> str:
    return f"""{name} AS (
  SELECT 's' || sid AS section_id, work_id, number, CASE WHEN r % 4 = 0 THEN 'Phần ' ELSE 'Section ' END || number AS title,
    content, {wc('content')} AS word_count,
    CASE WHEN r % 3 = 0 THEN NULL WHEN r % 7 = 0 THEN '' ELSE substr(content, 1, 40) END AS summary,
    CASE WHEN r % 5 = 0 THEN NULL WHEN r % 11 = 0 THEN '' ELSE substr(content, 1, 30) END AS highlight,
    CASE WHEN r % 2 = 0 THEN NULL WHEN r % 13 = 0 THEN '' ELSE substr(content, 1, 20) END AS next_preview,
    CASE WHEN r % 6 = 0 THEN 'audio/chapter_' || number || '.mp3' END AS audio_url,
    CASE WHEN r % 10 = 9 THEN 'pending' ELSE 'published' END AS publish_status,
    TIMESTAMP '2024-01-01' + to_minutes(r) AS created_at, TIMESTAMP '2024-01-01' + to_minutes(r * 2) AS updated_at
  FROM ({base}))"""


WORKS_V = _works("works_v", "SELECT source AS work_id, min(doc_id) AS w, arg_min(text, doc_id) AS first_text FROM documents GROUP BY source")
SECTIONS_V = _sections("sections_v", "SELECT source AS work_id, doc_id AS r, doc_id::VARCHAR AS sid, text AS content, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS number FROM documents")
WORKS_C = _works("works_c", "SELECT 'c' || conv_id AS work_id, conv_id AS w, arg_min(text, turn) AS first_text FROM conversations GROUP BY conv_id")
SECTIONS_C = _sections("sections_c", "SELECT 'c' || conv_id AS work_id, conv_id * 1000 + turn AS r, conv_id || '_' || turn AS sid, turn + 1 AS number, text AS content FROM conversations")


def with_views(body: str, *views: str, ctes: str = "") -> str:
    return "WITH " + ",\n".join([*views, *([ctes] if ctes else [])]) + "\n" + body


def on_v(body: str, ctes: str = "") -> str:
    return with_views(body, WORKS_V, SECTIONS_V, ctes=ctes)


def on_c(body: str, ctes: str = "") -> str:
    return with_views(body, WORKS_C, SECTIONS_C, ctes=ctes)


_SIGN = "[.?!…]"
_CAPITAL = "[A-ZÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚĂĐĨŨƠƯẠ-Ỹ]"


def reflow(c: str) -> str:
    """Glued dialogue on lines of its own. RE2 can't look behind, so the letter before a quote is matched too, and twice: it may close the match before."""
    nl = "chr(10)"
    glued = rf'([\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}])(["»])[{SPACE}]+({_CAPITAL})'
    steps = [
        (r"\r\n|\r", nl), (r"\n{3,}", f"{nl} || {nl}"), (rf'({_SIGN}["»])[{SPACE}]*([^\n"«{SPACE}])', rf"'\1' || {nl} || '\2'"),
        (rf'([:：])[{SPACE}]*(["«])', rf"'\1' || {nl} || '\2'"), (glued, rf"'\1\2' || {nl} || '\3'"), (glued, rf"'\1\2' || {nl} || '\3'"),
        (r'([.?!…"»])\n([^\n])', rf"'\1' || {nl} || {nl} || '\2'"), (rf'\n[{SPACE}]*(["«»])[{SPACE}]*\n+', rf"{nl} || '\1'"), (r"\n{3,}", f"{nl} || {nl}"),
    ]
    for pattern, to in steps:
        c = f"regexp_replace({c}, '{pattern}', {to}, 'g')"
    return strip(c)


def pieces_of(c: str, sep: str) -> str:
    return f"list_filter(list_transform(string_split({c}, {sep}), lambda x: {strip('x')}), lambda x: x <> '')"


def cascade(name: str, source: str, keys: str, text: str, least: int) -> str:
    """CTEs that end in ``name`` (keys, ps): the paragraphs of a text by blank lines or lines, by those of the reflowed text, or by sentences."""
    told = f"regexp_replace({strip(text)}, '([.!?…])[{SPACE}]+', '\\1' || chr(1), 'g')"
    return f"""{name}_f AS (SELECT {keys}, {wc(text)} AS words, CASE WHEN contains({text}, chr(10) || chr(10)) THEN {pieces_of(text, 'chr(10) || chr(10)')} ELSE {pieces_of(text, 'chr(10)')} END AS plain,
  {reflow(text)} AS flowed, {pieces_of(told, 'chr(1)')} AS told FROM {source}),
{name}_p AS (SELECT *, {pieces_of('flowed', 'chr(10) || chr(10)')} AS gaps, {pieces_of('flowed', 'chr(10)')} AS lns, greatest(3, len(told) // 18) AS step FROM {name}_f),
{name} AS (SELECT {keys}, CASE WHEN len(plain) >= 5 OR words < {least} THEN plain WHEN len(gaps) >= 5 THEN gaps WHEN len(lns) >= 5 THEN lns
  WHEN len(told) >= 10 THEN list_transform(range(0, (len(told) - 1) // step + 1), lambda i: array_to_string(told[i * step + 1 : (i + 1) * step], ' ')) ELSE plain END AS ps FROM {name}_p)"""
