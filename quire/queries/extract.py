"""Extraction queries over the raw pages and over pages extended from them."""

from pyspark.sql import functions as F

from quire.functions import html as h
from quire.operators import extract as ex
from quire.operators import sites
from quire.queries.sql import SPACE, strip
from quire.registry import query, table

NOISELESS = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g'), '(?is)<iframe\b[^>]*>.*?</iframe\s*>', '', 'g'), '(?is)<button\b[^>]*>.*?</button\s*>', '', 'g'), '(?is)<ins\b[^>]*>.*?</ins\s*>', '', 'g')"


def unescape(x):
    pairs = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", "\xa0"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
    for a, b in pairs:
        x = f"replace({x}, '{a}', '{b}')"
    return x


def text(x):
    return strip(unescape(strip(f"regexp_replace({x}, '[{SPACE}]*<[^>]+>[{SPACE}]*', '', 'g')")))


PARAS = f"list_transform(regexp_extract_all({NOISELESS}, '(?is)<p(?:\\s[^>]*)?>(.*?)</p\\s*>', 1), lambda b: " + strip(f"regexp_replace({text('b')}, '^\\d+[.)]?\\s*$', '')") + ")"


def pages(spark, d):
    return table(spark, d, "pages").select("page_id", "url", "html")


@query("H8_section_text", f"""SELECT page_id, md5(CASE WHEN len(ps) > 0 THEN array_to_string(ps, chr(10) || chr(10)) ELSE array_to_string(ls, chr(10) || chr(10)) END) AS digest FROM (
SELECT page_id, list_filter({PARAS}, lambda x: length(x) > 0) AS ps, list_filter(list_transform(string_split({unescape(f"regexp_replace({NOISELESS}, '<[^>]+>', chr(10), 'g')")}, chr(10)), lambda x: {strip('x')}), lambda x: x <> '') AS ls FROM pages)""")
def _(spark, d):
    return ex.section_texts(pages(spark, d)).select("page_id", F.md5("content").alias("digest"))


@query("H9_filtered_paragraphs", f"SELECT page_id, len(ps) AS n, md5(array_to_string(ps, '|')) AS digest FROM (SELECT page_id, list_filter({PARAS}, lambda x: length(x) > 80 AND NOT regexp_matches(x, 'https?://')) AS ps FROM pages)")
def _(spark, d):
    out = pages(spark, d).withColumn("ps", h.paragraph_texts("html", min_length=80, no_urls=True))
    return out.select("page_id", F.size("ps").alias("n"), F.md5(F.array_join("ps", "|")).alias("digest"))


@query("H1_work_info", rf"""SELECT page_id, title, 'Đang cập nhật' AS author, CASE WHEN regexp_matches(lower({text(NOISELESS)}), 'đang\s*(ra|cập\s*nhật)|ongoing|updating') THEN 'ongoing' ELSE 'completed' END AS status, len(g) AS genres FROM (
SELECT *, coalesce(CASE WHEN length(h1) BETWEEN 3 AND 199 THEN h1 END, nullif({strip("string_split(t, '|')[1]")}, '')) AS title FROM (SELECT *, {text(r"regexp_extract(html, '(?is)<h1(?:\s[^>]*)?>(.*?)</h1\s*>', 1)")} AS h1, {text(r"regexp_extract(html, '(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>', 1)")} AS t,
list_filter(regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"', 1), lambda x: regexp_matches(x, '/category/|/the-loai/')) AS g FROM pages)) WHERE title IS NOT NULL""")
def _(spark, d):
    info = ex.work_info(pages(spark, d))
    return info.select("page_id", "title", "author", "status", F.size("genres_raw").alias("genres"))


HEAD = """'<meta property="og:title" content="' || page_id || ' page - Site"><meta content="about ' || page_id || '" name="description"><meta property="og:image" content="/img/' || page_id || '.jpg">'"""


def _with_head(spark, d, *parts):
    return pages(spark, d).withColumn("html", F.replace("html", F.lit("<head>"), F.concat(F.lit("<head>"), *parts)))


@query("H2_meta_info", "SELECT page_id, page_id || ' page' AS title, 'about ' || page_id AS description, '/img/' || page_id || '.jpg' AS cover_image FROM pages WHERE html LIKE '%<head>%'")
def _(spark, d):
    k = F.col("page_id").cast("string")
    p = _with_head(
        spark, d, F.lit('<meta property="og:title" content="'), k, F.lit(' page - Site"><meta content="about '), k,
        F.lit('" name="description"><meta property="og:image" content="/img/'), k, F.lit('.jpg">'))
    return ex.meta_info(p.filter(F.col("html").contains("<head>"))).drop("url")


@query("H3_json_ld", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN NULL ELSE 'told ' || page_id END AS description FROM pages WHERE html LIKE '%<head>%'")
def _(spark, d):
    k = F.col("page_id")
    script = F.when(k % 3 == 0, F.lit('<script type="application/ld+json">{"name":"x"}</script>')).otherwise(
        F.concat(F.lit('<script type="application/ld+json">{"name":"x"}</script><script type="application/ld+json">\n{"description":"told '), k.cast("string"), F.lit('"}</script>')))
    p = _with_head(spark, d, script).filter(F.col("html").contains("<head>"))
    return p.select("page_id", h.json_ld("html", "$.description").alias("description"))


# the field at the top, in a list, in a graph, in the main entity, behind a broken script, and not at all
@query("H3_moved_fields", "SELECT page_id, CASE page_id % 6 WHEN 5 THEN NULL ELSE 'told \"' || page_id || '\"' END AS description FROM pages WHERE html LIKE '%<head>%'")
def _(spark, d):
    k = F.col("page_id").cast("string")
    told = F.concat(F.lit('{"@type":"Book","description":"told \\"'), k, F.lit('\\""}'))
    shapes = [told, F.concat(F.lit('[{"name":"x","description":""},'), told, F.lit("]")), F.concat(F.lit('{"@graph":[{"name":"x"},'), told, F.lit("]}")), F.concat(F.lit('{"name":7,"mainEntity":'), told, F.lit("}")),
              F.concat(F.lit('{"description": broken</script><script type="application/ld+json">'), told), F.lit('{"name":"x","@graph":[1,null]}')]
    script = F.concat(F.lit('<script type="application/ld+json">'), F.element_at(F.array(*shapes), (F.col("page_id") % 6 + 1).cast("int")), F.lit("</script>"))
    p = _with_head(spark, d, script).filter(F.col("html").contains("<head>"))
    return p.select("page_id", h.json_ld("html", "$.description").alias("description"))


@query("H4_embedded_data", "SELECT page_id, pos::INT AS pos, 'https://b.example/book/77_book/' || (page_id * 10 + pos) || '_part-' || (pos + 1) || '-x' AS section_url, 'one' || chr(10) || chr(10) || 'two & ' || repeat('z', 60) AS content FROM pages, (SELECT unnest([0, 1]) AS pos) WHERE html LIKE '%<head>%'")
def _(spark, d):
    k = F.col("page_id") * 10
    data = F.concat(
        F.lit('<script id="__NEXT_DATA__" type="application/json">{"a":[{"chapterId":"'), k.cast("string"), F.lit('","x":1,"chapterName":"Part 1: X!"},{"chapterId":"'),
        (k + 1).cast("string"), F.lit('","chapterName":"Part 2 - x"}],"content":"<p>one<\\/p>\\n<p>two &amp; '), F.lit("z" * 60), F.lit('</p>"}</script>'))
    p = _with_head(spark, d, data).filter(F.col("html").contains("<head>"))
    out = p.select("page_id", F.posexplode(h.next_data_sections("html", "https://b.example", F.lit("77"))).alias("pos", "section_url"), h.next_data_text("html").alias("content"))
    return out


@query("H5_section_links", f"""SELECT page_id, pos::INT AS pos, links[pos + 1] AS section_url FROM (SELECT page_id, links, unnest(range(len(links))) AS pos FROM (
SELECT page_id, (SELECT list(l ORDER BY i) FROM (SELECT l, min(i) AS i FROM (SELECT unnest(ls) AS l, unnest(range(len(ls))) AS i) GROUP BY l)) AS links FROM (
SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?is)<a\\s[^>]*?href="([^"]*)"', 1), lambda x: 'https://s.example' || {strip(unescape('x'))}), lambda x: regexp_matches(x, 'example/[a-zA-Z]')) AS ls FROM pages)))""")
def _(spark, d):
    return ex.section_links(pages(spark, d), "^/[a-zA-Z]", "https://s.example").select("page_id", "pos", "section_url")


@query("H6_listing_cards", f"""SELECT page_id, min_by(title, i) AS card_title, 'https://s.example' || url AS card_url FROM (SELECT page_id, i, {strip(unescape("regexp_extract(c, '(?is)href=\"([^\"]*)\"', 1)"))} AS url, {text('c')} AS title FROM (
SELECT page_id, unnest(cs) AS c, unnest(range(len(cs))) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\\s[^>]*?href="[^"]*"[^>]*>.*?</a\\s*>') AS cs FROM pages))) WHERE url <> '' AND title <> '' GROUP BY page_id, url""")
def _(spark, d):
    return ex.listing_cards(pages(spark, d), "", "https://s.example").select("page_id", "card_title", "card_url")


@query("H7_generated_links", "SELECT page_id, n::INT AS number, regexp_extract(url, '^(https?://[^/]+)', 1) || '/real-' || page_id || '/chuong-' || n AS section_url FROM (SELECT *, unnest(range(1, page_id % 6 + 3)) AS n FROM pages WHERE html LIKE '%<head>%')")
def _(spark, d):
    k = F.col("page_id")
    extra = F.concat(
        F.lit('<link href="https://r.example/real-'), k.cast("string"), F.lit('/chuong-1" rel="canonical"><select><option value="1">1</option><option value="'),
        (k % 6 + 2).cast("string"), F.lit('" selected>last</option><option value="all">all</option></select>'))
    p = _with_head(spark, d, extra).filter(F.col("html").contains("<head>"))
    return ex.generated_links(p).select("page_id", "number", "section_url")


@query("H10_region", f"""SELECT page_id, md5(array_to_string(list_filter(list_transform(regexp_extract_all(body, '(?is)<p(?:\\s[^>]*)?>(.*?)</p\\s*>', 1), lambda b: regexp_replace({text('b')}, '\\s{{2,}}', ' ', 'g')), lambda x: length(x) > 1), chr(10) || chr(10))) AS digest
FROM (SELECT page_id, regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1) AS body FROM pages)""")
def _(spark, d):
    return ex.region_texts(pages(spark, d), "<article>", "</article>").select("page_id", F.md5("content").alias("digest"))


# every second article holds another one, with a paragraph before and one behind
@query("H10_nested_region", f"""SELECT page_id, md5(array_to_string(list_filter(list_concat(CASE WHEN page_id % 2 = 0 THEN ['within ' || page_id, 'behind it'] ELSE [] END,
  list_transform(regexp_extract_all(body, '(?is)<p(?:\\s[^>]*)?>(.*?)</p\\s*>', 1), lambda b: regexp_replace({text('b')}, '\\s{{2,}}', ' ', 'g'))), lambda x: length(x) > 1), chr(10) || chr(10))) AS digest
FROM (SELECT page_id, regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1) AS body FROM pages)""")
def _(spark, d):
    within = F.concat(F.lit("<article><ARTICLE class='x'><p>within "), F.col("page_id").cast("string"), F.lit("</p></article ><p>behind it</p>"))
    html = F.when(F.col("page_id") % 2 == 0, F.replace("html", F.lit("<article>"), within)).otherwise(F.col("html"))
    return ex.region_texts(pages(spark, d).withColumn("html", html), "<article>", "</article>").select("page_id", F.md5("content").alias("digest"))


# Pages of four sites: the url, the marks and the elements nested in lists, containers and ads come from the key, the paragraphs from the page itself.
KIND = "['plain', 'reader', 'newest_first', 'episodes'][page_id % 4 + 1]"
P_BLOCKS = "(?is)<p(?:\\s[^>]*)?>.*?</p\\s*>"
SITE_TEXT = f"""list_transform(regexp_extract_all({NOISELESS}, '(?is)<p(?:\\s[^>]*)?>(.*?)</p\\s*>', 1), lambda b: {text('b')})"""


def _site_pages(spark, d):
    k, n = F.col("page_id").cast("string"), F.col("page_id") % 4
    kind = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (n + 1).cast("int"))
    body = F.array_join(F.regexp_extract_all(h.without("html"), F.lit("(?is)<p(?:\\s[^>]*)?>.*?</p\\s*>"), F.lit(0)), "\n")
    link = lambda i: F.concat(F.lit('<a href="/w-'), k, F.lit(f'/chuong-{i}">{i}</a>'))
    links = F.when(n == 2, F.concat(link(3), link(2), link(1))).otherwise(F.concat(link(1), link(2), link(1), link(3), F.lit('<a href="/the-loai/x">Love</a>')))
    page = F.concat(
        kind('<h3 class="title">', '<h1 class="truyen-title">', '<h3 class="big title">', "<h1>x</h1><h2>"), F.lit("Work "), k, kind("</h3>", "</h1>", "</h3>", "</h2>"),
        F.lit('<div class="info"><div><a href="/tac-gia/a">An '), k, F.lit("</a></div><span>"), F.when(F.col("page_id") % 3 == 0, "Đang ra").otherwise("Full"), F.lit("</span></div>"),
        kind('<div class="desc-text">', '<div class="description">', '<div class="desc-text">', '<div class="summary">'), F.lit("<div> </div>About "), k, F.lit("</div>"),
        kind('<div class="book">', '<div class="book-cover">', '<div class="thumb">', '<div class="book-cover">'), F.lit('<div>cover</div><img src="/c/'), k, F.lit('.jpg"></div>'),
        kind('<ul class="list-chapter">', '<div class="chapter-list">', '<ul class="list-chapter">', '<section><div class="episode-title">'), kind("<ul></ul>", "<div>all</div>", "<ul></ul>", "</div><section></section><div>"), links, kind("</ul>", "</div>", "</ul>", "</div></section>"),
        kind('<div id="chapter-c">', '<div class="chapter-content">', '<div id="chapter-content">', '<div class="content-container">'),
        F.when(n <= 1, '<div class="ads"><div><div>ad</div></div><p>buy this now</p></div>').otherwise(""), F.lit("<div><p><em>note to the reader</em></p></div>"),
        F.when(F.col("page_id") % 5 == 0, F.concat(F.lit('<div class="part"><div>'), body, F.lit("</div></div>"))).otherwise(body), F.lit("</div><p>outside of it all</p>"),
    )
    rows = table(spark, d, "pages").select("page_id", F.concat(F.lit("https://www.site"), n.cast("string"), F.lit(".example/w-"), k).alias("url"), page.alias("html"))
    domains = spark.createDataFrame([(f"site{i}.example", s, i) for i, s in enumerate(sites.SITES)], "domain string, source string, reg_order int")
    return sites.with_source(rows, domains)


@query("H1_info_by_site", f"""SELECT page_id, {KIND} AS source, 'Work ' || page_id AS title, 'An ' || page_id AS author, CASE WHEN page_id % 4 = 0 OR length('About ' || page_id) >= 11 THEN 'About ' || page_id ELSE '' END AS description,
'/c/' || page_id || '.jpg' AS cover_image, CASE WHEN page_id % 3 = 0 AND page_id % 4 <> 3 THEN 'ongoing' ELSE 'completed' END AS status, CASE WHEN page_id % 4 = 2 THEN '' ELSE 'love' END AS genres FROM pages""")
def _(spark, d):
    info = sites.work_info(_site_pages(spark, d))
    return info.select("page_id", "source", "title", "author", "description", "cover_image", "status", F.array_join("genres_raw", ",").alias("genres"))


@query("H5_links_by_site", """SELECT page_id, pos::INT AS pos, '/w-' || page_id || '/chuong-' || (pos + 1) AS section_url, (pos + 1)::INT AS number FROM pages, (SELECT unnest([0, 1, 2]) AS pos)
UNION ALL SELECT page_id, 3, '/the-loai/x', 4 FROM pages WHERE page_id % 4 IN (0, 3)""")
def _(spark, d):
    return sites.section_links(_site_pages(spark, d)).select("page_id", "pos", "section_url", "number")


@query("H8_text_by_site", f"""SELECT page_id, md5(array_to_string(CASE page_id % 4
  WHEN 2 THEN list_filter(ps, lambda x: length(x) > 5 AND NOT regexp_matches(x, 'https?://')) WHEN 3 THEN list_filter(ps[2:], lambda x: length(x) > 10 AND NOT regexp_matches(x, 'https?://'))
  ELSE list_filter(list_transform(ps, lambda x: {strip("regexp_replace(x, '^\\d+[.)]?\\s*$', '')")}), lambda x: x <> '') END, chr(10) || chr(10))) AS digest
FROM (SELECT page_id, list_concat(['note to the reader'], {SITE_TEXT}) AS ps FROM pages)""")
def _(spark, d):
    return sites.section_texts(_site_pages(spark, d)).select("page_id", F.md5("content").alias("digest"))
