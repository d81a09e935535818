from pyspark.sql import functions as F

from quire.functions import html as h
from quire.operators import extract as ex


def page(spark, html, url="https://h.example/truyen/ten-ht"):
    return spark.createDataFrame([(url, html)], "url string, html string")


def test_paragraphs(spark, value):
    html = '<div id="c"><script>var p="<p>no</p>"</script><p>Một <b>hai</b> &amp; ba</p><ins><p>ad</p></ins><p>12.</p><p> </p><p>Bốn&#7873;&hellip;</p></div>'
    assert value(h.section_text, html) == "Mộthai& ba\n\nBốnề…"
    assert value(h.section_text, "<div>a<br>b<br/> <i>c</i></div>") == "a\n\nb\n\nc"
    assert value(lambda c: h.paragraph_texts(c, min_length=3, no_urls=True, skip="(?i)<em"), "<p>abcd</p><p>abc</p><p>x https://a.b</p><p><em>note</em></p>") == ["abcd"]


def test_blocks_of_a_class(value):
    html = '<p>a</p><div class="w2w_read_more x"><p>more</p></div><p>b</p>'
    assert value(lambda c: h.section_text(h.without_blocks(c, "w2w_read_more")), html) == "a\n\nb"


def test_unescape(value):
    assert value(h.unescape, "&lt;p&gt; &amp;lt; &#x1ec1;&#272; &nope; &quot;") == '<p> &lt; ềĐ &nope; "'


def test_info(spark):
    html = ('<title>Bỏ | Trang</title><meta name="description" content="Mô tả &quot;hay&quot;"><meta content="/i.jpg" property="og:image">'
            '<h1>Tên <i>Truyện</i></h1><a href="/tac-gia/x">Tác Giả</a><span>Đang ra</span><a href="/the-loai/n">Ngôn Tình</a><a href="/x">z</a>')
    r = ex.work_info(page(spark, html), ex.InfoRules(base="https://h.example")).first()
    assert (r["title"], r["author"], r["description"], r["status"], r["genres_raw"]) == ("TênTruyện", "Tác Giả", 'Mô tả "hay"', "ongoing", ["ngôn tình"])
    assert r["cover_image"] == "https://h.example/i.jpg"
    r = ex.work_info(page(spark, "<title>Trang | Site</title><h1>x</h1>")).first()
    assert (r["title"], r["author"], r["status"]) == ("Trang", "Đang cập nhật", "completed")
    assert ex.work_info(page(spark, "<p>none</p>")).count() == 0
    m = ex.meta_info(page(spark, '<meta property="og:title" content="Tên - Trang"><meta property="og:description" content="d">')).first()
    assert (m["title"], m["description"]) == ("Tên", "d")


def test_embedded_data(value):
    html = ('<script id="__NEXT_DATA__">{"b":[{"chapterId":"11","k":1,"chapterName":"One: Two!"},{"chapterId":"12","chapterName":"***"}],'
            '"content":"<p>' + "dài " * 15 + 'có \\"nháy\\"</p><p>hết &amp; xong</p>"}</script>')
    links = value(lambda c: h.next_data_sections(c, "https://w", F.lit("7")), html)
    assert links == ["https://w/book/7_book/11_one-two", "https://w/book/7_book/12_chapter"]
    assert value(h.next_data_text, html).endswith('có "nháy"\n\nhết & xong')
    assert value(h.next_data_text, '<script id="__NEXT_DATA__">{"content":"short"}</script>') == ""
    assert value(lambda c: h.json_ld(c, "$.description"), '<script type="application/ld+json">{"a":1}</script><script type="application/ld+json">{"description":"D"}</script>') == "D"


def test_links(spark):
    html = '<a href="/c/chuong-3">3</a><a class="x" href="/c/chuong-2">2</a><a href="/other">o</a><a href="/c/chuong-3">again</a>'
    rows = ex.section_links(page(spark, html), "chuong-", "https://s", newest_first=True).orderBy("pos").collect()
    assert [(r["pos"], r["section_url"], r["number"]) for r in rows] == [(0, "https://s/c/chuong-2", 2), (1, "https://s/c/chuong-3", 3)]
    cards = ex.listing_cards(page(spark, '<a href="/a"><img></a><a href="/a"> Tên [Full]</a><a href="/a">khác</a>'), "", "https://s", r"\s*\[Full\]\z").collect()
    assert [(r["card_url"], r["card_title"]) for r in cards] == [("https://s/a", "Tên")]
    made = ex.generated_links(page(spark, '<link rel="canonical" href="https://h.example/that/chuong-1"><option value="2">2</option><option value="10">x</option>')).collect()
    assert len(made) == 10 and made[-1]["section_url"] == "https://h.example/that/chuong-10"


def test_region(spark):
    html = '<div class="nav">x</div><div class="actions">y</div><p>Một  hai</p><p>b</p><p>ba</p><div class="nav">z</div><p>no</p>'
    out = ex.region_texts(page(spark, html), 'class="actions">y</div>', '<div class="nav">').first()
    assert out["content"] == "Một hai\n\nba"


def test_nested_blocks(value):
    cut = lambda page: value(lambda c: h.without_blocks(c, "ads"), page)
    assert cut('<p>a</p><div class="ads"><div>x</div><p>buy now</p></div><p>b</p>') == "<p>a</p><p>b</p>"
    assert cut('<DIV class="ads big"><div><div class="ads">x</div >y</div>z</DIV>kept<div>in</div>') == "kept<div>in</div>"
    assert cut('a<div class="ads"/>b<div class="ads">c<div/>d</div>e') == 'a<div class="ads"/>be'
    assert cut('a<div class="ads">never closed<div>x</div>') == "a"
    assert cut("a</div>b") == "a</div>b" and cut("") == "" and cut('<div class="roads">x</div>') == '<div class="roads">x</div>'
    assert value(h.without, "a<ins>b<ins>c</ins>d</ins>e<button>f</button><!-- <ins> -->g") == "aeg"
    many = '<div class="ads"><div>' * 300 + "</div></div>" * 300
    assert cut(f"a{many}b" * 3) == "abab" + "ab"


def test_nested_regions(value):
    text = lambda page: value(lambda c: h.region(c, r'<div id="c">', "</div>"), page)
    assert text('<div>0</div><div id="c">1<div>2<div>3</div></div>4</div>5') == "1<div>2<div>3</div></div>4"
    assert text('<div id="c">1<div>2</div>3') == "1<div>2</div>3"
    assert text('<div id="c">1</div >2') == "1" and text("<div>1</div>") == ""
    assert value(lambda c: h.first_element(c, "div", 'class="d"'), '<div class="x">0</div><div class="d">a<div>b</div>c</div>') == "a<div>b</div>c"


def brute_depth(page, mark):
    """The page without div elements that hold ``mark`` in their start tag, by a walk over its tags."""
    import re

    out, depth = [], 0
    for piece in re.split(r"(<div[^>]*>|</div>)", page):
        if depth:
            depth += piece.startswith("<div") - (piece == "</div>")
        elif piece.startswith("<div") and mark in piece:
            depth = 1
        else:
            out.append(piece)
    return "".join(out)


def test_nesting_against_a_walk(value):
    import random

    rng = random.Random(3)
    pages = ["".join(rng.choice(['<div class="ads">', "<div>", "</div>", "</div>", "t", "<p>u</p>"]) for _ in range(rng.randrange(60))) for _ in range(40)]
    for page in pages:
        assert value(lambda c: h.without_blocks(c, "ads"), page) == brute_depth(page, "ads")
