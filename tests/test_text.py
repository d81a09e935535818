from pyspark.sql import functions as F

from quire.functions import genres as g
from quire.functions import predicates as p
from quire.functions import responses as r
from quire.functions import text as t
from quire.functions import urls


def test_words_and_slugs(value):
    assert value(t.word_count, "a b　c d\x1ce\u0085f") == 6
    assert value(t.word_count, " \n ") == 0
    assert value(t.slug, "Đường Về  Nhà: Chương 1!") == "duong-ve-nha-chuong-1"
    assert value(t.slug, "A.B—C d") == "abc-d"
    assert value(t.file_slug, "A.B—C d") == "a-b-c-d"
    every = "".join(chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000)
    assert value(t.word_count, "x".join(every)) == len("x".join(every).split())


def test_truncation(value):
    cases = {"a.": False, "a": True, "a” \n": False, "": True, "a)": False, "a\\": True}
    assert {k: value(p.is_truncated, k) for k in cases} == cases
    assert value(lambda c: t.truncate_at_sentence(c, 20), "Một câu. Câu hai rất là dài") == "Một câu."
    assert value(lambda c: t.truncate_at_sentence(c, 20), "Một câu hai rất là dài lắm") == "Một câu hai rất là…"


def test_mojibake(value):
    assert value(t.repair_mojibake, "Truyện".encode().decode("latin-1") + "\x00") == "Truyện"
    assert value(t.repair_mojibake, "Truyện ngắn") == "Truyện ngắn"
    assert value(t.repair_mojibake, "Ä\x80") == "Ā"


def test_foreign(value):
    assert value(t.strip_foreign, "Anh мой nói 你好 xin. He went to the store yesterday. Tom ơi") == "Anh nói xin. . Tom ơi"
    long = " ".join(["word"] * 200_000)
    assert value(t.strip_foreign, long) == ""


def test_reflow(value):
    assert value(t.reflow, 'nổ ra:"Phóng viên?"Gương mặt') == 'nổ ra:\n"Phóng viên?"\n\nGương mặt'
    assert value(t.reflow, 'Anh nói."Tôi đi."Cô khóc') == 'Anh nói."\n\nTôi đi."\n\nCô khóc'


def test_clean_body(value):
    text = "Chương 12: Tên\n\n\nT.i.ế.n lên\n—HẾT—\n12 Tôi đi\n9.Sáng nay\n------\nnhẫnGió ***g xa\U0001F600"
    assert value(t.clean_body, text) == "Tiến lên\nTôi đi\nnhẫn\nGió xa"
    assert value(lambda c: t.clean_body(c, (("máu", "huyết"), ("máu lạnh", "tàn nhẫn"))), "kẻ máu lạnh và máu") == "kẻ tàn nhẫn và huyết"


def test_phrases(value):
    pairs = (("chít", "chết"),)
    assert value(lambda c: t.replace_phrases(c, pairs), "Chít rồi, chít thật, chítt") == "Chết rồi, chết thật, chítt"
    foreign = (("voice", "giọng"),)
    assert value(lambda c: t.replace_foreign_words(c, foreign), "giọng voice hay, Voice lạ, voice giọng") == "giọng hay, Giọng lạ, giọng"


def test_punctuation_and_repeats(value):
    assert value(t.repair_punctuation, "đi.Tôi  , gấp,. ngập,, rồi!! tôi .") == "đi. Tôi, gấp. ngập, rồi! tôi."
    assert value(t.collapse_repeats, "rằng Rằng anh anhh đi") == "rằng anh anhh đi"
    assert value(t.remove_hesitation, 'yêu nhau... a... ba "Ưm... chúng, ừ, ta.....\nược rồi') == 'yêu nhau... ba "chúng, ta...\nđược rồi'


def test_sentences_and_descriptions(value):
    assert value(t.sentences, "A b. C!\nD\n\nE… F") == ["A b.", "C!", "D", "E…", "F"]
    text = "Nàng đẹp. Số đo 90-60-90 nóng. Hãy nghe truyện này. Kết thúc 😀 vui. Nghe tiếp để biết thêm."
    assert value(t.sanitise_description, text) == "Nàng đẹp. Kết thúc vui."
    assert value(p.is_call_to_action, 'Mời Nghe "Tên" để biết kết cục') and not value(p.is_call_to_action, "Nàng nghe tiếng gió")


def test_excerpts(value):
    assert value(lambda c: t.head_tail(c, 5, "|"), "abcdefgh") == "ab|fgh"
    text = "x" * 200 + "bad" + "y" * 100 + "worse" + "z" * 400 + "gone" + "w" * 10
    got = value(lambda c: t.contexts(c, F.array(F.lit("worse"), F.lit("bad"), F.lit("none"), F.lit("gone"))), text)
    first, second = got.split("\n…\n")
    assert first == text[50:458] and second == text[text.find("gone") - 150:]
    assert value(lambda c: t.masked_context(c, F.lit("bad"), "#", 3), text) == "xxx#yyy"
    assert value(lambda c: t.masked_context(c, F.lit("nope")), text) is None


def test_titles(value):
    prefix, suffix = "【A】", " | Kênh"
    f = lambda c: t.title_line(c, prefix, suffix, 30)
    assert value(f, "1. 【A】một hai | Tên | Kênh") == "1. 【A】một hai | Kênh"
    assert value(f, "không có") == "không có"
    assert value(f, "【A】một hai ba bốn năm sáu bảy | Tên | Kênh") == "【A】một hai ba bốn... | Kênh"
    s = lambda c: t.short_title(c, " | Kênh", "Kênh", 100)
    assert value(s, '1. "hay | Tên | Kênh"') == "hay | Kênh" and value(s, "[hay]") == "hay | Kênh" and value(s, "trần") == "trần"
    assert value(t.wrap_title, "một hai ba bốn... năm sáu bảy tám chín") == "một hai ba bốn...\nnăm sáu bảy tám chín"
    assert value(t.wrap_title, "aaaa bbbb cccc dddd eeee ffff gggg") == "aaaa bbbb cccc dddd\neeee ffff gggg"


def test_genres(value):
    pair = lambda c: g.map_genres(F.split(c, ","))
    assert tuple(value(pair, "Ngôn tình,Hiện đại,abc")) == ("ngon-tinh", "Hiện đại,abc")
    assert tuple(value(lambda c: g.map_genres(g.split_names(c)), "")) == ("ngon-tinh", "")
    assert value(g.first_era, "zz,do-thi") == "hien-dai" and value(g.first_era, "") == "co-trang"
    assert value(g.chosen_era, "do-thi", "thap-nien") == "thap-nien" and value(g.chosen_era, "do-thi", "co-trang") == "hien-dai"


def test_urls(value):
    number = lambda u: urls.section_number(u, F.lit(4))
    assert [value(number, u) for u in ("https://a/chuong-12", "https://a/chapter 7", "https://a/foo")] == [12, 7, 5]
    assert value(urls.work_slug, "https://h.x/truyen/ten-ht/") == "ten-ht" and value(urls.work_slug, "https://h.x/ten-ht/chuong-5") == "ten-ht"
    assert value(urls.book_id, "https://w.x/book/12345_name") == "12345" and value(urls.book_id, "https://w.x/b") is None
    assert value(lambda u: p.is_work_url(u, "https://c.x"), "https://c.x/abc/") and not value(lambda u: p.is_work_url(u, "https://c.x"), "https://c.x/tag/")


def test_responses(value):
    raw = "===SUMMARY===\nA\n===HIGHLIGHT===\nB"
    assert [value(lambda c, k=k: r.marked(c, k), raw) for k in ("SUMMARY", "HIGHLIGHT", "NEXT_PREVIEW")] == ["A", "B", ""]
    faq = value(r.faq, "Q: x?\nA: y\nz\n\nQ. w?\nA. v")
    assert [tuple(x) for x in faq] == [("x?", "y z"), ("w?", "v")]
    plan = lambda c: r.split_plan(c, F.lit(20), F.lit(3))
    ok = value(plan, 'ok {"splits":[7,14],"titles":["a","b","c"]}')
    assert (ok["splits"], ok["titles"]) == ([7, 14], ["a", "b", "c"])
    for bad in ('{"splits":[14,7],"titles":["a","b","c"]}', '{"splits":[7],"titles":["a","b","c"]}', '{"splits":[7,20],"titles":["a","b","c"]}', "none"):
        assert value(plan, bad) is None
    assert value(r.picked_title, '\n"**Title: Gió về.**"\nx') == "Gió về"
    script = "===CHARACTER===\nNAME: A\n===HOOK_STORY===\n" + "Câu này dài hơn hai mươi ký tự. " * 14 + "===SCENES===\n"
    told = value(r.scene_script, script)
    assert len(told["scenes"]) == 7 and told["scenes"][1]["emotion"] == "sadness" and told["scenes"][0]["text"].count(".") == 2


def test_speech_text(value):
    assert value(t.speech_text, " Tên ", 'Anh nói "\n\n Chào\n\n\n\nxong  ') == 'Tên.\n\nAnh nói "Chào\n\nxong'
    assert value(t.speech_text, "Tên", "") == "Tên"


def test_seeds_are_stable(value):
    import hashlib

    assert value(t.seed31, "abc") == int(hashlib.md5(b"abc").hexdigest()[:8], 16) % 2**31
    words = {"gió": ["bão"]}
    one = value(lambda c: t.substitute_seeded(c, F.lit("k"), words), "gió " * 40)
    assert one == value(lambda c: t.substitute_seeded(c, F.lit("k"), words), "gió " * 40) and 5 < one.count("bão") < 35


def test_nfc_equals_the_standard_library(spark):
    import random
    import unicodedata

    from quire.operators.normalise import nfc

    rng = random.Random(1)
    pool = [chr(c) for c in range(0x20, 0x3000) if unicodedata.category(chr(c)) not in ("Cs", "Cn")]
    pool += [chr(c) for c in (0xAC00, 0x1F600, 0x2F800, 0xF900, 0xFB1D, 0x1161, 0x11A8, 0x1100, 0x110BA, 0x11099)] + [*"eoau", *(chr(c) for c in (0x301, 0x302, 0x323, 0x309))] * 300
    texts = ["".join(rng.choice(pool) for _ in range(30)) for _ in range(2_000)] + [None, "", "plain"]
    got = [r["t"] for r in nfc(spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1), "t").collect()]
    assert got == [None if t is None else unicodedata.normalize("NFC", t) for t in texts]


def test_wrap_title_nearest_blank(spark):
    import random

    def plain(x):
        if len(x) <= 28 or "\n" in x:
            return x
        places = [i for i, ch in enumerate(x) if ch == " "]
        best = min(places, key=lambda i: (abs(i - len(x) // 2), i), default=0)
        return x[:best] + "\n" + x[best + 1 :] if best > 0 else x

    rng = random.Random(3)
    texts = ["".join(rng.choice("abđ" + " " * k) for _ in range(rng.randrange(27, 60))) for k in (0, 1, 1, 2) for _ in range(60)] + [" " + "a" * 40, "a" * 40 + " "]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", t.wrap_title("x").alias("y")).collect()
    assert [r["y"] for r in rows] == [plain(r["x"]) for r in rows]


def test_wrap_title_is_not_quadratic(spark):
    import time

    start = time.time()
    # a million letters without a blank near the middle, and blanks all over
    rows = spark.range(1).select(F.expr("concat(repeat('a b', 300000), repeat('đ', 100000))").alias("x"))
    assert rows.select(F.length(t.wrap_title("x")).alias("n")).first()["n"] == 1_000_000
    assert time.time() - start < 20


def _steps(spark, column, piece):
    """How often a long step stands in the plan of a column over a text."""
    rows = spark.createDataFrame([("x",)], "text string").select(column.alias("out"))
    return rows._jdf.queryExecution().analyzed().toString().count(piece)


def test_long_texts_are_cut_once(spark):
    assert _steps(spark, t.title_line("text", ">>", " | Brand"), "split(") == 1
    script = r.scene_script("text")
    assert _steps(spark, script, "SCENE\\s+") == 1 and _steps(spark, script, "===CHARACTER===") == 1
    assert _steps(spark, script, "===SCENES===, 1") == 2  # the story as a column and for the scenes
    assert _steps(spark, t.first_label("text", ((("a", "b"), "x"), (("c",), "y"))), "lower(") == 1


def test_title_lines_and_labels(value):
    run = lambda x: value(lambda c: t.title_line(c, ">>", " | B", 20), x)
    assert run("1. >>a b c. | w | B") == "1. >>a b c. | B" and run("no | prefix | here") == "no | prefix | here" and run(None) is None
    assert run("# >>aaaa bbbb cccc dddd. | w | B") == "# >>aaaa bbbb... | B"
    label = lambda x: value(lambda c: t.first_label(c, ((("a.", "b"), "x"), (("c",), "y"))), x)
    assert [label("cab"), label("xA."), label("axC"), label("z"), label(None)] == ["x", "x", "y", "", ""]


def test_faq_query_on_texts_that_begin_like_an_answer(spark, tmp_path):
    from quire import registry

    registry.load_all()
    rows = [(1, "A. b c"), (2, "q: x"), (3, "plain\ntext"), (4, "a\u00a0. b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(x["doc_id"], x["pos"]): (x["q"], x["a"]) for x in registry.QUERIES["T27_faq"](spark, str(tmp_path)).collect()}
    for k, line in ((1, "A. b c"), (2, "q: x"), (3, "plain text"), (4, "a . b")):
        assert got[k, 0] == (f"why {line}?", f"y {line}") and got[k, 1] == ("w?", "v")
