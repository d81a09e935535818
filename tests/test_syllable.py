from pyspark.sql import functions as F

from quire.functions import syllable as sy
from quire.operators import correct, lexicon as lx
from quire.plans.repair import repair_words

VALID = ("người những được không một trong thương cười nước đường trước muốn chuyện truyện quả quyền khuya nghe nghĩ gì gỉ già "
         "tia mía bún ba má cậu hoa hoạ tôi sao sánh so vậy ấy sự").split()
REPAIRS = {
    "ngưười": "người", "nhữững": "những", "đượều": "đượu", "khôông": "không", "nhưưng": "nhưng", "đưươc": "đươc", "ngưươi": "ngươi",
    "ươương": "ương", "ưương": "ương", "đượợc": "được", "chuuyện": "chuyện", "truuyện": "truyện", "Đêắng": "Đắng", "âài": "ài", "lấôi": "lôi",
    "khiếừng": "khiếng", "trôâu": "trâu", "lỏửa": "lửa", "nhưột": "nhột", "cáủa": "của", "ththật": "thật", "trườờng": "trường",
    "NHỮỮNG": "Những", "gngười": None, "mộọng": None, "còơn": None, "tôài": None,
}
# real syllables that settle the ambiguous deletions, and the near ones the fuzzy tier sees
LEXICON = ("người những không nhưng được chuyện truyện đắng lửa nhột của thật trường trâu ài lôi mọng mộng tài tôi nhanh nhánh nhạnh nhằn "
           "nhằng ương ngươi đươc khiếng đượu cảm thấy").split()


def words(spark, items, name="bad"):
    return spark.createDataFrame([(w,) for w in items], f"{name} string")


def test_bases_match_the_rules():
    assert len(sy.valid_bases()) == 4238 and len(sy.rules.RHYMES) == 170


def test_verdicts(spark):
    bad = ["ngưười", "mộọng", "còơn", "tôài", "café", "élève", "cáủ", "quu", "ke", "ce"]
    rows = words(spark, VALID + bad, "token").select("token", sy.is_valid("token").alias("v"), sy.is_suspicious("token").alias("s")).collect()
    got = {r["token"]: (r["v"], r["s"]) for r in rows}
    assert all(got[w][0] for w in VALID)
    assert not any(got[w][0] for w in bad if w != "ke") and got["ke"][0]
    plain = words(spark, "Claude John Python API GPT Linux".split(), "token").filter(sy.is_suspicious("token"))
    assert plain.count() == 0


def test_tier_one(spark):
    fixed = {r["bad"]: r["good"] for r in correct.collapse_fixes(words(spark, REPAIRS), words(spark, LEXICON, "syllable")).collect()}
    assert fixed == {k: v for k, v in REPAIRS.items() if v}


def test_tier_one_gives_up_without_a_single_answer(spark):
    fixed = correct.collapse_fixes(words(spark, ["tôài"]), words(spark, ["zzz"], "syllable")).collect()
    assert fixed == []


def test_fuzzy_candidates(spark):
    bad = ["lỏửa", "nhưột", "ngưười", "Đêắng", "ththật", "gngười", "mộọng", "tôài", "nhằnh", "khôông"]
    rows = correct.fuzzy_candidates(words(spark, bad), words(spark, LEXICON, "syllable")).collect()
    got = {}
    for r in rows:
        got.setdefault(r["bad"], set()).add(r["cand"])
    assert got == {"lỏửa": {"lửa"}, "nhưột": {"nhột"}, "ngưười": {"người"}, "Đêắng": {"đắng"}, "mộọng": {"mọng", "mộng"}, "tôài": {"tài", "tôi"},
                   "nhằnh": {"nhanh", "nhánh", "nhạnh", "nhằn", "nhằng"}, "khôông": {"không"}}
    picks = {r["bad"]: r["good"] for r in correct.fuzzy_fixes(correct.fuzzy_candidates(words(spark, bad), words(spark, LEXICON, "syllable"))).collect()}
    assert picks == {"lỏửa": "lửa", "nhưột": "nhột", "ngưười": "người", "Đêắng": "Đắng", "khôông": "không"}


def test_fuzzy_candidates_equal_brute_force(spark):
    import itertools
    import random

    rng = random.Random(3)
    letters = "aăđchnoôưt"
    lex = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(2, 5))) for _ in range(150)})
    bad = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(3, 5))) for _ in range(60)})

    def near(a, b):
        if len(a) == len(b):
            diff = [i for i in range(len(a)) if a[i] != b[i]]
            swap = len(diff) == 2 and diff[1] == diff[0] + 1 and a[diff[0]] == b[diff[1]] and a[diff[1]] == b[diff[0]]
            return (len(diff) == 1 or swap) and len(a) >= 4
        s, l = sorted((a, b), key=len)
        return len(l) - len(s) == 1 and any(l[:i] + l[i + 1:] == s for i in range(len(l)))

    wrong = {r["bad"] for r in words(spark, bad).filter(~sy.is_valid("bad")).collect()}
    onset = {r["w"]: r["o"] for r in words(spark, lex + bad, "w").select("w", sy.onset("w").alias("o")).collect()}
    expect = {(a, b) for a, b in itertools.product(wrong, lex) if near(a, b) and onset[a] == onset[b]}
    got = {(r["bad"], r["cand"]) for r in correct.fuzzy_candidates(words(spark, bad), words(spark, lex, "syllable"), top=10**6).collect()}
    assert got == expect and expect


def test_sentence(spark):
    text = "Tôi nhìn nhữững ngưười đó và cảm thấy đượều kỳ lạ. Anh Claude cười."
    df = spark.createDataFrame([(1, text), (2, "Anh cười.\n\nTốt!")], "id int, content string")
    q = {r["id"]: (r["invalid"], r["words"]) for r in lx.quality(df, ["id"]).collect()}
    assert q[1] == (3, ["nhữững", "ngưười", "đượều"]) and q[2] == (0, [])
    fixed, repairs = repair_words(df, words(spark, LEXICON, "syllable"), ["id"])
    out = {r["id"]: r["content"] for r in fixed.collect()}
    assert out[1] == "Tôi nhìn những người đó và cảm thấy đượu kỳ lạ. Anh Claude cười." and out[2] == "Anh cười.\n\nTốt!"
    assert {r["tier"] for r in repairs.collect()} == {1}
    again, _ = repair_words(fixed, words(spark, LEXICON, "syllable"), ["id"])
    assert {r["id"]: r["content"] for r in again.collect()} == out


def test_decomposed_text_is_composed_first(spark):
    import unicodedata

    df = spark.createDataFrame([(1, unicodedata.normalize("NFD", "ngưười ơi"))], "id int, content string")
    fixed, _ = repair_words(df, words(spark, LEXICON, "syllable"), ["id"])
    assert fixed.first()["content"] == "người ơi"


def test_cascade_tiers(spark):
    bad = words(spark, ["ngưười", "nhằnh", "mộọng", "tôài", "xyzê"])
    scores = spark.createDataFrame([("mộọng", "mọng", 9.0), ("mộọng", "mộng", 1.0), ("tôài", "tài", 2.0), ("tôài", "tôi", 1.5)], "bad string, cand string, score double")
    supplied = spark.createDataFrame([("tôài", "tôi"), ("nhằnh", "nhằnh"), ("xyzê", "xyzê2ă")], "bad string, good string")
    out = {r["bad"]: (r["good"], r["tier"]) for r in correct.cascade(bad, words(spark, LEXICON, "syllable"), scores, supplied).collect()}
    assert out["ngưười"] == ("người", 1) and out["mộọng"] == ("mọng", 3) and out["tôài"] == ("tôi", 4) and out["nhằnh"] == (None, None)


def test_corrupted_words(value):
    text = "Nóôi bấọng rồi giấy quyền khuya chuyểình xong"
    assert value(sy.drop_corrupted_words, text).split() == "rồi giấy quyền khuya xong".split()


def test_segments_rejoin(value):
    text = "Tôi — đi\n\nvề; 12.5%  «ừ»!\t"
    assert value(lambda c: F.array_join(sy.segments(c), ""), text) == text


def _below_counts(df):
    """The operators below the first aggregation of the optimized plan that judge a token by the pattern of bases."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return "RLIKE" in plan.split("Aggregate", 1)[1]


def test_words_are_judged_once_not_per_occurrence(spark):
    from quire.operators import correct, lexicon as lx

    texts = spark.createDataFrame([("nghièệng thưởng nghièệng the",), ("Ngiêu thưởng the",), (None,)], "text string")
    assert not _below_counts(lx.lexicon_of(lx.token_counts(texts, "text")))
    words = correct.damaged_words(texts, "text")
    assert not _below_counts(words.filter(~sy.is_valid("bad")))
    assert "nghièệng" in [r["bad"] for r in words.collect()]
    assert "thưởng" in [r["syllable"] for r in lx.lexicon_of(lx.token_counts(texts, "text")).collect()]


def test_marked_tokens_are_the_tokens_beyond_ascii(spark):
    text = "abc đá xyzé éa-b Ünter plain x9é ỹ A"
    row = spark.createDataFrame([(text,)], "t string").select(sy.tokens("t").alias("a"), sy.marked_tokens("t").alias("m")).first()
    assert row["m"] == [w for w in row["a"] if not w.isascii()] and len(row["m"]) == 6
