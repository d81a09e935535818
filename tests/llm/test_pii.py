import re

from fixtures_llm import CLASHES, documents, edge_rows

from quire.llm import pii

FOUND = [r"[^\s<>]+@[^\s<>]+\.[a-z]+", r"\d+\.\d+\.\d+\.\d+", r"\b\d{16}\b", r"\+1 \(\d{3}\) \d{3}-\d{4}", r"\b[0-9a-f]{40}\b"]


def run(spark, texts, key="k"):
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)]
    return {r["doc_id"]: (r["text"], [e["kind"] for e in r["entities"]]) for r in pii.replace(documents(spark, rows), key).collect()}


def test_kinds_keep_their_form(spark):
    token = "40d78a45c418324758e099eb7cb89bc0f5f12345"
    out = run(spark, [
        f'ip 97.51.17.173. token = "{token}" v 4.0.1', "+1 (017) 555-7713 and +1 017 555 7713", "4111 1111 1111 1111, 4111111111111111!!", "078-05-1120 10:30 1,234",
        "Write to Nt.26@mail7.example.com, NT.26@MAIL7.EXAMPLE.COM",
    ])
    assert re.fullmatch(r'ip \d+\.\d+\.\d+\.\d+\. token = "[0-9a-f]{40}" v 4\.0\.1', out[0][0]) and token not in out[0][0]
    a, b = re.fullmatch(r"(\+\d \(\d{3}\) \d{3}-\d{4}) and (\+\d \d{3} \d{3} \d{4})", out[1][0]).groups()
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) != "10175557713"
    digits = [re.sub(r"\D", "", x) for x in out[2][0].split(",")]
    assert digits[0] == digits[1] != "4" + "1" * 15
    total = sum(int(d) if i % 2 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(digits[0]))
    assert total % 10 == 0
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4} 10:30 1,234", out[3][0]) and out[3][1] == ["ssn"]
    x, y = re.findall(r"\S+@[^\s,]+", out[4][0])
    assert y == x.upper() and x != "nt.26@mail7.example.com" and re.fullmatch(r"[a-z]{2}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com", x)


def test_people_keep_gender_script_and_identity(spark):
    out = run(spark, ["Herr Peter Schmidt und Frau Schmidt. Mr. Schmidt.", "г-жа Иванова, г-н Пётр Иванов; г-жа Иванова", "Frau Anna Meier, Herr Meier"])
    surnames = re.findall(r"(?:Herr \w+|Frau|Mr\.) (\w+)", out[0][0])
    assert len(set(surnames)) == 1 and surnames[0] != "Schmidt"
    first, man, given, second = re.search(r"г-жа (\w+), г-н (\w+) (\w+); г-жа (\w+)", out[1][0]).group(1, 3, 2, 4)
    assert first == second and first.endswith("ова") and man.endswith("ов") and given.endswith("н")
    assert re.search(r"Frau (\w+na) ", out[2][0])


def test_names_come_again_and_phones_in_pairs(spark):
    out = run(spark, [
        "Herr Peter Schmidt kam. Schmidt ging, PETER blieb; Schmidthaus.", "Frau Anna Maria Meier und Maria Meier", "Mr. Smith's car. Smith went.",
        "Schmidt kam.", "+33 6 12 34 56 78, +34 612 34 56 78, 01 23 45 67 89, +49 30 1234567, 612 34 56 78, +7 495 123-45-67", "г-н Пётр Иванов. Иванов",
        "01 02 03 and 2020-01-02 10:30, 600 34 56",
    ])
    given, last, again, upper = re.fullmatch(r"Herr (\w+) (\w+) kam\. (\w+) ging, (\w+) blieb; Schmidthaus\.", out[0][0]).groups()
    assert last == again != "Schmidt" and upper == given.upper() != "PETER"
    names = re.fullmatch(r"Frau (\w+) (\w+) (\w+) und (\w+) (\w+)", out[1][0]).groups()
    assert names[1:3] == names[3:] and not {"Anna", "Maria", "Meier"} & set(names)
    first, second = re.fullmatch(r"Mr\. (\w+)'s car\. (\w+) went\.", out[2][0]).groups()
    assert first == second != "Smith"
    assert out[3] == ("Schmidt kam.", [])
    assert out[4][1] == ["phone"] * 6 and re.sub(r"\d", "0", out[4][0]) == "+00 0 00 00 00 00, +00 000 00 00 00, 00 00 00 00 00, +00 00 0000000, 000 00 00 00, +0 000 000-00-00"
    assert not [n for n in ("12 34 56 78", "23 45 67 89", "1234567", "123-45-67") if n in out[4][0]]
    assert len(set(re.findall("[И-Я]?\\w+ов\\b", out[5][0]))) == 1 and "Иванов" not in out[5][0]
    assert out[6] == ("01 02 03 and 2020-01-02 10:30, 600 34 56", [])


def test_distinct_entities_stay_distinct(spark):
    # two digits each: the surrogates of one round must clash
    mails = [f"{i:02d}@x.org" for i in range(100)]
    out = run(spark, mails + [f"again {m}" for m in mails])
    made = [out[i][0] for i in range(100)]
    assert len(set(made)) == 100 and not set(made) & set(mails)
    assert all(out[100 + i][0] == f"again {made[i]}" for i in range(100))
    assert {out[i][0] for i in range(100)} != {v[0] for k, v in run(spark, mails, "another key").items()}


def test_edges_and_sample(spark):
    docs = documents(spark, clashing=True)
    done = pii.replace(docs, "k", out="pii_found")
    assert done.columns == [*docs.columns, "pii_found"] and set(CLASHES.split()) <= set(done.columns)
    rows = {(r["doc_id"], r["text"]): r for r in done.collect()}
    for r in edge_rows():
        if r[0] != 12:
            assert (r[0], r[1]) in rows and rows[r[0], r[1]]["pii_found"] == []
    assert done.count() == docs.count() and pii.replace(documents(spark, []), "k").count() == 0
    sample = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    both = pii.replace(sample, "k").withColumnRenamed("text", "new").join(sample, "doc_id").collect()
    assert len(both) == sample.count()
    for r in both:
        for p in FOUND:
            assert not [m for m in re.findall(p, r["text"]) if m in r["new"]]
        if not r["entities"]:
            assert r["text"] == r["new"]
