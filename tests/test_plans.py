from pyspark.sql import functions as F

from quire.plans.audit import audit, audit_rows
from quire.plans.ingest import new_sections


def test_ingest(spark):
    body = "<p>" + "chữ " * 30 + "</p>"
    rows = [("w", i, f"https://m.read.io/t/chuong-{i + 1}", body if i not in (1, 5, 6, 7) else "<p>x</p>") for i in range(10)]
    rows.append(("v", 0, "https://other.io/t/chuong-1", body))
    pages = spark.createDataFrame(rows, "work_id string, pos int, url string, html string")
    stored = spark.createDataFrame([("w", 3)], "work_id string, number int")
    domains = spark.createDataFrame([("read.io", "A", 1)], "domain string, source string, reg_order int")
    out = new_sections(pages, stored, domains)
    assert sorted((r["work_id"], r["number"], r["word_count"]) for r in out.collect()) == [("w", n, 30) for n in (1, 4, 5)]


def test_audit(spark):
    works = spark.createDataFrame(
        [("w", "w", "W", "d" * 80, "r", "a", "[]", "published"), ("v", "v", "V", None, None, "", "x", "published"), ("p", "p", "P", "", "", "", "", "pending")],
        "work_id string, slug string, title string, description string, editorial_review string, character_analysis string, faq string, publish_status string")
    sections = spark.createDataFrame(
        [(f"s{i}", "w", i, "t", 400 if i else 10, "s", "h" if i != 2 else "", "published") for i in range(6)] + [("q", "p", 1, "t", 5, "s", "h", "published")],
        "section_id string, work_id string, number int, title string, word_count int, summary string, highlight string, publish_status string")
    found = {k: v.collect() for k, v in audit(works, sections).items()}
    assert [(r["slug"], r["sections"]) for r in found["thin_works"]] == [("v", 0)]
    assert [(r["slug"], r["has_review"], r["has_faq"]) for r in found["unenriched_works"]] == [("v", False, True)]
    assert [(r["slug"], r["description_length"]) for r in found["weak_description"]] == [("v", 0)]
    assert [r["section_id"] for r in found["unenriched_sections"]] == ["s2"]
    assert [(r["work_slug"], r["word_count"]) for r in found["short_sections"]] == [("p", 5), ("w", 10)]
    assert audit_rows(works, sections).filter(F.col("signal") == "thresholds").count() == 1


def test_slugs_until_one_is_free(spark):
    from quire.operators import changes as ch

    new = spark.createDataFrame([("a", "s", 2), ("b", "s", 1), ("c", "s", 1), ("d", "t", 1), ("e", None, 1)], "work_id string, slug string, created_at int")
    name = lambda w, k: new.filter(F.col("work_id") == w).select(ch.slug_candidate(F.col("slug"), F.col("work_id"), k)).first()[0]
    stored = spark.createDataFrame([("t",), (name("a", 1),), (name("a", 2),), (name("d", 1),)], "slug string")
    got = {r["work_id"]: r["slug"] for r in ch.unique_slugs(new, stored).collect()}
    assert got == {"a": name("a", 3), "b": "s", "c": name("c", 1), "d": name("d", 2), "e": None}
    # a suffixed slug that another new work asks for as its own
    both = spark.createDataFrame([("d", "t", 1), ("x", name("d", 1), 5)], "work_id string, slug string, created_at int")
    assert {r["work_id"]: r["slug"] for r in ch.unique_slugs(both, stored.limit(1)).collect()} == {"d": name("d", 2), "x": name("d", 1)}
    assert ch.unique_slugs(new.filter("false"), stored).count() == 0
