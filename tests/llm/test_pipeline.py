import corpus_pipeline
from fixtures_llm import documents, edge_rows, groups
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quire.llm import pii, quality_rules
from quire.llm.common import read, stored

SF = "/root/testdata/sf0.001"


def test_every_stage_works_on_what_is_left(spark):
    docs = read(spark, SF, "documents")
    benchmark = read(spark, SF, "benchmark").collect()
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, SF))
        ids, old = {r["doc_id"]: r for r in docs.collect()}, {r["doc_id"]: r for r in before.collect()}
        assert ids and set(ids) <= set(old)
        if name != "mix_sources":
            assert docs.columns == before.columns
        if name == "quality_rules":
            kept = {r["doc_id"] for r in quality_rules.judge(before).filter("quality.kept").collect()}
            assert set(ids) == kept
        elif name == "near_join":
            want = groups([(i, r["text"]) for i, r in old.items()])
            assert set(ids) == {i for i, c in want.items() if i == c}
        elif name == "decontaminate":
            from test_decontaminate import brute

            items = [(b["item_id"], b["text"]) for b in benchmark]
            assert set(ids) == {i for i, r in old.items() if not brute(r["text"], items)[1]}
        elif name == "pii_surrogates":
            assert set(ids) == set(old)
            assert all(r["n_chars"] == len(r["text"]) for i, r in ids.items() if r["text"] != old[i]["text"])
            assert not docs.join(pii.replace(before, "x").filter(F.size("entities") > 0).select("doc_id"), "doc_id").join(before.select("doc_id", "text"), ["doc_id", "text"]).count()
        else:
            assert docs.columns == [*before.columns, "copies"] and all(1 <= r["copies"] <= 3 for r in ids.values())


def test_edges(spark):
    for rows in (edge_rows(), []):
        docs = documents(spark, rows, clashing=True)
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = stored(stage(spark, docs, SF))
            assert name == "mix_sources" or docs.columns == columns


def test_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert names["pipeline"] is corpus_pipeline.run and len(corpus_pipeline.STAGES) == 5
