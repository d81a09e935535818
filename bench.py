"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = {
    "audit": "A2_audit_summary_documents",
    "merge_short": "W2_merge_short_documents",
    "split_to_target": "G4_split_documents",
    "text_quality": "A10_text_quality",
    "correction_cascade": "C9_cascade",
    "token_rewrite": "T14_token_rewrite",
    "page_text": "H8_section_text",
    "section_links": "H5_section_links",
    "pack_sections": "P1_pack_sections",
    "lexicon": "A7_lexicon",
    "resume_import": "X3_resume_import",
    "sync_batches": "K6_batches",
    "word_count": "T1_word_count",
    "clean_body": "T8_clean_body",
}


def main() -> None:
    from quire import registry
    from quire.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    registry.load_all()
    spark = local_session(cpus, app="quire-bench")
    # start the JVM's and the Python workers' machinery outside the measured queries
    registry.QUERIES["A4_catalogue_totals"](spark, sf_dir).collect()
    seconds = {}
    for label, name in HEADLINE.items():
        start = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[label] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": float(Path(sf_dir).name.removeprefix("sf") or 0),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
