"""Every registered query runs; those with SQL agree with DuckDB. QUIRE_ALL=1 runs all, else a spread of them."""

import os

import pytest

import __spark_entry__ as entry
from check import compare, duck

SF = "/root/testdata/sf0.001"
FEW = """A2_audit_summary A1_thin_works J9_match_works J10_match_domains X2_upsert_sections X9_unique_slugs W2_merge_short W5_stop_rule
W7_allocation G4_split_to_target P1_pack_sections K6_batches K7_import_payloads T2_slug T18_truncate T35_map_genres A10_text_quality C2_verdicts
C6_fuzzy_fixes T25_apply_supplied_fixes H8_section_text H5_section_links I1_new_sections I3_incremental_load I5_change_feed_stream""".split()
NAMES = list(entry.queries()) if os.environ.get("QUIRE_ALL") else FEW


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no sample data")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    _, verdict = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert verdict in ("ok", "rows only"), verdict


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
