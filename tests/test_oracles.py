"""Registered queries against DuckDB on the smallest tables.

The slow ones (whole evidence chain, catalogue splitting) run when LARDER_ALL is set; the same
comparison for all of them at any scale is ``python tests/oracle.py``.
"""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
FAST = [
    "nutriscore", "health_scores", "additive_assessments", "nova_markers", "cosmetic_flags", "catalog_rows", "trimmed_catalog",
    "generation_changes", "delta_violations", "changes_applied", "postings", "ranked_documents", "barcode_checks", "gs1_classes",
    "sync_plans", "republished_plans", "chain_refused", "published_nutriscore", "annex_sections", "us_paragraphs", "tag_lists", "ingredient_rows",
    "properties", "part_routing", "product_search", "sampled_documents", "streamed_changes", "streamed_scans", "stored_catalog",
    "history_view", "nutrient_values", "field_census", "item_tag_links", "protective_intakes", "annex_classes", "us_scope",
    "fine_part_routing", "taxonomy_file", "differing_parts", "delta_manifest", "reindexed", "ranked_after_changes", "stored_schemas",
]
NAMES = list(oracle_sql()) if os.environ.get("LARDER_ALL") else FAST


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    assert compare(spark, duck, name, queries()[name], oracle_sql()[name], SF) == []


def test_entry_has_rows(spark):
    df = entry(spark)
    assert df.count() > 0 and {"barcode", "score", "band"} <= set(df.columns)


def test_every_oracle_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_queries_can_be_listed_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 100)"], cwd=root, capture_output=True, text=True)
    assert said.stdout.strip().endswith("True"), said.stderr[-500:]
