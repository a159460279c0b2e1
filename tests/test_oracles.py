"""A cross-section of the registered queries against DuckDB on the smallest tables.

``python -m tests.check_oracles`` compares all of them.
"""

import pytest

from catalog import all_queries, all_sql
from tests.check_oracles import compare, connect

SAMPLE = [
    "doc_terms", "term_analysis", "terms_by_year_shares", "growth_indicators", "impact_analysis_authors", "core_authors",
    "bradford_zones", "bradford_law", "descriptive_statistics", "filter_records", "keywords_coverage", "historiograph_id",
    "co_occurrence", "auto_correlation", "cross_correlation_spearman", "tfidf", "strategic_map", "disambiguate_authors",
    "citation_pairs", "read_thesaurus", "json_records", "collocations",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_oracle(spark, sf, name):
    assert compare(all_queries()[name](spark, sf), connect(sf), all_sql()[name]) is None


def test_every_oracle_has_a_query():
    assert set(all_sql()) <= set(all_queries())
