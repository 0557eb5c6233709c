"""A slice of the registered queries against their checking SQL; the rest run in the same way."""

import os

import pytest

from pagelens.plans.oracle import oracles
from pagelens.plans.registry import QUERIES
from tests.checking import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = [
    "links", "images", "json_ld_requirements", "page_issues", "page_score_assets", "website_report", "factor_table", "keyword_placement", "issue_clusters_html",
    "report_chapters", "fix_guides", "llms_full_txt", "crawl_depth_bfs", "validate_rich_results", "stream_progress",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(oracles()) if os.environ.get("PAGELENS_ALL") else NAMES)
def test_query_matches(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, oracles()[name]) is None


def test_every_sql_has_a_query():
    assert set(oracles()) <= set(QUERIES)
    assert set(QUERIES) == set(oracles())
