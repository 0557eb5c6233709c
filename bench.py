"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

`page_extract` is the cold extraction job over the raw pages. The snapshot stages are then written
once and the report queries read them, which is how a crawl is processed at any size.
"""

from __future__ import annotations

import json
import os
import time

from pagelens.operators.extract import page
from pagelens.operators.rules import page_issues
from pagelens.plans import derived
from pagelens.plans.registry import QUERIES
from pagelens.plans.snapshot import derived_snapshot
from pagelens.session import local_session

HEADLINE = [
    "links", "json_ld", "page_issues", "page_score_assets", "website_report", "content_quality", "factor_table", "keyword_placement",
    "keyword_report", "document_keyword_count", "top_issues", "report_chapters", "dup_titles_members", "crawl_depth_bfs", "stream_site_scores",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    run(derived.load_pages(spark, sf_dir))
    seconds = {}

    def timed(name: str, work) -> None:
        start = time.perf_counter()
        work()
        seconds[name] = round(time.perf_counter() - start, 3)

    timed("page_extract", lambda: run(page(derived.derived_crawl(spark, sf_dir))))
    timed("page_extract_and_audit", lambda: run(page_issues(page(derived.derived_crawl(spark, sf_dir)))))
    snapshot = derived_snapshot(spark, sf_dir)
    for stage in ("page", "checked", "issues", "scores", "report", "advanced", "keywords"):
        timed(f"stage_{stage}", lambda s=stage: getattr(snapshot, s))
    for name in HEADLINE:
        timed(name, lambda n=name: run(QUERIES[n](spark, sf_dir)))
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir),
    }))


if __name__ == "__main__":
    main()
