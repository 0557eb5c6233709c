"""A crawl snapshot and the tables derived from it, each built once and lazily."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions.arrays import lit
from pagelens.operators import advanced, assets, keywords, rules, site, structured, visibility
from pagelens.operators.extract import page
from pagelens.plans import derived
from pagelens.session import ensure_checkpoint_dir

# Status of a link or image target derived from its text; null is "no response stored".
TARGET_STATUS = (
    "CASE length(target) % 10 WHEN 3 THEN 404 WHEN 5 THEN NULL WHEN 7 THEN 503 WHEN 9 THEN 301 ELSE 200 END"
)


class Snapshot:
    """Tables over one crawl, written stage by stage under one shared folder.

    The extraction job writes `page`; findings, scores, keywords and the site report are written
    from it once and read by every table after them. A written stage cuts the plan and the
    lineage: a lost executor replays one stage, and a report reads only the columns it uses.
    """

    def __init__(self, crawl: DataFrame, probe: DataFrame, sitemap: DataFrame, folder: str, url_status: DataFrame | None = None):
        self.crawl = crawl
        self.probe = probe
        self.sitemap = sitemap
        self.folder = folder
        self._url_status = url_status

    def _stored(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    @cached_property
    def page(self) -> DataFrame:
        return self._stored("page", page(self.crawl))

    @cached_property
    def references(self) -> DataFrame:
        return assets.references(self.page)

    @cached_property
    def url_status(self) -> DataFrame:
        if self._url_status is not None:
            return self._url_status
        targets = self.references.select("target").unionByName(
            self.page.selectExpr("explode(hreflang) as h").selectExpr("h.target_url as target")
        )
        return targets.distinct().selectExpr("target as url", f"{TARGET_STATUS} as status_code").where("status_code is not null")

    @cached_property
    def checked(self) -> DataFrame:
        return self._stored("reference", assets.checked_references(self.references, self.url_status))

    @cached_property
    def hreflang(self) -> DataFrame:
        return assets.hreflang_targets(self.page, self.url_status)

    @cached_property
    def orphans(self) -> DataFrame:
        return site.orphan_pages(self.sitemap, self.page)

    @cached_property
    def issues(self) -> DataFrame:
        """Page findings and site findings in one table."""
        frames = [
            rules.page_issues(self.page), assets.broken_issues(self.checked), assets.hreflang_issues(self.hreflang),
            *[site.duplicate_issues(self.page, k) for k in site.DUPLICATE_KEYS], site.orphan_issues(self.orphans, self.probe),
        ]
        return self._stored("issue", site.issue_columns(*frames))

    @cached_property
    def base_scores(self) -> DataFrame:
        return site.page_scores(self.page, self.probe)

    @cached_property
    def scores(self) -> DataFrame:
        return self._stored("page_score", site.page_scores(self.page, self.probe, self.checked))

    @cached_property
    def report(self) -> DataFrame:
        return self._stored("website_report", site.website_report(self.page, self.scores, self.orphans, self.probe))

    @cached_property
    def advanced(self) -> DataFrame:
        return self._stored("advanced_page", advanced.advanced_page(self.page))

    @cached_property
    def advanced_site(self) -> DataFrame:
        return advanced.advanced_site(self.advanced)

    @cached_property
    def factors(self) -> DataFrame:
        return visibility.factor_scores(self.advanced)

    @cached_property
    def factor_table(self) -> DataFrame:
        return visibility.factor_table(self.factors)

    @cached_property
    def tokenized(self) -> DataFrame:
        return keywords.tokens(keywords.page_text(self.page))

    @cached_property
    def keywords(self) -> DataFrame:
        return self._stored("keyword", keywords.keyword_table(self.tokenized))

    @cached_property
    def top_keywords(self) -> DataFrame:
        return keywords.top_keywords(self.keywords)

    @cached_property
    def gaps(self) -> DataFrame:
        return keywords.keyword_gaps(self.keywords, self.tokenized)

    @cached_property
    def seeds(self) -> DataFrame:
        return keywords.site_seeds(self.keywords)

    @cached_property
    def llms_sites(self) -> DataFrame:
        """Inputs of the llms.txt texts: the first pages of each site and a line about its score."""
        described = self.report.selectExpr(
            "site", "start_url as site_url",
            f"concat({lit('Page audit report for ')}, start_url, {lit('. Score: ')}, site_score, {lit('/100.')}) as site_description",
        )
        return described.join(structured.first_pages(self.page), "site")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder, or a temporary one where none is named."""
    ensure_checkpoint_dir(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{root}/{name}-{uuid.uuid4().hex}"


_SNAPSHOTS: dict[tuple[str, str], Snapshot] = {}


def derived_snapshot(spark: SparkSession, sf_dir: str) -> Snapshot:
    """The snapshot derived from the `pages` table of a folder; one per session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SNAPSHOTS:
        pages = derived.load_pages(spark, sf_dir)
        probe = pages.groupBy(F.expr(derived.SITE_OF).alias("site")).agg(F.min_by("url", "page_id").alias("start_url")).selectExpr(
            "site", "start_url", "length(site) % 2 = 0 as robots_txt_found", "length(site) % 3 <> 0 as sitemap_xml_found"
        )
        sitemap = pages.selectExpr(*derived.SITEMAP_COLUMNS).select("site", "loc", "lastmod")
        _SNAPSHOTS[key] = Snapshot(derived.derive_crawl(pages), probe, sitemap, scratch(spark, "snapshot"))
    return _SNAPSHOTS[key]

