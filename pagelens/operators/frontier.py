"""The crawl frontier as graph operators over a stored link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions import urls as U
from pagelens.functions.arrays import lit, present, strip
from pagelens.functions.html import attribute
from pagelens.operators.extract import tag_arrays
from pagelens.operators.skew import SALTS, hot_keys, salted_join
from pagelens.session import kept_in_place, stored

# Fixed values.
SKIP_ANCHOR = r"^(#|javascript:|mailto:|tel:|data:)"
SKIP_AREA = r"^(#|javascript:|mailto:)"
FOLLOWED_RELS = ["alternate", "canonical", "next", "prev"]
ROBOTS_BLOCKED = "Blocked by robots.txt"


def discovered_links(crawl: DataFrame) -> DataFrame:
    """Internal targets a page leads to: a, link, area and meta refresh, one row per distinct target."""
    followed = ", ".join(lit(r) for r in FOLLOWED_RELS)

    def hrefs(arr: str, cond: str) -> str:
        kept = f"filter({arr}, t -> {present(attribute('t', 'href'))} and {cond})"
        return f"transform({kept}, t -> {strip(attribute('t', 'href'))})"

    def refresh() -> str:
        content = attribute("t", "content")
        kept = f"filter(metas, t -> {attribute('t', 'http-equiv')} = 'refresh' and contains(lower({content}), 'url='))"
        target = strip(f"regexp_replace({content}, '(?s)^.*?url=', '')")
        return f"transform({kept}, t -> {target})"

    rels = f"split(lower(coalesce({attribute('t', 'rel')}, '')), ' ')"
    refs = "concat(" + ", ".join([
        hrefs("anchors", f"not {attribute('t', 'href')} rlike {lit(SKIP_ANCHOR)}"),
        hrefs("link_tags", f"arrays_overlap({rels}, array({followed}))"),
        hrefs("areas", f"not {attribute('t', 'href')} rlike {lit(SKIP_AREA)}"),
        refresh(),
    ]) + ")"
    resolved = tag_arrays(crawl).selectExpr("site", "ord", "url", "base", f"{U.url_join_all('base', refs)} as targets")
    internal = f"filter(array_distinct(targets), t -> {U.same_site(U.netloc('t'), 'base.netloc')})"
    return resolved.selectExpr("site", "ord", "url as source_url", f"posexplode({internal}) as (pos, target_url)")


def seed_frontier(sitemap: DataFrame, probe: DataFrame) -> DataFrame:
    """Sitemap URLs and then the start URL at depth 0, one per normalized URL."""
    both = sitemap.selectExpr("site", "loc as url", "0 as source").unionByName(probe.selectExpr("site", "start_url as url", "1 as source"))
    keyed = both.withColumn("url_key", F.expr(U.normalize_url("url")))
    return keyed.groupBy("site", "url_key").agg(
        F.expr("min_by(url, struct(source, url)) as url"), F.lit(0).alias("depth")
    )


def placed_edges(edges: DataFrame, hot: DataFrame, parts: int) -> DataFrame:
    """Edges dealt out once by (site, source_key, salt) and kept so; the edges of a hot source get a salt by target."""
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("target_key"), F.lit(SALTS)).cast("int")).otherwise(0)
    salted = edges.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), ["site", "source_key"], "left").withColumn("_salt", salt).drop("_hot")
    return kept_in_place(salted, parts, "site", "source_key", "_salt")


def next_level(edges: DataFrame, frontier: DataFrame, hot: DataFrame, visited: list[DataFrame], depth: int) -> DataFrame:
    """URLs that the frontier leads to and no level has yet, with the smallest path.

    Only the frontier and what it reaches move: edges and the levels of `visited` lie where their join keys put them.
    """
    last = F.when(F.col("_hot"), F.lit(SALTS - 1)).otherwise(0)
    sources = frontier.select("site", F.col("url_key").alias("source_key"), "path").join(F.broadcast(hot.withColumn("_hot", F.lit(True))), ["site", "source_key"], "left")
    sources = sources.withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_hot")
    step = edges.join(sources, ["site", "source_key", "_salt"]).groupBy("site", F.col("target_key").alias("url_key")).agg(F.expr("min(concat(path, array(pos)))").alias("path"))
    for level in visited:
        step = step.join(level, ["site", "url_key"], "left_anti")
    return step.select("site", "url_key", F.lit(depth).alias("depth"), "path")


def crawl_depth(seeds: DataFrame, edges: DataFrame, max_depth: int = 3) -> DataFrame:
    """Breadth-first depth and discovery path of every reachable URL: (site, url_key, depth, path).

    `seeds` is (site, url_key[, pos]); `edges` is (site, source_key, target_key[, pos]) of fetched and
    allowed pages only. A URL's path holds the position of each step that led to it, so URLs of one
    depth are discovered in the order of their paths: those of the earliest parent first, by their
    place on it. One join per level. Edges are written and dealt out once, the visited URLs level by level;
    a level is written too, so a lost executor replays one level.
    """
    spark = seeds.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def placed(df: DataFrame) -> DataFrame:
        return df if "pos" in df.columns else df.withColumn("pos", F.lit(0))

    edges = stored(placed(edges).groupBy("site", "source_key", "target_key").agg(F.min(F.col("pos").cast("int")).alias("pos")), "edges")
    # A hub page or a shared section has a large share of all edges: its edges are salted.
    hot = stored(hot_keys(edges, ["site", "source_key"]), "hot-sources")
    lying = placed_edges(edges, hot, parts)
    start = placed(seeds).groupBy("site", "url_key").agg(F.array(F.min(F.col("pos").cast("int"))).alias("path"))
    levels = [stored(start.select("site", "url_key", F.lit(0).alias("depth"), "path"), "level")]
    visited = []
    for depth in range(1, max_depth + 1):
        visited.append(kept_in_place(levels[-1].select("site", "url_key"), parts, "site", "url_key"))
        step = stored(next_level(lying, levels[-1], hot, visited, depth), "level")
        if step.isEmpty():
            break
        levels.append(step)
    for kept in (lying, *visited):
        kept.unpersist()
    reached = levels[0]
    for level in levels[1:]:
        reached = reached.unionByName(level)
    return reached


def fetched(crawl: DataFrame) -> DataFrame:
    """Pages that are expanded: fetched without error, with a success status."""
    return crawl.where("error_message is null and status_code between 200 and 299")


def page_edges(crawl: DataFrame) -> DataFrame:
    """Followable edges on normalized keys, from successful pages, with their place on the page."""
    return discovered_links(fetched(crawl)).selectExpr(
        "site", f"{U.normalize_url('source_url')} as source_key", f"{U.normalize_url('target_url')} as target_key", "pos"
    )


def frontier_limit(reached: DataFrame, max_pages: int) -> DataFrame:
    """The first max_pages URLs per site in discovery order; blocked URLs were never followed."""
    order = Window.partitionBy("site").orderBy("depth", "path", "url_key")
    return reached.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= max_pages)


def robots_verdicts(targets: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, robots_path, allow) of the distinct targets (host, robots_path) that a rule matches.

    A rule matches a target if its path is a prefix of it (`*` is the empty one). So a target is cut at the
    lengths that its host's rules have, the prefixes meet the rules by equality, and the first match decides: no
    target looks through a host's rules.
    """
    known = rules.where("host is not null and path is not null").selectExpr("host", "if(path = '*', '', path) as prefix", "ord", "allow").groupBy("host", "prefix").agg(F.min(F.struct("ord", "allow")).alias("rule"))
    lengths = known.groupBy("host").agg(F.array_sort(F.collect_set(F.length("prefix"))).alias("lengths"))
    cut = salted_join(targets, lengths, ["host"], ["robots_path"], "inner")
    cut = cut.selectExpr("host", "robots_path", "explode(transform(filter(lengths, n -> n <= length(robots_path)), n -> left(robots_path, n))) as prefix")
    met = salted_join(cut, known, ["host", "prefix"], ["robots_path"], "inner")
    return met.groupBy("host", "robots_path").agg(F.min("rule").alias("rule")).selectExpr("host", "robots_path", "rule.allow as allow")


def robots_filter(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Each URL with `allowed`: the first matching rule of its host decides; no rule allows.

    `rules` is (host, ord, allow, path) for one agent.
    """
    target = f"coalesce(nullif(concat({U._group('url', 5)}, {U._group('url', 6)}), ''), '/')"
    keyed = urls.selectExpr("*", f"{U.netloc('url')} as host", f"{target} as robots_path")
    verdicts = robots_verdicts(keyed.select("host", "robots_path").where("host is not null").distinct(), rules)
    return salted_join(keyed, verdicts, ["host", "robots_path"], ["url"]).selectExpr(
        *urls.columns, "coalesce(allow, true) as allowed", f"if(coalesce(allow, true), null, {lit(ROBOTS_BLOCKED)}) as error_message",
    )


def visited_dedup(urls: DataFrame) -> DataFrame:
    """One row per site and normalized URL."""
    return urls.withColumn("url_key", F.expr(U.normalize_url("url"))).groupBy("site", "url_key").agg(
        F.expr("min(ord) as ord"), F.expr("min_by(url, ord) as url")
    )
