"""robots.txt: stored texts to ordered rules per agent group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions.arrays import lit, strip
from pagelens.functions.urls import netloc


def robots_rules(documents: DataFrame) -> DataFrame:
    """(host, group_no, agent, ord, allow, path) of every rule of every stored robots.txt.

    A group starts at the first of consecutive user-agent lines and ends at a blank line or the
    next group. Lines are rows: running sums and maxima over a file carry the group, the last blank line and the last
    agent, so a file of any length is read in one pass. Equal rows of one address are one file.
    """
    line = strip("regexp_replace(l, '#.*$', '')")
    key = "lower(" + strip("substring_index(t, ':', 1)") + ")"
    value = strip("if(contains(t, ':'), regexp_replace(t, '^[^:]*:', ''), '')")
    parsed = (
        f"filter(transform(transform(split(body, {lit(chr(92) + 'r?' + chr(92) + 'n')}), l -> if(startswith(btrim(l), '#'), '#', {line})), "
        f"t -> named_struct('k', {key}, 'v', {value})), e -> e.k in ('user-agent', 'allow', 'disallow', ''))"
    )
    files = documents.selectExpr(f"{netloc('url')} as host", "url", "md5(body) as file", "body").dropDuplicates(["url", "file"])
    lines = files.selectExpr("host", "url", "file", f"posexplode({parsed}) as (i, e)").selectExpr("host", "url", "file", "i", "e.k as k", "e.v as v")
    down = Window.partitionBy("host", "url", "file").orderBy("i")
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    marked = lines.withColumn("starts", (F.col("k") == "user-agent") & (F.lag("k", 1, "").over(down) != "user-agent")).select(
        "*", F.sum(F.col("starts").cast("int")).over(down).cast("int").alias("g"),
        F.max(F.when(F.col("k") == "", F.col("i"))).over(before).alias("last_blank"), F.max(F.when(F.col("k") == "user-agent", F.col("i"))).over(before).alias("last_agent"),
    )
    agents = marked.where("k = 'user-agent'").selectExpr("host", "url", "file", "g", "lower(v) as agent")
    held = marked.where("k in ('allow', 'disallow') and last_agent > coalesce(last_blank, -1)").select("host", "url", "file", "g", "i", "k", "v")
    # A null address has no host; its files are read all the same.
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("host", "url", "file")]
    rules = agents.alias("a").join(held.alias("r"), [*same, F.col("a.g") == F.col("r.g")]).selectExpr("a.host", "a.g as group_no", "a.agent", "r.i", "r.k", "r.v")
    # An empty disallow path means that everything is allowed.
    return rules.selectExpr("host", "group_no", "agent", "i as ord", "k = 'allow' or v = '' as allow", "v as path")


def rules_for_agent(rules: DataFrame, agent: str) -> DataFrame:
    """The rules of the first group that names the agent, else of the first `*` group, per host."""
    name = agent.split("/")[0].lower()
    rank = f"case when agent <> '*' and contains({lit(name)}, agent) then group_no when agent = '*' then 1000000 + group_no end"
    ranked = rules.withColumn("rank", F.expr(rank)).where("rank is not null")
    chosen = ranked.groupBy("host").agg(F.min("rank").alias("rank"))
    return ranked.join(chosen, ["host", "rank"], "left_semi").select("host", "ord", "allow", "path").distinct()
