"""URL filters: rules, and link-graph propagation where no rule fits.

Method: personalised PageRank from trusted seed hosts along the links between
hosts, and distrust from blocked seed hosts along the reversed links; a host is
blocked where its distrust exceeds a share of its distrust and trust together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecmill.llm.common import cut, table


@dataclass(frozen=True)
class UrlRule:
    verdict: str  # block or allow
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


RULES = (
    UrlRule("block", "net", "/"),
    UrlRule("allow", "example.net", "/en/"),
    UrlRule("block", "example.com", "/de/"),
    UrlRule("allow", "org", "/fr/"),
)
DAMPING = 0.85
#: Propagation ends once the mass that still moves is below this, where a seed's page has mass 1.
RESIDUAL = 1e-6
#: A host is blocked where distrust / (trust + distrust) is over this; both count by the mass of their seeds, not by shares of it.
THRESHOLD = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest is asked first
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def whole_hosts(rules: tuple[UrlRule, ...]) -> list[str]:
    """Names of the rules that block hosts as a whole: their path is ``/``."""
    return [r.name for r in rules if r.verdict == "block" and r.path == "/"]


def host_links(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """(src, dst, weight, blocked): links of pages (host, html) to other hosts, counted by pair of hosts.

    Links are absolute (http, https) or begin with ``//``. ``blocked`` are those
    that a rule for whole hosts decides; without a path, a link counts as to ``/``.
    """
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)\bhref\s*=\s*["']?((?:https?:)?//[^\s"'<>]+)"""), F.lit(1))
    to = F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), F.col("to"))).otherwise(F.col("to"))
    path = F.when(path_of(F.col("to")) == "", "/").otherwise(path_of(F.col("to")))
    return (
        pages.where(F.col("host") != "")
        .select(F.col("host").alias("src"), F.explode(found).alias("to"))
        .select("src", to.alias("to"))
        .select("src", host_of(F.col("to")).alias("dst"), path.alias("path"))
        .where("dst <> '' AND src <> dst")
        .withColumn("bad", rule_of(F.col("dst"), F.col("path"), rules)["rule"].isin(whole_hosts(rules)))
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("weight"), F.count(F.when(F.col("bad"), 1)).alias("blocked"))
    )


def propagate(links: DataFrame, seeds: DataFrame, residual: float = RESIDUAL, damping: float = DAMPING) -> DataFrame:
    """(host, score): PageRank with restarts at ``seeds`` (host, mass; the masses are not normalised).

    Mass moves on until less than ``residual`` does, so that no other seed bears on what one seed gives.
    Mass at a host without links is lost; scores are at least those of the restarts.
    """
    now = cut(seeds.select("host", ((1 - damping) * F.col("mass")).alias("score")).withColumn("moving", F.col("score")))
    if links.isEmpty() or now.isEmpty():
        return now.select("host", "score")
    degree = links.groupBy("src").agg(F.sum("weight").alias("degree"))
    steps = cut(links.join(degree, "src").select("src", "dst", (F.col("weight") / F.col("degree")).alias("share")))
    while (now.agg(F.sum("moving")).first()[0] or 0.0) >= residual:
        moved = steps.join(now.where("moving > 0").select(F.col("host").alias("src"), "moving"), "src").select(
            F.col("dst").alias("host"), (damping * F.col("share") * F.col("moving")).alias("score")
        )
        both = now.select("host", "score", F.lit(0.0).alias("moving")).unionByName(moved.withColumn("moving", F.col("score")))
        now = cut(both.groupBy("host").agg(F.sum("score").alias("score"), F.sum("moving").alias("moving")))
    return now.select("host", "score")


def judge_pages(
    pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, threshold: float = THRESHOLD, residual: float = RESIDUAL
) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of each row of ``pages`` (page_id, url, html).

    A page that a rule fits has its verdict. Seeds of distrust are the hosts that
    a rule blocks as a whole (its path is ``/``), by their pages, or, where a host
    has none, by the links to it that such a rule decides; seeds of trust are the
    hosts of allowed pages, other than those (a host without pages links to none,
    and would pass no trust on). Other pages are blocked with
    their host, else allowed. A null url, or one without ``://``, has an empty
    host and path: no rule fits, and it is allowed. Null ids and repeated rows are
    rows like any other; a null html has no links. Other columns are not read. No
    rows give no rows.
    """
    whole = whole_hosts(rules)
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    ruled = seen.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    by_host = cut(
        ruled.where("host <> ''")
        .groupBy("host")
        .agg(
            F.count(F.when(F.col("fit.verdict") == "allow", 1)).alias("allowed"),
            F.count(F.when(F.col("fit.rule").isin(whole), 1)).alias("blocked"),
        )
    )
    links = cut(host_links(seen, rules))
    unseen = links.groupBy(F.col("dst").alias("host")).agg(F.sum("blocked").alias("mass")).join(by_host, "host", "left_anti")
    blocked = by_host.select("host", F.col("blocked").alias("mass")).unionByName(unseen).where("mass > 0")
    trust = propagate(links, by_host.where("allowed > 0 AND blocked = 0").select("host", F.col("allowed").alias("mass")), residual)
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = propagate(back, blocked, residual)
    scores = cut(
        trust.withColumnRenamed("score", "trust")
        .join(distrust.withColumnRenamed("score", "distrust"), "host", "full")
        .select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    )
    # plain scans on both sides: a host with a third of all pages is split as the join runs
    placed = ruled.select("page_id", "host", "path", "fit").join(scores, "host", "left")
    bad = (F.col("distrust") > 0) & (F.col("distrust") > threshold * (F.col("trust") + F.col("distrust")))
    return placed.select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(bad, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pages(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


_RULE = """CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END"""
ORACLE = r"""
WITH RECURSIVE p AS (SELECT page_id, coalesce(html, '') AS html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
u AS (SELECT src, translate(regexp_extract(link, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(nullif(regexp_extract(link, '(?s)^.*?://[^/?#]*([^?#]*)', 1), ''), '/') AS path
  FROM (SELECT host AS src, CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END AS link
    FROM (SELECT host, unnest(regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']?((?:https?:)?//[^\s"''<>]+)', 1)) AS link FROM p WHERE host <> ''))),
r AS (SELECT *, @RULE AS rule FROM p),
l AS (SELECT src, host AS dst, count(*) AS weight, count(*) FILTER (WHERE @RULE = 'net/') AS blocked FROM u WHERE host <> '' AND src <> host GROUP BY src, host),
h AS (SELECT host, count(*) FILTER (WHERE rule IN ('example.net/en/', 'org/fr/')) AS allowed, count(*) FILTER (WHERE rule = 'net/') AS blocked FROM r WHERE host <> '' GROUP BY host),
s AS (SELECT 'trust' AS kind, host, allowed AS mass FROM h WHERE allowed > 0 AND blocked = 0 UNION ALL SELECT 'distrust', host, blocked FROM h WHERE blocked > 0
  UNION ALL SELECT 'distrust', dst, sum(blocked) FROM l WHERE dst NOT IN (SELECT host FROM h) GROUP BY dst HAVING sum(blocked) > 0),
t AS (SELECT kind, a, b, weight / sum(weight) OVER (PARTITION BY kind, a) AS share FROM (SELECT 'trust' AS kind, src AS a, dst AS b, weight FROM l UNION ALL SELECT 'distrust', dst, src, weight FROM l)),
m AS (SELECT kind, host, CAST(0.15 * mass AS DOUBLE) AS m FROM s UNION ALL
  SELECT x.kind, t.b, sum(0.85 * t.share * x.m) FROM (SELECT *, sum(m) OVER (PARTITION BY kind) AS moving FROM m) x JOIN t ON t.kind = x.kind AND t.a = x.host WHERE x.moving >= 1e-6 GROUP BY x.kind, t.b),
f AS (SELECT host, coalesce(sum(m) FILTER (WHERE kind = 'trust'), 0) AS trust, coalesce(sum(m) FILTER (WHERE kind = 'distrust'), 0) AS distrust FROM m GROUP BY host)
SELECT page_id, r.host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN distrust > 0 AND distrust > 0.5 * (trust + distrust) THEN 'block' ELSE 'allow' END AS verdict FROM r LEFT JOIN f ON f.host = r.host
""".replace("@RULE", _RULE)
QUERIES = {"op6_url_filter": op6_url_filter}
ORACLES = {"op6_url_filter": ORACLE}
