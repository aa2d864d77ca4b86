"""URL rules by hashed expressions.

A rule is a host and a path. Each URL is expanded into every host suffix (at label boundaries, no longer than
the longest rule host) with every path prefix (of the lengths that rule paths have); an expression is
`suffix` + `prefix`. Short prefixes of SHA-256 digests are equi-joined with the rules', full digests confirm, and
the longest rule wins.

Distinct (host, path) pairs are judged, then joined back: a host with a third of all rows is expanded once per
path, and the join back is on the pair, which adaptive execution may split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table


@dataclass(frozen=True)
class Rule:
    """A rule fits its host and all subdomains if the path starts with its path. verdict: allow or block."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
DIGITS = 8  # of the hex digest, in the join


def host_and_path(url):
    """Columns (host, path) of a URL column: empty where it is null or has no `://`."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substr(u, F.instr(u, "://") + 3)).otherwise(F.lit(""))
    bare = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    raw = F.regexp_extract(bare, r"(?s)^([^/]*)", 1)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.substr(bare, F.length(raw) + 1)


def rules_table(spark: SparkSession, rules: tuple[Rule, ...] | list[Rule]) -> DataFrame:
    """(rule, size, verdict, digest); of rules of the same text, a block wins over an allow."""
    rows = sorted({(r.text, len(r.text), r.verdict, len(r.host)) for r in rules})
    df = spark.createDataFrame(rows, "rule string, size int, verdict string, host_size int")
    key = F.concat(F.substr("rule", F.lit(1), F.col("host_size")), F.lit("\n"), F.substr(F.col("rule"), F.col("host_size") + 1))
    return df.withColumn("digest", F.sha2(key, 256)).groupBy("digest").agg(F.max_by(F.struct("rule", "size", "verdict"), "verdict").alias("r")).select("digest", "r.*").withColumn("short", F.substr("digest", F.lit(1), F.lit(DIGITS)))


def expressions(pairs: DataFrame, labels: int, lengths: list[int]) -> DataFrame:
    """pairs (host, path) with one row for each of its expressions and the digest of that expression.

    labels: the most labels that a rule host has; lengths: of rule paths. Both come from the rules, so nothing that
    a rule could match is left out, however many labels or slashes a URL has.
    """
    parts = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."))
    prefix = F.array_distinct(F.filter(F.array(*[F.when(F.length("path") >= n, F.substr("path", F.lit(1), F.lit(n))) for n in lengths]), lambda x: x.isNotNull()))
    rows = pairs.withColumn("prefix", F.explode(prefix)).withColumn("suffix", F.explode(suffix))
    return rows.withColumn("digest", F.sha2(F.concat("suffix", F.lit("\n"), "prefix"), 256)).select("host", "path", "digest", F.substr("digest", F.lit(1), F.lit(DIGITS)).alias("short"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] | list[Rule] = RULES, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with the columns host, path, rule, verdict (under free names if taken: see the returned columns' end).

    Every row comes back once, repeated rows too. Null URLs and such without `://` have an empty host and path, which
    no rule fits: rule null, verdict `default`. Without rules, all get the default.
    Of rules of the same length that fit, a block wins over an allow, and among such the last text in order.
    """
    host, path = host_and_path(F.col(url_col))
    names = {k: free_name(pages, k) for k in ("host", "path", "rule", "verdict")}
    d = pages.withColumn(names["host"], host).withColumn(names["path"], path)
    if not rules:
        return d.withColumn(names["rule"], F.lit(None).cast("string")).withColumn(names["verdict"], F.lit(default))
    pairs = d.select(F.col(names["host"]).alias("host"), F.col(names["path"]).alias("path")).filter("host <> ''").distinct()
    exprs = expressions(pairs, max(r.host.count(".") + 1 for r in rules), sorted({len(r.path) for r in rules}))
    known = rules_table(pages.sparkSession, rules).withColumnRenamed("digest", "rule_digest")
    # no hint: the rules are broadcast if they are below the session's limit
    hits = exprs.join(known, "short").filter("digest = rule_digest")
    found = free_name(d, "found_rule")
    best = hits.groupBy(F.col("host").alias(names["host"]), F.col("path").alias(names["path"])).agg(F.max(F.struct("size", "verdict", "rule")).alias(found))
    out = d.join(best, [names["host"], names["path"]], "left")
    verdict = F.coalesce(F.col(found)["verdict"], F.lit(default))
    return out.select(*pages.columns, names["host"], names["path"], F.col(found)["rule"].alias(names["rule"]), verdict.alias(names["verdict"]))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (
  SELECT page_id, regexp_extract(rest, '^([^?#]*)', 1) AS bare FROM u
), h AS (
  SELECT page_id, bare, regexp_extract(bare, '^([^/]*)', 1) AS raw FROM b
), p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(bare, length(raw) + 1) AS path FROM h
), r(verdict, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), m AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""
ORACLE = {"op7_url_rules": _SQL}
QUERIES = {"op7_url_rules": op7_url_rules}
