"""URL filters: rules of a host suffix and a path prefix, looked up by hashes.

1. A rule is an expression, its host and path in one. A URL is expanded into the expressions that some rule could have:
   suffixes of its host at dots, prefixes of its path. Only the shapes that rules have (so many labels in the host, so
   many characters in the path) are made, so that a long URL has no more expressions than others.
2. Expressions meet rules by the first hex digits of their SHA-256, and count where the whole digests agree.
3. The longest rule that fits decides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hub_bound, hub_join, rename_columns, written

#: The rules of the registered query, (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@dataclass(frozen=True)
class Params:
    """prefix: hex digits of a digest that URLs and rules are joined on. shapes: shapes of expressions made in one pass
    over the URLs; further ones take further passes. sent: rules are sent whole to the tasks (some 200 bytes each) up to
    so many, and joined by a shuffle beyond. default: the verdict on URLs that no rule fits."""

    prefix: int = 8
    shapes: int = 2048
    sent: int = 100_000
    default: str = "allow"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """urls with host (after the first :// up to /, ? or #; A-Z lowered) and path (from there up to ? or #). Both are
    empty where the URL is null or has no ://."""
    at = F.instr(F.col(url_col), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return urls.withColumn("host", host).withColumn("path", path)


def _digested(df: DataFrame, p: Params) -> DataFrame:
    """(host, path, and others) with the digest of the expression (a tab parts host and path; hosts that hold one have it
    before the path's first slash, or the path is empty) and its prefix."""
    digest = F.sha2(F.concat_ws("\t", "host", "path"), 256)
    return df.withColumn("digest", digest).withColumn("prefix", F.substring("digest", 1, p.prefix))


def _shapes(rules: DataFrame) -> DataFrame:
    labels = F.size(F.split("host", r"\."))
    return rules.select(labels.alias("labels"), F.length("path").alias("chars")).distinct()


def verdicts(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", params: Params = Params()) -> DataFrame:
    """pages -> (page_id, host, path, rule, verdict), one row per row; rules: (host, path, verdict allow or block).

    A rule fits its host and the hosts that end with a dot and it, if the URL's path begins with the rule's. Of those that
    fit, the one of most characters (host and path) decides, then that of the longer host; of rules that are alike, block
    goes before allow. Without a rule that fits, rule is null and the verdict the default.

    A null URL, and one without ://, has an empty host and path; only a rule of an empty host fits those. Hosts of rules
    are lowered like those of URLs; rules with a null host, path or verdict don't count. Ids may be null or repeated.
    Other columns are ignored, and either table may be empty.
    """
    p = params
    own = rename_columns(pages, page_id=id_col, url=url_col).withColumn("url", F.col("url").cast("string"))
    # The rows' numbers must not change when a task runs again, and so they are stored.
    own = written(split_url(own.withColumn("row", F.monotonically_increasing_id())).drop("url"))
    known = rename_columns(rules, host="host", path="path", verdict="verdict").dropna()
    known = known.withColumn("host", F.translate("host", _UPPER, _LOWER)).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    known = written(_digested(known.withColumn("rule", F.concat("host", "path")), p))
    few = known.count() <= p.sent

    # Shapes come in groups of a bounded number, an array of one row each.
    shapes = written(_shapes(known))
    passes = max(1, -(-shapes.count() // p.shapes))
    by_prefix = known.groupBy("prefix").agg(F.collect_list(F.struct("digest", "rule", "verdict", F.length("host").alias("of_host"))).alias("rules"))
    found = None
    for i in range(passes):
        some = shapes.where(F.pmod(F.xxhash64("labels", "chars"), F.lit(passes)) == i).agg(F.collect_list(F.struct("labels", "chars")).alias("shapes"))
        parts = own.withColumn("parts", F.split("host", r"\.")).crossJoin(F.broadcast(some))  # of one row
        fits = F.filter("shapes", lambda s: (s["labels"] <= F.size("parts")) & (s["chars"] <= F.length("path")))
        made = parts.select("row", "parts", "path", F.explode(fits).alias("s"))
        made = made.select("row", F.expr("array_join(slice(parts, size(parts) - s.labels + 1, s.labels), '.')").alias("host"), F.expr("substring(path, 1, s.chars)").alias("path"))
        made = _digested(made, p).select("row", "digest", "prefix")
        if few:
            met = made.join(F.broadcast(by_prefix), "prefix")
        else:
            n = made.groupBy("prefix").agg(F.count("*").alias("count"))
            met = hub_join(made, by_prefix, "prefix", "row", n, hub_bound(own.count()))
        met = met.select("row", F.expr("filter(rules, r -> r.digest = digest)").alias("rules")).where("size(rules) > 0")
        met = met.select("row", F.explode("rules").alias("r"))
        found = met if found is None else found.union(met)
    order = F.struct(F.length("r.rule"), F.col("r.of_host"), F.col("r.verdict"), F.col("r.rule"))
    best = found.groupBy("row").agg(F.max_by(F.struct("r.rule", "r.verdict"), order).alias("best"))
    return own.join(best, "row", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(p.default)).alias("verdict"))


def rule_table(spark, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Rules of a list as a table."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def oracle(rules: list[tuple[str, str, str]] = RULES, default: str = "allow") -> str:
    """DuckDB SQL for verdicts() over pages."""
    rows = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return f"""
WITH u AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rhost, rpath, verdict) AS (VALUES {rows}),
best AS (SELECT n, arg_max(rhost || rpath, length(rhost || rpath) * 10000 + length(rhost)) AS rule, arg_max(verdict, length(rhost || rpath) * 10000 + length(rhost)) AS verdict
    FROM s JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, '{default}') AS verdict FROM s LEFT JOIN best USING (n)
"""
