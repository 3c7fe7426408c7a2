"""URL filters: host-suffix and path-prefix expressions, short hash prefixes, full digests, precedence.

* Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased.
  Path: what follows it up to ``?``, ``#`` or the end. A null URL or one without ``://`` has both empty.
* A rule (host, path, verdict) fits its host and all subdomains, if the URL's path starts with the rule's.
* Expressions: for each shape (labels of the host, characters of the path) that some rule has, the URL's
  host suffix of that many labels and path prefix of that many characters. So no URL is cut short, and
  the number of expressions follows the rules' shapes, not the URL's length.
* Expressions and rules are joined on the first four bytes of their SHA-256; full digests confirm.
* Precedence: the longest rule (host and path) wins, then the longer host, then block over allow.

Each distinct URL is judged once. Few rules are sent to all tasks, if their size is under a bound;
more are joined by shuffles, with the URLs' hot expressions spread over salted copies of the rules.
A URL without a rule gets the default verdict, ``allow``. Null and empty URLs have no host and path, and the
default verdict. Very long URLs are judged whole. Repeated pages keep their rows. An empty table gives an empty
one. Other columns are kept; where pages have a column named like a new one, it stays as it is, and the new
one is named ``url_host``, ``url_path``, ``url_rule`` or ``url_verdict`` (an error if that is there too).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import cut, skew_join

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
BROADCAST_RULES = 50_000  # rules that may be sent to all tasks; longer lists are shuffled
MAX_RULE_CHARS = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\x00"), path), 256)


def _labels(host: Column) -> Column:
    return F.size(F.split(host, "\\."))


def judge(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """(url, host, path, rule, verdict) for each distinct url."""
    named = rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), "verdict").distinct()
    named = cut(named.withColumn("digest", _digest(F.col("r_host"), F.col("r_path"))).withColumn("prefix", F.substring("digest", 1, 8)))
    sizes = named.agg(F.count("*").alias("n"), F.max(F.length("r_host") + F.length("r_path")).alias("chars")).first()
    # the distinct shapes are bounded by the longest rule, and sent to all tasks as a literal
    shapes = [(r[0], r[1]) for r in named.select(_labels(F.col("r_host")), F.char_length("r_path")).distinct().collect()]
    judged = urls.select(F.col(url_col).alias("url")).distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not shapes:
        return judged.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    kinds = F.array(*[F.struct(F.lit(a).alias("labels"), F.lit(b).alias("chars")) for a, b in shapes])
    fits = F.filter(kinds, lambda s: (s["labels"] <= _labels(F.col("host"))) & (s["chars"] <= F.char_length("path")))
    said = judged.select("url", F.explode(fits).alias("s"), "host", "path").select(
        "url", F.array_join(F.slice(F.split("host", "\\."), -F.col("s.labels"), F.col("s.labels")), ".").alias("e_host"), F.substring("path", F.lit(1), F.col("s.chars")).alias("e_path")
    )
    said = said.withColumn("e_digest", _digest(F.col("e_host"), F.col("e_path"))).select("url", "e_digest", F.substring("e_digest", 1, 8).alias("prefix"))
    small = sizes["n"] <= BROADCAST_RULES and sizes["chars"] <= MAX_RULE_CHARS
    met = said.join(F.broadcast(named), "prefix") if small else skew_join(said, named, ["prefix"], "url")
    best = (
        met.filter(F.col("digest") == F.col("e_digest"))
        .groupBy("url")
        .agg(F.max(F.struct(F.char_length("r_host") + F.char_length("r_path"), F.char_length("r_host"), F.col("verdict"), F.concat("r_host", "r_path").alias("rule"))).alias("best"))
    )
    return judged.join(best, "url", "left").select("url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict; see the module's head for names that clash."""
    new, there = ["host", "path", "rule", "verdict"], {c.lower() for c in pages.columns}
    names = [f"url_{c}" if c in there else c for c in new]
    if there & {*names}:
        raise ValueError(f"columns {sorted(there & {*names})} are there already")
    judged = judge(pages, rules, url_col, default).toDF("__url", *names)
    rows = pages
    # judged has one row a URL; a URL may repeat in many pages, and adaptive execution splits that side
    return rows.join(judged, rows[url_col].eqNullSafe(judged["__url"]), "left").drop("__url")


def digest(pages: DataFrame, rules: DataFrame) -> DataFrame:
    return filter_urls(pages.select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE = """
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(r_host, r_path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT page_id, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(verdict, length(r_host || r_path)) AS verdict
  FROM u JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY page_id)
SELECT u.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m ON u.page_id = m.page_id
"""
