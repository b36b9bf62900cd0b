"""URL filters by host-suffix and path-prefix expressions, in DataFrame functions only.

A rule names a host and a path and fits the host, its subdomains and every path that begins so. Each
URL is expanded into the expressions that a rule could have, joined on a short prefix of their hash,
confirmed by the whole digest, and the longest rule wins.
"""
from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The rules of the contract (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Verdict where no rule fits.
DEFAULT = "allow"
PREFIX = 8


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null and for text without ``://``."""
    rest = F.regexp_extract(url, r"(?s)\A.*?://(.*)\z", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*(/[^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict of every URL.

    ``rules`` (verdict, host, path) may be a list of any length: URLs and rules meet in an equi-join.
    Only host depths and path lengths that occur among the rules are expanded, so an expansion has at
    most as many rows as there are such pairs, however long the URL. Of rules of equal length the longer
    host wins, then ``block``. Each distinct URL is judged once, which also settles hot URLs; a null URL
    has empty parts and the default verdict. Columns of ``pages`` that have the new names are replaced.
    """
    host, path = url_parts(F.col(url_col))
    rules = rules.select(F.coalesce("verdict", F.lit("block")).alias("verdict"), F.coalesce("host", F.lit("")).alias("rule_host"),
                         F.coalesce("path", F.lit("")).alias("rule_path")).where("rule_host <> ''").distinct()
    # how deep hosts and how long paths of rules are: one row of two short lists (depth <= 127, length <= 2,083)
    depths, lengths = rules.agg(F.sort_array(F.collect_set(F.size(F.split("rule_host", r"\.")))),
                                F.sort_array(F.collect_set(F.length("rule_path")))).first()
    names = [F.substring_index("_host", ".", -d) for d in depths] or [F.lit("")]
    starts = F.array(*[F.when(F.length("_path") >= n, F.substring("_path", 1, n)) for n in lengths] or [F.lit(None).cast("string")])
    expanded = (pages.select(F.col(url_col).alias("_url")).where("_url is not null").distinct()
                .withColumns({"_host": url_parts(F.col("_url"))[0], "_path": url_parts(F.col("_url"))[1]})
                .select("_url", F.explode(F.array_distinct(F.array(*names))).alias("_name"), starts.alias("_starts"))
                .select("_url", "_name", F.explode(F.array_distinct(F.filter("_starts", lambda x: x.isNotNull()))).alias("_start"))
                .select("_url", F.sha2(F.concat("_name", "_start"), 256).alias("_digest"), F.length("_name").alias("_name_length"))
                .withColumn("_short", F.substring("_digest", 1, PREFIX)))
    listed = rules.select("verdict", F.concat("rule_host", "rule_path").alias("rule"), F.length("rule_host").alias("host_length"),
                          F.sha2(F.concat("rule_host", "rule_path"), 256).alias("digest"))
    best = (expanded.join(listed.withColumn("_short", F.substring("digest", 1, PREFIX)), "_short")
            .where("_digest = digest and _name_length = host_length")
            .groupBy("_url").agg(F.max(F.struct(F.length("rule"), "host_length", "verdict", "rule")).alias("_best")))
    judged = pages.drop(*[c for c in ("host", "path", "rule", "verdict", "_url", "_best") if c in pages.columns])
    return (judged.join(best, judged[url_col] == best["_url"], "left")
            .withColumns({"host": host, "path": path, "rule": F.col("_best.rule"), "verdict": F.coalesce("_best.verdict", F.lit(default))})
            .drop("_url", "_best"))


def rules_sql(rules: list[tuple[str, str, str]] = RULES) -> str:
    """The rules as a DuckDB relation ``(verdict, host, path)``."""
    return "(VALUES " + ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules) + ") r(verdict, host, path)"


def drop_blocked(pages: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """The rows of ``pages`` whose URL is allowed."""
    judged = judge_urls(pages.select(F.col(url_col).alias("_u")).distinct(), rules, url_col="_u")
    blocked = judged.where("verdict = 'block'").select("_u")
    return pages.join(blocked, pages[url_col] == blocked["_u"], "left_anti")

