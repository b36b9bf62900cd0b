"""Files and repository snapshots as documents."""
from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corpusflow.functions.text import file_parts
from corpusflow.operators.ordering import top_rows
from corpusflow.session import materialized
from corpusflow.sources.documents import require_rows
from corpusflow.sources.tree import read_tree

# File types, size in MB and number of files accepted in one upload.
UPLOAD_TYPES = [".txt", ".pdf", ".json", ".yaml", ".yml", ".xls", ".xlsx", ".docx", ".doc"]
UPLOAD_MAX_MB = 10
UPLOAD_MAX_FILES = 5

# Types whose bytes are the text itself.
TEXT_TYPES = [".txt", ".json", ".yaml", ".yml"]


def scan_files(spark: SparkSession, path: str, exts: Sequence[str] = tuple(TEXT_TYPES)) -> DataFrame:
    """Each file of the given types is one document; no file at all is an error."""
    require_rows(read_tree(spark, path, exts, content=False), f"no document found in {path}")
    files = read_tree(spark, path, exts)
    source = F.concat(F.lit(path.rstrip("/") + "/"), "path")
    # bytes that are not UTF-8 are replaced, so that one bad file does not lose the others
    return files.select(F.make_valid_utf8(F.col("content").cast("string")).alias("page_content"),
                        F.create_map(F.lit("source"), source).alias("metadata"), source.alias("source"))


def filter_uploads(df: DataFrame, exts: Sequence[str] = tuple(UPLOAD_TYPES), max_mb: int = UPLOAD_MAX_MB,
                   max_files: int = UPLOAD_MAX_FILES, *, path_col: str = "path", length_col: str = "length",
                   keys: Sequence[str] = ()) -> DataFrame:
    """Files an upload accepts: known type, not too large, the first few per upload (``keys``)."""
    fits = df.where(F.lower(file_parts(F.col(path_col))[1]).isin(*exts)
                    & (F.col(length_col) <= max_mb * 1024 * 1024))
    if keys:
        return top_rows(fits, keys, [path_col], max_files, "_place").drop("_place")
    return fits.orderBy(path_col).limit(max_files)


def ignore_pattern(rule: str) -> str:
    """One ignore rule (``*.log``, ``/build/``, ``docs/**/x?``) as a regex over relative paths."""
    folder_only = rule.endswith("/")
    body = rule.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    out = ""
    for token in re.findall(r"\*\*/|/\*\*\Z|\*\*|\*|\?|\[[^\]]*\]|.", body):
        out += {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(
            token, token if token.startswith("[") else re.sub(r"([\\.^$|+(){}])", r"\\\1", token))
    return ("^" if anchored else "(?:^|/)") + out + ("/" if folder_only else "(?:/|$)")


def drop_ignored(files: DataFrame, rules: Sequence[str], path_col: str = "path") -> DataFrame:
    """Drop files by ignore rules; a later rule wins and ``!rule`` takes a file back in."""
    ignored: Column = F.lit(False)
    for rule in rules:
        if not rule.strip() or rule.startswith("#"):
            continue
        keep = rule.startswith("!")
        hit = F.col(path_col).rlike(ignore_pattern(rule[1:] if keep else rule))
        ignored = F.when(hit, F.lit(not keep)).otherwise(ignored)
    return files.where(~ignored)


def ignore_rules(rules: DataFrame, repo_col: str = "repo", ord_col: str = "ord", rule_col: str = "rule") -> DataFrame:
    """``(repo, _groups)``: the rules of each repository as patterns, the rule that counts most first.

    Neighbouring rules that all drop, or all take back, are one pattern, so thousands of rules are a few tests a file.
    """
    @F.arrow_udf("string")
    def pattern(column: pa.Array) -> pa.Array:
        return pa.array([ignore_pattern(rule) for rule in column.to_pylist()], pa.string())

    rule = F.col(rule_col)
    keep = rule.startswith("!")
    used = rules.where(F.trim(rule) != "").where(~rule.startswith("#")).select(
        repo_col, ord_col, keep.alias("_keep"), pattern(F.when(keep, F.substr(rule, F.lit(2))).otherwise(rule)).alias("_pattern"))
    by_repo = Window.partitionBy(repo_col).orderBy(ord_col)
    turn = F.when(F.lag("_keep").over(by_repo) == F.col("_keep"), 0).otherwise(1)
    grouped = (used.withColumn("_turn", turn).withColumn("_group", F.sum("_turn").over(by_repo)).groupBy(repo_col, "_group", "_keep")
               .agg(F.array_join(F.collect_list(F.concat(F.lit("(?:"), "_pattern", F.lit(")"))), "|").alias("_pattern")))
    return grouped.groupBy(repo_col).agg(F.sort_array(F.collect_list(F.struct("_group", "_keep", "_pattern")), asc=False).alias("_groups"))


def drop_ignored_by_repo(files: DataFrame, rules: DataFrame, *, repo_col: str = "repo", path_col: str = "path", ord_col: str = "ord",
                         rule_col: str = "rule") -> DataFrame:
    """Drop files by the ignore rules ``(repo, ord, rule)`` of their repository; of the rules that fit a file the last decides.

    One row per repository meets the files; its size is known, so Spark sends it to them where it is small. Files of
    a repository without rules all stay.
    """
    groups = materialized(ignore_rules(rules, repo_col, ord_col, rule_col), "rules")
    first = F.filter("_groups", lambda g: F.regexp_like(F.col(path_col), g["_pattern"]))
    joined = files.join(groups, repo_col, "left")
    ignored = F.coalesce(~F.try_element_at(first, F.lit(1))["_keep"], F.lit(False))
    return joined.where(~ignored).select(*files.columns)


def scan_repo(spark: SparkSession, root: str, url: str, branch: str, rules: Sequence[str] = ()) -> DataFrame:
    """Every UTF-8 file below ``root`` that no ignore rule names, with its repository metadata."""
    files = drop_ignored(read_tree(spark, root, skip=[".git/"]), rules)
    files = files.where(F.is_valid_utf8(F.col("content").cast("string")))
    name, ext = file_parts(F.col("path"))
    return files.select(
        F.col("content").cast("string").alias("page_content"),
        F.create_map(F.lit("url"), F.lit(url), F.lit("branch"), F.lit(branch), F.lit("source"), F.col("path"),
                     F.lit("file_name"), name, F.lit("file_type"), ext).alias("metadata"),
        F.col("path").alias("source"))

