"""Group trees and link graphs, level by level."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusflow.functions.urls import (base_path, clean_url, keep_link, normalize_url, quote_seed, resolve_url, under_base)
from corpusflow.session import materialized
from corpusflow.sources.web import load_pages, page_links

# How deep a crawl follows links.
MAX_DEPTH = 10


def expand_groups(groups: DataFrame, subgroups: DataFrame, projects: DataFrame) -> DataFrame:
    """``(root, project)``: projects of each group and of all groups below it.

    ``groups(group)``, ``subgroups(parent, group)``, ``projects(group, project)``. The tree is
    followed one level per round, however deep; a pair that was reached before is not followed
    again, and a group below itself is an error. Projects join once at the end.
    """
    level = groups.select(F.col("group").alias("root"), "group").distinct()
    members = level
    while True:
        below = (level.withColumnRenamed("group", "parent").join(subgroups.select("parent", "group"), "parent")
                 .select("root", "group").distinct())
        below = materialized(below, "level")
        if not below.where("root = group").isEmpty():
            raise ValueError("the group tree has a cycle")
        level = materialized(below.join(members, ["root", "group"], "left_anti"), "level")
        if level.isEmpty():
            return members.join(projects.select("group", "project"), "group").select("root", "project")
        members = members.unionByName(level)


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Distinct ``(src, dst)`` of the links worth following, absolute and without fragment."""
    links = page_links(pages.select(url_col, html_col), html_col).where(keep_link(F.col("href")))
    return links.select(F.col(url_col).alias("src"), clean_url(resolve_url(F.col(url_col), F.col("href"))).alias("dst")).distinct()


def crawl_closure(edges: DataFrame, seeds: DataFrame, max_depth: int = MAX_DEPTH, seed_col: str = "seed") -> DataFrame:
    """``(seed, url, depth)``: all pages a crawl from each seed visits, with the shortest depth.

    Only links below the seed's base path count. A page at ``max_depth`` is still expanded, so
    pages up to ``max_depth + 1`` are visited. One join per level against the edges; every
    level is written out, so a small one is broadcast to the edges, which then stay in place.
    """
    start = seeds.select(F.col(seed_col).alias("seed"), quote_seed(normalize_url(F.col(seed_col))).alias("url")).distinct()
    start = start.withColumn("base", base_path(F.col("url")))
    edges = materialized(edges.select(F.col("src").alias("url"), "dst").distinct(), "edges")
    frontier = materialized(start.withColumn("depth", F.lit(0)), "level")
    visited = frontier
    for depth in range(max_depth + 1):
        found = (frontier.join(edges, "url").where(under_base(F.col("dst"), F.col("base")))
                 .select("seed", F.col("dst").alias("url"), "base").distinct())
        fresh = found.join(visited.select("seed", "url"), ["seed", "url"], "left_anti")
        frontier = materialized(fresh.withColumn("depth", F.lit(depth + 1)).select("seed", "url", "base", "depth"), "level")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited.select("seed", "url", "depth")


def crawl_documents(pages: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: int = MAX_DEPTH, *, url_col: str = "url",
                    html_col: str = "html") -> DataFrame:
    """``(seed, url, page_content, metadata)``: the pages a crawl visits, as documents of their seed.

    Of several pages stored for one address the one whose markup sorts first counts. A visited page that is
    not stored or cannot be read is a document without text, whose metadata has the ``error``.
    """
    visited = crawl_closure(edges, seeds, max_depth).select("seed", "url")
    stored = pages.groupBy(clean_url(F.col(url_col)).alias("url")).agg(F.min(html_col).alias("html"))
    texts, errors = load_pages(visited.select("url").distinct().join(stored, "url", "left"))
    found = texts.select(F.col("source").alias("url"), "page_content", "metadata").unionByName(errors.select(
        F.col("source").alias("url"), F.lit("").alias("page_content"), F.create_map(F.lit("source"), F.col("source"), F.lit("error"), F.col("error")).alias("metadata")))
    return visited.join(found, "url").select("seed", "url", "page_content", "metadata")
