"""Group trees and crawls."""
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import graph as gr

c = F.col


def test_expand_groups(spark):
    groups = spark.createDataFrame([("top",), ("mid",)], "group string")
    sub = spark.createDataFrame([("top", "mid"), ("mid", "low"), ("top", "other")], "parent string, group string")
    projects = spark.createDataFrame([("top", "p1"), ("low", "p2"), ("other", "p3"), ("mid", "p2")], "group string, project string")
    got = sorted(tuple(r) for r in gr.expand_groups(groups, sub, projects).collect())
    assert got == [("mid", "p2"), ("mid", "p2"), ("top", "p1"), ("top", "p2"), ("top", "p2"), ("top", "p3")]


def test_deep_group_trees_and_cycles(spark):
    n = 30
    sub = spark.createDataFrame([(str(i), str(i + 1)) for i in range(n)], "parent string, group string")
    projects = spark.createDataFrame([(str(n), "deep")], "group string, project string")
    top = spark.createDataFrame([("0",)], "group string")
    assert [tuple(r) for r in gr.expand_groups(top, sub, projects).collect()] == [("0", "deep")]
    ring = spark.createDataFrame([("a", "b"), ("b", "a")], "parent string, group string")
    with pytest.raises(ValueError, match="cycle"):
        gr.expand_groups(spark.createDataFrame([("a",)], "group string"), ring, projects)
    tail = spark.createDataFrame([("0", "a"), ("a", "b"), ("b", "a")], "parent string, group string")
    assert gr.expand_groups(top, tail, spark.createDataFrame([("b", "p")], "group string, project string")).count() == 1


def _walk(edges, seed, base, max_depth):
    seen, level, depth = {seed: 0}, [seed], 0
    while level and depth <= max_depth:
        depth += 1
        level = [d for s in level for x, d in edges if x == s and d.startswith(base)]
        level = [d for d in dict.fromkeys(level) if d not in seen]
        seen.update({d: depth for d in level})
    return seen


def test_crawl_depth_and_base(spark):
    site = "https://a.b/docs"
    chain = [(f"{site}/{i}" if i else site, f"{site}/{i + 1}") for i in range(20)]
    edges = chain + [(site, "https://a.b/docs2"), (site, "https://c.d/x"), (f"{site}/3", site), (f"{site}/1", f"{site}/9")]
    df = spark.createDataFrame(edges, "src string, dst string")
    seeds = spark.createDataFrame([(site + "/",)], "seed string")
    for max_depth in (0, 2, 10):
        got = {r.url: r.depth for r in gr.crawl_closure(df, seeds, max_depth).collect()}
        assert got == _walk(edges, site, site, max_depth)
        assert max(got.values()) == min(max_depth + 1, max(got.values()))
    assert "https://a.b/docs2" in got and "https://c.d/x" not in got


def test_crawl_from_a_file_uses_its_folder(spark):
    edges = [("https://a.b/x/index.html", "https://a.b/x/p"), ("https://a.b/x/index.html", "https://a.b/y"), ("https://a.b/x/p", "https://a.b/x/q")]
    seeds = spark.createDataFrame([("https://a.b/x/index.html",), ("https://lonely.example",)], "seed string")
    got = {(r.seed, r.url): r.depth for r in gr.crawl_closure(spark.createDataFrame(edges, "src string, dst string"), seeds).collect()}
    assert got == {("https://a.b/x/index.html", "https://a.b/x/index.html"): 0, ("https://a.b/x/index.html", "https://a.b/x/p"): 1,
                   ("https://a.b/x/index.html", "https://a.b/x/q"): 2, ("https://lonely.example", "https://lonely.example"): 0}


def test_link_edges(spark):
    html = ('<a href="/x">x</a><A HREF=\'y?a=1&amp;b=2#z\'>y</A><!-- <a href="/no">n</a> --><a class="k" href="mailto:m">m</a>'
            '<script>"<a href=\'/s\'>"</script><a href="pic.png">p</a><a href="/x#again">x</a><a name="n">n</a>')
    pages = spark.createDataFrame([("https://a.b/c/d", html)], "url string, html string")
    got = {tuple(r) for r in gr.link_edges(pages).collect()}
    assert got == {("https://a.b/c/d", "https://a.b/x"), ("https://a.b/c/d", "https://a.b/c/y?a=1&b=2")}
