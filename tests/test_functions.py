"""Column functions against literal results and the Python standard library."""
import os
from urllib.parse import quote, urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from corpusflow.functions import changes as ch, prompts as pr, text as tx, urls as ur

c = F.col


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_git_source_and_citation(spark):
    full = F.create_map(F.lit("url"), F.lit("https://example.git"), F.lit("branch"), F.lit("main"), F.lit("source"), F.lit("file.py"))
    no_url = F.create_map(F.lit("branch"), F.lit("main"), F.lit("source"), F.lit("file.py"))
    assert one(spark, tx.git_source(full), tx.git_source(no_url)) == ("https://example/-/blob/main/file.py", "file.py")
    assert one(spark, tx.citation_source(full), tx.citation_source(no_url)) == ("https://example/-/blob/main/file.py", "file.py")


def test_snippet(spark):
    none = F.lit(None).cast("string")
    assert one(spark, tx.snippet(F.lit("Content 1"), none), tx.snippet(F.lit(" A. B. "), F.lit("")), tx.snippet(F.lit("x"), F.lit("T"))) \
        == ("Content 1 ...", "A ...", "T")


@pytest.mark.parametrize("hour,word", [(4, "Hello"), (5, "Good morning"), (6, "Good morning"), (11, "Good morning"), (12, "Good afternoon"),
                                       (13, "Good afternoon"), (17, "Good evening"), (18, "Good evening"), (21, "Hello"), (22, "Hello")])
def test_day_part(spark, hour, word):
    assert one(spark, tx.day_part(F.lit(f"2023-01-01 {hour:02d}:30:00").cast("timestamp"))) == (word,)


def test_source_suffix(spark):
    none = F.lit(None).cast("string")
    assert one(spark, tx.with_source_suffix(F.lit("What is the weather?"), F.lit("yahoo")),
               tx.with_source_suffix(F.lit("Show me the daily summary"), none)) \
        == ("What is the weather? %yahoo%", "Show me the daily summary %none%")
    assert one(spark, *tx.parse_source_suffix(F.lit("hi 5% off %Web: x%"))) == ("hi 5% off", "Web: x")
    assert one(spark, *tx.parse_source_suffix(F.lit("no label"))) == ("no label", "none")
    assert one(spark, *tx.parse_source_suffix(F.lit("just one %"))) == ("just one %", "none")


def test_refs(spark):
    assert one(spark, *tx.extract_ref(F.lit("<#ref0#> Example content <#ref0#>"), compat=False)) == ("Example content", 0)
    assert one(spark, *tx.extract_ref(F.lit("Content with no ref ID."))) == ("Content with no ref ID.", -1)
    assert one(spark, *tx.extract_ref(F.lit("<#ref7#> text"))) == ("text", 7)
    assert one(spark, *tx.extract_ref(F.lit("2023 was dry"))) == ("was dry", 2023)
    assert one(spark, *tx.extract_ref(F.lit("text <#ref12#"))) == ("text", 12)
    assert one(spark, *tx.extract_ref(F.lit(" \n "))) == (None, None)
    assert one(spark, tx.wrap_refs(F.lit("a\n\nb"), F.lit(3))) == ("\n\n<#ref3#> a\nb <#ref3#>\n\n",)


def test_strip_is_python_strip(spark):
    spaces = [chr(i) for i in range(0x3001) if chr(i).isspace()]
    text = "".join(spaces) + "a b" + "".join(reversed(spaces))
    assert one(spark, tx.strip(F.lit(text))) == (text.strip(),)
    assert set(tx.SPACE) == set(spaces)


@pytest.mark.parametrize("path", ["a/b.txt", "b.tar.gz", ".bashrc", "x/.a.b", "x/..a", "noext", "dir.d/file", "end.", "a..b", "x/.a..b"])
def test_file_parts(spark, path):
    name, ext = one(spark, *tx.file_parts(F.lit(path)))
    assert (name, ext) == (os.path.basename(path), os.path.splitext(os.path.basename(path))[1])


def test_diff_counts(spark):
    assert one(spark, *ch.diff_counts(F.lit("+a\n++b\n+\n-c\n--d\n-"))) == (2, 2)
    assert one(spark, *ch.diff_counts(F.lit(None).cast("string"))) == (0, 0)


def test_strip_ansi(spark):
    assert one(spark, ch.strip_ansi(F.lit("\x1b[0K\x1b[31;1mred\x1b[0m plain [x]"))) == ("red plain [x]",)


URLS = ["http://a.b/c/d.html?x=1#f", "https://a.b/c/", "https://a.b", "https://a.b/p;v=1", "https://a.b/p?q", "http://a/b/c/d",
        "http://a/b//c", "HTTP://a.b/x.y/z", "https://a.b/v1.2", "https://a.b/?#"]
HREFS = ["../e/./g?y#z", "x/y", "/q/../r", "//h/x", "#s", "?n", "http://z/", "..", ".", "../../../g", "./", "g//h", "", "g;x=1/../y", "mailto:a@b", "/a b"]


def test_resolve_url_is_urljoin(spark):
    pairs = spark.createDataFrame([(u, h) for u in URLS if "HTTP" not in u for h in HREFS], "u string, h string")
    for r in pairs.select("u", "h", ur.resolve_url(c("u"), c("h")).alias("r")).collect():
        want = urljoin(r.u, r.h)
        assert r.r == want, (r.u, r.h, r.r, want)


def test_base_and_clean(spark):
    def base(url):
        parsed = urlparse(url)
        folder, _, last = parsed.path.rpartition("/")
        out = f"{parsed.scheme}://{parsed.netloc}{folder}" if "." in last else url
        return out.removesuffix("/")
    rows = spark.createDataFrame([(u,) for u in URLS], "u string").select("u", ur.base_path(c("u")).alias("b"), ur.clean_url(c("u")).alias("k"),
                                                                       ur.quote_seed(c("u")).alias("q")).collect()
    for r in rows:
        assert r.b == base(r.u), r.u
        if not r.u.startswith("HTTP"):
            assert r.k == urlparse(r.u)._replace(fragment="").geturl(), r.u
        assert r.q == quote(r.u, safe="/:"), r.u


def test_quote_seed_special(spark):
    text = "https://a.b/ü *~'()!&=+$,;@%20"
    assert one(spark, ur.quote_seed(F.lit(text))) == (quote(text, safe="/:"),)


def test_links_kept(spark):
    links = {"mailto:x": False, "javascript:f()": False, "#top": False, "a.png": False, "a.svg": False, "a.jpg": False, "a.jpeg": False,
             "a.gif": False, "a.PNG": True, "/x": True, "x#y": True}
    rows = spark.createDataFrame([(h,) for h in links], "h string").select("h", ur.keep_link(c("h"))).collect()
    assert dict(tuple(r) for r in rows) == links
    assert one(spark, ur.under_base(F.lit("https://a/docs2"), F.lit("https://a/docs"))) == (True,)


def test_render_keeps_braces_of_values(spark):
    assert one(spark, pr.render("{a} and {b}", a=F.lit("{b}"), b=F.lit(None).cast("string"))) == ("{b} and ",)


def test_prompt_messages(spark):
    plain = '[{"role":"system","content":"s"},{"role":"user","content":[{"type":"text","text":"u\\"q"}]}]'
    assert one(spark, pr.prompt_messages(F.lit("s"), F.lit('u"q'))) == (plain,)
    pictured = pr.prompt_messages(F.lit("s"), F.lit("u"), F.array(pr.data_uri(F.lit("pic").cast("binary"), F.lit("image/jpeg"))))
    assert one(spark, pictured)[0].endswith(
        '{"type":"text","text":"u"},{"type":"image_url","image_url":{"url":"data:image/jpeg;base64,cGlj"}}]}]')
    none = F.lit(None).cast("array<string>")
    assert one(spark, pr.prompt_messages(F.lit("s"), F.lit("u"), none))[0].count("image_url") == 0


def test_parse_queries(spark):
    assert one(spark, tx.parse_queries(F.lit(' ["a b", \'c\']\n'))) == (["a b", "c"],)
