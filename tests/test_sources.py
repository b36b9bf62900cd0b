"""Sources: text, files, repositories, pages."""
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from conftest import plan_text
from corpusflow.sources import documents as sd, files as sf, web as sw

c = F.col


def test_text_source(spark):
    df = spark.createDataFrame([("mock_data", "value", "old")], "data string, key string, source string")
    row = sd.text_source(df, "data", ["key", "source"], F.lit("mock_hash")).first()
    assert row.page_content == "mock_data" and row.metadata == {"key": "value", "source": "mock_hash"} and row.source == "mock_hash"
    stamped = spark.range(1).select(sd.stamp_source(F.create_map(F.lit("source"), F.lit("a"), F.lit("k"), F.lit("v")), F.lit("b")).alias("m")).first().m
    assert stamped == {"k": "v", "source": "b"}


def test_scan_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("Hello\nü")
    (tmp_path / "sub" / "b.JSON").write_text('{"x": 1}')
    (tmp_path / "c.bin").write_bytes(b"\x00")
    rows = {os.path.basename(r.source): r for r in sf.scan_files(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.txt", "b.JSON"} and rows["a.txt"].page_content == "Hello\nü"
    assert rows["a.txt"].metadata == {"source": rows["a.txt"].source}
    with pytest.raises(ValueError, match="no document"):
        sf.scan_files(spark, str(tmp_path), [".yaml"])


def test_scan_repo(spark, tmp_path):
    files = {"README.md": b"# Hi", "src/main.py": b"x = 1\n", "src/deep/.env": b"k", "src/__init__.py": b"", "bad.dat": b"\xc3\x28", "build/out.py": b"o", "a.log": b"l",
             "keep.log": b"k", ".git/config": b"g"}
    for name, content in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    docs = sf.scan_repo(spark, str(tmp_path), "https://h/x.git", "main", ["*.log", "!keep.log", "build/"])
    rows = {r.source: r for r in docs.collect()}
    assert set(rows) == {"README.md", "src/main.py", "src/deep/.env", "src/__init__.py", "keep.log"}
    assert rows["src/main.py"].metadata == {"url": "https://h/x.git", "branch": "main", "source": "src/main.py", "file_name": "main.py", "file_type": ".py"}
    assert rows["src/deep/.env"].metadata["file_type"] == "" and rows["src/main.py"].page_content == "x = 1\n"


@pytest.mark.parametrize("rule,hits", [
    ("*.log", {"a.log", "d/b.log"}), ("/a.log", {"a.log"}), ("d/", {"d/b.log", "d/e/f.txt", "x/d/g"}), ("d/*.log", {"d/b.log"}),
    ("**/f.txt", {"d/e/f.txt", "f.txt"}), ("d/**", {"d/b.log", "d/e/f.txt"}), ("?.log", {"a.log", "d/b.log"}), ("[ab].log", {"a.log", "d/b.log"}),
    ("d/**/f.txt", {"d/e/f.txt"}), ("f.tx", set())])
def test_ignore_rules(spark, rule, hits):
    paths = ["a.log", "d/b.log", "d/e/f.txt", "f.txt", "x/d/g", "logs"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert set(paths) - {r.path for r in sf.drop_ignored(df, [rule]).collect()} == hits


def test_uploads(spark):
    rows = [(f"{i}.txt", 10) for i in range(7)] + [("big.pdf", 11 * 1024 * 1024), ("fits.pdf", 10 * 1024 * 1024), ("a.exe", 1)]
    df = spark.createDataFrame(rows, "path string, length long")
    assert [r.path for r in sf.filter_uploads(df).collect()] == [f"{i}.txt" for i in range(5)]
    assert {r.path for r in sf.filter_uploads(df, max_files=50).collect()} == {f"{i}.txt" for i in range(7)} | {"fits.pdf"}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><h1>Big  &amp; bold</h1>
<p>One <b>two</b> <a href="/x">three</a><br>four</p><script>var a="<p>no</p>";</script><ul><li>first<li>second</ul>
<!-- hidden --><img src="i.png" alt="pic"><ol><li>n1</li><li>n2</li></ol><table><tr><td>a</td><td>b</td></tr></table><div>tail\\</div></body></html>"""


def test_pages_to_documents(spark):
    pages = spark.createDataFrame([("u", PAGE), ("gone", None)], "url string, html string")
    rows = sw.pages_to_documents(pages).collect()
    assert [(r.source, r.metadata) for r in rows] == [("u", {"source": "u"})]
    assert rows[0].page_content == "\n\n".join(["Big & bold", "One two three four", "first", "second", "n1", "n2", "a b", "tail\\"])
    elements = sw.pages_to_documents(pages, mode="elements").orderBy("ord").collect()
    assert [(r.page_content, r.metadata["category"]) for r in elements][:3] == [
        ("Big & bold", "Title"), ("One two three four", "NarrativeText"), ("first", "ListItem")]
    with pytest.raises(Exception, match="cannot read gone"):
        sw.pages_to_documents(pages, on_error="raise").collect()


def test_markup_to_text(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "# Head\n\nSome *em* and **bold** ![p](i.png)[t](u) a\\_b\n- item"), (3, None)], "id int, m string")
    got = {r.id: r.text for r in sw.markup_to_text(df, "m").collect()}
    assert got[1] == "# Big & bold\n\nOne two [three](/x) four\n\n  * first\n  * second\n  1. n1\n  2. n2\n\na b\n\ntail"
    assert got[2] == "# Head\n\nSome em and bold [t](u) a_b\n  * item" and got[3] is None


def test_wiki(spark):
    pages = spark.createDataFrame([("A", "<p>x</p>", False), ("A", "<p>y</p>", True), ("B", "<p>z</p>", False)], "space string, html string, att boolean")
    assert [r.page_content for r in sw.wiki_documents(pages, "A", attachment_col="att").collect()] == ["x"]
    assert sw.wiki_documents(pages).count() == 3


def test_issue_filters_reach_the_scan(spark, tmp_path):
    df = spark.createDataFrame([("P", "Open", "me", 2, "x"), ("P", "Open", "me", 1, "y"), ("Q", "Open", "me", 0, "z")],
                               "project string, status string, assignee string, created int, body string")
    df.write.parquet(str(tmp_path / "issues"))
    found = sd.scan_issues(spark.read.parquet(str(tmp_path / "issues")), "P", "Open", "me").select("created")
    assert [r.created for r in found.collect()] == [1, 2]
    plan = plan_text(found)
    assert "EqualTo(project,P)" in plan and "EqualTo(status,Open)" in plan and "EqualTo(assignee,me)" in plan and "body" not in plan


def test_require_rows_and_counts(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "source string")
    assert sd.require_rows(df, "none").count() == 3
    with pytest.raises(ValueError, match="none"):
        sd.require_rows(df.where("false"), "none")
    assert {r.source: r.documents for r in sd.ingest_counts(sd.union_sources([df, df])).collect()} == {"a": 4, "b": 2}


def test_configured_sources(spark):
    config = spark.createDataFrame([("confluence", ["space1", "space2"], None, None, None), ("gitlab", None, ["group1"], ["project1"], None),
                                    ("web", None, None, None, ["http://example.com"])],
                                   "source_type string, spaces array<string>, groups array<string>, projects array<string>, links array<string>")
    rows = sd.configured_sources(config).collect()
    assert sorted((r.source_type, r.identifier_type, r.identifier, r.ord) for r in rows) == [
        ("confluence", "spaces", "space1", 0), ("confluence", "spaces", "space2", 1), ("gitlab", "groups", "group1", 0),
        ("gitlab", "projects", "project1", 0), ("web", "links", "http://example.com", 0)]
    assert {r.hash for r in rows if r.identifier == "space1"} == {"confluence-" + hashlib.md5(b"space1").hexdigest() + ".source"}


def test_upload_index(spark, tmp_path):
    from corpusflow.plans.uploads import upload_index
    for i in range(7):
        (tmp_path / f"f{i}.txt").write_text(f"text {i}")
    (tmp_path / "a.exe").write_bytes(b"\xff")
    rows = upload_index(spark, str(tmp_path)).collect()
    assert sorted((r.namespace, r.page_content) for r in rows) == [(f"f{i}.txt", f"text {i}") for i in range(5)]
    assert all(len(r.embedding) == 64 for r in rows)
    with pytest.raises(ValueError, match="no file accepted"):
        upload_index(spark, str(tmp_path), max_files=0)
