"""Column functions against the same rules in plain Python, on many random texts."""
import random
import re

from pyspark.sql import functions as F

from corpusflow.functions import changes as ch, text as tx
from corpusflow.operators import context as cx

c = F.col


def texts(alphabet, n=600, longest=14, seed=11):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(longest))) for _ in range(n)]


def test_extract_ref(spark):
    def by_hand(s):
        s = s.strip()
        if not s:
            return None, None
        for pattern in (r"\A(?:<#)?(?:ref)?([0-9]+)(?:#>?)?", r"(?:<#)?(?:ref)?([0-9]+)(?:#>?)?\Z"):
            found = re.search(pattern, s)
            if found:
                return (s[:found.start()] + s[found.end():]).strip(), int(found[1])
        return s, -1
    rows = texts(["<#", "ref", "1", "20", "#>", "#", " ", "a", "\n", "<"])
    df = spark.createDataFrame([(s,) for s in rows], "s string")
    clean, ref = tx.extract_ref(c("s"))
    for r in df.select("s", clean.alias("t"), ref.alias("r")).collect():
        assert (r.t, r.r) == by_hand(r.s), repr(r.s)


def test_source_suffix(spark):
    def by_hand(s):
        if not s.endswith("%") or s.count("%") < 2:
            return s, "none"
        message, label, _ = s.rsplit("%", 2)
        return message.strip(), label.strip()
    df = spark.createDataFrame([(s,) for s in texts(["%", " ", "a", "\n", "b c", "\t"])], "s string")
    message, label = tx.parse_source_suffix(c("s"))
    for r in df.select("s", message.alias("m"), label.alias("l")).collect():
        assert (r.m, r.l) == by_hand(r.s), repr(r.s)


def test_diff_counts(spark):
    df = spark.createDataFrame([(s,) for s in texts(["+", "-", "\n", "\r", "a", "++", "--", " "])], "s string")
    added, removed = ch.diff_counts(c("s"))
    for r in df.select("s", added.alias("a"), removed.alias("d")).collect():
        assert (r.a, r.d) == (len(re.findall(r"^\+[^+]", r.s, re.M)), len(re.findall(r"^-(?!-)", r.s, re.M))), repr(r.s)


def test_snippet_and_strip(spark):
    df = spark.createDataFrame([(s,) for s in texts([".", " ", "a", "\n", " ", "b", " "])], "s string")
    for r in df.select("s", tx.snippet(c("s"), F.lit(None).cast("string")).alias("x"), tx.strip(c("s")).alias("p")).collect():
        assert r.x == r.s.strip().split(".")[0] + " ..." and r.p == r.s.strip()


def test_strip_ansi(spark):
    df = spark.createDataFrame([(s,) for s in texts(["\x1b", "[", "0", ";", "m", "K", " ", "a", "\x1b[31m", "?"])], "s string")
    for r in df.select("s", ch.strip_ansi(c("s")).alias("x")).collect():
        assert r.x == re.sub(r"\x1B\[[0-?]*[ -/]*[@-~]", "", r.s)


def test_contexts_of_long_lists_have_the_shape_of_short_ones(spark, tight):
    docs = spark.range(40).select(F.lit("q").alias("qid"), c("id").alias("rank"), F.concat(F.lit("text "), "id").alias("page_content"),
                                  F.create_map(F.lit("source"), F.lit("s")).alias("metadata"))
    rows = cx.format_context(docs, ["qid"], ["rank"])
    assert sorted((r.id, r.doc) for r in rows.collect()) == [(i, f"<doc id='{i}'>text {i}</doc>") for i in range(40)]
    cited = cx.citations(docs, ["qid"], ["rank"])
    assert sorted(r.id for r in cited.collect()) == list(range(40))
    assert [[s.id for s in r.sources] for r in cx.citation_arrays(cited, ["qid"], 7).collect()] == [list(range(7))]


def test_links_resolve_as_the_standard_says(spark):
    """Links as pages have them: absolute, of the same host, of the same site, relative or a query."""
    import random
    from urllib.parse import urljoin

    from corpusflow.functions import urls as ur
    rng = random.Random(11)
    paths = ["/".join(rng.choices(["a", "b.html", "..", ".", "c d"], k=rng.randrange(1, 5))) for _ in range(300)]
    links = [rng.choice(["", "/", "//h.example/", "https://o.example/", "?x=1&y=", "./", "../"]) + p + rng.choice(["", "/", "?q=1"]) for p in paths]
    bases = ["https://s.example/x/y/z.html", "http://s.example", "https://s.example/", "https://s.example/x?b=2"]
    rows = [(b, x) for b in bases for x in links]
    df = spark.createDataFrame(rows, "base string, link string")
    for r in df.select("base", "link", ur.resolve_url(c("base"), c("link")).alias("x")).collect():
        assert r.x == urljoin(r.base, r.link), (r.base, r.link)
