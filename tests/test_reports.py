"""Contexts, citations, summaries and reports."""
from pyspark.sql import functions as F

from corpusflow.operators import changes as ch, checks as ck, context as cx, issues as iss
from corpusflow.plans import retrieve as rt

c = F.col
META = "map<string,string>"


def test_context_and_citations(spark):
    docs = spark.createDataFrame([
        (1, 0, "Page content 1", {"url": "https://example.git", "branch": "main", "source": "file1.py"}),
        (1, 1, "Page content 2", {"source": "source2.py"}), (2, 0, "Other", {"source": "s", "title": "Title"})],
        f"qid long, rank int, page_content string, metadata {META}")
    got = {(r.qid, r.id): r.doc for r in cx.format_context(docs, ["qid"], ["rank"]).collect()}
    assert got == {(1, 0): "<doc id='0'>Page content 1</doc>", (1, 1): "<doc id='1'>Page content 2</doc>", (2, 0): "<doc id='0'>Other</doc>"}
    cited = cx.citations(docs, ["qid"], ["rank"])
    assert sorted(tuple(r) for r in cited.collect()) == [
        (1, 0, "https://example/-/blob/main/file1.py", "Page content 1 ..."), (1, 1, "source2.py", "Page content 2 ..."), (2, 0, "s", "Title")]
    arrays = {r.qid: [s.id for s in r.sources] for r in cx.citation_arrays(cited, ["qid"]).collect()}
    assert arrays == {1: [0, 1], 2: [0]}
    assert {r.qid: len(r.sources) for r in cx.citation_arrays(cited, ["qid"], top_n=1).collect()} == {1: 1, 2: 1}


def test_summarise_sources(spark):
    rows = [("confluence", "spaces", "space1", 0), ("confluence", "spaces", "space2", 1), ("gitlab", "groups", "group1", 0),
            ("gitlab", "projects", "project1", 0), ("web", "links", "http://example.com", 0), ("other", "x", "y", 0)]
    df = spark.createDataFrame(rows, "source_type string, identifier_type string, identifier string, ord int")
    want = ["- Confluence spaces: space1, space2", "- GitLab Groups: group1", "- GitLab repositories: project1",
            "- Relevant documentation and resources available at: http://example.com"]
    rows = cx.summarise_sources(df)
    assert sorted(tuple(r) for r in rows.where("section = 0").collect()) == [(0, -1, "- Confluence spaces: "), (0, 0, "space1"), (0, 1, "space2")]
    assert cx.summary_text(rows).first().summary == "\n  ".join(want)
    assert cx.summary_text(cx.summarise_sources(df.where("source_type <> 'gitlab'"))).first().summary == "\n  ".join([want[0], want[3]])
    assert cx.summary_text(rows, top_n=1).first().summary.startswith("- Confluence spaces: space1\n")


def test_compress_context(spark):
    hits = spark.createDataFrame([(1, "a b", 1, "a b c\nx y\n\nb"), (1, "a b", 2, "z\na b")], "qid long, query string, rank int, page_content string")
    rows = {r.ref: (r.page_content, r.words) for r in cx.compress_context(hits, budget=6).collect()}
    # best first: "a b", "a b c", then "b"
    assert rows == {0: ("a b c\nb", 4), 1: ("a b", 2)}
    rows = {r.ref: r.page_content for r in cx.compress_context(hits, budget=2).collect()}
    assert rows == {1: "a b"}
    documents = spark.createDataFrame([(1, 0, "m0")], "qid long, ref long, mark string")
    tagged = spark.createDataFrame([(1, 0, "t"), (1, -1, "u"), (1, 9, "v")], "qid long, ref long, text string")
    assert {r.text: r.mark for r in cx.restore_metadata(tagged, documents).collect()} == {"t": "m0", "u": None, "v": None}


def test_trace_and_tools(spark):
    steps = spark.createDataFrame([(1, 1, "b", "2", "y"), (1, 0, "a", "1", "x")], "run long, step int, tool string, tool_input string, observation string")
    assert sorted(tuple(r) for r in cx.render_trace(steps, ["run"], ["step"]).collect()) == [
        (1, 0, "<tool>a</tool><tool_input>1</tool_input><observation>x</observation>"), (1, 1, "<tool>b</tool><tool_input>2</tool_input><observation>y</observation>")]
    tools = spark.createDataFrame([("z", "last"), ("m", "math")], "name string, description string")
    assert sorted(tuple(r) for r in cx.tool_list(tools).collect()) == [(0, "m: math"), (1, "z: last")]
    assert cx.last_result(steps, ["run"], "step", ["tool", "observation"]).collect()[0][1:] == ("b", "y")


def test_answer_context_routes_questions_without_source(spark):
    questions = spark.createDataFrame([("q1", "What?", "Human: hi"), ("q2", "Why {context}?", "")], "qid string, question string, history string")
    hits = spark.createDataFrame([("q1", 1, "First. Rest", {"source": "s1"}), ("q1", 2, "Second", {"source": "s2"})],
                                 f"qid string, rank int, page_content string, metadata {META}")
    rows = {r.qid: r for r in rt.answer_context(questions, hits, "sys").collect()}
    assert rows["q1"].context == "<doc id='0'>First. Rest</doc>\n<doc id='1'>Second</doc>"
    assert [tuple(s) for s in rows["q1"].sources] == [(0, "s1", "First ..."), (1, "s2", "Second ...")]
    assert rows["q2"].context == "" and rows["q2"].sources == [] and "Why {context}?" in rows["q2"].prompt


def test_issue_report(spark):
    issues = spark.createDataFrame([
        ("E-1", None, "Epic", "Epic one", "Open", None, "Ann", None), ("S-1", "E-1", "Story", "Story one", "Open", "Desc", "Ann", "Bo"),
        ("T-1", "S-1", "Task", "Task one", "Done", None, "Cy", None), ("T-2", "missing", "Task", "Task two", "Done", None, "Cy", None)],
        "key string, parent string, issuetype string, summary string, status string, description string, reporter string, assignee string")
    comments = spark.createDataFrame([("S-1", 2, "Bo", "later "), ("S-1", 1, "Ann", "first"), ("X-9", 1, "No", "body")],
                                     "key string, ord long, author string, body string")
    parents = {r.key: r.parent_text for r in iss.with_parent(issues).collect()}
    assert parents == {"E-1": "No parent issue", "S-1": "No parent issue", "T-1": "S-1: Story one", "T-2": "No parent issue"}
    texts = {(r.key, r.ord): r.comment for r in iss.with_comments(issues, comments).collect()}
    assert texts == {("E-1", None): "None", ("S-1", 1): "Ann: first", ("S-1", 2): "Bo: later", ("T-1", None): "None", ("T-2", None): "None"}
    reports = {}
    for r in iss.issue_report(issues, comments).orderBy("section", "ord").collect():
        reports.setdefault(r.key, []).append(r.text)
    assert set(reports) == {"E-1", "S-1", "T-1", "T-2"}
    assert "\n".join(reports["S-1"]) == (
        "\n**Title**: Story one\n**Key**: S-1\n**Status**: Open\n**Description**: Desc\n**Reporter**: Ann\n**Assignee**: Bo\n"
        "**Comments**: \nAnn: first\nBo: later\n**Parent Issue Summary**: \nNo parent issue\n")
    assert reports["T-1"][1:] == ["None", "**Parent Issue Summary**: \nS-1: Story one\n"]


def _review(spark):
    person = "struct<name:string,username:string>"
    mrs = spark.createDataFrame(
        [("m1", "T", "Ann", "ann", "opened", "d1", "d2", "dev", "main", ["x", "y"], None, 2, [1], "u", "ok", False, [("Bo", "bo"), ("Cy", "cy")]),
         ("m2", "U", "Ann", "ann", "opened", "d1", "d2", "dev", "main", [], "success", 0, [], "u", "ok", True, [])],
        "mr string, title string, author_name string, author_username string, state string, created_at string, updated_at string, source_branch string, "
        "target_branch string, labels array<string>, pipeline_status string, approvals_required int, approved_by array<int>, web_url string, "
        f"merge_status string, first_contribution boolean, assignees array<{person}>")
    changes = ch.with_line_counts(spark.createDataFrame(
        [("m1", i, f"f{i}", i == 0, i == 1, i == 2, i == 3, "+a\n-b\n-c") for i in range(30)],
        "mr string, ord int, new_path string, new_file boolean, renamed_file boolean, deleted_file boolean, generated_file boolean, diff string"))
    return mrs, changes


def test_mr_report(spark):
    mrs, changes = _review(spark)
    rows = {}
    for r in ch.mr_report(mrs, changes).orderBy("section", "ord").collect():
        rows.setdefault(r.mr, []).append(r.text)
    assert len(rows["m1"]) == 32
    reports = {mr: "\n".join(texts) for mr, texts in rows.items()}
    lines = reports["m1"].split("\n")
    assert lines[:5] == ["Merge Request Details:", "Title: T", "Author: Ann (ann)", "State: opened", "Created At: d1"]
    assert lines[8:21] == ["Labels: x, y", "Pipeline Status: None", "Approvals Required: 2", "Approvals Received: 1", "Web URL: u", "Merge Status: ok",
                           "First Contribution: false", "Assignees:", "- Bo (bo)", "- Cy (cy)", "", "Changes:", "File: f0"]
    assert lines[21:30] == ["  - Lines Added: 1", "  - Lines Removed: 2", "  - Change Type: New File", "  - Generated File: No", "  - Diff:", "+a", "-b", "-c", ""]
    assert lines[-4:] == ["Statistics:", "Total Files Changed: 30", "Total Lines Added: 30", "Total Lines Removed: 60"]
    assert [x.split(": ")[1] for x in lines if "Change Type" in x][:4] == ["New File", "Renamed File", "Deleted File", "Modified"]
    assert reports["m2"].endswith("Assignees:\nNone\n\nChanges:\nStatistics:\nTotal Files Changed: 0\nTotal Lines Added: 0\nTotal Lines Removed: 0")


def test_checks(spark):
    agents = spark.createDataFrame([("Chef",), ("Waiter",), ("Chef",)], "role string")
    tasks = spark.createDataFrame([(1, "Chef"), (2, "Game Engineer"), (3, "Boss")], "id int, role string")
    assert [tuple(r) for r in ck.check_unique(agents, ["role"]).collect()] == [("Chef", 2)]
    boss = spark.createDataFrame([("Boss",)], "role string")
    found = {(r.id, r.violation) for r in ck.check_fk(tasks, agents.unionByName(boss), ["role"], boss).collect()}
    assert found == {(2, "missing"), (3, "forbidden")}
    steps = spark.createDataFrame([("a", 1, "do {input}"), ("a", 2, "then"), ("b", 1, "do"), ("b", 2, "{input}"), ("c", 1, None)], "crew string, ord int, text string")
    assert {r.crew for r in ck.check_first_contains(steps, "crew", "ord", "text", "{input}").collect()} == {"b", "c"}
    crews = spark.createDataFrame([("a",), ("z",)], "crew string")
    assert [tuple(r) for r in ck.check_min_count(crews, steps, "crew").collect()] == [("z", 0)]
    config = spark.createDataFrame([(1, "u", "p"), (0, None, "p"), (None, None, None)], "size int, username string, password string")
    rules = {"size": ck.positive("size"), "user": ck.required("username"), "pair": ck.both_or_neither("username", "password")}
    assert {r.rule: r.violations for r in ck.check_predicates(config, rules).collect()} == {"size": 2, "user": 2, "pair": 1}
    types = spark.createDataFrame([("web",), ("ftp",), (None,)], "t string")
    assert {r.t for r in ck.check_domain(types, "t", ["web"]).collect()} == {"ftp", None}
