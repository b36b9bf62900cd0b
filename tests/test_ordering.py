"""Work inside groups: pieces of a hot group must give what one window gives."""
import bisect
import json
import random

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import context as cx, logs as lg
from corpusflow.operators.ordering import first_rows, number_rows, top_rows, with_blocks

c = F.col


@pytest.fixture(scope="module")
def groups(spark):
    rng = random.Random(5)
    sizes = {"hot": 150, "warm": 40, "one": 1, None: 12}
    rows = [(k, i, f"t{i}") for k, n in sizes.items() for i in range(n)]
    rng.shuffle(rows)
    return sizes, spark.createDataFrame(rows, "k string, o long, t string").repartition(6)


def test_number_rows_split(groups, tight):
    sizes, df = groups
    rows = number_rows(df, ["k"], ["o"]).collect()
    assert len(rows) == sum(sizes.values())
    assert all(r.n == r.o for r in rows)
    assert sorted(r.n for r in number_rows(df.where("k = 'hot'"), [], ["o"]).collect()) == list(range(150))
    down = number_rows(df, ["k"], [c("o").desc()]).collect()
    assert all(r.n == sizes[r.k] - 1 - r.o for r in down)


def test_blocks_have_their_neighbours(groups, tight):
    _, df = groups
    blocked = with_blocks(number_rows(df.where("k = 'hot'"), ["k"], ["o"]), "n", 3, 2).collect()
    assert sorted(r.n for r in blocked if r._home) == list(range(150))
    for b in range(10):
        have = {r.n for r in blocked if r._block == b}
        assert have >= set(range(max(0, 16 * b - 3), min(150, 16 * b + 16 + 2)))


def test_top_and_first_rows(groups):
    sizes, df = groups
    assert {(r.k, r.o) for r in top_rows(df, ["k"], ["o"], 2).collect()} == {(k, i) for k, n in sizes.items() for i in range(min(2, n))}
    assert {(r.k, r.o) for r in first_rows(df, ["k"], [c("o").desc()]).collect()} == {(k, n - 1) for k, n in sizes.items()}


# --- chat history ----------------------------------------------------------------------------

def _conversations(spark):
    rows = [(k, 3 * i, ("user", "assistant", "system", "tool")[i % 4], f"m{i}") for k, n in ((1, 70), (2, 3)) for i in range(n)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)


def _history(k):
    names = {0: "Human", 1: "AI", 2: "System", 3: "tool"}
    return {(key, 3 * i): "\n".join(f"{names[j % 4]}: m{j}" for j in range(max(0, i - 2 * k), i)) for key, n in ((1, 70), (2, 3)) for i in range(n)}


@pytest.mark.parametrize("k", [1, 5])
def test_chat_history(spark, k):
    got = {(r.conv_id, r.turn): r.history for r in cx.chat_history(_conversations(spark), k).collect()}
    assert got == _history(k)


@pytest.mark.parametrize("k", [1, 5])
def test_chat_history_split(spark, tight, k):
    got = {(r.conv_id, r.turn): r.history for r in cx.chat_history(_conversations(spark), k).collect()}
    assert got == _history(k)


# --- logs -------------------------------------------------------------------------------------

def _log(seed, n, density):
    rng = random.Random(seed)
    return [("WARN " if rng.random() < density else "ok ") + str(i) for i in range(n)]


LOGS = {1: _log(1, 130, 0.05), 2: _log(2, 200, 0.4), 3: ["WARN x"] * 97, 4: _log(4, 7, 0.5), 5: ["ok"], 6: ["WARN only"],
        7: ["WARN"] + ["ok"] * 3 + ["WARN"] * 30 + ["ok"] * 40 + ["WARN"]}
STATUS = {j: "failed" if j in (2, 6) else "success" for j in LOGS}


def _windows(lines):
    """The first match opens a window, and so does the first one at least five lines after the last that did."""
    matches = [n for n, x in enumerate(lines) if "WARN" in x]
    opened = []
    while matches:
        opened.append(matches[0])
        matches = matches[bisect.bisect_left(matches, matches[0] + 5):]
    return [(n, "\n".join(lines[max(n - 5, 0):n + 5])) for n in opened]


def _lines(spark):
    rows = [(j, i, x) for j, lines in LOGS.items() for i, x in enumerate(lines)]
    return spark.createDataFrame(rows, "job long, n long, line string").repartition(5)


def _check_context(spark):
    got = {}
    for r in lg.log_context(_lines(spark), lg.warning_line(c("line"))).orderBy("job", "line_no").collect():
        got.setdefault(r.job, []).append((r.line_no, r.context))
    assert got == {j: w for j, x in LOGS.items() if (w := _windows(x))}


def test_log_context(spark):
    _check_context(spark)


def test_log_context_split(spark, tight):
    _check_context(spark)


def test_log_context_golden(spark):
    lines = spark.range(30).select(F.lit(1).alias("job"), c("id").alias("n"),
                                   F.when(c("id").isin(3, 5, 7, 9, 20), "WARNING").otherwise("fine").alias("line"))
    got = [(r.line_no, r.context.count("\n") + 1) for r in lg.log_context(lines, lg.warning_line(c("line"))).orderBy("line_no").collect()]
    assert got == [(3, 8), (9, 10), (20, 10)]


def _check_summary(spark):
    jobs = spark.createDataFrame(list(STATUS.items()), "job long, status string")
    got = {r.job: r for r in lg.job_summary(jobs, _lines(spark), lg.warning_line(c("line"))).collect()}
    assert set(got) == set(LOGS)
    for j, lines in LOGS.items():
        failed = STATUS[j] == "failed"
        windows = [] if failed else [w for _, w in _windows(lines)]
        assert got[j].warnings_count == len(windows)
        assert (got[j].warnings_sample or []) == windows[:5]
        assert got[j].errors_count == int(failed)
        assert got[j].errors_sample == (["\n".join(lines[-30:])] if failed else None)


def test_job_summary(spark):
    _check_summary(spark)


def test_job_summary_split(spark, tight, monkeypatch):
    monkeypatch.setattr(lg, "_MERGE", 2)
    _check_summary(spark)


def _check_section(spark):
    start, end = "section_start:12:step_script\r", "section_end:15:step_script"
    other = "section_start:13:upload"
    log = ["a", start, "b", other, "c", end, "d", end, start, start, "e"] + ["f"] * 40 + ["section_end:16:upload", end] + ["g"] * 20 + [start] + ["h"] * 30
    want, inside = [], False
    for i, x in enumerate(log):
        if x == start or x == end:
            inside = x == start
        elif inside:
            want.append((i, x))
    jobs = spark.createDataFrame([(1, "\n".join(log)), (2, "no\nmarks")], "job long, log string")
    lines = lg.job_lines(jobs)
    got = [(r.n, r.line) for r in lg.log_section(lines, lg.section_marks(c("line"))).where("job = 1").orderBy("n").collect()]
    assert got == want
    assert lg.log_section(lines, lg.section_marks(c("line"))).where("job = 2").count() == 0


def test_log_section(spark):
    _check_section(spark)


def test_log_section_split(spark, tight):
    _check_section(spark)


def test_log_tail(spark):
    got = {r.job: r.tail for r in lg.log_tail(_lines(spark)).collect()}
    assert got == {j: "\n".join(x[-30:]) for j, x in LOGS.items()}


def test_pipeline_report(spark):
    jobs = spark.createDataFrame([(1, "p", 2, 0, ["w", "v"]), (2, "p", 0, 1, None), (3, "q", 0, 0, None)],
                                 "job long, pipeline string, warnings_count long, errors_count long, warnings_sample array<string>")
    got = {(r.pipeline, r.section, r.ord): json.loads(r.text)
           for r in lg.pipeline_report(jobs, ["pipeline"], cols=["warnings_count", "warnings_sample"]).collect()}
    assert got == {("p", 0, None): {"total_jobs": 2, "total_warnings": 2, "total_errors": 1}, ("q", 0, None): {"total_jobs": 1, "total_warnings": 0, "total_errors": 0},
                   ("p", 1, 1): {"job": 1, "warnings_count": 2, "warnings_sample": ["w", "v"]}, ("p", 1, 2): {"job": 2, "warnings_count": 0},
                   ("q", 1, 3): {"job": 3, "warnings_count": 0}}
