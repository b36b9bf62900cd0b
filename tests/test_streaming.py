"""Streams give what one batch over all arrived rows gives."""
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import index as ix, logs as lg
from corpusflow.plans.retrieve import document_chunks
from corpusflow.session import scratch_path
from corpusflow.streaming import job_rollup as jr, polling as po

c = F.col


@pytest.fixture
def folder(spark, tmp_path):
    """Three files of polled issues; later files repeat earlier ids."""
    for i, ids in enumerate(([1, 2, 3], [3, 4], [1, 5, 5])):
        df = spark.createDataFrame([(x, f"2024-01-01 0{i}:00:00", x % 2 == 0) for x in ids], "id long, at string, flag boolean")
        df.withColumn("at", c("at").cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / f"poll{i}.parquet"))
    return str(tmp_path)


def _stream(spark, folder):
    return po.read_table_stream(spark, folder + "/*", "*.parquet", files_per_batch=1)


def test_track_new_is_exact(spark, folder):
    seen = po.drain_to_table(po.track_new(_stream(spark, folder).select("id"), ["id"]), "seen")
    assert sorted(r.id for r in seen.collect()) == [1, 2, 3, 4, 5]


def test_track_new_bounded(spark, folder):
    stream = po.track_new(_stream(spark, folder), ["id"], delay="5 hours")
    assert sorted(r.id for r in po.drain_to_table(stream, "seen").collect()) == [1, 2, 3, 4, 5]


@pytest.fixture(params=[1, 1000])
def backward(spark, tmp_path, request):
    """Five files of five rows each, every file dated earlier than the one before."""
    for i in range(5):
        df = spark.createDataFrame([(5 * i + k, f"2024-01-0{5 - i} 0{k}:00:00") for k in range(5)], "id long, at string")
        df.withColumn("at", c("at").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / f"poll{i}.parquet"))
    return lambda: po.read_table_stream(spark, str(tmp_path) + "/*", "*.parquet", files_per_batch=request.param)


def test_no_first_row_is_lost_in_any_order(spark, backward):
    twice = po.track_new(backward().unionByName(backward()), ["id"], delay="1 hour")
    assert sorted(r.id for r in po.drain_to_table(twice, "seen").collect()) == list(range(25))
    counts = po.stream_job_counts(backward(), ["id"], {"n": F.lit(True)}, time_col="at", window="1 day").collect()
    assert {(r.window_start.day, r.id): r.n for r in counts} == {(5 - i // 5, i): 1 for i in range(25)}


def test_job_counts_add_up_over_batches(spark, folder):
    rows = po.stream_job_counts(_stream(spark, folder), ["flag"], {"n": F.lit(True)}, time_col="at", window="1 hour").collect()
    assert {(r.window_start.hour, r.flag): r.n for r in rows} == {(0, False): 2, (0, True): 1, (1, False): 1, (1, True): 1, (2, False): 3}


def test_stream_index_and_change_signal(spark, tmp_path):
    source = str(tmp_path / "docs")
    path, state = scratch_path(spark, "ix"), scratch_path(spark, "state")

    def arrive(rows):
        spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema("doc_id long, text string, source string").parquet(source)
        po.stream_index(stream, path, document_chunks, state).awaitTermination()

    assert po.changed_since(spark, path, 0) == (False, 0)
    arrive([(1, "one", "a"), (2, "two", "b")])
    run()
    assert sorted(r.page_content for r in ix.read_index(spark, path).collect()) == ["one", "two"]
    changed, version = po.changed_since(spark, path, 0)
    assert changed and po.changed_since(spark, path, version) == (False, version)
    arrive([(3, "three", "a"), (1, "one", "a")])
    run()
    assert sorted(r.page_content for r in ix.read_index(spark, path).collect()) == ["one", "three", "two"]
    assert po.changed_since(spark, path, version)[0]


def test_refresh_job(spark):
    configured = spark.createDataFrame([("h1", "web", "links", "u1"), ("h2", "web", "links", "u2"), ("h3", "web", "links", "u3")],
                                       "hash string, source_type string, identifier_type string, identifier string")
    local = spark.createDataFrame([("h1", "x")], "hash string, label string")
    due = []

    def ingest(df):
        due.append({r.hash for r in df.collect()})
        return df.where("hash <> 'h3'")  # one source fails and stays due
    labels = {r.hash: r.label for r in po.refresh_job(configured, local, ingest).collect()}
    assert labels == {"h2": "web: links=u2"} and due == [{"h2", "h3"}]
    po.refresh_job(configured, local, ingest, force=True)
    assert due[1] == {"h1", "h2", "h3"}


def test_empty_streams(spark, tmp_path):
    nothing = str(tmp_path / "none")
    spark.createDataFrame([], "id long, at timestamp, flag boolean").write.parquet(nothing)
    stream = spark.readStream.schema("id long, at timestamp, flag boolean").parquet(nothing)
    assert po.stream_job_counts(stream, ["flag"], {"n": F.lit(True)}, time_col="at", window="1 hour").collect() == []
    assert po.drain_to_table(po.track_new(stream, ["id"]), "seen").collect() == []


# --- the log roll-up as lines arrive ---------------------------------------------------------------------

def _logs(spark, lengths, seed=2):
    """Lines ``(job, n, line)`` of logs; about a tenth of them warn."""
    import random
    rng = random.Random(seed)
    rows = [(job, n, ("WARN " if rng.random() < 0.1 else "ok ") + f"{job}.{n}") for job, length in enumerate(lengths) for n in range(length)]
    return rows, spark.createDataFrame(rows, "job long, n long, line string")


def _arrive(spark, rows, folder, files, order):
    import random
    rows = list(rows)
    random.Random(order).shuffle(rows)
    for i in range(files):
        spark.createDataFrame(rows[i::files], "job long, n long, line string").coalesce(1).write.mode("append").parquet(folder)


def _stated(df):
    return {r.job: (r.warnings_count, r.errors_count, r.warnings_sample, r.errors_sample) for r in df.collect()}


@pytest.mark.parametrize("files,per_batch,order", [(1, 1, 0), (5, 1, 1), (5, 2, 2), (3, 100, 3)])
def test_job_roll_up_is_that_of_all_lines(spark, tight, tmp_path, files, per_batch, order):
    rows, lines = _logs(spark, [0, 1, 16, 17, 33, 100, 21])
    jobs = spark.createDataFrame([(j, "failed" if j in (2, 5) else "success") for j in range(7)], "job long, status string")
    folder = str(tmp_path / "lines")
    _arrive(spark, rows + rows[5:40], folder, files, order)  # some lines are polled twice
    stream = po.read_table_stream(spark, folder, "*.parquet", files_per_batch=per_batch)
    got = _stated(jr.stream_job_summary(stream, jobs, lg.warning_line(c("line"))))
    assert got == _stated(lg.job_summary(jobs, lines, lg.warning_line(c("line"))))
    assert got[0] == (0, 0, None, None) and got[5][3] == ["\n".join(r[2] for r in rows if r[0] == 5 and r[1] >= 70)]


def test_job_roll_up_between_batches(spark, tight, tmp_path):
    """After each batch the summary is that of the lines so far; a status may change at any time."""
    rows, _ = _logs(spark, [40, 25])
    folder, out, state = (str(tmp_path / x) for x in ("lines", "out", "state"))
    jobs = spark.createDataFrame([(0, "running"), (1, "running")], "job long, status string")
    for i, upto in enumerate((10, 17, 40)):
        new = [r for r in rows if (0, 10, 17)[i] <= r[1] < upto]
        spark.createDataFrame(new, "job long, n long, line string").coalesce(1).write.mode("append").parquet(folder)
        stream = po.read_table_stream(spark, folder, "*.parquet", files_per_batch=1)
        jr.stream_job_blocks(stream, lg.warning_line(c("line")), out, state).awaitTermination()
        so_far = spark.createDataFrame([r for r in rows if r[1] < upto], "job long, n long, line string")
        assert _stated(jr.read_job_summary(spark, out, jobs)) == _stated(lg.job_summary(jobs, so_far, lg.warning_line(c("line"))))
    failed = jobs.withColumn("status", F.lit("failed"))
    assert _stated(jr.read_job_summary(spark, out, failed)) == _stated(lg.job_summary(failed, so_far, lg.warning_line(c("line"))))


def test_complete_blocks_leave_the_state(spark, tight, tmp_path):
    rows, _ = _logs(spark, [64])
    folder, out, state = (str(tmp_path / x) for x in ("lines", "out", "state"))
    _arrive(spark, rows, folder, 1, 0)
    run = lambda: jr.stream_job_blocks(po.read_table_stream(spark, folder, "*.parquet"), lg.warning_line(c("line")), out, state).awaitTermination()
    run()
    first = spark.read.parquet(out).count()
    _arrive(spark, rows, folder, 1, 1)  # everything again
    run()
    again = spark.read.parquet(out).where("batch = 1")
    assert first == 5 and {r._block for r in again.collect()} <= {3, 4}  # only blocks with lines still to come speak again


def test_a_table_of_several_files_is_a_stream(spark, tmp_path):
    """A table is a folder named like the file it is elsewhere, beside other tables."""
    spark.createDataFrame([(i, f"text {i}", "a") for i in range(6)], "doc_id long, text string, source string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, "other", "b")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "others.parquet"))
    stream = po.read_table_stream(spark, str(tmp_path), "documents.parquet", files_per_batch=1)
    path = scratch_path(spark, "ix")
    po.stream_index(stream, path, document_chunks, scratch_path(spark, "state")).awaitTermination()
    assert sorted(r.page_content for r in ix.read_index(spark, path).collect()) == [f"text {i}" for i in range(6)]
