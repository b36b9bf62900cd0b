"""Build-log analytics over log lines ``(job, n, line)``, ``n`` counting from 0 in each job."""
from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusflow.functions.changes import strip_ansi
from corpusflow.operators.ordering import block_rows, group_limit, largest_group, top_rows, with_blocks
from corpusflow.session import materialized

# Lines around a warning, lines kept of a failed job, samples per job.
CONTEXT_LINES = 5
TAIL_LINES = 30
SAMPLES = 5
WARNING_MARK = "WARN"
FAILED = "failed"
SECTION = "step_script"
SECTION_START = r"\Asection_start:\d+:(\w+)"
SECTION_END = r"\Asection_end:\d+:(\w+)"

# Blocks whose results are merged at a time.
_MERGE = 1_024


def job_lines(jobs: DataFrame, job: str = "job", log: str = "log") -> DataFrame:
    """Lines of whole logs, escape sequences removed."""
    return jobs.select(job, F.posexplode(F.split(F.col(log), "\n")).alias("n", "line")) \
        .withColumn("n", F.col("n").cast("bigint")).withColumn("line", strip_ansi(F.col("line")))


def section_marks(line: Column, name: str = SECTION) -> Column:
    """``start`` or ``end`` for the marker lines of a section, else null."""
    return (F.when(F.regexp_extract(line, SECTION_START, 1) == name, "start")
            .when(F.regexp_extract(line, SECTION_END, 1) == name, "end"))


def log_section(lines: DataFrame, mark: Column, job: str = "job", n: str = "n") -> DataFrame:
    """Lines after a start mark and before the next end mark; the marks themselves are left out.

    ``mark`` is ``start``, ``end`` or null per line. The state at the start of a block is the
    last mark of the blocks before it, so a long log is worked on block by block.
    """
    size = largest_group(lines, [job])
    marked = lines.withColumn("_mark", mark)
    running = Window.partitionBy(job, "_block").orderBy(n).rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("_block", F.floor(F.col(n) / block_rows(lines)) if size > group_limit(lines) else F.lit(0).cast("bigint"))
    state = F.last("_mark", ignorenulls=True).over(running)
    if size > group_limit(lines):
        earlier = Window.partitionBy(job).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        blocks = (marked.groupBy(job, "_block").agg(F.max_by("_mark", F.when(F.col("_mark").isNotNull(), F.col(n))).alias("_last"))
                  .select(job, "_block", F.last("_last", ignorenulls=True).over(earlier).alias("_carried")))
        marked = marked.join(blocks, [job, "_block"])
        state = F.coalesce(state, F.col("_carried"))
    inside = marked.withColumn("_state", state).where((F.col("_state") == "start") & F.col("_mark").isNull())
    return inside.select(*lines.columns)


def log_tail(lines: DataFrame, rows: int = TAIL_LINES, job: str = "job", n: str = "n", line: str = "line") -> DataFrame:
    """``(job, tail)``: the last lines of each log, joined."""
    last = top_rows(lines.select(job, n, line), [job], [F.col(n).desc()], rows, "_back")
    return last.groupBy(job).agg(F.expr(f"listagg(`{line}`, '\\n') within group (order by `{n}`)").alias("tail"))


def _picked(matches: Column, carry: Column, size: int) -> Column:
    """Windows taken greedily in one block: ``struct<next, picked>``.

    ``matches`` are (offset, context) in order, ``carry`` the first offset not yet covered by a
    window of the block before. A match inside a covered range is passed over.
    """
    start = F.struct(carry.cast("bigint").alias("next"), F.array().cast("array<struct<line_no:bigint,context:string>>").alias("picked"))
    return F.aggregate(matches, start, lambda acc, m: F.when(
        m["line_no"] >= acc["next"],
        F.struct((m["line_no"] + CONTEXT_LINES).cast("bigint").alias("next"), F.concat(acc["picked"], F.array(m)).alias("picked")),
    ).otherwise(acc))


def carry_over(blocks: DataFrame, job: str) -> DataFrame:
    """Add ``_carry``: how far the last window of the block before reaches into this block.

    Every block lists where it would leave off for each possible carry (0 to 4), so one pass
    over blocks, not lines, settles all of them in order.
    """
    job_type = blocks.schema[job].dataType.simpleString()

    def follow(batches):
        last_job = last_block = None
        reach = 0
        for batch in batches:
            carries = []
            for j, b, leaves in zip(batch[job], batch["_block"], batch["_leaves"]):
                if j != last_job or b != last_block + 1:
                    reach = 0
                carries.append(reach)
                reach = int(leaves[reach])
                last_job, last_block = j, b
            yield pd.DataFrame({job: batch[job], "_block": batch["_block"], "_carry": carries})

    steps = blocks.select(job, "_block", "_leaves").repartition(job).sortWithinPartitions(job, "_block")
    carried = steps.mapInPandas(follow, f"`{job}` {job_type}, _block bigint, _carry bigint")
    return blocks.join(carried, [job, "_block"])


def _context_blocks(lines: DataFrame, matches: Column, job: str, n: str, line: str, longest: int) -> DataFrame:
    """``(job, _block, windows)``: the windows around matches, greedily picked, per block.

    No job has more than ``longest`` lines.
    """
    size = block_rows(lines)
    several = longest > size
    base = with_blocks(lines.select(job, n, line, matches.alias("_hit")), n, CONTEXT_LINES, CONTEXT_LINES - 1) if several \
        else lines.select(job, n, line, matches.alias("_hit"), F.lit(0).cast("bigint").alias("_block"), F.lit(True).alias("_home"))
    around = Window.partitionBy(job, "_block").orderBy(n).rowsBetween(-CONTEXT_LINES, CONTEXT_LINES - 1)
    text = F.array_join(F.collect_list(F.col(line)).over(around), "\n")
    hits = base.withColumn("_context", text).where(F.col("_hit") & F.col("_home"))
    blocks = hits.groupBy(job, "_block").agg(F.array_sort(F.collect_list(F.struct(
        (F.col(n) - F.col("_block") * size).cast("bigint").alias("line_no"), F.col("_context").alias("context")))).alias("_found"))
    if several:
        offsets = F.transform("_found", lambda m: F.struct(m["line_no"].alias("line_no"), F.lit(None).cast("string").alias("context")))
        leaves = F.transform(F.sequence(F.lit(0), F.lit(CONTEXT_LINES - 1)),
                             lambda c: F.greatest(_picked(offsets, c, size)["next"] - size, F.lit(0)))
        # read twice, and dear to work out again
        blocks = carry_over(materialized(blocks.withColumn("_leaves", leaves), "blocks"), job)
    else:
        blocks = blocks.withColumn("_carry", F.lit(0))
    return blocks.select(job, "_block", F.transform(
        _picked(F.col("_found"), F.col("_carry"), size)["picked"],
        lambda m: F.struct((m["line_no"] + F.col("_block") * size).alias("line_no"), m["context"].alias("context"))).alias("windows"))


def log_context(lines: DataFrame, matches: Column, job: str = "job", n: str = "n", line: str = "line") -> DataFrame:
    """``(job, line_no, context)``: five lines before each match, the match and four after it.

    The search goes on behind a window, so a match within its range opens no window of its
    own; a window may reach back into the one before.
    """
    blocks = _context_blocks(lines, matches, job, n, line, largest_group(lines, [job]))
    return blocks.select(job, F.explode("windows").alias("w")).select(job, "w.*")


def warning_line(line: Column) -> Column:
    return line.contains(WARNING_MARK)


def job_summary(jobs: DataFrame, lines: DataFrame, matches: Column, job: str = "job", n: str = "n", line: str = "line",
                status: str = "status") -> DataFrame:
    """Jobs with counts and first samples of warnings and errors.

    A failed job reports one error, its tail; any other job its warnings in context.
    """
    state = jobs.select(job, status)
    flagged = lines.join(state, job)
    failed = F.col(status) == FAILED
    blocks = _context_blocks(flagged.where(~failed), matches, job, n, line, largest_group(lines, [job])).select(
        job, F.col("_block").alias("_place"), F.size("windows").cast("bigint").alias("_count"),
        F.slice("windows.context", 1, SAMPLES).alias("_sample"))
    return summary_of(jobs, blocks, log_tail(flagged.where(failed), TAIL_LINES, job, n, line), job)


def summary_of(jobs: DataFrame, blocks: DataFrame, tails: DataFrame, job: str = "job") -> DataFrame:
    """Jobs with the warnings of their blocks ``(job, _place, _count, _sample)`` and their tails."""
    for width in (_MERGE, None):  # many blocks of one job are merged in two steps
        place = F.floor(F.col("_place") / width) if width else F.lit(0).cast("bigint")
        blocks = blocks.groupBy(job, place.alias("_place")).agg(
            F.sum("_count").alias("_count"),
            F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_sample"))), lambda x: x["_sample"])),
                    1, SAMPLES).alias("_sample"))
    warnings = blocks.where("_count > 0").select(job, F.col("_count").alias("warnings_count"), F.col("_sample").alias("warnings_sample"))
    return (jobs.join(warnings, job, "left").join(tails, job, "left")
            .withColumn("warnings_count", F.coalesce("warnings_count", F.lit(0).cast("bigint")))
            .withColumn("errors_count", F.when(F.col("tail").isNotNull(), 1).otherwise(0).cast("bigint"))
            .withColumn("errors_sample", F.when(F.col("tail").isNotNull(), F.array("tail"))).drop("tail"))


def pipeline_summary(jobs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Jobs, warnings and errors per pipeline."""
    return jobs.groupBy(*keys).agg(F.count("*").alias("total_jobs"), F.sum("warnings_count").alias("total_warnings"),
                                   F.sum("errors_count").alias("total_errors"))


def pipeline_report(jobs: DataFrame, keys: Sequence[str], job: str = "job", cols: Sequence[str] = ()) -> DataFrame:
    """``(keys, section, ord, text)`` as JSON: the totals of a pipeline (section 0), then each of its jobs.

    The details of a job are ``cols``, samples included where they are named.
    """
    totals = pipeline_summary(jobs, keys)
    zero = F.lit(None).cast(jobs.schema[job].dataType)
    head = totals.select(*keys, F.lit(0).alias("section"), zero.alias("ord"),
                         F.to_json(F.struct("total_jobs", "total_warnings", "total_errors")).alias("text"))
    return head.unionByName(jobs.select(*keys, F.lit(1).alias("section"), F.col(job).alias("ord"), F.to_json(F.struct(job, *cols)).alias("text")))
