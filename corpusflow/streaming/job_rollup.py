"""The roll-up of build logs on lines as they arrive, in any batches and any order.

A log is kept in blocks of bounded length, each with the few lines next to it, so a long job spreads over many
keys. The state of a block is the lines that have come so far. With every batch a touched block says what
it holds for each way the block before may leave off; once all its lines are there they are
dropped from state. Reading takes the newest word of each block and settles blocks in order, as the batch
roll-up does.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusflow.operators import logs as lg
from corpusflow.operators.ordering import block_rows, with_blocks
from corpusflow.session import read_or_empty, scratch_path

_STATE = "done boolean, ns array<bigint>, lines array<string>, hits array<boolean>"
_BLOCK = "_block bigint, counts array<bigint>, leaves array<bigint>, samples array<array<string>>, tail array<struct<n:bigint,line:string>>"


def _windows(ns: np.ndarray, lines: list[str | None], hits: np.ndarray, first: int, size: int) -> tuple[list, list, list]:
    """Counts, where the last window leaves off, and samples of a block that begins at ``first``, for each carry."""
    home = np.flatnonzero(hits & (ns >= first) & (ns < first + size))
    offsets = (ns[home] - first).tolist()
    counts, leaves, samples = [], [], []
    for reach in range(lg.CONTEXT_LINES):
        count, sample = 0, []
        for place, offset in zip(home.tolist(), offsets, strict=True):
            if offset < reach:
                continue
            reach = offset + lg.CONTEXT_LINES
            count += 1
            if len(sample) < lg.SAMPLES:
                sample.append("\n".join(x for x in lines[max(place - lg.CONTEXT_LINES, 0):place + lg.CONTEXT_LINES] if x is not None))
        counts.append(count)
        leaves.append(max(reach - size, 0))
        samples.append(sample)
    return counts, leaves, samples


def block_words(stream: DataFrame, matches: Column, job: str = "job", n: str = "n", line: str = "line", tail_rows: int = lg.TAIL_LINES) -> DataFrame:
    """What touched blocks hold, as a stream in update mode; a block is complete when it and the lines next to it are there."""
    size = block_rows(stream)
    before, after = lg.CONTEXT_LINES, lg.CONTEXT_LINES - 1
    rows = with_blocks(stream.select(job, F.col(n).cast("bigint").alias("n"), F.col(line).alias("line"), matches.alias("hit")), "n", before, after)
    job_type = stream.schema[job].dataType.simpleString()

    def take(key: tuple, arrived: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, *have = state.get if state.exists else (False, [], [], [])
        if done:
            return  # lines that are polled again
        held = {place: (text, bool(hit)) for place, text, hit in zip(*have, strict=True)}
        for part in arrived:
            held.update(zip(part["n"].tolist(), zip(part["line"].tolist(), part["hit"].fillna(False).astype(bool).tolist(), strict=True), strict=True))
        places = sorted(held)
        texts, hits = [held[p][0] for p in places], [held[p][1] for p in places]
        first = int(key[1]) * size
        whole = range(max(first - before, 0), first + size + after)
        complete = len(places) == len(whole)
        state.update((True, [], [], []) if complete else (False, places, texts, hits))
        counts, leaves, samples = _windows(np.array(places), texts, np.array(hits, bool), first, size)
        tail = [{"n": p, "line": x} for p, x in zip(places, texts, strict=True) if first <= p < first + size][-tail_rows:]
        yield pd.DataFrame({job: [key[0]], "_block": [key[1]], "counts": [counts], "leaves": [leaves], "samples": [samples], "tail": [tail]})

    return rows.groupBy(job, "_block").applyInPandasWithState(
        take, f"`{job}` {job_type}, {_BLOCK}", _STATE, "update", GroupStateTimeout.NoTimeout)


def stream_job_blocks(stream: DataFrame, matches: Column, out: str, checkpoint: str, job: str = "job", n: str = "n", line: str = "line"):
    """Run ``block_words`` over all that has arrived into the table ``out``; a repeated batch is written anew."""
    def add(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (block_words(stream, matches, job, n, line).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(add).start())


def read_job_summary(spark: SparkSession, out: str, jobs: DataFrame, job: str = "job", status: str = "status") -> DataFrame:
    """Jobs with what ``job_summary`` says of all lines that have arrived so far.

    ``jobs`` may be as of now: a job's status decides on reading whether it reports its tail or its warnings.
    """
    job_type = jobs.schema[job].dataType.simpleString()
    words = read_or_empty(spark, out, f"`{job}` {job_type}, {_BLOCK}, batch bigint")
    newest = words.groupBy(job, "_block").agg(F.max_by(F.struct("counts", "leaves", "samples", "tail"), "batch").alias("_w")).select(job, "_block", "_w.*")
    failed = jobs.where(F.col(status) == lg.FAILED).select(job)
    others = newest.join(failed, job, "left_anti")
    settled = lg.carry_over(others.select(job, "_block", F.col("leaves").alias("_leaves"), "counts", "samples"), job)
    blocks = settled.select(job, F.col("_block").alias("_place"), F.col("counts")[F.col("_carry").cast("int")].alias("_count"),
                            F.col("samples")[F.col("_carry").cast("int")].alias("_sample"))
    lines = newest.join(failed, job, "left_semi").select(job, F.explode("tail").alias("_t")).select(job, "_t.*")
    return lg.summary_of(jobs, blocks, lg.log_tail(lines, lg.TAIL_LINES, job), job)


def stream_job_summary(stream: DataFrame, jobs: DataFrame, matches: Column, job: str = "job", n: str = "n", line: str = "line") -> DataFrame:
    """The roll-up of all lines that have arrived, by way of scratch tables."""
    spark = stream.sparkSession
    out = scratch_path(spark, "job-blocks")
    stream_job_blocks(stream, matches, out, scratch_path(spark, "job-blocks-state"), job, n, line).awaitTermination()
    return read_job_summary(spark, out, jobs, job)
