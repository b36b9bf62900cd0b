"""Review requests: change statistics, reports and comments."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusflow.functions.changes import change_type, diff_counts
from corpusflow.functions.prompts import json_field, render

# Layout of a review report.
HEADER = """Merge Request Details:
Title: {title}
Author: {author_name} ({author_username})
State: {state}
Created At: {created_at}
Updated At: {updated_at}
Source Branch: {source_branch}
Target Branch: {target_branch}
Labels: {labels}
Pipeline Status: {pipeline_status}
Approvals Required: {approvals_required}
Approvals Received: {approvals_received}
Web URL: {web_url}
Merge Status: {merge_status}
First Contribution: {first_contribution}
Assignees:
{assignees}

Changes:"""
CHANGE = """File: {new_path}
  - Lines Added: {lines_added}
  - Lines Removed: {lines_removed}
  - Change Type: {change_type}
  - Generated File: {generated}
  - Diff:
{diff}
"""
STATISTICS = """Statistics:
Total Files Changed: {total_files_changed}
Total Lines Added: {total_lines_added}
Total Lines Removed: {total_lines_removed}"""


def with_line_counts(changes: DataFrame, diff: str = "diff") -> DataFrame:
    added, removed = diff_counts(F.col(diff))
    return changes.withColumn("lines_added", added).withColumn("lines_removed", removed)


def mr_stats(changes: DataFrame, mr: str = "mr") -> DataFrame:
    """Files changed and lines added and removed per request."""
    return changes.groupBy(mr).agg(
        F.count("*").alias("total_files_changed"), F.sum("lines_added").alias("total_lines_added"),
        F.sum("lines_removed").alias("total_lines_removed"))


def _shown(c):
    return F.coalesce(c.cast("string"), F.lit("None"))


def mr_report(mrs: DataFrame, changes: DataFrame, mr: str = "mr", order: str = "ord") -> DataFrame:
    """``(mr, section, ord, text)``: the request (section 0), each of its changes and their totals (2) as text.

    ``mrs``: the columns named in the header, with ``labels`` array<string>, ``approved_by``
    array and ``assignees`` array<struct<name, username>>. ``changes``: mr, ord, new_path,
    new_file, renamed_file, deleted_file, generated_file, diff, lines_added, lines_removed.
    """
    people = F.transform("assignees", lambda a: F.concat(F.lit("- "), a["name"], F.lit(" ("), a["username"], F.lit(")")))
    plain = ["title", "author_name", "author_username", "state", "created_at", "updated_at", "source_branch", "target_branch",
             "pipeline_status", "approvals_required", "web_url", "merge_status", "first_contribution"]
    header = render(
        HEADER, **{c: _shown(F.col(c)) for c in plain}, labels=F.array_join("labels", ", "),
        approvals_received=F.size("approved_by"),
        assignees=F.when(F.size("assignees") > 0, F.array_join(people, "\n")).otherwise("None"))
    entry = render(
        CHANGE, new_path=F.col("new_path"), lines_added=F.col("lines_added"), lines_removed=F.col("lines_removed"),
        change_type=change_type(F.col("new_file"), F.col("renamed_file"), F.col("deleted_file")),
        generated=F.when(F.col("generated_file"), "Yes").otherwise("No"), diff=_shown(F.col("diff")))
    totals = mrs.select(mr).join(mr_stats(changes, mr), mr, "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("total_files_changed", "total_lines_added", "total_lines_removed")}
    none = F.lit(None).cast(changes.schema[order].dataType)
    return (mrs.select(mr, F.lit(0).alias("section"), none.alias("ord"), header.alias("text"))
            .unionByName(changes.select(mr, F.lit(1).alias("section"), F.col(order).alias("ord"), entry.alias("text")))
            .unionByName(totals.select(mr, F.lit(2).alias("section"), none.alias("ord"), render(STATISTICS, **zero).alias("text"))))


def mr_comments(notes: DataFrame, mr: str = "mr", payload: str = "note") -> DataFrame:
    """Comments of requests from their JSON notes: id, body, author, created and updated."""
    note = F.col(payload)
    return notes.select(
        mr, json_field(note, "id").alias("id"), json_field(note, "body").alias("body"),
        json_field(note, "author.username").alias("author"),
        json_field(note, "created_at").alias("created_at"), json_field(note, "updated_at").alias("updated_at"))
