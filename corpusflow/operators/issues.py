"""Issue reports with comments and parent."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusflow.functions.prompts import render
from corpusflow.functions.text import field_or_none, strip

# Layout of an issue report, a comment and a linked issue.
ISSUE_HEAD = """
**Title**: {title}
**Key**: {key}
**Status**: {status}
**Description**: {description}
**Reporter**: {reporter}
**Assignee**: {assignee}
**Comments**: """
ISSUE_FOOT = """**Parent Issue Summary**: 
{parent}
"""
COMMENT = "{author}: {content}"
LINKED_ISSUE = "{issue_key}: {issue_summary}"
NO_PARENT = "No parent issue"
NO_COMMENTS = "None"
EPIC = "Epic"


def with_parent(issues: DataFrame, key: str = "key", parent: str = "parent", summary: str = "summary",
                issuetype: str = "issuetype") -> DataFrame:
    """Add ``parent_text``: key and summary of the parent; epics and missing parents do not count."""
    parents = (issues.where(F.col(issuetype) != EPIC)
               .select(F.col(key).alias(parent), render(LINKED_ISSUE, issue_key=F.col(key), issue_summary=F.col(summary)).alias("_text")))
    return issues.join(parents, parent, "left").withColumn("parent_text", F.coalesce("_text", F.lit(NO_PARENT))).drop("_text")


def comment_lines(comments: DataFrame, author: str = "author", body: str = "body"):
    return strip(render(COMMENT, author=F.col(author), content=F.col(body)))


def with_comments(issues: DataFrame, comments: DataFrame, key: str = "key", order: str = "ord") -> DataFrame:
    """Issues with a row per comment, ``(..., ord, comment)``; one row ``None`` without a comment."""
    lines = comments.select(key, F.col(order).alias("ord"), comment_lines(comments).alias("comment"))
    return issues.join(lines, key, "left").withColumn("comment", F.coalesce("comment", F.lit(NO_COMMENTS)))


def issue_report(issues: DataFrame, comments: DataFrame, key: str = "key", order: str = "ord") -> DataFrame:
    """``(key, section, ord, text)``: fields (section 0), each comment in order and the parent (2) of every issue."""
    full = with_parent(issues, key)
    head = render(ISSUE_HEAD, title=field_or_none(F.col("summary")), key=F.col(key), status=F.col("status"),
                  description=field_or_none(F.col("description")), reporter=F.col("reporter"),
                  assignee=field_or_none(F.col("assignee")))
    none = F.lit(None).cast(comments.schema[order].dataType)
    return (full.select(key, F.lit(0).alias("section"), none.alias("ord"), head.alias("text"))
            .unionByName(with_comments(issues.select(key), comments, key, order).select(key, F.lit(1).alias("section"), "ord", F.col("comment").alias("text")))
            .unionByName(full.select(key, F.lit(2).alias("section"), none.alias("ord"), render(ISSUE_FOOT, parent=F.col("parent_text")).alias("text"))))
