"""Column expressions over build logs and diffs."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# Terminal escape sequence; added and removed lines of a unified diff.
ANSI_ESCAPE = r"\x1B\[[0-?]*[ -/]*[@-~]"
ADDED_LINE = r"(?md)^\+[^+]"
REMOVED_LINE = r"(?md)^-(?!-)"


def strip_ansi(c: Column) -> Column:
    return F.regexp_replace(c, ANSI_ESCAPE, "")


def diff_counts(diff: Column) -> tuple[Column, Column]:
    """``(lines added, lines removed)`` of a diff text; file header lines do not count."""
    text = F.coalesce(diff, F.lit(""))
    return (F.regexp_count(text, F.lit(ADDED_LINE)).cast("bigint"),
            F.regexp_count(text, F.lit(REMOVED_LINE)).cast("bigint"))


def change_type(new: Column, renamed: Column, deleted: Column) -> Column:
    return (F.when(new, "New File").when(renamed, "Renamed File")
            .when(deleted, "Deleted File").otherwise("Modified"))
