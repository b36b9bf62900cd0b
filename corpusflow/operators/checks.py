"""Constraint checks: each returns the violations, an empty table means the check holds."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def check_unique(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Values that occur more than once, with their count.

    A first pass counts 8-byte hashes, so that only rows that may have a copy are grouped by
    their full values, which can be long texts.
    """
    hashed = df.select(*cols, F.xxhash64(*cols).alias("_hash"))
    suspect = hashed.groupBy("_hash").count().where("count > 1").select("_hash")
    return hashed.join(suspect, "_hash", "left_semi").groupBy(*cols).agg(F.count("*").alias("n")).where("n > 1")


def check_fk(child: DataFrame, parent: DataFrame, on: Sequence[str], forbid: DataFrame | None = None) -> DataFrame:
    """Child rows without a parent (``missing``) or with a parent they must not use (``forbidden``)."""
    on = list(on)
    missing = child.join(parent.select(*on).distinct(), on, "left_anti").withColumn("violation", F.lit("missing"))
    if forbid is None:
        return missing
    forbidden = child.join(forbid.select(*on).distinct(), on, "left_semi").withColumn("violation", F.lit("forbidden"))
    return missing.unionByName(forbidden)


def check_first_contains(df: DataFrame, group: str, order: str, text: str, token: str) -> DataFrame:
    """Groups whose first row does not contain ``token``."""
    first = df.groupBy(group).agg(F.min_by(text, order).alias("first_text"))
    return first.where(~F.coalesce(F.contains("first_text", F.lit(token)), F.lit(False)))


def check_min_count(parents: DataFrame, children: DataFrame, on: str, n: int = 1) -> DataFrame:
    """Parents with fewer than ``n`` children, with the count."""
    counts = children.groupBy(on).agg(F.count("*").alias("n"))
    return (parents.select(on).join(counts, on, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
            .where(F.col("n") < n))


def check_predicates(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``(rule, violations)`` for all rules in one pass; an undefined rule counts as violated."""
    counts = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])
    return counts.select(F.explode(F.create_map(*[x for name in rules for x in (F.lit(name), F.col(name))])).alias("rule", "violations"))


def positive(col: str) -> Column:
    return F.col(col) > 0


def required(col: str) -> Column:
    return F.col(col).isNotNull() & (F.col(col).cast("string") != "")


def both_or_neither(a: str, b: str) -> Column:
    return F.col(a).isNull() == F.col(b).isNull()


def check_domain(df: DataFrame, col: str, allowed: Sequence[str]) -> DataFrame:
    """Values outside the domain, with their count."""
    return df.where(F.col(col).isNull() | ~F.col(col).isin(*allowed)).groupBy(col).agg(F.count("*").alias("n"))
