"""Validation rules (2.14) as anti-joins, duplicates, pairings and order checks; each yields findings.

A finding is (rule_id, severity, subject, message). Rules are built from four
patterns, and the table below names which columns of a package each applies to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def findings(df: DataFrame, rule: str, subject: Column, message: str, severity: str = "error") -> DataFrame:
    return df.select(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"), F.lit(message).alias("message"))


def dangling(references: DataFrame, targets: DataFrame, ref: str, target: str, rule: str, severity: str = "error") -> DataFrame:
    """References to what does not exist: I-REL-001, I-REL-003, I-CT-001, I-XREF-001..003, I-STORY-001."""
    known = targets.select(F.col(target).alias("__known")).distinct()
    lost = references.where(F.col(ref).isNotNull()).join(known, F.col(ref) == F.col("__known"), "left_anti")
    return findings(lost.select(ref).distinct(), rule, F.col(ref), "no such target", severity)


def duplicates(df: DataFrame, keys: list[str], rule: str, severity: str = "error") -> DataFrame:
    """Ids that are not unique: I-REL-002, I-ANN-001."""
    twice = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return findings(twice, rule, F.concat_ws("/", *keys), "not unique", severity)


def unpaired(markers: DataFrame, key: str, side: str, rule: str, severity: str = "error") -> DataFrame:
    """Starts without an end and ends without a start: I-ANN-002, I-ANN-003, I-RANGE-001, I-PERM-001."""
    sides = markers.groupBy(key).agg(F.count_if(F.col(side) == "start").alias("s"), F.count_if(F.col(side) == "end").alias("e"))
    return findings(sides.where("s <> 1 or e <> 1"), rule, F.col(key), "start and end do not pair", severity)


def misordered(children: DataFrame, parent: str, pos: str, rank: str, rule: str, severity: str = "warning") -> DataFrame:
    """Children out of schema order: I-ORD-001..005."""
    before = F.lag(rank).over(Window.partitionBy(parent).orderBy(pos))
    return findings(children.withColumn("__before", before).where(F.col("__before") > F.col(rank)).select(parent).distinct(), rule, F.col(parent), "children out of order", severity)


def required(present: DataFrame, column: str, names: list[str], rule: str) -> DataFrame:
    """Required parts that are missing: I-PKG-001..003."""
    wanted = present.sparkSession.createDataFrame([(n,) for n in names], "name string")
    have = present.select(F.lower(column).alias("__have")).distinct()
    return findings(wanted.join(have, F.lower("name") == F.col("__have"), "left_anti"), rule, F.col("name"), "missing")


def out_of_range(df: DataFrame, column: str, low: int, high: int, rule: str, severity: str = "error") -> DataFrame:
    """Ids outside their range: I-ANN-004, I-ANN-006, I-XREF-005."""
    return findings(df.where(~F.col(column).between(low, high)), rule, F.col(column), f"outside {low}..{high}", severity)


def too_many(df: DataFrame, most: int, rule: str, severity: str = "warning") -> DataFrame:
    """I-XREF-004: more definitions than consumers accept."""
    return findings(df.agg(F.count("*").alias("n")).where(F.col("n") > most), rule, F.col("n"), f"more than {most}", severity)


def nested_in(paths: DataFrame, path: str, pattern: str, rule: str) -> DataFrame:
    """Nesting that is not allowed: I-TC-001, I-TC-003, I-DOC-001..003, I-MATH-001."""
    return findings(paths.where(F.col(path).rlike(pattern)), rule, F.col(path), "not allowed here")


def new_findings(before: DataFrame, after: DataFrame) -> DataFrame:
    """Findings that the baseline has not, however often."""
    keys = ["rule_id", "subject"]
    return after.join(before.select(*keys).distinct(), keys, "left_anti")


def verdict(all_findings: DataFrame) -> DataFrame:
    """One row: errors, warnings and whether anything blocks."""
    return all_findings.agg(
        F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), (F.count_if(F.col("severity") == "error") == 0).alias("ok")
    )
