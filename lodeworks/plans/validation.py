"""Incremental validation: overlay changed files on a snapshot, and compare issues and scores before and after."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlay(files: DataFrame, changed: DataFrame, deleted: DataFrame) -> DataFrame:
    """files with changed ones in place of theirs, and without the deleted (repo_id, path)."""
    gone = changed.select("repo_id", "path").union(deleted.select("repo_id", "path"))
    return files.join(gone, ["repo_id", "path"], "left_anti").unionByName(changed.select(files.columns))


def new_issues(before: DataFrame, after: DataFrame) -> DataFrame:
    """Issues of after that before has not, by repository, category, file, line and message; nulls equal nulls."""
    keys = ["repo_id", "category", "file", "line", "message"]
    seen = before.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return after.join(seen, on, "left_anti")


def impact(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows (repo_id, category, change) of the categories that both have."""
    b = before.select("repo_id", "category", F.col("score").alias("_b"))
    return after.join(b, ["repo_id", "category"]).select("repo_id", "category", (F.col("score") - F.col("_b")).alias("change"))


def status(repos: DataFrame, drift: DataFrame, strict: bool = False) -> DataFrame:
    """Rows (repo_id, status): fail with an error, warn (fail if strict) with a warning, else pass."""
    worst = drift.groupBy("repo_id").agg(F.bool_or(F.col("severity") == "error").alias("e"), F.bool_or(F.col("severity") == "warning").alias("w"))
    kind = F.when(F.col("e"), "fail").when(F.col("w"), "fail" if strict else "warn").otherwise("pass")
    return repos.select("repo_id").distinct().join(worst, "repo_id", "left").select("repo_id", kind.alias("status"))
