"""Incremental indexing: what is new, changed, unchanged or removed, and the changes to the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plan_index(current: DataFrame, recorded: DataFrame) -> DataFrame:
    """current(path, content_hash), recorded(path, content_hash null) -> (path, status).

    new: not recorded; unchanged: recorded with the same hash; changed: with another or with null (retry); removed:
    recorded only. Repeated paths count once (of several hashes the greatest); null paths are left out.
    """
    now = current.where("path is not null").groupBy("path").agg(F.max("content_hash").alias("hash"))
    old = recorded.where("path is not null").groupBy("path").agg(F.max("content_hash").alias("old_hash"))
    both = now.withColumn("here", F.lit(True)).join(old.withColumn("there", F.lit(True)), "path", "full_outer")
    status = (
        F.when(F.col("there").isNull(), "new").when(F.col("here").isNull(), "removed")
        .when(F.col("hash") == F.col("old_hash"), "unchanged").otherwise("changed")
    )
    return both.select("path", status.alias("status"))


def plan_counts(plan: DataFrame) -> DataFrame:
    """One row: how many of each status, and whether the index is stale."""
    n = lambda s: F.count_if(F.col("status") == s)
    return plan.agg(n("new").alias("new"), n("changed").alias("changed"), n("unchanged").alias("unchanged"), n("removed").alias("removed"), (n("new") + n("changed") + n("removed") > 0).alias("stale"))


def files_to_index(plan: DataFrame) -> DataFrame:
    """The paths to parse again: new and changed."""
    return plan.where(F.col("status").isin("new", "changed")).select("path")


def replace_rows(stored: DataFrame, fresh: DataFrame, key: str = "file_path") -> DataFrame:
    """The stored rows of all files that `fresh` does not hold, and the fresh rows: one anti join on distinct keys."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def remove_files(stored: DataFrame, gone: DataFrame, key: str = "file_path") -> DataFrame:
    """The stored rows without those of the files in gone(path)."""
    return stored.join(gone.select(F.col("path").alias(key)).distinct(), key, "left_anti")


def tracked_only(stored: DataFrame, files: DataFrame, key: str = "file_path") -> DataFrame:
    """The stored rows whose file is recorded in files(path)."""
    return stored.join(files.select(F.col("path").alias(key)).distinct(), key, "left_semi")


def untracked(stored: DataFrame, files: DataFrame, key: str = "file_path") -> DataFrame:
    return stored.join(files.select(F.col("path").alias(key)).distinct(), key, "left_anti")
