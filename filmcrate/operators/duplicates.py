"""Exact duplicates: size and hash of the head first, the whole only for what is left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, paths


def eligible(size: Column, kind: Column) -> Column:
    return (size > 0) & (kind != "sidecar")


def candidates(items: DataFrame) -> DataFrame:
    """Items that share size and head hash with another. Groups are counted before they are joined, and the join can be split at a frequent one."""
    rows = items.where(eligible(F.col("size"), F.col("kind")))
    many = rows.groupBy("size", "quick").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(many, ["size", "quick"], "left_semi")


def keep_order() -> list[Column]:
    """Which of equal files stays: most companions, not from a messenger copy, dated by its metadata, not named like a copy, shortest path, key."""
    return [-F.col("n_members"), dates.source_of(F.col("stem")) == "kakao", F.col("basis") != "exif", paths.looks_like_copy(F.col("stem")), F.length("path"), F.col("key")]


def find_exact(items: DataFrame, hash_missing: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """key, dup_of, reason of every item that repeats another.

    ``items``: key, path, stem, size, kind, quick, sha1 ('' or null where unknown), n_members,
    basis. ``hash_missing`` gives (path, sha1) for the files whose head is not the whole; an
    unreadable one drops out and is nobody's duplicate.
    """
    rows = candidates(items)
    if hash_missing is not None:
        unknown = F.coalesce(F.col("sha1"), F.lit("")) == ""
        read = hash_missing(rows.where(unknown)).select(F.col("path").alias("p"), F.col("sha1").alias("h"))
        rows = rows.join(read, F.col("path") == F.col("p"), "left").withColumn("sha1", F.coalesce(F.nullif(F.col("sha1"), F.lit("")), F.col("h"))).drop("p", "h")
    rows = rows.where(F.coalesce(F.col("sha1"), F.lit("")) != "")
    order = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(keep_order())])
    rows = rows.withColumn("_o", order)
    keepers = rows.groupBy("size", "quick", "sha1").agg(F.min_by("path", "_o").alias("dup_of"), F.min("_o").alias("_k"), F.count("*").alias("n")).where("n > 1").drop("n")
    out = rows.join(keepers, ["size", "quick", "sha1"]).where(F.col("_o") != F.col("_k"))
    return out.select("key", "dup_of", F.lit("exact").alias("reason"))


def keepers_by_window(items: DataFrame) -> DataFrame:
    """The same decision as a window: rank in the duplicate set and the path that stays."""
    w = Window.partitionBy("size", "quick", "sha1").orderBy(*keep_order())
    return items.withColumn("rn", F.row_number().over(w)).withColumn("keeper", F.first("path").over(w))
