"""Rescan: metadata of files whose identity, size and time did not change is taken over from a stored snapshot.

A snapshot is a folder of versions, each a Parquet table that is complete once its success
mark is there. A rescan joins the listing with the latest version, opens only what is new or
changed, and writes the next version: the files that are there now, so that vanished ones
are gone from it. Earlier versions but one are deleted.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import paths


def identity(device: Column, inode: Column, path: Column, case_insensitive: bool = True) -> Column:
    """Volume and file number where there is one, else the path."""
    return F.when(F.coalesce(inode, F.lit(0)) != 0, F.concat_ws(":", F.lit("id"), device, inode)).otherwise(F.concat(F.lit("path:"), paths.path_key(path, case_insensitive)))


def reuse(listing: DataFrame, snapshot: DataFrame, carried: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``carried`` columns come from the snapshot, and the rows still to be read.

    Both have ident, size, mtime. Snapshot rows with an error are never taken; path and
    readonly are the listing's.
    """
    old = snapshot.where(F.coalesce(F.col("error"), F.lit("")) == "") if "error" in snapshot.columns else snapshot
    old = old.select("ident", "size", "mtime", *carried).dropDuplicates(["ident"])
    same = ["ident", "size", "mtime"]
    return listing.join(old, same), listing.join(old.select(*same), same, "left_anti")


def union_snapshot(reused: DataFrame, read: DataFrame) -> DataFrame:
    return reused.unionByName(read, allowMissingColumns=True)


#: What the content of a file gives; the rest of a row comes from the listing.
CARRIED = ["fmt", "quick", "sha1", "w", "h", "meta"]


def _folder(spark: SparkSession, path: str):
    """A path and its file system, whichever it is on."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, snapshot: str) -> list[int]:
    """Numbers of the complete versions, ascending."""
    at, system = _folder(spark, f"{snapshot}/version=*/_SUCCESS")
    names = [str(found.getPath().getParent().getName()) for found in system.globStatus(at) or []]
    return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"version=(\d+)", n)))


def rescan(files: DataFrame, snapshot: str, read: Callable[[DataFrame], DataFrame], case_insensitive: bool = True) -> tuple[DataFrame, int]:
    """``files`` with CARRIED columns, and how many of them were opened for it.

    ``read`` adds the CARRIED columns to files that must be opened. Files that could not be
    read (``meta.error``) are tried again each time. Where two rescans run at once, the one
    that comes second finds its version there and fails.
    """
    spark = files.sparkSession
    known = versions(spark, snapshot)
    rows = files.withColumn("ident", identity(F.col("device"), F.col("inode"), F.col("path"), case_insensitive))
    opened = Observation("opened")
    if known:
        old = spark.read.parquet(f"{snapshot}/version={known[-1]}").withColumn("error", F.col("meta.error"))
        taken, unread = reuse(rows, old, CARRIED)
        fresh = read(unread).observe(opened, F.count("*").alias("n"))
        now = taken.unionByName(fresh.select(*taken.columns))
    else:
        now = read(rows).observe(opened, F.count("*").alias("n"))
    number = known[-1] + 1 if known else 1
    now.write.parquet(f"{snapshot}/version={number}")
    for stale in known[:-1]:
        at, system = _folder(spark, f"{snapshot}/version={stale}")
        system.delete(at, True)
    return spark.read.parquet(f"{snapshot}/version={number}").drop("ident"), opened.get["n"]


def total_bytes(media: DataFrame) -> DataFrame:
    return media.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"))
