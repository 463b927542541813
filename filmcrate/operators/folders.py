"""Folders a run empties, found without recursion: every file speaks for all folders above it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def ancestors(path: Column, root: Column, own: bool = False) -> Column:
    """Folders strictly between the root and a path (and the path itself, if ``own``), as an array."""
    base = F.rtrim(root, F.lit("/"))
    inner = F.substring(path, F.length(base) + 2, F.length(path))
    parts = F.split(inner, "/")
    last = F.size(parts) - (0 if own else 1)
    found = F.transform(F.sequence(F.lit(1), last), lambda n: F.concat(base, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    none = F.array().cast("array<string>")
    return F.when(path.startswith(F.concat(base, F.lit("/"))) & (last > 0), found).otherwise(none)


def emptied_folders(files: DataFrame, folders: DataFrame, targets: DataFrame, root: str, denied: DataFrame | None = None) -> DataFrame:
    """Paths of folders whose files all are junk or leave, of which at least one leaves, and that no target needs; deepest first.

    ``files``: path, junk, leaving; ``folders``: path; ``targets``: path of files that will
    exist and of folders to keep. A folder above one that could not be listed stays. Counts per folder
    are summed on each side before the shuffle, so a root with very many files below is no hot key.
    """
    top = F.lit(root)
    rows = files.select(F.explode(ancestors(F.col("path"), top)).alias("folder"), (F.col("junk") | F.col("leaving")).alias("ok"), (F.col("leaving") & ~F.col("junk")).alias("leaves"))
    blocked = lambda df, own: df.select(F.explode(ancestors(F.col("path"), top, own)).alias("folder"), F.lit(False).alias("ok"), F.lit(False).alias("leaves"))
    rows = rows.union(blocked(targets, False))
    if denied is not None:
        rows = rows.union(blocked(denied, True))
    known = folders.select(F.lower(F.col("path")).alias("k"), "path")
    sums = rows.groupBy(F.lower(F.col("folder")).alias("k")).agg(F.min("ok").alias("ok"), F.max("leaves").alias("leaves")).where("ok and leaves")
    out = known.join(sums, "k").where(F.col("k") != root.rstrip("/").lower())
    depth = F.length("path") - F.length(F.replace(F.col("path"), F.lit("/")))
    return out.select("path", depth.alias("depth"), "k").orderBy(F.col("depth").desc(), "k").select("path")


def subtree_filter(path: Column, excluded: Column | str) -> Column:
    """Whether a path is a folder or lies below it."""
    base = F.lower(F.rtrim(F.lit(excluded) if isinstance(excluded, str) else excluded, F.lit("/")))
    return (F.lower(path) == base) | F.lower(path).startswith(F.concat(base, F.lit("/")))


def leaving_files(files: DataFrame, leaving: DataFrame) -> DataFrame:
    """files (path) with junk and leaving, the latter for paths in ``leaving`` (key)."""
    marked = files.join(leaving.select(F.col("key").alias("lk")).distinct(), paths.path_key(F.col("path")) == F.col("lk"), "left")
    return marked.select("path", paths.is_junk(paths.basename(F.col("path"))).alias("junk"), F.col("lk").isNotNull().alias("leaving"))
