"""A directory tree as a DataFrame, listed in rounds.

A round is a table of folders; its tasks list them and go on downwards, each up to a number
of folders, and hand back those they did not reach for the next round. Links are not entered, excluded folders are
never listed, and a folder that cannot be listed gives a row instead of an error. Spark's own
binary source is no substitute: it hides names that begin with _ or . and empty files, and
follows links round in circles.

Rows: what = file, dir, cloud or denied; for files size, mtime, mode, attributes, device and
inode. Sizes and times come with the listing, contents are only read by ``binary``.
"""

from __future__ import annotations

import os
import stat
from collections import deque
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels, paths
from ..operators.ordering import kept

SCHEMA = "what string, path string, size long, mtime double, mode int, attributes long, device long, inode long, files array<string>, subdirs array<string>"
_COLUMNS = [field.split()[0] for field in SCHEMA.split(", ")]
#: Folders that the first round's one task lists, those that each task of a later round lists, and rows given to Spark at once.
FIRST_FOLDERS, MOST_FOLDERS, BATCH = 256, 4096, 10_000


def list_folder(folder: str, excluded: frozenset[str]) -> tuple[tuple | None, list[tuple], list[str]]:
    """The folder's own row (or one that says it is denied), rows of its files, and paths of its subfolders."""
    try:
        with os.scandir(folder) as entries:
            found = sorted(entries, key=lambda e: e.name)
    except OSError:
        return None, [("denied", folder, *[None] * 8)], []
    rows, names, subs = [], [], []
    for entry in found:
        path = os.path.join(folder, entry.name)
        try:
            if entry.is_dir(follow_symlinks=False):
                if path.lower() not in excluded and not entry.is_symlink() and not entry.is_junction():
                    subs.append(path)
                continue
            s = entry.stat(follow_symlinks=False)
        except OSError:
            continue
        names.append(entry.name)
        attributes = getattr(s, "st_file_attributes", 0)
        what = "cloud" if attributes & paths.CLOUD_MASK else "file"
        rows.append((what, path, s.st_size, s.st_mtime, stat.S_IMODE(s.st_mode), attributes, s.st_dev, s.st_ino, None, None))
    own = ("dir", folder, *[None] * 6, names, [os.path.basename(p) for p in subs])
    return own, rows, subs


def walk(folders: Iterable[str], excluded: frozenset[str] = frozenset(), most: int | None = None) -> Iterator[tuple]:
    """Rows of the given folders and of what lies below, level by level; links are not entered.

    Once ``most`` folders are listed, those still to do are rows of what = todo.
    """
    ahead, listed = deque(folders), 0
    given = len(ahead)
    while ahead:
        folder = ahead.popleft()
        if most is not None and listed >= max(most, given):
            yield ("todo", folder, *[None] * 8)
            continue
        own, rows, subs = list_folder(folder, excluded)
        listed += 1
        if own:
            yield own
        yield from rows
        ahead += subs


def _round(folders: DataFrame, excluded: frozenset[str], most: int) -> DataFrame:
    """One round over rows folder: every task walks down from its folders until it has listed enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = walk([f for batch in batches for f in batch["folder"]], excluded, most)
        while rows := list(islice(found, BATCH)):
            yield pd.DataFrame(rows, columns=_COLUMNS, dtype=object)

    return folders.mapInPandas(run, SCHEMA)


def listing(spark: SparkSession, root: str, exclude: list[str] | None = None, first: int = FIRST_FOLDERS, most: int = MOST_FOLDERS) -> DataFrame:
    """Rows of the tree below ``root``; excluded folders (whole paths, in any case) are never listed.

    Listed in rounds: what a round's tasks did not reach is dealt out anew to all tasks of
    the next, so that one deep or wide subtree is many tasks' work. The driver only counts.
    A root that cannot be listed is a denied row; a tree without files gives its folders.
    """
    excluded = frozenset(p.lower() for p in exclude or [])
    ahead, rounds = spark.createDataFrame([(os.path.abspath(root),)], "folder string").coalesce(1), []
    while True:
        rows = kept(_round(ahead, excluded, most if rounds else first))
        rounds.append(rows.where("what <> 'todo'"))
        todo = rows.where("what = 'todo'").select(F.col("path").alias("folder"))
        left = todo.count()
        if not left:
            return reduce(DataFrame.union, rounds)
        ahead = todo.repartition(min(left, max(2 * spark.sparkContext.defaultParallelism, left // most)))


def media_files(rows: DataFrame) -> DataFrame:
    """The listing's media files with name, ext, kind and readonly; junk and other files left out."""
    name = paths.basename(F.col("path"))
    out = rows.where("what = 'file'").withColumn("name", name).withColumn("ext", paths.extension(F.col("name")))
    out = out.where(paths.is_media(F.col("ext")) & ~paths.is_junk(F.col("name")))
    return out.select("path", "name", "ext", "size", "mtime", "device", "inode", paths.kind_of(F.col("ext")).alias("kind"), paths.is_readonly(F.col("mode")).alias("readonly"))


def folders(rows: DataFrame) -> DataFrame:
    return rows.where("what = 'dir'").select("path", "files", "subdirs")


def cloud_files(rows: DataFrame) -> DataFrame:
    name = paths.basename(F.col("path"))
    return rows.where((F.col("what") == "cloud") & paths.is_media(paths.extension(name)) & ~paths.is_junk(name)).select("path")


def denied_folders(rows: DataFrame) -> DataFrame:
    return rows.where("what = 'denied'").select("path")


def exclusions(root: str, dest: str) -> list[str]:
    return labels.special_folders(root, dest)
