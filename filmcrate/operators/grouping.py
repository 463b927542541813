"""Files into items: companions of one name travel together, with one date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, paths
from ..plans.options import Options

# Which member of a pair comes first, and which kinds can lead one.
ORDER = {"heic": 0, "avif": 1, "raw": 2, "jpeg": 3, "image": 4, "video": 5, "sidecar": 6}
LEADERS = ("heic", "avif", "raw", "jpeg")


def rank_of_kind(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in ORDER.items() for x in pair]), kind), F.lit(9))


def paired_members(kinds: Column, exts: Column) -> Column:
    """Whether files of one folder and stem form a pair: several, all of different kinds (sidecars by extension), led by a photo, no other picture among them."""
    told = F.transform(F.arrays_zip(kinds.alias("k"), exts.alias("e")), lambda z: F.when(z["k"] == "sidecar", F.lower(z["e"])).otherwise(z["k"]))
    return (F.size(kinds) > 1) & (F.size(F.array_distinct(told)) == F.size(kinds)) & kinds[0].isin(*LEADERS) & ~F.array_contains(kinds, "image")


def group_pairs(media: DataFrame, case_insensitive: bool = True) -> DataFrame:
    """One row an item: members (array of media structs, the first one leading), key, stem_key, folder_key.

    One shuffle on (folder, stem); a bucket that is no pair falls apart into its files without another.
    """
    name, folder = F.col("name"), F.col("folder")
    rows = media.withColumn("name", paths.basename(F.col("path"))).withColumn("folder", paths.dirname(F.col("path")))
    rows = rows.withColumn("stem", paths.stem(name)).withColumn("ext", paths.extension(name))
    fields = ["path", "name", "stem", "ext", "size", "mtime", "kind", "fmt", "quick", "sha1", "meta", "user_date"]
    fields = [c for c in fields if c in rows.columns]
    member = F.struct(rank_of_kind(F.col("kind")).alias("rank"), *fields)
    rows = rows.select(paths.path_key(folder, case_insensitive).alias("folder_key"), paths.stem_key(name).alias("stem_key"), member.alias("m"))
    bucket = rows.groupBy("folder_key", "stem_key").agg(F.array_sort(F.collect_list(F.struct(F.col("m.rank").alias("r"), F.col("m.name").alias("n"), "m"))).alias("ms"))
    bucket = bucket.withColumn("ms", F.col("ms.m"))
    whole = paired_members(F.col("ms.kind"), F.col("ms.ext"))
    parts = F.when(whole, F.array("ms")).otherwise(F.transform("ms", lambda m: F.array(m)))
    items = bucket.select("folder_key", "stem_key", F.explode(parts).alias("members"))
    return items.withColumn("key", paths.path_key(F.col("members")[0]["path"], case_insensitive))


def numbered(items: DataFrame) -> DataFrame:
    """Items with ``item_idx``, their place in the order of keys; ranges are numbered apart and put end to end."""
    from ..operators.ordering import with_position

    return with_position(items, ["key"], "item_idx")


def dated_items(items: DataFrame, opts: Options, manual: Column | None = None) -> DataFrame:
    """Items with when, basis and source: a manual date, the leader's, a companion's not from its file time, any companion's.

    With patterns of the user's own, media rows carry ``user_date`` (see ``dates.user_date``).
    A JPG that is about to leave as a duplicate of its pair does not date it.
    """
    given = F.lit(None).cast("timestamp_ntz") if manual is None else manual
    leads = F.col("members")[0]["kind"].isin("heic", "avif", "raw")
    voters = F.when(leads, F.filter("members", lambda m: m["kind"] != "jpeg")).otherwise(F.col("members")) if opts.jpg_pair_as_dupe else F.col("members")
    found = F.transform(voters, lambda m: dates.resolve(m["meta"], m["stem"], m["mtime"], opts.dates, m["user_date"] if opts.dates.user_patterns else None))
    pick = lambda when, basis: F.struct(when.alias("when"), basis.alias("basis"))

    def choose(f: Column) -> Column:
        rest = F.filter(F.slice(f, 2, F.greatest(F.size(f), F.lit(1))), lambda r: r["when"].isNotNull())
        first, any_ = F.get(f, F.lit(0)), F.get(rest, F.lit(0))
        borrowed = F.get(F.filter(rest, lambda r: r["basis"] != "mtime"), F.lit(0))
        out = F.when(given.isNotNull(), pick(given, F.lit("manual"))).when(first["when"].isNotNull(), pick(first["when"], first["basis"]))
        out = out.when(borrowed.isNotNull(), pick(borrowed["when"], F.lit("pair"))).otherwise(pick(any_["when"], F.coalesce(any_["basis"], F.lit(""))))
        return F.struct(out.alias("c"), first["source"].alias("source"))

    lone = F.col("members")[0]["kind"] == "sidecar"
    rows = items.withColumn("_c", F.when(~lone, dates.let(found, choose)))
    return rows.withColumn("when", F.col("_c.c.when")).withColumn("basis", F.coalesce("_c.c.basis", F.lit(""))).withColumn("source", F.coalesce("_c.source", F.lit("other"))).drop("_c")


def primaries(media: DataFrame) -> DataFrame:
    """The leading file of every (folder, stem), as a window."""
    w = Window.partitionBy(paths.path_key(paths.dirname(F.col("path"))), paths.stem_key(paths.basename(F.col("path")))).orderBy(rank_of_kind(F.col("kind")), paths.basename(F.col("path")))
    return media.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
