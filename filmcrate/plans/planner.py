"""From media files to a plan: items, duplicates, similar pictures, placement, states, counts."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, paths
from ..operators import duplicates, folders, grouping, incremental, placement
from ..operators import similar as similar_
from ..operators.ordering import kept
from ..sources import binary, pictures, tree
from .options import OVERRIDES, Options
from .progress import watched

DUPES = "key string, dup_of string, reason string"
SIMILAR = "key string, group_no long, suggested boolean"


@dataclass
class Plan:
    options: Options
    items: DataFrame
    empty_dirs: DataFrame
    serial: int = 0
    #: paths of files that are not on this machine, and of folders that could not be listed
    cloud: DataFrame | None = None
    denied: DataFrame | None = None
    #: files whose content was read for the plan; None where no snapshot was kept
    opened: int | None = None


def _lead(field: str) -> Column:
    return F.col("members")[0][field]


def moves() -> Column:
    """Whether any member gets another place; a folder's other case is the same folder, a name's other case is another name."""
    pairs = F.arrays_zip(F.transform("members", lambda m: m["path"]).alias("p"), F.col("dsts").alias("d"))
    return F.exists(pairs, lambda z: (z["d"] != "") & ((paths.path_key(z["d"]) != paths.path_key(z["p"])) | (paths.basename(z["d"]) != paths.basename(z["p"]))))


def trashes() -> Column:
    return (F.col("status") == "dup") & ~F.exists("dsts", lambda d: d != "")


def acts() -> Column:
    return F.col("checked") & ~F.col("present") & (F.col("moves") | (F.col("convert_dst") != "") | (F.col("heic_dst") != "") | trashes())


def classify(items: DataFrame, opts: Options, dupes: DataFrame, similar: DataFrame, overrides: DataFrame) -> DataFrame:
    """Items with status, notes, convert, duplicate and similar fields, checked and keep: left joins and one CASE each."""
    o = overrides.select(F.col("key").alias("ok"), F.col("dup").alias("user_dup"), F.coalesce("unchecked", F.lit(False)).alias("unchecked"))
    d = dupes.select(F.col("key").alias("dk"), F.col("dup_of").alias("d_of"), F.col("reason").alias("d_reason"))
    s = similar.select(F.col("key").alias("sk"), F.col("group_no").alias("similar"), "suggested")
    rows = items.join(d, F.col("key") == F.col("dk"), "left").join(s, F.col("key") == F.col("sk"), "left").join(o, F.col("key") == F.col("ok"), "left")
    lone = _lead("kind") == "sidecar"
    empty = ~lone & (_lead("size") == 0)
    rows = rows.withColumn("when", F.when(empty & (F.col("basis") != "manual"), F.lit(None).cast("timestamp_ntz")).otherwise(F.col("when")))
    rows = rows.withColumn("basis", F.when(empty & (F.col("basis") != "manual"), "").otherwise(F.col("basis")))
    jpeg = F.exists(F.slice("members", 2, F.greatest(F.size("members"), F.lit(1))), lambda m: m["kind"] == "jpeg")
    wanted = F.lit(opts.convert or opts.heic_only) & ~lone & ~jpeg & (_lead("size") > 0)
    wanted = wanted & (paths.is_heif(_lead("fmt"), _lead("kind")) | (F.lit(opts.convert_avif) & paths.is_avif(_lead("fmt"), _lead("kind"))))
    dup = ~lone & ((F.col("d_of").isNotNull() & F.coalesce(F.col("user_dup"), F.lit(True))) | F.coalesce(F.col("user_dup"), F.lit(False)))
    pair = F.lit(opts.jpg_pair_as_dupe) & jpeg & _lead("kind").isin("heic", "avif", "raw")
    note = lambda test, name: F.when(test, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    meta = _lead("meta")
    notes = F.concat(note(empty, "empty"), note(~lone & (F.coalesce(meta["frames"], F.lit(1)) > 1), "burst"), note(~lone & (F.coalesce(meta["error"], F.lit("")) != ""), "meta_error"), note(~lone & pair, "pair_jpg"))
    rows = rows.withColumn("notes", notes).withColumn("status", F.when(lone, "same").when(dup, "dup").when(F.col("when").isNull(), "nodate").otherwise("same"))
    rows = rows.withColumn("dup_of", F.when(dup, F.coalesce("d_of", F.lit(""))).otherwise("")).withColumn("dup_reason", F.when(dup, F.coalesce("d_reason", F.lit("similar"))).otherwise(""))
    rows = rows.withColumn("convert", wanted & ~dup).withColumn("keep", F.coalesce(~F.col("user_dup"), F.lit(False))).withColumn("checked", ~F.coalesce("unchecked", F.lit(False)) | lone)
    rows = rows.withColumn("similar", F.when(lone, 0).otherwise(F.coalesce("similar", F.lit(0)))).withColumn("suggest_dup", ~lone & F.coalesce("suggested", F.lit(False)))
    return rows.drop("dk", "d_of", "d_reason", "sk", "suggested", "ok", "user_dup", "unchecked")


def split_pairs(items: DataFrame, opts: Options) -> DataFrame:
    """With the option, the JPG of a pair becomes an item of its own right behind, a duplicate of the pair; positions are doubled to make room."""
    rows = items.withColumn("item_idx", F.col("item_idx") * 2)
    if not opts.jpg_pair_as_dupe:
        return rows
    apart = F.array_contains("notes", "pair_jpg") & (F.col("status") != "dup")
    rows = rows.withColumn("apart", apart).withColumn("twin", F.explode(F.when(apart, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    jpgs = F.filter("members", lambda m: m["kind"] == "jpeg")
    is_twin = F.col("twin") == 1
    first = F.col("members")[0]
    kept_members = F.when(is_twin, F.slice(jpgs, 1, 1)).when(F.col("apart"), F.filter("members", lambda m, i: (m["kind"] != "jpeg") | (i == 0))).otherwise(F.col("members"))
    rows = rows.withColumn("dup_of", F.when(is_twin, first["path"]).otherwise(F.col("dup_of"))).withColumn("dup_reason", F.when(is_twin, "pair").otherwise(F.col("dup_reason")))
    rows = rows.withColumn("status", F.when(is_twin, "dup").otherwise(F.col("status"))).withColumn("convert", F.col("convert") & ~is_twin).withColumn("notes", F.when(is_twin, F.array().cast("array<string>")).otherwise(F.col("notes")))
    for name, value in (("similar", F.lit(0)), ("suggest_dup", F.lit(False)), ("keep", F.lit(False))):
        rows = rows.withColumn(name, F.when(is_twin, value).otherwise(F.col(name)))
    rows = rows.withColumn("members", kept_members).withColumn("key", paths.path_key(F.col("members")[0]["path"], opts.case_insensitive))
    return rows.withColumn("item_idx", F.col("item_idx") + F.col("twin")).drop("apart", "twin")


def finish(items: DataFrame) -> DataFrame:
    """Final states: duplicates and undated stay what they are; conversion, then conflict, then ok or same."""
    rows = items.withColumn("moves", moves())
    converts = (F.col("convert_dst") != "") & F.col("checked")
    state = F.when(F.col("status").isin("dup", "nodate", "conflict"), F.col("status")).when(converts, "convert").when(F.col("moves"), "ok").otherwise("same")
    rows = rows.withColumn("status", state)
    return rows.withColumn("acts", acts())


def summary(items: DataFrame, n_folders: Column | int = 0) -> DataFrame:
    """Six counts; they overlap: an undated item that moves counts twice."""
    dup, undated = F.col("status") == "dup", F.col("status") == "nodate"
    return items.agg(
        F.count_if(~dup & F.col("checked") & F.col("moves")).alias("move"),
        F.count_if(F.col("checked") & (F.col("convert_dst") != "")).alias("convert"),
        F.count_if(undated).alias("nodate"),
        F.count_if(dup).alias("dupes"),
        F.count_if(~dup & ~undated & ~F.col("acts")).alias("same"),
        (F.lit(n_folders) if isinstance(n_folders, int) else n_folders).cast("long").alias("folders"),
    )


def actionable(items: DataFrame, n_folders: int = 0) -> DataFrame:
    return items.agg((F.count_if("acts") + n_folders).alias("actionable"))


def group_members(items: DataFrame) -> DataFrame:
    """group, status, checked: members of similar groups, and duplicates with the item that stays."""
    cols = ["status", "checked"]
    by_group = items.where("similar > 0").select(F.concat(F.lit("s"), F.col("similar")).alias("group"), *cols)
    dups = items.where("status = 'dup' and dup_of <> ''").select(paths.path_key(F.col("dup_of")).alias("k"), F.col("status").alias("s"), F.col("checked").alias("c"))
    keepers = items.select("key", *cols)
    told = dups.join(keepers, F.col("k") == F.col("key")).select(F.concat(F.lit("d"), F.col("key")).alias("group"), F.col("s").alias("status"), F.col("c").alias("checked"))
    stay = keepers.join(dups.select("k").distinct(), F.col("key") == F.col("k"), "left_semi").select(F.concat(F.lit("d"), F.col("key")).alias("group"), *cols)
    return by_group.union(told).union(stay)


def blocked_groups(items: DataFrame) -> DataFrame:
    """Groups every member of which would leave."""
    out = group_members(items).groupBy("group").agg(F.count("*").alias("n"), F.every((F.col("status") == "dup") & F.col("checked")).alias("all_leave"))
    return out.where("n > 1 and all_leave").select("group", "n")


def space_need(items: DataFrame, mode: str, other_drive: Column | None = None) -> DataFrame:
    """Bytes that copies, moves to another drive and converted pictures (twice their size) need."""
    far = F.lit(mode == "copy") | (F.lit(False) if other_drive is None else other_drive)
    rows = items.where("acts").select("item_idx", "convert_dst", F.posexplode(F.arrays_zip(F.transform("members", lambda m: m["path"]).alias("p"), F.transform("members", lambda m: m["size"]).alias("s"), F.col("dsts").alias("d"))).alias("i", "z"))
    goes = (F.col("z.d") != "") & (paths.path_key(F.col("z.d")) != paths.path_key(F.col("z.p"))) & far
    made = F.when((F.col("i") == 0) & (F.col("convert_dst") != ""), F.col("z.s") * 2).otherwise(0)
    return rows.agg(F.coalesce(F.sum(F.when(goes, F.col("z.s")).otherwise(0) + made), F.lit(0)).alias("need"))


VIEWS = ("all", "todo", "nodate", "dup", "failed")


def view(items: DataFrame, name: str, failed: DataFrame | None = None) -> DataFrame:
    """Items of a view: everything, what acts, undated, duplicates and similar, or failed ones (``failed``: key)."""
    if name == "failed":
        return items.join(failed.select("key").distinct(), "key", "left_semi")
    tests = {"all": F.lit(True), "todo": F.col("acts"), "nodate": F.col("status") == "nodate", "dup": (F.col("status") == "dup") | (F.col("similar") > 0)}
    return items.where(tests[name])


def printed(items: DataFrame, opts: Options) -> DataFrame:
    """One line of text an item."""
    lead = F.col("members")[0]["path"]
    more = F.array_join(F.transform(F.slice("members", 2, F.greatest(F.size("members"), F.lit(1))), lambda m: F.concat(F.lit(" +"), m["ext"])), "")
    new = F.when(F.col("dsts")[0] == "", "(bin)").otherwise(paths.relative(F.col("dsts")[0], F.lit(opts.target)))
    day = F.coalesce(F.date_format("when", "yyyy-MM-dd HH:mm"), F.lit("-"))
    line = F.format_string("%s [%s] %s%s  %s (%s) -> %s", F.when(F.col("acts"), " ").otherwise("-"), "status", paths.relative(lead, F.lit(opts.root)), more, day, F.coalesce(F.nullif("basis", F.lit("")), F.lit("-")), new)
    return items.select("item_idx", line.alias("line"))


def empty_dirs(items: DataFrame, files: DataFrame, dirs: DataFrame, opts: Options, denied: DataFrame | None = None) -> DataFrame:
    """Folders that this plan empties (move mode only)."""
    if opts.mode != "move" or not opts.remove_empty or opts.heic_only:
        return dirs.select("path").where(F.lit(False))
    pairs = items.where("acts").select(F.explode(F.arrays_zip(F.transform("members", lambda m: m["path"]).alias("p"), F.col("dsts").alias("d"))).alias("z")).select("z.*")
    leaving = pairs.where((F.col("d") == "") | (paths.path_key(F.col("d")) != paths.path_key(F.col("p")))).select(paths.path_key(F.col("p")).alias("key"))
    targets = pairs.where("d <> ''").select(F.col("d").alias("path")).union(items.where("heic_dst <> ''").select("heic_dst")).union(dirs.sparkSession.createDataFrame([(f"{opts.target}/x",)], "path string"))
    return folders.emptied_folders(folders.leaving_files(files, leaving), dirs, targets, opts.root, denied)


def build(items: DataFrame, files: DataFrame, opts: Options, dupes: DataFrame | None = None, similar: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """Planned items from dated, numbered ones."""
    spark = items.sparkSession
    dupes = spark.createDataFrame([], DUPES) if dupes is None else dupes
    similar = spark.createDataFrame([], SIMILAR) if similar is None else similar
    overrides = spark.createDataFrame([], OVERRIDES) if overrides is None else overrides
    rows = split_pairs(classify(items, opts, dupes, similar, overrides), opts)
    placed = placement.place_items(rows, files, opts)
    return finish(placement.original_targets(placed, files, opts))


def find_similar(items: DataFrame, threshold: int = 6) -> DataFrame:
    """key, group_no, suggested of items whose leading pictures look alike; items are grouped and numbered ones."""
    lead = F.col("members")[0]
    photos = items.where(similar_.eligible(lead["size"], lead["kind"])).select(F.col("item_idx").alias("idx"), "key", "when", lead["path"].alias("path"), lead["stem"].alias("stem"), lead["size"].alias("size"))
    seen = kept(pictures.hashed(photos).withColumnRenamed("path", "p"))
    photos = photos.join(seen, F.col("path") == F.col("p"))
    groups, edges = similar_.groups(photos.select("idx", "phash"), threshold)
    members = photos.join(groups, "idx").select("idx", "group_no", "stem", "pixels", "when", "size", "path")
    told = similar_.suggestions(members, edges).select(F.col("idx").alias("i"), "group_no", "suggested")
    return photos.join(told, F.col("idx") == F.col("i")).select("key", "group_no", "suggested")


def make_plan(spark: SparkSession, opts: Options, dedupe: bool = True, overrides: DataFrame | None = None, similar: DataFrame | None = None, threshold: int | None = None, snapshot: str = "", progress: Callable[[int, int], None] | None = None, cancel: threading.Event | None = None) -> Plan:
    """List, read, group, date, deduplicate and place a folder tree.

    With a ``threshold``, similar pictures are looked for too; ``similar`` gives groups found before instead.
    With a ``snapshot`` folder, only files that are new or changed since the last plan with it are opened.
    ``progress`` and ``cancel`` reach listing, reading and hashing as well (``progress.watched``).
    """
    with watched(spark, progress, cancel):
        return _plan(spark, opts, dedupe, overrides, similar, threshold, snapshot)


def _plan(spark: SparkSession, opts: Options, dedupe: bool, overrides: DataFrame | None, similar: DataFrame | None, threshold: int | None, snapshot: str) -> Plan:
    listing = kept(tree.listing(spark, opts.root, tree.exclusions(opts.root, opts.target)))
    media, opened = tree.media_files(listing), None
    if snapshot:
        media, opened = incremental.rescan(media, snapshot, binary.read_media, opts.case_insensitive)
    else:
        media = kept(binary.read_media(media))
    if opts.dates.user_patterns:
        media = media.withColumn("user_date", dates.user_date(paths.stem(F.col("name")), opts.dates))
    items = grouping.group_pairs(media, opts.case_insensitive)
    manual = None
    if overrides is not None:
        items = items.join(overrides.select(F.col("key").alias("ok"), F.col("date").alias("manual")), F.col("key") == F.col("ok"), "left").drop("ok")
        manual = F.col("manual")
    items = kept(grouping.numbered(grouping.dated_items(items, opts, manual)))
    lead = F.col("members")[0]
    flat = items.select("key", "basis", F.size("members").alias("n_members"), lead["path"].alias("path"), lead["stem"].alias("stem"), lead["size"].alias("size"), lead["kind"].alias("kind"), lead["quick"].alias("quick"), lead["sha1"].alias("sha1"))
    dupes = kept(duplicates.find_exact(flat, binary.full_hashes)) if dedupe and not opts.heic_only else None
    if similar is None and threshold is not None and not opts.heic_only:
        similar = kept(find_similar(items, threshold))
    there = tree.listing(spark, opts.target) if opts.target != opts.root.rstrip("/") else tree.listing(spark, opts.root)
    files = there.where("what = 'file'").select("path", "size")
    known = media.select(F.col("path").alias("mp"), F.col("sha1").alias("ms"))
    files = kept(files.join(known, F.col("path") == F.col("mp"), "left").select("path", "size", F.col("ms").alias("sha1"), F.col("mp").isNotNull().alias("scanned")))
    other = files.where("not scanned or coalesce(sha1, '') = ''")
    clash = items.select(F.explode("members.size").alias("s")).distinct()
    read = binary.full_hashes(other.join(clash, F.col("size") == F.col("s"), "left_semi")).select(F.col("path").alias("rp"), F.col("sha1").alias("rs"))
    files = kept(files.join(read, F.col("path") == F.col("rp"), "left").select("path", "size", F.coalesce(F.nullif("sha1", F.lit("")), "rs", F.lit("")).alias("sha1"), "scanned"))
    planned = kept(build(_with_hashes(items, files), files, opts, dupes, similar, overrides))
    gone = empty_dirs(planned, listing.where("what in ('file', 'cloud')").select("path"), tree.folders(listing), opts, tree.denied_folders(listing))
    return Plan(opts, planned, gone, cloud=tree.cloud_files(listing), denied=tree.denied_folders(listing), opened=opened)


def _with_hashes(items: DataFrame, files: DataFrame) -> DataFrame:
    """Members' full hashes filled in from what was read."""
    rows = items.select("item_idx", F.posexplode("members").alias("pos", "m"))
    known = files.select(F.col("path").alias("fp"), F.col("sha1").alias("fs"))
    rows = rows.join(known, F.col("m.path") == F.col("fp"), "left")
    full = F.col("m").withField("sha1", F.coalesce(F.nullif(F.col("m.sha1"), F.lit("")), "fs", F.lit("")))
    back = rows.groupBy("item_idx").agg(F.array_sort(F.collect_list(F.struct("pos", full.alias("m")))).alias("ms")).select("item_idx", F.col("ms.m").alias("members"))
    return items.drop("members").join(back, "item_idx")
