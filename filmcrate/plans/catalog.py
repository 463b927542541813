"""Queries of the catalog engine, one or more for each operator, and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, labels, paths, perceptual, templates
from ..operators import duplicates, folders, grouping, history, incremental, ordering, placement, similar
from ..sources import binary, stills
from . import planner, views
from .options import Options

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
OPTS = dates.DateOptions()


def query(name: str, sql: str = "") -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def text(when: Column) -> Column:
    return F.date_format(when, "yyyy-MM-dd HH:mm:ss")


# Views in SQL -------------------------------------------------------------------------------

NAMES = """n AS (SELECT event_id AS id, ts, event_id % 8 AS k, strftime(ts, '%Y-%m-%d %H:%M:%S') AS "full", strftime(ts, '%Y-%m-%d 00:00:00') AS day FROM events),
names AS (SELECT id, k, ts, CASE WHEN k IN (4, 5) THEN day WHEN k = 7 THEN NULL ELSE "full" END AS found,
  CASE k WHEN 0 THEN 'kakao' WHEN 1 THEN 'screenshot' WHEN 2 THEN 'camera' WHEN 3 THEN 'camera' WHEN 4 THEN 'messenger' WHEN 5 THEN 'messenger' ELSE '' END AS src FROM n)"""
META = """m AS (SELECT o_orderkey AS id, o_orderkey % 8 AS k, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS "full", strftime(o_orderdate, '%Y-%m-%d %H:%M:00') AS "minute",
  '2999' || strftime(o_orderdate, '-%m-%d %H:%M:%S') AS future FROM orders),
meta AS (SELECT id, k, CASE WHEN k IN (0, 1, 2) THEN "full" WHEN k = 3 THEN "minute" WHEN k = 6 THEN '2000-01-01 00:00:00' WHEN k = 7 THEN future END AS found FROM m)"""
FILES = """files AS (SELECT doc_id AS id, '/lib/' || source || '/' || lang || '/' || doc_id || '.jpg' AS path, coalesce(text, '') AS t, strlen(coalesce(text, ''))::BIGINT AS size,
  sha1(left(coalesce(text, ''), 16)) AS quick, sha1(coalesce(text, '')) AS sha1, doc_id % 3 + 1 AS n_members, doc_id % 2 AS by_name FROM documents)"""
PAIRS = """l AS (SELECT l_orderkey AS o, l_linenumber AS n, count(*) AS c FROM lineitem GROUP BY ALL),
e AS (SELECT o, n, unnest(CASE WHEN n = 2 AND c > 1 THEN ['.jpg', '.jpeg'] ELSE [['.heic', '.jpg', '.mov', '.aae', '.xmp', '.dng', '.png'][n]] END) AS ext FROM l),
pairs AS (SELECT o, n, ext, o * 10 + n AS size, '/p/' || o % 10 || '/IMG_' || o || ext AS path, 'IMG_' || o || ext AS name,
  CASE ext WHEN '.heic' THEN 'heic' WHEN '.dng' THEN 'raw' WHEN '.mov' THEN 'video' WHEN '.aae' THEN 'sidecar' WHEN '.xmp' THEN 'sidecar' WHEN '.png' THEN 'image' ELSE 'jpeg' END AS kind,
  CASE ext WHEN '.heic' THEN 0 WHEN '.dng' THEN 2 WHEN '.mov' THEN 5 WHEN '.aae' THEN 6 WHEN '.xmp' THEN 6 WHEN '.png' THEN 4 ELSE 3 END AS ord FROM e),
buckets AS (SELECT o, count(*) AS c, count(DISTINCT CASE WHEN kind = 'sidecar' THEN ext ELSE kind END) AS d, min(ord) AS lead, bool_or(kind = 'image') AS image FROM pairs GROUP BY o),
whole AS (SELECT o, c > 1 AND d = c AND lead <= 3 AND NOT image AS pair FROM buckets),
items AS (SELECT p.*, w.pair, row_number() OVER (PARTITION BY p.o, CASE WHEN w.pair THEN '' ELSE p.name END ORDER BY p.ord, p.name) AS rn,
  count(*) OVER (PARTITION BY p.o, CASE WHEN w.pair THEN '' ELSE p.name END) AS n_members FROM pairs p JOIN whole w USING (o))"""
BITS = """b AS (SELECT vec_id AS idx, list_transform(embedding, lambda x: x::DOUBLE) AS block FROM embeddings),
md AS (SELECT idx, block, (list_sort(block)[32] + list_sort(block)[33]) / 2 AS med FROM b),
raw AS (SELECT idx, list_reduce(list_transform(block, lambda x: (CASE WHEN x > med THEN 1 ELSE 0 END)::HUGEINT), lambda a, x: a * 2 + x) AS u FROM md),
bits AS (SELECT idx, (CASE WHEN u >= 9223372036854775808::HUGEINT THEN u - 18446744073709551616::HUGEINT ELSE u END)::BIGINT AS h FROM raw)"""
HASHES = (
    BITS
    + """, near AS (SELECT idx, h, unnest(CASE WHEN idx % 5 = 0 THEN [0, 1, 2] ELSE [0] END) AS n FROM bits),
hashes AS (SELECT idx * 4 + n AS idx, xor(h, (CASE n WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 3 END)::BIGINT) AS h FROM near),
cut AS (SELECT idx, i AS band, (((CASE WHEN h < 0 THEN h::HUGEINT + 18446744073709551616::HUGEINT ELSE h::HUGEINT END) // (1::HUGEINT << (10 * i)::INT)) % 1024)::INT AS v FROM hashes, range(7) r(i)),
turned AS (SELECT idx, band, v FROM cut UNION SELECT idx, band, CASE WHEN band = 6 THEN 15 - v ELSE 1023 - v END FROM cut),
cand AS (SELECT DISTINCT a.idx, t.idx AS other FROM cut a JOIN turned t ON a.band = t.band AND a.v = t.v AND a.idx < t.idx),
dist AS (SELECT c.idx, c.other, least(bit_count(xor(x.h, y.h)), 64 - bit_count(xor(x.h, y.h)))::INT AS distance FROM cand c JOIN hashes x ON x.idx = c.idx JOIN hashes y ON y.idx = c.other)"""
)
STEPS = """steps AS (SELECT user_id AS run_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'move' WHEN 'click' THEN 'copy' WHEN 'purchase' THEN 'trash' WHEN 'signup' THEN 'mkdir' ELSE 'rmdir' END AS op,
  '/s/' || event_id % 97 AS src, CASE WHEN event_type IN ('view', 'click') THEN '/s/' || event_id * 7 % 97 END AS dst, user_id % 4 = 0 AS undone FROM events)"""
TREE = """f AS (SELECT n_regionkey AS r, c_nationkey AS nk, c_custkey AS ck, '/t/r' || n_regionkey || '/n' || c_nationkey || '/c' || c_custkey AS folder FROM customer JOIN nation ON c_nationkey = n_nationkey),
o AS (SELECT folder, o_orderkey % 11 = 0 AS junk, o_orderstatus <> 'P' AS leaving FROM orders JOIN f ON o_custkey = ck)"""


# Names and dates ----------------------------------------------------------------------------


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files per dated target folder: name, date, resolution, template, count.

    Undated files are left out by their count: a filter before it would be pushed below the
    projection and have every date computed twice.
    """
    n = views.names(spark, sf_dir)
    empty = F.struct(*[F.lit("").alias(f"exif_{p}") for p in ("original", "digitized", "datetime")], F.lit("").alias("camera"), F.lit(None).cast("timestamp_ntz").alias("video_local"), F.lit(None).cast("timestamp_ntz").alias("video_utc"))
    rows = n.withColumn("r", dates.resolve(empty, F.col("stem"), F.lit(0.0), OPTS))
    folder = F.array_join(templates.render("{yyyy}/{source}/{yyyy-mm-dd}", F.col("r.when"), F.col("r.source"), F.lit(".jpg"), Options("/x").source_names), "/")
    return rows.groupBy(folder.alias("folder"), F.col("r.basis").alias("basis")).agg(F.count("r.when").alias("n")).where("n > 0")


query(
    "target_folder_counts",
    f"""WITH {NAMES} SELECT left(found, 4) || '/' || CASE src WHEN 'kakao' THEN 'KakaoTalk' WHEN 'screenshot' THEN 'Screenshots' WHEN 'camera' THEN 'Camera' WHEN 'messenger' THEN 'Messengers' ELSE 'Other' END || '/' || left(found, 10) AS folder,
    'name' AS basis, count(*) AS n FROM names WHERE found IS NOT NULL GROUP BY ALL""",
)(flagship)


@query("name_date_patterns", f"WITH {NAMES} SELECT id, found AS \"when\", CASE WHEN found IS NULL THEN NULL ELSE k NOT IN (4, 5) END AS has_time, CASE WHEN found IS NULL THEN NULL ELSE src END AS source, CASE WHEN found IS NULL THEN NULL ELSE false END AS multiple FROM names")
def _(spark, sf):
    d = views.names(spark, sf).withColumn("d", dates.name_date(F.col("stem"), OPTS))
    return d.select("id", text(F.col("d.when")).alias("when"), "d.has_time", "d.source", "d.multiple")


@query("name_source_counts", f"WITH {NAMES} SELECT src AS source, count(*) AS n FROM names GROUP BY ALL")
def _(spark, sf):
    return views.names(spark, sf).groupBy(dates.source_of(F.col("stem")).alias("source")).agg(F.count("*").alias("n"))


@query("name_multi", f"WITH {NAMES} SELECT id, left(\"full\", 10) AS \"first\", left(\"full\", 10) <> '2024-01-15' AS multiple FROM n")
def _(spark, sf):
    stem = F.concat(F.date_format("ts", "yyyyMMdd"), F.lit("_copy_20240115"))
    d = views.names(spark, sf).withColumn("d", dates.name_date(stem, OPTS))
    return d.select("id", F.date_format("d.when", "yyyy-MM-dd").alias("first"), F.col("d.multiple").alias("multiple"))


@query("name_user_patterns", f"WITH {NAMES} SELECT id, day AS \"when\", false AS has_time FROM n")
def _(spark, sf):
    opts = dates.DateOptions(user_patterns=(r"x(?P<d>\d{2})\.(?P<m>\d{2})\.(?P<y>\d{4})", "("))
    stem = F.concat(F.lit("x"), F.date_format("ts", "dd.MM.yyyy"))
    d = views.names(spark, sf).withColumn("own", dates.user_date(stem, opts)).withColumn("d", dates.name_date(stem, opts, F.col("own")))
    return d.select("id", text(F.col("d.when")).alias("when"), F.col("d.has_time").alias("has_time"))


@query("rename_stem", f"WITH {NAMES} SELECT id, strftime(ts, '%Y-%m-%d_%H%M%S_') || 'IMG_' || id AS renamed, 'IMG_' || id AS stripped, 'kakao' AS source FROM n")
def _(spark, sf):
    stem = F.concat(F.lit("2019-01-02_030405_IMG_"), F.col("id").cast("string"))
    kakao = F.concat(F.lit("2019-01-02_030405_KakaoTalk_20200102_030405"))
    return views.names(spark, sf).select("id", templates.renamed_stem(F.col("ts"), stem).alias("renamed"), dates.strip_renamed(stem).alias("stripped"), dates.name_date(kakao, OPTS)["source"].alias("source"))


@query("exif_parse", f'WITH {META} SELECT id, found AS "when" FROM meta')
def _(spark, sf):
    return views.metadata(spark, sf).select("id", text(dates.parse_meta_date(F.col("text"))).alias("when"))


_RESOLVED = f"""WITH {META}, r AS (SELECT id, k, found, CASE WHEN k IN (0, 1, 2, 3) AND found <> '2000-01-01 00:00:00' THEN 'exif' WHEN k IN (0, 1, 2, 3, 6) THEN CASE WHEN id % 3 = 0 THEN 'name' ELSE 'exif_suspect' END WHEN id % 3 = 0 THEN 'name' ELSE '' END AS basis FROM meta)"""


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    m = views.metadata(spark, sf)
    meta = F.struct(F.col("text").alias("exif_original"), F.lit("").alias("exif_digitized"), F.lit(" ").alias("exif_datetime"), F.when(F.col("id") % 2 == 0, "Apple").otherwise("").alias("camera"), F.lit(None).cast("timestamp_ntz").alias("video_local"), F.lit(None).cast("timestamp_ntz").alias("video_utc"))
    stem = F.when(F.col("id") % 3 == 0, "KakaoTalk_20100203_040506").otherwise("x")
    return m.withColumn("r", dates.resolve(meta, stem, F.lit(0.0), OPTS)).select("id", text(F.col("r.when")).alias("when"), "r.basis", "r.source")


@query("date_resolve_basis", _RESOLVED + " SELECT id, CASE basis WHEN 'name' THEN '2010-02-03 04:05:06' WHEN '' THEN NULL ELSE found END AS \"when\", basis, CASE WHEN id % 3 = 0 THEN 'kakao' WHEN id % 2 = 0 THEN 'camera' ELSE 'other' END AS source FROM r")
def _(spark, sf):
    return _resolved(spark, sf)


@query("date_resolve_counts", _RESOLVED + " SELECT basis, count(*) AS n FROM r GROUP BY ALL")
def _(spark, sf):
    return _resolved(spark, sf).groupBy("basis").agg(F.count("*").alias("n"))


@query("date_video_mtime", "SELECT event_id AS id, strftime(date_trunc('second', ts) + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS video, strftime(date_trunc('second', ts) + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS changed, 'video' AS basis, 'mtime' AS basis2 FROM events")
def _(spark, sf):
    """UTC video times and modification times in a zone nine hours ahead."""
    opts = dates.DateOptions(time_zone="Asia/Seoul", use_mtime=True)
    e = views.names(spark, sf).withColumn("t", F.date_trunc("second", F.col("ts")).cast("timestamp_ntz"))
    none = F.lit(None).cast("timestamp_ntz")
    meta = lambda utc: F.struct(*[F.lit("").alias(f"exif_{p}") for p in ("original", "digitized", "datetime")], F.lit("").alias("camera"), none.alias("video_local"), utc.alias("video_utc"))
    seconds = F.unix_timestamp(F.col("t").cast("timestamp")).cast("double")
    rows = e.withColumn("v", dates.resolve(meta(F.col("t")), F.lit("x"), F.lit(0.0), opts)).withColumn("c", dates.resolve(meta(none), F.lit("x"), seconds, opts))
    return rows.select("id", text(F.col("v.when")).alias("video"), text(F.col("c.when")).alias("changed"), F.col("v.basis").alias("basis"), F.col("c.basis").alias("basis2"))


@query("date_make", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 40 BETWEEN 1 AND 31 THEN try_strptime(2000 + o_orderkey % 25 || '-' || (o_orderkey % 14) || '-' || o_orderkey % 40, '%Y-%m-%d')::DATE::VARCHAR END AS made FROM orders")
def _(spark, sf):
    k = F.col("o_orderkey")
    when = dates.make_date([(k % 25 + 2000).cast("int"), (k % 14).cast("int"), (k % 40).cast("int")])
    return views.table(spark, sf, "orders").select(k.alias("id"), F.date_format(when, "yyyy-MM-dd").alias("made"))


@query("date_manual_display", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 5 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 6 IN (0, 1) THEN ' 10:20:' || CASE WHEN o_orderkey % 6 = 0 THEN '30' ELSE '00' END ELSE '' END END AS shown, o_orderdate = TIMESTAMP '2000-01-01' AS reset, year(o_orderdate) >= 1998 AS inside FROM orders")
def _(spark, sf):
    o = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp_ntz").alias("t"))
    day, k = F.date_format("t", "yyyy-MM-dd"), F.col("id") % 6
    typed = F.when(k == 0, F.concat(day, F.lit(" 10:20:30"))).when(k == 1, F.concat(day, F.lit(" 10:20"))).when(k == 2, day).when(k == 3, F.date_format("t", "yyyy.MM.dd")).when(k == 4, F.date_format("t", " yyyyMMdd ")).otherwise("soon")
    return o.select("id", dates.displayed(dates.parse_manual(typed)).alias("shown"), dates.is_reset(F.col("t")).alias("reset"), dates.in_range(F.col("t"), dates.DateOptions(year_min=1998)).alias("inside"))


# Paths, names and words -----------------------------------------------------------------------


@query("path_parts", "SELECT p_partkey AS id, '/a/' || p_brand AS folder, p_name || '.x' || '.JPG' AS name, p_name || '.x' AS stem, '.JPG' AS ext, lower('/a/' || p_brand || '/' || p_name || '.x.JPG') AS key, lower(p_name || '.x') AS stem_key, '/a/' || p_brand || '/' || p_name || '.x.JPG' = '' AS none, p_brand || '/' || p_name || '.x.JPG' AS rel FROM part")
def _(spark, sf):
    path = F.concat(F.lit("/a/"), "p_brand", F.lit("/"), "p_name", F.lit(".x.JPG"))
    p = views.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), path.alias("path"))
    name = paths.basename(F.col("path"))
    return p.select("id", paths.dirname(F.col("path")).alias("folder"), name.alias("name"), paths.stem(name).alias("stem"), paths.extension(name).alias("ext"), paths.target_key(F.col("path")).alias("key"), paths.stem_key(name).alias("stem_key"), (F.col("path") == "").alias("none"), paths.relative(F.col("path"), F.lit("/a")).alias("rel"))


@query("unicode_keys", "SELECT c_custkey AS id, lower(nfc_normalize('Café' || c_name)) AS target, lower('strasse' || c_name) AS stem, lower('Cafe\u0301' || c_name) AS path FROM customer")
def _(spark, sf):
    c = views.table(spark, sf, "customer")
    accent = F.concat(F.lit("Cafe\u0301"), "c_name")
    return c.select(F.col("c_custkey").alias("id"), paths.target_key(accent).alias("target"), paths.stem_key(F.concat(F.lit("Straße"), "c_name", F.lit(".jpg"))).alias("stem"), paths.path_key(accent).alias("path"))


@query("safe_name", "SELECT p_partkey AS id, 'a_b_' || p_type || '_ c' AS safe, '_' AS blank FROM part")
def _(spark, sf):
    t = F.concat(F.lit(" a<b:"), "p_type", F.lit("? c.. "))
    return views.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), paths.safe_name(F.regexp_replace(t, r"\.\. $", "..")).alias("safe"), paths.safe_name(F.lit(" ... ")).alias("blank"))


@query("pattern_render", "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y') || '|Camera ' || strftime(o_orderdate, '%m') || '|{x}' || strftime(o_orderdate, '%Y-%m-%d') || '_jpg' AS folders FROM orders")
def _(spark, sf):
    o = views.table(spark, sf, "orders")
    when = F.col("o_orderdate").cast("timestamp_ntz")
    r = templates.render("{yyyy}/ /{source} {mm}\\{x}{yyyy-mm-dd}:{ext}", when, F.lit("camera"), F.lit(".JPG"), Options("/x").source_names)
    return o.select(F.col("o_orderkey").alias("id"), F.array_join(r, "|").alias("folders"))


@query("pattern_validate", "SELECT o_orderkey AS id, ['', 'err_pattern_empty', 'err_pattern_unknown', 'err_pattern_braces', 'err_pattern_absolute', 'err_pattern_absolute'][1 + o_orderkey % 6] AS problem FROM orders")
def _(spark, sf):
    shapes = ("{yyyy}/{ext}", "  ", "{yyyy}/{when}", "{yyyy}}/x", "/{yyyy}", "{yyyy}/../x")
    t = F.element_at(F.array(*map(F.lit, shapes)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), templates.template_problem_column(t).alias("problem"))


@query("fit_stem", "SELECT p_partkey AS id, length(left(repeat('n', p_partkey % 300), greatest(240 - 3 - 4, 8)))::INT AS len, p_partkey % 300 > 233 AS truncated FROM part".replace("240 - 3 - 4", "233"))
def _(spark, sf):
    f = templates.fit_stem(F.lit("/a"), F.repeat(F.lit("n"), (F.col("p_partkey") % 300).cast("int")), F.lit(4))
    return views.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), f["stem"].alias("s"), f["truncated"].alias("truncated")).select("id", F.length("s").alias("len"), "truncated")


@query("text_forms", "SELECT o_orderkey AS id, CASE WHEN o_totalprice < 1024 THEN printf('%.0f B', o_totalprice) WHEN o_totalprice < 1048576 THEN printf('%.1f KB', o_totalprice / 1024) ELSE printf('%.1f MB', o_totalprice / 1048576) END AS size, format('{:,}', o_orderkey) AS count, CASE WHEN length(o_orderpriority) <= 7 THEN o_orderpriority ELSE left(o_orderpriority, 2) || '…' || right(o_orderpriority, 4) END AS short, least(100, greatest(80, o_orderkey % 150)) AS quality FROM orders")
def _(spark, sf):
    o = views.table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), paths.human_size(F.col("o_totalprice")).alias("size"), paths.human_count(F.col("o_orderkey")).alias("count"), paths.shortened(F.col("o_orderpriority"), 7).alias("short"), paths.clamp(F.col("o_orderkey") % 150, 80, 100).alias("quality"))


@query("path_longform", "SELECT p_partkey AS id, CASE WHEN length(p) < 248 THEN p ELSE '\\\\?\\' || p END AS long, p AS plain, false AS network FROM (SELECT p_partkey, 'C:\\' || repeat('d', (p_partkey % 300)::INT) AS p FROM part)")
def _(spark, sf):
    p = F.concat(F.lit("C:\\"), F.repeat(F.lit("d"), (F.col("p_partkey") % 300).cast("int")))
    return views.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), paths.long_form(p).alias("long"), paths.plain_form(paths.long_form(p)).alias("plain"), paths.is_network(p).alias("network"))


@query("copy_name", "SELECT p_partkey AS id, p_partkey % 5 IN (0, 1, 2, 3) AS copy FROM part")
def _(spark, sf):
    s = F.element_at(F.array(*map(F.lit, ("a copy", "b - Copy", "c (2)", "사본 d", "copyright (2) e"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return views.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), paths.looks_like_copy(s).alias("copy"))


@query("kind_counts", f"WITH {PAIRS} SELECT kind, count(*) AS n, sum(size)::BIGINT AS bytes FROM pairs GROUP BY ALL")
def _(spark, sf):
    p = views.pairs(spark, sf)
    kind = paths.kind_of(paths.extension(paths.basename(F.col("path"))))
    return p.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("junk_filter", "SELECT p_partkey AS id, p_partkey % 5 < 3 AS junk, p_partkey % 5 = 3 AS media, p_partkey % 3 = 0 AS cloud, p_partkey % 2 = 0 AS readonly FROM part")
def _(spark, sf):
    k = F.col("p_partkey")
    name = F.element_at(F.array(*map(F.lit, ("Thumbs.db", ".DS_Store", "._a.jpg", "a.JPEG", "a.txt"))), (k % 5 + 1).cast("int"))
    media = paths.is_media(paths.extension(name)) & ~paths.is_junk(name)
    return views.table(spark, sf, "part").select(k.alias("id"), paths.is_junk(name).alias("junk"), media.alias("media"), paths.is_cloud_only(F.when(k % 3 == 0, 0x1000).otherwise(32)).alias("cloud"), paths.is_readonly(F.when(k % 2 == 0, 0o444).otherwise(0o644)).alias("readonly"))


@query("sniff_counts", "SELECT ['JPEG', 'PNG', 'GIF', 'WEBP', 'BMP', 'TIFF', 'HEIC', 'AVIF', 'MOV', '3GP', 'CR3', 'MP4', 'MOV', ''][1 + o_orderkey % 14] AS fmt, count(*) AS n FROM orders GROUP BY ALL")
def _(spark, sf):
    heads = ("FFD8FFE1", "89504E470D0A1A0A", "474946383961", "52494646000000005745425020", "424D0000", "4D4D002A", "000000186674797068656963", "000000186674797061766966", "000000186674797071742020", "000000186674797033677034", "000000186674797063727820", "00000018667479706d703432", "000000086D6F6F76", "0001")
    head = F.unhex(F.element_at(F.array(*map(F.lit, heads)), (F.col("o_orderkey") % 14 + 1).cast("int")))
    return views.table(spark, sf, "orders").groupBy(paths.sniff(head).alias("fmt")).agg(F.count("*").alias("n"))


@query("i18n_lookup", "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN '카메라' WHEN 1 THEN '날짜 없음' ELSE 'no_such_key' END AS text FROM customer")
def _(spark, sf):
    key = F.element_at(F.array(F.lit("source_camera"), F.lit("folder_nodate"), F.lit("no_such_key")), (F.col("c_custkey") % 3 + 1).cast("int"))
    c = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), key.alias("key"))
    return labels.lookup(c, labels.language_table(spark), "ko").select("id", "text")


@query("pref_coerce", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 200 BETWEEN 80 AND 100 THEN o_orderkey % 200 ELSE 92 END AS quality, CASE o_orderkey % 3 WHEN 1 THEN 'copy' ELSE 'move' END AS mode FROM orders")
def _(spark, sf):
    k = F.col("o_orderkey")
    mode = F.element_at(F.array(F.lit("move"), F.lit("copy"), F.lit("steal")), (k % 3 + 1).cast("int"))
    return views.table(spark, sf, "orders").select(k.alias("id"), labels.coerce_column("quality", (k % 200).cast("string")).alias("quality"), labels.coerce_column("mode", mode).alias("mode"))


@query("version_notice", "SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN '1.2.' || c_custkey END AS latest, c_custkey % 4 < 2 AS korean FROM customer")
def _(spark, sf):
    k = F.col("c_custkey").cast("string")
    site = "https://tools.example/"
    base = lambda flag, url: F.concat(F.lit('{"updateAvailable": ' + flag + ', "latest": " 1.2.'), k, F.lit('", "url": "' + url + 'x"}'))
    answers = F.array(base("true", site), base("false", site), base('"true"', site), base("true", "https://other.example/"), F.lit("[]"), F.lit("{broken"))
    note = labels.version_notice(F.element_at(answers, (F.col("c_custkey") % 6 + 1).cast("int")), site, F.lit("0.9"))
    code = F.element_at(F.array(*map(F.lit, ("ko", "ko_KR", "en-US", "kok"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return views.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), note["latest"].alias("latest"), labels.is_korean(code).alias("korean"))


@query(
    "special_folders",
    """WITH c AS (SELECT c_custkey AS id, '/d/' || c_name AS root, CASE c_custkey % 6 WHEN 0 THEN '/d/' || c_name || '/in' WHEN 2 THEN '/D/' || c_name || '/In' WHEN 3 THEN '/e' WHEN 5 THEN '/d/' || c_name || 'x' ELSE '/d/' || c_name END AS dest FROM customer)
    SELECT id, dest AS folder FROM c WHERE id % 6 IN (0, 2) UNION ALL SELECT id, b || '/' || w FROM (SELECT id, root AS b FROM c UNION SELECT id, dest FROM c) t, (VALUES ('_Duplicates'), ('_重複'), ('_중복'), ('_重复'), ('_Original_HEIC'), ('_元HEIC'), ('_원본HEIC'), ('_原始HEIC')) u(w)""",
)
def _(spark, sf):
    """Every customer's folder as a root, with a destination inside it, none, one inside in other case, one elsewhere, the root itself and one beside it."""
    k, root = F.col("c_custkey"), F.concat(F.lit("/d/"), F.col("c_name"))
    dest = F.element_at(F.array(F.concat(root, F.lit("/in")), F.lit(""), F.concat(F.lit("/D/"), F.col("c_name"), F.lit("/In/")), F.lit("/e"), F.concat(root, F.lit("/")), F.concat(root, F.lit("x"))), (k % 6 + 1).cast("int"))
    return views.table(spark, sf, "customer").select(k.alias("id"), F.explode(labels.special_folders_of(root, dest)).alias("folder"))


@query("exclude_subtree", f"WITH {FILES} SELECT id FROM files WHERE NOT (path = '/lib/src1' OR path LIKE '/lib/src1/%')")
def _(spark, sf):
    return views.files(spark, sf).where(~folders.subtree_filter(F.col("path"), "/LIB/src1/")).select("id")


# Grouping, duplicates, similar pictures -------------------------------------------------------


@query("group_pairs", f"WITH {PAIRS} SELECT any_value(path) FILTER (rn = 1) AS lead, string_agg(ext, ' ' ORDER BY ord, name) AS members, sum(size)::BIGINT AS size FROM items GROUP BY o, CASE WHEN pair THEN '' ELSE name END")
def _(spark, sf):
    g = grouping.group_pairs(views.pairs(spark, sf))
    return g.select(F.col("members")[0]["path"].alias("lead"), F.array_join("members.ext", " ").alias("members"), F.aggregate("members.size", F.lit(0).cast("long"), lambda a, x: a + x).alias("size"))


@query("pair_primary", f"WITH {PAIRS}, r AS (SELECT path, row_number() OVER (PARTITION BY o ORDER BY ord, name) AS rn FROM pairs) SELECT path FROM r WHERE rn = 1")
def _(spark, sf):
    return grouping.primaries(views.pairs(spark, sf)).select("path")


@query(
    "pair_date",
    f"""WITH {PAIRS}, g AS (SELECT any_value(path) FILTER (rn = 1) AS lead, any_value(n) FILTER (rn = 1) AS n1, any_value(kind) FILTER (rn = 1) AS k1, bool_or(n % 2 = 1 AND rn > 1) AS other FROM items GROUP BY o, CASE WHEN pair THEN '' ELSE name END)
    SELECT lead, CASE WHEN k1 = 'sidecar' THEN '' WHEN n1 % 2 = 1 THEN 'exif' WHEN other THEN 'pair' ELSE '' END AS basis, CASE WHEN k1 <> 'sidecar' AND (n1 % 2 = 1 OR other) THEN '2001-02-03 04:05:06' END AS "when" FROM g""",
)
def _(spark, sf):
    g = grouping.dated_items(grouping.group_pairs(views.pairs(spark, sf)), Options("/p"))
    return g.select(F.col("members")[0]["path"].alias("lead"), "basis", text(F.col("when")).alias("when"))


@query("sort_items", f"WITH {PAIRS} SELECT path, row_number() OVER (ORDER BY lower(path)) - 1 AS item_idx FROM items WHERE rn = 1")
def _(spark, sf):
    g = grouping.numbered(grouping.group_pairs(views.pairs(spark, sf)).select("key", "members"))
    return g.select(F.col("members")[0]["path"].alias("path"), "item_idx")


_KEPT = f"""WITH {FILES}, c AS (SELECT *, count(*) OVER (PARTITION BY size, quick) AS c1 FROM files WHERE size > 0),
d AS (SELECT *, count(*) OVER w AS c2, row_number() OVER (PARTITION BY size, quick, sha1 ORDER BY n_members DESC, by_name, length(path), lower(path)) AS rn, first_value(path) OVER (PARTITION BY size, quick, sha1 ORDER BY n_members DESC, by_name, length(path), lower(path)) AS keeper FROM c WHERE c1 > 1 WINDOW w AS (PARTITION BY size, quick, sha1))"""


@query("dedupe_exact", _KEPT + " SELECT lower(path) AS key, keeper AS dup_of, 'exact' AS reason FROM d WHERE c2 > 1 AND rn > 1")
def _(spark, sf):
    return duplicates.find_exact(views.files(spark, sf))


@query("dedupe_keeper", f"WITH {FILES} SELECT path, row_number() OVER w AS rn, first_value(path) OVER w AS keeper FROM files WINDOW w AS (PARTITION BY size, quick, sha1 ORDER BY n_members DESC, by_name, length(path), lower(path))")
def _(spark, sf):
    return duplicates.keepers_by_window(views.files(spark, sf)).select("path", "rn", "keeper")


@query("dedupe_summary", _KEPT + " SELECT count(*) AS copies, count(DISTINCT keeper) AS groups, coalesce(sum(size), 0)::BIGINT AS bytes FROM d WHERE c2 > 1 AND rn > 1")
def _(spark, sf):
    f = views.files(spark, sf)
    d = duplicates.find_exact(f).join(f.select("key", "size"), "key")
    return d.agg(F.count("*").alias("copies"), F.count_distinct("dup_of").alias("groups"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


@query("phash_bits", f"WITH {BITS} SELECT idx, h FROM bits")
def _(spark, sf):
    return views.blocks(spark, sf).select("idx", perceptual.phash_bits(F.col("block")).alias("h"))


def _turned_sql(place: str, odd: str) -> str:
    block = f"list_transform(range(64), lambda i: CASE WHEN ({odd}) % 2 = 1 THEN -block[({place}) + 1] ELSE block[({place}) + 1] END)"
    return BITS.replace("md AS (SELECT idx, block,", f"tb AS (SELECT idx, {block} AS block FROM b), md AS (SELECT idx, block,").replace("FROM b),\nraw", "FROM tb),\nraw")


_TURNS = ", ".join(f"q{q} AS (WITH {_turned_sql(p, o)} SELECT idx, h FROM bits)" for q, (p, o) in {1: ("i % 8 * 8 + i // 8", "i // 8"), 2: ("i", "i % 8 + i // 8"), 3: ("i % 8 * 8 + i // 8", "i % 8")}.items())


@query("phash_rotations", f"WITH q0 AS (WITH {BITS} SELECT idx, h FROM bits), {_TURNS} SELECT idx, q0.h AS r0, q1.h AS r90, q2.h AS r180, q3.h AS r270 FROM q0 JOIN q1 USING (idx) JOIN q2 USING (idx) JOIN q3 USING (idx)")
def _(spark, sf):
    r = views.blocks(spark, sf).select("idx", perceptual.phash_rotations(F.col("block")).alias("r"))
    return r.select("idx", *[F.col("r")[i].alias(f"r{90 * i}") for i in range(4)])


@query("dct_low", "")
def _(spark, sf):
    """Coefficients of flat pictures: the first one alone is not zero."""
    b = views.table(spark, sf, "supplier").select("s_suppkey", perceptual.dct_low(F.array_repeat(F.col("s_nationkey").cast("double"), 1024)).alias("c"))
    return b.select("s_suppkey", F.round(F.col("c")[0], 3).alias("dc"), F.round(F.array_max(F.transform(F.slice("c", 2, 63), F.abs)), 3).alias("rest"))


ORACLES["dct_low"] = "SELECT s_suppkey, round(s_nationkey::DOUBLE * 1024, 3) AS dc, 0.0::DOUBLE AS rest FROM supplier"


@query("lsh_candidates", f"WITH {HASHES} SELECT idx, other FROM cand")
def _(spark, sf):
    return similar.candidate_pairs(views.hashes(spark, sf))


@query("hamming_pairs", f"WITH {HASHES} SELECT idx, other, distance FROM dist WHERE distance <= 6")
def _(spark, sf):
    return similar.near_pairs(views.hashes(spark, sf), 6)


_GROUPS = f"""WITH RECURSIVE {HASHES}, edge AS (SELECT idx AS a, other AS b FROM dist WHERE distance <= 6 UNION SELECT other, idx FROM dist WHERE distance <= 6),
walk AS (SELECT a AS node, a AS root FROM edge UNION SELECT e.b, w.root FROM walk w JOIN edge e ON e.a = w.node),
roots AS (SELECT node AS idx, min(root) AS root FROM walk GROUP BY node), groups AS (SELECT idx, dense_rank() OVER (ORDER BY root) AS group_no FROM roots)"""


@query("similar_groups", _GROUPS + " SELECT idx, group_no FROM groups")
def _(spark, sf):
    return similar.groups(views.hashes(spark, sf), 6)[0]


@query("similar_suggest", _GROUPS + ", p AS (SELECT idx, group_no, 1000 - idx % 4 * 0 AS px, idx % 8 = 0 AS kakao, (idx % 3)::BIGINT AS size FROM groups), f AS (SELECT group_no, count(*) FILTER (kakao) AS nk, count(*) AS n, arg_max(idx, size * 1000000 - idx) AS kept FROM p GROUP BY ALL) SELECT idx, CASE WHEN nk > 0 AND nk < n THEN kakao ELSE idx <> kept END AS suggested FROM p JOIN f USING (group_no)")
def _(spark, sf):
    g, edges = similar.groups(views.hashes(spark, sf), 6)
    m = g.withColumn("stem", F.when(F.col("idx") % 8 == 0, "KakaoTalk_20240101_010101").otherwise("x")).withColumn("pixels", F.lit(1000))
    m = m.withColumn("when", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).withColumn("size", F.col("idx") % 3).withColumn("path", F.lit("/p"))
    return similar.suggestions(m, edges).select("idx", "suggested")


@query("similar_suggest_pixels", _GROUPS + ", p AS (SELECT idx, group_no, (100 + idx % 4 * 10)::BIGINT * (50 + idx % 3) AS pixels FROM groups), f AS (SELECT group_no, max(pixels) AS best, min(pixels) AS least, min(idx) AS kept FROM p GROUP BY ALL) SELECT idx, pixels, CASE WHEN least < best THEN pixels < best ELSE idx <> kept END AS suggested FROM p JOIN f USING (group_no)")
def _(spark, sf):
    """Widths and heights are read from the headers of four formats in turn."""
    g, edges = similar.groups(views.hashes(spark, sf), 6)
    m = g.withColumn("size", stills.header_size(views.picture_head(F.col("idx"), 100 + F.col("idx") % 4 * 10, 50 + F.col("idx") % 3)))
    m = m.select("idx", "group_no", F.lit("x").alias("stem"), perceptual.pixels(F.col("size")).alias("pixels"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("when"), F.lit(1).cast("long").alias("size"), F.lit("/p").alias("path"))
    return similar.suggestions(m, edges).select("idx", "pixels", "suggested")


@query("similar_estimate", f"WITH {PAIRS} SELECT round(sum(CASE kind WHEN 'jpeg' THEN 0.02 WHEN 'image' THEN 0.04 WHEN 'heic' THEN 0.09 WHEN 'raw' THEN 0.25 ELSE 0 END)::DOUBLE, 3) AS seconds FROM pairs")
def _(spark, sf):
    return similar.estimate_seconds(views.pairs(spark, sf)).select(F.round("seconds", 3).alias("seconds"))


# Plans ----------------------------------------------------------------------------------------


def _planned(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as planned items: state, target and members by their keys."""
    o = views.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ("ok", "dup", "nodate", "same", "conflict"))), (k % 5 + 1).cast("int"))
    path = F.concat(F.lit("/s/"), (k % 50).cast("string"), F.lit("/"), k.cast("string"), F.lit(".jpg"))
    member = F.struct(path.alias("path"), F.floor("o_totalprice").cast("long").alias("size"), F.lit(".jpg").alias("ext"))
    dst = F.when(status == "same", path).when((status == "dup") & (k % 2 == 0), "").otherwise(F.concat(F.lit("/d/"), k.cast("string"), F.lit(".jpg")))
    rows = o.select(k.alias("item_idx"), path.alias("key"), F.array(member).alias("members"), status.alias("status"), F.array(dst).alias("dsts"), F.when((k % 7 == 0) & (status != "dup"), "/d/x.jpg").otherwise("").alias("convert_dst"), F.lit("").alias("heic_dst"), (k % 11 != 0).alias("checked"), F.lit(False).alias("present"), (k % 715).alias("similar"), F.when(status == "dup", F.concat(F.lit("/s/"), ((k - 1) % 50).cast("string"), F.lit("/"), (k - 1).cast("string"), F.lit(".jpg"))).otherwise("").alias("dup_of"))
    rows = rows.withColumn("moves", planner.moves())
    return rows.withColumn("acts", planner.acts())


PLANNED = """p AS (SELECT o_orderkey AS k, floor(o_totalprice)::BIGINT AS size, ['ok', 'dup', 'nodate', 'same', 'conflict'][1 + o_orderkey % 5] AS status, o_orderkey % 11 <> 0 AS checked, o_orderkey % 715 AS sim FROM orders),
q AS (SELECT *, '/s/' || k % 50 || '/' || k || '.jpg' AS key, status = 'dup' AND k % 2 = 0 AS bin, status <> 'same' AND NOT (status = 'dup' AND k % 2 = 0) AS moves, k % 7 = 0 AND status <> 'dup' AS conv FROM p),
planned AS (SELECT *, checked AND (moves OR conv OR bin) AS acts FROM q)"""


@query("plan_summary", f"WITH {PLANNED} SELECT count(*) FILTER (status <> 'dup' AND checked AND moves) AS \"move\", count(*) FILTER (checked AND conv) AS \"convert\", count(*) FILTER (status = 'nodate') AS nodate, count(*) FILTER (status = 'dup') AS dupes, count(*) FILTER (status NOT IN ('dup', 'nodate') AND NOT acts) AS same, 3::BIGINT AS folders FROM planned")
def _(spark, sf):
    return planner.summary(_planned(spark, sf), 3)


@query("plan_actionable", f"WITH {PLANNED} SELECT count(*) FILTER (acts) + 3 AS actionable FROM planned")
def _(spark, sf):
    return planner.actionable(_planned(spark, sf), 3)


@query("blocked_groups", f"WITH {PLANNED}, g AS (SELECT 's' || sim AS \"group\", status, checked FROM planned WHERE sim > 0), d AS (SELECT 'd' || b.key AS \"group\", a.status, a.checked, b.status AS s2, b.checked AS c2 FROM planned a JOIN planned b ON a.status = 'dup' AND b.k = a.k - 1), e AS (SELECT \"group\", status, checked FROM g UNION ALL SELECT \"group\", status, checked FROM d UNION ALL SELECT DISTINCT \"group\", s2, c2 FROM d) SELECT \"group\", count(*) AS n FROM e GROUP BY \"group\" HAVING count(*) > 1 AND bool_and(status = 'dup' AND checked)")
def _(spark, sf):
    return planner.blocked_groups(_planned(spark, sf))


@query("space_need", f"WITH {PLANNED} SELECT sum(CASE WHEN moves THEN size ELSE 0 END + CASE WHEN conv THEN 2 * size ELSE 0 END)::BIGINT AS need FROM planned WHERE acts")
def _(spark, sf):
    return planner.space_need(_planned(spark, sf), "copy")


@query("view_todo", f"WITH {PLANNED} SELECT k AS item_idx FROM planned WHERE acts")
def _(spark, sf):
    return planner.view(_planned(spark, sf), "todo").select("item_idx")


@query("view_dup_sorted", f"WITH {PLANNED} SELECT k AS item_idx, row_number() OVER (ORDER BY coalesce(nullif(sim, 0), 1000000000), key) AS place FROM planned WHERE status = 'dup' OR sim > 0 ORDER BY place LIMIT 200")
def _(spark, sf):
    top = ordering.page(planner.view(_planned(spark, sf), "dup"), ordering.duplicates_view_order(), 0, 200)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*ordering.duplicates_view_order()))).select("item_idx", "place")


@query("view_failed", f"WITH {PLANNED} SELECT k AS item_idx FROM planned WHERE k % 100 = 0")
def _(spark, sf):
    p = _planned(spark, sf)
    return planner.view(p, "failed", p.where("item_idx % 100 = 0").select("key")).select("item_idx")


@query("page_offset_limit", f"WITH {PLANNED} SELECT k AS item_idx, key FROM planned ORDER BY key LIMIT 25 OFFSET 100")
def _(spark, sf):
    return ordering.page(_planned(spark, sf), ["key"], 100, 25).select("item_idx", "key")


@query("number_names", "WITH r AS (SELECT o_orderkey AS item_idx, '/d/' || o_custkey AS folder, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) SELECT item_idx, folder || '/IMG' || CASE WHEN n > 1 THEN ' (' || n || ')' ELSE '' END || '.jpg' AS target FROM r")
def _(spark, sf):
    o = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("item_idx"), F.concat(F.lit("/d/"), F.col("o_custkey").cast("string")).alias("folder"), F.lit("IMG").alias("stem"), F.lit(".jpg").alias("ext"))
    return placement.number_names(o).select("item_idx", "target")


def _placing_items(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as dated items of one name a customer, every order with other bytes."""
    o = views.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    path = F.concat(F.lit("/in/"), k.cast("string"), F.lit("/IMG.jpg"))
    member = F.struct(path.alias("path"), F.lit("IMG.jpg").alias("name"), F.lit("IMG").alias("stem"), F.lit(".jpg").alias("ext"), k.cast("long").alias("size"), F.lit("jpeg").alias("kind"), k.cast("string").alias("sha1"))
    blank = F.lit("")
    return o.select(k.alias("item_idx"), path.alias("key"), F.array(member).alias("members"), F.col("o_orderdate").cast("timestamp_ntz").alias("when"), F.lit("camera").alias("source"), F.lit("exif").alias("basis"), F.lit("same").alias("status"), blank.alias("dup_of"), blank.alias("dup_reason"), F.lit(False).alias("convert"), F.lit(False).alias("keep"), F.lit(True).alias("checked"))


@query("place_full", "WITH r AS (SELECT o_orderkey AS item_idx, strftime(o_orderdate, '%Y-%m') AS d, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_orderkey) AS n FROM orders) SELECT item_idx, '/out/' || d || '/IMG' || CASE WHEN n > 1 THEN ' (' || n || ')' ELSE '' END || '.jpg' AS dst, CASE WHEN n > 1 THEN 'conflict' ELSE 'same' END AS status FROM r")
def _(spark, sf):
    """The stateful placement where all names collide and all bytes differ."""
    files = spark.createDataFrame([], "path string, size long, sha1 string, scanned boolean")
    out = placement.place_items(_placing_items(spark, sf), files, Options("/in", "/out", template="{yyyy-mm}"))
    return out.select("item_idx", F.col("dsts")[0].alias("dst"), "status")


@query("place_twins", "SELECT o_orderkey AS item_idx, CASE WHEN row_number() OVER w = 1 THEN '' ELSE 'name' END AS dup_reason, CASE WHEN row_number() OVER w = 1 THEN 'same' ELSE 'dup' END AS status FROM orders WINDOW w AS (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_orderkey)")
def _(spark, sf):
    """Placement where equal names have equal bytes: all but the first of a folder are duplicates."""
    rows = _placing_items(spark, sf)
    m = F.col("members")[0].withField("size", F.lit(5).cast("long")).withField("sha1", F.lit("x"))
    files = spark.createDataFrame([], "path string, size long, sha1 string, scanned boolean")
    out = placement.place_items(rows.withColumn("members", F.array(m)), files, Options("/in", "/out", template="{yyyy-mm}"))
    return out.select("item_idx", "dup_reason", "status")


@query(
    "empty_dirs",
    f"""WITH {TREE}, u AS (SELECT folder AS path, junk, leaving FROM o UNION ALL SELECT regexp_extract(folder, '^/t/r[0-9]+/n[0-9]+'), junk, leaving FROM o UNION ALL SELECT regexp_extract(folder, '^/t/r[0-9]+'), junk, leaving FROM o),
    d AS (SELECT folder AS path FROM f UNION SELECT regexp_extract(folder, '^/t/r[0-9]+/n[0-9]+') FROM f UNION SELECT regexp_extract(folder, '^/t/r[0-9]+') FROM f)
    SELECT path FROM u JOIN d USING (path) WHERE path NOT LIKE '/t/r0%' GROUP BY path HAVING bool_and(junk OR leaving) AND bool_or(leaving AND NOT junk)""",
)
def _(spark, sf):
    rows, low = views.tree(spark, sf)
    up = low.select(F.explode(folders.ancestors(F.col("path"), F.lit("/t"), True)).alias("path")).distinct()
    keep = low.where("path like '/t/r0/%'").select(F.concat("path", F.lit("/x")).alias("path"))
    return folders.emptied_folders(rows, up, keep, "/t")


@query("incremental_scan", f"WITH {FILES} SELECT CASE WHEN id % 10 <> 0 AND id % 7 <> 0 THEN 'reused' ELSE 'read' END AS how, count(*) AS n, sum(size)::BIGINT AS bytes FROM files GROUP BY ALL")
def _(spark, sf):
    f = views.files(spark, sf).withColumn("ident", incremental.identity(F.lit(1), F.col("id"), F.col("path"))).withColumn("mtime", F.lit(1.0))
    old = f.withColumn("error", F.when(F.col("id") % 7 == 0, "broken").otherwise("")).withColumn("mtime", F.when(F.col("id") % 10 == 0, 2.0).otherwise(1.0)).select("ident", "size", "mtime", "error", "sha1")
    same, new = incremental.reuse(f.drop("sha1"), old, ["sha1"])
    both = same.select(F.lit("reused").alias("how"), "size").union(new.select(F.lit("read"), "size"))
    return both.groupBy("how").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("total_bytes", f"WITH {FILES} SELECT sum(size)::BIGINT AS total_bytes FROM files")
def _(spark, sf):
    return incremental.total_bytes(views.files(spark, sf))


# Runs and undo --------------------------------------------------------------------------------


@query("run_counts", f"WITH {STEPS} SELECT run_id, " + ", ".join(f"count(*) FILTER (op = '{k}') AS n_{k}" for k in ("move", "copy", "trash", "mkdir", "rmdir", "convert")) + ", count(*) FILTER (op IN ('move', 'copy', 'trash')) AS files FROM steps GROUP BY run_id")
def _(spark, sf):
    return history.run_counts(views.ops(spark, sf))


_CUT = "cut AS (SELECT user_id, min(event_id) AS at FROM events WHERE event_id % 97 = 0 GROUP BY 1), left_ AS (SELECT e.user_id, e.event_id, e.event_type FROM events e LEFT JOIN cut c ON c.user_id = e.user_id WHERE c.at IS NULL OR e.event_id < c.at)"


@query("journal_recovered", f"WITH {_CUT} SELECT user_id::VARCHAR AS log, 'r' || user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, event_type AS op FROM left_ WHERE user_id % 3 <> 0 UNION ALL SELECT DISTINCT user_id::VARCHAR, 'r' || user_id, 0, 'told' FROM events WHERE user_id % 3 = 0 OR (user_id % 3 = 1 AND user_id NOT IN (SELECT user_id FROM left_))")
def _(spark, sf):
    """Every user's events as the journal of a run, cut at a line: of users by three the run is closed, open with a step in its document, or not in it."""
    e = views.table(spark, sf, "events")
    line = F.when(F.col("event_id") % 97 == 0, F.lit('{"op": "br')).otherwise(F.to_json(F.struct(F.col("event_type").alias("op"))))
    log = F.col("user_id").cast("string").alias("log")
    head = F.concat(F.lit('{"journal": {"id": "r'), F.col("user_id").cast("string"), F.lit('", "open": true}}'))
    at = lambda n: F.struct(F.lit(0).cast("long").alias("split"), n.cast("long").alias("line")).alias("at")
    lines = e.select(log, at(F.col("event_id")), line.alias("value")).union(e.select("user_id").distinct().select(log, at(F.lit(-1)), head))
    runs = e.where("user_id % 3 < 2").select("user_id").distinct()
    runs = runs.select(log, F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("id"), (F.col("user_id") % 3 == 1).alias("open"), F.array(F.struct(F.lit("told").alias("op"))).alias("ops"))
    return history.recovered_steps(runs, lines, "struct<op:string>").select("log", "id", "seq", "op")


@query("undo_latest_run", f"WITH {STEPS} SELECT max(run_id) AS run_id FROM steps WHERE NOT undone")
def _(spark, sf):
    return history.latest_pending(views.ops(spark, sf))


@query("undo_blockers", f"WITH {STEPS} SELECT DISTINCT a.run_id, b.run_id AS blocked_by FROM steps a JOIN steps b ON a.op IN ('move', 'copy') AND b.op IN ('move', 'trash') AND NOT b.undone AND b.run_id > a.run_id AND a.dst = b.src")
def _(spark, sf):
    return history.all_blockers(views.ops(spark, sf))


@query("undo_blockers_of_run", f"WITH {STEPS} SELECT DISTINCT run_id FROM steps WHERE run_id > 3 AND NOT undone AND op IN ('move', 'trash') AND src IN (SELECT dst FROM steps WHERE run_id = 3 AND op IN ('move', 'copy'))")
def _(spark, sf):
    return history.blockers(views.ops(spark, sf), 3)


@query("undo_reverse_order", f"WITH {STEPS} SELECT run_id, seq, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS undo_seq FROM steps")
def _(spark, sf):
    return history.reversed_ops(views.ops(spark, sf)).select("run_id", "seq", "undo_seq")


@query("undo_outcome", f"WITH {STEPS} SELECT seq, CASE op WHEN 'move' THEN CASE WHEN substr(dst, 4)::INT % 2 = 1 THEN 'missing' WHEN substr(src, 4)::INT % 2 = 0 AND src <> dst THEN 'original_taken' ELSE 'restore' END WHEN 'copy' THEN CASE WHEN substr(dst, 4)::INT % 2 = 1 THEN 'gone' WHEN seq % 3 <> 0 THEN 'copy_changed' ELSE 'remove' END WHEN 'trash' THEN 'in_bin' WHEN 'mkdir' THEN 'remove_folder' ELSE 'make_folder' END AS outcome FROM steps")
def _(spark, sf):
    steps = views.ops(spark, sf).withColumn("size", F.when(F.col("seq") % 3 == 0, 1).otherwise(2).cast("long")).withColumn("mtime_ns", F.lit(5).cast("long"))
    there = spark.range(0, 98, 2).select(F.concat(F.lit("/s/"), F.col("id").cast("string")).alias("path"), F.lit(1).cast("long").alias("size"), F.lit(5).cast("long").alias("mtime_ns"))
    return history.undo_outcome(steps, there).select("seq", "outcome")


@query("run_metrics", f"WITH {STEPS} SELECT count(*) FILTER (ok AND op IN ('move', 'copy')) AS done, count(*) FILTER (ok AND op = 'convert') AS converted, count(*) FILTER (ok AND op = 'trash') AS trashed, count(*) FILTER (ok AND op = 'rmdir') AS folders_removed, coalesce(sum(seq) FILTER (ok AND op = 'convert'), 0)::BIGINT AS bytes_in, coalesce(sum(run_id) FILTER (ok AND op = 'convert'), 0)::BIGINT AS bytes_out FROM (SELECT seq, run_id, CASE WHEN op = 'copy' AND seq % 2 = 0 THEN 'convert' ELSE op END AS op, seq % 10 <> 0 AS ok FROM steps)")
def _(spark, sf):
    o = views.ops(spark, sf)
    op = F.when((F.col("op") == "copy") & (F.col("seq") % 2 == 0), "convert").otherwise(F.col("op"))
    return history.run_metrics(o.select(op.alias("op"), (F.col("seq") % 10 != 0).alias("ok"), F.col("seq").alias("bytes_in"), F.col("run_id").alias("bytes_out")))


@query("failed_to_item", f"WITH {FILES} SELECT CASE WHEN id % 2 = 0 THEN 'item' || id ELSE lower(path) END AS key, 'r' AS reason FROM files WHERE id % 5 = 0")
def _(spark, sf):
    f = views.files(spark, sf)
    members = f.where("id % 2 = 0").select("path", F.concat(F.lit("item"), F.col("id").cast("string")).alias("key"))
    return history.failed_items(f.where("id % 5 = 0").select("path", F.lit("r").alias("reason")), members)


@query("log_by_folder", "SELECT DISTINCT '/log/' || user_id % 9 AS log FROM events WHERE 'src' || user_id % 7 = 'src3' OR 'dst' || user_id % 5 = 'src3'")
def _(spark, sf):
    u = F.col("user_id")
    runs = views.table(spark, sf, "events").select(F.concat(F.lit("/log/"), (u % 9).cast("string")).alias("log"), F.concat(F.lit("SRC"), (u % 7).cast("string")).alias("source"), F.concat(F.lit("dst"), (u % 5).cast("string")).alias("dest"))
    return history.logs_for_folder(runs, "src3")


@query("distinct_logs", "SELECT '/log/' || user_id % 9 AS log, min(event_id) AS idx FROM events GROUP BY ALL")
def _(spark, sf):
    e = views.table(spark, sf, "events").select(F.concat(F.lit("/log/"), (F.col("user_id") % 9).cast("string")).alias("log"), F.col("event_id").alias("idx"))
    return ordering.distinct_in_order(e, "log", "idx")


@query("sort_depth_runs", "SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey % 4 DESC, o_orderkey) AS by_depth FROM orders")
def _(spark, sf):
    o = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.repeat(F.lit("/a"), (F.col("o_orderkey") % 4).cast("int")), F.lit("/"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("path"))
    depth = F.length("path") - F.length(F.replace(F.col("path"), F.lit("/")))
    return ordering.with_position(o.withColumn("up", -depth), ["up", "path"], "by_depth", 1).select("id", "by_depth")


# Binary readers (rows only where SQL has no parser) ---------------------------------------------


@query("meta_camera", "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'Canon EOS' WHEN 1 THEN 'Apple iPhone' ELSE 'iPhone' END AS camera FROM customer")
def _(spark, sf):
    k = F.col("c_custkey") % 3
    return views.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), binary.camera_name(F.when(k == 0, "canon").when(k == 1, " Apple").otherwise(""), F.when(k == 0, "Canon EOS").otherwise("iPhone")).alias("camera"))


@query("meta_mvhd", "SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS made FROM events")
def _(spark, sf):
    """Movie headers built from the events' times and read back."""
    e = views.names(spark, sf)
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp")) + binary.MAC_EPOCH

    def run(batches):
        import pandas as pd

        for b in batches:
            heads = [b"\0\0\0\0" + int(s).to_bytes(4, "big") + b"\0" * 12 for s in b["s"]]
            yield pd.DataFrame({"id": b["id"], "unix": [binary.movie_seconds(h) for h in heads]})

    out = e.select("id", seconds.alias("s")).mapInPandas(run, "id long, unix long")
    return out.select("id", F.date_format(F.timestamp_seconds("unix").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss").alias("made"))
