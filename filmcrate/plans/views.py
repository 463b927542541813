"""Catalog-shaped views of the star-schema tables, so that operators can be checked against SQL on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import perceptual


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ts(col: str, shape: str):
    return F.date_format(col, shape)


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, stem: file names made from the events' times, eight shapes in turn."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    day, clock, k = _ts("ts", "yyyyMMdd"), _ts("ts", "HHmmss"), F.col("id") % 8
    stem = (
        F.when(k == 0, F.concat(F.lit("KakaoTalk_"), day, F.lit("_"), clock, F.lit("123")))
        .when(k == 1, F.concat(F.lit("Screenshot_"), day, F.lit("_"), clock))
        .when(k == 2, F.concat(day, F.lit("_"), clock))
        .when(k == 3, F.concat(F.lit("PXL_"), day, F.lit("_"), clock, F.lit("789")))
        .when(k == 4, F.concat(F.lit("IMG-"), day, F.lit("-WA"), F.col("id").cast("string")))
        .when(k == 5, F.concat(F.lit("band_"), day))
        .when(k == 6, F.concat(F.lit("trip "), _ts("ts", "yyyy-MM-dd"), F.lit(" "), _ts("ts", "HH.mm.ss")))
        .otherwise(F.concat(F.lit("DSC"), (F.col("id") % 1000).cast("string")))
    )
    return e.select("id", "ts", stem.alias("stem"))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, text, ts: metadata texts made from the orders' dates, eight shapes in turn."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"))
    k = F.col("id") % 8
    text = (
        F.when(k == 0, _ts("ts", "yyyy:MM:dd HH:mm:ss"))
        .when(k == 1, _ts("ts", "yyyy-MM-dd'T'HH:mm:ss"))
        .when(k == 2, _ts("ts", "yyyy/MM/dd HH:mm:ss"))
        .when(k == 3, _ts("ts", "yyyy:MM:dd HH:mm"))
        .when(k == 4, F.lit("0000:00:00 00:00:00"))
        .when(k == 5, F.lit("not a date"))
        .when(k == 6, F.lit("2000:01:01 00:00:00"))
        .otherwise(F.concat(F.lit("2999"), _ts("ts", ":MM:dd HH:mm:ss")))
    )
    return o.select("id", "ts", text.alias("text"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, stem, size, quick, sha1 and more: documents as files, the head being 16 characters."""
    d = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    return d.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("/lib/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("path"),
        F.lower(F.concat(F.lit("/lib/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".jpg"))).alias("key"),
        F.col("doc_id").cast("string").alias("stem"),
        F.octet_length(text).cast("long").alias("size"),
        F.lit("jpeg").alias("kind"),
        F.sha1(F.left(text, F.lit(16)).cast("binary")).alias("quick"),
        F.sha1(text.cast("binary")).alias("sha1"),
        (F.col("doc_id") % 3 + 1).cast("int").alias("n_members"),
        F.when(F.col("doc_id") % 2 == 0, "exif").otherwise("name").alias("basis"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, kind and more: line items as files, an order's lines sharing a stem; a second line 2 ends in jpeg."""
    from ..functions import paths

    ext = F.element_at(F.array(*map(F.lit, (".heic", ".jpg", ".mov", ".aae", ".xmp", ".dng", ".png"))), F.col("n"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")).agg(F.count("*").alias("c"))
    rows = rows.withColumn("ext", F.explode(F.when((F.col("n") == 2) & (F.col("c") > 1), F.array(F.lit(".jpg"), F.lit(".jpeg"))).otherwise(F.array(ext))))
    name = F.concat(F.lit("IMG_"), F.col("o").cast("string"), "ext")
    meta = F.struct(F.when(F.col("n") % 2 == 1, "2001:02:03 04:05:06").otherwise("").alias("exif_original"), F.lit("").alias("exif_digitized"), F.lit("").alias("exif_datetime"), F.lit("").alias("camera"), F.lit(0).alias("orientation"), F.lit(None).cast("timestamp_ntz").alias("video_local"), F.lit(None).cast("timestamp_ntz").alias("video_utc"), F.lit(1).alias("frames"), F.lit("").alias("error"))
    return rows.select(F.concat(F.lit("/p/"), (F.col("o") % 10).cast("string"), F.lit("/"), name).alias("path"), (F.col("o") * 10 + F.col("n")).cast("long").alias("size"), F.lit(0.0).alias("mtime"), paths.kind_of(F.col("ext")).alias("kind"), F.lit("").alias("fmt"), F.lit("").alias("quick"), F.lit("").alias("sha1"), meta.alias("meta"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, block: embeddings as blocks of coefficients."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), F.transform("embedding", lambda x: x.cast("double")).alias("block"))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, phash: the blocks' hashes, and of every fifth block two near copies (one and two bits changed)."""
    h = blocks(spark, sf_dir).select("idx", perceptual.phash_bits(F.col("block")).alias("h"))
    near = F.when(F.col("idx") % 5 == 0, F.array(F.lit(0), F.lit(1), F.lit(3))).otherwise(F.array(F.lit(0)))
    rows = h.select("idx", "h", F.posexplode(near).alias("n", "flip"))
    value = F.col("h").bitwiseXOR(F.col("flip").cast("long"))
    return rows.select((F.col("idx") * 4 + F.col("n")).cast("long").alias("idx"), F.array(value, F.bitwise_not(value), value, F.bitwise_not(value)).alias("phash"))


def picture_head(k: Column, w: Column, h: Column) -> Column:
    """First bytes of a PNG, JPEG, GIF or HEIC file (by ``k``) of a width and height."""
    big = lambda n, size: F.unhex(F.lpad(F.hex(n), size * 2, "0"))
    little = lambda n: F.unhex(F.concat(F.lpad(F.hex(n % 256), 2, "0"), F.lpad(F.hex(F.floor(n / 256)), 2, "0")))
    box = lambda kind, *parts: F.concat(big(sum((F.octet_length(p) for p in parts), F.lit(8)), 4), F.lit(kind), *parts)
    zero = F.lit(bytes(4))
    png = F.concat(F.lit(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR"), big(w, 4), big(h, 4))
    jpeg = F.concat(F.lit(b"\xff\xd8\xff\xe0\0\x04JF\xff\xc0\0\x08\x08"), big(h, 2), big(w, 2))
    gif = F.concat(F.lit(b"GIF89a"), little(w), little(h))
    held = box(b"iprp", box(b"ipco", box(b"ispe", zero, big(w, 4), big(h, 4))), box(b"ipma", zero, F.lit(b"\0\0\0\1\0\1\1\x81")))
    heic = F.concat(box(b"ftyp", F.lit(b"heic"), zero), box(b"meta", zero, box(b"pitm", zero, F.lit(b"\0\1")), held))
    return F.when(k % 4 == 0, png).when(k % 4 == 1, jpeg).when(k % 4 == 2, gif).otherwise(heic)


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, seq, op, src, dst, undone: events as logged steps of a run for every user."""
    e = table(spark, sf_dir, "events")
    kind = F.element_at(F.create_map(*[F.lit(x) for p in (("view", "move"), ("click", "copy"), ("purchase", "trash"), ("signup", "mkdir"), ("error", "rmdir")) for x in p]), F.col("event_type"))
    k = F.col("event_id")
    return e.select(F.col("user_id").alias("run_id"), k.alias("seq"), kind.alias("op"), F.concat(F.lit("/S/"), (k % 97).cast("string")).alias("src"), F.when(kind.isin("move", "copy"), F.concat(F.lit("/s/"), (k * 7 % 97).cast("string"))).alias("dst"), (F.col("user_id") % 4 == 0).alias("undone"))


def tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Files (path, junk, leaving) of a tree region/nation/customer/order, and its folders."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    folder = F.concat(F.lit("/t/r"), F.col("n_regionkey").cast("string"), F.lit("/n"), F.col("c_nationkey").cast("string"), F.lit("/c"), F.col("c_custkey").cast("string"))
    c = c.select("c_custkey", folder.alias("folder"))
    o = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    rows = o.select(F.concat("folder", F.lit("/o"), F.col("o_orderkey").cast("string")).alias("path"), (F.col("o_orderkey") % 11 == 0).alias("junk"), (F.col("o_orderstatus") != "P").alias("leaving"))
    return rows, c.select(F.col("folder").alias("path"))
