"""Fuzzy line deduplication by MinHash, in DataFrame functions alone.

A line (trimmed, lower case) is the set of its character shingles; a shorter line is one
shingle. Its signature holds, for each of BANDS * ROWS fixed points, the shingle hash that
comes nearest to the point by xor: two lines agree in a place with the probability of their
Jaccard similarity. Lines that agree in all ROWS places of a band share a bucket. There every
line is checked by exact Jaccard similarity against the bucket's hub (the line that most
documents share). Lines that this leaves in different components are compared with each
other in cells of bounded size; only links leave a cell. Links become components by
distributed union-find, and the first line of each component stays.

Shingles become rows that are aggregated in the same stage (UNROLL of them a row), so that
hashing and minima stay in generated code. Arrays that are costly to make are exploded by the
outer forms: for the others Spark makes the array twice, first to leave out empty ones. Only lines that share a bucket have their texts
fetched, and only the links' and the repeated lines' places are looked up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

SHINGLE, SIMILAR = 9, 0.8
BANDS, ROWS = 6, 3
#: Shingles hashed by one generated row.
UNROLL = 16
#: Shingles of a block; a bucket with more is dealt out as pairs of blocks, so that a cell holds two blocks at most.
BLOCK = 1 << 18
#: Places of two signatures that must agree (by one byte each) before a pair is checked: fewer agree once in 1,400 pairs at a similarity of exactly 0.8.
LEAST_PLACES = 9
#: Least shingle hashes of a line that are compared before the whole sets, and how many two lines must share: at 0.8 they share fewer once in 20,000 pairs.
SKETCH, SHARED = 64, 38
#: Links that a round gives for one line at most; further ones are found by the next round, if they still lead to another component.
PARTNERS = 64
#: White space that is trimmed; a line of nothing else is blank.
_BLANK = " \t\x0b\x0c\r"
#: Words of 64 bits that hold the parities of a set.
_PARITY = [f"p{i}" for i in range(8)]
_SIGN = [f"s{i}" for i in range(-(-BANDS * ROWS // 8))]


def _point(k: int) -> int:
    """The k-th of the fixed points, a signed 64-bit number."""
    x = (k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % (1 << 64)
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % (1 << 64)
    x ^= x >> 31
    return x - (1 << 64) if x >> 63 else x


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), line_no, lh (hash of the line) and line, of every line that is not blank."""
    rows = common.pick(docs, "doc_id", "text").where("text is not null")
    # beside the explode, the hash of the text would be taken again for every line
    rows = rows.select("doc_id", F.xxhash64("text").alias("th"), F.split("text", "\n", -1).alias("lines"))
    rows = rows.select("doc_id", "th", F.posexplode_outer("lines").alias("line_no", "line"))
    odd = reduce(Column.__or__, [end("line", F.lit(c)) for c in _BLANK for end in (F.startswith, F.endswith)])
    # cutting other characters than the space walks the whole line, so only lines that need it are cut
    rows = rows.withColumn("line", F.when(odd, F.trim("line", F.lit(_BLANK))).otherwise(F.col("line"))).where("line <> ''")
    # a text is lower-cased by line: lines of ASCII alone, whatever stands beside them, need no case tables
    rows = rows.withColumn("line", F.lower("line"))
    return rows.select("doc_id", "th", "line_no", F.xxhash64("line").alias("lh"), "line")


def signatures(lines: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """lh, n (how often the line occurs), k0.. (band keys) and s0.. (a byte of each place) of every different line of a table lh, line.

    Shingles are cut from the UTF-8 bytes here, so that each is found without counting
    characters; an edit touches no larger share of them than of the character shingles.
    """
    rows = lines.select("lh", F.col("line").cast("binary").alias("raw"))
    rows = rows.withColumn("last", F.greatest(F.octet_length("raw") - (shingle - 1), F.lit(1)))
    rows = rows.select("lh", "raw", "last", F.explode_outer(F.sequence(F.lit(1), F.col("last"), F.lit(UNROLL))).alias("i"))
    begin = [F.col("i"), *(F.least(F.col("i") + j, F.col("last")) for j in range(1, UNROLL))]
    rows = rows.select("lh", "i", *[F.xxhash64(F.substring("raw", at, F.lit(shingle))).alias(f"h{j}") for j, at in enumerate(begin)])
    nearest = [F.min(F.least(*[F.col(f"h{j}").bitwiseXOR(F.lit(_point(k))) for j in range(UNROLL)])).alias(f"m{k}") for k in range(BANDS * ROWS)]
    found = rows.groupBy("lh").agg(F.sum(F.when(F.col("i") == 1, 1).otherwise(0)).alias("n"), *nearest)
    keys = [F.xxhash64(F.lit(b), *[f"m{k}" for k in range(b * ROWS, (b + 1) * ROWS)]).alias(f"k{b}") for b in range(BANDS)]
    byte = lambda k: F.shiftleft(F.col(f"m{k}").bitwiseAND(F.lit(255)), 8 * (k % 8))
    signs = [reduce(Column.bitwiseOR, map(byte, range(lo, min(lo + 8, BANDS * ROWS)))).alias(name) for lo, name in zip(range(0, BANDS * ROWS, 8), _SIGN, strict=True)]
    return found.select("lh", "n", *keys, *signs)


def _agree(x: list[Column], y: list[Column]) -> Column:
    """Number of places in which two signatures agree."""
    differ = F.lit(0)
    for a, b in zip(x, y, strict=True):
        bits = a.bitwiseXOR(b)
        for shift in (4, 2, 1):
            bits = bits.bitwiseOR(F.shiftrightunsigned(bits, shift))
        differ = differ + F.bit_count(bits.bitwiseAND(F.lit(0x0101010101010101)))
    return F.lit(BANDS * ROWS) - differ


def _bound(value: Column, body) -> Column:
    """``body(value)``, with ``value`` evaluated once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _hashes(raw: Column, shingle: int, width: int) -> Column:
    """Hashes of the shingles of a text of ``width`` bytes a character, repeats included; a shorter text is one shingle."""
    size = shingle * width
    starts = F.sequence(F.lit(1), F.greatest(F.octet_length(raw) - (size - 1), F.lit(1)), F.lit(width))
    return F.transform(starts, lambda i: F.xxhash64(F.substring(raw, i, F.lit(size))))


def shingle_set(line: Column, shingle: int) -> Column:
    """The distinct hashes of a line's character shingles; a line that is shorter is one shingle."""
    return F.array_distinct(_bound(F.encode(line, "UTF-32"), lambda raw: _hashes(raw, shingle, 4)))


def _pair_hashes(x: Column, y: Column, shingle: int) -> list[Column]:
    """Hashes of the shingles of two lines, repeats included, for ``shingle_sets``. Bytes are bound: a cast inside would copy the line for every shingle."""
    plain = (F.octet_length(x) == F.length(x)) & (F.octet_length(y) == F.length(y))
    cut = lambda line: F.when(plain, _bound(line.cast("binary"), lambda raw: _hashes(raw, shingle, 1))).otherwise(_bound(F.encode(line, "UTF-32"), lambda raw: _hashes(raw, shingle, 4)))
    return [cut(x), cut(y)]


def shingle_sets(x: Column, y: Column, shingle: int) -> list[Column]:
    """The sets of two lines that are compared with each other only: cut from their bytes where these are the characters of both."""
    return [F.array_distinct(s) for s in _pair_hashes(x, y, shingle)]


def parities(sets: DataFrame) -> DataFrame:
    """w (the line), units (size of the set) and p0.., the bits that an odd number of the set's hashes falls on, of every row of lh, s.

    Two sets differ in at least as many elements as these bits differ in places, so that
    a pair whose bits differ in too many is certainly not similar.
    """
    rows = sets.select(F.col("lh").alias("w"), F.explode_outer("s").alias("h"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    word = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(len(_PARITY) - 1))
    return rows.groupBy("w").agg(F.count("*").cast("int").alias("units"), *[F.bit_xor(F.when(word == k, bit).otherwise(F.lit(0).cast("long"))).alias(name) for k, name in enumerate(_PARITY)])


def _enough(both: Column, m: Column, n: Column, similar: float) -> Column:
    """Whether sets of m and n elements that share ``both`` have a Jaccard similarity of ``similar`` (to a thousandth) or more."""
    part = F.lit(round(similar * 1000)).cast("long")
    return both * (part + 1000) >= part * (m + n)


def _texts(ids: DataFrame, lines: DataFrame) -> DataFrame:
    """lh and line of every line among ``ids`` (lh)."""
    few = common.maybe_in(lines.select("lh", "line"), "lh", ids).dropDuplicates(["lh"])
    return common.settle(few.join(ids, "lh", "left_semi"), "texts")


def hub_links(met: DataFrame, lines: DataFrame, shingle: int, similar: float) -> tuple[DataFrame, DataFrame]:
    """Links a, b between lines and the hubs of their buckets; lh and line of all lines that are compared, here or later. ``met``: key, lh, hub, size, s0.. and first (the hub's s0..)."""
    near = _agree([F.col(c) for c in _SIGN], [F.col("first")[c] for c in _SIGN]) >= LEAST_PLACES
    pairs = common.settle(met.where("lh <> hub").where(near).select(F.least("lh", "hub").alias("a"), F.greatest("lh", "hub").alias("b")).distinct(), "pairs")
    # lines that a hub may leave apart are fetched as well, so that all lines are read for their texts once
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("lh")).union(met.where("size > 2 and lh <> hub").select("lh"))
    texts = _texts(common.settle(wanted.distinct(), "wanted"), lines)
    both = pairs.join(texts.select(F.col("lh").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("lh").alias("b"), F.col("line").alias("y")), "b")
    # a hub's pairs are dealt out again before their sets are cut
    both = both.repartition(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b")
    x, y = _pair_hashes(F.col("x"), F.col("y"), shingle)
    # exploded, the hashes and their number in common are columns: evaluated once, and compared by generated code
    both = both.select("a", "b", F.array(F.struct(x.alias("x"), y.alias("y"))).alias("p")).select("a", "b", F.explode_outer("p").alias("p")).select("a", "b", "p.*")
    both = both.select("a", "b", "x", "y", F.explode_outer(F.array(F.size(F.array_intersect("x", "y")))).alias("n"))
    # repeats make a line's set seem larger only: a pair that is alike with them is so without, and others have them taken out
    enough = lambda x, y: _enough(F.col("n"), F.size(x), F.size(y), similar)
    alike = F.when(enough(F.col("x"), F.col("y")), True).otherwise(enough(F.array_distinct("x"), F.array_distinct("y")))
    return common.settle(both.where(alike).select("a", "b"), "links"), texts


def _partners(rows: Column, within: Column, similar: float, whole: bool) -> Column:
    """Of a cell's rows (structs lh, root, own, earlier, units, s0.., p0..; if ``whole`` low, s too) a, and partners: lines of other roots that pass the tests.

    Without the whole sets the tests only leave out what is certainly not similar, or as
    good as never. ``earlier`` are the line's keys in the bands before the cell's: a pair
    that meets there is left to that band.
    """

    def partner(x: Column, y: Column) -> Column:
        apart = (y["lh"] < x["lh"]) & (y["root"] != x["root"]) & (within | (y["own"] != x["own"]))
        m, n = x["units"], y["units"]
        agree = _agree([x[c] for c in _SIGN], [y[c] for c in _SIGN]) >= LEAST_PLACES
        differ = reduce(Column.__add__, [F.bit_count(x[c].bitwiseXOR(y[c])) for c in _PARITY])
        part = round(similar * 1000)
        tests = [_enough(F.least(m, n), m, n, similar), differ * (1000 + part) <= (m + n) * (1000 - part), agree, ~F.arrays_overlap(x["earlier"], y["earlier"])]
        if whole:
            near = F.size(F.array_intersect(x["low"], y["low"])) * SKETCH >= F.least(F.size(x["low"]), F.size(y["low"])) * SHARED
            tests += [near, _enough(F.size(F.array_intersect(x["s"], y["s"])), m, n, similar)]
        return reduce(lambda rest, test: F.when(test, rest).otherwise(False), reversed([apart, *tests]), F.lit(True))

    found = F.transform(rows, lambda x: F.struct(x["lh"].alias("a"), F.transform(F.filter(rows, lambda y: partner(x, y)), lambda y: y["lh"]).alias("partners")))
    return F.filter(found, lambda x: F.size(x["partners"]) > 0)


def cell_members(cells: DataFrame, similar: float) -> DataFrame:
    """key, i, j, lh of the lines that may have a partner in their cell (columns key, i, j, rows), by what is known without their sets."""
    found = _partners(F.col("rows"), F.col("i") == F.col("j"), similar, False)
    lines = F.transform(found, lambda x: F.concat(F.array(x["a"]), x["partners"]))
    return cells.select("key", "i", "j", F.explode_outer(F.array_distinct(F.flatten(lines))).alias("lh")).where("lh is not null")


def cell_links(cells: DataFrame, similar: float) -> DataFrame:
    """Links found inside cells (columns key, i, j, rows with whole sets).

    key, a, partners: for each line the first PARTNERS lines of other roots that it is like; and more,
    whether it has further ones.
    """
    rows = F.transform("rows", lambda x: x.withField("low", F.slice(x["s"], 1, SKETCH)))
    cells = cells.select("key", (F.col("i") == F.col("j")).alias("within"), rows.alias("rows"))
    found = cells.select("key", F.explode_outer(_partners(F.col("rows"), F.col("within"), similar, True)).alias("l")).where("l is not null")
    return found.select("key", "l.a", F.slice("l.partners", 1, PARTNERS).alias("partners"), (F.size("l.partners") > PARTNERS).alias("more"))


def apart_links(left: DataFrame, marks: DataFrame, texts: DataFrame, shingle: int, similar: float) -> DataFrame:
    """Links a, b between lines (key, lh, root) of one key and different roots, enough to join all that are similar. ``texts``: lh, line of these and others.

    Buckets of more than BLOCK shingles are dealt out as pairs of blocks. Where a line has
    more partners than one round gives, another round looks through its buckets, among those that are still apart.
    """
    ids = common.settle(left.select("lh").distinct(), "apart")
    signs = common.maybe_in(marks, "lh", ids).select(F.col("lh").alias("v"), F.array(*[f"k{b}" for b in range(BANDS)]).alias("keys"), *_SIGN)
    signs = common.settle(parities(texts.join(ids, "lh", "left_semi").select("lh", shingle_set(F.col("line"), shingle).alias("s"))).join(signs, F.col("w") == F.col("v")).drop("v"), "signs")
    rows = common.settle(left.join(signs.select("w", "units"), F.col("lh") == F.col("w")).select("key", "lh", "root", "units"), "members")
    earlier = F.slice("keys", F.lit(1), F.greatest(F.array_position("keys", F.col("key")).cast("int") - 1, F.lit(0)))
    known = ["lh", "root", "own", earlier.alias("earlier"), "units", *_SIGN, *_PARITY]
    links = None
    while True:
        sizes = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.sum("units").alias("units"))
        sizes = common.settle(sizes.where("low < high").select(F.col("key").alias("k"), F.ceil(F.col("units") / BLOCK).cast("int").alias("blocks")), "buckets")
        cut = rows.drop("units").join(sizes, F.col("key") == F.col("k")).withColumn("own", F.pmod(F.xxhash64("lh", F.lit(7)), F.col("blocks")).cast("int"))
        cut = cut.select("key", "lh", "root", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        cut = cut.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "lh", "root", "own")
        full = cut.join(signs, F.col("lh") == F.col("w"))
        cells = full.groupBy("key", "i", "j").agg(F.collect_list(F.struct(*known)).alias("rows"))
        # whole sets are cut and moved only for lines that may have a partner
        near = common.settle(cell_members(cells, similar), "near")
        sets = common.settle(texts.join(near.select("lh").distinct(), "lh", "left_semi").select(F.col("lh").alias("v"), F.sort_array(shingle_set(F.col("line"), shingle)).alias("s")), "sets")
        full = full.join(near, ["key", "i", "j", "lh"], "left_semi").join(sets, F.col("lh") == F.col("v"))
        cells = full.groupBy("key", "i", "j").agg(F.collect_list(F.struct(*known, "s")).alias("rows"))
        found = common.settle(cell_links(cells, similar), "cross")
        new = found.select("a", F.explode("partners").alias("b")).distinct()
        links = new if links is None else links.union(new)
        again = found.where("more").select("key").distinct()
        if not again.head(1):
            return links
        ends = new.join(rows.select(F.col("lh").alias("a"), F.col("root").alias("p")).distinct(), "a").join(rows.select(F.col("lh").alias("b"), F.col("root").alias("q")).distinct(), "b")
        merged = common.settle(components(ends.select(F.col("p").alias("a"), F.col("q").alias("b"))), "merged").withColumnRenamed("root", "to")
        rows = common.settle(rows.join(again, "key", "left_semi").join(merged, F.col("root") == F.col("node"), "left").select("key", "lh", F.coalesce("to", "root").alias("root"), "units"), "members")


def line_roots(lines: DataFrame, shingle: int, similar: float) -> DataFrame:
    """lh and root of every line that occurs more than once or is like another; lines of one component share a root."""
    marks = common.settle(signatures(lines, shingle), "marks")
    bands = marks.select("lh", "n", *_SIGN, F.explode(F.array(*[f"k{b}" for b in range(BANDS)])).alias("key"))
    shared = common.settle(bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    met = common.settle(common.maybe_in(bands, "key", shared.select("key")).join(shared, "key").select("key", "lh", "n", "size", *_SIGN), "met")
    hubs = met.groupBy("key").agg(F.min(F.struct(-F.col("n"), "lh", *_SIGN)).alias("first")).select("key", "first")
    met = common.settle(met.join(hubs, "key").select("key", "lh", F.col("first.lh").alias("hub"), "size", *_SIGN, "first"), "hubs")
    links, texts = hub_links(met, lines, shingle, similar)
    roots = common.settle(components(links), "roots")
    rest = met.where("size > 2 and lh <> hub").join(roots, F.col("lh") == F.col("node"), "left").select("key", "lh", F.coalesce("root", "lh").alias("root"))
    rest = common.settle(rest, "rest")
    split = common.settle(rest.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key"), "split")
    left = common.settle(rest.join(split, "key", "left_semi"), "left")
    cross = apart_links(left, marks, texts, shingle, similar) if left.head(1) else None
    if cross is not None and cross.head(1):
        roots = common.settle(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(cross)), "roots")
    many = marks.where("n > 1").select(F.col("lh").alias("m"))
    return common.settle(many.join(roots, F.col("m") == F.col("node"), "full").select(F.coalesce("m", "node").alias("lh"), F.coalesce("root", "m").alias("root")), "named")


def removed_lines(docs: DataFrame, shingle: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """doc_id, th (hash of the text), line_no of every line that goes, with kept_doc_id and kept_line_no, the line it repeats.

    Lines are ordered by doc_id (null last), then hash of the text, then line number; the first of
    a component stays. Any doc_id is allowed; texts that share one are told apart. Rows that
    repeat doc_id and text count once. Null texts and blank lines have no part in it, lines
    shorter than a shingle only as exact repeats. Long lines are compared whole. An empty table
    gives an empty one; columns besides doc_id and text are not read.
    """
    with common.passing(docs.sparkSession):
        lines = common.settle(line_table(docs), "lines", codec="zstd")
        named = line_roots(lines, shingle, similar)
        place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "th", "line_no").alias("at")
        few = common.maybe_in(lines.select("lh", "doc_id", "th", "line_no"), "lh", named.select("lh"))
        rows = common.settle(few.select("lh", place).join(named, "lh").select("root", "at"), "places")
        least = common.settle(rows.groupBy("root").agg(F.min("at").alias("kept")), "least")
        gone = rows.join(least, "root").where(F.col("at") != F.col("kept"))
        gone = gone.select("at.doc_id", "at.th", "at.line_no", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.line_no").alias("kept_line_no")).distinct()
        return common.settle(gone, "removed", stays=True)


def _with_gone(docs: DataFrame, gone: DataFrame, *values: Column) -> tuple[DataFrame, Column, Column]:
    """``docs`` with columns c0, c1 .. in place of its names and what is aggregated of ``gone`` for each doc_id and text; then its doc_id and text."""
    at, text = docs.columns.index("doc_id"), docs.columns.index("text")
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).withColumn("_th", F.xxhash64(f"c{text}"))
    found = gone.groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).agg(*values)
    rows = rows.join(found, rows[f"c{at}"].eqNullSafe(found["_d"]) & (rows["_th"] == found["_t"]), "left")
    return rows, F.col(f"c{at}"), F.col(f"c{text}")


def dedup_lines(docs: DataFrame, shingle: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """``docs`` with the texts that are left when every line that repeats an earlier one, exactly or nearly, is taken out.

    See ``removed_lines`` for the order and for what counts as a repeat. Null and empty texts
    stay as they are; a text all of whose lines go becomes empty; blank lines stay. Rows that
    repeat doc_id and text stay alike. An empty table gives an empty one; other columns, of
    whatever names, are passed through.
    """
    rows, _, text = _with_gone(docs, removed_lines(docs, shingle, similar), F.collect_list("line_no").alias("_gone"))
    rest = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    new = F.when(F.col("_gone").isNull(), text).otherwise(rest)
    return rows.select(*[new if n == "text" and i == docs.columns.index("text") else F.col(f"c{i}") for i, n in enumerate(docs.columns)]).toDF(*docs.columns)


def op10_minhash_lines(spark, sf_dir: str) -> DataFrame:
    """Per row of ``documents``: doc_id, n_lines, n_removed, and ``removed``: line number, then document and line that stays.

    A null text has no lines, an empty one has one. Rows that repeat doc_id and text have the
    same lists; of a line that several documents share, or that one repeats, the first
    occurrence stays. A null doc_id is written as nothing. An empty table gives an empty one.
    See ``removed_lines`` for the rest.
    """
    docs = common.pick(common.read(spark, sf_dir, "documents"), "doc_id", "text")
    line = F.struct("line_no", "kept_doc_id", "kept_line_no")
    each = F.transform(F.array_sort(F.collect_list(line)), lambda x: F.concat(x["line_no"].cast("string"), F.lit(":"), F.coalesce(x["kept_doc_id"].cast("string"), F.lit("")), F.lit(":"), x["kept_line_no"].cast("string")))
    n_lines = F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1, F.lit(0)).cast("long")
    found = removed_lines(docs).groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).agg(F.count("*").alias("n"), F.array_join(each, ",").alias("list"))
    # texts are counted and hashed before the join, so that none is moved
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), n_lines.alias("n_lines"))
    out = rows.join(found, rows["doc_id"].eqNullSafe(found["_d"]) & (rows["th"] == found["_t"]), "left")
    return out.select("doc_id", "n_lines", F.coalesce("n", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("list", F.lit("")).alias("removed"))
