"""Copies and near copies of documents: every pair whose sets of word shingles have a Jaccard similarity of 0.8 or more.

The pipeline's near-duplicate stage. The pigeonhole search over SimHash fingerprints gives the
first candidates (``sketch_links``). One SimHash of 64 bits cannot tell a similarity of 0.8
from 0.6 (see README), so what it does not bring together is looked for by MinHash over the
whole set, 21 bands of three least hashes: a pair at a similarity of exactly 0.8 meets in none
of them with probability (1 - 0.8**3)**21, or 3e-7. Only pairs whose exact similarity is high
enough become links, whichever search found them.

Within a band's bucket every text is first checked against two hubs (a text that many
documents share, and another). Only texts that this leaves in different components are then
checked against each other, by signature and then exactly, in cells of two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, flat, simhash
from .components import components

U = np.uint64
SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS, PLACES = 21, 3, 64
#: Standard deviations by which a checked pair's signature may fall short: 5 leave out 3 pairs in ten million at a similarity of exactly 0.8.
DEVIATIONS = 5.0
#: Equal places from which a pair is checked.
LEAST = PLACES * SIMILAR - DEVIATIONS * (PLACES * SIMILAR * (1 - SIMILAR)) ** 0.5
#: Texts of one bucket that one task compares at once; larger buckets are dealt out as pairs of blocks.
BLOCK = 512
_FACTORS = flat.mix(np.arange(1, PLACES + 1, dtype=np.uint64)) | U(1)
_SIGN = [f"s{i}" for i in range(PLACES // 8)]
_KEYS = [f"k{i}" for i in range(BANDS)]


def shingle_hashes(texts: list[str], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles (lower case) of the texts, one after another, and how many each text has; a shorter text is one shingle. Every text has a word."""
    cut = flat.flatten([t.lower() for t in texts])
    n = np.bincount(cut.word_doc, minlength=len(texts))
    units = np.maximum(n - shingle + 1, 1)
    owner = np.repeat(np.arange(len(texts)), units)
    start = np.arange(len(owner)) + (np.cumsum(n) - n - np.cumsum(units) + units)[owner]
    return flat.span_hash(flat.word_sums(flat.word_hashes(cut)), start, start + np.minimum(n, shingle)[owner], flat._C), units


def signature_values(texts: list[str], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (n, BANDS) and one byte of each place as int64 (n, PLACES // 8)."""
    h, units = shingle_hashes(texts, shingle)
    first = np.cumsum(units) - units
    table = np.column_stack([np.minimum.reduceat(h * f, first) for f in _FACTORS])
    keys = np.empty((len(texts), BANDS), dtype=np.uint64)
    for band in range(BANDS):
        key = np.full(len(texts), band + 1, dtype=np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            key = flat.mix(key + table[:, k])
        keys[:, band] = key
    byte = (flat.mix(table) & U(255)).astype(np.uint8)
    return keys.view(np.int64), np.ascontiguousarray(byte).view(np.int64)


def signatures(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """th, k0.. (band keys) and s0.. (eight places each) of every different text of a table th, text."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        th = batch.column(0).to_numpy()
        _, first = np.unique(th, return_index=True)
        rows = np.sort(first)
        names, found = th[rows], batch.column(1).take(pa.array(rows)).to_pylist()
        for lo, hi in flat.chunks(found):
            keys, sign = signature_values(found[lo:hi], shingle)
            yield pa.RecordBatch.from_arrays([pa.array(names[lo:hi]), *map(pa.array, keys.T.copy()), *map(pa.array, sign.T.copy())], names=["th", *_KEYS, *_SIGN])

    columns = [*_KEYS, *_SIGN]
    found = texts.select("th", "text").mapInArrow(common.by_batch(work), ", ".join(f"{c} long" for c in ["th", *columns]))
    return found.groupBy("th").agg(*[F.min(c).alias(c) for c in columns])


def _wanted(pairs: DataFrame) -> DataFrame:
    """The different ids in pairs a, b, as w."""
    return common.settle(pairs.select(F.explode(F.array("a", "b")).alias("w")).distinct(), "wanted")


def _alike(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Pairs whose signatures agree in LEAST places."""
    pairs = common.settle(pairs, "candidates")
    sign = common.settle(marks.join(_wanted(pairs), F.col("th") == F.col("w")).select("th", F.struct(*_SIGN).alias("s")), "signs")
    both = pairs.join(sign.select(F.col("th").alias("a"), F.col("s").alias("x")), "a").join(sign.select(F.col("th").alias("b"), F.col("s").alias("y")), "b")
    differ = F.lit(0)
    for c in _SIGN:
        bits = F.col("x")[c].bitwiseXOR(F.col("y")[c])
        for shift in (4, 2, 1):
            bits = bits.bitwiseOR(F.shiftrightunsigned(bits, shift))
        differ = differ + F.bit_count(bits.bitwiseAND(F.lit(0x0101010101010101)))
    return common.settle(both.where(F.lit(PLACES) - differ >= LEAST).select("a", "b"), "alike")


def _common(x: np.ndarray, y: np.ndarray, similar: float) -> bool:
    """Whether two sets (sorted hashes, each once) have a Jaccard similarity of ``similar`` or more."""
    if min(len(x), len(y)) < similar * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate([x, y]), kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared >= similar * (len(both) - shared)


def cell_links(th, root, own, within, band, keys, sign, texts, shingle: int, similar: float) -> list[tuple[int, int]]:
    """Verified links between the rows of one cell that have different roots, as far as no earlier link joins them.

    Pairs that an earlier band brings together as well are left to it.
    """
    parent: dict[int, int] = {}
    sets: dict[int, np.ndarray] = {}
    found = []

    def top(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    def hashes(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = np.unique(shingle_hashes([texts[i]], shingle)[0])
        return sets[i]

    for i in range(len(th) - 1):
        k = np.flatnonzero((root[i + 1 :] != root[i]) & (within[i] | (own[i + 1 :] != own[i]))) + i + 1
        k = k[np.count_nonzero(sign[k] == sign[i], axis=1) >= LEAST]
        k = k[np.argmax(keys[k] == keys[i], axis=1) == band[i]]
        for j in k.tolist():
            x, y = top(int(root[i])), top(int(root[j]))
            if x != y and _common(hashes(i), hashes(j), similar):
                parent[y] = x
                found.append((int(th[i]), int(th[j])))
        sets.pop(i, None)
    return found


def _links_apart(left: DataFrame, marks: DataFrame, texts: DataFrame, shingle: int, similar: float) -> DataFrame:
    """Links a, b that join what is similar among rows (key, th, root) with one key and different roots.

    A bucket's texts are compared in numpy and only links become rows. Buckets of more than
    BLOCK texts are dealt out as pairs of blocks, so that no task holds more than two blocks
    and no pair is left out.
    """
    sizes = common.settle(left.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK).select(F.col("key").alias("k"), F.ceil(F.col("m") / (BLOCK / 2)).cast("int").alias("blocks")), "large")
    rows = left.join(sizes, F.col("key") == F.col("k"), "left").select("key", "th", "root", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("th", F.lit(7)), F.col("blocks")).cast("int"))
    rows = rows.select("key", "th", "root", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("key", "th", "root", "own", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), (F.col("own") == F.col("other")).alias("within"))
    apart = common.settle(left.select(F.col("th").alias("a"), F.col("th").alias("b")).distinct(), "apart")
    sign = common.settle(marks.join(_texts(apart, texts), "th").select(F.col("th").alias("w"), *_KEYS, *_SIGN, "text"), "signs")
    rows = rows.join(sign, F.col("th") == F.col("w"))
    band = F.array_position(F.array(*_KEYS), F.col("key")).cast("int") - 1
    rows = rows.select("cell", "th", "root", "own", "within", band.alias("band"), *_KEYS, *_SIGN, "text")

    def links(columns: list[np.ndarray]) -> list[tuple[int, int]]:
        keys, sign = np.column_stack(columns[6 : 6 + BANDS]), np.column_stack(columns[6 + BANDS : -1]).view(np.uint8)
        edges = np.flatnonzero(columns[0][1:] != columns[0][:-1]) + 1
        found = []
        for lo, hi in zip([0, *edges], [*edges, len(columns[0])], strict=True):
            if hi - lo > 1:
                found += cell_links(*(c[lo:hi] for c in columns[1:6]), keys[lo:hi], sign[lo:hi], columns[-1][lo:hi], shingle, similar)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in chain(batches, [None]):
            rows = rest
            if batch is not None:
                rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                rows = [np.concatenate(x) for x in zip(rest, rows, strict=True)] if rest is not None else rows
            if rows is None or not len(rows[0]):
                continue
            # the last cell may go on in the next batch
            cut = int(np.flatnonzero(np.append(True, rows[0][1:] != rows[0][:-1]))[-1]) if batch is not None else len(rows[0])
            rest, found = [r[cut:] for r in rows], links([r[:cut] for r in rows]) if cut else []
            yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in found], pa.int64()), pa.array([max(x) for x in found], pa.int64())], names=["a", "b"])
        common.tidy()

    return common.settle(rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long").distinct(), "cross")


def _texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """th and text of every text in pairs a, b, once each."""
    ids = _wanted(pairs)
    few = common.maybe_in(texts.select("th", "text"), "th", ids).dropDuplicates(["th"])
    return common.settle(few.join(ids, F.col("th") == F.col("w"), "left_semi"), "texts")


def _similar(pairs: DataFrame, texts: DataFrame, shingle: int, similar: float) -> DataFrame:
    """Those of the pairs a, b whose texts' shingle sets have a Jaccard similarity of ``similar`` or more."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        a, b, left, right = (c.to_pylist() for c in batch.columns)
        keep = np.zeros(len(a), dtype=bool)
        for lo, hi in flat.chunks([x if len(x) > len(y) else y for x, y in zip(left, right, strict=True)]):
            held = dict(zip([*a[lo:hi], *b[lo:hi]], [*left[lo:hi], *right[lo:hi]], strict=True))
            h, units = shingle_hashes(list(held.values()), shingle)
            sets = dict(zip(held, map(np.unique, np.split(h, np.cumsum(units)[:-1])), strict=True))
            for i in range(lo, hi):
                keep[i] = _common(sets[a[i]], sets[b[i]], similar)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    held = _texts(pairs, texts)
    both = pairs.join(held.select(F.col("th").alias("a"), F.col("text").alias("left")), "a").join(held.select(F.col("th").alias("b"), F.col("text").alias("right")), "b")
    return common.settle(both.select("a", "b", "left", "right").mapInArrow(common.by_batch(work), "a long, b long"), "similar")


def sketch_links(texts: DataFrame, shingle: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """Links a, b between texts of a table th, text found by SimHash: equal fingerprints, and the pigeonhole search's links within three bits.

    Of texts with one fingerprint the least is its node; the others are checked against it.
    Only pairs whose exact similarity is high enough stay.
    """
    marks = simhash.fingerprints(texts.select(F.col("th").alias("doc_id"), "text"), shingle)
    marks = common.settle(marks.groupBy(F.col("doc_id").alias("th")).agg(F.min("fp").alias("fp")), "fingerprints")
    nodes = common.settle(marks.groupBy("fp").agg(F.min("th").alias("node")), "nodes")
    equal = marks.join(nodes, "fp").where("th <> node").select(F.col("node").alias("a"), F.col("th").alias("b"))
    near = simhash.near_links(nodes.select("fp", "node")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return _similar(common.settle(equal.union(near), "sketched"), texts, shingle, similar)


def text_roots(texts: DataFrame, shingle: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """node and root of every text (th) of a table th, text that is like another."""
    counts = texts.groupBy("th").agg(F.count("*").alias("n")).where("n > 1")
    marks = common.settle(signatures(texts, shingle), "marks")
    bands = marks.select("th", F.explode(F.array(*_KEYS)).alias("key"))
    met = common.settle(bands.join(bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key"), "met")
    many = common.settle(counts.select(F.col("th").alias("l"), "n"), "many")
    met = met.join(many, F.col("th") == F.col("l"), "left").select("key", "th", F.coalesce("n", F.lit(1)).alias("n"))
    hubs = met.groupBy("key").agg(F.min(F.struct(-F.col("n"), "th")).alias("first"), F.max("th").alias("hub2")).select("key", F.col("first.th").alias("hub"), "hub2")
    met = common.settle(met.join(hubs, "key").select("key", "th", "hub", "hub2"), "hubs")
    first = met.select("th", F.explode(F.array("hub", "hub2")).alias("hub")).where("th <> hub").select(F.least("th", "hub").alias("a"), F.greatest("th", "hub").alias("b")).distinct()
    links = sketch_links(texts, shingle, similar).union(_similar(_alike(first, marks), texts, shingle, similar))
    roots = common.settle(components(links), "roots")

    named = common.settle(met.join(roots, F.col("th") == F.col("node"), "left").select("key", "th", "hub", "hub2", F.coalesce("root", "th").alias("root")), "named")
    split = common.settle(named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key"), "split")
    left = common.settle(named.join(split, "key", "left_semi").where("th <> hub and th <> hub2").select("key", "th", "root"), "apart")
    cross = _links_apart(left, marks, texts, shingle, similar)
    return common.settle(components(links.union(cross)), "roots") if cross.head(1) else roots


def copy_classes(docs: DataFrame, shingle: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """doc_id, th (hash of the text), kept_doc_id and kept_th of every row: the first document of its group.

    Every text has a word. Documents are ordered by doc_id (null last), then by hash of the
    text; any doc_id is allowed, and different texts under one are told apart. Texts are
    compared whole. An empty table gives an empty one; further columns are not read.
    """
    with common.passing(docs.sparkSession):
        texts = common.pick(docs, "doc_id", "text").withColumn("th", F.xxhash64("text"))
        roots = text_roots(texts, shingle, similar)
        place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "th").alias("at")
        thin = common.settle(texts.select("doc_id", "th"), "thin")
        rows = common.settle(thin.join(roots, F.col("th") == F.col("node"), "left").select(place, F.coalesce("root", "th").alias("root")), "places")
        least = common.settle(rows.groupBy("root").agg(F.min("at").alias("kept")), "least")
        return common.settle(rows.join(least, "root").select("at.doc_id", "at.th", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.th").alias("kept_th")), "classes", stays=True)
