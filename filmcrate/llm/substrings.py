"""Removal of passages that occur twice or more, by a compacted de Bruijn graph of token k-mers.

A window of WINDOW consecutive words is repeated if its words also start anywhere else. The
graph that finds such windows is sparse. Its nodes are k-mers (KMER words) that their own
words select: of the SEED-word pieces of a k-mer the least stands first or last. Every
window holds one of them at least, and equal windows hold equal ones at equal places. An
edge leads from a k-mer to the next one of the text; the two meet or overlap.

1. One row a text (equal texts counted) with its k-mers; those that occur once are dropped.
2. An edge is nonbranching if its k-mers occur equally often and each occurrence of the first
   is followed by the second at the same distance. Chains of such edges compact into paths
   by joins that double the distance looked back (``heads``).
3. All occurrences of a path are alike from end to end, so one row stands for each: its
   source coordinates, and a digest of all its words. Only windows that stick out of every
   path, and whose k-mers are all repeated, are rows of their own.
4. Rows with a digest (two hashes of 64 bits and the length) that occurs again are verified:
   their windows are repeated, and the words that they cover go.

No list grows beyond one text, and what is frequent is counted before it is joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, flat

WINDOW = 35
#: Words of a k-mer and of the pieces that select it; WINDOW - KMER + 1 >= KMER - SEED, so that every window holds a selected one.
KMER, SEED = 19, 2
_FIRST, _SECOND = 0xA0761D6478BD642F | 1, 0xE7037ED1A0B428DB | 1
#: What a byte counts as in the second hash of a window.
_BYTES = flat.mix(np.arange(1001, 1257, dtype=np.uint64) * flat.U(0xD6E8FEB86659FD93))
_KMERS = "doc_id long, k1 long, k2 long, at array<int>, kmer array<long>"
_ROWS = "h1 long, h2 long, words int, id long, at int, m long"
_KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def selected(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every selected k-mer, in texts of WINDOW words or more; ``words`` are hashes, ``doc`` the text of each."""
    n = len(words)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = pieces = flat.mix(words[:-1] * flat.U(_FIRST) + flat.mix(words[1:]))
    last, span = KMER - SEED, 1
    while span * 2 <= last + 1:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    grams = n - KMER + 1
    least = np.minimum(least[:grams], least[last + 1 - span :][:grams])
    ends = (least == pieces[:grams]) | (least == pieces[last:][:grams])
    sizes = np.bincount(doc)
    first = np.flatnonzero(ends & (doc[:grams] == doc[KMER - 1 :]) & (sizes[doc[:grams]] >= WINDOW))
    return first, flat.span_hash(flat.prefix(words, _FIRST), first, first + KMER, _FIRST)


def _second_words(held: flat.Flat) -> np.ndarray:
    """Word hashes that are independent of ``flat.word_hashes``."""
    out = flat.span_hash(flat.prefix(_BYTES[held.data], _SECOND), held.word_start, held.word_end, _SECOND)
    for i in np.flatnonzero(held.word_end - held.word_start > flat.LONG).tolist():
        out[i] = np.frombuffer(blake2b(held.data[held.word_start[i] : held.word_end[i]].tobytes(), digest_size=8, key=b"second").digest(), np.uint64)[0]
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and two hashes that name the text."""
    rows = common.pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("second"), "text").alias("k2"))


def _kmers(docs: DataFrame) -> DataFrame:
    """Selected k-mers of every text of WINDOW words or more."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column("text").to_pylist()
        for lo, hi in flat.chunks(texts):
            held = flat.flatten(texts[lo:hi])
            first, kmer = selected(flat.word_hashes(held), held.word_doc)
            counts = np.bincount(held.word_doc, minlength=hi - lo)
            begin = np.cumsum(counts) - counts
            mine = held.word_doc[first]
            held_by = np.bincount(mine, minlength=hi - lo)
            keep = np.flatnonzero(held_by)
            edges = pa.array(np.concatenate([[0], np.cumsum(held_by[keep])]).astype(np.int32))
            at = pa.ListArray.from_arrays(edges, pa.array((first - begin[mine]).astype(np.int32)))
            kmers = pa.ListArray.from_arrays(edges, pa.array(kmer.view(np.int64)))
            some = batch.slice(lo, hi - lo).take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("k1"), some.column("k2"), at, kmers], names=["doc_id", "k1", "k2", "at", "kmer"])

    return _keyed(docs).select("doc_id", "k1", "k2", "text").mapInArrow(common.by_batch(work), _KMERS)


def _occurrences(texts: DataFrame) -> DataFrame:
    """One row a k-mer of a text: id, m, kmer, at, and the next one with the distance to it."""
    following = lambda c: F.slice(c, F.lit(2), F.size(c))
    zipped = F.arrays_zip(F.col("kmer").alias("kmer"), F.col("at").alias("at"), following("kmer").alias("next"), following("at").alias("next_at"))
    return texts.select("id", "m", F.inline(zipped)).select("id", "m", "kmer", "at", "next", (F.col("next_at") - F.col("at")).alias("step"))


def heads(links: DataFrame) -> DataFrame:
    """node, head, words: where the chain of each node with a predecessor begins, and how many words before it.

    ``links``: a, b, step; nobody has two successors or predecessors, and there are no
    circles. In each round everyone takes over what the node it looks back to sees, so
    a chain of n nodes takes about log2(n) rounds.
    """
    spark = links.sparkSession
    paths = [common.scratch(spark, "chains")]
    links.select(F.col("b").alias("node"), F.col("a").alias("head"), F.col("step").cast("long").alias("words")).write.parquet(paths[0])
    while True:
        rows = spark.read.parquet(paths[-1])
        back = rows.select(F.col("node").alias("n"), F.col("head").alias("further"), F.col("words").alias("more"))
        paths.append(common.scratch(spark, "chains"))
        joined = rows.join(back, F.col("head") == F.col("n"), "left")
        joined.select("node", F.coalesce("further", "head").alias("head"), (F.col("words") + F.coalesce("more", F.lit(0))).alias("words"), F.col("n").isNotNull().alias("went")).write.parquet(paths[-1])
        common.delete(spark, paths[-2])
        rows = spark.read.parquet(paths[-1])
        if not rows.where("went").head(1):
            return rows.drop("went")


def paths_of(texts: DataFrame) -> DataFrame:
    """kmer and words of every repeated k-mer: the words of its path if it heads one of WINDOW words or more, else 0."""
    alike = lambda c: F.min(c) == F.max(c)
    counted = _occurrences(texts).groupBy("kmer").agg(F.sum("m").alias("n"), F.sum(F.when(F.col("next").isNotNull(), F.col("m"))).alias("followed"), F.min("next").alias("next"), F.min("step").alias("step"), (alike("next") & alike("step")).alias("alike"))
    one_way = (F.col("followed") == F.col("n")) & F.col("alike")
    nodes = common.settle(counted.where("n > 1").select("kmer", "n", F.when(one_way, F.col("next")).alias("next"), "step"), "nodes")
    after = nodes.select(F.col("kmer").alias("b"), F.col("n").alias("n_b"))
    links = nodes.where("next is not null").join(after, (F.col("next") == F.col("b")) & (F.col("n") == F.col("n_b"))).select(F.col("kmer").alias("a"), "b", "step")
    long = heads(links).groupBy("head").agg((F.max("words") + KMER).alias("words")).where(F.col("words") >= WINDOW)
    return nodes.join(long, F.col("kmer") == F.col("head"), "left").select("kmer", F.coalesce("words", F.lit(0)).cast("int").alias("words"))


def _digest(held: flat.Flat, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Digests of long spans (word numbers) as pairs of 64 bits."""
    ends = zip(held.word_start[first].tolist(), held.word_end[last - 1].tolist(), strict=True)
    joined = (b" ".join(held.data[a:b].tobytes().split()) for a, b in ends)
    return np.frombuffer(b"".join(blake2b(x, digest_size=16).digest() for x in joined), dtype=np.int64).reshape(-1, 2)


def _candidates(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows to verify of each text: occurrences of paths, and windows outside all of them whose k-mers are all repeated.

    ``facts``: k1, k2, rep, id, m, at and words (one entry a repeated k-mer). A text that
    several documents have is read from those with the least doc_id.
    """
    rows = _keyed(docs).join(facts.withColumnRenamed("k1", "f1").withColumnRenamed("k2", "f2"), (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2")))
    rows = rows.where(F.col("doc_id").eqNullSafe(F.col("rep"))).select("text", "id", "m", "at", "words")

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column("text").to_pylist()
        for lo, hi in flat.chunks(texts):
            part = batch.slice(lo, hi - lo)
            held = flat.flatten(texts[lo:hi])
            one = flat.word_hashes(held)
            doc, n = held.word_doc, len(one)
            counts = np.bincount(doc, minlength=hi - lo)
            begin = np.cumsum(counts) - counts
            first, _ = selected(one, doc)
            lists = part.column("at")
            owner = np.repeat(np.arange(hi - lo), np.diff(lists.offsets.to_numpy()))
            at = lists.flatten().to_numpy() + begin[owner]
            words = part.column("words").flatten().to_numpy().astype(np.int64)
            # windows with a k-mer that occurs once, and windows inside a path
            once = np.zeros(n + 1, np.int32)
            once[first + 1] = 1
            once[at + 1] = 0
            once = np.cumsum(once)
            start = np.flatnonzero(doc[: n - WINDOW + 1] == doc[WINDOW - 1 :]) if n >= WINDOW else np.zeros(0, np.int64)
            inside = np.zeros(n + 1, np.int32)
            heads_ = words > 0
            np.add.at(inside, at[heads_], 1)
            np.add.at(inside, at[heads_] + words[heads_] - WINDOW + 1, -1)
            inside = np.cumsum(inside)
            start = start[(once[start + WINDOW - KMER + 1] == once[start]) & (inside[start] == 0)]
            two = _second_words(held)
            pair = np.empty((len(start) + int(heads_.sum()), 2), np.int64)
            for j, (values, base) in enumerate(((one, _FIRST), (two, _SECOND))):
                pair[: len(start), j] = flat.span_hash(flat.prefix(values, base), start, start + WINDOW, base).view(np.int64)
            pair[len(start) :] = _digest(held, at[heads_], at[heads_] + words[heads_])
            all_at = np.concatenate([start, at[heads_]])
            mine = doc[all_at]
            length = np.concatenate([np.full(len(start), WINDOW), words[heads_]])
            columns = [pair[:, 0].copy(), pair[:, 1].copy(), length.astype(np.int32), part.column("id").to_numpy()[mine], (all_at - begin[mine]).astype(np.int32), part.column("m").to_numpy()[mine]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in _ROWS.split(", ")])

    return rows.mapInArrow(common.by_batch(work), _ROWS)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """k1, k2, at, words (lists): for each text with repeated windows the spans that they cover, by number of the first word; spans may overlap."""
    found = _kmers(docs)
    texts = found.groupBy("k1", "k2").agg(F.count("*").alias("m"), F.min("doc_id").alias("rep"), F.first("at").alias("at"), F.first("kmer").alias("kmer"))
    texts = common.settle(texts.withColumn("id", F.monotonically_increasing_id()), "kmers")
    paths = common.settle(paths_of(texts), "paths").withColumnRenamed("kmer", "node")
    met = _occurrences(texts).select("id", "at", "kmer").join(paths, F.col("kmer") == F.col("node"))
    facts = met.groupBy("id").agg(F.collect_list(F.struct("at", "words")).alias("s")).select(F.col("id").alias("i"), F.col("s.at").alias("at"), F.col("s.words").alias("words"))
    names = texts.select("id", "k1", "k2", "m", "rep")
    facts = common.settle(names.join(facts, F.col("id") == F.col("i")).drop("i"), "facts")
    rows = common.settle(_candidates(docs, facts), "windows")
    key = ["h1", "h2", "words"]
    again = common.settle(rows.groupBy(*key).agg(F.sum("m").alias("n")).where("n > 1").select(*key), "again")  # written, so that Spark can split the join at a frequent window
    spans = rows.join(again, key).groupBy("id").agg(F.collect_list(F.struct("at", "words")).alias("s"))
    spans = spans.select(F.col("id").alias("i"), F.col("s.at").alias("at"), F.col("s.words").alias("words"))
    return facts.select("id", "k1", "k2").join(spans, F.col("id") == F.col("i")).select("k1", "k2", "at", "words")


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row: words covered by a window that starts anywhere else as well are gone.

    Words are the longest runs without white space (``[^\\x20\\x09-\\x0D]+``). A null text and
    one of white space have no words. A text of fewer than WINDOW words loses none, repeated
    or not. Rows of equal text, repeated rows included, are occurrences of their own: all
    words of theirs go where there are WINDOW or more. All copies lose a passage, the first
    one too. Null and repeated doc_ids are no matter; texts of any length are taken whole
    (working memory is a few times one text). An empty table gives no rows. Other columns,
    clashing names included, are not read.
    """
    spans = common.settle(repeated_spans(docs), "spans").select(F.col("k1").alias("s1"), F.col("k2").alias("s2"), "at", "words")
    rows = _keyed(docs).join(spans, (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2")), "left").select("doc_id", "text", "at", "words")

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes, removed, digests = [], [], []
        for text, at, words in zip(batch.column("text"), batch.column("at"), batch.column("words"), strict=True):
            held = text.as_py().encode("utf-8", "surrogatepass").split()
            n = len(held)
            if at.is_valid:
                gone = np.zeros(n + 1, np.int32)
                first = at.values.to_numpy()
                np.add.at(gone, first, 1)
                np.add.at(gone, first + words.values.to_numpy(), -1)
                held = list(compress(held, (np.cumsum(gone[:-1]) == 0).tolist()))
            sizes.append(n)
            removed.append(n - len(held))
            digests.append(sha256(b" ".join(held)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], names=[c.split()[0] for c in _KEPT.split(", ")])

    return rows.mapInArrow(common.by_batch(work), _KEPT)


def op12_debruijn_passages(spark, sf_dir: str) -> DataFrame:
    """Words, removed words and digest of the kept words of all ``documents``; see ``without_repeats`` for nulls, ties, repeated rows and empty tables."""
    return without_repeats(common.read(spark, sf_dir, "documents"))


#: Every window of every text as a row.
op12_sql = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
starts AS (SELECT rid, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
win AS (SELECT rid, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h FROM starts),
again AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT DISTINCT rid, i FROM win JOIN again USING (h)),
word AS (SELECT rid, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS v FROM d),
flagged AS (SELECT word.rid, word.i, v, max(CASE WHEN hit.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY word.rid ORDER BY word.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM word LEFT JOIN hit ON hit.rid = word.rid AND hit.i = word.i),
kept AS (SELECT rid, sum(gone)::BIGINT AS n_removed, sha256(coalesce(string_agg(v, ' ' ORDER BY i) FILTER (gone = 0), '')) AS kept_sha256 FROM flagged GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n_removed, 0) AS n_removed, coalesce(k.kept_sha256, sha256('')) AS kept_sha256
FROM d LEFT JOIN kept k ON k.rid = d.rid
"""
