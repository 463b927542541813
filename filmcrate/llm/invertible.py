"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs at newlines, and long paragraphs further after words whose
hash is divisible by CUT (so that the cuts move with the text). Every paragraph's digest goes
into one cell of each of three subtables; a cell keeps a count and the xor of its digests
with their check sums. The tables grow with the text's paragraphs, so that all can be peeled
out again; they are the fingerprint. Two fingerprints are folded to a common small width and
subtracted cell by cell: what both hold cancels, and cells left with a single digest are
peeled until none is left. Where peeling stops early they are folded less. The differing
digests found this way give the likeness: paragraphs in common over paragraphs in either.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, flat

U = np.uint64
TABLES = 3
#: Cells of a subtable of the smallest sketch; others have a power of two times as many.
WIDTH = 8
#: Rounds of peeling at most; a table that needs more counts as not peeled.
ROUNDS = 100
CUT = 8
_SALT = [0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3]
_CHECK = U(0x589965CC75374CC3)


def paragraphs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Digest and text number of every paragraph, ordered by text. A paragraph that a text repeats has another digest each time."""
    f = flat.flatten(texts)
    words = flat.word_hashes(f)
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    lines = np.searchsorted(np.flatnonzero(f.data == 10), f.word_start)
    ends = (words % U(CUT) == 0) | np.append(lines[1:] != lines[:-1], True)
    stop = np.flatnonzero(ends) + 1
    start = np.concatenate([[0], stop[:-1]])
    doc = f.word_doc[start]
    digest = flat.span_hash(flat.word_sums(words), start, stop, flat._C)
    long = np.flatnonzero(stop - start > flat.LONG)
    if len(long):
        digest[long] = flat.strong(words[a:b].tobytes() for a, b in zip(start[long].tolist(), stop[long].tolist(), strict=True))
    own = digest ^ flat.mix(doc.astype(np.uint64) + U(1))
    again = flat.repeated(own)
    if len(again):
        order = again[np.argsort(own[again], kind="stable")]
        fresh = np.concatenate([[True], own[order][1:] != own[order][:-1]])
        at = np.arange(len(order))
        nth = at - np.maximum.accumulate(np.where(fresh, at, 0))
        digest[order] = flat.mix(digest[order] + nth.astype(np.uint64) * U(0x9E3779B97F4A7C15))
    return digest, doc


def _words(digest: np.ndarray) -> np.ndarray:
    """What a cell collects by xor: 40 bits of a digest above 24 bits of its check sum."""
    high = digest >> U(24)
    return (high << U(24)) | (flat.mix(high * _CHECK + U(7)) >> U(40))


def _cells(word: np.ndarray, width: int, table: int) -> np.ndarray:
    """Cell in a subtable of ``width`` cells, a power of two: halving the width leaves out the highest bit."""
    return (flat.mix(word ^ U(_SALT[table])) & U(width - 1)).astype(np.int64) + table * width


class Sketch:
    """Tables of ``n`` texts, each with TABLES subtables of ``width`` cells."""

    def __init__(self, n: int, width: int):
        self.width, self.cells = width, TABLES * width
        self.count, self.word = np.zeros(n * self.cells, dtype=np.int64), np.zeros(n * self.cells, dtype=np.uint64)

    def add(self, word: np.ndarray, owner: np.ndarray, sign) -> Sketch:
        for table in range(TABLES):
            at = owner * self.cells + _cells(word, self.width, table)
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.word, at, word)
        return self

    def minus(self, other: Sketch) -> Sketch:
        out = Sketch(0, self.width)
        out.count, out.word = self.count - other.count, self.word ^ other.word
        return out

    def pick(self, rows: np.ndarray) -> Sketch:
        out = Sketch(0, self.width)
        out.count, out.word = (x.reshape(-1, self.cells)[rows].ravel() for x in (self.count, self.word))
        return out

    def folded(self, width: int) -> Sketch:
        """The tables as they would be with fewer cells."""
        out = Sketch(0, width)
        shape = (-1, TABLES, self.width // width, width)
        out.count, out.word = self.count.reshape(shape).sum(axis=2).ravel(), np.bitwise_xor.reduce(self.word.reshape(shape), axis=2).ravel()
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Owner, word and sign of what is left after a subtraction, and which owners were emptied. The tables are used up."""
        found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))]
        for _ in range(ROUNDS):
            pure = np.flatnonzero(np.abs(self.count) == 1)
            pure = pure[_words(self.word[pure]) == self.word[pure]]
            if not len(pure):
                break
            owner, word, sign = pure // self.cells, self.word[pure], self.count[pure]
            _, one = np.unique(word ^ flat.mix(owner.astype(np.uint64) + U(1)), return_index=True)
            found.append((owner[one], word[one], sign[one]))
            self.add(word[one], owner[one], -sign[one])
        whole = ~((self.count != 0) | (self.word != 0)).reshape(-1, self.cells).any(axis=1)
        return (*(np.concatenate(x) for x in zip(*found, strict=True)), whole)

    def written(self, i: int) -> str:
        part = slice(i * self.cells, (i + 1) * self.cells)
        return base64.b64encode(self.count[part].astype("<i2").tobytes() + self.word[part].astype("<u8").tobytes()).decode()

    @staticmethod
    def read(text: str) -> Sketch:
        raw = base64.b64decode(text)
        out = Sketch(0, len(raw) // (10 * TABLES))
        out.count, out.word = np.frombuffer(raw, "<i2", out.cells).astype(np.int64), np.frombuffer(raw, "<u8", out.cells, 2 * out.cells).copy()
        return out


def sketches(words: np.ndarray, owner: np.ndarray, n: int) -> list[tuple[np.ndarray, Sketch, np.ndarray, np.ndarray]]:
    """Sketches of n texts, in groups of one width: the numbers of the texts, their tables, and what was peeled out of them: words and their texts.

    A text's width is the least that holds its paragraphs at two thirds of its cells and from
    which they can all be peeled; where that fails it doubles. It depends on the text alone.
    """
    size = np.bincount(owner, minlength=n)
    width = np.full(n, WIDTH, dtype=np.int64)
    while (small := 3 * size > 2 * TABLES * width).any():
        width[small] *= 2
    open_, out = np.arange(n), []
    while len(open_):
        again = []
        for w in np.unique(width[open_]).tolist():
            mine = open_[width[open_] == w]
            place = np.full(n, -1, dtype=np.int64)
            place[mine] = np.arange(len(mine))
            held = place[owner] >= 0
            made = Sketch(len(mine), w).add(words[held], place[owner[held]], 1)
            peeled, word, _, whole = made.pick(np.arange(len(mine))).peel()
            whole = whole | (w > 64 * np.maximum(size[mine], WIDTH))
            out.append((mine[whole], made.pick(np.flatnonzero(whole)), word[whole[peeled]], mine[peeled[whole[peeled]]]))
            again.append(mine[~whole])
        open_ = np.concatenate(again)
        width[open_] *= 2
    return out


def differing(a: Sketch, b: Sketch) -> np.ndarray:
    """How many paragraphs differ between the i-th tables of a and of b, as far as can be peeled.

    The tables are folded to the smallest width, subtracted and peeled; where that fails with
    twice the width, up to that of the smaller table, and at last each is peeled alone.
    """
    n = len(a.count) // a.cells
    out, open_, width = np.zeros(n, dtype=np.int64), np.arange(n), WIDTH
    while len(open_) and width <= min(a.width, b.width):
        left = a.pick(open_).folded(width).minus(b.pick(open_).folded(width))
        owner, _, _, whole = left.peel()
        out[open_[whole]] = np.bincount(owner, minlength=len(open_))[whole]
        open_, width = open_[~whole], 2 * width
    if len(open_):
        (mine, x, *_), (theirs, y, *_) = a.pick(open_).peel(), b.pick(open_).peel()
        keys = [word ^ flat.mix(owner.astype(np.uint64) + U(1)) for owner, word in ((mine, x), (theirs, y))]
        for owner, own, other in ((mine, *keys), (theirs, *reversed(keys))):
            out[open_] += np.bincount(owner[~np.isin(own, other)], minlength=len(open_))
    return out


def likeness(a: Sketch, b: Sketch) -> np.ndarray:
    """Paragraphs in common over paragraphs in either, for the i-th tables of a and b; 1 where neither has any."""
    both = sum(x.count.reshape(-1, x.cells)[:, : x.width].sum(axis=1) for x in (a, b))
    differ = np.minimum(differing(a, b), both)
    return np.where(both > 0, (both - differ) / np.maximum(both + differ, 1), 1.0)


class Prints:
    """Fingerprints of the texts of a batch, with what is needed to compare them."""

    def __init__(self, texts: list[str]):
        digest, owner = paragraphs(texts)
        # one of two different paragraphs whose 40 bits agree stays
        _, one = np.unique((digest >> U(24)) ^ flat.mix(owner.astype(np.uint64) + U(1)), return_index=True)
        made = sketches(_words(digest[one]), owner[one], len(texts))
        self.tables = [t for _, t, _, _ in made]
        self.group, self.row, self.width = (np.zeros(len(texts), dtype=np.int64) for _ in range(3))
        for g, (mine, table, _, _) in enumerate(made):
            self.group[mine], self.row[mine], self.width[mine] = g, np.arange(len(mine)), table.width
        word, text = (np.concatenate([np.zeros(0, dtype=x.dtype), *(m[k] for m in made)]) for k, x in ((2, digest), (3, owner)))
        order = np.argsort(text, kind="stable")
        self.word, self.begin = word[order], np.searchsorted(text[order], np.arange(len(texts) + 1))

    def written(self, i: int) -> str:
        return self.tables[self.group[i]].written(int(self.row[i]))

    def folded(self, at: np.ndarray, width: int) -> Sketch:
        """The tables of texts whose own are at least so wide."""
        out = Sketch(len(at), width)
        count, word, group = out.count.reshape(len(at), -1), out.word.reshape(len(at), -1), self.group[at]
        for g in np.unique(group).tolist():
            mine = np.flatnonzero(group == g)
            part = self.tables[g].pick(self.row[at[mine]]).folded(width)
            count[mine], word[mine] = part.count.reshape(len(mine), -1), part.word.reshape(len(mine), -1)
        return out

    def peeled(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What peeling each text's own table gave: for the k-th of the texts, k and the words."""
        size = self.begin[at + 1] - self.begin[at]
        k = np.repeat(np.arange(len(at)), size)
        return k, self.word[np.arange(len(k)) + np.repeat(self.begin[at] - np.cumsum(size) + size, size)]

    def likeness(self, at: np.ndarray, other: Prints, there: np.ndarray) -> np.ndarray:
        """As ``likeness``, for all pairs of texts at once."""
        most = np.minimum(self.width[at], other.width[there])
        differ, open_, width = np.zeros(len(at), dtype=np.int64), np.ones(len(at), dtype=bool), WIDTH
        while len(k := np.flatnonzero(open_ & (most >= width))):
            owner, _, _, whole = self.folded(at[k], width).minus(other.folded(there[k], width)).peel()
            differ[k[whole]] = np.bincount(owner, minlength=len(k))[whole]
            open_[k[whole]] = False
            width *= 2
        k = np.flatnonzero(open_)
        (x, mine), (y, theirs) = self.peeled(at[k]), other.peeled(there[k])
        keys = [word ^ flat.mix(i.astype(np.uint64) + U(1)) for i, word in ((x, mine), (y, theirs))]
        for i, own, rest in ((x, *keys), (y, *reversed(keys))):
            differ[k] += np.bincount(i[~np.isin(own, rest)], minlength=len(k))
        both = (self.begin[at + 1] - self.begin[at]) + (other.begin[there + 1] - other.begin[there])
        return np.where(both > 0, (both - differ) / np.maximum(both + differ, 1), 1.0)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row. Null texts count as empty."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for lo, hi in flat.chunks(texts):
            made = Prints(texts[lo:hi])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(map(made.written, range(hi - lo)), pa.string())], names=["doc_id", "fingerprint"])

    return common.pick(docs, "doc_id", "text").mapInArrow(common.by_batch(work), "doc_id long, fingerprint string")


def _branch(bounds: list[int], first: int = 0) -> Column:
    """Number of bounds below doc_id, by a tree of comparisons."""
    if not bounds:
        return F.lit(first)
    m = len(bounds) // 2
    return F.when(F.col("doc_id") <= bounds[m], _branch(bounds[:m], first)).otherwise(_branch(bounds[m + 1 :], first + m + 1))


def beside_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, bucket and follower, so sorted that each row is followed by the next by descending doc_id.

    Rows are dealt into ranges of doc_id (null ids last, in a range of their own); each range
    also gets, as ``follower``, the rows with the highest doc_id of the range below, the lowest
    range those of the highest. Only the ranges' limits come to the driver. Ties are ordered
    by text.
    """
    spark = docs.sparkSession
    rows = common.pick(docs, "doc_id", "text")
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 100 * parts)).first()[0]
    bucket = F.when(F.col("doc_id").isNull(), -1).otherwise(_branch(sorted(set(cuts or [])))).cast("int")
    top = {r["bucket"]: r["top"] for r in rows.select("doc_id").withColumn("bucket", bucket).groupBy("bucket").agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(top)
    above = dict(zip(order, [*order[1:], *order[:1]], strict=True))  # the highest range's first rows follow the lowest range
    if not order:
        return rows.withColumn("bucket", F.lit(0)).withColumn("follower", F.lit(False))
    limits = spark.createDataFrame([(b, top[b], above[b]) for b in order], "b int, top long, above int")
    rows = rows.withColumn("bucket", bucket).join(F.broadcast(limits), F.col("bucket") == F.col("b"))
    copies = F.when(F.col("doc_id").eqNullSafe(F.col("top")), F.array(F.struct("bucket", F.lit(False).alias("follower")), F.struct(F.col("above").alias("bucket"), F.lit(True).alias("follower"))))
    rows = rows.select("doc_id", "text", F.explode(F.coalesce(copies, F.array(F.struct("bucket", F.lit(False).alias("follower"))))).alias("c")).select("doc_id", "text", "c.*")
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "follower", F.col("doc_id").desc_nulls_last(), "text")


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many (or all) of another text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edit, and what sketches find them to share.

    Null texts count as empty. Empty texts have an empty sketch; two empty ones are alike
    (1.0), an empty and another are not (0.0). Rows with equal doc_id are ordered by text;
    a table of one row is its own next. An empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[tuple] = []
        for batch in batches:
            rows = rest + list(zip(batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()], batch.column(3).to_pylist(), strict=True))
            rest = rows[-1:]
            for lo, hi in flat.chunks([r[1] for r in rows[:-1]]):
                yield _compare(rows[lo : hi + 1])

    shape = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return beside_next(docs).select("doc_id", "text", "bucket", "follower").mapInArrow(run, shape)


def _compare(rows: list[tuple]) -> pa.RecordBatch:
    """Each row but the last against its edit and its successor; followers are successors only."""
    at = [i for i, r in enumerate(rows[:-1]) if not r[2]]
    texts = [r[1] for r in rows]
    edits = [edited(texts[i], texts[i + 1]) for i in at]
    mine, changed = Prints(texts), Prints(edits)
    here = np.array(at, dtype=np.int64)
    cols = [
        pa.array([rows[i][0] for i in at], pa.int64()),
        pa.array([len(texts[i]) for i in at], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edits], pa.string()),
        pa.array(map(mine.written, at), pa.string()),
        pa.array(map(changed.written, range(len(at))), pa.string()),
        pa.array(mine.likeness(here, changed, np.arange(len(at))), pa.float64()),
        pa.array(mine.likeness(here, mine, here + 1), pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def op2_invertible_sketch(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every row of ``documents`` and of its edited text, and how alike they are; see ``edit_likeness`` for nulls, ties, repeated rows and empty tables."""
    return edit_likeness(common.read(spark, sf_dir, "documents"))
