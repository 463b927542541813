"""Quality rules on repetition: how much of a text lies inside repeated n-grams and lines.

Rolling polynomial hashes (one pass of prefix sums over the bytes and one over the words,
modulo 2**64) give the hash of every word and n-word window by two subtractions; equal
hashes inside one text are equal windows. Words of more than 64 bytes have a digest instead
(``flat.strong``), and lines are compared as they are. Whole batches of texts are handled as flat
arrays. Memory follows the longest text of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, flat

#: Highest share of a text's word characters in the most frequent n-gram, by n.
TOP_SHARE = {2: 0.20, 3: 0.18, 4: 0.16}
#: Highest share in n-grams that occur twice or more, by n.
DUP_SHARE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Highest share of lines, and of their characters, that repeat an earlier line.
LINE_SHARE, LINE_CHARS_SHARE = 0.30, 0.20
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_share double, dup_line_chars_share double, top_gram_share double, dup_gram_excess double"
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def measure(texts: list[str]) -> dict[str, np.ndarray]:
    """The columns of SCHEMA after doc_id, for texts handled together."""
    n = len(texts)
    f = flat.flatten(texts)
    words, doc, chars = flat.word_hashes(f), f.word_doc, f.word_points()
    n_words, word_chars = flat.per_doc(doc, n), flat.per_doc(doc, n, chars)
    symbol_at = np.flatnonzero(_SYMBOL[f.data])
    n_symbols = flat.per_doc(np.searchsorted(f.begin, symbol_at, side="right") - 1, n)

    ends = np.flatnonzero(f.data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    counted = np.searchsorted(f.word_start, ends) > np.searchsorted(f.word_start, starts)
    starts, ends = starts[counted], ends[counted]
    line_doc = np.searchsorted(f.begin, starts, side="right") - 1
    raw, seen, again = f.data.tobytes(), set(), np.zeros(len(starts), dtype=bool)
    for i, line in enumerate(zip(line_doc.tolist(), map(raw.__getitem__, map(slice, starts.tolist(), ends.tolist())), strict=True)):
        again[i] = line in seen  # lines themselves are compared, not hashes of them
        seen.add(line)
    line_chars = f.points[ends] - f.points[starts]
    n_lines, n_dup = flat.per_doc(line_doc, n), flat.per_doc(line_doc[again], n)
    dup_chars, all_chars = flat.per_doc(line_doc[again], n, line_chars[again]), flat.per_doc(line_doc, n, line_chars)

    sums, before = flat.word_sums(words), np.concatenate([[0], np.cumsum(chars)])
    total = np.maximum(word_chars, 1)
    top, excess, n_repeat = np.zeros(n), np.zeros(n), np.zeros(n, dtype=np.int64)
    verdict = np.ones(n, dtype=bool)
    for size in sorted({*TOP_SHARE, *DUP_SHARE, 3}):
        at, grams = flat.gram_hashes(words, doc, size, sums)
        dup = flat.repeated(grams)
        first = at[dup]
        if size in TOP_SHARE:
            _, one, inverse, count = np.unique(grams[dup], return_index=True, return_inverse=True, return_counts=True)
            most = np.zeros(n)
            np.maximum.at(most, doc[first[one]], count * (before[first[one] + size] - before[first[one]]))
            share = np.minimum(most / total, 1.0)
            verdict &= share <= TOP_SHARE[size]
            top = np.maximum(top, share)
        if size == 3 or size in DUP_SHARE:
            held = flat.covered(len(words), first, size)
            if size == 3:
                n_repeat = flat.per_doc(doc[held], n)
            if size in DUP_SHARE:
                share = flat.per_doc(doc[held], n, chars[held]) / total
                verdict &= share <= DUP_SHARE[size]
                excess = np.maximum(excess, share - DUP_SHARE[size])
    line_share, line_chars_share = n_dup / np.maximum(n_lines, 1), dup_chars / np.maximum(all_chars, 1)
    verdict &= (line_share <= LINE_SHARE) & (line_chars_share <= LINE_CHARS_SHARE)
    failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat, "base_failed": failed, "kept": ~failed & verdict, "dup_line_share": line_share, "dup_line_chars_share": line_chars_share, "top_gram_share": top, "dup_gram_excess": excess}


def repetition_rules(docs: DataFrame) -> DataFrame:
    """One row a document with its counts, shares and verdict.

    Null and empty texts have no words: every count is 0, ``base_failed`` is true, ``kept``
    false. Very long texts are measured whole. Repeated rows give repeated results, an empty
    table an empty one; columns other than doc_id and text are not read.
    """

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
        for lo, hi in flat.chunks(texts):
            out = measure(texts[lo:hi])
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *map(pa.array, out.values())], names=["doc_id", *out])

    return common.pick(docs, "doc_id", "text").mapInArrow(common.by_batch(work), SCHEMA)


def op5_repetition_coverage(spark, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every row of ``documents``; see ``repetition_rules`` for nulls, very long texts and empty tables."""
    return repetition_rules(common.read(spark, sf_dir, "documents"))
