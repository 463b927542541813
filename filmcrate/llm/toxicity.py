"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the hashes of its words, of neighbouring words and of words one and
two places apart, each once. FTRL-proximal keeps a learning rate for every coordinate and
sets coordinates with little evidence to exactly zero (L1), so a model is a short list of
(feature, weight) that every executor gets. Training reads a bounded sample of labelled
rows in one task; scoring reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, flat

U = np.uint64
BITS = 20
#: Places between the two words of a pair feature.
GAPS = (1, 2, 3)
#: Labelled rows that training reads at most: those with the smallest hashes of doc_id.
TRAIN_ROWS = 12_000
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 8.0, 0.1, 3
#: One row in so many of the sample sets the threshold instead of the weights.
CALIBRATE = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers below 2**BITS and the text each belongs to, repeats included."""
    f = flat.flatten(texts, _GAP)
    words = flat.span_hash(flat.prefix(flat.BYTES[_LOWER[f.data]], flat._B), f.word_start, f.word_end, flat._B)
    found, owner = [words], [f.word_doc]
    for gap in GAPS:
        same = np.flatnonzero(f.word_doc[gap:] == f.word_doc[:-gap])
        found.append(flat.mix(words[same] * U(3) + words[same + gap] * U(2 * gap + 5)))
        owner.append(f.word_doc[same])
    return (np.concatenate(found) >> U(64 - BITS)).astype(np.int64), np.concatenate(owner)


def feature_sets(texts: list[str]) -> list[np.ndarray]:
    index, owner = features(texts)
    key = np.unique((owner << BITS) | index)
    return np.split((key & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(key >> BITS, np.arange(1, len(texts))))


@dataclass(frozen=True)
class Model:
    index: np.ndarray
    weight: np.ndarray
    bias: float

    @cached_property
    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, dtype=np.float32)
        out[self.index] = self.weight
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        dense = self.dense
        out = np.empty(len(texts))
        for lo, hi in flat.chunks(texts):
            index, owner = features(texts[lo:hi])
            hit = np.flatnonzero(dense[index])
            key = np.unique((owner[hit] << BITS) | index[hit])
            total = np.bincount(key >> BITS, weights=dense[key & ((1 << BITS) - 1)], minlength=hi - lo)
            out[lo:hi] = 1 / (1 + np.exp(-np.clip(total + self.bias, -35, 35)))
        return out


def fit(sets: list[np.ndarray], labels: np.ndarray, seed: int = 0) -> Model:
    """FTRL-proximal over shuffled rows; the bias is then moved so that 0.5 is the threshold of the best F1 on rows left out of it."""
    n = len(labels)
    prior = (labels.sum() + 0.5) / (n + 2)
    flat_bias = float(np.log(prior / (1 - prior)))
    if not n or labels.min() == labels.max():
        return Model(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32), flat_bias)
    # place 0 beyond the features is the bias, without L1
    z, g2 = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    l1 = np.append(np.full(1 << BITS, L1), 0.0)

    def weights(at: np.ndarray) -> np.ndarray:
        zi, li = z[at], l1[at]
        return np.where(np.abs(zi) > li, (np.sign(zi) * li - zi) / ((BETA + np.sqrt(g2[at])) / ALPHA + L2), 0.0)

    own = np.arange(n) % CALIBRATE != 0 if n >= 50 * CALIBRATE else np.ones(n, dtype=bool)
    rows = np.flatnonzero(own)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(rows):
            at = np.append(sets[i], 1 << BITS)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[i]
            old = np.sqrt(g2[at])
            g2[at] += g * g
            z[at] += g - (np.sqrt(g2[at]) - old) / ALPHA * w
    w = weights(np.arange((1 << BITS) + 1))
    index = np.flatnonzero(w[:-1])
    held = np.flatnonzero(~own) if not own.all() and 0 < labels[~own].sum() < (~own).sum() else rows
    raw = np.array([w[sets[i]].sum() + w[-1] for i in held])
    order = np.argsort(-raw, kind="stable")
    caught = np.cumsum(labels[held][order])
    f1 = 2 * caught / (np.arange(1, len(held) + 1) + caught[-1])
    best = int(np.argmax(f1))
    cut = (raw[order][best] + raw[order][min(best + 1, len(held) - 1)]) / 2
    return Model(index, w[index].astype(np.float32), float(w[-1] - cut))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from labelled rows whose crc32(doc_id as text) mod 5 is not 0.

    At most ``rows`` labels (those with the smallest hashes of doc_id) and as many texts are
    read; null labels and labels without a document are passed over, null texts count as
    empty. With one class only, or no labels, the score is a constant from the class counts.
    """
    spark = docs.sparkSession
    known = common.pick(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id", "toxic").limit(rows)
    texts = common.pick(docs, "doc_id", "text").join(F.broadcast(known), "doc_id").select("h", "doc_id", "toxic", "text")

    def build(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [t or "" for t in batch.column(3).to_pylist()]
        for lo, hi in flat.chunks(texts):
            sets = pa.array(feature_sets(texts[lo:hi]), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:3]), sets], names=["h", "doc_id", "toxic", "f"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, labels = [], []
        for batch in batches:
            sets += [x.values.to_numpy() for x in batch.column(3)]
            labels += batch.column(2).to_pylist()
        model = fit(sets, np.array(labels, dtype=np.float64))
        index, weight = np.append(model.index, -1), np.append(model.weight.astype(np.float64), model.bias)
        yield pa.RecordBatch.from_arrays([pa.array(index), pa.array(weight)], names=["i", "w"])
        common.tidy()

    sample = texts.mapInArrow(common.by_batch(build), "h long, doc_id long, toxic int, f array<int>").orderBy("h", "doc_id", "toxic", "f").limit(rows)
    learned = sample.mapInArrow(learn, "i long, w double").toArrow()  # at most 2**BITS + 1 weights
    index, weight = learned["i"].to_numpy(), learned["w"].to_numpy()
    if not len(index):
        return fit([], np.zeros(0))
    return Model(index[index >= 0], weight[index >= 0].astype(np.float32), float(weight[index < 0][0]))


def scorer(docs: DataFrame, model: Model):
    """A column function: score of a text, 0 to 1."""
    parts = model.index.astype(np.int32), model.weight, model.bias  # a few thousand weights: they go with the function

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        mine = Model(*parts)
        try:
            for texts in batches:
                yield pd.Series(mine.scores([t or "" for t in texts]))
        finally:
            common.tidy()

    return score


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from 0.5 on) of every row.

    Null and empty texts get the score of a text without features. Long texts are read whole,
    repeated rows scored alike, other columns not read; an empty table gives an empty one.
    """
    rows = common.pick(docs, "doc_id", "text")
    rows = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer(docs, model)("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op1_ftrl_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity score of every row of ``documents`` by a model fitted on rows that are not held out.

    Null texts count as empty; repeated rows are scored alike, texts of any length whole. For
    labels that are null, unknown, of one class only or not there see ``train``. An empty
    table gives no rows. Columns besides doc_id and text are not read.
    """
    docs = common.read(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, common.read(spark, sf_dir, "labels")))
