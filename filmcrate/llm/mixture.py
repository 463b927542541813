"""Mixing sources to target weights by a low-discrepancy schedule.

A source's documents stand in a shuffled order (by a hash of identifier and text) and form
one stream of words that may be read up to three times over. The mix is a sequence of slots
of equally many words. Slot k takes the golden-ratio point frac(k * phi); the point's place
among the cumulated targets names its source, and the slot's rank among those of its source
names the block of that source's stream it reads. A source that no point meets has one slot
after all others. Joining slots with the documents' pieces
of blocks gives what the mix reads of each document.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
#: A source is read this often at most.
EPOCHS = 3
#: Words of a slot, whatever the size of the mix: larger slots would pass over small sources.
SLOT_WORDS = 16
#: Sources at most: their totals, targets and cumulated weights are kept on the driver.
MOST_SOURCES = 1_000_000
_WORD = r"[^\x20\x09-\x0D]+"
_GOLDEN = 0x9E3779B97F4A7C15


def targets(sizes: Sequence[int], weights: Sequence[float]) -> list[float]:
    """Shares of the sum of sizes by weight, none above EPOCHS times its own size; what is cut off is shared again by weight."""
    out, left, free = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while free:
        whole = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / whole > EPOCHS * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / whole
            break
        for i in over:
            out[i] = float(EPOCHS * sizes[i])
        free -= set(over)
        left -= sum(out[i] for i in over)
    return out


def sources_at(slots: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Source of each slot: the golden-ratio point mapped through the cumulated shares."""
    point = (slots.astype(np.uint64) * np.uint64(_GOLDEN) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    return np.minimum(np.searchsorted(edges, point, side="right"), len(edges) - 1)


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, seed: int = 0, key: str = "") -> tuple[DataFrame, DataFrame]:
    """Two tables: the documents as the mix sees them, and the pieces it reads.

    Documents: doc_id, source, size, src (source's number), source_size, target, start (first
    word in the source's stream). Pieces, one for each slot and document it reads from:
    slot (place in the mix), src, start, doc_id, size, from_word, words.

    Null texts, empty texts and texts of white space have size 0 and are never read; a null
    source is a source of its own, the last. Repeated rows are read separately. An empty
    table, or one without words, gives an empty mix. The order, hence the whole mix, depends
    on the rows and the seed only. Columns besides doc_id, text and source are not read, but
    for ``key``, which the documents keep where it is given.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    more = [key] if key else []
    thin = common.pick(docs, "doc_id", "text", "source", *more).select(*more, "doc_id", "source", F.regexp_count(text, F.lit(_WORD)).cast("long").alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))
    thin = common.settle(thin, "sizes")
    totals = thin.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    totals = sorted(totals, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in totals]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))])
    words, n = sum(sizes), sum(r["n"] for r in totals)
    block = SLOT_WORDS
    slots = round(words / block) if words >= block else min(words, 1)
    edges = np.cumsum(goal) / max(words, 1)
    last = max((i for i, g in enumerate(goal) if g > 0), default=0)
    edges[last:] = 1.0  # rounding never names an empty source

    known = spark.createDataFrame([(r["source"], i, r["size"], g) for i, (r, g) in enumerate(zip(totals, goal, strict=True))], "s string, src int, source_size long, target double")
    known = F.broadcast(known) if len(totals) <= 10_000 else known
    rows = thin.join(known, thin["source"].eqNullSafe(known["s"])).drop("s")
    bits = max(0, (n // 2048).bit_length())
    rows = rows.withColumn("bin", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long"))
    held = rows.groupBy("src", "bin").agg(F.sum("size").alias("held"))
    before = held.select(F.col("src"), F.col("bin"), F.coalesce(F.sum("held").over(Window.partitionBy("src").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = Window.partitionBy("src", "bin").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(before, ["src", "bin"]).withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(own), F.lit(0)))
    rows = common.settle(rows.select(*more, "doc_id", "source", "size", "src", "source_size", "target", "start"), "stream")

    @F.pandas_udf("int")
    def source_of(k: pd.Series) -> pd.Series:
        return pd.Series(sources_at(k.to_numpy(), edges).astype(np.int32))

    plan = spark.range(slots).select(F.col("id").alias("slot"), F.shiftright("id", 12).alias("part"), source_of("id").alias("src"))
    counts = plan.groupBy("src", "part").agg(F.count("*").alias("n"))
    first = counts.select("src", "part", F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("src", "part").orderBy("slot")) - 1
    plan = plan.join(first, ["src", "part"]).select("slot", "src", (F.col("first") + rank).alias("block"))
    missed = known.where("target > 0").join(counts.select("src").distinct(), "src", "left_anti")
    plan = plan.union(missed.select((F.lit(slots).cast("long") + F.col("src")).alias("slot"), "src", F.lit(0).cast("long").alias("block")))

    real = rows.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1))))
    real = real.withColumn("at", F.col("start") + F.col("epoch") * F.col("source_size"))
    real = real.where(F.col("at") < F.col("target") + F.lit(64 * block))  # no slot lies further on: ranks stay near target / block
    real = real.withColumn("block", F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")))
    lo = F.greatest(F.col("at"), F.col("block") * block)
    hi = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block)
    real = real.select("src", "block", "start", "doc_id", "size", (lo - F.col("at")).alias("from_word"), (hi - lo).alias("words"))
    return rows, real.join(plan, ["src", "block"]).select("slot", "src", "start", "doc_id", "size", "from_word", "words")


def taken_words(docs: DataFrame, weights: Sequence[float] = WEIGHTS, seed: int = 0, key: str = "") -> DataFrame:
    """One row a document: the ``key`` and its start in the stream if one is given, doc_id, source, size, source_size, target and taken."""
    rows, pieces = mix_sources(docs, weights, seed, key)
    read = pieces.groupBy("src", "start").agg(F.sum("words").alias("taken"))
    full = rows.where("size > 0").join(read, ["src", "start"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    names = [*([key, "start"] if key else []), "doc_id", "source", "size", "source_size", "target", "taken"]
    return full.select(*names).union(rows.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*names))


def read_times(docs: DataFrame, key: str) -> DataFrame:
    """``key`` (unique) and times: how often a mix of whole documents reads each, EPOCHS times at most; once where there are no words.

    A document is read as often as the mix takes all of its words. What a source is then
    short of, since its last document was taken in part, the documents behind that one in
    the stream make up; what these leave, one more whose size comes nearest to it, or none
    if that would be farther off.
    """
    taken = common.settle(taken_words(docs, key=key).select(key, "start", "source", "size", "taken"), "taken")
    part = F.col("taken") % F.col("size")
    worded = taken.where("size > 0").withColumn("times", F.expr("taken div size"))
    short = worded.groupBy("source").agg(F.sum(part).alias("short"), F.max(F.when(part > 0, F.col("start") + F.col("size"))).alias("behind")).where("short > 0").withColumnRenamed("source", "s")
    behind = (F.col("start") >= F.col("behind")) & (F.col("start") + F.col("size") <= F.col("behind") + F.col("short")) & (F.col("times") < EPOCHS)
    once = F.coalesce(behind, F.lit(False)).cast("int")
    times = worded.join(short, F.col("source").eqNullSafe(F.col("s")), "left").select(key, "source", "size", "short", once.alias("once"), (F.col("times") + once).cast("int").alias("times"))
    times = common.settle(times, "times")
    left = times.groupBy("source").agg((F.max("short") - F.sum(F.col("once") * F.col("size"))).alias("left")).where("left > 0").select(F.col("source").alias("s"), "left")
    off = F.abs(F.col("size") - F.col("left"))
    last = times.where(F.col("times") < EPOCHS).join(left, F.col("source").eqNullSafe(F.col("s"))).where(off < F.col("left"))
    last = last.groupBy("s").agg(F.min_by(key, F.struct(off, key)).alias("last")).select("last")
    times = times.join(last, F.col(key) == F.col("last"), "left").select(key, (F.col("times") + F.col("last").isNotNull().cast("int")).alias("times"))
    return times.union(taken.where("size = 0").select(key, F.lit(1).alias("times")))


def op3_golden_schedule(spark, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every row of ``documents``; see ``mix_sources`` for nulls, ties, repeated rows and empty tables."""
    out = taken_words(common.read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")
