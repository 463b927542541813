"""Near-duplicates by SimHash, found by the generalised pigeonhole principle.

The 64 bits of the distinct fingerprints are grouped into partitions of correlated bits.
Two fingerprints that differ in at most T bits differ in at most t_i bits of some partition i
whenever the sum of (t_i + 1) is T + 1; a partition with t_i = -1 is not looked at. Numbers of
candidates are estimated from counts over all fingerprints, and dynamic programming picks
the thresholds with the least cost, among several numbers of partitions. Fingerprints that
agree under a partition's mask (for t_i = 1 or 2: with any one or two of its bits masked
out as well) meet in a bucket and are verified there by the full distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, flat
from .components import components

BITS, MOST_BITS, SHINGLE, SEED = 64, 3, 3, 42
#: Larger buckets are not compared in one task; they take the path of ``ball_links``, or beyond BALL_BITS that of ``block_links``.
BUCKET, BALL_BITS = 4096, 3
#: Cost of a key row against that of one comparison.
KEY_COST = 200.0
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint_values(texts: list[str], shingle: int = SHINGLE) -> np.ndarray:
    """SimHash of each text as a signed 64-bit number: XXH64 of word shingles, repeats included, majority of each bit."""
    digest, hashes, owner = xxhash.xxh64_intdigest, [], []
    for i, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
        if not words:
            continue
        line = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        n = max(1, len(words) - shingle + 1)
        stop = ends[shingle - 1 :].tolist() if len(words) >= shingle else [len(line)]
        start = [0, *(ends[: n - 1] + 1).tolist()]
        hashes += [digest(line[a:b], SEED) for a, b in zip(start, stop, strict=True)]
        owner.append((i, n))
    out = np.zeros(len(texts), dtype=np.int64)
    if hashes:
        at, count = np.array(owner).T
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, np.concatenate([[0], np.cumsum(count)[:-1]]), axis=0, dtype=np.int32)
        out[at] = np.packbits(2 * ones > count[:, None], axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp of every row. Null texts and texts without words have fp 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in flat.chunks(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(fingerprint_values(texts[lo:hi], shingle))], names=["doc_id", "fp"])

    return common.pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def bit_counts(nodes: DataFrame) -> np.ndarray:
    """How many fingerprints have bits i and j set both (64 x 64), over all of them; tasks send sums only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            raw = batch.column(0).to_numpy().astype(np.int64)
            for lo in range(0, len(raw), 1 << 14):
                x = np.unpackbits(raw[lo : lo + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(total.ravel().astype(np.int64))], names=["cell", "n"])

    out = np.zeros(BITS * BITS)
    for r in nodes.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out.reshape(BITS, BITS)


def group_bits(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal width, each grown from a bit by the strongest correlations."""
    f = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(f * (1 - f), 1e-12))
    tie = np.abs((both / max(n, 1) - np.outer(f, f)) / np.outer(sd, sd))
    np.fill_diagonal(tie, 0)
    left, out = list(range(BITS)), []
    for p in range(parts):
        width = len(left) // (parts - p)
        group = [max(left, key=lambda b: (tie[b, left].sum(), -b))] if p < parts - 1 else list(left)
        while len(group) < width:
            group.append(max((b for b in left if b not in group), key=lambda b: (tie[b, group].sum(), -b)))
        left = [b for b in left if b not in group]
        out.append(sorted(group))
    return out


def allocate(costs: list[list[float]], budget: int) -> tuple[float, list[int]] | None:
    """Thresholds t_i from -1 with the sum of (t_i + 1) equal to ``budget`` and the least sum of costs[i][t_i + 1]; None if no sum gets there."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for k, c in enumerate(row):
                if used + k <= budget and (used + k not in step or cost + c < step[used + k][0]):
                    step[used + k] = (cost + c, [*chosen, k - 1])
        best = step
    return best.get(budget)


def masks(bits: list[int], free: int) -> list[int]:
    """Masks under which fingerprints agree that differ in at most ``free`` of these bits, one bit set dropped in each."""
    if free < 0:
        return []
    whole = sum(1 << b for b in bits)
    return [whole - sum(1 << b for b in drop) for drop in combinations(bits, min(free, len(bits)))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def plan_masks(nodes: DataFrame, n: int, most_bits: int = MOST_BITS) -> tuple[list[int], list[tuple[list[int], int]]]:
    """The masks of the cheapest plan, and the plan: bits and threshold of each partition."""
    both = bit_counts(nodes)
    f = np.diag(both) / max(n, 1)
    same = np.maximum(f * f + (1 - f) * (1 - f), 1e-9)
    choices = {m: group_bits(both, n, m) for m in range(2, min(most_bits + 2, 8) + 1)}
    groups = list({tuple(g) for m in choices for g in choices[m]})
    whole = F.array(*[F.lit(_signed(masks(list(g), 0)[0])) for g in groups])
    seen = nodes.select("fp", F.posexplode(whole).alias("g", "mask")).groupBy("g", F.col("fp").bitwiseAND(F.col("mask")).alias("v")).agg(F.count("*").alias("n"))
    pairs = {r["g"]: float(r["pairs"]) for r in seen.where("n > 1").groupBy("g").agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2).alias("pairs")).collect()}
    best = None
    for m, parts in choices.items():
        costs = []
        for bits in parts:
            equal = pairs.get(groups.index(tuple(bits)), 0.0) + n * n / 2 * float(np.prod(same[bits]))
            odds = (1 - same[bits]) / same[bits]
            one, two = odds.sum(), (odds.sum() ** 2 - (odds**2).sum()) / 2
            near = [0.0, equal, equal * (1 + one), equal * (1 + one + two)]
            costs.append([0.0 if k == 0 else near[k] + KEY_COST * n * len(masks(bits, k - 1)) for k in range(min(4, most_bits + 2))])
        found = allocate(costs, most_bits + 1)
        if found and (best is None or found[0] < best[0]):
            best = found[0], list(zip(parts, found[1], strict=True))
    plan = best[1]
    return [_signed(x) for bits, t in plan for x in masks(bits, t)], plan


def _differing(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))


def _forest(fp: np.ndarray, node: np.ndarray, most_bits: int, found: list) -> None:
    """Links of one bucket in which very many pairs are near: a spanning forest of them."""
    left = np.arange(len(fp))
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            near = _differing(fp[front[0]] ^ fp[left]) <= most_bits
            hit = left[near]
            found.append((np.full(len(hit), node[front[0]]), node[hit]))
            front, left = np.concatenate([front[1:], hit]), left[~near]


def _within(fp: np.ndarray, node: np.ndarray, most_bits: int, found: list) -> None:
    """Links of one bucket: all its near pairs, or a spanning forest where they are more than a few for each row."""
    step, near, total = max(1, (1 << 19) // len(fp)), [], 0
    for lo in range(0, len(fp), step):
        part = fp[lo : lo + step]
        i, k = np.nonzero(_differing(part[:, None] ^ fp[None, lo:]) <= most_bits)
        i, k = i[k > i] + lo, k[k > i] + lo
        near.append((node[i], node[k]))
        total += len(i)
        if total > 8 * len(fp):
            return _forest(fp, node, most_bits, found)
    found += near
    return None


def bucket_links(keys: DataFrame, mask: list[int], most_bits: int) -> DataFrame:
    """Verified links a, b of rows (j, key, fp, node) that share (j, key). Buckets are runs of sorted rows."""
    shared = np.array(mask, dtype=np.int64)

    def links(j: np.ndarray, key: np.ndarray, fp: np.ndarray, node: np.ndarray) -> list:
        found: list = []
        new = np.concatenate([[True], (j[1:] != j[:-1]) | (key[1:] != key[:-1])])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(j)))
        for s, n in zip(start[size > 64], size[size > 64], strict=True):
            _within(fp[s : s + n], node[s : s + n], most_bits, found)
        small = np.repeat(size <= 64, size)
        run = np.repeat(np.arange(len(start)), size)
        for gap in range(1, min(64, int(size[size <= 64].max(initial=0)))):
            i = np.flatnonzero((run[:-gap] == run[gap:]) & small[:-gap])
            x = fp[i] ^ fp[i + gap]
            near = _differing(x) <= most_bits
            i, x = i[near], x[near]
            for k in range(len(shared)):  # a pair that an earlier mask brings together is left to it
                keep = (k >= j[i]) | ((x & shared[k]) != 0)
                i, x = i[keep], x[keep]
            found.append((node[i], node[i + gap]))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, dtype=np.int64)] * 4
        for batch in chain(batches, [None]):
            if batch is not None:
                rows = [np.concatenate([r, c.to_numpy()]) for r, c in zip(rest, batch.columns, strict=True)]
                changes = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])) if len(rows[0]) else np.zeros(0, dtype=int)
                cut = int(changes[-1]) + 1 if len(changes) else 0
            else:
                rows, cut = rest, len(rest[0])
            rest = [r[cut:] for r in rows]
            found = links(*(r[:cut] for r in rows)) if cut else []
            if found:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    sorted_rows = keys.select(F.col("j").cast("long"), "key", "fp", "node").repartition("j", "key").sortWithinPartitions("j", "key")
    return sorted_rows.mapInArrow(run, "a long, b long")


def ball_links(keys: DataFrame, mask: list[int], most_bits: int) -> DataFrame:
    """Links that connect all rows of large buckets as far as they lie within ``most_bits``, without comparing pairs.

    Two fingerprints lie within d + e bits if and only if some point lies within d bits of
    one and e bits of the other. Every row gives the points around it (only bits that its
    bucket leaves free are changed); at each point all rows within e bits hang on the least
    row within d bits, where d = most_bits // 2 and e = most_bits - d. Rows grow with the
    bucket's size, never with its square.
    """
    near, far = most_bits // 2, most_bits - most_bits // 2
    rows = None
    for j, m in enumerate(mask):
        free = [b for b in range(BITS) if not m >> b & 1]
        for k in range(far + 1):
            flips = F.array(*[F.lit(_signed(sum(1 << b for b in s))) for s in combinations(free, k)])
            part = keys.where(F.col("j") == j).select("node", (F.lit(k <= near)).alias("core"), F.explode(flips).alias("flip"), "fp").select("node", "core", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
            rows = part if rows is None else rows.union(part)
    rows = common.settle(rows, "points")
    hubs = common.settle(rows.where("core").groupBy("point").agg(F.min("node").alias("hub")), "hubs")
    return rows.join(hubs, "point").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()


def block_links(keys: DataFrame, most_bits: int, block: int) -> DataFrame:
    """Links that connect all rows of large buckets as far as they lie within ``most_bits``, by comparing pairs of blocks.

    A bucket is dealt out in blocks of about ``block`` / 2 rows; every pair of blocks is one
    cell, so that no task holds more than two blocks of a bucket at once and no pair is left
    out. Rows grow with the number of blocks, comparisons with the square of the bucket.
    """
    sizes = common.settle(keys.groupBy("j", "key").agg(F.count("*").alias("m")).select(F.col("j").alias("g"), F.col("key").alias("k"), F.ceil(F.col("m") / (block / 2)).cast("int").alias("blocks")), "sizes")
    rows = keys.join(sizes, (F.col("j") == F.col("g")) & (F.col("key") == F.col("k"))).withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int"))
    rows = rows.select("j", "key", "fp", "node", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cell = F.xxhash64("j", "key", F.least("own", "other"), F.greatest("own", "other"))
    # a cell is a bucket of its own for bucket_links; without masks every near pair of it is found, or a spanning forest
    return bucket_links(rows.select(F.lit(0).alias("j"), cell.alias("key"), "fp", "node"), [], most_bits).distinct()


def near_links(nodes: DataFrame, most_bits: int = MOST_BITS, bucket: int = BUCKET) -> DataFrame:
    """Links a, b between rows (fp distinct, node) within ``most_bits`` bits that leave no component apart."""
    n = nodes.count()
    mask, _ = plan_masks(nodes, n, most_bits)
    keys = nodes.select("fp", "node", F.posexplode(F.array(*map(F.lit, mask))).alias("j", "mask")).select("j", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "node")
    large = common.settle(keys.groupBy("j", "key").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("j", "key"), "large")
    found = large.limit(10_001).count()
    if not found:
        return bucket_links(keys, mask, most_bits)
    large = F.broadcast(large) if found <= 10_000 else large
    rest = bucket_links(keys.join(large, ["j", "key"], "left_anti"), mask, most_bits)
    hot = keys.join(large, ["j", "key"])
    return rest.union(ball_links(hot, mask, most_bits) if most_bits <= BALL_BITS else block_links(hot, most_bits, bucket))


def near_duplicates(docs: DataFrame, most_bits: int = MOST_BITS, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) of every row.

    Null texts and texts without words have fingerprint 0 and link like any other; shorter
    texts than a shingle are one shingle. Repeated rows and equal texts meet in one node.
    Rows without doc_id take part; a component without any doc_id has a null component_id.
    Any doc_id is allowed. An empty table gives an empty one; further columns are not
    read. Nothing is left out of large groups: see ``ball_links`` and ``block_links``.
    """
    marks = common.settle(fingerprints(docs, shingle), "fingerprints")
    nodes = common.settle(marks.groupBy("fp").agg(F.min("doc_id").alias("first")).select("fp", F.col("fp").alias("node"), "first"), "nodes")
    roots = components(near_links(nodes.select("fp", "node"), most_bits, bucket))
    named = common.settle(nodes.join(roots, "node", "left").select(F.col("fp").alias("f"), F.coalesce("root", "node").alias("c"), "first"), "named")
    least = common.settle(named.groupBy("c").agg(F.min("first").alias("component_id")), "least")
    named = named.join(least, "c").select("f", "component_id")
    return marks.join(named, marks["fp"] == named["f"]).select("doc_id", "fp", "component_id")


def op6_simhash_pigeonhole(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of ``documents``; see ``near_duplicates`` for nulls, ties, repeated rows and empty tables."""
    out = near_duplicates(common.read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
