import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from filmcrate.llm import simhash
from filmcrate.llm.components import components


def groups(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    links = [tuple(map(int, x)) for x in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2001 + i) for i in range(50)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for p in links if p[0] != p[1] for x in p}
    assert got == groups(nodes, [p for p in links if p[0] != p[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_allocation_is_the_least():
    rng = np.random.default_rng(0)
    for _ in range(20):
        costs = [[0.0, *np.sort(rng.random(3) * 100)] for _ in range(4)]
        cost, chosen = simhash.allocate(costs, 4)
        every = [sum(costs[i][t] for i, t in enumerate(ts)) for ts in np.ndindex(4, 4, 4, 4) if sum(ts) == 4]
        assert sum(t + 1 for t in chosen) == 4 and abs(cost - min(every)) < 1e-9


@pytest.mark.parametrize("bucket", [4096, 30])
def test_links_on_dense_clusters(spark, bucket):
    rng = np.random.default_rng(5)
    fps = set()
    for _ in range(4):
        centre = int(rng.integers(0, 1 << 63))
        for _ in range(90):
            fps.add(centre ^ sum({1 << int(b) for b in rng.integers(0, 64, int(rng.integers(0, 4)))}))
    fps |= {int(x) for x in rng.integers(0, 1 << 63, 300)}
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    nodes = spark.createDataFrame(list(zip(fps, range(len(fps)), strict=True)), "fp long, node long")
    links = [(a, b) for a, b in combinations(range(len(fps)), 2) if ((fps[a] ^ fps[b]) & (1 << 64) - 1).bit_count() <= 3]
    found = [(r["a"], r["b"]) for r in simhash.near_links(nodes, 3, bucket).collect()]
    assert {tuple(sorted(p)) for p in found} <= set(links)
    assert groups(range(len(fps)), found) == groups(range(len(fps)), links)


def test_large_buckets_at_eight_bits(spark):
    """Buckets over the limit lose no link at the wider radius, where points around a fingerprint are too many to list."""
    rng = np.random.default_rng(6)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 200)}
    for _ in range(3):
        centre = int(rng.integers(0, 1 << 63))
        fps |= {centre ^ sum({1 << int(b) for b in rng.integers(0, 63, int(rng.integers(0, 9)))}) for _ in range(120)}
    fps = sorted(fps)
    nodes = spark.createDataFrame(list(zip(fps, range(len(fps)), strict=True)), "fp long, node long")
    links = [(a, b) for a, b in combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 8]
    found = [(r["a"], r["b"]) for r in simhash.near_links(nodes, 8, 30).collect()]
    assert {tuple(sorted(p)) for p in found} <= set(links)
    assert groups(range(len(fps)), found) == groups(range(len(fps)), links)


def test_every_plan_is_whole():
    rng = np.random.default_rng(2)
    both = np.full((64, 64), 25.0) + np.diag(np.full(64, 25.0))
    for parts in range(2, 6):
        split = simhash.group_bits(both, 100, parts)
        assert sorted(b for g in split for b in g) == list(range(64))
        for _ in range(5):
            t = [-1] * parts
            for i in rng.integers(0, parts, 4):
                t[i] += 1
            every = [m for g, k in zip(split, t, strict=True) if k <= 2 for m in simhash.masks(g, k)]
            if max(t) > 2:
                continue
            for _ in range(200):
                x = sum({1 << int(b) for b in rng.integers(0, 64, 3)})
                assert any(m & x == 0 for m in every)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("doc_id < 700")
    extra = [(-1, None), (-2, ""), (-3, "One  two"), (-4, "ONE two"), (None, "one two"), (None, "lonely words of a nameless text"), (5, "again"), (5, "again"), (-6, "Wörter ÄÖ " * 9000)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema)).withColumn("fp", F.lit("x"))
    rows = [(r[0], plain(r[1])) for r in docs.select("doc_id", "text").collect()]
    fps = sorted({f for _, f in rows})
    root = groups(range(len(fps)), [(a, b) for a, b in combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 3])
    least = {}
    for i, f in rows:
        if i is not None:
            least[root[fps.index(f)]] = min(i, least.get(root[fps.index(f)], i))
    got = sorted((r["doc_id"] or 0, r["fp"] % (1 << 64), r["component_id"] or 0) for r in simhash.near_duplicates(docs).collect())
    assert got == sorted((i or 0, f, least.get(root[fps.index(f)], 0) or 0) for i, f in rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_identifiers_of_the_whole_range(spark):
    rows = [(1 << 62, "one two three four"), ((1 << 63) - 1, "One two three four"), (-(1 << 63), "five six seven eight"), (None, "nine ten eleven twelve"), (None, "five six seven eight")]
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1 << 62, 1 << 62), ((1 << 63) - 1, 1 << 62), (-(1 << 63), -(1 << 63)), (None, None), (None, -(1 << 63))}
