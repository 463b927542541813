import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from filmcrate.llm import mixture




def test_targets_share_again():
    assert mixture.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    assert mixture.targets([10, 1000, 0], [5, 2, 1]) == [30.0, 980.0, 0.0]
    assert mixture.targets([], []) == []


def test_mix_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    extra = [(-1, None, None), (-2, "a b c " * 9, None), (-3, " \n", "src1"), (-3, " \n", "src1"), (None, "z " * 40, "tiny"), (-9, "y " * 50000, "long")]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    rows, pieces = mixture.mix_sources(docs)
    rows, pieces = rows.collect(), pieces.collect()
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = mixture.targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    assert {(r["source"], r["source_size"], r["target"]) for r in rows} == {(s, sizes[s], g) for s, g in zip(names, goal, strict=True)}
    stream = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["size"] == 0 or len(stream[r["src"]]) == r["start"]
        stream[r["src"]] += [(r["doc_id"], r["start"], i) for i in range(r["size"])]
    words, got = sum(sizes.values()), defaultdict(list)
    for p in pieces:
        got[p["slot"], p["src"]] += [(p["doc_id"], p["start"], p["from_word"] + i) for i in range(p["words"])]
    point, at, rank = 0.0, np.cumsum(goal) / words, defaultdict(int)
    for k in range(round(words / 16)):
        point = (k * 0x9E3779B97F4A7C15 % 2**64) / 2**64
        s = min(int(np.searchsorted(at, point, side="right")), len(names) - 1)
        whole = stream[s] * 3
        assert sorted(got.get((k, s), [])) == sorted(whole[rank[s] * 16 : rank[s] * 16 + 16])
        rank[s] += 1


def test_taken_near_target_and_repeatable(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mixture.taken_words(docs).collect()
    assert len(out) == docs.count()
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in out)
    taken, goal = defaultdict(int), {}
    for r in out:
        taken[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
    assert all(abs(taken[s] - goal[s]) <= max(0.02 * goal[s], 64) for s in goal)
    again = mixture.taken_words(docs.repartition(3)).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def test_empty_and_wordless_tables(spark):
    shape = "doc_id long, text string, source string, block int, src int"
    assert mixture.taken_words(spark.createDataFrame([], shape)).count() == 0
    (r,) = mixture.taken_words(spark.createDataFrame([(1, None, None, 1, 1)], shape)).collect()
    assert (r["taken"], r["target"]) == (0, 0.0)


def test_small_sources_of_a_large_mix(spark):
    """Sources of one short document beside 40 million words are taken near their targets: none falls between the slots."""
    docs = [(0, "a " * 1_000_000, "big")] + [(1 + i, f"s{i} " * n, f"tiny{i}") for i, n in enumerate([4, 9, 20, 40, 90] * 8)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, source string")
    big = rows.where("doc_id = 0").withColumn("doc_id", F.explode(F.sequence(F.lit(-40).cast("long"), F.lit(-1).cast("long"))))
    got = mixture.taken_words(big.union(rows.where("doc_id > 0"))).where("doc_id > 0").collect()
    assert len(got) == 40
    assert all(0 < r["taken"] <= 3 * r["size"] and abs(r["taken"] - r["target"]) <= 64 for r in got)


def test_whole_documents_come_near_the_targets(spark):
    """Ids that are null, shared or negative, texts that differ under one id, rows that repeat, a source of one very long text."""
    rows = [(None if i % 2 else 7, f"a{i} " * 40, "a") for i in range(40)] + [(-i, f"b{i} " * 40, "b") for i in range(40)]
    rows += [(5, "c " * 13, "c"), (5, "c " * 13, "c"), (None, None, "c"), (9, " \n", None), (9, "z " * 900, None), (9, "z " * 7, None), (1, "long " * 3000, "d"), *[(2, f"d{i} " * 30, "d") for i in range(200)]]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row long, doc_id long, text string, source string")
    times = {r["row"]: r["times"] for r in mixture.read_times(docs, "row").collect()}
    assert len(times) == len(rows) and all(0 <= t <= mixture.EPOCHS for t in times.values())
    sizes = [len((t or "").split()) for _, t, _ in rows]
    assert all(times[i] == 1 for i, n in enumerate(sizes) if not n)
    names = ["a", "b", "c", "d", None]
    of = lambda s: [i for i, r in enumerate(rows) if r[2] == s]
    goal = mixture.targets([sum(sizes[i] for i in of(s)) for s in names], [5, 2, 1, 5, 2])
    for s, g in zip(names, goal, strict=True):
        read = sum(times[i] * sizes[i] for i in of(s))
        worded = sorted(sizes[i] for i in of(s) if sizes[i])
        assert abs(read - g) <= worded[len(worded) // 2] / 2 + mixture.SLOT_WORDS, (s, read, g)


def test_read_times_of_nothing(spark):
    docs = spark.createDataFrame([], "row long, doc_id long, text string, source string")
    assert mixture.read_times(docs, "row").collect() == []
    assert [tuple(r) for r in mixture.read_times(spark.createDataFrame([(3, 1, None, "s")], docs.schema), "row").collect()] == [(3, 1)]
