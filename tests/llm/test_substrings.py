import random
import re
from collections import Counter
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from filmcrate.llm import flat, substrings

SCHEMA = "doc_id long, text string"


def brute(rows):
    """The contract by a dictionary of all windows."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for (doc_id, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((doc_id, len(w), len(gone), sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def made_rows(seed):
    rng = random.Random(seed)
    some = lambda n, k: [f"w{rng.randrange(k)}" for _ in range(n)]
    passages = [some(n, 5000) for n in (34, 35, 36, 60, 300)]
    rows = []
    for i in range(60):
        parts = [some(rng.randrange(0, 60), 5000)]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            cut = rng.randrange(len(p) // 2 + 1) if rng.random() < 0.5 else 0
            parts += [p[cut:], some(rng.randrange(0, 40), 5000)]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(x for p in parts for x in p)))
    rows += [(100 + i, " ".join(some(200, 2))) for i in range(4)]  # few different words: branches everywhere
    rows += [(110, "x " * 34), (111, "x " * 35), (112, "x " * 36), (113, "y " * 500), (114, "a b c " * 40), (115, " ".join(some(20, 9) * 6))]
    whole = " ".join(some(90, 5000))
    rows += [(120, whole), (121, whole), (121, whole), (None, whole), (122, whole + " more"), (None, None), (123, None), (124, ""), (125, " \n\t"), (126, "short text"), (127, "short text")]
    rows += [(130, "é😀 " * 3 + " ".join(passages[3])), (131, " ".join(some(50, 9)) + " " + " ".join(passages[2])), (132, "z" * 300 + " " + " ".join(passages[1])), (132, "z" * 300 + " " + " ".join(passages[1]))]
    long = some(60_000, 10**6)
    return rows + [(140, " ".join(long)), (141, " ".join(long[20_000:20_500])), (142, " ".join(long[100:140] + long[150:190]))]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_dictionary_of_windows(spark, seed):
    rows = made_rows(seed)
    got = substrings.without_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_long_repeats_are_few_rows(spark):
    rng = random.Random(3)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(2000))
    rows = [(i, f"{' '.join(f'a{rng.randrange(10**6)}' for _ in range(50))} {passage}") for i in range(5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    spans = substrings.repeated_spans(docs).collect()
    assert len(spans) == 5
    for r in spans:
        covered = {i for a, n in zip(r["at"], r["words"], strict=True) for i in range(a, a + n)}
        assert covered == set(range(50, 2050)) and max(r["words"]) > 1900 and len(r["at"]) < 50


def test_query_equals_sql(spark, tmp_path):
    spark.createDataFrame(made_rows(4)[:-3], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, want = substrings.op12_debruijn_passages(spark, str(tmp_path)), con.sql(substrings.op12_sql)
    assert want.columns == got.columns
    assert sorted(want.fetchall(), key=str) == sorted((tuple(r) for r in got.collect()), key=str)


def test_every_window_holds_a_selected_kmer():
    rng = np.random.default_rng(1)
    for choices in (1, 2, 3, 1000):
        words = flat.mix(rng.integers(1, choices + 1, 4000).astype(np.uint64))
        first, kmer = substrings.selected(words, np.zeros(4000, np.int64))
        assert first[0] <= 16 and np.diff(first).max() <= 17 and first[-1] >= 4000 - 35
        again, same = substrings.selected(words[500:], np.zeros(3500, np.int64))
        held = set(zip((again + 500).tolist(), same.tolist(), strict=True))
        assert held == {(p, k) for p, k in zip(first.tolist(), kmer.tolist(), strict=True) if p >= 500}


def test_chains_of_any_length(spark):
    links = [(f * 1000 + i, f * 1000 + i + 1, 1 + i % 3) for f, n in enumerate((1, 2, 7, 100)) for i in range(n)]
    got = {(r["node"], r["head"], r["words"]) for r in substrings.heads(spark.createDataFrame(links, "a long, b long, step int")).collect()}
    assert got == {(f * 1000 + i, f * 1000, sum(1 + j % 3 for j in range(i))) for f, n in enumerate((1, 2, 7, 100)) for i in range(1, n + 1)}


def test_empty_table_and_clashing_columns(spark):
    assert substrings.without_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = spark.createDataFrame([(1, "q " * 40), (2, "fine")], SCHEMA).select("*", F.lit("x").alias("Text"), F.lit(1).alias("k1"), F.lit(2).alias("at"), F.lit("y").alias("text"))
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.without_repeats(rows).collect())
    assert got == [(1, 40, 40), (2, 1, 0)]
