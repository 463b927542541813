import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from filmcrate.llm import repetition, shards

DOCS = "doc_id long, text string, shard string"


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 4097])
def test_permutation_and_inverse(n):
    p = shards.permute(np.arange(n), n, seed=3)
    assert sorted(p) == list(range(n))
    assert (shards.unpermute(p, n, seed=3) == np.arange(n)).all()
    assert (shards.row_at(p % 16, p // 16, n, 16, seed=3) == np.arange(n)).all()


def test_shards_are_even_gapless_and_repeatable(spark):
    rows = [(i, "x" * (i % 7), "own") for i in range(999)] + [(None, None, "z"), (5, "", "q"), (5, "", "q")]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    out = shards.shard_documents(df, 16).collect()
    assert len(out) == len(rows) and {r["size"] for r in out if r["text"] is None} == {1}
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    key = lambda rs: sorted((r["doc_id"] or -1, r["text"] or "", r["shard"], r["slot"]) for r in rs)
    assert key(out) == key(shards.shard_documents(df.repartition(2), 16).collect())


def test_shards_of_an_empty_table(spark):
    assert shards.shard_documents(spark.createDataFrame([], DOCS)).count() == 0


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    total, ok = max(1, sum(map(len, words))), True
    for n, most in {**repetition.TOP_SHARE, **repetition.DUP_SHARE}.items():
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        count = Counter(grams)
        if n in repetition.TOP_SHARE:
            share = max((c * sum(map(len, g)) for g, c in count.items() if c > 1), default=0) / total
        else:
            share = sum(len(words[j]) for j in {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + n)}) / total
        ok &= min(share, 1) <= most
    dup = [x for i, x in enumerate(lines) if x in lines[:i]]
    ok &= len(dup) / max(1, len(lines)) <= 0.30 and sum(map(len, dup)) / max(1, sum(map(len, lines))) <= 0.20
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(dup), len(hit), failed, not failed and ok)


def test_repetition_equals_brute_force(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = [(-1, None), (-2, ""), (-3, " \n\n\t"), (-4, "añ ß 😀 " * 70 + "\n" + "x y z\n" * 9), (None, "a b c a b c"), (-4, "word " * 30000)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    want = sorted((r[0] if r[0] is not None else -9, *plain(r[1])) for r in df.collect())
    got = sorted((r[0] if r[0] is not None else -9, *r[1:8]) for r in repetition.repetition_rules(df).collect())
    assert got == want
    assert repetition.repetition_rules(df.limit(0)).count() == 0


def test_texts_on_which_polynomial_hashes_collide():
    """Thue-Morse strings and their complements: equal modulo 2**64 whatever the base, as lines, as words and as paragraphs of words."""
    from filmcrate.llm import flat, invertible

    bits = [bin(i).count("1") & 1 for i in range(4096)]
    one, two = ("".join("ab"[b ^ k] for b in bits) for k in (0, 1))
    out = repetition.measure([f"{one}\n{two}", f"{one}\n{one}"])
    assert out["n_dup_lines"].tolist() == [0, 1]
    assert len(set(flat.word_hashes(flat.flatten([f"{one} {two}"])).tolist())) == 2
    kept = [w for w in map(str, range(100)) if int(flat.word_hashes(flat.flatten([w]))[0]) % invertible.CUT][:2]
    digest, doc = invertible.paragraphs([" ".join(kept[b ^ k] for b in bits) for k in (0, 1)])
    assert doc.tolist() == [0, 1] and digest[0] != digest[1]


def _place(x, n, seed=0):
    """A row's place by the definition in Python integers: halves swapped six times, each mixed into the other, until it falls inside."""
    m = (1 << 64) - 1
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    low = (1 << half) - 1
    keys = [(seed * 0x9E3779B97F4A7C15 + (i + 1) * 0xD1B54A32D192ED03) & m for i in range(6)]

    def mixed(v, key):
        v = (v + key) & m
        v = ((v ^ v >> 30) * 0xBF58476D1CE4E5B9) & m
        v = ((v ^ v >> 27) * 0x94D049BB133111EB) & m
        return v ^ v >> 31

    while True:
        left, right = x >> half, x & low
        for key in keys:
            left, right = right, left ^ mixed(right, key) & low
        x = left << half | right
        if x < n:
            return x


def test_op9_equals_the_definition(spark):
    """Every column of the query, recomputed from the table by plain Python."""
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    data = [((r["text"] or "").encode(), r["doc_id"]) for r in rows]
    order = sorted((d is not None, d or 0, zlib.crc32(t), len(t) + 1) for t, d in data)
    want = [(d if there else None, size, crc, "rows", _place(i, len(order)) % 16, _place(i, len(order)) // 16, None) for i, (there, d, crc, size) in enumerate(order)]
    got = shards.op9_feistel_shards(spark, sf).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_rules_with_clashing_columns_and_a_very_long_text(spark):
    rows = spark.createDataFrame([(1, "word " * 300_000), (2, None)], "doc_id long, text string")
    wide = rows.select("*", F.lit("x").alias("Text"), F.lit(5).alias("n_words"), F.lit("y").alias("text"), F.lit(9).alias("kept"))
    assert sorted(tuple(r) for r in repetition.repetition_rules(wide).collect()) == sorted(tuple(r) for r in repetition.repetition_rules(rows).collect())
