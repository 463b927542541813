import random

import numpy as np
import pytest

import corpus_pipeline as cp
from filmcrate.llm import copies, simhash

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def left(spark, docs):
    rows = [(i, t, "en", "a", len(t)) for i, t in docs]
    return {r["doc_id"] for r in cp.drop_copies(spark, spark.createDataFrame(rows, SHAPE), "").collect()}


def changed(rng, words, n):
    """Words with n neighbouring ones replaced, so that n + 4 shingles change."""
    at = rng.randrange(10, len(words) - 10 - n)
    return [*words[:at], *(f"new{rng.randrange(10**9)}" for _ in range(n)), *words[at + n :]]


@pytest.fixture(scope="module")
def pairs():
    """Pairs of 200 words, without a third document to help, at similarities from 0.6 to 1."""
    rng, out = random.Random(4), []
    for i in range(0, 800, 2):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        out += [(i, " ".join(words)), (i + 1, " ".join(changed(rng, words, rng.randrange(1, 45))))]
    return out


def test_every_pair_from_four_fifths_loses_one(spark, pairs):
    kept, sets = left(spark, pairs), [grams(t) for _, t in pairs]
    near = [i for i in range(0, len(pairs), 2) if jaccard(sets[i], sets[i + 1]) >= 0.8]
    assert len(near) > 100 and any(jaccard(sets[i], sets[i + 1]) < 0.85 for i in near)
    assert [i for i in near if i + 1 in kept or i not in kept] == []


def test_hashes_and_signatures():
    texts = ["One two", "a b c d e f", "a B c d e\tf ", "x", " ".join(f"w{i}" for i in range(900))]
    h, units = copies.shingle_hashes(texts)
    assert units.tolist() == [1, 2, 2, 1, 896] and len(np.unique(h)) == 900
    keys, sign = copies.signature_values(texts)
    assert (keys[1] == keys[2]).all() and (sign[1] == sign[2]).all() and len({*keys[[0, 1, 3, 4]].ravel().tolist()}) == 84
    both = [" ".join(f"w{i}" for i in range(k, k + 1000)) for k in (0, 100)]
    same = np.mean([a == b for x in [copies.signature_values(both)[1].view(np.uint8)] for a, b in zip(x[0], x[1], strict=True)])
    assert abs(same - 0.81) < 0.2


def test_unlike_documents_stay(spark, pairs):
    """Pairs below four fifths, and unrelated texts of six words whose fingerprints lie within 8 bits."""
    rng, docs = random.Random(9), []
    for i in range(0, len(pairs), 2):
        if jaccard(grams(pairs[i][1]), grams(pairs[i + 1][1])) < 0.8:
            docs += pairs[i : i + 2]
    short = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(6)) for _ in range(3000)]
    fp = simhash.fingerprint_values(short, 5)
    met = [(i, i + 1 + int(k)) for i in range(len(fp) - 1) for k in np.flatnonzero(np.bitwise_count((fp[i] ^ fp[i + 1 :]).view(np.uint64)) <= 8)]
    assert met and len(docs) > 100
    docs += [(10_000 + i, short[i]) for i in {x for p in met for x in p}]
    assert left(spark, docs) == {i for i, _ in docs}


def test_repeated_and_missing_identifiers(spark):
    """Texts under one doc_id, or none, are judged each for itself."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    data = [(1, a), (2, a), (2, b), (3, c), (3, c), (3, d), (None, a), (None, "x y z"), (None, "x y z"), (None, None), (None, " ")]
    rows = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in data], SHAPE)
    got = sorted(((r["doc_id"] or 0, r["text"] or "") for r in cp.drop_copies(spark, rows, "").collect()))
    assert got == sorted([(1, a), (2, b), (3, c), (3, d), (0, "x y z"), (0, ""), (0, " ")])


def test_simhash_search_gives_links_that_jaccard_confirms(spark):
    rng = random.Random(8)
    docs = []
    for i in range(0, 60, 2):
        words = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
        docs += [(i, " ".join(words)), (i + 1, " ".join(changed(rng, words, 1)))]
    docs += [(100, "same six words for both here"), (101, "Same six  words for both here"), (102, "other words")]
    found = {tuple(sorted((r["a"], r["b"]))) for r in copies.sketch_links(spark.createDataFrame(docs, "th long, text string")).collect()}
    assert (100, 101) in found and len(found) > 25
    known = dict(docs)
    assert all(jaccard(grams(known[a]), grams(known[b])) >= 0.8 for a, b in found)


def test_simhash_search_of_nothing(spark):
    assert copies.sketch_links(spark.createDataFrame([], "th long, text string")).collect() == []
