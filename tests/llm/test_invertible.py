import hashlib
from collections import Counter

import numpy as np

from filmcrate.llm import invertible


def test_differences_equal_set_difference():
    rng = np.random.default_rng(1)
    sets = [(set(rng.integers(1, 1 << 60, n).tolist()), d) for n, d in ((0, 0), (1, 0), (5, 5), (300, 40), (2000, 1999))]
    a, b = [], []
    for base, d in sets:
        a.append(base)
        b.append(set(sorted(base)[d:]) | set(rng.integers(1 << 61, 1 << 62, d).tolist()))
    flat = lambda xs: (np.array([x for s in xs for x in s], dtype=np.uint64), np.array([i for i, s in enumerate(xs) for _ in s], dtype=np.int64))
    made = []
    for digest, owner in (flat(a), flat(b)):
        words = invertible._words(digest)
        made.append({int(i): t.pick(np.array([k])) for mine, t, _, _ in invertible.sketches(words, owner, len(sets)) for k, i in enumerate(mine)})
    short = lambda xs: {int(w) for w in invertible._words(np.array(sorted(xs), dtype=np.uint64))}
    for i in range(len(sets)):
        x, y = made[0][i], made[1][i]
        assert invertible.differing(x, y).tolist() == [len(a[i] ^ b[i])]
        for table, held in ((x, a[i]), (y, b[i])):  # every table can be peeled alone
            _, word, sign, whole = invertible.Sketch.read(table.written(0)).peel()
            assert whole.all() and set(map(int, word)) == short(held) and len(word) == len(held) and (sign == 1).all()
    wide = max(made[0][3].width, made[1][3].width)
    _, word, sign, whole = made[0][3].folded(wide).minus(made[1][3].folded(wide)).peel()
    assert whole.all() and {(int(w), int(s)) for w, s in zip(word, sign, strict=True)} == {(w, 1) for w in short(a[3] - b[3])} | {(w, -1) for w in short(b[3] - a[3])}


def plain(a, b):
    bags = [Counter(map(int, invertible.paragraphs([t])[0])) for t in (a, b)]
    either = len(bags[0] | bags[1])
    return len(bags[0] & bags[1]) / either if either else 1.0


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = [(-1, None), (-2, ""), (-3, "ab"), (-4, "same line\n" * 40), (-5, "same line\n" * 40), (-7, "word " * 30000), (10**12, "é😀 ß\nx")]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    rows = sorted(((r[0], r[1] or "") for r in docs.collect()), reverse=True)
    got = {r["doc_id"]: r for r in invertible.edit_likeness(docs).collect()}
    assert len(got) == len(rows)
    prints = {r["doc_id"]: r["fingerprint"] for r in invertible.fingerprints(docs).collect()}
    for (i, text), (j, after) in zip(rows, [*rows[1:], rows[0]], strict=True):
        cut, r = len(text) // 3, got[i]
        edit = text[: len(text) - cut] + after[:cut]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edit.encode()).hexdigest()
        assert abs(r["near_edited"] - plain(text, edit)) < 1e-12 and abs(r["near_next"] - plain(text, after)) < 1e-12
        assert r["fingerprint"] == prints[i]
        # what is said of likeness follows from the strings alone
        x, y, z = map(invertible.Sketch.read, (r["fingerprint"], r["edited_fingerprint"], prints[j]))
        assert (invertible.likeness(x, y)[0], invertible.likeness(x, z)[0]) == (r["near_edited"], r["near_next"])
    assert got[-4]["fingerprint"] == got[-5]["fingerprint"]
    near = [r for r in got.values() if r["n_chars"] > 300]
    assert np.mean([r["near_edited"] > r["near_next"] for r in near]) > 0.95


def test_small_tables(spark):
    shape = "doc_id long, text string, bucket int, follower boolean"
    assert invertible.edit_likeness(spark.createDataFrame([], shape)).count() == 0
    (r,) = invertible.edit_likeness(spark.createDataFrame([(1, "abc def", 1, True)], shape)).collect()
    assert r["near_next"] == 1.0
    rows = invertible.edit_likeness(spark.createDataFrame([(None, "a", 1, True), (None, None, 2, False), (3, "x y", 1, True), (3, "x y", 1, True)], shape)).collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in rows) == [(0, 0), (0, 1), (3, 3), (3, 3)]
