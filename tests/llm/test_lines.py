import random
from itertools import combinations

from filmcrate.llm import lines
from tests.llm.test_simhash import groups


def shingles(line):
    raw = line.strip(" ").lower()
    return frozenset(raw[i : i + 9] for i in range(max(len(raw) - 8, 1))) if raw else frozenset()


def plain(rows):
    """Lines that go, by comparing all pairs."""
    at = [(d, i, shingles(x)) for d, t in rows if t is not None for i, x in enumerate(t.split("\n"))]
    at = [(d if d is not None else (1 << 63) - 1, i, s) for d, i, s in at if s]
    sets = sorted({s for *_, s in at}, key=sorted)
    number = {s: k for k, s in enumerate(sets)}
    links = [(a, b) for a, b in combinations(range(len(sets)), 2) if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = groups(range(len(sets)), links)
    least = {}
    for d, i, s in at:
        r = root[number[s]]
        least[r] = min(least.get(r, (d, i)), (d, i))
    return {(d, i, *least[root[number[s]]]) for d, i, s in at if (d, i) != least[root[number[s]]]}


def edit(rng, line, n):
    words = line.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = "".join(rng.choices("abcdefgh", k=6))
    return " ".join(words)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()][:120]
    base = [x for _, t in docs[:30] for x in t.split("\n") if len(x) > 150][:12]
    docs += [(1000 + i, "\n".join([edit(rng, rng.choice(base), rng.randrange(3)), rng.choice(base).upper(), "short", "", "common line of the house"])) for i in range(150)]
    docs += [(-1, None), (-2, ""), (None, base[0]), (5000, "x" * 40000), (5001, "x" * 40001 + "\n" + "é😀" * 20)]
    got = {(r["doc_id"] if r["doc_id"] is not None else (1 << 63) - 1, r["line_no"], r["kept_doc_id"], r["kept_line_no"]) for r in lines.removed_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = plain(docs)
    assert len(got & want) >= 0.98 * len(want | got), (len(got), len(want), list(got ^ want)[:5])
    assert {x[:2] for x in got} <= {x[:2] for x in want}


def test_texts_after_removal(spark):
    rows = [(1, "first line of it all\nanother line here now\n\nab", 7, "k"), (2, "another line here now\nab", 7, "k"), (2, "another line here now\nab", 7, "k"), (3, None, 7, "k"), (4, "", 7, "k"), (None, "First line of it all ", 7, "k")]
    out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, at int, line string"))
    assert out.columns == ["doc_id", "text", "at", "line"]
    got = sorted((r["doc_id"] or 99, r["text"] or "-") for r in out.collect())
    assert got == [(1, rows[0][1]), (2, "-"), (2, "-"), (3, "-"), (4, "-"), (99, "-")]
    assert lines.dedup_lines(out.limit(0)).count() == 0


def test_query_counts(spark):
    out = lines.op10_minhash_lines(spark, "/root/testdata/sf0.001").collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(out) == len(docs)
    assert all(r["n_lines"] == docs[r["doc_id"]].count("\n") + 1 and r["n_removed"] == (r["removed"].count(",") + 1 if r["removed"] else 0) for r in out)


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """Copies that are like each other but not like the hubs, with blocks of four lines: same components as by all pairs."""
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(60)]
    docs = [(i, edit(rng, " ".join(words), rng.randrange(1, 6))) for i in range(80)]
    monkeypatch.setattr(lines, "BLOCK", 1500)
    got = {(r["doc_id"], r["line_no"], r["kept_doc_id"], r["kept_line_no"]) for r in lines.removed_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(got ^ plain(docs)) <= 1


def test_repeats_inside_a_line_do_not_count(spark):
    """Lines with the same shingles, in very different numbers, are found alike."""
    rng, rows = random.Random(21), []
    for k, (size, times) in enumerate([(300, 12), (1000, 10), (60, 20), (300, 5)] * 6):
        unit = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=size))
        rows += [(2 * k, unit + unit[:8]), (2 * k + 1, unit * times + unit[:8])]
        assert shingles(rows[-1][1]) == shingles(rows[-2][1])
    rows += [(100, "=" * 60), (101, "=" * 40000)]
    marks = {r["lh"]: tuple(r[f"k{b}"] for b in range(lines.BANDS)) for r in lines.signatures(lines.line_table(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert len(marks) == len(rows) and all(list(marks.values()).count(k) == 2 for k in marks.values())
    got = {(r["doc_id"], r["line_no"], r["kept_doc_id"], r["kept_line_no"]) for r in lines.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain(rows)


def test_query_on_odd_rows(spark, tmp_path, monkeypatch):
    """The query against brute force: null, negative and repeated identifiers, one id with two texts, empty and long texts, clashing columns."""
    long = "".join(random.Random(5).choices("abcdefghij ", k=200_000)).strip()
    data = [(-5, "x\nsome line of text"), (3, "some line of text"), (None, "some line of text\n\nown line of it"), (7, "first\nfirst\nfirst"), (7, "first\nfirst\nfirst"), (8, "one text here\nlast"), (8, "other text it is\nlast"),
            (9, ""), (10, None), (11, " \t \r\n "), ((1 << 63) - 1, long), (-(1 << 63), "q" + long), (12, long[:-1] + "\nx")]
    rows = spark.createDataFrame([(i, t, "k", 1) for i, t in data], "doc_id long, text string, Text string, line_no int")
    monkeypatch.setattr(lines, "PARTNERS", 1)
    spark.conf.set("spark.sql.caseSensitive", "true")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    rows.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    try:
        out = [tuple(r) for r in lines.op10_minhash_lines(spark, str(tmp_path)).collect()]
        assert lines.op10_minhash_lines(spark, f"{tmp_path}/empty").count() == 0
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")
    th = dict(zip([t for _, t in data], [r[0] for r in spark.createDataFrame([(t,) for _, t in data], "t string").selectExpr("xxhash64(t)").collect()], strict=True))
    order = {(d, t): ((d is None, d or 0), th[t]) for d, t in data if t is not None}
    first, want = {}, []
    for d, t in sorted(set(order), key=order.get):
        for n, x in enumerate(t.split("\n")):
            if key := x.strip().lower().removeprefix("q")[:1000]:  # the two long lines and the third are alike
                first.setdefault(key, (d, n, t))
    for d, t in data:
        gone = [(n, first[k]) for n, x in enumerate((t or "").split("\n")) if t and (k := x.strip().lower().removeprefix("q")[:1000]) and first[k] != (d, n, t)]
        want.append((d, t.count("\n") + 1 if t is not None else 0, len(gone), ",".join(f"{n}:{'' if f[0] is None else f[0]}:{f[1]}" for n, f in gone)))
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(out, key=key) == sorted(want, key=key)
    kept = lines.dedup_lines(rows)
    assert kept.columns == rows.columns and kept.count() == len(data)


def test_costly_arrays_are_made_once(spark):
    """No filter on the size of the lines of a text, or of the shingles of a line, makes these a first time."""
    table = lines.line_table(spark.createDataFrame([(1, "some line of text\nother")], "doc_id long, text string"))
    sets = table.select("lh", lines.shingle_set(table["line"], 9).alias("s"))
    for made in (table, lines.signatures(table), lines.parities(sets)):
        assert "size(" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_query_moves_no_text(spark):
    """The join that adds what was removed has identifiers, hashes and counts on its left side, and no text."""
    plan = lines.op10_minhash_lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().head()
    out = plan.children().head().output()
    assert [out.apply(i).dataType().typeName() for i in range(out.size())] == ["long", "long", "long"]


def test_whole_sets_only_for_lines_that_may_have_a_partner(spark, monkeypatch):
    """Of lines that share buckets, and that no hub joins, those have their sets written that may be like another; no link is lost."""
    rng, held, settle = random.Random(31), {}, lines.common.settle
    words = ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(60)]
    docs = [(i, edit(rng, " ".join(words), 12)) for i in range(120)] + [(500 + i, edit(rng, " ".join(words), 1)) for i in range(6)]

    def counted(df, name, *args, **kwargs):
        out = settle(df, name, *args, **kwargs)
        held[name] = held.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(lines.common, "settle", counted)
    got = {(r["doc_id"], r["line_no"], r["kept_doc_id"], r["kept_line_no"]) for r in lines.removed_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert held["apart"] > 60 and 2 * held["sets"] < held["apart"]
    assert got == plain(docs)


def test_sets_of_a_pair_equal_sets_of_characters(spark):
    """Two lines share as many shingles, whether their bytes are cut or their characters."""
    pairs = [("abcdefghijkl", "abcdefghijkm"), ("abcdefghijkl\u00e9", "abcdefghijkl"), ("\U0001f600" * 12, "\U0001f600" * 11 + "a"), ("ab", "ab"), ("x" * 50, "x" * 40)]
    rows = spark.createDataFrame(pairs, "x string, y string").select("x", "y", *[c.alias(n) for c, n in zip(lines.shingle_sets(lines.F.col("x"), lines.F.col("y"), 9), "st", strict=True)])
    for r in rows.collect():
        a, b = shingles(r["x"]), shingles(r["y"])
        assert (len(r["s"]), len(r["t"]), len(set(r["s"]) & set(r["t"]))) == (len(a), len(b), len(a & b))


def test_no_line_is_copied_for_every_shingle(spark):
    """What is done for each shingle of a pair's lines holds no cast: it would copy the whole line from the row it lies in."""
    rows = spark.createDataFrame([("some line of text", "some line of texts")], "x string, y string")
    x, y = lines.shingle_sets(lines.F.col("x"), lines.F.col("y"), 9)
    assert "substring(cast(" not in rows.select(x, y)._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_fetched_once(spark, monkeypatch):
    """Lines that no hub joins are compared by the texts that were fetched for the hubs' pairs."""
    rng, held, settle = random.Random(31), [], lines.common.settle
    words = ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(60)]
    docs = [(i, edit(rng, " ".join(words), 8)) for i in range(40)]
    monkeypatch.setattr(lines.common, "settle", lambda df, name, *args, **kwargs: held.append(name) or settle(df, name, *args, **kwargs))
    lines.removed_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert "apart" in held and held.count("texts") == 1
