import zlib
from collections import defaultdict
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from filmcrate.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(text):
    return sha256(text.encode()).hexdigest()


def brute(rows, arity=2):
    """Every row's leaf, subroot, root, siblings and folded root, by plain loops over lists."""

    def leaf(r, more=0):
        n = None if r["n_chars"] is None else r["n_chars"] + more
        return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], n, r["text"])))

    def climb(nodes):
        """Top of a list of digests, and each one's siblings as (left, right) pairs."""
        paths, own = [[] for _ in nodes], [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            runs = [range(i, min(i + arity, len(nodes))) for i in range(0, len(nodes), arity)]
            for run in runs:
                for i in run:
                    pair = "".join(nodes[j] for j in run if j < i), "".join(nodes[j] for j in run if j > i)
                    for k in own[i]:
                        paths[k].append(pair)
            own = [[k for i in run for k in own[i]] for run in runs]
            nodes = [digest("".join(nodes[i] for i in run)) for run in runs]
        return nodes[0], paths

    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {}
    for g in names:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        made[g] = climb([leaf(r) for r in groups[g]])
    root, upper = climb([made[g][0] for g in names]) if names else (None, [])
    out = []
    for g, above in zip(names, upper, strict=True):
        for r, path in zip(groups[g], made[g][1], strict=True):
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            have = leaf(r, int(tampered))
            for left, right in path + above:
                have = digest(left + have + right)
            out.append((r["doc_id"], leaf(r), made[g][0], root, digest("".join(a + b for a, b in path + above)), have, have == root))
    return sorted(out, key=str)


def answered(rows, arity=2):
    got = merkle.manifest(rows, arity)
    folded = merkle.fold(F.col("changed"), F.col("proof"))
    got = got.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")), folded, folded == F.col("root"))
    return sorted((tuple(r) for r in got.collect()), key=str)


def odd_rows():
    rows = [(i, f"text {i} " * (i % 5), ["en", "fr", None, "日本", ""][i % 5], None if i % 4 else "s", None if i % 6 == 0 else i) for i in range(60)]
    return rows + [
        (None, None, None, None, None),
        (None, "x", "en", "s", 3),
        (7, "same", "en", "s", 4),
        (7, "same", "en", "s", 4),
        (7, "other", "en", "s", 4),
        (-5, "", "lone", "", 0),
        (9, "long " * 200_000, "en", "s", (1 << 63) - 1),
        (10, "é:😀", "fr", "-", -3),
    ]


@pytest.mark.parametrize("arity", [2, 3])
def test_equals_plain_loops(spark, arity):
    rows = spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    assert answered(rows, arity) == brute([r.asDict() for r in rows.collect()], arity)


def test_all_of_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([r.asDict() for r in rows.collect()])
    got = sorted((tuple(r) for r in merkle.op13_merkle_manifest(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == want
    assert {v for *_, v in got} == {True, False}


def test_equals_sql(spark, tmp_path):
    spark.createDataFrame(odd_rows(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = merkle.op13_merkle_manifest(spark, str(tmp_path))
    want = con.sql(merkle.op13_sql)
    assert want.columns == got.columns
    assert sorted(want.fetchall(), key=str) == sorted((tuple(r) for r in got.collect()), key=str)


def test_few_rows_and_clashing_columns(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []
    one = spark.createDataFrame([(1, "a", "en", "s", 1)], SCHEMA)
    got = merkle.manifest(one).first()
    assert got["leaf"] == got["subroot"] == got["root"] and got["proof"] == []
    twice = one.select("*", F.lit("B").alias("Text"), F.lit("C").alias("node"), F.lit("D").alias("grp"), F.lit("E").alias("lang"))
    assert merkle.manifest(twice).first() == got


def test_a_lone_last_node_is_hashed_again(spark):
    rows = spark.createDataFrame([(i, str(i), "en", "s", 1) for i in range(3)], SCHEMA)
    leaves = [r["leaf"] for r in merkle.manifest(rows).orderBy("doc_id").collect()]
    assert merkle.manifest(rows).first()["root"] == digest(digest(leaves[0] + leaves[1]) + digest(leaves[2]))
