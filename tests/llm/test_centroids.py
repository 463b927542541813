import math
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from filmcrate.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k=40, rounds=5, dim=64):
    """(vec_id, vector, cluster, distance) by comparing every vector with every centroid in Python integers."""
    vectors = [(i, [math.floor(256 * float(x)) for x in e]) for i, e in rows if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    name = lambda i: (i is None, sha256(f"2:{i}".encode()).hexdigest())
    at = [v for _, v in sorted(vectors, key=lambda r: (name(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(at))
    for _ in range(rounds):
        mine = [near(v)[1] for _, v in vectors]
        for j in range(len(at)):
            own = [v for (_, v), m in zip(vectors, mine, strict=True) if m == j]
            if own:
                at[j] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    return [(i, v, near(v)[1], near(v)[0]) for i, v in vectors], at


def odd_rows():
    rng = np.random.default_rng(5)
    middle = rng.normal(0, 0.3, (9, 64))
    rows = [(i, [float(np.float32(x)) for x in middle[i % 9] + rng.normal(0, 0.05, 64)], 0) for i in range(150)]
    rows += [(1000 + i, [0.25] * 64, None) for i in range(30)]
    rows += [(7, rows[7][1], 1), (7, rows[8][1], 1), (None, rows[3][1], 1), (None, [0.5] * 64, None)]
    bad = [None, [], [0.1] * 63, [0.1] * 65, [0.1] * 63 + [None], [0.1] * 63 + [float("nan")], [float("inf")] + [0.1] * 63, [float("-inf")] + [0.1] * 63]
    return rows + [(2000 + i, b, None) for i, b in enumerate(bad)]


@pytest.mark.parametrize("k", [1, 6, 40])
def test_equals_comparing_all(spark, k):
    rows = odd_rows()
    got, at = centroids.cluster_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), k)
    want, want_at = plain([(i, e) for i, e, _ in rows], k)
    assert at.tolist() == want_at
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(((r["vec_id"], r["v"], r["cluster"], r["distance"]) for r in got.collect()), key=key) == sorted(want, key=key)


def test_bounds_spare_scans_and_hold(spark):
    rows = spark.createDataFrame(odd_rows(), SCHEMA)
    got, at = centroids.cluster_vectors(rows, 9)
    for r in got.collect():
        far = sorted(((np.array(r["v"]) - c) ** 2).sum() ** 0.5 for c in at)
        assert r["upper"] >= r["distance"] ** 0.5 and r["lower"] <= far[1]
    assert got.where("scanned").count() < got.count() / 2


def test_query_equals_sql(spark, tmp_path):
    spark.createDataFrame(odd_rows(), SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got, want = centroids.op11_hamerly_centroids(spark, str(tmp_path)), con.sql(centroids.op11_sql)
    assert want.columns == got.columns
    assert sorted(want.fetchall(), key=str) == sorted((tuple(r) for r in got.collect()), key=str)


def test_empty_and_clashing_columns(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert centroids.op11_hamerly_centroids(spark, str(tmp_path)).collect() == []
    rows = spark.createDataFrame(odd_rows()[:12], SCHEMA).select("*", F.lit(1).alias("v"), F.lit(2).alias("Embedding"), F.lit(3).alias("cluster"), F.lit(4).alias("vec_id"))
    got, at = centroids.cluster_vectors(rows)
    assert len(at) == 12 and got.where("distance = 0").count() == 12


def test_very_large_components_are_held(spark):
    rows = spark.createDataFrame([(i, [s * 3.0e38] * 32 + [float(i)] * 32, 0) for i, s in enumerate((1, -1, 1, -1))], SCHEMA)
    got, at = centroids.cluster_vectors(rows, 2, 3)
    by = {r["vec_id"]: r["cluster"] for r in got.collect()}
    assert np.abs(at).max() == centroids.WIDEST and by[0] == by[2] != by[1] == by[3]
