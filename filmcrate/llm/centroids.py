"""Exact integer k-means whose vectors carry distance bounds from round to round (Hamerly).

Every vector keeps an upper bound of the distance to its centroid and one lower bound of the
distance to any other. When centroids move, the bounds are loosened by how far they went;
only where the bounds no longer tell does a vector measure its own centroid anew, and only
if that does not settle it, all of them, in integers. A round is one pass over the written
table of vectors and bounds, and one aggregation to at most K rows of sums. The centroids
(K times DIM integers) are all that the driver and every task hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DIM, K, ROUNDS, SCALE = 64, 40, 5, 256
#: Integers are held at this distance from 0 at most, so that squared distances fit into a long.
WIDEST = 1 << 27
#: Up to this size all sums of products are whole doubles.
_EXACT = 1 << 22
#: Bounds are moved apart by this share, far more than what doubles round off.
_SLACK = 1e-9
STATE = "vec_id long, v array<int>, cluster int, distance long, upper double, lower double, scanned boolean"


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of c, exactly (both int64, at most WIDEST)."""
    widest = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    kind = np.float64 if widest <= _EXACT else np.int64
    a, b = x.astype(kind), c.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)


@dataclass(frozen=True)
class Centroids:
    """Centroids and, after a move, how far each went."""

    at: np.ndarray
    drift: np.ndarray

    @staticmethod
    def first(at: np.ndarray) -> Centroids:
        return Centroids(at, np.zeros(len(at)))

    def moved(self, to: np.ndarray) -> Centroids:
        gone = ((self.at - to).astype(np.float64) ** 2).sum(1)
        return Centroids(to, np.sqrt(gone) * (1 + _SLACK))

    def half_gaps(self) -> np.ndarray:
        """Half the distance from each centroid to the nearest other one: nearer vectors are its own."""
        between = np.sqrt(squared(self.at, self.at).astype(np.float64))
        np.fill_diagonal(between, np.inf)
        return between.min(1) / 2 * (1 - _SLACK)

    def others_drift(self) -> np.ndarray:
        """For each centroid the farthest that any other went."""
        if len(self.drift) == 1:
            return np.zeros(1)
        order = np.argsort(self.drift)
        out = np.full(len(self.drift), self.drift[order[-1]])
        out[order[-1]] = self.drift[order[-2]]
        return out


def assign(x: np.ndarray, centroids: Centroids, cluster: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid of each vector (of equally near ones the first), new bounds, and which vectors were compared with all centroids.

    Without a cluster and bounds every vector is compared with all.
    """
    n, gaps = len(x), centroids.half_gaps()
    if cluster is None:
        cluster, upper, lower, open_ = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.arange(n)
    else:
        upper = (upper + centroids.drift[cluster]) * (1 + _SLACK)
        lower = np.maximum(lower - centroids.others_drift()[cluster], 0) * (1 - _SLACK)
        sure = np.maximum(lower, gaps[cluster])
        open_ = np.flatnonzero(upper >= sure)
        own = ((x[open_] - centroids.at[cluster[open_]]) ** 2).sum(1)
        upper[open_] = np.sqrt(own.astype(np.float64)) * (1 + _SLACK)
        open_ = open_[upper[open_] >= sure[open_]]
    if len(open_):
        far = squared(x[open_], centroids.at)
        rows, best = np.arange(len(open_)), far.argmin(1)
        cluster[open_] = best
        upper[open_] = np.sqrt(far[rows, best].astype(np.float64)) * (1 + _SLACK)
        others = far.astype(np.float64)
        others[rows, best] = np.inf
        lower[open_] = np.sqrt(others.min(1)) * (1 - _SLACK)
    scanned = np.zeros(n, bool)
    scanned[open_] = True
    return cluster, upper, lower, scanned


def integer_vectors(rows: DataFrame, dim: int = DIM) -> DataFrame:
    """vec_id and v of the vectors that have exactly ``dim`` components, all of them finite numbers."""
    rows = common.pick(rows, "vec_id", "embedding").withColumn("e", F.col("embedding").cast("array<double>"))
    finite = F.forall("e", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    whole = F.transform("e", lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x * SCALE, F.lit(1e9)), F.lit(-1e9))), F.lit(WIDEST)), F.lit(-WIDEST)).cast("int"))
    return rows.where((F.size("e") == dim) & finite).select("vec_id", whole.alias("v"))


def _pass(table: DataFrame, centroids: Centroids, dim: int) -> DataFrame:
    """One assignment of all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)
            told = "cluster" in batch.schema.names
            before = [batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("cluster", "upper", "lower")] if told else [None] * 3
            cluster, upper, lower, scanned = assign(x, centroids, *before)
            distance = ((x - centroids.at[cluster]) ** 2).sum(1)
            made = [pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(upper), pa.array(lower), pa.array(scanned)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), *made], names=["vec_id", "v", "cluster", "distance", "upper", "lower", "scanned"])

    return table.mapInArrow(run, STATE)


def _means(state: DataFrame, before: np.ndarray, dim: int) -> np.ndarray:
    """Floor of the mean of each cluster's vectors; a cluster without any keeps its centroid."""
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(dim)])
    after = before.copy()
    for row in sums.collect():
        after[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(dim)]
    return after


def cluster_vectors(rows: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM) -> tuple[DataFrame, np.ndarray]:
    """STATE of every kept vector after ``rounds`` rounds and a last assignment, and the centroids then.

    Kept are vectors of exactly ``dim`` components without nulls, NaN and infinities; their
    components become floor(SCALE * x), held at WIDEST on either side of 0. The first
    centroids are the k vectors whose sha256 of ``2:<vec_id>`` is smallest; a null vec_id
    comes last, vectors that share one in the order of their components. With fewer vectors
    there are fewer centroids, without any the result is empty. Repeated rows are vectors of
    their own. Other columns, clashing names included, are not read.
    """
    spark = rows.sparkSession
    paths = [common.scratch(spark, "vectors")]
    integer_vectors(rows, dim).write.parquet(paths[0])
    table = spark.read.parquet(paths[0])
    named = table.select(F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    first = named.orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    centroids = Centroids.first(np.array([r["v"] for r in first], dtype=np.int64).reshape(-1, dim))
    for turn in range(rounds + 1):
        paths.append(common.scratch(spark, "bounds"))
        _pass(table, centroids, dim).write.parquet(paths[-1])
        table = spark.read.schema(STATE).parquet(paths[-1])
        common.delete(spark, paths[-2])
        if turn < rounds:
            centroids = centroids.moved(_means(table, centroids.at, dim))
    return table, centroids.at


def op11_hamerly_centroids(spark, sf_dir: str) -> DataFrame:
    """Cluster, squared distance, inertias and digest of the centroid of every kept vector of ``embeddings``; see ``cluster_vectors`` for nulls, ties and empty tables."""
    state, at = cluster_vectors(common.read(spark, sf_dir, "embeddings"))
    sums = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    facts = [(c, s, sum(sums.values()), sha256(",".join(map(str, at[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    facts = spark.createDataFrame(facts, "c int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(facts), F.col("cluster") == F.col("c")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql_round(r: int) -> str:
    """Assignment to the centroids c{r}, and the centroids after it."""
    return f"""a{r} AS MATERIALIZED (
  SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': d, 'c': c}}) AS best FROM (
    SELECT x.rid, x.vec_id, x.v, c.c, list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x, c{r} c) GROUP BY rid),
n{r} AS (SELECT c, list((s - (s % n + n) % n) // n ORDER BY i)::BIGINT[] AS v FROM (SELECT best.c AS c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY ALL) GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(n.v, c.v) AS v FROM c{r} c LEFT JOIN n{r} n ON n.c = c.c)"""


_SQL_ROUNDS = ",\n".join(_sql_round(r) for r in range(ROUNDS + 1))
#: Every vector is compared with every centroid in each round.
op11_sql = f"""
WITH x AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: greatest(least(floor(greatest(least(x::DOUBLE * 256, 1e9), -1e9)), {WIDEST}), -{WIDEST})::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x::DOUBLE), false)))),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR) NULLS LAST, v) - 1 AS c, v FROM x QUALIFY c < 40),
{_SQL_ROUNDS},
f AS (SELECT best.c AS c, sum(best.d)::BIGINT AS s FROM a{ROUNDS} GROUP BY ALL)
SELECT a.vec_id, a.best.c::INTEGER AS cluster, a.best.d AS distance, f.s AS cluster_inertia, (SELECT sum(s)::BIGINT FROM f) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN f ON f.c = a.best.c JOIN c{ROUNDS} c ON c.c = a.best.c
"""
