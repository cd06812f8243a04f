"""Centroid clustering by the threshold algorithm (operator 12).

Vectors become integers, ``floor(scale * x)``.  In each dimension the centroids
are sorted; a vector walks outward from its own value in all dimensions at
once, nearer side first.  A centroid met for the first time gets its exact
squared distance.  One that no dimension has met is at least as far as the sum
of the squared frontier distances, so the walk stops once that sum strictly
exceeds the best exact distance (strictly, as an equal one might have a smaller
number).

A round is one pass: tasks send a sum and a count per cluster and dimension, and
Spark adds them up, so ``k`` times the number of dimensions rows reach the driver; means are exact
integer floors.  The centroids are all that is shipped to tasks; they don't grow
with the data.  Nothing is shuffled by vector, so copies of one vector are no hot key.

Cases: vectors that are null, of another length, or hold nulls, non-finite
numbers or one of ``LIMIT`` or more (whose squared distances would not fit a long)
take no part and are not returned; with fewer than ``k`` vectors there are as
many centroids; equal starting centroids leave the later ones empty, which stay
where they are; repeated ids are separate rows, and equal hashes start in the
order of the vectors; a null id never comes before another as start; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import materialize, read

DIMENSIONS = 64
CENTROIDS = 8
ROUNDS = 10
SCALE = 1024
SEED = 3
LIMIT = 2.0**17
CHUNK = 2048
_FAR = np.int64(1) << np.int64(40)


class SortedCentroids:
    """Centroids (integers, k x d) with a sorted list of their values in each dimension."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = np.ascontiguousarray(centroids, dtype=np.int64)
        self.order = np.argsort(self.centroids, axis=0, kind="stable")
        self.values = np.take_along_axis(self.centroids, self.order, axis=0)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of the nearest centroid of each row (ties: smaller number), and how many distances were computed."""
        (m, d), k = x.shape, len(self.centroids)
        dims = np.arange(d)
        above = np.stack([np.searchsorted(self.values[:, j], x[:, j]) for j in range(d)], axis=1) if m else np.zeros((0, d), dtype=np.int64)
        below = above - 1
        best, which = np.full(m, np.iinfo(np.int64).max), np.zeros(m, dtype=np.int64)
        seen = np.zeros((m, k), dtype=bool)
        live, computed = np.arange(m), 0
        while len(live):
            here = x[live]
            down = np.where(below >= 0, here - self.values[np.maximum(below, 0), dims], _FAR)
            up = np.where(above < k, self.values[np.minimum(above, k - 1), dims] - here, _FAR)
            lower = down <= up
            frontier = np.where(lower, down, up)
            met = self.order[np.where(lower, below, above), dims]
            new = np.zeros((len(live), k), dtype=bool)
            new[np.arange(len(live))[:, None], met] = True
            new &= ~seen
            seen |= new
            rows, cols = np.nonzero(new)
            computed += len(rows)
            exact = np.full((len(live), k), np.iinfo(np.int64).max)
            exact[rows, cols] = np.square(here[rows] - self.centroids[cols]).sum(axis=1)
            first = exact.argmin(axis=1)  # the smaller number on a tie
            least = exact[np.arange(len(live)), first]
            better = (least < best[live]) | ((least == best[live]) & (first < which[live]))
            best[live[better]], which[live[better]] = least[better], first[better]
            goes_on = (np.square(frontier).sum(axis=1) <= best[live]) & ~seen.all(axis=1)
            below, above = (below - lower)[goes_on], (above + ~lower)[goes_on]
            live, seen = live[goes_on], seen[goes_on]
        return which, best, computed


def quantised(vectors: DataFrame, key: str, vector: str, dimensions: int, scale: int) -> DataFrame:
    """(id, v): vectors that take part, as arrays of integers."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LIMIT))
    kept = vectors.filter((F.size(v) == dimensions) & fine)
    return kept.select(F.col(key).alias("id"), F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x).cast("int")).alias("v"))


def _chunks(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, CHUNK):
            part = batch.slice(i, CHUNK)
            flat = part.column(part.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False)
            yield part, flat.astype(np.int64).reshape(-1, dimensions)


def cluster_sums(table: DataFrame, centroids: np.ndarray) -> list:
    """Rows cluster, dim, total, n: sums of the vectors nearest to each centroid that has any."""
    k, d = centroids.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total, n = SortedCentroids(centroids), np.zeros((k, d), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for _, x in _chunks(batches, d):
            which, _, _ = index.nearest(x)
            n += np.bincount(which, minlength=k)
            for c in np.unique(which):
                total[c] += x[which == c].sum(axis=0)
        cs, ds = np.nonzero(np.repeat((n > 0)[:, None], d, axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(cs, pa.int32()), pa.array(ds, pa.int32()), pa.array(total[cs, ds]), pa.array(n[cs])], ["cluster", "dim", "total", "n"])

    found = table.mapInArrow(work, "cluster int, dim int, total bigint, n bigint").groupBy("cluster", "dim")
    return found.agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()


def assigned(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, cluster, distance of every vector of ``table``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = SortedCentroids(centroids)
        for part, x in _chunks(batches, centroids.shape[1]):
            which, distance, _ = index.nearest(x)
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("id")), pa.array(which, pa.int32()), pa.array(distance)], ["id", "cluster", "distance"])

    return table.mapInArrow(work, T.StructType([table.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]))


def cluster(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS,
    k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED,
) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    table = materialize(quantised(vectors, key, vector, dimensions, scale), "quantised")
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    starts = table.select(named.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    if not starts:
        schema = T.StructType([T.StructField(key, table.schema["id"].dataType), T.StructField("cluster", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("distance", "cluster_inertia", "inertia")), T.StructField("centroid_sha256", T.StringType())])
        return spark.createDataFrame([], schema)
    centroids = np.array([r["v"] for r in starts], dtype=np.int64)
    for _ in range(rounds):
        moved = centroids.copy()
        for r in cluster_sums(table, centroids):
            moved[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
        if np.array_equal(moved, centroids):
            break  # all further rounds would be the same
        centroids = moved
    out = materialize(assigned(table, centroids), "clusters")
    inertia = {r["cluster"]: int(r["s"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    about = [(c, s, sum(inertia.values()), digest(c)) for c, s in inertia.items()]
    table_of = spark.createDataFrame(about, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")  # k rows
    return out.join(F.broadcast(table_of), "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(read(spark, sf_dir, "embeddings"))


def oracle_sql() -> str:
    """Every distance of every round, by brute force."""
    near = """{name} AS MATERIALIZED (
  SELECT rid, v, arg_min(c.n, (c.d, c.n)) AS cluster, min(c.d) AS distance
  FROM (SELECT x.rid, x.v, struct_pack(n := {was}.n, d := list_sum(list_transform(list_zip(x.v, {was}.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT) AS c FROM kept x, {was})
  GROUP BY rid, v)"""
    move = """{name} AS MATERIALIZED (
  SELECT {was}.n, coalesce(m.c, {was}.c) AS c FROM {was} LEFT JOIN (
    SELECT cluster, list(mean ORDER BY j) AS c FROM (
      SELECT cluster, j, (sum(x)::HUGEINT - ((sum(x)::HUGEINT % count(*) + count(*)) % count(*))) // count(*) AS mean
      FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM {near}) GROUP BY cluster, j) GROUP BY cluster) m ON m.cluster = {was}.n)"""
    steps = []
    for r in range(ROUNDS):
        steps += [near.format(name=f"a{r}", was=f"c{r}"), move.format(name=f"c{r + 1}", was=f"c{r}", near=f"a{r}")]
    steps.append(near.format(name="final", was=f"c{ROUNDS}"))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM (SELECT * FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: isfinite(x))) = {DIMENSIONS})),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS n, v AS c FROM (SELECT sha256('{SEED}:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT {CENTROIDS})),
{", ".join(steps)}
SELECT vec_id, final.cluster::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY final.cluster))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{ROUNDS}.c, ',')) AS centroid_sha256
FROM final JOIN kept USING (rid) JOIN c{ROUNDS} ON c{ROUNDS}.n = final.cluster"""
