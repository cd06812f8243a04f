"""Approximate nearest neighbours with balanced posting lists (operator 4).

Equal vectors are first collapsed: of each distinct vector the ``k + 1`` smallest
ids are kept, which loses no answer because the others tie with them and have
larger ids.  Centroids come from a bounded, documented sample by a k-means whose
assignment is penalised by list length.  Every distinct vector goes to the list
of its nearest centroid and, near a boundary, to further lists (at most
``replicas``) whose centroid is almost as near.  Centroids are found by a
best-first walk over an in-memory neighbour graph.  A query visits lists in
order of distance while the ratio to the nearest one stays below ``prune``.

How many lists a query visits is chosen in the job: at most ``TRIAL_QUERIES``
queries, taken by a hash, are answered by brute force over the whole table, and the
number of lists grows from ``probes`` until the lists visited hold ``RECALL`` of
their true neighbours (all lists and no pruning at the latest, which is exact).

The centroids (at most ``MAX_CENTROIDS``) are the only thing shipped to all
tasks.  Lists longer than ``block_rows`` are dealt into blocks by a hash, and the
queries of a block likewise, so no group grows with the data.  Queries are looked
up per distinct vector too.

Score: cosine in double precision on the original vectors, summed for each pair
in the same order, so equal vectors tie exactly; ties go to the smaller id.

Cases: vectors that are null, of norm zero, or hold nulls or non-finite numbers
take no part, as query or candidate, and neither do those of another length than
most vectors have (the larger length on a tie); with fewer than k candidates all are
returned; repeated ids with different vectors are separate rows; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import materialize, read

SAMPLE_ROWS = 20_000
LIST_ROWS = 400
MAX_CENTROIDS = 4096
REPLICAS = 4
CLOSURE = 1.15
PROBES = 24
PRUNE = 1.6
DEGREE = 24
BEAM = 48
TRIAL_QUERIES = 256
RECALL = 0.97


def balanced_centroids(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k-means on unit vectors; crowded lists repel, so that lists get about the same length."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), size=k, replace=False)].copy()
    penalty = np.zeros(k)
    for _ in range(rounds):
        nearest = np.concatenate(
            [np.argmax(part @ centroids.T - penalty, axis=1) for part in np.array_split(sample, max(1, len(sample) // 2048))]
        )
        counts = np.bincount(nearest, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centroids)
        penalty += 0.02 * (counts / (len(sample) / k) - 1)
        penalty = np.clip(penalty - penalty.mean(), -0.1, 0.1)
    return centroids


class CentroidGraph:
    """Neighbour graph over centroids; a batch of vectors walks it best first."""

    def __init__(self, centroids: np.ndarray, degree: int = DEGREE):
        self.centroids = centroids
        k = len(centroids)
        degree = min(degree, k - 1)
        near = np.empty((k, max(degree, 1)), dtype=np.int64)
        rng = np.random.default_rng(3)
        for part in np.array_split(np.arange(k), max(1, k // 512)):
            sims = centroids[part] @ centroids.T
            sims[np.arange(len(part)), part] = -np.inf
            near[part] = np.argsort(-sims, axis=1)[:, : max(degree, 1)] if k > 1 else 0
        if k > 4 * degree > 0:  # a few far links keep the graph connected
            near[:, -3:] = rng.integers(0, k, size=(k, 3))
        self.near = near
        self.entries = np.unique(np.linspace(0, k - 1, min(k, 2 * DEGREE)).astype(np.int64))

    def search(self, x: np.ndarray, n: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of about the ``n`` nearest centroids of each row, nearest first."""
        k = len(self.centroids)
        n, beam = min(n, k), min(max(beam, n), k)
        if 4 * beam >= k:  # so wide a walk meets about all of them
            sims = x @ self.centroids.T
            ids = np.argsort(-sims, axis=1, kind="stable")[:, :n]
            return ids, np.take_along_axis(sims, ids, axis=1)
        seen = np.zeros((len(x), k), dtype=bool)
        ids = np.repeat(self.entries[None, :], len(x), axis=0)
        sims = x @ self.centroids[self.entries].T
        seen[:, self.entries] = True
        done = np.zeros_like(ids, dtype=bool)
        rows = np.arange(len(x))[:, None]
        while True:
            order = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
            ids, sims, done = ids[rows, order], sims[rows, order], done[rows, order]
            open_sims = np.where(done, -np.inf, sims)
            best = np.argsort(-open_sims, axis=1, kind="stable")[:, :4]
            live = np.isfinite(open_sims[rows, best])
            if not live.any():
                break
            done[rows, best] = True
            new = self.near[ids[rows, best]].reshape(len(x), -1)
            fresh = ~seen[rows, new] & np.repeat(live, self.near.shape[1], axis=1)
            seen[rows, new] = seen[rows, new] | fresh
            found = np.where(fresh, np.einsum("ijk,ik->ij", self.centroids[new], x), -np.inf)
            sorted_new = np.sort(np.where(fresh, new, -1), axis=1)  # one link may be met twice in a step
            if (sorted_new[:, 1:] == sorted_new[:, :-1])[sorted_new[:, 1:] >= 0].any():
                for r in range(len(x)):
                    _, first = np.unique(new[r], return_index=True)
                    again = np.ones(new.shape[1], dtype=bool)
                    again[first] = False
                    found[r, again] = -np.inf
            ids = np.concatenate([ids, new], axis=1)
            sims = np.concatenate([sims, found], axis=1)
            done = np.concatenate([done, ~np.isfinite(found)], axis=1)
        return ids[:, :n], sims[:, :n]


def _distances(sims: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * sims))


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): rows that take part, v as doubles."""
    v = F.col(vector)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    good_rows = vectors.filter(v.isNotNull() & good).filter(norm > 0).select(F.col(key).alias("id"), v.cast("array<double>").alias("v"))
    length = good_rows.groupBy(F.size("v").alias("n")).count().agg(F.max(F.struct("count", "n")).alias("most")).first()["most"]
    return good_rows.filter(F.size("v") == length["n"]) if length else good_rows


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _within(sims: np.ndarray, ratio: float) -> np.ndarray:
    d = _distances(sims)
    return np.isfinite(sims) & (d <= np.maximum(ratio * d[:, :1], 1e-6))


def _spread(table: DataFrame, graph: CentroidGraph, width: int, ratio: float, name: str) -> DataFrame:
    """``table`` (with v) once for each list within ``ratio`` of the nearest: column ``list``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("v")
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                ids, sims = graph.search(_unit(_matrix(part.column(at))), width, max(BEAM, 2 * width))
                rows, cols = np.nonzero(_within(sims, ratio))
                made = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*made.columns, pa.array(ids[rows, cols], pa.int32())], [*made.schema.names, name])

    return table.mapInArrow(work, T.StructType([*table.schema.fields, T.StructField(name, T.IntegerType())]))


def true_neighbours(distinct: DataFrame, asked: np.ndarray, own: np.ndarray, k: int) -> DataFrame:
    """q, vid: the ``k`` nearest of all ``distinct`` vectors to each row of ``asked`` (unit vectors, few), without its own vid."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sims, vids = np.full((len(asked), k), -np.inf), np.full((len(asked), k), -1)
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                vid = part.column(part.schema.get_field_index("vid")).to_numpy()
                new = asked @ _unit(_matrix(part.column(part.schema.get_field_index("v")))).T
                new[own[:, None] == vid[None, :]] = -np.inf
                sims = np.concatenate([sims, new], axis=1)
                vids = np.concatenate([vids, np.broadcast_to(vid, new.shape)], axis=1)
                best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                sims, vids = np.take_along_axis(sims, best, axis=1), np.take_along_axis(vids, best, axis=1)
        rows, cols = np.nonzero(np.isfinite(sims))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(vids[rows, cols], pa.int64()), pa.array(sims[rows, cols])], ["q", "vid", "s"])

    found = distinct.select("vid", "v").mapInArrow(work, "q int, vid bigint, s double")
    order = Window.partitionBy("q").orderBy(F.desc("s"), "vid")
    return found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).select("q", "vid")


def chosen_probes(distinct: DataFrame, posted: DataFrame, query_vectors: DataFrame, graph: CentroidGraph, k: int, probes: int, prune: float) -> tuple[int, float, float]:
    """(probes, prune, recall): the fewest lists, from ``probes`` on, that hold ``RECALL`` of the true neighbours of the trial queries."""
    lists = len(graph.centroids)
    trial = query_vectors.orderBy(F.xxhash64("v", F.lit(11))).limit(TRIAL_QUERIES).join(distinct.select("vid", "v"), "v").select("vid", "v").toArrow()
    if not trial.num_rows:
        return probes, prune, 1.0
    asked = _unit(_matrix(trial.column("v").combine_chunks()))
    truth = true_neighbours(distinct, asked, trial.column("vid").to_numpy(), k)
    held = posted.select("vid", "list").join(F.broadcast(truth), "vid").groupBy("q", "vid").agg(F.collect_set("list").alias("lists")).collect()
    if not held:
        return probes, prune, 1.0
    width = min(probes, lists)
    while True:
        ids, sims = graph.search(asked, width, max(BEAM, 2 * width))
        for ratio in (prune, float("inf")):
            keep = _within(sims, ratio)
            visited = [set(i[w].tolist()) for i, w in zip(ids, keep, strict=True)]
            recall = sum(not visited[r["q"]].isdisjoint(r["lists"]) for r in held) / len(held)
            if recall >= RECALL:
                return width, ratio, recall
        if width == lists:
            return width, float("inf"), recall
        width = min(lists, -(-width * 5 // 4))


def nearest(
    vectors: DataFrame,
    is_query,
    k: int,
    key: str = "vec_id",
    vector: str = "embedding",
    probes: int = PROBES,
    prune: float = PRUNE,
    sample_rows: int = SAMPLE_ROWS,
    list_rows: int = LIST_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest other rows of each row for which ``is_query`` (a Column on ``id``) holds."""
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector)
    by_vector = Window.partitionBy("v").orderBy("id")
    ranked = rows.withColumn("n", F.row_number().over(by_vector)).filter(F.col("n") <= k + 1)
    distinct = materialize(ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("vid", F.monotonically_increasing_id()), "vectors")
    queries = materialize(rows.filter(is_query).select("id", "v"), "queries")
    query_vectors = queries.select("v").distinct().withColumn("qid", F.monotonically_increasing_id())
    query_vectors = materialize(query_vectors, "query-vectors")
    count = distinct.count()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if count == 0:
        return empty
    sample = distinct.select("v").orderBy(F.xxhash64("v")).limit(sample_rows).toArrow().column("v").combine_chunks()
    points = _unit(_matrix(sample))
    lists = int(min(MAX_CENTROIDS, max(1, count // list_rows), max(1, len(points) // 4)))
    graph = CentroidGraph(balanced_centroids(points, lists))

    posted = materialize(_spread(distinct.select("vid", "ids", "v"), graph, REPLICAS, CLOSURE, "list"), "lists")
    probes, prune, _ = chosen_probes(distinct, posted, query_vectors, graph, k, probes, prune)
    sent = _spread(query_vectors, graph, probes, prune, "list")
    sizes = {r["list"]: r["count"] for r in posted.groupBy("list").count().collect()}  # at most MAX_CENTROIDS rows
    asked = materialize(sent, "probes")
    wanted = {r["list"]: r["count"] for r in asked.groupBy("list").count().collect()}
    blocks = spark.createDataFrame(
        [(i, -(-sizes[i] // (4 * list_rows)), -(-wanted.get(i, 1) // (4 * list_rows))) for i in sizes], "list int, vb bigint, qb bigint"
    )
    deal = lambda column, n: F.pmod(F.xxhash64(column), F.col(n))
    left = posted.join(F.broadcast(blocks), "list").select(
        "list", deal("vid", "vb").alias("b"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("qb") - 1)).alias("c"), "vid", "ids", "v"
    )
    right = asked.join(F.broadcast(blocks), "list").select(
        "list", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("vb") - 1)).alias("b"), deal("qid", "qb").alias("c"), "qid", "v"
    )

    def search(_key, held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(held) and len(asked):
            x = np.stack(held["v"].to_numpy()).astype(np.float64)
            norms = np.sqrt((x * x).sum(axis=1))
            unit = x / norms[:, None]
            first, vids = held["ids"].to_numpy(), held["vid"].to_numpy()
            q = np.stack(asked["v"].to_numpy()).astype(np.float64)
            sims = _unit(q) @ unit.T
            top = min(k + 1, len(x))
            floor = np.partition(sims, len(x) - top, axis=1)[:, len(x) - top] - 1e-9
            for i, qid in enumerate(asked["qid"].to_numpy()):
                found = np.flatnonzero(sims[i] >= floor[i])
                near, a = np.ascontiguousarray(x[found]), q[i]
                exact = (near * a).sum(axis=1) / (norms[found] * np.sqrt((a * a).sum()))
                named = [(qid, vids[j], int(v), s) for j, s in zip(found, exact, strict=True) for v in first[j]]
                named.sort(key=lambda r: (-r[3], r[2]))
                out += named[: k + 1]
        return pd.DataFrame(out, columns=["qid", "vid", "vec_id", "score"]).astype({"qid": "int64", "vid": "int64", "vec_id": "int64", "score": "float64"})

    found = left.groupBy("list", "b", "c").cogroup(right.groupBy("list", "b", "c")).applyInPandas(search, "qid bigint, vid bigint, vec_id bigint, score double")
    order = [F.desc("score"), F.asc("vec_id")]
    best = found.dropDuplicates(["qid", "vid", "vec_id"]).withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
    best = best.filter(F.col("n") <= k + 1).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("best"))
    named = materialize(query_vectors.join(best, "qid").select("v", "best"), "found")
    others = F.slice(F.filter("best", lambda r: r["vec_id"] != F.col("id")), 1, k)
    return queries.join(named, "v").select(F.col("id").alias("query_id"), F.posexplode(others).alias("n", "r")).select(
        "query_id", (F.col("n") + 1).cast("int").alias("rank"), F.col("r.vec_id").alias("vec_id"), (-F.col("r.s")).alias("score")
    )


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)
