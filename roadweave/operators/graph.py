"""Merge components, paths and greedy chains over fragment graphs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share: ``spark.checkpoint.dir`` of the session or its context.

    A local session (one JVM, as in tests) without one gets a temporary folder; a cluster must name one.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = shared_path(spark, "graph")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_methods(spark: SparkSession) -> None:
    """Let the session run plans step by step where one method for all steps would be over 8,000 bytes, which HotSpot leaves to its interpreter."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


TASK_EDGES = 100_000


def _united(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """u, v: each node of the edges of one task and the least node that it reaches."""
    root: dict = {}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for pdf in batches:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
            root.setdefault(u, u)
            root.setdefault(v, v)
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    if root:
        yield pd.DataFrame({"u": list(root), "v": [find(n) for n in root]})


def connected_components(nodes: DataFrame, edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, component): component is the least node reachable.

    Up to ``task_edges`` edges are united in one task, more by large- and small-star rounds; two numbers reach the driver each round.
    ``edges``: a, b. Isolated nodes are their own component.
    """
    edges = checkpointed(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            break
        if state is None and now[0] <= task_edges:
            edges = edges.coalesce(1).mapInPandas(_united, edges.schema)
            break
        state = now
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower.select("u", "m")).filter("u != v").distinct()
        edges = checkpointed(small)
    return nodes.select("node").distinct().join(edges.select(F.col("u").alias("node"), "v"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))


def with_component(pairs: DataFrame, keys: tuple[str, ...], a: str, b: str, two_sided: bool = True) -> DataFrame:
    """``pairs`` with the component of the graph of ``a`` and ``b`` ids within ``keys``; what happens in one does not bear on another.

    Two-sided: an id as ``a`` and the same as ``b`` are two nodes.
    """
    side = lambda c, s: F.concat_ws("\x1f", F.lit(s), *(F.col(k).cast("string") for k in keys), F.col(c).cast("string"))
    pairs = checkpointed(pairs)
    edges = pairs.select(side(a, "a").alias("a"), side(b, "b" if two_sided else "a").alias("b")).distinct()
    parts = connected_components(edges.select(F.col("a").alias("node")).distinct(), edges).select(F.col("node").alias("_node"), "component")
    return pairs.join(parts, side(a, "a") == F.col("_node")).drop("_node")


def extract_paths(ends: DataFrame, links: DataFrame) -> DataFrame:
    """(path, fragment ids in time order): components of the chosen links; single fragments are paths too."""
    parts = connected_components(ends.select(F.col("frag_id").alias("node")), links.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    met = ends.join(parts, ends["frag_id"] == parts["node"])
    return met.groupBy(F.col("component").alias("path")).agg(F.array_sort(F.collect_list(F.struct("first_t", "frag_id"))).alias("s")).select("path", F.col("s").getField("frag_id").alias("fragment_ids"))


def verify_paths(paths: DataFrame, costs: DataFrame, limit: float = 10.0) -> DataFrame:
    """(path, n, max_cost, ok): a path with any costlier pair is rejected. ``costs``: a_frag_id, b_frag_id, cost."""
    members = paths.select("path", F.explode("fragment_ids").alias("frag_id"))
    a = members.select("path", F.col("frag_id").alias("a_frag_id"))
    b = members.select(F.col("path").alias("b_path"), F.col("frag_id").alias("b_frag_id"))
    inside = costs.join(a, "a_frag_id").join(b, "b_frag_id").filter("path = b_path").groupBy("path").agg(F.max("cost").alias("max_cost"))
    return paths.select("path", F.size("fragment_ids").alias("n")).join(inside, "path", "left").withColumn("ok", F.coalesce(F.col("max_cost") <= limit, F.lit(True)))


def greedy_chains(pairs: DataFrame, threshold: float, keys: tuple[str, ...] = ("scenario", "direction")) -> DataFrame:
    """Chains one after the other: the earliest fragment that is in none starts one, and it is extended by the best
    unused successor above ``threshold`` until there is none.  Equal scores go to the smaller id.

    ``pairs``: keys, src, dst, src_t (start of src), score; dst starts after src.  Order decides only within a
    component of the graph of pairs above ``threshold``, so each is a group.
    """

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["src_t", "src", "score", "dst"], ascending=[True, True, False, True])
        after: dict = {}
        for r in pdf.itertuples():
            after.setdefault(r.src, []).append((r.dst, r.score))
        used, out = set(), []
        for start in after:
            here = start if start not in used else None
            while here is not None:
                used.add(here)
                link = next(((d, s) for d, s in after.get(here, ()) if d not in used), None)
                if link:
                    out.append((here, *link))
                here = link and link[0]
        return pd.DataFrame(out, columns=["src", "dst", "score"])

    parts = with_component(pairs.filter(F.col("score") > threshold), keys, "src", "dst", two_sided=False)
    return parts.groupBy(*keys, "component").applyInPandas(work, "src string, dst string, score double")
