"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: the larger neighbours of ``u`` move to its least neighbour. Small star: the smaller ones and ``u`` do."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    met = both.join(least, "u")
    if large:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``links`` (a, b: comparable ids); the label is the component's least node.

    Self links and repeated links do no harm; isolated nodes are not listed; no
    links give no rows.  Rounds grow with the logarithm of a component's size;
    each is written to the shared folder, and two numbers tell the driver when
    nothing moves any more.
    """
    edges = links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = materialize(edges, "links"), None
    while True:
        after = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if after == before:
            break
        before = after
        edges = materialize(_stars(_stars(edges, True), False), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
