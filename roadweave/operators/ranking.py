"""Window, top-k and set operations on candidate rows (anchor_id, candidate_id, cost, label, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import unit_hash


def last_observation(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def next_fragment(ends: DataFrame) -> DataFrame:
    w = Window.partitionBy("gt_id").orderBy("first_t", "frag_id")
    return ends.select("frag_id", "gt_id", F.lead("frag_id").over(w).alias("next_frag_id"), (F.lead("first_t").over(w) - F.col("last_t")).alias("gap"))


def top_candidate(rows: DataFrame, cost: str = "cost") -> DataFrame:
    """Cheapest candidate of each anchor, the smaller id on ties: a combined aggregate, no window."""
    return rows.groupBy("anchor_id").agg(F.min(F.struct(cost, "candidate_id")).alias("m")).select("anchor_id", "m.candidate_id", F.col(f"m.{cost}").alias("cost"))


def cap_group(rows: DataFrame, k: int, mode: str = "positives_first", seed: int = 0) -> DataFrame:
    """At most ``k`` rows an anchor: positives first and the rest in hash order, the k cheapest, or (one_of_each) one
    positive and one negative where there are both, then any, all in hash order."""
    u = unit_hash("anchor_id", "candidate_id", seed=seed)
    if mode == "one_of_each":
        by_label = Window.partitionBy("anchor_id", "label").orderBy(u, "candidate_id")
        both = F.min("label").over(Window.partitionBy("anchor_id")) != F.max("label").over(Window.partitionBy("anchor_id"))
        lead = F.coalesce(both & F.col("label").isNotNull() & (F.row_number().over(by_label) == 1), F.lit(False))
        rows, order = rows.withColumn("_lead", lead), [F.desc("_lead"), u, F.col("candidate_id")]
    elif mode == "positives_first":
        order = [F.desc(F.coalesce(F.col("label") == 1, F.lit(False))), u, F.col("candidate_id")]
    else:
        order = [F.col("cost"), F.col("candidate_id")]
    w = Window.partitionBy("anchor_id").orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).drop("rn", "_lead")


def middle_slice(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Positions n // 4 up to max(n // 4 + 1, 3 n // 4) of a group in rising order."""
    w = Window.partitionBy(group).orderBy(order, "candidate_id")
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    lo = F.floor(n / 4)
    hi = F.greatest(lo + 1, F.floor(3 * n / 4))
    ranked = rows.withColumns({"rn": F.row_number().over(w) - 1, "lo": lo, "hi": hi})
    return ranked.filter((F.col("rn") >= F.col("lo")) & (F.col("rn") < F.col("hi"))).drop("rn", "lo", "hi")


def semi_hard_negatives(rows: DataFrame, margin: float, k: int, seed: int = 0) -> DataFrame:
    """Per anchor negatives of its first tier that has any, compared with the cheapest positive.

    Tier 0: less than margin + 0.3 above it, the ``k`` nearest; tier 1: not above it, the ``k`` cheapest;
    tier 2: one of the others in hash order.
    """
    by_anchor = Window.partitionBy("anchor_id")
    n = rows.withColumn("pos", F.min(F.when(F.col("label") == 1, F.col("cost"))).over(by_anchor)).filter((F.col("label") == 0) & F.col("pos").isNotNull())
    d = F.col("cost") - F.col("pos")
    n = n.withColumn("tier", F.when((d > 0) & (d < margin + 0.3), 0).when(d <= 0, 1).otherwise(2))
    place = F.when(F.col("tier") < 2, d).otherwise(unit_hash("anchor_id", "candidate_id", seed=seed))
    w = Window.partitionBy("anchor_id").orderBy("tier", place, "candidate_id")
    ranked = n.withColumns({"first": F.min("tier").over(by_anchor), "rn": F.row_number().over(w)})
    most = F.when(F.col("tier") < 2, F.lit(k)).otherwise(1)
    return ranked.filter((F.col("tier") == F.col("first")) & (F.col("rn") <= most)).drop("rn", "pos", "first")


def rank_correlation(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Per anchor the Pearson correlation of ordinal ranks (ties by id); null counts as 0."""
    wx, wy = (Window.partitionBy("anchor_id").orderBy(c, "candidate_id") for c in (x, y))
    ranked = rows.select("anchor_id", F.row_number().over(wx).cast("double").alias("rx"), F.row_number().over(wy).cast("double").alias("ry"))
    return ranked.groupBy("anchor_id").agg(F.coalesce(F.corr("rx", "ry"), F.lit(0.0)).alias("rho"), F.count(F.lit(1)).alias("n"))


def curvature(d: DataFrame) -> DataFrame:
    """Mean and deviation of |dx ddy - dy ddx| / ((dx^2 + dy^2)^1.5 + 1e-6), by central differences, one-sided at the ends."""
    w = Window.partitionBy("frag_id").orderBy("idx")

    def gradient(c: str):
        before, after = F.lag(c).over(w), F.lead(c).over(w)
        return F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), after - F.col(c)).when(after.isNull(), F.col(c) - before).otherwise((after - before) / 2)

    g = d.select("frag_id", "idx", gradient("x").alias("dx"), gradient("y").alias("dy"))
    g = g.select("frag_id", "idx", "dx", "dy", gradient("dx").alias("ddx"), gradient("dy").alias("ddy"))
    k = F.abs(F.col("dx") * F.col("ddy") - F.col("dy") * F.col("ddx")) / (F.pow(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"), 1.5) + 1e-6)
    return g.groupBy("frag_id").agg(F.avg(k).alias("curvature_mean"), F.stddev_pop(k).alias("curvature_std"))


def switches(matches: DataFrame, keys: Sequence[str], match: str = "match_id", order: str = "frame") -> DataFrame:
    """How often an object's match changes along its frames, unmatched frames skipped."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.last(match, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    changed = (F.col(match).isNotNull() & before.isNotNull() & (F.col(match) != before)).cast("int")
    return matches.withColumn("changed", changed).groupBy(*keys).agg(F.sum("changed").alias("switches"))


def top_n(rows: DataFrame, n: int, by: str, tie: str) -> DataFrame:
    return rows.orderBy(F.desc(by), tie).limit(n)


def error_examples(rows: DataFrame, anchors: DataFrame, limit: int = 100) -> DataFrame:
    """Rows of the listed anchors, the first ``limit`` by (anchor, candidate)."""
    return rows.join(anchors.select("anchor_id").distinct(), "anchor_id", "left_semi").orderBy("anchor_id", "candidate_id").limit(limit)


def stack(a: DataFrame, b: DataFrame, tag: str = "source_tag") -> DataFrame:
    """Both tables, after their schemas are found equal, with a provenance column."""
    if sorted(a.dtypes) != sorted(b.dtypes):
        raise ValueError("tables with different columns can't be stacked")
    return a.withColumn(tag, F.lit("a")).unionByName(b.withColumn(tag, F.lit("b")))


def not_selected(rows: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    return rows.join(selected.select(key), key, "left_anti")


def set_jaccard(selected: DataFrame) -> DataFrame:
    """Similarity of the feature sets of each pair of scenarios. ``selected``: scenario, feature."""
    a = selected.select(F.col("scenario").alias("a"), "feature").distinct()
    sizes = a.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    b = a.withColumnRenamed("a", "b")
    both = a.join(b, "feature").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    names = sizes.join(sizes.select(F.col("a").alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b"))
    met = names.join(both, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    return met.select("a", "b", (F.col("shared") / (F.col("n") + F.col("nb") - F.col("shared"))).alias("jaccard"))


def canonical_pairs(pairs: DataFrame, a: str = "a_frag_id", b: str = "b_frag_id") -> DataFrame:
    return pairs.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).distinct()


def anchor_outcomes(rows: DataFrame, methods: dict[str, str], min_candidates: int = 2) -> DataFrame:
    """Per eligible anchor (enough labelled candidates, both labels) whether each method's cheapest is positive."""
    known = rows.filter("label is not null")
    best = [F.min(F.struct(F.col(c).alias("c"), "candidate_id", "label")).alias(f"best_{m}") for m, c in methods.items()]
    per = known.groupBy("anchor_id").agg(F.count(F.lit(1)).alias("n"), F.max("label").alias("hi"), F.min("label").alias("lo"), F.min(F.when(F.col("label") == 1, F.col("gap"))).alias("min_positive_gap"), *best)
    return per.filter((F.col("n") >= min_candidates) & (F.col("hi") == 1) & (F.col("lo") == 0)).select(
        "anchor_id", "n", "min_positive_gap", *((F.col(f"best_{m}.label") == 1).alias(f"{m}_correct") for m in methods)
    )


def anchor_metrics(outcomes: DataFrame, base: str, other: str, *by: str) -> DataFrame:
    """Error rates, relative lift, recovery of the baseline's errors and regression of its hits."""
    b, o = F.col(f"{base}_correct"), F.col(f"{other}_correct")
    rate = lambda c: F.avg(c.cast("double"))
    out = outcomes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), rate(~b).alias("base_error"), rate(~o).alias("other_error"),
        F.coalesce(F.sum((~b & o).cast("int")) / F.nullif(F.sum((~b).cast("int")), F.lit(0)), F.lit(0.0)).alias("recovery"),
        F.coalesce(F.sum((b & ~o).cast("int")) / F.nullif(F.sum(b.cast("int")), F.lit(0)), F.lit(0.0)).alias("regression"))
    return out.withColumn("lift", F.coalesce((F.col("base_error") - F.col("other_error")) / F.nullif(F.col("base_error"), F.lit(0.0)), F.lit(0.0)))


def gap_bucket(gap):
    return F.when((gap >= 0) & (gap < 2), "0-2").when((gap >= 2) & (gap < 5), "2-5").when((gap >= 5) & (gap < 15), "5-15").otherwise("other")


def size_bucket(n):
    return F.when(n == 2, "2").when(n.between(3, 4), "3-4").otherwise("5+")


def sliced_metrics(outcomes: DataFrame, base: str, other: str) -> DataFrame:
    """Anchor metrics by gap and by number of candidates; empty buckets are kept with n = 0."""
    spark = outcomes.sparkSession
    kinds = [("gap", b) for b in ("0-2", "2-5", "5-15", "other")] + [("candidates", b) for b in ("2", "3-4", "5+")]
    all_buckets = spark.createDataFrame(kinds, "slice string, bucket string")
    both = outcomes.withColumn("k", F.explode(F.array(F.struct(F.lit("gap").alias("slice"), gap_bucket(F.col("min_positive_gap")).alias("bucket")), F.struct(F.lit("candidates").alias("slice"), size_bucket(F.col("n")).alias("bucket")))))
    found = anchor_metrics(both.select("*", "k.slice", "k.bucket"), base, other, "slice", "bucket")
    return F.broadcast(all_buckets).join(found, ["slice", "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def ranking_gate(rows: DataFrame, score: str = "cost", other: str = "base", min_candidates: int = 2) -> DataFrame:
    """One row: cross-class pairwise accuracy, top-1 accuracy, mean rank correlation of the two costs, and the decision.

    An anchor counts with ``min_candidates`` labelled candidates, both labels and finite costs. Pairwise accuracy
    counts, for each positive, the negatives that cost strictly more. Sorted counts, no pair join.
    """
    labelled = rows.filter("label is not null")
    finite = lambda c: F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False)) & ~F.isnan(c)
    seen = labelled.groupBy("anchor_id").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(finite(score) & finite(other)).alias("finite"))
    known = labelled.join(seen.filter((F.col("n") >= min_candidates) & (F.col("lo") == 0) & (F.col("hi") == 1) & F.col("finite")).select("anchor_id"), "anchor_id", "left_semi")
    per_cost = known.groupBy("anchor_id", score).agg(F.sum(F.col("label")).alias("p"), F.sum(1 - F.col("label")).alias("q"))
    w = Window.partitionBy("anchor_id").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    wins = per_cost.withColumn("above", F.coalesce(F.sum("q").over(w), F.lit(0)))
    per_anchor = wins.groupBy("anchor_id").agg(F.sum(F.col("p") * F.col("above")).alias("won"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    top = known.groupBy("anchor_id").agg(F.min(F.struct(score, "candidate_id", "label")).alias("b")).select("anchor_id", (F.col("b.label") == 1).cast("double").alias("top1"))
    rho = rank_correlation(known, score, other).select("anchor_id", "rho")
    none = lambda c: F.coalesce(c, F.lit(0.0))
    out = per_anchor.join(top, "anchor_id").join(rho, "anchor_id").agg(
        F.count(F.lit(1)).alias("anchors"), none(F.sum("won") / F.sum(F.col("p") * F.col("q"))).alias("pairwise"), none(F.avg("top1")).alias("top1"), none(F.avg("rho")).alias("spearman"))
    return out.withColumn("passed", (F.col("pairwise") >= 0.95) & (F.col("top1") >= 0.85) & (F.col("spearman") >= 0.55))


def audit_decision(metrics: DataFrame) -> DataFrame:
    good = (F.col("recovery") >= 0.15) & (F.col("regression") <= 0.05) & (F.col("other_error") <= F.col("base_error")) & (F.col("n") > 0)
    return metrics.withColumn("decision", F.when(good, "continue").otherwise("pivot"))


def selection_score(row: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted mean of the metrics that are not null."""
    have = lambda c: F.when(F.col(c).isNotNull(), F.lit(weights[c])).otherwise(0.0)
    num = sum((F.coalesce(F.col(c), F.lit(0.0)) * weights[c] for c in weights), F.lit(0.0))
    den = sum((have(c) for c in weights), F.lit(0.0))
    return row.withColumn("selection_score", F.when(den > 0, num / den))


def candidate_log(pairs: DataFrame, invalid: float = 1e5) -> DataFrame:
    """(candidate, anchor, cost, gap, label): label 1 for one vehicle, 0 for two, null where a vehicle is unknown."""
    same = F.when(F.col("a_gt_id").isNull() | F.col("b_gt_id").isNull(), None).when(F.col("a_gt_id") == F.col("b_gt_id"), 1).otherwise(0)
    return pairs.filter(F.col("cost") < invalid).select(F.col("a_frag_id").alias("candidate_id"), F.col("b_frag_id").alias("anchor_id"), "cost", "gap", same.cast("int").alias("label"))
