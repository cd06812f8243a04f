"""Aggregations over fragments, pairs and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import percentiles_of

HISTOGRAM_EDGES = (0.0, 0.5, 1.0, 2.0, 3.0, 5.0, 10.0)


def fuse_components(d: DataFrame, components: DataFrame) -> DataFrame:
    """Mean position and size of a component per identical timestamp. ``components``: frag_id, component."""
    return d.join(components, "frag_id").groupBy("component", "t").agg(*(F.avg(c).alias(c) for c in ("x", "y", "length", "width")), F.count(F.lit(1)).alias("n"))


def component_scalars(ends: DataFrame, components: DataFrame) -> DataFrame:
    """Scalars of the member that ends first, and the ids of all members."""
    met = ends.join(components, "frag_id")
    first = F.min(F.struct("last_t", "frag_id", "direction", "gt_id"))
    return met.groupBy("component").agg(first.alias("s"), F.array_sort(F.collect_list("frag_id")).alias("merged_ids")).select(
        "component", "s.direction", "s.gt_id", F.col("s.frag_id").alias("kept_frag_id"), "merged_ids"
    )


def combine_path(f: DataFrame, paths: DataFrame) -> DataFrame:
    """One trajectory a path: samples in path order, median size, most frequent direction (ties: the smallest). ``paths``: frag_id, path, pos."""
    met = f.join(paths, "frag_id")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "frag_id", "t", "x", "y", "length", "width")))
    modes = met.groupBy("path", "direction").count().groupBy("path").agg(F.min(F.struct((-F.col("count")).alias("c"), "direction")).alias("m"))
    rows = met.groupBy("path").agg(ordered.alias("s"))
    flat = lambda c: F.flatten(F.col("s").getField(c))
    middle = lambda c: F.expr(f"percentile({c}, 0.5)")
    sizes = met.select("path", F.explode("length").alias("l")).groupBy("path").agg(middle("l").alias("length"))
    widths = met.select("path", F.explode("width").alias("w")).groupBy("path").agg(middle("w").alias("width"))
    out = rows.select("path", F.col("s").getField("frag_id").alias("fragment_ids"), flat("t").alias("t"), flat("x").alias("x"), flat("y").alias("y"))
    return out.join(sizes, "path").join(widths, "path").join(modes.select("path", "m.direction"), "path")


def fragment_summary(d: DataFrame, channels: Sequence[str]) -> DataFrame:
    """mean, std (population), min, max, first and last of each channel."""
    return d.groupBy("frag_id").agg(
        *(f.alias(f"{c}_{n}") for c in channels for n, f in (
            ("mean", F.avg(c)), ("std", F.stddev_pop(c)), ("min", F.min(c)), ("max", F.max(c)), ("first", F.min_by(c, "idx")), ("last", F.max_by(c, "idx"))))
    )


def pair_summary_features(pairs: DataFrame, summary: DataFrame) -> DataFrame:
    """Both fragments' summaries and the endpoint gaps."""
    columns = [c for c in summary.columns if c != "frag_id"]
    a = summary.select(F.col("frag_id").alias("a_frag_id"), *(F.col(c).alias(f"a_{c}") for c in columns))
    b = summary.select(F.col("frag_id").alias("b_frag_id"), *(F.col(c).alias(f"b_{c}") for c in columns))
    met = pairs.select("a_frag_id", "b_frag_id", "gap").join(a, "a_frag_id").join(b, "b_frag_id")
    gaps = {f"gap_{c}": F.col(f"b_{c}_first") - F.col(f"a_{c}_last") for c in ("x", "y", "velocity") if f"{c}_first" in columns}
    return met.withColumns(gaps)


def normalization_stats(d: DataFrame, channels: Sequence[str]) -> DataFrame:
    """One row: mean_c, and std_c plus 1e-6."""
    return d.agg(*(F.avg(c).alias(f"mean_{c}") for c in channels), *((F.stddev_pop(c) + 1e-6).alias(f"std_{c}") for c in channels))


def anchor_meta(rows: DataFrame, min_size: int = 2, max_size: int = 80) -> DataFrame:
    """Per anchor: size, which labels it has; sizes outside the range go."""
    return rows.groupBy("anchor_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.bool_or(F.col("label").isNotNull()), F.lit(False)).alias("has_any_gt"),
        F.coalesce(F.bool_or(F.col("label") == 1), F.lit(False)).alias("has_pos"),
        F.coalesce(F.bool_or(F.col("label") == 0), F.lit(False)).alias("has_neg"),
        F.min("gt_id").alias("gt_id"),
    ).filter(F.col("n").between(min_size, max_size))


def cost_stats(pairs: DataFrame, cost: str = "cost", invalid: float = 1e5) -> DataFrame:
    """One row: count, invalid, min, mean, std, max, and a histogram with fixed edges; below the first edge counts in the first bin."""
    c = F.when(F.col(cost) < invalid, F.col(cost))
    edges = [*HISTOGRAM_EDGES[1:], float("inf")]
    bins, low = [], float("-inf")
    for i, high in enumerate(edges):
        bins.append(F.coalesce(F.sum(((c >= low) & (c < high)).cast("long")), F.lit(0)).alias(f"bin_{i}"))
        low = high
    return pairs.agg(F.count(c).alias("n"), (F.count(F.lit(1)) - F.count(c)).alias("n_invalid"), F.min(c).alias("min"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.max(c).alias("max"), *bins)


def unpivot(x: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(ids, feature, value)."""
    return x.select(*ids, *(F.col(c).cast("double").alias(c) for c in features)).unpivot(list(ids), list(features), "feature", "value")


def feature_audit(x: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """Per feature and class: mean, std, min, quartiles, max, share of zeros."""
    u = unpivot(x, [label], features)
    out = u.groupBy("feature", label).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.avg((F.col("value") == 0).cast("double")).alias("zero_fraction"))
    q = percentiles_of(x, features, (0.25, 0.5, 0.75), [label]).select(F.col("column").alias("_f"), F.col(label).alias("_l"), "q")
    out = out.join(q, (F.col("feature") == F.col("_f")) & F.col(label).eqNullSafe(F.col("_l")), "left")
    return out.select("feature", label, "n", "mean", "std", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max", "zero_fraction")


def benchmark_summary(m: DataFrame, by: str, metric: str = "value") -> DataFrame:
    return m.groupBy(by, "metric").agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"), F.min(metric).alias("min"), F.max(metric).alias("max"))


def best_performer(m: DataFrame, metric: str = "value") -> DataFrame:
    """Per metric the method with the highest mean; ties go to the first name."""
    means = m.groupBy("metric", "method").agg(F.avg(metric).alias("mean"))
    return means.groupBy("metric").agg(F.min(F.struct((-F.round("mean", 9)).alias("s"), "method")).alias("b")).select("metric", F.col("b.method").alias("method"), (-F.col("b.s")).alias("mean"))


def comparison_pivot(m: DataFrame, methods: Sequence[str]) -> DataFrame:
    return m.groupBy("metric").pivot("method", list(methods)).agg(F.avg("value"))


# The most switches and fragments an object has had in each scenario, and elsewhere.
MOST_SWITCHES = {"i": 2.0, "ii": 20.0, "iii": 5.0}
MOST_FRAGMENTS = {"i": 6.0, "ii": 6.0, "iii": 6.0}
OTHER_SWITCHES, OTHER_FRAGMENTS = 5.0, 6.0


def composite_score(hota: Column, mota: Column, idf1: Column, sw: Column, fg: Column, scenario: Column | None = None) -> Column:
    """.40 HOTA + .25 MOTA + .20 IDF1 + .10 (1 - sw) + .05 (1 - fg); switches and fragments are shares of the scenario's maxima, 1 at most."""

    def share(c: Column, most: dict[str, float], other: float) -> Column:
        limit = F.lit(other)
        for name, value in most.items() if scenario is not None else ():
            limit = F.when(scenario == name, value).otherwise(limit)
        return F.least(c / limit, F.lit(1.0))

    return 0.40 * hota + 0.25 * mota + 0.20 * idf1 + 0.10 * (1 - share(sw, MOST_SWITCHES, OTHER_SWITCHES)) + 0.05 * (1 - share(fg, MOST_FRAGMENTS, OTHER_FRAGMENTS))


def mean_quality(hota: Column, idf1: Column) -> Column:
    return (hota + idf1) / 2
