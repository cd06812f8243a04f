"""Training-data building from fragments: masks, augmentation, negatives, balanced and stratified samples.

Every sample is ordered by a hash of values, so it is the same for any partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip, mean, unit_hash, unit_normal
from .costs import hardness_score
from .joins import binned_neighbors
from .prefix import percentiles, percentiles_of

# Corridor centres, camera boundaries (ft).
CENTRES = (225.0, 625.0, 1125.0, 1625.0)
BOUNDARIES = tuple(float(x) for x in range(-200, 1801, 400))


def mask_split(f: DataFrame, width: Column | float = 250.0, centres: Sequence[float] = CENTRES, min_points: int = 10, max_dy: float = 5.0) -> DataFrame:
    """Each track cut at fixed centres: samples before and after the masked stretch, in travel direction, as a positive pair."""
    masked = f.withColumn("m", F.explode(F.array(*[F.struct(F.lit(i).alias("mask_idx"), F.lit(c).alias("centre")) for i, c in enumerate(centres)])))
    half = (F.lit(width) if not isinstance(width, Column) else width) / 2
    s = F.arrays_zip(F.col("t"), F.col("x"), F.col("y"))
    low = F.filter(s, lambda v: v["x"] < F.col("m.centre") - half)
    high = F.filter(s, lambda v: v["x"] > F.col("m.centre") + half)
    east = F.col("direction") == 1
    p = masked.withColumns({"before": F.when(east, low).otherwise(high), "after": F.when(east, high).otherwise(low)})
    p = p.filter((F.size("before") >= min_points) & (F.size("after") >= min_points))
    b_end, a_start = F.element_at("before", -1), F.element_at("after", 1)
    dy = F.abs(mean(F.col("before").getField("y")) - mean(F.col("after").getField("y")))
    return p.filter((b_end["t"] < a_start["t"]) & (dy <= max_dy)).select(
        "frag_id", "gt_id", "direction", "m.mask_idx", F.size("before").alias("n_before"), F.size("after").alias("n_after"), (a_start["t"] - b_end["t"]).alias("gap"), dy.alias("dy"), "before", "after")


def camera_masks(d: DataFrame, duration: float, boundaries: Sequence[float] = BOUNDARIES, near: float = 50.0, min_side: int = 15) -> DataFrame:
    """For each boundary the nearest sample within ``near``; the samples of ``duration`` around it are the mask; both sides keep ``min_side``."""
    b = d.withColumn("boundary", F.explode(F.lit(list(boundaries)))).withColumn("far", F.abs(F.col("x") - F.col("boundary"))).filter(F.col("far") <= near)
    centre = b.groupBy("frag_id", "boundary").agg(F.min(F.struct("far", "idx", "t")).alias("c")).select("frag_id", "boundary", "c.t")
    met = d.join(centre.withColumnRenamed("t", "centre_t"), "frag_id")
    lo, hi = F.col("centre_t") - duration / 2, F.col("centre_t") + duration / 2
    g = met.groupBy("frag_id", "boundary").agg(F.sum((F.col("t") < lo).cast("int")).alias("n_before"), F.sum(F.col("t").between(lo, hi).cast("int")).alias("gap_points"), F.sum((F.col("t") > hi).cast("int")).alias("n_after"))
    return g.filter((F.col("n_before") >= min_side) & (F.col("n_after") >= min_side))


def curriculum(rows: DataFrame, lo: float, hi: float, levels: int, jitter: float = 0.0, seed: int = 0) -> DataFrame:
    """Rows times levels with a mask duration that grows linearly, times U(1 - jitter, 1 + jitter)."""
    step = (hi - lo) / max(1, levels - 1)
    out = rows.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    u = 1 - jitter + 2 * jitter * unit_hash(rows.columns[0], "level", seed=seed) if jitter else F.lit(1.0)
    return out.withColumn("duration", (lo + F.col("level") * step) * u)


def random_masks(f: DataFrame, per: int, lo: float, hi: float, seed: int = 0) -> DataFrame:
    """``per`` masks a trajectory: start and duration from hashes."""
    m = f.select("frag_id", "first_t", "last_t", F.explode(F.sequence(F.lit(0), F.lit(per - 1))).alias("mask_idx"))
    length = lo + (hi - lo) * unit_hash("frag_id", "mask_idx", seed=seed)
    start = F.col("first_t") + F.greatest(F.lit(0.0), F.col("last_t") - F.col("first_t") - length) * unit_hash("frag_id", "mask_idx", seed=seed + 1)
    return m.select("frag_id", "mask_idx", start.alias("mask_start"), (start + length).alias("mask_end"))


# Standard deviations of the detection noise, and the mean and deviation of the confidence; channels whose values are 1.0 at least.
NOISE = {"x": 1.5, "y": 0.5, "length": 0.8, "width": 0.15, "height": 0.3}
VELOCITY_NOISE, CONFIDENCE = 4.0, (0.92, 0.11)
SIZES = ("length", "width", "height")
# Standard deviations of the correlated noise, and the share of its running sums.
CORRELATED = {"velocity": 2.0, "y": 0.5, "t": 0.02, "x": 1.0}
RUNNING = 0.1


def _normal(channel: str, seed: int) -> Column:
    """One number per sample and channel, whatever the partitioning."""
    return unit_normal("frag_id", "idx", F.lit(channel), seed=seed)


def detection_noise(d: DataFrame, seed: int = 0) -> DataFrame:
    """Independent noise on every sample (frag_id, idx, t, x, ...), sizes of 1.0 at least, confidence anew within .1 and 1.

    Velocity becomes the difference of the noisy positions to the next sample over its time (the last repeats the one before; 0 for a single
    sample; equal times count as 1e-6), with noise.  Heights, sizes and confidences are touched where there are some.
    """
    have = [c for c in NOISE if c in d.columns]
    moved = {c: F.col(c) + NOISE[c] * _normal(c, seed) for c in have}
    out = d.withColumns({c: F.greatest(v, F.lit(1.0)) if c in SIZES else v for c, v in moved.items()})
    w = Window.partitionBy("frag_id").orderBy("idx")
    step = F.lead("t").over(w) - F.col("t")
    ahead = (F.lead("x").over(w) - F.col("x")) / F.when(step == 0, 1e-6).otherwise(step)
    out = out.withColumn("_v", ahead).withColumn("_v", F.coalesce("_v", F.lag("_v").over(w), F.lit(0.0)))
    if "conf" in d.columns:
        out = out.withColumn("conf", clip(CONFIDENCE[0] + CONFIDENCE[1] * _normal("conf", seed), 0.1, 1.0))
    return out.withColumn("velocity", F.col("_v") + VELOCITY_NOISE * _normal("velocity", seed)).drop("_v")


def correlated_noise(d: DataFrame, seed: int = 0) -> DataFrame:
    """One y offset a fragment with a tenth as much per sample; time and x drift by a tenth of the running sums of steps; velocity by itself.

    A sample is never before the one before it.
    """
    w = Window.partitionBy("frag_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    drift = lambda c: RUNNING * F.sum(CORRELATED[c] * _normal(c, seed)).over(w)
    offset = CORRELATED["y"] * (unit_normal("frag_id", F.lit("y"), seed=seed) + RUNNING * _normal("y", seed))
    out = d.withColumns({"y": F.col("y") + offset, "x": F.col("x") + drift("x"), "t": F.col("t") + drift("t")}).withColumn("t", F.max("t").over(w))
    return out.withColumn("velocity", F.col("velocity") + CORRELATED["velocity"] * _normal("velocity", seed)) if "velocity" in d.columns else out


def point_dropout(d: DataFrame, rate: float = 0.05, min_keep: int = 10, seed: int = 0) -> DataFrame:
    """Samples whose hash is below ``rate`` go, but never the ends, and never below ``min_keep``."""
    w = Window.partitionBy("frag_id")
    u = unit_hash("frag_id", "idx", seed=seed)
    marked = d.withColumns({"_n": F.count(F.lit(1)).over(w), "_last": F.max("idx").over(w), "_u": u})
    inner = (F.col("idx") > 0) & (F.col("idx") < F.col("_last"))
    marked = marked.withColumn("_rank", F.row_number().over(w.orderBy(F.when(inner, F.col("_u")).otherwise(2.0), "idx")))
    drop = inner & (F.col("_u") < rate) & (F.col("_rank") <= F.col("_n") - min_keep)
    return marked.filter(~drop).drop("_n", "_last", "_u", "_rank")


def upscale(pairs: DataFrame, copies: int, tag: str, key: str = "pair_id") -> DataFrame:
    """Copies of each pair with their own id and provenance."""
    c = pairs.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return c.withColumns({key: F.concat_ws("_", key, F.concat(F.lit("c"), F.col("copy"))), "source_split_tag": F.lit(tag)})


def balance_classes(rows: DataFrame, key: str, label: str = "label", seed: int = 0) -> DataFrame:
    """The larger class cut to the smaller one's size in hash order. The cut is found from counts of hash ranges, not by a sort in one task."""
    counts = rows.groupBy(label).count()
    least = counts.agg(F.min("count").alias("_k"))
    ranked = rank_in_ranges(rows.withColumn("_u", unit_hash(key, seed=seed)), [label], "_u", [key])
    return ranked.crossJoin(F.broadcast(least)).filter(F.col("rn") <= F.col("_k")).drop("_u", "rn", "_k")


def rank_in_ranges(rows: DataFrame, keys: Sequence[str], u: str, tie: Sequence[str], ranges: int = 256) -> DataFrame:
    """Row numbers by ``u`` (in [0, 1)) per key, without a task per key: rank inside ranges of u plus the counts before."""
    r = rows.withColumn("_r", F.floor(F.col(u) * ranges).cast("int"))
    counts = r.groupBy(*keys, "_r").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*keys, "_r", before.alias("_before"))
    w = Window.partitionBy(*keys, "_r").orderBy(u, *tie)
    return r.withColumn("_in", F.row_number().over(w)).join(offsets, [*keys, "_r"]).withColumn("rn", F.col("_in") + F.col("_before")).drop("_r", "_in", "_before")


def hard_negatives(ends: DataFrame, n: int, dt: float, dx: float, max_gap: float, least: float = 0.5) -> DataFrame:
    """The ``n`` hardest sequential pairs of different vehicles in neighbouring bins. ``ends`` has velocity and mean_length."""
    met = binned_neighbors(ends, dt, dx, (0, 3), 3).select("a_frag_id", "b_frag_id").distinct()
    a = ends.select(*(F.col(c).alias(f"a_{c}") for c in ends.columns))
    b = ends.select(*(F.col(c).alias(f"b_{c}") for c in ends.columns))
    p = met.join(a, "a_frag_id").join(b, "b_frag_id").withColumn("gap", F.col("b_first_t") - F.col("a_last_t"))
    p = hardness_score(p.filter((F.col("a_gt_id") != F.col("b_gt_id")) & (F.col("gap") > 0) & (F.col("gap") <= max_gap)))
    return p.filter(F.col("hardness") >= least).orderBy(F.desc(F.round("hardness", 9)), "a_frag_id", "b_frag_id").limit(n).select("a_frag_id", "b_frag_id", "gap", "hardness")


def triplets(positives: DataFrame, negatives: DataFrame, per: int = 3, seed: int = 0) -> DataFrame:
    """(anchor, positive, negative): per pair, ``per`` negatives of the anchor in hash order. positives: anchor, positive; negatives: anchor, negative."""
    w = Window.partitionBy("anchor", "positive").orderBy(unit_hash("anchor", "positive", "negative", seed=seed), "negative")
    return positives.join(negatives, "anchor").filter("positive != negative").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= per).drop("rn")


def nearest_negatives(positives: DataFrame, negatives: DataFrame, vectors: DataFrame, metric: str = "cosine") -> DataFrame:
    """(anchor, positive, negative, distance): per pair the anchor's negative that is nearest to it in embedding space.

    positives: anchor, positive; negatives: anchor, negative; vectors: id, v (array of numbers). ``metric``: cosine or l2.
    Ties go to the smaller negative; ids without a vector, and zero vectors under cosine, take no part.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError(metric)
    a = vectors.select(F.col("id").alias("anchor"), F.col("v").cast("array<double>").alias("a"))
    b = vectors.select(F.col("id").alias("negative"), F.col("v").cast("array<double>").alias("b"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: i * j), F.lit(0.0), lambda s, i: s + i)
    if metric == "cosine":
        distance = 1 - dot("a", "b") / F.nullif(F.sqrt(dot("a", "a") * dot("b", "b")), F.lit(0.0))
    else:
        distance = F.sqrt(F.aggregate(F.zip_with("a", "b", lambda i, j: (i - j) * (i - j)), F.lit(0.0), lambda s, i: s + i))
    met = negatives.select("anchor", "negative").distinct().join(a, "anchor").join(b, "negative").select("anchor", "negative", distance.alias("distance"))
    pairs = positives.select("anchor", "positive").distinct().join(met.filter("distance is not null"), "anchor").filter("positive != negative")
    best = pairs.groupBy("anchor", "positive").agg(F.min_by("negative", F.struct("distance", "negative")).alias("negative"), F.min("distance").alias("distance"))
    return best.select("anchor", "positive", "negative", "distance")


def largest_remainder(total: int, shares: Sequence[float]) -> list[int]:
    raw = [total * s for s in shares]
    out = [int(x) for x in raw]
    for i in sorted(range(len(raw)), key=lambda i: (-(raw[i] - out[i]), i))[: total - sum(out)]:
        out[i] += 1
    return out


def gap_stratified(pairs: DataFrame, total: int, edges: Sequence[float] = (5.0, 10.0, 15.0), shares: Sequence[float] = (0.40, 0.35, 0.25), seed: int = 0) -> DataFrame:
    """``total`` pairs with quotas by gap bin (right-closed); shortfalls are filled from what is left, in hash order."""
    quotas = largest_remainder(total, shares)
    low, bin_ = 0.0, F.lit(None).cast("int")
    for i, high in enumerate(edges):
        bin_ = F.when((F.col("gap") > low) & (F.col("gap") <= high), i).otherwise(bin_)
        low = high
    # no bin gives more than its first ``total`` in hash order; each task keeps as many, so nothing else is sorted or shuffled
    order = ["_u", "a_frag_id", "b_frag_id"]
    firsts = [pairs.withColumn("bin", bin_).filter(F.col("bin") == i).withColumn("_u", unit_hash("a_frag_id", "b_frag_id", seed=seed)).orderBy(*order).limit(total) for i in range(len(edges))]
    ranked = reduce(DataFrame.unionAll, firsts).withColumn("rn", F.row_number().over(Window.partitionBy("bin").orderBy(*order)))
    quota = F.element_at(F.lit(quotas), F.col("bin") + 1)
    first = ranked.withColumn("in_quota", F.col("rn") <= quota)
    # quota rows come first, then the rest in hash order, up to the total
    return first.orderBy(F.desc("in_quota"), "_u", "a_frag_id", "b_frag_id").limit(total).drop("_u", "rn", "in_quota")


def hardness_buckets(rows: DataFrame, difficulty: str = "difficulty", wrong: str = "misclassified", label: str = "label", hard: float = 0.25, medium: float = 0.60) -> DataFrame:
    """hard: the class's most difficult quarter and what the model got wrong; medium: up to 60 %; easy: the rest."""
    q = percentiles(rows, difficulty, (1 - medium, 1 - hard), [label])
    d = F.col(difficulty)
    kind = F.when(F.col(wrong) | (d >= F.col("q")[1]), "hard").when(d >= F.col("q")[0], "medium").otherwise("easy")
    return rows.join(F.broadcast(q), label).withColumn("bucket", kind).drop("q")


def stratification_key(rows: DataFrame, features: Sequence[str], bins: int = 8) -> DataFrame:
    """Quantile bins of the features joined by '|'."""
    q = percentiles_of(rows, features, [i / bins for i in range(1, bins)])
    cuts = q.agg(*(F.max(F.when(F.col("column") == c, F.col("q"))).alias(f"_q_{c}") for c in features))  # one row
    met = rows.crossJoin(F.broadcast(cuts))

    def bin_of(c: str) -> Column:
        return F.size(F.filter(f"_q_{c}", lambda v: v < F.col(c))).cast("string")

    key = F.concat_ws("|", *map(bin_of, features))
    return met.withColumn("strat_key", key).drop(*(f"_q_{c}" for c in features))


def _diverse_order(rows: DataFrame, key: str, groups: Sequence[str], strat: str, seed: int) -> DataFrame:
    """``rows`` with ``_lead`` and ``_o``: within its groups a row comes sooner if ``_lead`` (first of its bin), then by a smaller ``_o``."""
    bin_ = [*groups, strat]
    rows = rows.withColumn("_u", unit_hash(key, seed=seed))
    bins = rows.groupBy(*bin_).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("_u", key))[key].alias("_first"))
    met = rows.join(bins, bin_).withColumn("_lead", F.col(key) == F.col("_first"))
    order = F.when(F.col("_lead"), F.col("_n").cast("double")).otherwise(-F.log(F.greatest(F.col("_u"), F.lit(1e-12))) * F.sqrt("_n"))
    return met.withColumn("_o", order).drop("_n", "_u", "_first")


def diverse_sample(rows: DataFrame, n: int, key: str, strat: str = "strat_key", seed: int = 0) -> DataFrame:
    """One row of each bin first (rarest bins first), then by weights 1 / sqrt(bin size), without replacement."""
    return _diverse_order(rows, key, [], strat, seed).orderBy(F.desc("_lead"), "_o", key).limit(n).drop("_lead", "_o")


def balanced_build(base: DataFrame, extra: DataFrame, k: int, key: str, shares: Sequence[float] = (0.6, 0.3, 0.1), strat: str = "strat_key", seed: int = 0) -> DataFrame:
    """All of ``base`` plus ``k`` rows of each class from ``extra`` by hardness (hard, medium, easy), each share a diverse sample of its bucket.

    ``extra`` has label, bucket and the bin ``strat``.  Where a bucket has too few rows, the class's other rows fill up to ``k``
    in the same order.  A task keeps at most ``k`` rows of a bucket before the shuffle.
    """
    quotas = dict(zip(("hard", "medium", "easy"), largest_remainder(k, shares), strict=True))
    order = [F.desc("_lead"), "_o", key]
    ranked = _diverse_order(extra, key, ["label", "bucket"], strat, seed).withColumn("rn", F.row_number().over(Window.partitionBy("label", "bucket").orderBy(*order))).filter(F.col("rn") <= k)
    quota = reduce(lambda c, b: F.when(F.col("bucket") == b, quotas[b]).otherwise(c), quotas, F.lit(0))
    ranked = ranked.withColumn("_over", F.col("rn") > quota)
    chosen = ranked.withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy("_over", *order))).filter(F.col("rn") <= k).select(*base.columns)
    return base.withColumn("source_tag", F.lit("base")).unionByName(chosen.withColumn("source_tag", F.lit("extra")))


def anchor_split(rows: DataFrame, val: float = 0.15, test: float = 0.15, seed: int = 0) -> DataFrame:
    """train, val or test by a hash of the anchor's vehicle; unknown vehicles train."""
    u = unit_hash("gt_id", seed=seed)
    side = F.when(F.col("gt_id").isNull(), "train").when(u < val, "val").when(u < val + test, "test").otherwise("train")
    return rows.withColumn("split", side)


def sanity_gate(meta: DataFrame, min_anchors: int = 200, min_mixed: int = 80) -> None:
    """Raise unless there are enough anchors, and enough with both labels."""
    n, mixed = meta.agg(F.count(F.lit(1)), F.count_if(F.col("has_pos") & F.col("has_neg"))).first()
    if n < min_anchors or mixed < min_mixed:
        raise ValueError(f"{n} anchors, {mixed} mixed; {min_anchors} and {min_mixed} are needed")
