"""Projections, filters and per-fragment preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import at, mean

SAMPLES = ("t", "x", "y", "length", "width", "conf")


def normalize_fragments(f: DataFrame, min_points: int = 4, node: str | None = None) -> DataFrame:
    """Doubles, and only tracks with ``min_points`` samples; ``node`` sets compute_node_id."""
    doubles = {n: F.transform(n, lambda x: x.cast("double")) for n, t in f.dtypes if t.startswith("array<") and "struct" not in t and "string" not in t}
    out = f.withColumns(doubles) if doubles else f
    out = out.filter(F.size("timestamp" if "timestamp" in f.columns else "t") >= min_points)
    return out.withColumn("compute_node_id", F.lit(node)) if node else out


def filter_direction(f: DataFrame, direction: int) -> DataFrame:
    return f.filter(F.col("direction") == direction)


def to_detections(f: DataFrame, samples: tuple[str, ...] = SAMPLES) -> DataFrame:
    """One row per sample; other columns are repeated."""
    rest = [c for c in f.columns if c not in samples]
    return f.select(*rest, F.posexplode(F.arrays_zip(*samples)).alias("idx", "s")).select(*rest, "idx", *(F.col(f"s.{c}").alias(c) for c in samples))


def to_fragments(d: DataFrame, samples: tuple[str, ...] = SAMPLES) -> DataFrame:
    """One row per fragment, samples in order of ``idx``."""
    keys = [c for c in d.columns if c not in (*samples, "idx")]
    rows = d.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", *samples))).alias("s"))
    return rows.select(*keys, *(F.col("s").getField(c).alias(c) for c in samples))


def with_endpoints(f: DataFrame, t: str = "t", x: str = "x") -> DataFrame:
    return f.withColumns({"first_t": at(t, 1), "last_t": at(t, -1), "start_x": at(x, 1), "end_x": at(x, -1)})


def filter_confidence(f: DataFrame, threshold: float = 0.2, min_keep: int = 4, samples: tuple[str, ...] = SAMPLES) -> DataFrame:
    """Samples of ``threshold`` confidence at least; arrays are cut to the shortest first; short remains go."""
    n = F.least(*(F.size(c) for c in samples))
    zipped = F.arrays_zip(*(F.slice(F.col(c), F.lit(1), n).alias(c) for c in samples))
    kept = f.withColumn("_s", F.filter(zipped, lambda s: s["conf"] >= threshold)).filter(F.size("_s") >= min_keep)
    return kept.withColumns({c: F.col("_s").getField(c) for c in samples}).drop("_s")


def with_gt_id(f: DataFrame) -> DataFrame:
    """The vehicle: the first ``gt_ids`` entry, else ``_source_gt_id``, else null."""
    first = F.try_element_at(F.try_element_at(F.col("gt_ids"), F.lit(1)), F.lit(1)).getField("$oid")
    return f.withColumn("gt_id", F.coalesce(first, F.col("_source_gt_id")))


def with_fragment_id(f: DataFrame, fallback: Column | None = None) -> DataFrame:
    names = [F.col(c).cast("string") for c in ("calib_id", "local_fragment_id", "_id") if c in f.columns]
    return f.withColumn("fragment_id", F.coalesce(*names, fallback if fallback is not None else F.lit(None)))


def interpolate_positions(d: DataFrame) -> DataFrame:
    """Missing x and y filled linearly over the sample index, ends held; y is filled where x is missing."""
    ahead = Window.partitionBy("frag_id").orderBy("idx").rowsBetween(0, Window.unboundedFollowing)
    back = Window.partitionBy("frag_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    known = F.col("x").isNotNull() & ~F.isnan("x")
    at_known = F.when(known, F.struct("idx", "x", "y"))
    d = d.withColumns({"_a": F.last(at_known, ignorenulls=True).over(back), "_b": F.first(at_known, ignorenulls=True).over(ahead)})
    share = (F.col("idx") - F.col("_a.idx")) / (F.col("_b.idx") - F.col("_a.idx"))

    def filled(c: str) -> Column:
        a, b = F.col(f"_a.{c}"), F.col(f"_b.{c}")
        return F.when(known, F.col(c)).when(F.col("_a").isNull(), b).when(F.col("_b").isNull(), a).otherwise(a + (b - a) * share)

    return d.withColumns({"x": filled("x"), "y": filled("y")}).drop("_a", "_b")


def with_velocity(d: DataFrame, mode: str = "forward") -> DataFrame:
    """Finite differences along a fragment.

    forward: next minus this, the last repeats; backward: this minus previous over
    dt + 1e-6, the first repeats; guarded: the same over max(dt, 1e-6).
    """
    w = Window.partitionBy("frag_id").orderBy("idx")
    dx, dt = F.col("x") - F.lag("x").over(w), F.col("t") - F.lag("t").over(w)
    if mode == "forward":
        step = (F.lead("x").over(w) - F.col("x")) / (F.lead("t").over(w) - F.col("t"))
        d = d.withColumn("_v", step)
        return d.withColumn("velocity", F.coalesce("_v", F.lag("_v").over(w), F.lit(0.0))).drop("_v")
    step = dx / (dt + 1e-6) if mode == "backward" else dx / F.greatest(dt, F.lit(1e-6))
    d = d.withColumn("_v", step)
    return d.withColumn("velocity", F.coalesce("_v", F.lead("_v").over(w), F.lit(0.0))).drop("_v")


def relative_sequence(f: DataFrame) -> DataFrame:
    """Positions and times relative to the first sample."""

    def shifted(c: str) -> Column:
        first = at(c, 1)
        return F.transform(c, lambda v: v - first)

    return f.withColumns({f"rel_{c}": shifted(c) for c in ("t", "x", "y")})


def harmonize_arrays(f: DataFrame, columns: tuple[str, ...], mode: str = "mean", like: str = "t") -> DataFrame:
    """Arrays of the sample length: filled up with their mean, or with their last value; longer ones are cut."""
    n = F.size(like)

    def fitted(c: str) -> Column:
        fill = mean(F.col(c)) if mode == "mean" else at(c, -1)
        return F.slice(F.concat(F.col(c), F.array_repeat(fill, F.greatest(n - F.size(c), F.lit(0)))), F.lit(1), n)

    return f.withColumns({c: fitted(c) for c in columns})


def rich_sequence(d: DataFrame, length: float = 15.0, width: float = 6.0, height: float = 5.0) -> DataFrame:
    """Eight channels a sample: x, y, v, length, width, height, conf, and time in [0, 1]."""
    w = Window.partitionBy("frag_id")
    have = set(d.columns)
    default = lambda c, v: F.coalesce(F.col(c), F.lit(v)) if c in have else F.lit(v)
    span = F.max("t").over(w) - F.min("t").over(w)
    v = with_velocity(d, "backward")
    return v.select(
        "frag_id", "idx", "x", "y", "velocity", default("length", length).alias("length"), default("width", width).alias("width"),
        default("height", height).alias("height"), default("conf", 1.0).alias("conf"),
        F.when(span > 0, (F.col("t") - F.min("t").over(w)) / span).otherwise(0.0).alias("t_norm"),
    )


def normalize_sequence(d: DataFrame, stats: DataFrame, channels: tuple[str, ...]) -> DataFrame:
    """z-values by a one-row table of means and deviations (mean_c, std_c)."""
    one = d.crossJoin(F.broadcast(stats.limit(1)))
    return one.withColumns({c: (F.col(c) - F.col(f"mean_{c}")) / F.col(f"std_{c}") for c in channels}).select(*d.columns)


def lane_bounds(f: DataFrame, y: str = "mean_y", step: float = 12.0) -> DataFrame:
    """Per direction the lowest and highest y and the number of lanes (two rows at most, so it is broadcast)."""
    return f.groupBy("direction").agg(F.min(y).alias("lo"), F.max(y).alias("hi")).withColumn(
        "lanes", F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo")) / step)).cast("int")
    )


def with_lane(f: DataFrame, bounds: DataFrame, y: str = "mean_y", step: float = 12.0) -> DataFrame:
    """Lane 1 starts at the lowest y eastbound and at the highest westbound; beyond the last lane is the last lane."""
    depth = F.when(F.col("direction") == 1, F.col(y) - F.col("lo")).otherwise(F.col("hi") - F.col(y))
    lane = F.least(F.floor(depth / step).cast("int") + 1, F.col("lanes"))
    return f.join(F.broadcast(bounds), "direction").withColumn("lane", lane).drop("lo", "hi", "lanes")


def fixed_lane(y: Column, direction: Column) -> Column:
    """Lanes of 12 ft from 0 eastbound and from 72 westbound, truncated toward zero and clamped to 0..3."""
    raw = F.when(direction == 1, y / 12).otherwise((y - 72) / 12).cast("int")
    return F.least(F.greatest(raw, F.lit(0)), F.lit(3))


def timespace_table(d: DataFrame, f: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows of a time-space diagram: lane, time since the earliest sample, x."""
    lanes = with_lane(f, bounds).select("frag_id", "lane")
    earliest = f.agg(F.min("first_t").alias("t0"))
    return d.join(lanes, "frag_id").crossJoin(F.broadcast(earliest)).select("frag_id", "lane", "idx", (F.col("t") - F.col("t0")).alias("t_rel"), "x")


CHANNELS = ("x", "y", "length", "width")


def resample(f: DataFrame, dt: float = 0.04, base: float = 0.01, trim: float = 1.0) -> DataFrame:
    """t, x, y, length, width on a regular grid from the first sample on: means in bins of ``base``, linear between bins with a value, every ``dt``.

    A channel keeps its first and last value beyond them; the grid ends ``trim`` after the last sample with a position.
    Fragments without samples go.  One shuffle by fragment; bins know their neighbours, and each makes the grid up to the next.
    """
    keys = [c for c in f.columns if c not in SAMPLES and c != "frag_id"]
    step = max(1, round(dt / base))
    samples = f.filter(F.size("t") > 0).select("frag_id", *keys, F.element_at("t", 1).alias("t0"), F.explode(F.arrays_zip("t", *CHANNELS)).alias("s"))
    binned = samples.repartition("frag_id").withColumn("bin", F.floor((F.col("s.t") - F.col("t0")) / base + 1e-9))
    until = F.max(F.when(F.col("s.x").isNotNull(), F.col("s.t")))
    means = binned.groupBy("frag_id", "bin").agg(F.first("t0").alias("t0"), until.alias("known"), *(F.first(k).alias(k) for k in keys), *(F.avg(f"s.{c}").alias(c) for c in CHANNELS))
    order = Window.partitionBy("frag_id").orderBy("bin")
    upto, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(1, Window.unboundedFollowing)
    have = lambda c: F.when(F.col(c).isNotNull(), F.struct("bin", F.col(c).alias("v")))
    near = means.withColumns(
        {"next": F.lead("bin").over(order), "last": F.max("known").over(Window.partitionBy("frag_id"))}
        | {f"{c}_a": F.last(have(c), ignorenulls=True).over(upto) for c in CHANNELS}
        | {f"{c}_b": F.first(have(c), ignorenulls=True).over(after) for c in CHANNELS}
    )
    first, stop = F.ceil(F.col("bin") / step) * step, F.coalesce(F.col("next") - 1, F.col("bin"))
    grid = near.filter(first <= stop).withColumn("g", F.explode(F.sequence(first, stop, F.lit(step).cast("bigint"))))

    def value(c: str) -> Column:
        a, b = F.col(f"{c}_a"), F.col(f"{c}_b")
        line = a["v"] + (b["v"] - a["v"]) * ((F.col("g") - a["bin"]) / (b["bin"] - a["bin"]))
        return F.when(b.isNull(), a["v"]).when(a.isNull(), b["v"]).otherwise(line)

    point = F.struct("g", (F.col("t0") + F.col("g") * base).alias("t"), *(value(c).alias(c) for c in CHANNELS))
    points = grid.filter(F.col("last").isNull() | (F.col("t0") + F.col("g") * base <= F.col("last") + trim)).select("frag_id", *keys, point.alias("p"))
    out = points.groupBy("frag_id").agg(*(F.first(k).alias(k) for k in keys), F.array_sort(F.collect_list("p")).alias("p"))
    return out.select("frag_id", *keys, *(F.col("p").getField(c).alias(c) for c in ("t", *CHANNELS)))


def head_tail(f: DataFrame, n: int = 25, columns: tuple[str, ...] = ("t", "x", "y")) -> DataFrame:
    """First and last min(size, n) samples."""

    def ends(c: str) -> dict[str, Column]:
        k = F.least(F.size(c), F.lit(n))
        return {f"head_{c}": F.slice(F.col(c), F.lit(1), k), f"tail_{c}": F.slice(F.col(c), F.size(c) - k + 1, k)}

    return f.withColumns({k: v for c in columns for k, v in ends(c).items()})


def box_corners(b: DataFrame) -> DataFrame:
    half_l, half_w = F.col("length") / 2, F.col("width") / 2
    return b.withColumns({"x1": F.col("x") - half_l, "x2": F.col("x") + half_l, "y1": F.col("y") - half_w, "y2": F.col("y") + half_w})


def to_boxes(d: DataFrame, fps: float, t0: DataFrame) -> DataFrame:
    """Boxes by frame number (half to even); the last sample of a track in a frame wins. ``t0`` is one row."""
    framed = d.crossJoin(F.broadcast(t0)).withColumn("frame", F.bround((F.col("t") - F.col("t0")) * fps).cast("long"))
    last = F.max_by(F.struct("x", "y", "length", "width"), "idx")
    return framed.groupBy("scenario", "direction", "frame", "gt_id", "frag_id").agg(last.alias("b")).select(
        "scenario", "direction", "frame", "gt_id", "frag_id", "b.x", "b.y", "b.length", "b.width"
    )
