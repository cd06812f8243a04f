"""Range and interval joins on thin endpoint tables, and pair construction.

Every range join is an equi-join on cells of time, x or y (``cell_join``), split at
quantiles where they are crowded; the exact predicate follows.  Arrays never travel
through these joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import unit_hash
from .graph import checkpointed, small_methods
from .prefix import ranked_within

#: A cell of a range join with more right rows than this is split, in each range into at most ``SLICES``.
DEPTH, SLICES = 4096, 64


def cell_join(left: DataFrame, right: DataFrame, keys: Sequence[str], ranges: Sequence[tuple[Column, Column, str, float]], depth: int = DEPTH) -> DataFrame:
    """Pairs with equal keys that share a cell, each at most once; all with ``lo <= right.at <= hi`` in every range are among them.

    ``ranges``: (lo, hi, at, width) with ``lo``, ``hi`` over the left side and ``at`` a right column; a range whose width is not
    positive and finite makes no cells.  Left columns are prefixed ``a_``, right ones ``b_``; ``keys`` are without prefix.
    A right row has one cell of the given widths, a left row looks into those that its ranges meet.  A cell with more than
    ``depth`` right rows is split in each range at its own quantiles, up to ``SLICES`` a range, so that crowded places have many
    small cells and empty ones few large ones.  Right rows on a repeated quantile (ties) are dealt to its slices by hash.
    Left rows with a null or non-finite bound, and right rows with a null, have no pairs.
    """
    ranges = [r for r in ranges if 0 < r[3] < float("inf")]
    edge, cell, cut, part = ([f"_{n}{i}" for i in range(len(ranges))] for n in ("edge", "cell", "cut", "slice"))
    for i, (lo, hi, at, width) in enumerate(ranges):
        slack = 1e-9 * (F.abs(lo) + F.abs(hi) + width)  # the caller's predicate may round in another way
        left = left.filter((F.abs(lo) < float("inf")) & (F.abs(hi) < float("inf"))).withColumn(edge[i], F.array(lo - slack, hi + slack))
        low, high = F.col(edge[i])[0], F.col(edge[i])[1]
        left = left.withColumn(cell[i], F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))
        right = right.withColumn(cell[i], F.floor(F.col(at) / width))
    left = left.withColumns({f"_key{i}": F.col(f"a_{k}") for i, k in enumerate(keys)})
    right = right.withColumns({f"_key{i}": F.col(f"b_{k}") for i, k in enumerate(keys)})
    on = [f"_key{i}" for i in range(len(keys))] + cell

    if not ranges:
        return left.join(right, on).drop(*on)
    full = right.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > depth)
    quantiles = [F.percentile_approx(r[2], [j / SLICES for j in range(1, SLICES)], 1000).alias(c) for c, r in zip(cut, ranges, strict=True)]
    split = right.join(full, on).groupBy(*on, "_n").agg(*quantiles)
    count = F.least(F.lit(SLICES), F.ceil(F.pow(F.col("_n") / depth, 1 / max(1, len(ranges))))).cast("int")
    some = lambda c: F.transform(F.sequence(F.lit(1), count - 1), lambda j: F.element_at(c, (j * SLICES / count).cast("int")))
    split = split.withColumns({c: some(c) for c in cut}).drop("_n")

    hashed = [c for c, t in right.dtypes if "map<" not in t]
    left, right = left.join(split, on, "left"), right.join(split, on, "left")
    below = lambda c, v: F.size(F.filter(c, lambda q: q < v))
    upto = lambda c, v: F.size(F.filter(c, lambda q: q <= v))
    for i, (_, _, at, _) in enumerate(ranges):
        c, low, high, p = F.col(cut[i]), F.col(edge[i])[0], F.col(edge[i])[1], F.col(at)
        met = F.when(c.isNull(), F.array(F.lit(0))).otherwise(F.sequence(below(c, low), upto(c, high)))
        left = left.withColumn(part[i], F.explode(met))
        dealt = below(c, p) + F.pmod(F.xxhash64(F.lit(i), *hashed), upto(c, p) - below(c, p) + 1)
        right = right.withColumn(part[i], F.when(c.isNull(), F.lit(0)).otherwise(dealt).cast("int"))
    # pairs are many more than the rows that meet, so tasks must not be united by the size of these
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = (t.repartition(tasks, *on, *part) for t in (left.drop(*edge, *cut), right.drop(*cut)))
    return left.join(right, on + part).drop(*on, *part)


def bucket_range_join(left: DataFrame, right: DataFrame, keys: Sequence[str], lo: Column, at: str, width: float, depth: int = DEPTH) -> DataFrame:
    """Pairs with ``lo <= right.at <= lo + width`` and equal keys; each pair once. Columns as in ``cell_join``."""
    met = cell_join(left, right, keys, [(lo, lo + width, at, width)], depth)
    return met.filter((F.col(at) >= lo) & (F.col(at) <= lo + width))


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(prefix + c) for c in df.columns))


def candidate_pairs(ends: DataFrame, time_win: float, max_x_gap: float = 800.0, same_scenario: bool = False, max_dy: float = float("inf"), depth: int = DEPTH, starts: DataFrame | None = None) -> DataFrame:
    """Ordered pairs where b starts within ``time_win`` after a ends, same direction, x gap at most ``max_x_gap``, mean y apart by at most ``max_dy``.

    The finite ones of these bounds make the cells of the join.  Both sides' columns are beside each pair, so what a pair cost needs of
    a fragment travels here, with the fragments and not with the pairs.  ``starts``: the table of b, where it has other columns than ``ends``.
    """
    keys = ["direction", "scenario"] if same_scenario else ["direction"]
    last, x, y = F.col("a_last_t"), F.col("a_end_x"), F.col("a_mean_y") if max_dy < float("inf") else F.lit(0.0)
    ranges = [(last, last + time_win, "b_first_t", time_win), (x - max_x_gap, x + max_x_gap, "b_start_x", 2 * max_x_gap), (y - max_dy, y + max_dy, "b_mean_y", 2 * max_dy)]
    pairs = cell_join(prefixed(ends, "a_"), prefixed(ends if starts is None else starts, "b_"), keys, ranges, depth)
    good = (F.col("b_first_t") >= last) & (F.col("b_first_t") <= last + time_win) & (F.abs(F.col("b_start_x") - x) <= max_x_gap)
    if max_dy < float("inf"):
        good &= F.abs(y - F.col("b_mean_y")) <= max_dy
    return pairs.filter(good & (F.col("a_frag_id") != F.col("b_frag_id"))).withColumn("gap", F.col("b_first_t") - last)


def node_compatible(pairs: DataFrame, nodes: DataFrame, diff: int = 0, invalid: float = 1e5, cost: str = "cost") -> DataFrame:
    """Cost ``invalid`` where the camera nodes of a pair are more than ``diff`` places apart. ``nodes``: node, pos (a fixed road layout)."""
    a = nodes.select(F.col("node").alias("a_node"), F.col("pos").alias("_pa"))
    b = nodes.select(F.col("node").alias("b_node"), F.col("pos").alias("_pb"))
    met = pairs.join(F.broadcast(a), "a_node", "left").join(F.broadcast(b), "b_node", "left")
    good = F.coalesce(F.abs(F.col("_pa") - F.col("_pb")) <= diff, F.lit(False))
    return met.withColumn(cost, F.when(good, F.col(cost)).otherwise(invalid)).drop("_pa", "_pb")


def directional_gap(pairs_direction: Column, a_end: Column, b_start: Column) -> Column:
    return F.when(pairs_direction == 1, b_start - a_end).otherwise(a_end - b_start)


def strict_candidates(ends: DataFrame, max_gap: float = 5.0, x_range: tuple[float, float] = (-50.0, 200.0), max_dy: float = 5.0) -> DataFrame:
    """Candidates that truly follow (0 < gap <= ``max_gap``), with a directional x gap in range and close mean y."""
    last, x, y = F.col("a_last_t"), F.col("a_end_x"), F.col("a_mean_y")
    ahead = F.col("a_direction") == 1
    x_lo, x_hi = (x + F.when(ahead, near).otherwise(-far) for near, far in (x_range, x_range[::-1]))
    ranges = [(last, last + max_gap, "b_first_t", max_gap), (x_lo, x_hi, "b_start_x", x_range[1] - x_range[0]), (y - max_dy, y + max_dy, "b_mean_y", 2 * max_dy)]
    pairs = cell_join(prefixed(ends, "a_"), prefixed(ends, "b_"), ["direction"], ranges).withColumn("gap", F.col("b_first_t") - last)
    dx = directional_gap(F.col("a_direction"), x, F.col("b_start_x"))
    return pairs.filter((F.col("gap") > 0) & (F.col("gap") <= max_gap) & (dx >= x_range[0]) & (dx <= x_range[1]) & (F.abs(y - F.col("b_mean_y")) <= max_dy))


def with_extent(ends: DataFrame) -> DataFrame:
    """``x_lo`` and ``x_hi``: the stretch of road that a track covers, extended by its mean length in travel direction."""
    return ends.withColumns(
        {"x_lo": F.least("start_x", "end_x") - F.when(F.col("direction") == -1, F.col("mean_length")).otherwise(0.0),
         "x_hi": F.greatest("start_x", "end_x") + F.when(F.col("direction") == 1, F.col("mean_length")).otherwise(0.0)}
    )


def overlaps(a, b):
    """Whether two tracks overlap in time (touching is none) and in x. ``a``, ``b``: (first_t, last_t, x_lo, x_hi), columns or arrays alike."""
    return (a[1] > b[0]) & (b[1] > a[0]) & (a[2] <= b[3]) & (b[2] <= a[3])


def overlap_pairs(ends: DataFrame, bucket: float, wanted: DataFrame | None = None, stretch: float = 1000.0, carry: Sequence[str] = (), depth: int = DEPTH) -> DataFrame:
    """Unordered pairs (a_id < b_id) of tracks that overlap in time and in extended x; with ``wanted``, only pairs with one of its tracks.

    Of two such tracks one starts (equal starts: by id) within the other's time: a range join of starts with spans in cells of time
    (``bucket``, split where crowded) and road.  Both sides are exploded to the stretches of road (``stretch``) they cover; a pair counts
    in the one where its overlap begins, so it appears once.  ``carry``: columns of ``ends`` that pairs keep, prefixed ``a_`` and ``b_``.
    """
    def covered(t: DataFrame) -> DataFrame:
        t = with_extent(t).filter("last_t >= first_t and x_hi >= x_lo and x_hi - x_lo < double('Infinity')")
        reach = F.sequence(F.floor(F.col("x_lo") / stretch), F.floor(F.col("x_hi") / stretch))
        return t.select("frag_id", "direction", "first_t", "last_t", "x_lo", "x_hi", *carry, F.explode(reach).alias("s"))

    def met(spans: DataFrame, starts: DataFrame) -> DataFrame:
        pairs = cell_join(prefixed(covered(spans), "a_"), prefixed(covered(starts), "b_"), ["direction", "s"], [(F.col("a_first_t"), F.col("a_last_t"), "b_first_t", bucket)], depth)
        side = lambda p: [F.col(f"{p}_{c}") for c in ("first_t", "last_t", "x_lo", "x_hi")]
        later = F.struct("b_first_t", "b_frag_id") > F.struct("a_first_t", "a_frag_id")
        return pairs.filter(later & overlaps(side("a"), side("b")) & (F.floor(F.greatest("a_x_lo", "b_x_lo") / stretch) == F.col("a_s")))

    if wanted is None:
        pairs = met(ends, ends)
    else:
        others = ends.join(wanted.select("frag_id"), "frag_id", "left_anti")
        pairs = met(wanted, ends).unionByName(met(others, wanted))
    swap = F.col("a_frag_id") > F.col("b_frag_id")
    either = lambda c: [F.when(swap, F.col(f"{q}_{c}")).otherwise(F.col(f"{p}_{c}")).alias(f"{p}_{c}") for p, q in ("ab", "ba")]
    times = F.col("a_direction").alias("direction"), F.col("b_first_t").alias("overlap_start"), F.least("a_last_t", "b_last_t").alias("overlap_end")
    return pairs.select(*either("frag_id"), *times, *(c for name in carry for c in either(name)))


def align_overlap(ends: DataFrame, d: DataFrame, bucket: float, dt: float, wanted: DataFrame | None = None) -> DataFrame:
    """``overlap_pairs`` whose samples meet, with these side by side: ``aligned`` has each two of one slot, the grid place since the start of the overlap.

    A track's samples travel with it through the range join, so pairs and their samples are never shuffled.
    """
    small_methods(ends.sparkSession)
    samples = d.groupBy("frag_id").agg(F.array_sort(F.collect_list(F.struct("t", "x", "y", "length", "width"))).alias("samples"))
    tracks = checkpointed(ends.select("frag_id", "direction", "first_t", "last_t", "start_x", "end_x", "mean_length").join(samples, "frag_id"))
    some = None if wanted is None else tracks.join(wanted.select("frag_id"), "frag_id", "left_semi")
    pairs = overlap_pairs(tracks, bucket, some, carry=["samples"])
    start, end = F.col("overlap_start"), F.col("overlap_end")
    sizes = ("x", "y", "length", "width")

    def side(p: str) -> Column:
        near = F.filter(f"{p}_samples", lambda v: (v["t"] >= start - dt / 2) & (v["t"] <= end + dt / 2))
        return F.transform(near, lambda v: F.struct(F.floor((v["t"] - start) / dt + 0.5).alias("slot"), *(v[c].alias(c) for c in sizes)))

    # a row of one element: what was made once is not made again for a filter or for each sample of the other track
    once = lambda c, good: F.explode(F.filter(F.array(c), good))
    pairs = pairs.select("a_frag_id", "b_frag_id", once(F.struct(side("a").alias("a"), side("b").alias("b")), lambda s: (F.size(s["a"]) > 0) & (F.size(s["b"]) > 0)).alias("_s"))
    both = lambda u, v: F.struct(*(w[c].alias(f"{p}_{c}") for p, w in (("a", u), ("b", v)) for c in sizes))
    meet = F.flatten(F.transform("_s.a", lambda u: F.transform(F.filter("_s.b", lambda v: v["slot"] == u["slot"]), lambda v: both(u, v))))
    return pairs.select("a_frag_id", "b_frag_id", once(meet, lambda v: F.size(v) > 0).alias("aligned"))


def binned_neighbors(ends: DataFrame, dt: float, dx: float, radius_t: tuple[int, int], radius_x: int) -> DataFrame:
    """Pairs in neighbouring space-time bins, same direction; bins truncate toward zero. One side is exploded."""
    binned = ends.select("frag_id", "direction", "gt_id", "first_t", "last_t", "start_x", "end_x", (F.col("first_t") / dt).cast("int").alias("bt"), (F.col("start_x") / dx).cast("int").alias("bx"))
    near = binned.withColumn("dt_", F.explode(F.sequence(F.lit(radius_t[0]), F.lit(radius_t[1])))).withColumn("dx_", F.explode(F.sequence(F.lit(-radius_x), F.lit(radius_x))))
    a = prefixed(near.withColumns({"kt": F.col("bt") + F.col("dt_"), "kx": F.col("bx") + F.col("dx_")}).drop("dt_", "dx_"), "a_")
    b = prefixed(binned, "b_")
    on = (F.col("a_direction") == F.col("b_direction")) & (F.col("a_kt") == F.col("b_bt")) & (F.col("a_kx") == F.col("b_bx"))
    return a.join(b, on).filter("a_frag_id != b_frag_id")


def positive_pairs(ends: DataFrame, mode: str = "consecutive") -> DataFrame:
    """Pairs of one vehicle: consecutive ones, or all ordered by start."""
    if mode == "consecutive":
        w = Window.partitionBy("gt_id").orderBy("first_t", "frag_id")
        nxt = F.lead(F.struct("frag_id", "first_t")).over(w)
        return ends.withColumn("b", nxt).filter("b is not null").select(
            F.col("frag_id").alias("a_frag_id"), F.col("b.frag_id").alias("b_frag_id"), "gt_id", (F.col("b.first_t") - F.col("last_t")).alias("gap")
        )
    a, b = prefixed(ends.select("frag_id", "gt_id", "first_t", "last_t"), "a_"), prefixed(ends.select("frag_id", "gt_id", "first_t", "last_t"), "b_")
    met = a.join(b, (F.col("a_gt_id") == F.col("b_gt_id")) & (F.struct("a_first_t", "a_frag_id") < F.struct("b_first_t", "b_frag_id")))
    return met.select("a_frag_id", "b_frag_id", F.col("a_gt_id").alias("gt_id"), (F.col("b_first_t") - F.col("a_last_t")).alias("gap"))


def cross_negatives(ends: DataFrame, groups: Sequence[str], max_gap: float = 10.0, max_dy: float = 5.0) -> DataFrame:
    """Pairs of different vehicles in a group with a gap in (0, max_gap] and close mean y."""
    last, y = F.col("a_last_t"), F.col("a_mean_y")
    ranges = [(last, last + max_gap, "b_first_t", max_gap), (y - max_dy, y + max_dy, "b_mean_y", 2 * max_dy)]
    pairs = cell_join(prefixed(ends, "a_"), prefixed(ends, "b_"), list(groups), ranges)
    return pairs.withColumn("gap", F.col("b_first_t") - last).filter(
        (F.col("a_gt_id") != F.col("b_gt_id")) & (F.col("gap") > 0) & (F.col("gap") <= max_gap) & (F.abs(F.col("a_mean_y") - F.col("b_mean_y")) <= max_dy)
    )


def lane_negatives(ends: DataFrame, k: int = 29, lane_ft: float = 6.0) -> DataFrame:
    """Within a direction and lane bin, each fragment with the next ``k`` by start, other vehicles only: an equi-join on places in the lane."""
    lane = (F.col("mean_y") / lane_ft).cast("int")
    placed = ranked_within(ends.select("frag_id", "gt_id", "direction", lane.alias("lane"), "first_t"), ["direction", "lane"], ["first_t", "frag_id"])
    a = placed.select("direction", "lane", "gt_id", F.col("frag_id").alias("a_frag_id"), F.explode(F.sequence(F.col("rn") + 1, F.col("rn") + k)).alias("rn"))
    b = placed.select("direction", "lane", "rn", F.col("gt_id").alias("b_gt_id"), F.col("frag_id").alias("b_frag_id"))
    return a.join(b, ["direction", "lane", "rn"]).filter("gt_id != b_gt_id").select("a_frag_id", "b_frag_id", "direction", "lane")


def random_negatives(ends: DataFrame, n: int, time_win: float, seed: int = 0) -> DataFrame:
    """``n`` sequential pairs of different vehicles with twice the window, in hash order."""
    pool = candidate_pairs(ends, 2 * time_win, float("inf")).filter("a_gt_id != b_gt_id")
    return pool.select("a_frag_id", "b_frag_id", "gap").orderBy(unit_hash("a_frag_id", "b_frag_id", seed=seed), "a_frag_id", "b_frag_id").limit(n)


def match_by_values(rows: DataFrame, targets: DataFrame, columns: tuple[str, str], tolerance: float = 1e-3) -> DataFrame:
    """For each row the target with both values within ``tolerance``: nearest first, then the smaller id."""
    c1, c2 = columns
    grid = lambda c: F.floor(F.col(c) / tolerance)
    left = rows.select(F.col("id").alias("row_id"), F.col(c1).alias("r1"), F.col(c2).alias("r2"))
    near = F.explode(F.array(*[grid("r1") + i for i in (-1, 0, 1)]))
    left = left.withColumn("k1", near).withColumn("k2", F.explode(F.array(*[grid("r2") + i for i in (-1, 0, 1)])))
    right = targets.select(F.col("id").alias("target_id"), F.col(c1).alias("t1"), F.col(c2).alias("t2")).withColumns({"k1": grid("t1"), "k2": grid("t2")})
    met = left.join(right, ["k1", "k2"]).filter((F.abs(F.col("r1") - F.col("t1")) < tolerance) & (F.abs(F.col("r2") - F.col("t2")) < tolerance))
    far = F.abs(F.col("r1") - F.col("t1")) + F.abs(F.col("r2") - F.col("t2"))
    return met.groupBy("row_id").agg(F.min(F.struct(F.round(far, 9).alias("far"), "target_id")).alias("m")).select("row_id", "m.target_id")


def vehicle_split(ids: DataFrame, val_ratio: float, seed: int = 0, column: str = "gt_id") -> DataFrame:
    """Each vehicle once with its side, by a hash of its id, so the split is stable and needs no sort."""
    return ids.select(column).distinct().withColumn("side", F.when(unit_hash(column, seed=seed) < val_ratio, "val").otherwise("train"))


def vehicle_disjoint_split(pairs: DataFrame, val_ratio: float = 0.2, seed: int = 0) -> DataFrame:
    """Pairs whose vehicles are on one side; pairs across go. The side is a function of the id, so no join is needed."""
    side = lambda c: F.when(unit_hash(c, seed=seed) < val_ratio, "val").otherwise("train")
    return pairs.withColumn("side", side("a_gt_id")).filter(F.col("side") == side("b_gt_id"))


def mask_cross_labels(rows: DataFrame, split: DataFrame) -> DataFrame:
    """Null labels where the candidate's vehicle belongs to another split than the row. ``split``: gt_id, side."""
    own = split.select(F.col("gt_id").alias("candidate_gt_id"), F.col("side").alias("candidate_side"))
    met = rows.join(own, "candidate_gt_id", "left")
    crossed = F.col("candidate_side").isNotNull() & (F.col("candidate_side") != F.col("side"))
    return met.withColumn("label", F.when(~crossed, F.col("label"))).drop("candidate_side")


def experiment_matrix(configs: DataFrame, scenarios: DataFrame, done: DataFrame) -> DataFrame:
    """Every (config, scenario) with its result; without one it is FAILED. All three are small result tables."""
    return configs.crossJoin(F.broadcast(scenarios)).join(done, ["config", "scenario"], "left").withColumn("status", F.when(F.col("value").isNull(), "FAILED").otherwise("OK"))
