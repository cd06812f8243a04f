"""Cells of range joins against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from roadweave.operators import joins

ENDS = "frag_id long, gt_id long, direction int, scenario string, first_t double, last_t double, start_x double, end_x double, mean_y double, mean_length double"


def road(rng, n, crowd):
    """Tracks of which many start on one spot, some at the very same time and place."""
    out = []
    for i in range(n):
        if rng.random() < crowd:
            t, x = rng.choice([(100.0, 500.0), (100.0 + rng.random(), 500.0 + rng.random())])
        else:
            t, x = rng.uniform(-50, 400), rng.uniform(-2000, 4000)
        last, end = t + rng.choice([0.0, 1.0, rng.uniform(0, 3)]), x + rng.choice([0.0, 30.0, -30.0])
        out.append((i, rng.randrange(n // 3), rng.choice([1, -1]), rng.choice("ab"), t, last, x, end, rng.choice([3.0, 8.0, rng.uniform(0, 40)]), 15.0))
    return out


@pytest.mark.parametrize("depth", [2, 5, 4096])
def test_cells_equal_all_pairs(spark, depth):
    rng = random.Random(depth)
    rows = road(rng, 300, 0.4) + [(900, None, None, "a", 100.0, 101.0, 500.0, 500.0, 3.0, 15.0), (901, 1, 1, "a", None, None, 500.0, 500.0, 3.0, 15.0), (902, 1, 1, "a", 100.0, 100.5, float("nan"), float("nan"), float("nan"), 15.0), (903, 1, 1, "a", 100.0, 100.5, float("inf"), float("inf"), 3.0, 15.0)]
    ends = spark.createDataFrame(rows, ENDS)

    def want(win, gap, dy, scenario):
        return sorted(
            (a[0], b[0])
            for a in rows[:300]
            for b in rows[:300]
            if a[0] != b[0] and a[2] == b[2] and a[5] <= b[4] <= a[5] + win and abs(b[6] - a[7]) <= gap and abs(a[8] - b[8]) <= dy and (not scenario or a[3] == b[3])
        )

    for win, gap, dy, scenario in [(4.0, 30.0, float("inf"), False), (2.0, 700.0, 5.0, True)]:
        got = joins.candidate_pairs(ends, win, gap, scenario, dy, depth)
        assert sorted(map(tuple, got.select("a_frag_id", "b_frag_id").collect())) == want(win, gap, dy, scenario)
    # without a bound on x the places of no use are no bar
    got = joins.candidate_pairs(ends.filter("frag_id < 900"), 4.0, 1e9, depth=depth)
    assert sorted(map(tuple, got.select("a_frag_id", "b_frag_id").collect())) == want(4.0, 1e9, float("inf"), False)
    assert joins.candidate_pairs(ends.limit(0), 4.0, 30.0, depth=depth).count() == 0


def test_cells_of_a_crowded_road_are_even(spark):
    """All tracks start within one cell, a third at one moment: no task has over three times the median."""
    rng = random.Random(1)
    rows = [(i, 10.0 if i % 3 == 0 else rng.uniform(8, 12), rng.uniform(0, 20)) for i in range(6000)]
    b = spark.createDataFrame(rows, "b_id long, b_t double, b_x double").withColumn("b_k", F.lit(1))
    a = b.limit(600).select(F.col("b_id").alias("a_id"), F.col("b_t").alias("a_t"), F.col("b_x").alias("a_x"), F.lit(1).alias("a_k"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(kept, ("false", "8", "-1"), strict=True):
            spark.conf.set(k, v)

        def tasks(depth):
            ranges = [(F.col("a_t") - 10, F.col("a_t") + 10, "b_t", 20.0), (F.col("a_x") - 20, F.col("a_x") + 20, "b_x", 40.0)]
            met = joins.cell_join(a, b, ["k"], ranges, depth)
            counts = [r.n for r in met.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
            return met.select("a_id", "b_id").distinct().count(), sorted(counts)

        all_pairs, split = tasks(50)
        plain_pairs, plain = tasks(10**9)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert all_pairs == plain_pairs == sum(split) == 600 * 6000
    assert len(plain) == 1
    assert len(split) == 8 and split[-1] <= 3 * split[4]


def test_overlap_cells_equal_all_pairs(spark):
    rng = random.Random(4)
    rows = road(rng, 200, 0.3)
    ends = spark.createDataFrame(rows, ENDS)

    def extent(r):
        return min(r[6], r[7]) - (r[9] if r[2] == -1 else 0), max(r[6], r[7]) + (r[9] if r[2] == 1 else 0)

    want = sorted(
        (a[0], b[0])
        for a in rows
        for b in rows
        if a[0] < b[0] and a[2] == b[2] and a[5] > b[4] and b[5] > a[4] and extent(a)[0] <= extent(b)[1] and extent(b)[0] <= extent(a)[1]
    )
    for bucket, stretch in [(12.0, 1000.0), (1.0, 7.0)]:
        got = joins.overlap_pairs(ends, bucket, stretch=stretch)
        assert sorted((r.a_frag_id, r.b_frag_id) for r in got.collect()) == want
    some = ends.filter("frag_id % 7 = 0")
    got = joins.overlap_pairs(ends, 12.0, some, 40.0)
    assert sorted((r.a_frag_id, r.b_frag_id) for r in got.collect()) == [p for p in want if p[0] % 7 == 0 or p[1] % 7 == 0]


def test_cross_negatives_equal_all_pairs(spark):
    rows = road(random.Random(9), 200, 0.4)
    got = joins.cross_negatives(spark.createDataFrame(rows, ENDS), ["direction", "scenario"])
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[2:4] == b[2:4] and a[1] != b[1] and 0 < b[4] - a[5] <= 10 and abs(a[8] - b[8]) <= 5)
    assert sorted((r.a_frag_id, r.b_frag_id) for r in got.collect()) == want


def test_gaps_are_bounded_as_differences(spark):
    """b starts an ulp around a's end plus the bound, where sum and difference round to different sides; the difference decides, as in SQL."""
    near = [(a, b) for a in (0.1 * i for i in range(1, 300)) for b in (a + 5.0, math.nextafter(a + 5.0, 1e9), math.nextafter(a + 5.0, 0)) if (b - a <= 5) != (b <= a + 5)]
    assert len({b - a <= 5 for a, b in near}) == 2
    rows = [(2 * i + j, 2 * i + j, 1, "a", first, last, 0.0, 0.0, 20.0 * i, 15.0) for i, (a, b) in enumerate(near) for j, (first, last) in enumerate([(a - 1, a), (b, b + 1)])]
    want = sorted((a[0], b[0]) for a in rows for b in rows if 0 < b[4] - a[5] <= 5 and abs(a[8] - b[8]) <= 5)
    ends = spark.createDataFrame(rows, ENDS)
    for got in (joins.strict_candidates(ends), joins.cross_negatives(ends, ["direction", "scenario"], 5.0)):
        assert sorted((r.a_frag_id, r.b_frag_id) for r in got.collect()) == want
