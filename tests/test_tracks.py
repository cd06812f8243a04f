import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadweave.functions.numeric import softplus
from roadweave.operators import calibrate, costs, datasets, graph, joins, mot, prepare, ranking, smooth
from roadweave.operators.features import ADVANCED, BASIC, fragment_features, pair_features
from roadweave.operators.prefix import percentiles, running_sums
from roadweave.sources import io


def detections(spark, tracks):
    rows = [(n, d, i, float(t), float(x), float(y), 4.5, 2.0, 0.95, 50.0) for n, d, ts, xs, ys in tracks for i, (t, x, y) in enumerate(zip(ts, xs, ys, strict=True))]
    return spark.createDataFrame(rows, "frag_id string, direction int, idx int, t double, x double, y double, length double, width double, conf double, velocity double")


PAIR = [("a", 1, [0, 0.04, 0.08, 0.12, 0.16], [100, 102, 104, 106, 108], [20, 20.5, 21, 20.5, 20]), ("b", 1, [0.20, 0.24, 0.28], [110, 112, 114], [20, 20, 20])]


def test_pair_features(spark):
    pairs = spark.createDataFrame([("a", "b")], "a_frag_id string, b_frag_id string")
    row = pair_features(pairs, fragment_features(detections(spark, PAIR))).first()
    slope, at = np.polyfit(PAIR[0][2], PAIR[0][4], 1, w=np.sqrt(np.linspace(1e-6, 1, 5)))
    off = np.array([20 - (slope * u + at) for u in PAIR[1][2]])
    want = {
        "time_gap": 0.04, "spatial_gap": 2.0, "duration_a": 0.16, "duration_b": 0.08, "duration_ratio": 2, "y_diff": 0.4, "y_mean_a": 20.4, "y_mean_b": 20, "y_std_a": np.std([20, 20.5, 21, 20.5, 20]), "y_std_b": 0,
        "vel_a_mean": 50, "vel_diff": 0, "vel_ratio": 1, "length_a": 4.5, "length_diff": 0, "width_b": 2, "conf_a_min": 0.95, "conf_b_mean": 0.95, "direction_match": 1, "height_a": 0,
        "projection_error_x_mean": 0, "projection_error_x_max": 0, "projection_error_y_mean": off.mean(), "projection_error_y_std": off.std(), "projection_error_y_max": abs(off).max(),
        "velocity_fit_x": 50, "velocity_fit_y": slope, "velocity_actual_x_mean": 2 / (0.04 + 1e-6), "velocity_actual_y_mean": 0, "velocity_mismatch_x": 50 - 2 / (0.04 + 1e-6), "velocity_mismatch_y": abs(slope), "curvature_b_mean": 0,
    }
    for name, value in want.items():
        assert row[name] == pytest.approx(value, abs=1e-4, rel=1e-5), name
    assert tuple(row.asDict())[2:] == BASIC + ADVANCED and len(BASIC) == 28 and len(ADVANCED) == 19


def fragments(spark, tracks):
    return prepare.with_endpoints(prepare.to_fragments(detections(spark, tracks).drop("velocity"))).withColumns({"gt_id": F.lit(1), "scenario": F.lit(0)})


def test_stitch_cost_against_loops(spark):
    """The mean distance of each sample from the longer track's line, forward and backward, and the window."""
    tracks = [*PAIR, ("c", 1, [0.3, 0.4], [120, 117], [21, 22]), ("d", 1, [1.0, 1.1, 1.3, 1.5], [160, 158, 157, 150], [20, 20, 21, 22])]
    pairs = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("a", "d")]
    f = fragments(spark, tracks)
    df = spark.createDataFrame(pairs, "a_frag_id string, b_frag_id string")
    got = {(r.a_frag_id, r.b_frag_id): r.cost for r in costs.stitch_cost(costs.with_profiles(df, costs.end_profile(f)), 15.0).collect()}
    held = {n: (np.array(t, float), np.array(x, float), np.array(y, float)) for n, _, t, x, y in tracks}

    def line(t, v, w):
        (slope, at) = np.linalg.lstsq(np.stack([t, np.ones_like(t)], 1) * np.sqrt(w)[:, None], v * np.sqrt(w), rcond=None)[0]
        return slope, at

    def cost(a, b):
        (ta, xa, ya), (tb, xb, yb) = held[a], held[b]
        if tb[0] < ta[-1]:
            return 1e6
        ahead = len(ta) >= len(tb)
        (t, x, y), (mt, mx, my) = (held[a], held[b]) if ahead else (held[b], held[a])
        w = np.linspace(1e-6, 1, len(t)) if ahead else np.linspace(1, 1e-6, len(t))
        (sx, ix), (sy, iy) = line(t, x, w), line(t, y, w)
        dt = (mt - ta[-1]) if ahead else (tb[0] - mt)
        wide_x, wide_y = 0.2 + 0.1 * dt * abs(sx), 2.0 + 0.1 * dt * abs(sy)
        if sx < 0:
            sx, ix = 0, (w * x).sum() / w.sum()
        total = 0
        for k in range(len(mt)):
            for diff, v1, v2 in ((sx * mt[k] + ix - mx[k], wide_x[k] ** 2, wide_x[0] ** 2), (sy * mt[k] + iy - my[k], wide_y[k] ** 2, max(np.var(my), 4.0))):
                v = (v1 + v2) / 2
                total += diff**2 / (8 * v) + 0.5 * np.log(v / np.sqrt(v1 * v2))
        return total / len(mt) + 0.1 * (tb[0] - ta[-1])

    for pair in pairs:
        assert got[pair] == pytest.approx(cost(*pair), rel=1e-6), pair


def test_pair_cost_by_name(spark):
    f = fragments(spark, PAIR)
    pairs = spark.createDataFrame([("a", "b"), ("b", "a")], "a_frag_id string, b_frag_id string")
    of = lambda cost: {r.a_frag_id: r.cost for r in cost(pairs, f).collect()}
    assert of(costs.pair_cost("distance")) == {"a": pytest.approx(2.0), "b": 1e6}
    assert of(costs.pair_cost("physics_only"))["b"] == 1e6
    own = lambda p, f: p.withColumns({"gap": F.lit(0.0), "cost": F.lit(7.0)})
    assert of(costs.pair_cost("gate_rank", gate=costs.pair_cost("distance"), rank=own)) == {"a": 7.0, "b": 1e6}
    scores = spark.createDataFrame([("a", "b", 0.5)], "a_frag_id string, b_frag_id string, score double")
    assert of(costs.pair_cost("score", scores=scores, scale=4.0)) == {"a": pytest.approx(2.0 + 0.004), "b": 1e6}
    with pytest.raises(ValueError, match="no pair cost named"):
        costs.pair_cost("nothing")


def physics(spark, tracks, **options):
    pairs = spark.createDataFrame([("a", "b")], "a_frag_id string, b_frag_id string")
    profiles = costs.physics_profile(fragments(spark, tracks), **options)
    return costs.physics_residuals(pairs, profiles, 15.0), profiles


def test_physics_residuals(spark):
    good = [("a", 1, [0, 0.04, 0.08, 0.12], [0, 1, 2, 3], [4, 4, 4.1, 4.1]), ("b", 1, [0.16, 0.20, 0.24], [4, 5, 6], [4.1, 4.1, 4.2])]
    p, _ = physics(spark, good)
    row = costs.physics_cost(p, 15.0).first()
    assert all(row[n] < 5 for n in costs.RESIDUALS) and row.velocity == pytest.approx(0, abs=1e-9) and math.isfinite(row.cost)
    far = [("a", 1, [0, 0.04, 0.08], [0, 1, 2], [4, 4, 4]), ("b", 1, [20.0, 20.04], [4, 5], [4, 4])]
    row = costs.physics_cost(physics(spark, far)[0], 15.0).first()
    assert [row[n] for n in costs.RESIDUALS] == [1000.0] * 6 and row.cost == 1e6
    _, short = physics(spark, [("a", 1, [0, 0.1], [5, 6], [2, 2.2]), ("b", 1, [1.0], [0], [0])])
    a = {r.frag_id: r for r in short.collect()}["a"]
    assert (a.x_slope, a.y_slope) == (0, 0) and a.x_at == pytest.approx(6, abs=1e-5)
    _, wrong = physics(spark, [("a", 1, [0, 0.04, 0.08, 0.12, 0.16], [10, 9.8, 9.6, 9.4, 9.2], [0, 0, 0, 0, 0]), ("b", 1, [1.0], [0], [0])])
    assert {r.frag_id: r.x_slope for r in wrong.collect()}["a"] == 0
    damped = spark.createDataFrame([(0.5, 1.0, 2.0, 0.0, 3.0, 0.4)], list(costs.RESIDUALS)).select(*costs.damped_residuals()).first()
    assert tuple(damped) == pytest.approx((math.log(1.5), math.log(2), math.log(3), 0, 3, math.log(1.4)))


def test_chains_are_grown_to_their_end(spark):
    """a takes c before b is looked at, and c takes d at once, so b can't have d."""
    rows = [("a", "c", 0.0, 0.9), ("b", "d", 1.0, 0.95), ("c", "d", 2.0, 0.8), ("d", "e", 3.0, 0.5), ("b", "e", 1.0, 0.7)]
    df = spark.createDataFrame([(0, 1, *r) for r in rows], "scenario int, direction int, src string, dst string, src_t double, score double")
    assert {(r.src, r.dst) for r in graph.greedy_chains(df, 0.5).collect()} == {("a", "c"), ("c", "d"), ("b", "e")}


def test_semi_hard_negatives_come_from_one_tier(spark):
    rows = [("A", 0, 2.0, 1), ("A", 1, 2.1, 0), ("A", 2, 2.5, 0), ("A", 3, 1.0, 0), ("B", 0, 2.0, 1), ("B", 1, 2.0, 0), ("B", 2, 0.5, 0), ("B", 3, 1.5, 0), ("C", 0, 2.0, 1), ("C", 1, 9.0, 0), ("C", 2, 8.0, 0)]
    df = spark.createDataFrame(rows, "anchor_id string, candidate_id long, cost double, label int")
    got = sorted((r.anchor_id, r.candidate_id, r.tier) for r in ranking.semi_hard_negatives(df, 0.5, 2).collect())
    assert [x for x in got if x[0] != "C"] == [("A", 1, 0), ("A", 2, 0), ("B", 2, 1), ("B", 3, 1)]
    assert len([x for x in got if x[0] == "C" and x[2] == 2]) == 1


def plain_resample(t, v, dt, base):
    bins = np.floor((np.array(t) - t[0]) / base + 1e-9).astype(int)
    known = sorted({b for b, x in zip(bins, v, strict=True) if x is not None})
    means = [np.mean([x for b, x in zip(bins, v, strict=True) if b == k and x is not None]) for k in known]
    grid = np.arange(0, bins[-1] + 1, round(dt / base))
    return t[0] + grid * base, np.interp(grid, known, means)


def test_resample_fixture(spark):
    t = [0.013, 0.050, 0.091, 0.137, 0.180, 0.260]
    rng = np.random.default_rng(1)
    long = np.sort(rng.random(90) * 3).tolist()
    holes = [None if rng.random() < 0.2 else float(x) for x in rng.normal(size=90)]
    rows = [("a", 7, t, [10 * x for x in t], [1.0] * 6), ("b", 8, long, holes, long), ("c", 9, [2.0], [5.0], [1.0]), ("d", 9, [], [], []), ("e", 9, None, None, None)]
    df = spark.createDataFrame(rows, "frag_id string, tag int, t array<double>, x array<double>, y array<double>").withColumns({"length": F.col("y"), "width": F.col("y")})
    got = {r.frag_id: r for r in prepare.resample(df, 0.04, 0.01).collect()}
    assert set(got) == {"a", "b", "c"} and got["b"].tag == 8
    assert got["a"].t == pytest.approx([0.013 + 0.04 * k for k in range(7)])
    assert got["a"].x == pytest.approx([0.13, 0.6025, 1.002, 1.37, 1.8, 2.2, 2.6], abs=1e-3)
    grid, x = plain_resample(long, holes, 0.04, 0.01)
    assert got["b"].t == pytest.approx(grid) and got["b"].x == pytest.approx(x)
    assert (got["c"].t, got["c"].x) == ([2.0], [5.0])
    plan = prepare.resample(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_resample_ends_at_the_trim(spark):
    df = spark.createDataFrame([("a", [0.0, 0.5, 9.0], [0.0, 5.0, None])], "frag_id string, t array<double>, x array<double>").withColumns({c: F.col("x") for c in ("y", "length", "width")})
    r = prepare.resample(df, 1.0, 0.25, trim=1.0).first()
    assert (r.t, r.x) == ([0.0, 1.0], [0.0, 5.0])  # the last known value is at .5


def test_merge_components(spark):
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "node long")
    edges = spark.createDataFrame([(1, 2), (3, 2)], "a long, b long")
    for task_edges in (0, 100):
        assert {r.node: r.component for r in graph.connected_components(nodes, edges, task_edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert {r.node: r.component for r in graph.connected_components(nodes, edges.limit(0)).collect()} == {i: i for i in (1, 2, 3, 4)}


def dense_smooth(z, lam2, lam3, dt):
    n, seen = len(z), ~np.isnan(z)
    d = lambda k: np.diff(np.eye(n), n=k, axis=0) / dt**k
    a = np.diag(seen / seen.sum() + 1e-12) + lam2 / (n - 2) * d(2).T @ d(2) + lam3 / (n - 3) * d(3).T @ d(3)
    return np.linalg.solve(a, np.where(seen, z, 0) / seen.sum())


def dense_robust(z, lam1, lam2, lam3, dt):
    e, x = np.zeros(len(z)), dense_smooth(z, lam2, lam3, dt)
    for _ in range(50):
        r = np.where(np.isnan(z), 0, z - x)
        new = np.sign(r) * np.maximum(np.abs(r) - lam1 / 2, 0)
        if np.abs(new - e).max() < 1e-9:
            break
        e = new
        x = dense_smooth(z - e, lam2, lam3, dt)
    return x, e


def dense_search(z, lam2, lam3, dt):
    best, shift, kept = np.inf, np.nanmin(z), None
    for turn in range(1, 12):
        x, e = dense_robust(z - shift, turn * 1e-3, lam2, lam3, dt)
        mae = np.nanmean(np.abs(z - shift - x - e))
        if mae >= best:
            break
        best, kept = mae, x
    return kept + shift


@pytest.mark.parametrize("lam2,lam3", [(0.3, 0.7), (0.0, 1.0), (0.2, 0.0)])
def test_smoothing_against_dense_solves(lam2, lam3):
    rng = np.random.default_rng(0)
    series = []
    for n in [4, 5, 6, 9, 9, 14, 30, 31, 32, 60]:
        z = np.cumsum(rng.normal(size=n)) + (rng.random(n) < 0.1) * 20
        z[rng.random(n) < 0.15] = np.nan
        z[0], z[n // 2], z[-1] = 1.0, 2.0, 3.0
        series.append(z)
    series += [np.array([1.0, 2, 3]), np.full(8, np.nan), np.array([])]
    for lam1, search, plain in ((None, False, lambda z: dense_smooth(z, lam2, lam3, 0.5)), (0.5, False, lambda z: dense_robust(z, 0.5, lam2, lam3, 0.5)[0]), (None, True, lambda z: dense_search(z, lam2, lam3, 0.5))):
        got = smooth.smooth_series(series, lam2, lam3, 0.5, lam1, search)
        assert [g is None for g in got] == [len(z) <= 3 or np.isnan(z).all() for z in series]
        for z, g in zip(series[:-3], got, strict=False):
            assert g == pytest.approx(plain(z), abs=1e-5)


def test_smoothing_keeps_a_line_and_the_input_where_it_fails(spark):
    line = [float(i) for i in range(8)]
    df = spark.createDataFrame([("a", [*line[:3], None, *line[4:]], line), ("b", [1.0, 2.0], [1.0, 2.0]), ("c", None, line)], "frag_id string, x array<double>, y array<double>")
    got = {r.frag_id: r for r in smooth.smooth(df, 0.0, 1.0, dt=1.0).collect()}
    assert got["a"].x == pytest.approx(line, abs=1e-4) and got["a"].status == "ok"
    assert (got["b"].x, got["b"].status, got["c"].status) == ([1.0, 2.0], "too few samples", "too few samples")


def boxes(spark, rows):
    return spark.createDataFrame([(0, 1, f, i, float(x), 0.0, 4.0, 2.0) for f, i, x in rows], "scenario int, direction int, frame long, id string, x double, y double, length double, width double")


def test_metrics_of_truth_against_itself_and_a_switch(spark):
    g = boxes(spark, [(f, "1", 10 * f) for f in range(4)])
    t = boxes(spark, [(f, "a" if f < 2 else "b", 10 * f) for f in range(4)])
    rows = {r.tracker: r for r in mot.evaluate_trackers(g, {"t": t}).collect()}
    assert (rows["gt"].hota, rows["gt"].mota, rows["gt"].idf1, rows["gt"].idsw) == (pytest.approx(1), 1, 1, 0)
    assert (rows["t"].mota, rows["t"].idf1, rows["t"].idsw) == (0.75, 0.5, 1)


def test_greedy_matching(spark):
    p = spark.createDataFrame([(0, 1, 0, "g1", "t1", 0.9), (0, 1, 0, "g1", "t2", 0.8), (0, 1, 0, "g2", "t1", 0.7)], "scenario int, direction int, frame long, g_id string, t_id string, iou double")
    assert [(r.g_id, r.t_id) for r in mot.greedy_matches(p, [0.5]).collect()] == [("g1", "t1")]


def test_a_scene_is_not_one_group(spark):
    n = 30
    g = boxes(spark, [(f, f"g{i}", 100 * i + f) for i in range(n) for f in range(3)])
    t = boxes(spark, [(f, f"t{i}", 100 * i + f) for i in range(n) for f in range(3)])
    pairs = mot.iou_pairs(g, t)
    chains = spark.createDataFrame([(0, 1, f"a{i}", f"b{i}", float(i), 1.0) for i in range(n)], "scenario int, direction int, src string, dst string, src_t double, score double")
    made = {"clear": mot.clear_matches(pairs), "identity": mot.identity_metrics(pairs, g, t), "chains": graph.greedy_chains(chains, 0.5)}
    for name, out in made.items():
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "component" in plan.split("FlatMapGroupsInPandas [", 1)[1].split("]")[0], name
    assert made["clear"].count() == 3 * n
    assert made["identity"].first()["idtp"] == 3 * n
    assert made["chains"].count() == n


def test_nearest_negatives(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [9.0, 1.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, [1.0, 1.0])], "id long, v array<double>")
    p = spark.createDataFrame([(0, 7), (0, 1)], "anchor long, positive long")
    n = spark.createDataFrame([(0, i) for i in (1, 2, 3, 4, 5)], "anchor long, negative long")
    near = lambda metric: {r.positive: (r.negative, round(r.distance, 6)) for r in datasets.nearest_negatives(p, n, v, metric).collect()}
    assert near("cosine") == {7: (1, 0.006116), 1: (2, 0.292893)}
    assert near("l2") == {7: (2, 1.0), 1: (2, 1.0)}


def test_roc_and_calibration(spark):
    r = spark.createDataFrame([(1.0, 1), (2.0, 1), (3.0, 0), (4.0, 1)], "cost double, label int").withColumn("score", -F.col("cost"))
    assert calibrate.roc_auc(r, "score").first()["auc"] == pytest.approx(2 / 3)
    p = spark.createDataFrame([(0.05, 0), (0.05, 0), (0.95, 1), (0.95, 0)], "p double, label int")
    assert calibrate.expected_calibration_error(p).first()["ece"] == pytest.approx(0.25)


def test_percentiles_and_running_sums_per_key(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(v) if rng.random() > 0.1 else None) for k, n in (("a", 700), ("b", 1), ("c", 90)) for v in rng.integers(0, 60, n)] + [("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    held = {k: [v for n, v in rows if n == k and v is not None] for k in "abcd"}
    got = {r.k: r.q for r in percentiles(df, "v", probs, ["k"]).collect()}
    assert got == {k: pytest.approx(np.quantile(v, probs)) for k, v in held.items() if v}
    assert percentiles(df, "v", [0.5]).first().q == pytest.approx([np.median(sum(held.values(), []))])
    assert [r.q for r in percentiles(df.limit(0), "v", [0.5]).collect()] == [None]
    assert percentiles(df.limit(0), "v", [0.5], ["k"]).count() == 0
    per = df.filter("v is not null").groupBy("k", "v").count()
    for r in running_sums(per, ["k"], "v", {"upto": "count"}, descending=True, ranges=8).collect():
        assert r.upto == sum(1 for x in held[r.k] if x >= r.v)


def test_boxes_meet_across_cells(spark):
    rng = np.random.default_rng(4)
    rows = lambda p: [(0, 1, int(f), f"{p}{i}", float(x), float(y), float(w), 3.0) for i, (f, x, y, w) in enumerate(zip(rng.integers(0, 3, 60), rng.normal(0, 60, 60), rng.normal(0, 2, 60), rng.uniform(1, 90, 60), strict=True))]
    g, t = rows("g"), rows("t")
    schema = "scenario int, direction int, frame long, id string, x double, y double, length double, width double"
    want = {(a[3], b[3]) for a in g for b in t if a[2] == b[2] and abs(a[4] - b[4]) < (a[6] + b[6]) / 2 and abs(a[5] - b[5]) < 3}
    got = [(r.g_id, r.t_id) for r in mot.iou_pairs(spark.createDataFrame(g, schema), spark.createDataFrame(t, schema), cell=20.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_gate_rank_and_scores(spark):
    rows = spark.createDataFrame([(4.2, 0.1), (1.0, 0.7), (2.4, float("nan")), (2.4, float("inf"))], "g double, r double")
    assert [r[0] for r in rows.select(costs.gate_rank_cost(F.col("g"), F.col("r"))).collect()] == [4.2, 0.7, 2.4, 2.4]
    s = [r[0] for r in spark.createDataFrame([(-50.0,), (0.0,), (50.0,)], "s double").select(softplus(F.col("s"))).collect()]
    assert s[0] >= 0 and s == sorted(s)


def test_anchor_audit(spark):
    rows = [("A", "A1", 2, 1, 1.0, 1), ("A", "A2", 1, 2, 1.2, 0), ("B", "B1", 1, 1, 1.0, 1), ("C", "C1", 1, 1, 1.0, 1), ("C", "C2", 2, 1, 1.0, 1), ("D", "D1", 1, 1, 1.0, None)]
    df = spark.createDataFrame(rows, "anchor_id string, candidate_id string, base long, other long, gap double, label int")
    o = ranking.anchor_outcomes(df, {"base": "base", "other": "other"}).collect()
    assert [(r.anchor_id, r.base_correct, r.other_correct) for r in o] == [("A", False, True)]
    out = spark.createDataFrame([(False, True), (False, True), (True, False), (True, True)], "base_correct boolean, other_correct boolean")
    m = ranking.anchor_metrics(out, "base", "other").first()
    assert (m.base_error, m.other_error, m.lift, m.recovery, m.regression) == (0.5, 0.25, 0.5, 1.0, 0.5)


def test_frames_round_half_to_even(spark):
    d = detections(spark, [("a", 1, [0.0, 2.5, 3.5], [0, 1, 2], [0, 0, 0])]).withColumns({"scenario": F.lit(0), "gt_id": F.lit(1)})
    got = prepare.to_boxes(d, 1.0, spark.createDataFrame([(0.0,)], "t0 double"))
    assert sorted(r.frame for r in got.collect()) == [0, 2, 4]


def test_largest_remainder():
    assert datasets.largest_remainder(7, (0.40, 0.35, 0.25)) == [3, 2, 2]


def test_samples_do_not_depend_on_partitioning(spark):
    x = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    one, many = (sorted(r.k for r in datasets.balance_classes(x.repartition(n), "k").collect()) for n in (1, 7))
    assert one == many and len(one) == 2 * 167


def test_range_join_has_each_pair_once(spark):
    e = spark.createDataFrame([(str(i), 1, i * 0.5, i * 0.5 + 1.0, 0.0, 0.0) for i in range(40)], "frag_id string, direction int, first_t double, last_t double, start_x double, end_x double")
    got = sorted((r.a_frag_id, r.b_frag_id) for r in joins.candidate_pairs(e, 3.0).collect())
    want = sorted((str(i), str(j)) for i in range(40) for j in range(40) if i != j and 0 <= j * 0.5 - (i * 0.5 + 1.0) <= 3.0)
    assert got == want


def test_sources(spark, tmp_path):
    (tmp_path / "f.json").write_text('[{"_id": {"$oid": "x1"}, "timestamp": [1, 2], "x_position": [1, 2]}, {"_id": "x2", "timestamp": [3], "x_position": [1]}]')
    assert sorted(r._id for r in io.read_fragments(spark, str(tmp_path / "f.json")).collect()) == ["x1", "x2"]
    (tmp_path / "l.json").write_text('{"_id": "a", "timestamp": [1.0]}\n{"_id": broken\n\n')
    good, bad = io.read_quarantine(spark, str(tmp_path / "l.json"))
    assert (good.count(), bad.count()) == (1, 1)
    (tmp_path / "m.csv").write_text("1,7,0.5,1,2,3,-1,-1\n")
    assert tuple(io.read_mot_csv(spark, str(tmp_path / "m.csv")).first()) == (1, 7, 0.5, 1.0, 2.0, 3.0)
    batch = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "_id string, v int")
    for _ in range(2):
        io.write_append(batch, str(tmp_path / "sink"))
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 2


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], timeout=120).returncode == 0


def test_registered_sql_and_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


QUIET = ("pair_features", "displacement_targets", "cost_by_name", "physics_cost", "stitch_cost", "hardness_score", "align_overlap", "merge_cost", "merge_cost_simple", "overlap_cost")  # queries on candidate pairs that shuffle fragments, not pairs


@pytest.mark.parametrize("name", QUIET)
def test_pairs_are_not_shuffled(spark, name, capsys):
    """Nothing is exchanged above the range join: what a pair needs of its fragments travels with these."""
    from roadweave.plans import tracks

    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tracks.QUERIES[name](spark, "/root/testdata/sf0.001").explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    lines = capsys.readouterr().out.split("Initial Plan")[0].splitlines()
    first = next(i for i, line in enumerate(lines) if "Join" in line)
    assert not [line for line in lines[:first] if "Exchange" in line]


def test_pairs_of_costs_by_label_are_not_kept(spark, monkeypatch):
    """The tables that ``candidate_cost_by_label`` writes have a row per fragment at most, not one per pair."""
    from roadweave.plans import tracks

    kept = []
    monkeypatch.setattr(tracks, "checkpointed", lambda df: kept.append(df) or df)
    made = tracks.QUERIES["candidate_cost_by_label"](spark, "/root/testdata/sf0.001").collect()
    assert kept and made
    assert all("frag_id" in df.columns and df.count() == df.select("frag_id").distinct().count() for df in kept)
