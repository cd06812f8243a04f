import math
import random

from roadweave.functions.numeric import unit_hash
from roadweave.operators import datasets


def test_balanced_build_brute_force(spark):
    """Shares of each bucket by diverse sampling; a class with a short bucket is filled from its others, one with too few rows gives all."""
    rng = random.Random(2)
    rows = [(i, int(i % 4 == 0), rng.choices(["hard", "medium", "easy"], [1, 6, 6])[0], rng.choice("abbbbccccccc")) for i in range(200)]
    rows += [(i, 2, "easy", "a") for i in range(200, 205)]
    extra = spark.createDataFrame(rows, "id long, label int, bucket string, strat_key string")
    u = {r.id: r.u for r in extra.select("id", unit_hash("id", seed=0).alias("u")).collect()}
    base = spark.createDataFrame([(1000, 1), (1001, 0)], "id long, label int")

    def in_order(members):
        bins = {}
        for r in members:
            bins.setdefault(r[3], []).append(r)
        first = {b: min(m, key=lambda r: (u[r[0]], r[0]))[0] for b, m in bins.items()}
        size = {b: len(m) for b, m in bins.items()}
        place = {r[0]: (0, size[r[3]], r[0]) if first[r[3]] == r[0] else (1, -math.log(max(u[r[0]], 1e-12)) * math.sqrt(size[r[3]]), r[0]) for r in members}
        return sorted((place[r[0]], r[0]) for r in members)

    want = {(1000, "base"), (1001, "base")}
    for label in (0, 1, 2):
        ranked = []
        for bucket, quota in (("hard", 18), ("medium", 9), ("easy", 3)):
            ranked += [(i >= quota, *o) for i, o in enumerate(in_order([r for r in rows if r[1] == label and r[2] == bucket]))]
        want |= {(key, "extra") for _, _, key in sorted(ranked)[:30]}
    got = datasets.balanced_build(base, extra, 30, "id").collect()
    assert {(r.id, r.source_tag) for r in got} == want
    assert len(got) == len(want) == 2 + 30 + 30 + 5
    assert datasets.balanced_build(base, extra.limit(0), 30, "id").count() == 2


def test_gap_stratified_keeps_a_few_rows_a_task(spark, capsys):
    """Quotas by bin, shortfalls in hash order; each bin is cut to the total where its pairs are, and nothing else is sorted."""
    rng = random.Random(3)
    rows = [(f"a{i}", f"b{i % 7}", rng.choice([0.0, 1.0, 5.0, 7.0, 10.0, 10.5, 40.0])) for i in range(60)] + [("c", "d", 12.0)]
    pairs = spark.createDataFrame(rows, "a_frag_id string, b_frag_id string, gap double")
    u = {(r.a_frag_id, r.b_frag_id): r.u for r in pairs.select("a_frag_id", "b_frag_id", unit_hash("a_frag_id", "b_frag_id", seed=0).alias("u")).collect()}
    bins = [sorted((u[a, b], a, b) for a, b, gap in rows if low < gap <= low + 5) for low in (0.0, 5.0, 10.0)]
    for total, quotas in ((10, (4, 4, 2)), (20, (8, 7, 5)), (1000, (400, 350, 250))):
        want = sorted((rank >= quota, *r, i) for i, (found, quota) in enumerate(zip(bins, quotas, strict=True)) for rank, r in enumerate(found))[:total]
        got = datasets.gap_stratified(pairs, total)
        assert [(r.a_frag_id, r.b_frag_id, r.bin) for r in got.collect()] == [r[2:] for r in want]
    capsys.readouterr()
    got.explain()
    assert capsys.readouterr().out.split("Initial Plan")[0].count("TakeOrderedAndProject") == 4
