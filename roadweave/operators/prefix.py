"""Running sums and exact percentiles without a task that sees all values.

Running sums: rows are first counted by distinct value.  The values of each key are
cut into ranges at approximate quantiles, ranges are summed, and a range's offset is
added to the sums inside it.

Percentiles: a sketch brackets each rank, and a second pass counts what lies below the
bracket and, by value, inside; only what is inside is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed

ACCURACY = 10_000
FEW = 16
MARGINS = tuple(3 / ACCURACY * 8**k for k in range(5))


def running_sums(per: DataFrame, keys: Sequence[str], by: str, sums: dict[str, str], descending: bool = False, ranges: int = 64) -> DataFrame:
    """``per`` (one row per keys and ``by``) with a column for each of ``sums`` (name: summed column), the sum down to and including the row."""
    keys = list(keys)
    per = checkpointed(per)  # read three times
    q = F.percentile_approx(by, F.lit([i / ranges for i in range(1, ranges)]), F.lit(10_000))
    cuts = per.groupBy(*keys).agg(F.array_distinct(q).alias("_q"))
    met = per.join(cuts, keys) if keys else per.crossJoin(F.broadcast(cuts))
    before = (lambda v: v > F.col(by)) if descending else (lambda v: v < F.col(by))
    placed = met.withColumn("_r", F.size(F.filter("_q", before))).drop("_q")
    totals = placed.groupBy(*keys, "_r").agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    earlier = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # at most ``ranges`` rows a key
    offsets = totals.select(*keys, "_r", *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_{n}") for n in sums))
    inside = Window.partitionBy(*keys, "_r").orderBy(F.desc(by) if descending else F.col(by)).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()})
    out = local.join(offsets, [*keys, "_r"])
    return out.select(*per.columns, *((F.col(n) + F.col(f"_{n}")).alias(n) for n in sums))


def ranked_within(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn") -> DataFrame:
    """``rows`` with their place (1, 2, ...) in ``order`` within their key, from a range partition: no task per key.  ``order`` tells rows apart."""
    by = [*keys, *order]
    placed = checkpointed(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_place", F.monotonically_increasing_id())).withColumn("_task", F.shiftrightunsigned("_place", 33))
    runs = placed.groupBy(*keys, "_task").agg(F.min("_place").alias("_from"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # a row per task and key
    runs = runs.select(*keys, "_task", "_from", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    met = placed.alias("l").join(runs.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_task"]])
    return met.select(*(F.col(f"l.{c}").alias(c) for c in rows.columns), (F.col("_before") + F.col("l._place") - F.col("_from") + 1).alias(name))


def percentiles(rows: DataFrame, value: str, probabilities: Sequence[float], keys: Sequence[str] = (), name: str = "q") -> DataFrame:
    """keys and an array of the exact percentiles of ``value``, interpolated between ranks; nulls don't count.

    Keys without a value have no row; without keys there is one row, null if there is no value.
    """
    keys = list(keys)
    found = percentiles_of(rows, [value], probabilities, keys)
    if keys:
        return found.select(*keys, F.col("q").alias(name))
    return found.agg(F.max("q").alias(name))


def percentiles_of(rows: DataFrame, values: Sequence[str], probabilities: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """keys, ``column`` (one of ``values``) and ``q``, the exact percentiles of that column: two scans of ``rows`` for any number of columns.

    The first takes quantiles by a sketch, for each probability at several margins on both sides; the second counts values below and inside
    the narrowest bracket that is sure for the number of values (a few in ``ACCURACY`` of them), where ranks are then exact.
    Should a sketch be worse than it promises, the bracket that missed is opened to all values.
    """
    keys, probs = list(keys), [float(p) for p in probabilities]
    every = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in values))
    long = rows.select(*keys, F.explode(every).alias("_s")).select(*keys, "_s.column", "_s.v").filter("v is not null")
    group = [*keys, "column"]
    fractions = sorted({min(1.0, max(0.0, p + side * m)) for p in probs for m in MARGINS for side in (-1, 1)})
    place = {f: i for i, f in enumerate(fractions)}
    sketch = long.groupBy(*group).agg(F.count("v").alias("n"), F.percentile_approx("v", F.lit(fractions), F.lit(ACCURACY)).alias("s"))

    order = sorted(range(len(probs)), key=lambda i: probs[i])  # lower ends of brackets rise

    def places(side: int) -> list[list[int]]:
        """For each margin, and for none, where each bracket's end is among the fractions; -1 where it is open."""
        at = [[probs[k] + side * m for k in order] for m in MARGINS]
        return [[place[f] + 1 if 0 < f < 1 else -1 for f in row] for row in at] + [[-1] * len(probs)]

    # the narrowest margin that holds three ranks more than the sketch may err
    margin = F.size(F.filter(F.lit(list(MARGINS)), lambda m: m < 3 / ACCURACY + 3 / F.col("n"))) + 1

    def ends(side: int, open_to: float):
        return F.transform(F.element_at(F.lit(places(side)), margin), lambda at: F.when(at < 0, F.lit(open_to)).otherwise(F.element_at("s", F.greatest(at, F.lit(1)))))

    turn = F.array(*(F.lit(order.index(k) + 1) for k in range(len(probs))))
    numbered = F.lit([[float(i), probs[k]] for i, k in enumerate(order)])
    zipped = sketch.select(*group, "n", F.arrays_zip(numbered.alias("at"), ends(-1, float("-inf")).alias("lo"), ends(1, float("nan")).alias("hi")).alias("z"))  # NaN is above all numbers
    bracket = F.transform("z", lambda x: F.struct(x["at"][0].cast("int").alias("i"), x["at"][1].alias("p"), x["lo"].alias("lo"), x["hi"].alias("hi")))
    brackets = checkpointed(zipped.select(*group, "n", bracket.alias("b")))
    same = lambda t: [F.col(f"{t}.{c}").eqNullSafe(F.col(f"b.{c}")) for c in group]

    def counted(brackets: DataFrame) -> DataFrame:
        met = long.alias("l").join(brackets.alias("b"), same("l"))
        in_ = lambda x: (F.col("v") >= x["lo"]) & (F.col("v") <= x["hi"])
        if len(probs) <= FEW:  # spelled out, Spark compiles it
            each = [F.col("b.b")[i] for i in range(len(probs))]
            under = reduce(lambda s, x: s + (F.col("v") < x["lo"]).cast("int"), each, F.lit(0))
            inside = reduce(lambda s, x: s | in_(x), each, F.lit(False))
        else:
            under, inside = F.size(F.filter("b.b", lambda x: F.col("v") < x["lo"])), F.exists("b.b", in_)
        names = [F.col(f"b.{c}").alias(c) for c in group]
        # a value lies below so many of the last brackets; only values inside one are kept apart
        found = met.select(*names, under.alias("under"), F.when(inside, F.col("v")).alias("v")).groupBy(*group, "under", "v").agg(F.count(F.lit(1)).alias("c"))
        found = checkpointed(found)
        lower = found.filter("under > 0").select(*group, F.explode(F.sequence(F.lit(len(probs)) - F.col("under"), F.lit(len(probs) - 1))).alias("i"), F.lit(None).cast("double").alias("v"), "c")
        inner = found.filter("v is not null").alias("l").join(brackets.select(*group, "b").alias("b"), same("l"))
        inner = inner.select(*names, F.explode(F.transform(F.filter("b.b", in_), lambda x: x["i"])).alias("i"), "v", "c")
        counts = inner.unionByName(lower.groupBy(*group, "i", "v").agg(F.sum("c").alias("c")))
        upto = Window.partitionBy(*group, "i").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0)
        known = brackets.select(*group, "n", F.explode("b").alias("_b")).select(*group, "n", F.col("_b.i").alias("i"), F.col("_b.p").alias("p"))
        ranks = counts.withColumn("upto", F.sum("c").over(upto)).filter("v is not null").alias("l").join(known.alias("b"), [*same("l"), F.col("l.i") == F.col("b.i")])
        at = F.col("p") * (F.col("n") - 1)
        holds = lambda r: (r >= F.col("upto") - F.col("c")) & (r < F.col("upto"))
        hit = ranks.groupBy(*(F.col(f"b.{c}").alias(c) for c in group), F.col("b.i").alias("i")).agg(
            F.max(F.when(holds(F.floor(at)), F.col("v"))).alias("lo"), F.max(F.when(holds(F.ceil(at)), F.col("v"))).alias("hi"), F.max(at).alias("at"))
        between = F.when(F.ceil("at") == F.floor("at"), F.col("lo")).otherwise((F.ceil("at") - F.col("at")) * F.col("lo") + (F.col("at") - F.floor("at")) * F.col("hi"))
        return hit.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("i", between.alias("q")))).alias("_s")).select(*group, F.transform(turn, lambda k: F.try_element_at(F.col("_s").getField("q"), k)).alias("q"))

    found = checkpointed(counted(brackets))
    good = F.forall("q", lambda x: x.isNotNull())
    missed = brackets.alias("b").join(found.filter(good).alias("f"), same("f"), "left_anti")
    if missed.isEmpty():
        return found
    wide = missed.withColumn("b", F.transform("b", lambda x: F.struct(x["i"].alias("i"), x["p"].alias("p"), F.lit(float("-inf")).alias("lo"), F.lit(float("nan")).alias("hi"))))
    return found.filter(good).unionByName(counted(checkpointed(wide)))
