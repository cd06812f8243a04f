"""Mixing sources to target weights by pivotal dependent rounding (operator 13), DataFrame functions only.

Targets: sources in order get weights, and a share of all words; a target stops
at ``most`` times its source, and what is over is shared again by weight until
none is above (``level``: two sums reach the driver each round).

Copies: a document of a source with target T and size S is wanted q = T / S times.
All get floor(q) copies; the rest is the probability of one more.  Probabilities
are rounded in pairs: words move from one document of a pair to the other, the
way drawn so that each keeps its expectation, until one is settled; the sum in
words never changes.  The unsettled one goes on, so a group leaves one: groups of
hash prefixes, then groups of shorter prefixes, up to the source: a reduction
tree whose groups hold about ``GROUP`` rows, however large or hot a source is.

What is left of a tree is settled by its own probability, which misses the target
by less than one document.  So documents go in classes of size, largest first
(``CLASS_BITS`` bits each), and what a class misses is given to the probabilities
of the smaller ones.  A source's total so misses its target by less than its
smallest class's largest document, if smaller documents can make up for larger ones.

Words are counted in units of 2**-20, so that all sums are exact.  All draws are
hashes of ``seed``, id and size, so reruns agree, whatever the partitioning.

Cases: a null text has size 0 and is taken 0 times; null is a source of its own,
the last; repeated rows (same id, source and size) are one unit with a count and
come back as rows of their own; a null id is an id; sources without words have
target 0; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, ranked, read

WEIGHTS = (5, 2, 1)
PERCENT = 150
MOST = 2
SEED = 13
GROUP_BITS = 6
GROUP = 1 << GROUP_BITS
CLASS_BITS = 3
WORD = 1 << 20
COPIES = 4096
_UNIT = "struct<h: bigint, doc: {id}, size: bigint, n: bigint, sure: bigint, base: bigint, mass: bigint>"
_DONE = "array<struct<doc: {id}, size: bigint, n: bigint, more: bigint, base: bigint>>"


def sizes(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """doc, source, size (number of words), n (rows that share these)."""
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
    return docs.select(F.col(key).alias("doc"), F.col(source).alias("source"), words.alias("size")).groupBy("doc", "source", "size").agg(F.count(F.lit(1)).alias("n"))


def with_targets(sources: DataFrame, weights: tuple[int, ...], percent: int, most: int) -> DataFrame:
    """``sources`` (source, source_size) with ``target``."""
    placed = ranked(sources, [F.asc_nulls_last("source")], "place", "sources")
    weighted = placed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")))
    cap, weight = F.col("source_size") * most, F.col("weight").cast("bigint")
    total = F.sum("source_size").alias("total")
    first = weighted.agg(total, F.sum(weight).alias("weight"), F.lit(0).alias("n"), F.lit(0).alias("full")).first()
    every, now, words, open_ = (first["total"] or 0) * percent / 100, -1, 0, first["weight"] or 1
    while True:
        level = (every - words) / open_ if open_ else math.inf
        above = weight.cast("double") * level > cap if math.isfinite(level) else F.lit(True)
        found = weighted.agg(F.count_if(above).alias("n"), F.sum(F.when(above, cap)).alias("words"), F.sum(F.when(~above, weight)).alias("open")).first()
        if found["n"] == now:
            break
        now, words, open_ = found["n"], found["words"] or 0, found["open"] or 0
    share = F.lit(every - words) * weight / F.lit(open_ or 1)
    return weighted.select("source", "source_size", F.when(above, cap.cast("double")).otherwise(share).alias("target"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _settle(group: DataFrame, id_type: str, seed: int) -> DataFrame:
    """``left`` (the unit that goes on) and ``done`` of each ``units`` array, by moving words between neighbours in the array."""
    unit, done = _UNIT.format(id=id_type), _DONE.format(id=id_type)
    full = lambda x: x["size"] * F.lit(WORD)
    as_done = lambda x, mass: F.struct(
        x["doc"].alias("doc"), x["size"].alias("size"), x["n"].alias("n"), (x["sure"] + (mass == full(x)).cast("bigint")).alias("more"), x["base"].alias("base")
    )
    with_mass = lambda x, mass: F.struct(*(x[c].alias(c) for c in ("h", "doc", "size", "n", "sure", "base")), mass.alias("mass"))

    def step(acc: Column, y: Column) -> Column:
        x = acc["left"]
        up = F.least(full(x) - x["mass"], y["mass"])  # words that x can take from y
        down = F.least(x["mass"], full(y) - y["mass"])
        draw = F.pmod(F.xxhash64(x["h"], y["h"], F.lit(seed)), F.greatest(up + down, F.lit(1)))
        moved = F.when(draw < down, up).otherwise(-down)
        x_mass, y_mass = x["mass"] + moved, y["mass"] - moved
        x_settled = (x_mass == 0) | (x_mass == full(x))
        return F.struct(
            F.when(x_settled, with_mass(y, y_mass)).otherwise(with_mass(x, x_mass)).cast(unit).alias("left"),
            F.concat(acc["done"], F.array(F.when(x_settled, as_done(x, x_mass)).otherwise(as_done(y, y_mass))).cast(done)).alias("done"),
        )

    start = F.struct(F.element_at("units", 1).cast(unit).alias("left"), F.array().cast(done).alias("done"))
    rest = F.slice("units", F.lit(2), F.greatest(F.size("units") - 1, F.lit(0)))
    return group.withColumn("r", F.aggregate(rest, start, step)).drop("units").select("*", "r.left", "r.done").drop("r")


def _rounded(units: DataFrame, id_type: str, count: int, seed: int, label: str) -> list[DataFrame]:
    """Tables of settled units (source, doc, size, n, more, base) for units (source, h, ..., mass)."""
    names = ["h", "doc", "size", "n", "sure", "base", "mass"]
    bits = max(0, math.ceil(math.log2(max(1, count) / GROUP)))
    out, level = [], units
    while True:
        prefix = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("bigint")
        groups = level.groupBy("source", prefix.alias("prefix")).agg(F.sort_array(F.collect_list(F.struct(*names))).alias("units"))
        settled = materialize(_settle(groups, id_type, seed), label)
        out.append(settled.select("source", F.inline("done")))
        level = settled.select("source", "left.*")
        if not bits:
            break
        bits = max(0, bits - GROUP_BITS)
    full = F.col("size") * WORD
    last = F.pmod(F.xxhash64("h", F.lit(seed + 1)), full) < F.col("mass")
    out.append(level.select("source", "doc", "size", "n", (F.col("sure") + last.cast("bigint")).alias("more"), "base"))
    return out


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST, seed: int = SEED,
) -> DataFrame:
    """One row per row of ``docs``: key, source, size, source_size, target, copies, taken (copies times size)."""
    h = F.xxhash64(F.lit(seed), "doc", "size")
    size_class = F.floor((F.length(F.bin("size")) - 1) / CLASS_BITS)
    units = materialize(sizes(docs, key, text, source).withColumns({"h": h, "class": F.when(F.col("size") > 0, size_class)}), "sizes")
    id_type = dict(units.dtypes)["doc"]
    totals = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    sources = materialize(with_targets(materialize(totals, "source-sizes"), weights, percent, most), "targets")
    state = sources.select("source", F.col("target").alias("wanted"), F.col("source_size").alias("words"))
    classes = units.filter("size > 0").groupBy("class").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("class")).collect()  # at most 64 / CLASS_BITS rows
    nothing = F.lit(0).cast("bigint")
    done = [units.filter("size = 0").select("source", "doc", "size", "n", nothing.alias("more"), nothing.alias("base"))]
    for r in classes:
        rate = F.least(F.greatest(F.col("wanted") / F.col("words"), F.lit(0.0)), F.lit(float(most)))
        base = F.floor("rate")
        wanted = F.col("n") * (F.col("rate") - base)  # more copies for the rows of the unit together
        sure = F.floor(wanted)
        now = units.filter(F.col("class") == r["class"]).alias("u").join(state.alias("s"), _same("u.source", "s.source"))
        now = now.select("u.*", rate.alias("rate")).withColumns({"base": base, "sure": sure}).withColumn("mass", F.floor((wanted - F.col("sure")) * F.col("size") * WORD))
        now = materialize(now, "wanted-copies")
        parts = [now.filter("mass = 0").select("source", "doc", "size", "n", F.col("sure").alias("more"), "base")]
        open_ = now.filter("mass > 0")
        if not open_.isEmpty():
            parts += _rounded(open_.select("source", "h", "doc", "size", "n", "sure", "base", "mass"), id_type, r["count"], seed, "rounded")
        done += parts
        if r is not classes[-1]:
            taken = reduce(DataFrame.unionByName, parts).groupBy("source").agg(
                F.sum(F.col("size") * (F.col("n") * F.col("base") + F.col("more"))).alias("taken"), F.sum(F.col("size") * F.col("n")).alias("size")
            )
            met = state.alias("s").join(taken.alias("t"), _same("s.source", "t.source"), "left")
            left = met.select("s.source", (F.col("wanted") - F.coalesce("taken", nothing)).alias("wanted"), (F.col("words") - F.coalesce("t.size", nothing)).alias("words"))
            state = materialize(left, "left-over")
    every = reduce(DataFrame.unionByName, done)
    turns = every.withColumn("turn", F.explode(F.sequence(nothing, F.floor((F.col("n") - 1) / COPIES)))).select(
        "source", "doc", "size", "base", "more", F.explode(F.sequence(F.col("turn") * COPIES, F.least(F.col("turn") * COPIES + COPIES, F.col("n")) - 1)).alias("i")
    )
    copies = F.col("base") + (F.col("i") < F.col("more")).cast("bigint")
    found = turns.alias("d").join(sources.alias("s"), _same("d.source", "s.source"))
    return found.select(F.col("doc").alias(key), F.col("d.source").alias(source), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
