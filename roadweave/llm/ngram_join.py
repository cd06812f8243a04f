"""Exact Jaccard similarity join of shingle sets in a metric space (operator 3).

Jaccard distance is a metric.  A plain Voronoi partition of whole corpora prunes
nothing, because unrelated documents all lie at distance 1 of each other, so the
first level of regions uses shingles themselves: of two linked documents, one
of the ``n - ceil(t n) + 1`` first shingles (in any common order) is shared.  The
order puts shingles of rarely filled hash buckets first; the bucket counts cover
all documents and have a fixed size.

Each such region has a pivot, its least document.  Every document is measured
against its most frequent pivot, and what is linked that way is contracted.
Regions that still hold several components are joined again, whole and exactly:
pivots inside the region make Voronoi cells, a document is replicated to each
cell whose pivot is at most twice the radius farther than its own (triangle
inequality), and cells are joined recursively.  Components are united as links
are found and only links that unite two of them leave a task, so a group of
near copies gives as many links as it has members, not pairs.

A region that outgrows a task is dealt to blocks by hash, twice, and contracted
after each deal; most such regions are one component by then and done.  What
still has several is decided exactly: shells as wide as the radius around a
pivot hold documents of like distance, only blocks of the same or the next shell
can hold a link (triangle inequality again), and blocks of the region's largest
component don't meet each other.  No group and no task grows with the data.
Before sets travel, sketches of 256 bytes (counts by hash bucket, which bound an
intersection from above) drop the members of a region that can't be linked with
any other; regions of more than ``SCREEN_ROWS`` open members skip that filter.

Equal sets are one node, so copies never meet in pairs.  Nodes are named by 64
bits of a digest; where 64 further bits tell that sets of one name differ, both
together name them.

Cases: null and empty texts, and texts of separators only, have no shingles and
are linked with nothing; repeated rows are one node and get the same component;
a null key gets a null component unless a linked row has a key; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import map_groups, materialize, read
from .bpe import slices
from .components import components
from .shingles import shingle_sets

BUCKETS = 1 << 16
TILE_ROWS = 512
TILE_ITEMS = 1 << 21
SCREEN_ROWS = 4096
LEAF = 96
SKETCH = 256
PIVOTS = 6


def _bucket_counts(docs: DataFrame, text: str, words: int) -> np.ndarray:
    """How many shingles (distinct in their document) fall into each of ``BUCKETS`` hash buckets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                for s in shingle_sets(part.column(0).to_pylist(), words):
                    counts += np.bincount((s >> np.uint64(48)).astype(np.int64), minlength=BUCKETS) if len(s) > 4096 else 0
                    if len(s) <= 4096:
                        np.add.at(counts, (s >> np.uint64(48)).astype(np.int64), 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], ["bucket", "n"])

    found = docs.select(text).mapInArrow(work, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    rows = found.toArrow()
    counts = np.zeros(BUCKETS, dtype=np.int64)
    counts[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return counts


def _sketch(items: np.ndarray) -> bytes:
    """How many of the hashes fall into each of ``SKETCH`` buckets; empty where a count needs more than a byte."""
    counts = np.bincount(((items >> np.uint64(40)) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
    return b"" if counts.max() > 255 else counts.astype(np.uint8).tobytes()


def _digest(items: bytes) -> tuple[int, int]:
    """Two 64-bit names of a set."""
    made = hashlib.blake2b(items, digest_size=16).digest()
    return int.from_bytes(made[:8], "little", signed=True), int.from_bytes(made[8:], "little", signed=True)


def _signatures(docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """(row, doc, n, node, second, prefix, sketch) for each row."""
    counts = docs.sparkSession.sparkContext.broadcast(_bucket_counts(docs, text, words))
    key_type = docs.select(key).schema[0].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = counts.value
        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                sizes, names, prefixes, sketches = [], [], [], []
                for s in shingle_sets(part.column(1).to_pylist(), words):
                    n = len(s)
                    sizes.append(n)
                    sketches.append(_sketch(s))
                    names.append(_digest(s.tobytes()))
                    take = n - -(-percent * n // 100) + 1 if n else 0
                    if take < n:
                        rank = order[(s >> np.uint64(48)).astype(np.int64)]
                        least = np.lexsort((s, rank))[:take]
                        s = s[least]
                    prefixes.append(s.view(np.int64))
                ends = np.concatenate(([0], np.cumsum([len(p) for p in prefixes]))).astype(np.int32)
                flat = np.concatenate(prefixes) if prefixes else np.zeros(0, dtype=np.int64)
                nodes, seconds = (pa.array([x[i] for x in names], pa.int64()) for i in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int32()), nodes, seconds, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(sketches, pa.binary())],
                    ["doc", "n", "node", "second", "prefix", "sketch"],
                )

    made = docs.select(key, text).mapInArrow(work, f"doc {key_type}, n int, node bigint, second bigint, prefix array<bigint>, sketch binary")
    return materialize(made.withColumn("row", F.monotonically_increasing_id()), "signatures")


def _nodes(signatures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``signatures`` with names that only equal sets share, and one row of it for each name."""
    firsts = signatures.groupBy("node").agg(F.min("row").alias("row"), F.min("second").alias("lo"), F.max("second").alias("hi"))
    firsts = materialize(firsts, "firsts")
    shared = firsts.filter("lo != hi").select("node")
    if not shared.isEmpty():
        marked = signatures.join(shared.withColumn("shared", F.lit(True)), "node", "left")
        signatures = marked.withColumn("node", F.when(F.col("shared"), F.xxhash64("node", "second")).otherwise(F.col("node"))).drop("shared")
        signatures = materialize(signatures, "signatures")
        firsts = signatures.groupBy("node").agg(F.min("row").alias("row"))
    return signatures, materialize(signatures.join(firsts.select("row"), "row", "left_semi"), "nodes")


def _sets(docs: DataFrame, key: str, text: str, words: int, wanted: DataFrame) -> DataFrame:
    """(node, items) for ``wanted`` (doc, node, second), one row of ``docs`` for each node; items are the hashes as bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, 4 << 20):
                names, nodes, items = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True), [], []
                for (node, second), s in zip(names, shingle_sets(part.column(2).to_pylist(), words), strict=True):
                    raw = s.tobytes()
                    if _digest(raw)[1] == second:
                        nodes.append(node)
                        items.append(raw)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(items, pa.binary())], ["node", "items"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    met = rows.join(wanted, F.col("k").eqNullSafe(F.col("doc"))).select("node", "second", "t")
    sets = materialize(met.mapInArrow(work, "node bigint, items binary"), "sets")
    again = sets.groupBy("node").count().filter("count > 1")  # only where a key and its text are repeated
    return sets if again.isEmpty() else sets.dropDuplicates(["node"])


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets of distinct hashes have a similarity of ``percent`` at least."""
    n = len(a) + len(b)
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate((a, b)), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (n - shared)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked ones of ``pairs`` (a, b)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(i).to_pylist() for i in (2, 3))
            good = [_linked(np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64), percent) for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(work, "a bigint, b bigint")


def _similar(rows: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of sets of small integers, by products of 0/1 matrices over runs of columns."""
    width = 1 + max((int(r.max()) for r in [*rows, *others] if len(r)), default=-1)
    total = np.zeros((len(rows), len(others)), dtype=np.float32)
    step = max(1, (1 << 22) // max(1, len(rows) + len(others)))
    for at in range(0, width, step):
        left, right = (np.zeros((len(x), min(step, width - at)), dtype=np.float32) for x in (rows, others))
        for matrix, sets in ((left, rows), (right, others)):
            for i, s in enumerate(sets):
                lo, hi = np.searchsorted(s, (at, at + step))
                matrix[i, s[lo:hi] - at] = 1
        total += left @ right.T
    return total


def join_region(sets: list[np.ndarray], labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Places (i, j) of linked sets, one link for each two labels it unites: a forest of labels.  Sets are sorted and distinct.

    Voronoi cells around pivots, windows of twice the radius, recursion, and products at the leaves.
    Cells and leaves whose members are of one label by then are left out.
    """
    if len(sets) == 2:
        return [(0, 1)] if labels[0] != labels[1] and _linked(*sets, percent) else []
    n = np.array([len(s) for s in sets], dtype=np.float64)
    flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    values, inverse, seen = np.unique(flat, return_inverse=True, return_counts=True)
    name = np.full(len(values), -1, dtype=np.int64)
    name[seen > 1] = np.arange(int((seen > 1).sum()))  # what one set alone has is in no intersection
    local = [x[x >= 0] for x in np.split(name[inverse], np.cumsum(n.astype(np.int64))[:-1])]
    local = [np.sort(x) for x in local]
    radius = 1 - percent / 100
    label = np.unique(labels, return_inverse=True)[1]
    found: list[tuple[int, int]] = []
    stack = [np.arange(len(sets))]
    while stack:
        ids = stack.pop()
        if len(ids) < 2 or (label[ids] == label[ids[0]]).all():
            continue
        if len(ids) > LEAF:
            pivots = ids[np.linspace(0, len(ids) - 1, PIVOTS).astype(np.int64)]
            shared = _similar([local[i] for i in ids], [local[i] for i in pivots])
            distance = 1 - shared / (n[ids][:, None] + n[pivots][None, :] - shared)
            own = distance.min(axis=1, keepdims=True)
            inside = distance <= own + 2 * radius + 1e-6
            cells = {tuple(np.flatnonzero(inside[:, j])) for j in range(len(pivots))}
            if max(map(len, cells)) <= 0.8 * len(ids):
                stack += [ids[list(c)] for c in cells if len(c) > 1]
                continue
        for at in range(0, len(ids), 64):
            part, rest = ids[at : at + 64], ids[at:]
            if (label[rest] == label[rest[0]]).all():
                break
            shared = _similar([local[i] for i in part], [local[i] for i in rest]).astype(np.int64)
            union = n[part][:, None].astype(np.int64) + n[rest][None, :].astype(np.int64) - shared
            for i, hit in zip(part, 100 * shared >= percent * union, strict=True):
                others = rest[hit]
                while len(others := others[label[others] != label[i]]):
                    found.append((int(i), int(others[0])))
                    label[label == label[others[0]]] = label[i]
    return found


def _dealt(rows: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """``rows`` (node, n, ...) with the block of their group by ``keys``, and the number of its blocks; blocks have ``TILE_ROWS`` rows and ``TILE_ITEMS`` hashes on average at most."""
    most = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / TILE_ROWS), F.ceil(F.sum(F.col("n").cast("bigint")) / TILE_ITEMS))
    blocks = rows.groupBy(*keys).agg(most.cast("int").alias("blocks"))
    return rows.join(blocks, keys).withColumn("block", F.pmod(F.xxhash64("node", F.lit(seed)), "blocks").cast("int"))


def _tiles(rows: DataFrame) -> DataFrame:
    """``rows`` (p, node, n, cell, apart, ...) once for each tile they are needed in.

    A tile pairs two blocks of region p of the same cell or of neighbouring ones.
    Blocks of rows set apart don't meet each other.
    """
    dealt = _dealt(rows, ["p", "cell", "apart"], 0).withColumn("x", F.struct("cell", "apart", "block"))
    blocks = materialize(dealt.select("p", "x").distinct(), "blocks")
    near = F.abs(F.col("x.cell") - F.col("y.cell")) <= 1
    pairs = blocks.join(blocks.withColumnRenamed("x", "y"), "p").filter(near & (F.col("x") <= F.col("y")) & ~(F.col("x.apart") & F.col("y.apart")))
    sides = pairs.select("p", F.xxhash64("x", "y").alias("tile"), F.explode(F.array_distinct(F.array("x", "y"))).alias("x"))
    return dealt.join(sides, ["p", "x"]).select(*rows.columns, "tile")


def _screened(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(p, node): members of a region that may be linked with another member, by sketches alone.  None that is linked is lost.

    Who may be linked with the pivot stays at once and needs no comparison with its like.
    """
    pairs = members.select("p", "pn", "node", "n").distinct()
    used = pairs.select("node").union(pairs.select("p")).distinct()
    sketches = materialize(nodes.join(used, "node", "left_semi").select("node", "sketch"), "sketches")

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        out = np.ones(len(a), dtype=bool)
        known = np.flatnonzero((a.map(len) > 0).to_numpy() & (b.map(len) > 0).to_numpy())
        if len(known):
            x, y = (np.frombuffer(b"".join(c.iloc[known]), dtype=np.uint8).reshape(-1, SKETCH) for c in (a, b))
            most = np.minimum(x, y).sum(axis=1, dtype=np.int64)
            out[known] = 100 * most >= percent * (na.to_numpy()[known] + nb.to_numpy()[known] - most)
        return pd.Series(out)

    met = pairs.join(sketches, "node").join(sketches.select(F.col("node").alias("p"), F.col("sketch").alias("p_sketch")), "p")
    rows = met.select("p", "node", "n", "sketch", near("sketch", "p_sketch", F.col("n"), F.col("pn")).alias("main"), F.lit(0).alias("cell"))
    rows = materialize(rows, "screened")

    def work(batch: pa.RecordBatch, bounds: np.ndarray) -> pa.RecordBatch:
        main, n, own = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("main", "n", "node"))
        raw = batch.column("sketch").to_pylist()
        sketch = np.frombuffer(b"".join(x or b"\xff" * SKETCH for x in raw), dtype=np.uint8).reshape(-1, SKETCH)
        size = np.diff(bounds)
        group = np.repeat(np.arange(len(size)), size)
        asks = np.flatnonzero(~main)
        ends = np.cumsum(size[group[asks]])
        n, stays, at = n.astype(np.int64), np.zeros(batch.num_rows, dtype=bool), 0
        while at < len(asks):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 14), side="right")))
            some = asks[at:end]
            times = size[group[some]]
            left = np.repeat(some, times)
            right = np.arange(times.sum()) + np.repeat(bounds[group[some]] - np.cumsum(times) + times, times)
            small, large = np.minimum(n[left], n[right]), np.maximum(n[left], n[right])
            fit = (own[left] != own[right]) & (100 * small >= percent * large) & ~(stays[left] & stays[right])
            left, right = left[fit], right[fit]
            most = np.minimum(sketch[left], sketch[right]).sum(axis=1, dtype=np.int32).astype(np.int64)
            hit = 100 * most >= percent * (n[left] + n[right] - most)
            stays[left[hit]] = stays[right[hit]] = True
            at = end
        return batch.select(["p", "node"]).filter(pa.array(stays))

    regions = rows.groupBy("p").agg(F.count_if(~F.col("main")).alias("open"), F.count_if("main").alias("near")).filter("open > 0 OR near > 1")
    large = F.col("open") + F.col("near") > TILE_ROWS
    named = rows.join(regions, "p").withColumn("apart", F.col("main") & large)
    asked = named.filter((F.col("open") > 0) & (F.col("open") <= SCREEN_ROWS))
    wanted = ["p", "tile", "node", "n", "main", "sketch"]
    one = asked.filter(~large).withColumn("tile", F.lit(0).cast("bigint")).select(*wanted)
    several = _tiles(asked.filter(large).drop("open", "near")).select(*wanted)
    found = map_groups(one.unionByName(several), ["p", "tile"], work, "p bigint, node bigint")
    whole = named.filter((F.col("open") > SCREEN_ROWS) | (F.col("main") & (F.col("near") > 1))).select("p", "node")  # the pivot is near itself
    return found.unionByName(whole).distinct()


def _joined(dealt: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that unite different labels inside each tile of a region.  dealt: (p, tile, node, label)."""

    def work(batch: pa.RecordBatch, bounds: np.ndarray) -> pa.RecordBatch:
        nodes, labels = batch.column("node").to_numpy(), batch.column("label").to_numpy()
        items = [np.frombuffer(x, dtype=np.uint64) for x in batch.column("items").to_pylist()]
        found = [(x + i, x + j) for x, y in zip(bounds[:-1], bounds[1:], strict=True) for i, j in join_region(items[x:y], labels[x:y], percent)]
        at = np.array(found, dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(nodes[at[:, 0]]), pa.array(nodes[at[:, 1]])], ["a", "b"])

    met = dealt.select("p", F.col("tile").cast("bigint").alias("tile"), "node", "label").join(sets, "node")
    return map_groups(met, ["p", "tile"], work, "a bigint, b bigint")


def _several(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` (p, node, n) of regions with several labels, with each row's ``label``."""
    named = rows.join(labels, "node", "left").select("p", "node", "n", F.coalesce("label", "node").alias("label"))
    several = named.groupBy("p").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("p")
    return materialize(named.join(several, "p", "left_semi"), "regions")


def _shells(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``rows`` with ``cell``, the distance to the region's least node in whole radii; rows of its most frequent label are set ``apart``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                both = np.sort(np.concatenate((np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64))), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                union = len(both) - shared
                cells.append(100 * (union - shared) // max(1, union * (100 - percent)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cells, pa.int32())], ["p", "node", "n", "cell"])

    least = rows.groupBy("p").agg(F.min("node").alias("q"))
    met = rows.join(least, "p").join(sets, "node").join(sets.select(F.col("node").alias("q"), F.col("items").alias("q_items")), "q")
    cells = met.select("p", "node", "n", "items", "q_items").mapInArrow(work, "p bigint, node bigint, n int, cell int")
    counts = rows.groupBy("p", "label").count()
    largest = counts.groupBy("p").agg(F.max_by("label", F.struct("count", "label")).alias("largest"))
    named = rows.select("p", "node", "label").join(cells, ["p", "node"]).join(largest, "p")
    return materialize(named.select("p", "node", "n", "label", "cell", (F.col("label") == F.col("largest")).alias("apart")), "shells")


def _region_labels(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``labels`` (node, label) after the links inside each region.  members: (token, node, n, p)."""

    def with_links(links: DataFrame) -> DataFrame:
        more = materialize(links, "region-links")
        return labels if more.isEmpty() else materialize(components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more)), "labels")

    named = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_tokens = named.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("token")
    rows = named.join(open_tokens, "token", "left_semi").select("p", "node", "n").distinct()
    for seed in (1, 2):
        rows = _several(rows, labels)
        dealt = materialize(_dealt(rows, ["p"], seed), "dealt")
        labels = with_links(_joined(dealt.withColumnRenamed("block", "tile"), sets, percent))
        rows = dealt.filter("blocks > 1").select("p", "node", "n")  # the others are decided
        if rows.isEmpty():
            return labels
    rows = _several(rows, labels)
    return labels if rows.isEmpty() else with_links(_joined(_tiles(_shells(rows, sets, percent)), sets, percent))


def _members(nodes: DataFrame, percent: int) -> DataFrame:
    """(token, node, n, p, pn): regions with at least two documents of linkable sizes, and each one's pivot.

    Of two linked documents the smaller has a shared shingle even in its first
    ``n - ceil(2 t / (1 + t) n) + 1``.  Sizes are cut into classes one threshold
    wide; a document counts in its own and the next, so linkable sizes meet.
    """
    short = F.col("pos") <= F.col("n") - F.ceil(F.lit(2 * percent) * F.col("n") / (100 + percent) - 1e-9)
    tokens = nodes.select("node", "n", F.posexplode("prefix").alias("pos", "token")).select("node", "n", "token", short.alias("short"))
    groups = tokens.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.max("short").alias("short")).filter("lo != hi AND short")
    met = materialize(tokens.join(groups.select("token"), "token"), "met")

    own = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9)
    classed = met.withColumn("class", F.explode(F.array(own, own + 1))).withColumn("token", F.struct("token", "class")).drop("class")
    pivot = F.min(F.when(F.col("short"), F.struct("n", "node"))).alias("first")
    pivots = classed.groupBy("token").agg(pivot).filter("first is not null").select("token", F.col("first.node").alias("p"), F.col("first.n").alias("pn"))
    kept = classed.join(pivots, "token").filter("n >= pn")
    several = kept.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo != hi").select("token")
    return materialize(kept.join(several, "token", "left_semi").select("token", "node", "n", "p", "pn"), "members")


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id) for each row of ``docs``: components of links of ``percent`` similarity at least."""
    signatures, nodes = _nodes(_signatures(docs, key, text, words, percent))
    members = _members(nodes, percent)
    members = materialize(members.join(_screened(members, nodes, percent), ["p", "node"], "left_semi"), "members")
    near = (100 * F.col("pn") >= percent * F.col("n")) & (F.col("node") != F.col("p"))
    counted = members.filter(near).groupBy("node", "p").count().groupBy("node").agg(F.max(F.struct("count", "p")).alias("best"))
    stars = materialize(counted.select(F.col("node").alias("a"), F.col("best.p").alias("b")), "stars")

    used = members.select("node").distinct()
    sets = _sets(docs, key, text, words, nodes.join(used, "node", "left_semi").select("doc", "node", "second"))
    labels = materialize(components(materialize(_verified(stars, sets, percent), "verified")), "labels")
    labels = _region_labels(members.select("token", "node", "n", "p"), labels, sets, percent)

    alone = F.col("n") == 0
    named = signatures.select("doc", "n", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = materialize(named.select("doc", "n", "label"), "labelled")
    least_doc = materialize(named.filter(~alone).groupBy("label").agg(F.min("doc").alias("component_id")), "least")  # so that Spark can split a hot label in the join
    linked = named.filter(~alone).join(least_doc, "label").select(F.col("doc").alias(key), F.col("n").cast("bigint").alias("n_shingles"), "component_id")
    return linked.unionByName(named.filter(alone).select(F.col("doc").alias(key), F.lit(0).cast("bigint").alias("n_shingles"), F.col("doc").alias("component_id")))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(read(spark, sf_dir, "documents").select("doc_id", "text"), words=3, percent=90)
