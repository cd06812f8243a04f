"""Removal of long repeated byte strings with suffix arrays and the Burrows-Wheeler transform (operator 2).

Every byte covered by a ``min_bytes`` string that also starts anywhere else in
the corpus (the same document included) is removed.

1. Windows of ``min_bytes`` are dealt out by content: the least hash of their
   ``GRAM``-byte grams.  Runs of windows with one such anchor form a segment;
   equal windows have equal anchors wherever they stand.
2. Anchors that occur once, in their segment too, are dropped.  Segments that occur twice whole (anchor
   and a second 64-bit hash of all their bytes) are repeated window by window.
   What is left are segments that share an anchor but differ, mostly at the
   edges of repeated passages.
3. These are gathered in buckets of bounded size.  A task sorts the suffixes of
   its bucket, forms the Burrows-Wheeler transform and expands intervals breadth
   first by backward extension.  That yields common prefixes by increasing value;
   it stops at ``min_bytes``, and places that have none by then start a repeated
   string.
4. An anchor with more distinct segments than a bucket takes (at the edge of a
   passage in a large share of all documents) is split: windows are told apart by
   the place of the anchor in them, in two ranges, then four and so on, and by
   the bytes that all windows of a range have in common.  Equal windows stay
   together.  Steps 2 and 3 follow for the parts, until each fits a bucket; in
   the end a range is one place, and what it has in common is the whole window.

Nothing but counts reaches the driver, and no group grows with the data.

Cases: a null text is empty; texts shorter than ``min_bytes`` lose nothing;
repeated rows repeat each other, so both lose every such string; a null key is a
document of its own; an empty table gives an empty result; other columns are
carried along by ``remove_repeats`` and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, read
from .bpe import slices
from .shingles import BYTE_VALUES, STEP_BYTES, mix, powers

MIN_BYTES = 200
GRAM = 32
BUCKET_BYTES = 1 << 21
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)


def _prefix(b: np.ndarray, which: int) -> np.ndarray:
    """Sums of a polynomial hash; ``_hash`` takes the hash of any substring from them."""
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[b] * powers(_BASES[which], len(b)), out=sums[1:])
    return sums


def _hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(_INVERSES[which], len(sums))[starts])


def segments_of(text: bytes, min_bytes: int) -> tuple[np.ndarray, ...]:
    """(anchor, segment hash, first window, number of windows, whether the anchor occurs twice) of a text's segments, in order."""
    out = []
    n_windows = len(text) - min_bytes + 1
    for at in range(0, max(0, n_windows), STEP_BYTES):
        b = np.frombuffer(text, dtype=np.uint8, count=min(len(text) - at, STEP_BYTES + min_bytes - 1), offset=at)
        windows = len(b) - min_bytes + 1
        gram = min(GRAM, min_bytes)
        sums = _prefix(b, 0)
        grams = mix((sums[gram:] - sums[:-gram]) * powers(_INVERSES[0], len(sums))[: len(b) - gram + 1])
        width, least, have = min_bytes - gram + 1, grams, 1
        while 2 * have <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        least = np.minimum(least[:windows], least[width - have : width - have + windows])
        turn = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        gaps = np.diff(np.concatenate((turn, [windows])))
        if (gaps > width).any():  # one gram again and again: cut evenly
            turn = np.concatenate([np.arange(t, t + g, width) for t, g in zip(turn, gaps, strict=True)])
            gaps = np.diff(np.concatenate((turn, [windows])))
        spans = gaps + width - 1
        begins = np.concatenate(([0], np.cumsum(spans)))
        places = np.repeat(turn - begins[:-1], spans) + np.arange(begins[-1])
        times = np.add.reduceat((grams[places] == np.repeat(least[turn], spans)).astype(np.int32), begins[:-1])
        out.append((least[turn], _hash(_prefix(b, 1), turn, turn + gaps + min_bytes - 1, 1), turn + at, gaps, times > 1))
    if not out:
        return tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int64, bool))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _anchors(docs: DataFrame, min_bytes: int) -> DataFrame:
    """(row, k, rid, segs): the segments of each row of (k, rid, t)."""
    key_type = docs.schema["k"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, 2 << 20):
                found = [segments_of(t or b"", min_bytes) for t in part.column(2).to_pylist()]
                ends = np.concatenate(([0], np.cumsum([len(f[0]) for f in found]))).astype(np.int32)
                flat = [np.concatenate([f[i] for f in found]) for i in range(5)]
                segs = pa.StructArray.from_arrays(
                    [pa.array(flat[0].view(np.int64)), pa.array(flat[1].view(np.int64)), pa.array(flat[2]), pa.array(flat[3].astype(np.int32)), pa.array(flat[4])],
                    ["h", "s", "start", "n", "twice"],
                )
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(ends), segs)], ["k", "rid", "segs"])

    made = docs.select("k", "rid", "t").mapInArrow(work, f"k {key_type}, rid bigint, segs array<struct<h:bigint,s:bigint,start:bigint,n:int,twice:boolean>>")
    return materialize(made.withColumn("row", F.monotonically_increasing_id()), "anchors")


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Places sorted by the ``depth`` symbols that follow them (at least), by prefix doubling."""
    rank, have = symbols.astype(np.int64), 1
    n = len(rank)
    if n == 0:
        return rank
    packed = np.zeros(n, dtype=np.uint64)
    while have < 6:  # nine bits a symbol: six symbols in one number
        have += 1
    for j in range(min(have, n)):
        packed[: n - j] |= rank[j:].astype(np.uint64) << np.uint64(9 * (have - 1 - j))
    order = np.argsort(packed, kind="stable")
    new = np.concatenate(([False], packed[order][1:] != packed[order][:-1]))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.cumsum(new) + 1
    while have < min(depth + 1, n) and rank.max() < n:
        key = rank << 32
        key[: n - have] |= rank[have:]
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([False], key[order][1:] != key[order][:-1]))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(new) + 1
        have *= 2
    return order


def expand_intervals(symbols: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each place of the suffix array but the first, whether it shares at least ``depth`` symbols with the one before.

    Breadth-first backward extension on the Burrows-Wheeler transform: intervals
    of strings of length l give those of length l + 1, and an interval's right
    end that is met first at length l has a common prefix of l.
    """
    n = len(symbols)
    codes = symbols[order - 1].astype(np.int64)
    counts = np.bincount(codes)
    kinds = len(counts)
    last_to_first = np.empty(n, dtype=np.int64)
    last_to_first[np.argsort(codes, kind="stable")] = np.arange(n)
    unset = np.ones(n + 1, dtype=bool)
    unset[0] = unset[n] = False
    lo, hi = np.array([0]), np.array([n])
    for _ in range(depth):
        if not len(lo):
            break
        sizes = hi - lo
        one = lo[sizes == 1]  # of a single suffix there is one extension
        lo, sizes = lo[sizes > 1], sizes[sizes > 1]
        begins = np.concatenate(([0], np.cumsum(sizes)))
        places = np.repeat(lo - begins[:-1], sizes) + np.arange(begins[-1])
        key = np.repeat(np.arange(len(lo)) * kinds, sizes) + codes[places]
        by_key = np.argsort(key, kind="stable")
        turn = np.flatnonzero(np.concatenate(([True], np.diff(key[by_key]) != 0))) if len(key) else np.zeros(0, dtype=np.int64)
        ends = np.concatenate((turn[1:], [len(key)])) - 1 if len(key) else turn
        # the first and the last suffix of an interval that a character extends bound the new interval
        new_lo = np.concatenate((last_to_first[places[by_key[turn]]], last_to_first[one]))
        new_hi = np.concatenate((last_to_first[places[by_key[ends]]], last_to_first[one])) + 1
        fresh = np.flatnonzero(unset[new_hi])
        met, at = np.unique(new_hi[fresh], return_index=True)
        unset[met] = False
        lo, hi = new_lo[fresh[at]], met
    return unset[1:n]


def repeated_windows(texts: list[bytes], min_bytes: int) -> list[np.ndarray]:
    """For each text, the starts of its ``min_bytes`` strings that also start elsewhere in ``texts``."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.concatenate(([0], np.cumsum(sizes + 1)))
    symbols = np.ones(int(begins[-1]) + 1, dtype=np.int16)  # 1 ends a text, 0 ends all
    symbols[-1] = 0
    for t, at in zip(texts, begins, strict=False):
        symbols[at : at + len(t)] = np.frombuffer(t, dtype=np.uint8).astype(np.int16) + 2
    if len(symbols) < 2:
        return [np.zeros(0, dtype=np.int64) for _ in texts]
    order = suffix_array(symbols, max(min_bytes, 1))
    shared = expand_intervals(symbols, order, min_bytes)
    repeated = np.zeros(len(symbols), dtype=bool)
    repeated[order[1:][shared]] = True
    repeated[order[:-1][shared]] = True
    return [np.flatnonzero(repeated[at : at + max(0, size - min_bytes + 1)]) for at, size in zip(begins, sizes, strict=False)]


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """(first, number) of the runs of consecutive numbers."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) != 1) + 1
    return [(int(r[0]), len(r)) for r in np.split(starts, cut)]


def _texts(docs: DataFrame, places: DataFrame, min_bytes: int) -> DataFrame:
    """``places`` (k, rid, row, h, start, n) with their bytes."""
    by_row = places.groupBy("k", "rid").agg(F.collect_set(F.struct("row", "h", "start", "n")).alias("segs"))
    same = F.col("d.k").eqNullSafe(F.col("p.k")) & (F.col("d.rid") == F.col("p.rid"))
    met = docs.alias("d").join(by_row.alias("p"), same).select("d.t", F.explode("p.segs").alias("g"))
    return met.select("g.row", "g.h", "g.start", "g.n", F.expr(f"substring(t, cast(g.start + 1 as int), g.n + {min_bytes - 1})").alias("bytes"))


def _bucket_runs(texts: DataFrame, buckets: int, min_bytes: int) -> DataFrame:
    """(row, start, n): runs of repeated windows among the segments of each bucket."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        found = repeated_windows(list(pdf["bytes"]), min_bytes)
        rows = [(r, s + a, n) for r, s, w in zip(pdf["row"], pdf["start"], found, strict=True) for a, n in _runs(w)]
        return pd.DataFrame(rows, columns=["row", "start", "n"]).astype({"row": "int64", "start": "int64", "n": "int32"})

    dealt = texts.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInPandas(work, "row bigint, start bigint, n int")


def parts_of(text: bytes, anchor: int, parts: int, min_bytes: int) -> list[tuple[int, int, int]]:
    """(name, first window, number of windows) of the runs of a segment's windows that have the anchor in one of ``parts`` ranges of places.

    The name is made of the anchor, the range and the bytes that every window with the anchor in that range has.
    """
    b = np.frombuffer(text, dtype=np.uint8)
    gram = min(GRAM, min_bytes)
    width, windows = min_bytes - gram + 1, np.arange(len(b) - min_bytes + 1)
    sums = _prefix(b, 0)
    grams = mix((sums[gram:] - sums[:-gram]) * powers(_INVERSES[0], len(sums))[: len(b) - gram + 1])
    met = np.flatnonzero(grams == np.int64(anchor).astype(np.uint64))
    at = met[np.searchsorted(met, windows)]  # of each window, the first place of the anchor
    part = (at - windows) * parts // width
    turn = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (part[1:] != part[:-1]))))
    at, part = at[turn], part[turn]
    least, most = -(-part * width // parts), -(-(part + 1) * width // parts) - 1
    common = _hash(sums, at - least, at + min_bytes - most, 0)
    names = mix(common ^ mix(np.int64(anchor).astype(np.uint64) + (part.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASES[1]) * np.uint64(parts)))
    return list(zip(names.view(np.int64).tolist(), turn.tolist(), np.diff(np.concatenate((turn, [len(windows)]))).tolist(), strict=True))


def _split(texts: DataFrame, parts: int, min_bytes: int) -> DataFrame:
    """(row, anchor, h, s, start, n, bytes): segments (row, anchor, start, bytes) cut into parts, h being the part's name and s a hash of its bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 3, 1 << 20):
                out: list[tuple] = []
                for row, anchor, start, text in zip(*(some.column(i).to_pylist() for i in range(4)), strict=True):
                    b = np.frombuffer(text, dtype=np.uint8)
                    found = parts_of(text, anchor, parts, min_bytes)
                    firsts, counts = (np.array([f[i] for f in found], dtype=np.int64) for i in (1, 2))
                    hashes = _hash(_prefix(b, 1), firsts, firsts + counts + min_bytes - 1, 1).view(np.int64).tolist()
                    out += [(row, anchor, name, x, start + first, n, text[first : first + n + min_bytes - 1]) for (name, first, n), x in zip(found, hashes, strict=True)]
                types = [pa.int64()] * 5 + [pa.int32(), pa.binary()]
                columns = zip(*out, strict=True) if out else [[]] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["row", "anchor", "h", "s", "start", "n", "bytes"])

    return texts.select("row", "anchor", "start", "bytes").mapInArrow(work, "row bigint, anchor bigint, h bigint, s bigint, start bigint, n int, bytes binary")


def _crowded_runs(texts: DataFrame, min_bytes: int, bucket_bytes: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Runs (row, start, n) of repeated windows among segments of crowded anchors, and what is left for buckets (row, h, start, n, bytes)."""
    decided, small, parts, texts = [], [], 1, texts.withColumn("anchor", F.col("h"))
    while not texts.isEmpty():
        parts *= 2
        cut = materialize(_split(texts, parts, min_bytes), "split")
        kinds = materialize(cut.groupBy("h", "s").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("row", "start")).alias("one"), F.max("n").alias("n")), "split-kinds")
        decided.append(cut.join(kinds.filter("c > 1").select("h", "s"), ["h", "s"], "left_semi").select("row", "start", "n"))
        names = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.min("c").alias("least"), F.sum(F.col("n") + min_bytes).alias("size"))
        names = names.filter("kinds > 1 AND least = 1").select("h", (F.col("size") > bucket_bytes // 2).alias("crowded"))
        ones = kinds.join(names, "h").select("h", "s", "one.row", "one.start", "crowded")
        left = materialize(cut.join(ones, ["h", "s", "row", "start"]).select("row", "anchor", "h", "start", "n", "bytes", "crowded"), "split-open")
        small.append(left.filter("NOT crowded").drop("crowded", "anchor"))
        texts = left.filter("crowded").drop("crowded")
    return decided, small


def repeats(docs: DataFrame, min_bytes: int = MIN_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(k, rid, spans) of the rows of (k, rid, t) that have repeated strings: first window and number of windows, in any order."""
    anchors = _anchors(docs, min_bytes)
    segs = anchors.select("row", F.explode("segs").alias("g")).select("row", "g.h", "g.s", "g.start", "g.n", "g.twice")
    groups = segs.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("s").alias("lo"), F.max("s").alias("hi"), F.max("twice").alias("twice"))
    groups = materialize(groups.filter("c > 1 OR twice").select("h", F.expr("lo != hi OR c = 1").alias("mixed")), "groups")  # so that Spark can split a hot anchor in the join
    met = segs.drop("twice").join(groups, "h")
    met = materialize(met, "shared")
    mixed = met.filter("mixed").groupBy("h", "s").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("row", "start", "n")).alias("one"))
    mixed = materialize(mixed, "mixed")
    open_anchors = mixed.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.min("c").alias("least"), F.sum(F.col("one.n") + min_bytes).alias("size"))
    crowded = F.col("size") > bucket_bytes // 2
    open_anchors = materialize(open_anchors.filter("least = 1").select("h", crowded.alias("crowded")), "open")
    places = mixed.join(open_anchors, "h").select("h", "one.row", "one.start", "one.n", "crowded")
    places = places.join(anchors.select("row", "k", "rid"), "row")
    texts = _texts(docs, places, min_bytes).join(open_anchors, "h")
    texts = materialize(texts.select("row", "h", "start", "n", "bytes", "crowded"), "open-texts")
    decided, small = _crowded_runs(texts.filter("crowded").drop("crowded"), min_bytes, bucket_bytes)
    for part in small:
        texts = texts.filter("NOT crowded").unionByName(part.withColumn("crowded", F.lit(False)))
    texts = texts.filter("NOT crowded").drop("crowded")
    total = texts.agg(F.sum(F.length("bytes") + 1)).first()[0] or 0
    sure = met.filter("NOT mixed").select("row", "start", "n")
    twice = met.filter("mixed").join(mixed.filter("c > 1").select("h", "s"), ["h", "s"], "left_semi").select("row", "start", "n")
    all_runs = sure.unionByName(twice).unionByName(_bucket_runs(texts, int(total // bucket_bytes) + 1, min_bytes))
    for part in decided:
        all_runs = all_runs.unionByName(part)
    by_row = all_runs.groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    named = by_row.join(anchors.select("row", "k", "rid"), "row")
    return materialize(named.groupBy("k", "rid").agg(F.flatten(F.collect_list("spans")).alias("spans")), "repeats")


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(F.col(key).alias("k"), t.alias("t")).withColumn("rid", F.xxhash64("t"))


def cut(text: bytes, spans: list[tuple[int, int]], min_bytes: int) -> tuple[bytes, int, int]:
    """What is left of ``text``, the number of bytes removed and the number of maximal removed runs."""
    out, at, removed, runs = [], 0, 0, 0
    for start, n in sorted(spans):
        end = start + n + min_bytes - 1
        if start > at or (runs == 0 and start == 0):
            out.append(text[at:start])
            runs += 1
            removed += end - start
            at = end
        elif end > at:
            removed += end - at
            at = end
    out.append(text[at:])
    return b"".join(out), removed, runs


def _cut_rows(docs: DataFrame, key: str, text: str, min_bytes: int, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with the spans of each row: column ``spans``; and the text as bytes ``t``."""
    keyed = _keyed(docs, key, text)
    found = repeats(keyed, min_bytes, bucket_bytes)
    rows = docs.withColumn("t", F.coalesce(F.col(text), F.lit("")).cast("binary")).withColumn("rid", F.xxhash64("t")).alias("d")
    same = F.col(f"d.{key}").eqNullSafe(F.col("p.k")) & (F.col("d.rid") == F.col("p.rid"))
    return rows.join(found.select("k", "rid", "spans").alias("p"), same, "left").select("d.*", "p.spans")


def repeated_spans(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_bytes: int = MIN_BYTES, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans, kept (binary)."""
    key_type = docs.select(key).schema[0].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                texts, spans = part.column(1).to_pylist(), part.column(2).to_pylist()
                found = [cut(t, [(s["start"], s["n"]) for s in x or ()], min_bytes) for t, x in zip(texts, spans, strict=True)]
                columns = [part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()), pa.array([f[0] for f in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "n_bytes", "n_removed", "n_spans", "kept"])

    rows = _cut_rows(docs.select(key, text), key, text, min_bytes, bucket_bytes).select(key, "t", "spans")
    made = rows.mapInArrow(work, f"key {key_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return made.withColumnRenamed("key", key)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", min_bytes: int = MIN_BYTES) -> DataFrame:
    """``docs`` with repeated strings cut from the text; bytes of characters cut in two go as well. Null texts become empty."""

    @F.pandas_udf("string")
    def left(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series(
            [cut(t, [(s["start"], s["n"]) for s in x], min_bytes)[0].decode(errors="ignore") if x is not None else t.decode() for t, x in zip(texts, spans, strict=True)]
        )

    return _cut_rows(docs, key, text, min_bytes).withColumn(text, left("t", "spans")).select(*docs.columns)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
