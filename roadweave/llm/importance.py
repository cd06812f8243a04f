"""Importance resampling towards a target distribution (operator 11), by batch concatenation.

The texts of a batch (about ``STEP_BYTES``) are lower-cased (A-Z) and joined with the
byte 0xFF, which UTF-8 never uses.  One regex pass finds all words and
separators; ``searchsorted`` on the separators' places tells each word's
document, n-grams that reach over a separator are masked, and ``bincount`` counts
buckets or sums gains.  A feature's bucket is the CRC-32 of its UTF-8 bytes; that
of a longer n-gram is carried on from the shorter one, so none is joined.

Two passes over the texts: counts per bucket of both corpora (a task sends one
row per bucket at most), then gains and scores.  What reaches the driver and all
tasks is one number per bucket.  Ranks come from a range partition and the
number of rows per task, so no task sorts all rows.

Cases: a null text has no words; a text beyond ``STEP_BYTES`` is cut between
words, and n-grams run over the cuts; a text that holds 0xFF is decoded with U+FFFD
in place of what is no UTF-8;
a null id is hashed as an empty string and comes last among ties; repeated rows
are drawn separately; empty tables (of either side) work; other columns are not
read, so their names can't clash.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import UPPER, materialize, ranked, read

STEP_BYTES = 1 << 20
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_TOKEN = re.compile(rb"\xff|[^\x00-\x2F\x3A-\x60\x7B-\x7F\xff]+")
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


def _parts(text: bytes, step: int) -> Iterator[bytes]:
    """Parts of about ``step`` bytes that end between words."""
    at = 0
    while True:
        gap = _GAP.search(text, at + step) if at + step < len(text) else None
        if not gap:
            yield text[at:]
            return
        yield text[at : gap.start()]
        at = gap.start()


def _coded(text: bytes | None) -> bytes:
    """Lower-cased bytes without 0xFF."""
    text = (text or b"").translate(_LOWER)
    return text.decode("utf-8", "replace").encode() if b"\xff" in text else text


def _batches(texts: list[bytes | None], step: int) -> Iterator[tuple[int, list[bytes], bool]]:
    """(first document, texts or one part, whether the part carries on its document) in batches of about ``step`` bytes."""
    group: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        text = _coded(t)
        if group and size + len(text) > step:
            yield i - len(group), group, False
            group, size = [], 0
        if len(text) > step:
            for n, part in enumerate(_parts(text, step)):
                yield i, [part], n > 0
        else:
            group.append(text)
            size += len(text) + 1
    if group:
        yield len(texts) - len(group), group, False


def features(texts: list[bytes | None], n: int, step: int = STEP_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, CRC-32, whether it is a single word) of every run of 1 to ``n`` words of UTF-8 texts, batch by batch."""
    carried: list[bytes] = []
    for first, group, goes_on in _batches(texts, step):
        head = carried if goes_on else []
        tokens = head + _TOKEN.findall(b"\xff".join(group))
        crc = np.fromiter(map(zlib.crc32, tokens), dtype=np.uint32, count=len(tokens))
        if len(group) > 1:
            breaks = np.fromiter((i for i, t in enumerate(tokens) if t == b"\xff"), dtype=np.int64, count=len(group) - 1)
        else:
            breaks = np.zeros(0, dtype=np.int64)
        document = np.searchsorted(breaks, np.arange(len(tokens)), side="left")
        word = np.ones(len(tokens), dtype=bool)
        word[breaks] = False
        for length in range(1, n + 1):
            if length > 1:
                crc = np.fromiter(map(zlib.crc32, (b" " + t for t in tokens[length - 1 :]), crc.tolist()[:-1]), dtype=np.uint32, count=max(0, len(tokens) - length + 1))
            k = len(crc)
            inside = document[:k] == document[length - 1 : length - 1 + k]  # no separator between the first word and the last
            inside &= word[:k] & word[length - 1 : length - 1 + k]
            inside[: max(0, len(head) - length + 1)] = False  # these ended in the part before
            yield first + document[:k][inside], crc[inside], np.full(int(inside.sum()), length == 1)
        carried = tokens[max(0, len(tokens) - n + 1) :] if n > 1 else []


def bucket_counts(docs: DataFrame, text: str, n: int, buckets: int) -> np.ndarray:
    """Features of all texts in each bucket: one row per bucket reaches the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, crc, _ in features(batch.column(0).to_pylist(), n):
                held += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(held[at])], ["bucket", "n"])

    found = docs.select(F.col(text).cast("binary")).mapInArrow(work, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, dtype=np.int64)
    for r in found:
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) for each bucket."""
    k = len(source)
    every_s, every_t = float(source.sum() + k), float(target.sum() + k)
    return np.array([math.floor(1000 * math.log((t + 1) * every_s / ((s + 1) * every_t))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def _scorer(gains: np.ndarray, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            words, count, weight = (np.zeros(rows, dtype=np.int64) for _ in range(3))
            for document, crc, single in features(batch.column(2).to_pylist(), n):
                if not len(document):
                    continue
                found = np.bincount(document, minlength=rows)
                count += found
                if single[0]:
                    words += found
                weight += np.bincount(document, weights=gains[crc % np.uint32(len(gains))], minlength=rows).astype(np.int64)
            noise = [math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))) for h in batch.column(1).to_pylist()]
            made = [words, count, weight, weight + np.array(noise, dtype=np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, made)], ["id", "n_words", "n_features", "weight", "score"])

    return work


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
    n: int = 1, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_features, weight, score, rank (1, 2, ... of those drawn, else null).

    Drawn are the ``percent`` of the documents of ``min_words`` or more whose log
    importance weight plus Gumbel noise (from a hash of seed and id) is highest:
    sampling without replacement in proportion to the weights.
    """
    gains = bucket_gains(bucket_counts(docs, text, n, buckets), bucket_counts(target, target_text, n, buckets))
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(key).alias("id"), F.conv(F.substring(named, 1, 8), 16, 10).cast("bigint").alias("h"), F.col(text).cast("binary").alias("text"))
    schema = T.StructType([rows.schema["id"], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight", "score"))])
    scored = materialize(rows.mapInArrow(_scorer(gains, n), schema), "scores")
    long = scored.filter(F.col("n_words") >= min_words).withColumn("_row", F.monotonically_increasing_id())  # of a written table, so it stays
    drawn = long.count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("weight"), F.asc("n_features"), F.asc("_row")]
    out = ranked(long, order, "rank", "ranks").drop("_row").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(
        scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("bigint"))
    )
    return out.withColumnRenamed("id", key)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def oracle_sql() -> str:
    """CRC-32 from its definition (the reflected polynomial 0xEDB88320, bit by bit) on distinct words."""
    low = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
    words = rf"regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    bit = "CASE WHEN {0} % 2 = 1 THEN xor({0} // 2, 3988292384) ELSE {0} // 2 END"
    steps = "b0 AS (SELECT i, i::BIGINT AS c FROM range(256) r(i))" + "".join(f", b{k + 1} AS (SELECT i, {bit.format('c')} AS c FROM b{k})" for k in range(8))
    return rf"""
WITH {steps}, tab AS (SELECT list(c ORDER BY i) AS t FROM b8),
src AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
doc_words AS (SELECT rid, word, count(*) AS n FROM (SELECT rid, unnest(w) AS word FROM src) GROUP BY rid, word),
target_words AS (SELECT word, count(*) AS n FROM (SELECT unnest({words}) AS word FROM benchmark) GROUP BY word),
vocabulary AS (SELECT DISTINCT word, hex(encode(word)) AS x FROM (SELECT word FROM doc_words UNION SELECT word FROM target_words)),
hashed AS (
  SELECT word, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, length(x) // 2 + 1), lambda i: ('0x' || substr(x, (2 * i - 1)::INT, 2))::BIGINT)),
    lambda c, b: xor(t[(xor(c, b) % 256 + 1)::INT], c // 256))) % {BUCKETS} AS bucket
  FROM vocabulary, tab),
s AS (SELECT bucket, sum(n) AS n FROM doc_words JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS n FROM target_words JOIN hashed USING (word) GROUP BY bucket),
gains AS (
  SELECT r.i AS bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM s), 0) + {BUCKETS})::DOUBLE
    / ((coalesce(s.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM range({BUCKETS}) r(i) LEFT JOIN s ON s.bucket = r.i LEFT JOIN t ON t.bucket = r.i),
weights AS (SELECT rid, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM doc_words JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY rid),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM src LEFT JOIN weights USING (rid)),
placed AS (
  SELECT *, n_features >= {MIN_WORDS} AS able, row_number() OVER (PARTITION BY n_features >= {MIN_WORDS} ORDER BY score DESC, doc_id) AS place,
    count(*) FILTER (n_features >= {MIN_WORDS}) OVER () * {PERCENT} // 100 AS drawn
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= drawn THEN place END AS rank FROM placed"""
