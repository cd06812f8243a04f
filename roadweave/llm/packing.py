"""Harmonic packing of token sequences (operator 7).

Lengths fall into reciprocal-capacity classes: class ``k`` takes pieces of at
most ``capacity // k`` tokens, and each of its bins takes exactly ``k`` pieces.
So a bin is full after a fixed count, no search over open bins is needed, and
every task fills its own bins.  Documents are cut to sizes that classes take
without waste: whole capacities first, then, while the rest is long, the largest
reciprocal size that fits in it.  What a task's last bins leave over is packed
by first fit at the end of the task.

Memory is one batch of texts plus the open bins (at most ``capacity`` pieces a
class).  There is no shuffle.

Cases: a null or empty text is the end token alone; a text longer than a
sequence gives several pieces; repeated rows are packed one by one; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import read
from .bpe import Encoder, slices

CAPACITY = 2048
END_ID = 1
CUT_CLASSES = 8


def classes(capacity: int) -> list[int]:
    """Bin counts of the classes: every count up to 16, then about four to each doubling, so that few bins stay open."""
    counts = list(range(1, 17))
    while counts[-1] < capacity:
        counts.append(min(capacity, max(counts[-1] + 1, counts[-1] * 5 // 4)))
    return counts


def piece_lengths(n: int, capacity: int, cut_classes: int = CUT_CLASSES) -> list[int]:
    """Sizes of the pieces of a document of ``n`` tokens."""
    pieces = [capacity] * (n // capacity)
    rest = n % capacity
    while rest > capacity // cut_classes:
        size = capacity // -(-capacity // rest)
        pieces.append(size)
        rest -= size
    return pieces + [rest] * (rest > 0)


class _Bins:
    """The open bins of one task."""

    def __init__(self, capacity: int, task: int):
        self.capacity, self.counts = capacity, classes(capacity)
        self.of_length = np.zeros(capacity + 1, dtype=np.int64)
        for k in self.counts:
            self.of_length[1 : capacity // k + 1] = k
        self.open: dict[int, list] = {}
        self.next = task << 40
        self.done: list[tuple] = []

    def add(self, piece: tuple) -> None:
        k = int(self.of_length[piece[2]])
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) == k:
            self._close(self.open.pop(k))

    def _close(self, pieces: list) -> None:
        at = 0
        for piece in pieces:
            self.done.append((*piece, self.next, at))
            at += piece[2]
        self.next += 1

    def finish(self) -> None:
        rest = sorted((p for held in self.open.values() for p in held), key=lambda p: -p[2])
        self.open = {}
        bins: list[list] = []
        room: list[int] = []
        for piece in rest:
            at = next((i for i, r in enumerate(room) if r >= piece[2]), None)
            if at is None:
                bins.append([])
                room.append(self.capacity)
                at = len(bins) - 1
            bins[at].append(piece)
            room[at] -= piece[2]
        for held in bins:
            self._close(held)

    def take(self) -> list[tuple]:
        done, self.done = self.done, []
        return done


def pack(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """Pieces with their ids (binary, little-endian u32) and their place in a sequence.

    Columns: key, start, length, ids, doc_tokens, sequence_id, offset.
    """
    key_type = docs.select(key).schema[0].dataType.simpleString()
    names = ["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    end = np.array([end_id], dtype="<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, bins, key_arrow = Encoder.shared(path, None), _Bins(capacity, TaskContext.get().partitionId()), None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            types = [key_arrow, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            key_arrow = batch.schema.field(0).type
            for part in slices(batch, 1):
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    total, start = len(ids) // 4, 0
                    for size in piece_lengths(total, capacity):
                        bins.add((doc, start, size, ids[4 * start : 4 * (start + size)], total))
                        start += size
                if rows := [(d, s, n, i, t, q, o) for d, s, n, i, t, q, o in bins.take()]:
                    yield out(rows)
        bins.finish()
        if key_arrow is not None and (rows := bins.take()):
            yield out(rows)
        pa.default_memory_pool().release_unused()  # workers live on into other stages

    schema = f"key {key_type}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    return docs.select(key, text).mapInArrow(work, schema).withColumnRenamed("key", key)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
