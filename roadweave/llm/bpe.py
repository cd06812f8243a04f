"""Byte-level BPE encoding and decoding, and token ids for packing (operator 10).

The ``tokenizers`` library runs over Arrow batches.  A text is first cut before
each blank that a non-blank character follows: at these places every pattern of
the byte-level family ends a match, so the parts are encoded independently and
equal parts are encoded once (a bounded cache per worker, of two generations, so
that frequent parts stay when it is full; Arrow columns hold it and look it up).  What
the cache lacks is encoded as texts of some parts; ids are dealt back to parts by the
lengths of their bytes.  Long texts need little more memory than their own ids.  Decoding reverses the byte table: ids become
bytes first and the bytes are read as UTF-8 only when they are joined, so
characters split over several ids are whole again.

Cases: a null text is empty; an empty text has no ids; strings that look like
special tokens are ordinary text; repeated rows are encoded one by one; an empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ._common import read

CACHE_PARTS = 300_000
BATCH_PARTS = 4_096
JOINED_PARTS = 128
CACHED_BYTES = 48
_BREAK = re.compile(r" (?=\S)")
_ODD = re.compile(r" (?:\s|\Z)")


def byte_characters() -> dict[int, str]:
    """The byte-to-character table: printable Latin-1 bytes stand for themselves, the others follow from code point 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts whose merge makes ``token``: the last step of merging its bytes by ranks below its own."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


def tokenizer_from_ranks(path: str, pattern: str):
    """A ``tokenizers`` BPE model with the vocabulary of a rank file; ``pattern`` cuts the text before the merges."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, table = read_ranks(path), byte_characters()
    text = lambda token: "".join(table[b] for b in token)
    merges = [
        tuple(map(text, _merge_of(token, ranks))) for token, _ in sorted(ranks.items(), key=lambda x: x[1]) if len(token) > 1
    ]
    made = Tokenizer(models.BPE(vocab={text(token): rank for token, rank in ranks.items()}, merges=merges))
    made.pre_tokenizer = pre_tokenizers.Sequence(
        [
            pre_tokenizers.Split(Regex(pattern), behavior="isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ]
    )
    return made


def tokenizer_from_file(path: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    return made


def slices(batch: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose values in ``column`` have at most ``most`` bytes together, or a single row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield batch.slice(start)


_MADE: dict[tuple, Encoder] = {}


class _Held:
    """Words and their ids as two Arrow columns: some 50 bytes a word, where Python's own objects take over 200."""

    def __init__(self):
        self.words, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def __len__(self) -> int:
        return len(self.words)

    def add(self, words: pa.Array, ids: pa.Array) -> None:
        self.words, self.ids = pa.concat_arrays([self.words, words]), pa.concat_arrays([self.ids, ids])

    def find(self, words: pa.Array) -> np.ndarray:
        """Place of each word, or -1."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().copy()


def _column(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of ``ids`` that stop before ``ends``, as binary values."""
    bounds = np.concatenate(([0], 4 * ends)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(bounds), pa.py_buffer(ids)])


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes; one per worker process and vocabulary."""

    def __init__(self, tokenizer):
        self.tokenizer, self.known, self.before = tokenizer, _Held(), _Held()
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        self.lengths = np.zeros(1 + max(vocabulary.values()), dtype=np.int64)  # a character of a token stands for a byte
        self.lengths[list(vocabulary.values())] = list(map(len, vocabulary))

    @staticmethod
    def shared(path: str, pattern: str | None) -> Encoder:
        key = (path, pattern)
        if key not in _MADE:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use the cores
            _MADE[key] = Encoder(tokenizer_from_ranks(path, pattern) if pattern else tokenizer_from_file(path))
        return _MADE[key]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text.  What the cache lacks is encoded once for all ``texts``."""
        texts = [t or "" for t in texts]
        odd = [i for i, t in enumerate(texts) if _ODD.search(t)]
        held = set(odd)
        even = [i for i in range(len(texts)) if i not in held]
        out: list[bytes] = [b""] * len(texts)
        cut = pc.split_pattern(pa.array([texts[i] for i in even], pa.large_string()), " ")
        for rows, parts in ((even, cut), (odd, pa.array([_BREAK.split(texts[i]) for i in odd], pa.large_list(pa.large_string())))):
            if len(rows):
                for i, ids in zip(rows, self._encode_cut(parts), strict=True):
                    out[i] = ids
        return out

    def _encode_cut(self, cut: pa.Array) -> list[bytes]:
        """Ids of texts that are cut into parts; all parts but a text's first have lost the blank before them."""
        offsets = cut.offsets.to_numpy()
        words = cut.flatten().dictionary_encode()
        codes, first = words.indices.to_numpy(), offsets[:-1]
        rest = np.ones(len(codes), dtype=bool)
        rest[first] = False
        used = np.zeros(len(words.dictionary), dtype=bool)
        used[codes[rest]] = True
        places = np.flatnonzero(used)
        ids, of_word = self._ids(words.dictionary.take(pa.array(places)))
        place = np.zeros(len(used), dtype=np.int32)
        place[places] = of_word
        at = place[codes]
        at[first] = np.arange(len(ids), len(ids) + len(first))
        firsts = self._made(words.dictionary.take(pa.array(codes[first])))
        _, ends, flat = pa.concat_arrays([ids, firsts]).take(pa.array(at)).buffers()
        bounds, flat = np.frombuffer(ends, dtype=np.int64)[offsets].tolist(), memoryview(flat or b"")
        return [bytes(flat[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def _ids(self, distinct: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """A column of ids, and the place in it of each of the distinct words, with the blank before it."""
        known, before = self.known, self.before
        place = known.find(distinct)
        gaps = np.flatnonzero(place < 0)
        missed = distinct.take(pa.array(gaps))
        older = before.find(missed)
        new = np.flatnonzero(older < 0)
        older[new] = np.arange(len(before), len(before) + len(new))
        place[gaps] = len(known) + older
        ids = pa.concat_arrays([known.ids, before.ids, self._made(missed.take(pa.array(new)), blank=True)])
        self._keep(missed, ids.take(pa.array(place[gaps])))
        return ids, place

    def _keep(self, words: pa.Array, ids: pa.Array) -> None:
        short = pc.less_equal(pc.binary_length(words), CACHED_BYTES)
        words, ids = words.filter(short), ids.filter(short)
        while len(words):
            if len(self.known) >= CACHE_PARTS:
                self.known, self.before = _Held(), self.known
            room = CACHE_PARTS - len(self.known)
            self.known.add(words.slice(0, room), ids.slice(0, room))
            words, ids = words.slice(room), ids.slice(room)

    def _made(self, parts: pa.Array, blank: bool = False) -> pa.Array:
        """Ids of parts, some at a time, because the library's own records are many times as large as the ids."""
        made = [pa.array([], pa.large_binary())]
        for at in range(0, len(parts), BATCH_PARTS):
            some = parts.slice(at, BATCH_PARTS)
            made.append(self._encoded_joined(some) if blank else _column(*self._encoded(some.to_pylist())))
        return pa.concat_arrays(made)

    def _encoded_joined(self, words: pa.Array) -> pa.Array:
        """Ids of words that begin with no blank, each with a blank before it, so that no match reaches from one into the next.

        They are joined to texts of ``JOINED_PARTS`` words: a text for each word costs more, and so does a long text.
        """
        held = words.to_numpy(zero_copy_only=False).tolist()
        found, _ = self._encoded([" " + " ".join(held[i : i + JOINED_PARTS]) for i in range(0, len(held), JOINED_PARTS)])
        at, ends = np.cumsum(self.lengths[found]), np.cumsum(pc.binary_length(words).to_numpy() + 1)
        places = np.searchsorted(at, ends)
        if not len(at) or places[-1] >= len(at) or (at[places] != ends).any():
            return _column(*self._encoded([" " + word for word in held]))
        return _column(found, places + 1)

    def _encoded(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts, and where each part's end."""
        found = [x.ids for x in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        ends = np.cumsum(list(map(len, found)), dtype=np.int64)
        return np.fromiter(chain.from_iterable(found), dtype="<u4", count=ends[-1] if len(ends) else 0), ends


def offsets(tokenizer, text: str) -> list[tuple[int, int, int]]:
    """(id, first character, end character) of each id; ids that split a character name the whole character."""
    found = tokenizer.encode(text, add_special_tokens=False)
    return [(i, a, b) for i, (a, b) in zip(found.ids, found.offsets, strict=True)]


class Decoder:
    """Bytes of ids, by the rank file's own table."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def encode_decode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row: key, ids (binary, little-endian u32) and decoded bytes."""
    key_type = docs.select(key).schema[0].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder.shared(path, pattern), Decoder(path)
        for batch in batches:
            for part in slices(batch, 1):
                ids = encoder.encode(part.column(1).to_pylist())
                decoded = [decoder.decode(i) for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], ["key", "ids", "decoded"]
                )

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in work(batches):
            ids = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                    pa.array([hashlib.sha256(d).hexdigest() for d in batch.column(2).to_pylist()]),
                ],
                ["key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    source = docs.select(key, text)
    if with_ids:
        return source.mapInArrow(work, f"key {key_type}, ids binary, decoded binary").withColumnRenamed("key", key)
    made = source.mapInArrow(digests, f"key {key_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return made.withColumnRenamed("key", key)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents")
    return encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
