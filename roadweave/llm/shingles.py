"""Word shingles as 64-bit hashes, vectorised over the bytes of many texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

STEP_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[32, *range(9, 14)]] = True
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: each input bit reaches each output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the process."""
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        size = max(n, 1 << 16)
        held = np.ones(size, dtype=np.uint64)
        done, factor = 1, base
        while done < size:
            take = min(done, size - done)
            held[done : done + take] = held[:take] * np.uint64(factor)
            done += take
            factor = factor * factor & _MASK
        _POWERS[base] = held
    return held[:n]


def _words_of(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word in lower-cased bytes."""
    inside = np.concatenate(([False], ~_SEPARATOR[b], [False]))
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turns[::2], turns[1::2]
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(BYTE_VALUES[b] * powers(_BASE, len(b)))))
    hashes = (sums[ends] - sums[starts]) * powers(_BASE_INVERSE, len(b) + 1)[starts]
    return starts, mix(hashes + (ends - starts).astype(np.uint64))


def _steps(text: bytes) -> Iterator[bytes]:
    """Parts of about ``STEP_BYTES`` that end at separators."""
    at = 0
    while at < len(text):
        end = at + STEP_BYTES
        while end < len(text) and not _SEPARATOR[text[end]]:
            end += 1
        yield text[at:end]
        at = end


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; with fewer words, the whole sequence is one; without words, none.

    Words are runs of characters other than blank and tab to carriage return, A-Z lower-cased.
    """
    coded = [(t or "").encode().translate(_LOWER) for t in texts]
    out, group, size = [], [], 0
    for text in [*coded, None]:
        if group and (text is None or size + len(text) > STEP_BYTES):
            out += _sets_of(group, words)
            group, size = [], 0
        if text is not None:
            group.append(text)
            size += len(text) + 1
    return out


def _sets_of(group: list[bytes], words: int) -> list[np.ndarray]:
    if len(group) == 1:
        hashes = [_words_of(np.frombuffer(p, dtype=np.uint8))[1] for p in _steps(group[0])]
        lists = [np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)]
    else:
        starts, hashes = _words_of(np.frombuffer(b" ".join(group), dtype=np.uint8))
        begins = np.cumsum([len(t) + 1 for t in group])[:-1]
        lists = np.split(hashes, np.searchsorted(starts, begins))
    out = []
    for h in lists:
        k = min(words, len(h))
        if k == 0:
            out.append(h)
            continue
        n = len(h) - k + 1
        s = mix(h[:n] + np.uint64(k))
        for j in range(1, k):
            s = mix(s * np.uint64(_BASE) + h[j : j + n])
        out.append(np.unique(s))
    return out
