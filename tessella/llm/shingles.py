"""Word shingle sets as 64-bit numbers, computed for many texts at once in numpy.

A word's number is a polynomial in its bytes modulo 2^64, taken from one prefix
sum over the whole buffer; a shingle's number mixes those of its words. Two
different shingles of a corpus share a number with odds of about 2^-64 a pair.
"""

from __future__ import annotations

import hashlib

import numpy as np

SIZE = 5
#: Bytes of text that one numpy pass takes at most (a longer text has a pass of its own).
PASS_BYTES = 2 << 20

#: A-Z to a-z; all white space of the contract to a line feed.
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else 10 if b == 32 or 9 <= b <= 13 else b for b in range(256))

_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


_known: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each; the largest asked for stay in memory."""
    if len(_known[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _known[i] = np.multiply.accumulate(p)
    return _known[0], _known[1]


def _word_numbers(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Number and start of each word of a cleaned buffer that ends in a line feed."""
    b = np.frombuffer(buffer, np.uint8)
    size = 1 << 12
    while size < len(b):
        size <<= 1
    up, down = _powers(size)
    is_word = b != 10
    edge = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
    if len(b) and is_word[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    total = np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)])
    before = np.where(starts > 0, total[starts - 1], np.uint64(0))
    return mix((total[ends - 1] - before) * down[starts]), starts


def passes(texts: list[bytes | None]):
    """Slices of ``texts`` with at most PASS_BYTES each."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or b"") <= PASS_BYTES):
            size += len(texts[end] or b"")
            end += 1
        yield at, end
        at = end


def shingle_sets(texts: list[bytes | None], size: int = SIZE) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted. A text of fewer words is one shingle; without words: empty."""
    out: list[np.ndarray] = []
    for at, end in passes(texts):
        part = [(t or b"").translate(_CLEAN) for t in texts[at:end]]
        buffer = b"\n".join(part) + b"\n"
        words, starts = _word_numbers(buffer)
        offsets = np.cumsum([0] + [len(t) + 1 for t in part])
        first = np.searchsorted(starts, offsets)
        numbers = np.zeros(max(0, len(words) - size + 1), np.uint64)
        for k in range(size):
            numbers += words[k : k + len(numbers)] * _MIX[k % 5] * np.uint64(2 * k + 1)
        numbers = mix(numbers)
        for a, b in zip(first[:-1], first[1:], strict=True):
            n = int(b - a)
            if n >= size:
                out.append(np.unique(numbers[a : b - size + 1]))
            elif n:
                x = np.uint64(n)
                with np.errstate(over="ignore"):
                    for w in words[a:b]:
                        x = mix(np.array([x * _MIX[2] + w], np.uint64))[0]
                out.append(np.array([x], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def set_key(shingles: np.ndarray) -> int:
    """A signed 64-bit key of a set (a cryptographic hash of its sorted numbers)."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)
