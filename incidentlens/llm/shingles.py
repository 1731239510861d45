"""Word shingle sets of whole texts as 64-bit hashes, computed over a batch of texts at once with numpy.

Words are hashed by a polynomial over their bytes, for all words of a batch from one running sum; a shingle's hash
combines five word hashes in order. Batches are cut into pieces of about ``PIECE_BYTES``, so memory is
bounded by the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

SHINGLE_WORDS = 5
PIECE_BYTES = 1 << 18

_WORD_BYTE = np.ones(256, dtype=bool)
_WORD_BYTE[[32, *range(9, 14)]] = False
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_PLACE = mix64(np.arange(1, SHINGLE_WORDS + 1, dtype=np.uint64)) | np.uint64(1)


def _powers_to(length: int) -> tuple[np.ndarray, np.ndarray]:
    powers, inverses = np.full(length, _BASE), np.full(length, _INVERSE)
    powers[0] = inverses[0] = 1
    return np.multiply.accumulate(powers), np.multiply.accumulate(inverses)


@lru_cache(maxsize=1)
def _usual_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers_to(PIECE_BYTES + (PIECE_BYTES >> 2))


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; those for a longer text are not kept."""
    return _usual_powers() if size <= PIECE_BYTES + (PIECE_BYTES >> 2) else _powers_to(size)


def pieces(texts: list[str | None]) -> Iterator[list[bytes]]:
    """The texts in order, A-Z lower-cased, in lists of about ``PIECE_BYTES``; None is empty."""
    piece, size = [], 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        if piece and size + len(data) > PIECE_BYTES:
            yield piece
            piece, size = [], 0
        piece.append(data)
        size += len(data) + 1
    if piece:
        yield piece


def word_hashes(piece: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and how many words each text has."""
    joined = np.frombuffer(b"\n".join(piece) + b"\n", dtype=np.uint8)
    inside = _WORD_BYTE[joined]
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edges[0::2], edges[1::2]
    powers, inverses = _powers(len(joined) + 1)
    sums = np.empty(len(joined) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[joined] * powers[: len(joined)], out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))
    stops = np.cumsum([len(x) + 1 for x in piece])
    counts = np.diff(np.searchsorted(starts, stops), prepend=0)
    return hashes, counts


def shingle_sets(texts: list[str | None]) -> Iterator[list[np.ndarray]]:
    """For the texts in order, piece by piece: the sorted distinct shingle hashes of each."""
    for piece in pieces(texts):
        hashes, counts = word_hashes(piece)
        full = np.zeros(max(len(hashes) - SHINGLE_WORDS + 1, 0), dtype=np.uint64)
        for n in range(SHINGLE_WORDS):
            full += hashes[n: n + len(full)] * _PLACE[n]
        full = mix64(full)
        sets, at = [], 0
        for count in counts:
            if count >= SHINGLE_WORDS:
                sets.append(np.unique(full[at: at + count - SHINGLE_WORDS + 1]))
            elif count:
                whole = (hashes[at: at + count] * _PLACE[:count]).sum(dtype=np.uint64) + np.uint64(count)
                sets.append(mix64(np.array([whole], dtype=np.uint64)))
            else:
                sets.append(np.empty(0, dtype=np.uint64))
            at += count
        yield sets


def set_digest(values: np.ndarray) -> str:
    return hashlib.blake2b(values.tobytes(), digest_size=16).hexdigest()
