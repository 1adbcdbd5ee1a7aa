"""Sample positions of a byte string for the duplicate search of ``suffix_dedup``.

Every run of ``length`` bytes picks one of its ``gram``-byte substrings, the one with the
smallest hash (the leftmost of equals), so equal runs pick the same one wherever they
stand. The positions picked are the sample; about two of ``length - gram`` are in it.
"""

from __future__ import annotations

import numpy as np

from revlens.llm import shingles as S

#: Bytes sampled at once; neighbouring blocks overlap by a run.
BLOCK = S.BLOCK >> 1
_U = np.uint64
_LOW = _U((1 << 21) - 1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    starts = np.arange(len(data) - gram + 1)
    return S.range_hashes(data, starts, starts + gram)


def _sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from running minima of blocks of that width."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[: len(x)] = x
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def sample(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, hash of the gram there, hash of the bytes around it) of a byte string.

    The bytes around reach ``length - gram`` to the left and ``length`` from the position
    to the right, as far as the string does; they hold every run that picks the position.
    """
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
    reach = length - gram
    at = 0
    while len(data) - at >= length:
        block = data[at : at + BLOCK + length - 1]
        hashes = gram_hashes(block, gram)
        # the low bits give way to the place, so that the leftmost of equals is the smallest
        keyed = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
        picked = np.unique(_sliding_minimum(keyed, reach + 1) & _LOW).astype(np.int64)
        lo, hi = max(at - reach, 0), min(at + len(block) + length, len(data))
        wide = data[lo:hi]
        place = picked + at
        left, right = np.maximum(place - reach, 0), np.minimum(place + length, len(data))
        around = S.range_hashes(wide, left - lo, right - lo)
        around = S.mix(around + (place - left).astype(np.uint64) * _U(0x9E3779B97F4A7C15))
        found.append((place, hashes[picked], around))
        at += BLOCK
    place, grams, around = (np.concatenate(p) for p in zip(*found, strict=True))
    if len(found) > 2:  # a position may be picked by both blocks
        place, first = np.unique(place, return_index=True)
        grams, around = grams[first], around[first]
    return place, grams, around
