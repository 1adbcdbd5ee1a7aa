"""Hashed word shingles of whole texts, as arrays."""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np

#: Bytes hashed at once; a longer text is cut at blanks.
BLOCK = 1 << 18
#: Words of more bytes are hashed one by one.
LONG_WORD = 1024
_ODD = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64
_MORE = _U(0x2545F4914F6CDD1D)
#: Masks of the low 0 to 8 bytes of a step.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number per byte value, and the powers of the base and of its inverse."""
    byte = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
    inverse = pow(int(_ODD), -1, 1 << 64)
    up = np.empty(BLOCK, dtype=np.uint64)
    down = np.empty(BLOCK + 1, dtype=np.uint64)
    up[0] = down[0] = 1
    np.multiply.accumulate(np.full(BLOCK - 1, _ODD), out=up[1:])
    np.multiply.accumulate(np.full(BLOCK, inverse, dtype=np.uint64), out=down[1:])
    return byte, up, down


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte range of ``data`` (at most ``BLOCK`` bytes), for ranges of a few hundred bytes.

    A polynomial modulo 2**64: ranges of 1,024 bytes and more can be made up that share a hash.
    """
    byte, up, down = _tables()
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(byte[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def chained_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte range, by two different chains over its eight-byte steps.

    Unlike a polynomial it is not a sum over the bytes, so no pattern of bytes cancels out.
    """
    padded = np.append(data, np.zeros(8, dtype=np.uint8))
    steps = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    length = ends - starts
    seed, step = length.astype(np.uint64) * _ODD, steps[starts] & _KEEP[np.minimum(length, 8)]
    one, two = mix(seed ^ step), mix(seed + step * _MORE)
    active = np.flatnonzero((length > 8) & (length <= LONG_WORD))
    at = 8
    while len(active):
        step = steps[starts[active] + at] & _KEEP[np.minimum(length[active] - at, 8)]
        one[active] = mix(one[active] ^ step)
        two[active] = mix(two[active] * _ODD + step)
        at += 8
        active = active[length[active] > at]
    out = mix(one + ((two << _U(32)) | (two >> _U(32))))
    for k in np.flatnonzero(length > LONG_WORD):
        out[k] = _long_hash(data[starts[k] : ends[k]].tobytes())
    return out


def _long_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def word_hashes(text: str) -> np.ndarray:
    """One hash per white-space separated word."""
    flat = " ".join(text.split()).encode("utf-8", "surrogatepass")
    found, at = [], 0
    while at < len(flat):
        end = len(flat)
        if end - at > BLOCK:
            end = flat.rfind(b" ", at, at + BLOCK)
            if end < 0:  # a word longer than a block
                end = flat.find(b" ", at)
                end = len(flat) if end < 0 else end
                found.append(np.array([_long_hash(flat[at:end])], dtype=np.uint64))
                at = end + 1
                continue
        data = np.frombuffer(flat[at:end], dtype=np.uint8)
        blanks = np.flatnonzero(data == 32)
        found.append(chained_hashes(data, np.append(0, blanks + 1), np.append(blanks, len(data))))
        at = end + 1
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words; a shorter text is one shingle, an empty one none."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    total = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        total = total * _ODD + words[k : k + n]
    return mix(total + _U(width))


@cache
def _multipliers(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    base = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * _ODD + _U(seed))
    return base[:count] | _U(1), base[count:]


def min_hashes(shingles: np.ndarray, count: int, seed: int = 7) -> np.ndarray:
    """``count`` minima over the shingles under different orders."""
    a, b = _multipliers(count, seed)
    low = np.full(count, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048]
        np.minimum(low, (part[None, :] * a[:, None] + b[:, None]).min(axis=1), out=low)
    return low


def band_hashes(minima: np.ndarray, rows: int) -> np.ndarray:
    """One signed 64-bit hash per band of ``rows`` minima, different for every band."""
    table = minima.reshape(-1, rows)
    total = np.arange(1, len(table) + 1, dtype=np.uint64) * _ODD
    for k in range(rows):
        total = mix(total * _ODD + table[:, k])
    return total.view(np.int64)


def bands_for(recall: float, similarity: float, rows: int) -> int:
    """Fewest bands of ``rows`` minima that let a pair of that similarity meet with that probability."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))
