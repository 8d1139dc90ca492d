"""Word and shingle hashes of many texts at a time, in numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case.  A word is
hashed eight bytes at a time, each eight mixed with their place before they are
added, so no algebra of the bytes carries over to the hash; words of a batch
share array operations.
"""

from __future__ import annotations

import hashlib

import numpy as np

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of a text that ``words`` prepares at a time.
PIECE = 1 << 20
#: Strings of more bytes are hashed one by one.
LONGEST = 320
_STEP = _U(0x9E3779B97F4A7C15)
#: What is kept of eight bytes when only so many belong to the string.
_PART = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: So that the same eight bytes count differently at each place of a string.
_SALT = mix(np.arange(1, LONGEST // 8 + 1, dtype=np.uint64) * _STEP)


def string_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each string ``flat[start:end]`` of an array of bytes."""
    size = ends - starts
    held = np.concatenate([flat, np.zeros(LONGEST + 8, np.uint8)])
    # the eight bytes from each place on, as one number
    eight = np.ndarray(len(flat) + LONGEST, "<u8", held, strides=(1,))
    total = size.astype(_U) * _STEP
    live = np.flatnonzero(size <= LONGEST)
    steps = -(-int(size[live].max(initial=0)) // 8)
    if steps * len(live) <= 1 << 15:  # few strings: all their steps in one array
        j = np.arange(steps)
        left = np.clip(size[live][:, None] - 8 * j, 0, 8)
        total[live] += mix((eight[starts[live][:, None] + 8 * j] & _PART[left]) ^ _SALT[j]).sum(1, where=left > 0, dtype=_U)
    else:
        at, left = starts[live], size[live]
        for j in range(steps):
            more = left > 8 * j
            if not more.all():
                live, at, left = live[more], at[more], left[more]
            total[live] += mix((eight[at + 8 * j] & _PART[np.minimum(left - 8 * j, 8)]) ^ _SALT[j])
    for k in np.flatnonzero(size > LONGEST):
        total[k] = int.from_bytes(hashlib.blake2b(flat[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return mix(total)


def words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (bytes) of every word of a text."""
    flat = _LOWER[np.frombuffer(raw, np.uint8)]
    edge = np.diff(np.concatenate([[True], SPACE[flat], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    hashes = np.zeros(len(starts), _U)
    k = 0
    while k < len(starts):
        # whole words in a piece; a word that is longer than a piece gets its own
        stop = max(k + 1, int(np.searchsorted(ends, starts[k] + PIECE, side="right")))
        a, b = int(starts[k]), int(ends[stop - 1])
        hashes[k:stop] = string_hashes(flat[a:b], starts[k:stop] - a, ends[k:stop] - a)
        k = stop
    return hashes, starts, ends


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` words; fewer words are one run."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, _U)
    runs = max(1, n - width + 1)
    size = min(n, width)
    out = np.full(runs, size, _U)
    for j in range(size):
        out = (out * _U(0xD6E8FEB86659FD93) + hashes[j : j + runs]) ^ (out >> _U(29))
    return mix(out)


def shingle_set(raw: bytes, width: int) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    return np.unique(shingles(words(raw)[0], width))


def shingle_sets(texts: list[bytes], width: int, band: int = 1 << 20) -> list[np.ndarray]:
    """``shingle_set`` of each text; short texts share array operations."""
    out: list[np.ndarray] = []
    k = 0
    while k < len(texts):
        stop, size = k, 0
        while stop < len(texts) and (stop == k or size + len(texts[stop]) < band):
            size += len(texts[stop]) + 1
            stop += 1
        joined = b" ".join(texts[k:stop])
        hashes, starts, _ = words(joined)
        limits = np.cumsum([len(t) + 1 for t in texts[k:stop]])
        cuts = np.searchsorted(starts, limits)
        begin = 0
        for c in cuts:
            out.append(np.unique(shingles(hashes[begin:c], width)))
            begin = int(c)
        k = stop
    return out
