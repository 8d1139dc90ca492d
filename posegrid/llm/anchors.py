"""Anchors of all 200-byte strings of a text: where equal strings must meet.

Of the ``K``-byte strings inside each ``LENGTH``-byte string, the one of least
hash is its anchor; equal strings have equal anchors at equal offsets.  So
strings need only be compared with strings of the same anchor.
"""

from __future__ import annotations

import numpy as np

from .shingles import mix, string_hashes

LENGTH, K = 200, 100
_W = LENGTH - K + 1
_U = np.uint64
#: The base of the rolling hash that chooses anchors, and its inverse.
_BASE = _U(0x9E3779B97F4A7C15)
_BACK = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes hashed at a time; pieces overlap so that no string is cut.
PIECE = 1 << 20


def _sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """The minimum or maximum of every run of ``w`` values."""
    n = len(x) - w + 1
    pad = -len(x) % w
    fill = x[-1:] if pad else x[:0]
    blocks = np.concatenate([x, np.repeat(fill, pad)]).reshape(-1, w)
    ahead = op.accumulate(blocks, 1).ravel()
    back = op.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return op(back[:n], ahead[w - 1 : w - 1 + n])


_UP = _DOWN = np.ones(1, _U)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if len(_UP) < n:
        up, down = np.full(n, _BASE, _U), np.full(n, _BACK, _U)
        up[0] = down[0] = 1
        _UP, _DOWN = np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)
    return _UP[:n], _DOWN[:n]


class Hashed:
    """Prefix sums that give the hash of any string of a piece of text."""

    def __init__(self, flat: np.ndarray):
        self.up, self.down = _powers(len(flat) + 1)
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum((flat.astype(_U) + _U(1)) * self.up[: len(flat)], dtype=_U)])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(_U))


def runs(raw: bytes) -> tuple[np.ndarray, ...]:
    """Anchor hash, run hash, anchor place, first and last start of each run.

    A run is a maximal range of string starts with the same anchor place; its run
    hash is that of all bytes its strings cover (not of the rolling kind, which
    would give some pairs of long strings the same hash).
    """
    flat = np.frombuffer(raw, np.uint8)
    total = len(flat) - LENGTH + 1
    if total <= 0:
        return (np.zeros(0, _U), np.zeros(0, _U), *(np.zeros(0, np.int64),) * 3)
    out = []
    for a in range(0, total, PIECE):
        b = min(total, a + PIECE)
        piece = flat[a : b + LENGTH - 1]
        h = Hashed(piece)
        at = np.arange(len(piece) - K + 1)
        own = h.of(at, at + K)
        least = _sliding(own, _W, np.minimum)
        # the leftmost place of the minimum: the first equal value at or after each start
        place = _first_equal(own, least)
        cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        first, last = cut, np.concatenate([cut[1:], [len(place)]]) - 1
        out.append((own[place[cut]], string_hashes(piece, first, last + LENGTH), place[cut] + a, first + a, last + a))
    return tuple(np.concatenate(x) for x in zip(*out))


def _first_equal(own: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each start, the first place in its window that has the window's least value."""
    n = len(least)
    # a place is a candidate for the starts of the last window that it is the minimum of
    place = np.full(n, -1, np.int64)
    changed = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    ends = np.concatenate([changed[1:], [n]])
    for s, e in zip(changed.tolist(), ends.tolist()):
        # within a stretch of equal minima the place moves only when it drops out
        v, p, k = least[s], -1, s
        while k < e:
            p = k + int(np.argmax(own[k : k + _W] == v))
            stop = min(e, p + 1)
            place[k:stop] = p
            k = stop
    return place
