"""Dynamic time warping of two recordings in little memory.

Totals are computed one anti-diagonal after the other, and what two neighbouring
anti-diagonals hold is kept only now and then.  The path is found from its end:
between two kept places, all cells that can lie on it are a cone of cells behind
the one that was reached, so only the cone is computed again, with the very
numbers of the first pass; ties fall as they would in the whole matrix.  For two
recordings of n frames about n^(4/3) numbers are held at a time, not n^2.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Costs of cells ``i`` = a..b (from 1) on the anti-diagonal ``i + j = k``.
Costs = Callable[[int, int, int], np.ndarray]
#: The least number of anti-diagonals between two that are kept.
LEAST = 64


def warp(n: int, m: int, costs: Costs, every: int | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Total of the best path, and its cells (from 0) in order.

    Of equal ways back the diagonal is taken first, then up, then left.
    """
    if n == 0 or m == 0:
        return float("inf"), np.zeros(0, int), np.zeros(0, int)
    every = every or max(LEAST, int((32 * min(n, m) * (n + m) / 2) ** (1 / 3)))
    kept: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    before, now, spare = (np.full(n + 1, np.inf) for _ in range(3))
    before[0] = 0
    for k in range(2, n + m + 1):
        if (k - 2) % every == 0:
            a, b = max(0, k - 2 - m), min(n, k - 1) + 1
            kept.append((k - 1, a, before[a:b].copy(), now[a:b].copy()))
        a, b = max(1, k - m), min(n, k - 1)
        spare.fill(np.inf)
        spare[a : b + 1] = costs(k, a, b) + np.minimum(np.minimum(before[a - 1 : b], now[a - 1 : b]), now[a : b + 1])
        before, now, spare = now, spare, before
    total = float(now[n])
    i, j = n, m
    rows, cols = [], []
    while i > 0 and j > 0:
        while kept[-1][0] >= i + j:
            kept.pop()
        at, first, x, y = kept[-1]
        end, low = i + j, max(0, i - (i + j - at))
        steps = np.zeros((end - at, i - low + 1), np.uint8)
        # only rows low..i of the two anti-diagonals are needed
        before, now = (np.full(i - low + 2, np.inf) for _ in range(2))
        for buffer, held in ((before, x), (now, y)):
            a, b = max(low - 1, first), min(i, first + len(held) - 1)
            if a <= b:
                buffer[a - low + 1 : b - low + 2] = held[a - first : b - first + 1]
        for k in range(at + 1, end + 1):
            a, b = max(1, k - m, i - (end - k)), min(n, k - 1, i)
            spare = np.full(i - low + 2, np.inf)
            if a <= b:
                s = slice(a - low, b - low + 1)  # rows a-1..b-1; one further on: a..b
                t = slice(a - low + 1, b - low + 2)
                diagonal, up, left = before[s], now[s], now[t]
                spare[t] = costs(k, a, b) + np.minimum(np.minimum(diagonal, up), left)
                steps[k - at - 1, a - low : b - low + 1] = np.where((diagonal <= up) & (diagonal <= left), 0, np.where(up <= left, 1, 2))
            before, now = now, spare
        while i > 0 and j > 0 and i + j > at:
            rows.append(i - 1)
            cols.append(j - 1)
            step = steps[i + j - at - 1, i - low]
            i, j = i - (step != 2), j - (step != 1)
    return total, np.array(rows[::-1], int), np.array(cols[::-1], int)


def joint_costs(x: np.ndarray, y: np.ndarray, exponent: float) -> np.ndarray:
    """Confidence-weighted distance of frames, matched along the axes before the last two.

    The last two axes are joints and (x, y, z, confidence).
    """
    far = np.sqrt((x[..., 0] - y[..., 0]) ** 2 + (x[..., 1] - y[..., 1]) ** 2 + (x[..., 2] - y[..., 2]) ** 2)
    w = x[..., 3] * y[..., 3]
    return ((far * w).sum(-1) / (w.sum(-1) + 1e-8)) ** exponent


def pose_costs(x: np.ndarray, y: np.ndarray, exponent: float) -> Costs:
    """Of two recordings, (frames, joints, 4) each; joints lie in planes so that sums run along memory."""
    a, b = (np.ascontiguousarray(np.moveaxis(v, 2, 0)) for v in (x, y))

    def costs(k: int, first: int, last: int) -> np.ndarray:
        p, q = a[:, first - 1 : last], b[:, k - last - 1 : k - first][:, ::-1]
        return joint_costs(np.moveaxis(p, 0, -1), np.moveaxis(q, 0, -1), exponent)

    return costs


def value_costs(x: np.ndarray, y: np.ndarray) -> Costs:
    """Squared differences of two series."""
    return lambda k, first, last: (x[first - 1 : last] - y[k - last - 1 : k - first][::-1]) ** 2


def most_common(values: np.ndarray) -> int:
    """The most frequent value, the smallest of several."""
    found, counts = np.unique(values, return_counts=True)
    return int(found[counts.argmax()])
