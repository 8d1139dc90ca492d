"""Assignments of greatest total similarity, of matrices that need not be held.

Shortest augmenting paths with potentials (the Hungarian method), begun well: a row
takes its best column if that is free; then rows bid for columns, each by as much as
its best is better than its second, and who is outbid bids again.  Only columns that
have an owner get a potential, so matrices need not be square.  Most rows are placed
by then; each of the others takes a path of its own.  Bids are limited in number and
not needed for the result: the paths are exact from any such beginning.

A row of the matrix is computed when it is looked at; rows are kept as long as all
of them go into ``HELD`` bytes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Bytes of a matrix that is kept, and bids for each row.
HELD, BIDS = 512 << 20, 8


def assign(similarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of an assignment of greatest total similarity."""
    flip = similarity.shape[0] > similarity.shape[1]
    cost = -(similarity.T if flip else similarity)
    rows, cols = _least(cost.shape[0], cost.shape[1], cost.__getitem__)
    return _ordered(rows, cols, flip)


def assign_vectors(x: np.ndarray, y: np.ndarray, held: int = HELD) -> tuple[np.ndarray, np.ndarray]:
    """The same for the products of the rows of ``x`` and ``y``."""
    if 8 * len(x) * len(y) <= held:
        return assign(x @ y.T)
    flip = len(x) > len(y)
    a, b = (y, x) if flip else (x, y)
    rows, cols = _least(len(a), len(b), lambda i: -(b @ a[i]))
    return _ordered(rows, cols, flip)


def _ordered(rows: np.ndarray, cols: np.ndarray, flip: bool) -> tuple[np.ndarray, np.ndarray]:
    a, b = (cols, rows) if flip else (rows, cols)
    order = np.argsort(a)
    return a[order], b[order]


def _least(n: int, m: int, cost: Callable[[int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each of ``n`` rows with a column of its own of ``m``, at the least total cost."""
    v, owner, place = np.zeros(m), np.full(m, -1), np.full(n, -1)
    waiting = []
    for i in range(n):
        j = int(cost(i).argmin()) if m else -1
        if owner[j] < 0:
            owner[j], place[i] = i, j
        else:
            waiting.append(i)
    waiting.reverse()
    rest = []
    for _ in range(BIDS * n if m > 1 else 0):
        if not waiting:
            break
        i = waiting.pop()
        reduced = cost(i) - v
        j = int(reduced.argmin())
        best = reduced[j]
        reduced[j] = np.inf
        second = int(reduced.argmin())
        gap = reduced[second] - best
        if not gap > 0 and owner[j] >= 0:
            j = second
            if owner[j] >= 0:
                rest.append(i)
                continue
            gap = 0.0
        if gap > 0:
            v[j] -= gap
        out = int(owner[j])
        owner[j], place[i] = i, j
        if out >= 0:
            place[out] = -1
            waiting.append(out)
    for i in rest + waiting[::-1]:
        _augment(i, cost, v, owner, place)
    return np.arange(n), place


def _augment(start: int, cost: Callable[[int], np.ndarray], v: np.ndarray, owner: np.ndarray, place: np.ndarray) -> None:
    """The shortest path from a row without a column to a free column, and potentials that make it tight.

    Columns are taken off the list of those that are open; its arrays hold what is open alone.
    """
    m = len(v)
    open_, far, back = np.arange(m), np.full(m, np.inf), np.full(m, start)
    done, length = [], []
    i, base = start, 0.0
    while True:
        row = cost(i)[open_] - v[open_]
        # the row's own potential: its column is tight
        row += base - (0.0 if i == start else own)
        better = row < far
        np.copyto(far, row, where=better)
        back[open_[better]] = i
        k = int(far.argmin())
        base, j = far[k], int(open_[k])
        if owner[j] < 0:
            free = np.flatnonzero(far == base)
            j = int(open_[free[(owner[open_[free]] < 0).argmax()]])
            break
        done.append(j)
        length.append(base)
        open_[k], far[k] = open_[-1], far[-1]
        open_, far = open_[:-1], far[:-1]
        i = int(owner[j])
        own = cost(i)[j] - v[j]
    if done:
        v[done] += np.array(length) - base
    while True:
        i = int(back[j])
        owner[j] = i
        place[i], j = j, int(place[i])
        if i == start:
            return
