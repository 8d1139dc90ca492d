"""Plain versions of the operators, for tables small enough for one process."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def raw(text) -> bytes:
    return b"" if text is None else text.encode("utf-8")


def shingle_set(text, width: int) -> frozenset:
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in raw(text))
    words = WORD.findall(low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1)))


def jaccard_components(rows, width: int, percent: int) -> list[tuple]:
    """(doc_id, n_shingles, component_id) of rows (doc_id, text), by all pairs that share a shingle."""
    sets = [shingle_set(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    first: dict[frozenset, int] = {}
    for k, s in enumerate(sets):
        if s:
            root[find(k)] = find(first.setdefault(s, k))
    holders = defaultdict(list)
    for k in first.values():
        for x in sets[k]:
            holders[x].append(k)
    shared: Counter = Counter()
    for own in holders.values():
        for i, a in enumerate(own):
            for b in own[:i]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            root[find(a)] = find(b)
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(s), None if i is None else (least[find(k)] if s else i)) for k, ((i, _), s) in enumerate(zip(rows, sets))]


def removed_spans(texts: list, length: int = 200) -> list[list[tuple[int, int]]]:
    """Of each text the maximal runs of bytes in strings that start twice or more."""
    own = [raw(t) for t in texts]
    seen: Counter = Counter(r[k : k + length] for r in own for k in range(len(r) - length + 1))
    out = []
    for r in own:
        gone = np.zeros(len(r) + 1, np.int8)
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                gone[k : k + length] = 1
        edge = np.diff(np.concatenate([[0], gone]))
        out.append(list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())))
    return out


def removed(rows) -> list[tuple]:
    out = []
    for (i, t), spans in zip(rows, removed_spans([t for _, t in rows])):
        r, kept, at = raw(t), b"", 0
        for a, e in spans:
            kept += r[at:a]
            at = e
        kept += r[at:]
        out.append((i, len(r), len(r) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return out


def nearest(rows, k: int, every: int) -> list[tuple]:
    """(query, rank, id, distance) over rows (id, vector)."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for i in sorted({i for i, _ in good if i % every == 0}):
        q = min((v.tolist() for j, v in good if j == i))
        near = sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for j, v in good if j != i and len(v) == len(q))[:k]
        out += [(i, n + 1, j, d) for n, (d, j) in enumerate(near)]
    return out


def overlaps(rows, items, window: int = 13, need: int = 11) -> set[tuple]:
    """(doc, item) where a window of ``window`` words has ``need`` equal words at equal places."""
    low = lambda t: WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in raw(t)))
    own = [(i, low(t)) for i, t in items if i is not None]
    out = set()
    number: dict[bytes, int] = {}
    code = lambda ws: np.array([number.setdefault(w, len(number)) for w in ws])
    own = [(i, code(w)) for i, w in own]
    for d, t in rows:
        doc = code(low(t))
        for i, item in own:
            size = min(window, len(item))
            if size < 6 or len(doc) < size:
                continue
            wi, wd = (np.lib.stride_tricks.sliding_window_view(x, size) for x in (item, doc))
            if any(((wd == w).sum(1) * window >= need * size).any() for w in wi):
                out.add((d, i))
    return out


def auc(score, label) -> float:
    order = np.argsort(np.asarray(score), kind="stable")
    s, y = np.asarray(score)[order], np.asarray(label)[order]
    _, inverse, counts = np.unique(s, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    pos = y.sum()
    return float((rank[y == 1].sum() - pos * (pos + 1) / 2) / max(1, pos * (len(y) - pos)))
