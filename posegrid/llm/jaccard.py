"""Exact Jaccard join of documents on word shingles, in regions of the metric space.

Equal sets are one class; only classes are compared.

1. Regions.  In the Jaccard metric unrelated documents are all at distance 1, so
   documents as the first pivots would send everything everywhere.  The first
   regions are therefore cut by parts of the sets, with replication wide enough
   that any two linked sets meet in one of them (``cells``): at 0.85 or more by
   hashed parts, of which linked sets share at least one whole; below, by single
   shingles, a set's first ones in a fixed order, frequent ones last.
2. Pivots.  In each region the sets of a size class and the next one are compared
   with one pivot.  Sets linked with the same pivot are connected already.
3. Recursion.  Regions whose sets are not all connected are cut further: Voronoi
   cells around pivots in the space of bucket counts, whose L1 distance never
   exceeds the symmetric difference; every set has one home cell and visits
   every cell whose pivot is no further from it than its own pivot and twice the
   threshold (triangle inequality).  Crowded regions are cut like this by joins,
   so that their cells go to different tasks (``spread``), small ones inside a
   task (``near_pairs``).  No row is made for every pair within the bound: a cell
   tells which components such pairs connect (``_touching``), fewer than it has
   sets, and what they connect in all is a region of its own.
4. Links.  These last regions get the texts of their sets, each set once.  Of the
   links those come out that connect something, fewer than there are sets.

Candidates are found by 64-bit hashes; a pair is linked by the words of its two
texts (``linked``).

Defined results: a null or blank text has an empty set and is linked with
nothing; rows that repeat an id or a text are linked by their equal sets; a row
with a null id links others like any row, its own component is null; a very long
text is one set like any other; an empty table gives an empty table; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shingles import mix, shingle_sets
from .storage import drop, written

#: Documents sampled to find frequent shingles, and in how many of them one is.
SAMPLE_DOCS, FREQUENT = 4000, 8
#: Bucket counts of a set: as many as a quarter of it decide which pairs are read. Up to
#: ``2 ** CELL_BITS`` of them go to its cells; there ``BUCKETS`` sums of them are compared first.
BUCKETS, PER_BUCKET, CELL_BITS = 64, 4, 10
#: Sets of a cell that are compared without cutting it further.
CELL = 128
#: Sets whose home is one cell of a task; a cell with more is cut by joins, around as many pivots.
CROWD, PIVOTS = 2048, 8
#: Times that a crowded cell is cut around pivots before its homes are dealt out in blocks.
ROUNDS = 6
#: Sets of one comparison with a set, and bytes of visitors' texts that a task holds (about).
SOME, TEXT_BYTES = 64, 1 << 26


def _row_key(id_col: str, text_col: str) -> tuple[Column, Column, Column]:
    """Of a row ``null_id``, ``key`` (its id, or its text's hash where that is null) and ``t``, its text's hash.

    Rows that have all three in common have the same id and the same text.
    """
    i, t = F.col(id_col).cast("long"), F.xxhash64(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")))
    return i.isNull().alias("null_id"), F.coalesce(i, t).alias("key"), t.alias("t")


def _raw(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("raw")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), raw, *_row_key(id_col, text_col)[1:])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def frequent_shingles(rows: DataFrame, width: int) -> np.ndarray:
    """Hashes of the shingles of at least ``FREQUENT`` sampled documents, ascending.

    It can have at most the shingles of ``SAMPLE_DOCS`` documents / ``FREQUENT``.
    """
    n = rows.count()
    if not n:
        return np.zeros(0, np.uint64)
    part = 1 << 20
    some = rows.where(F.pmod(F.xxhash64("key"), F.lit(part)) < max(1, min(part, SAMPLE_DOCS * part // n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets([r.as_py() for r in b.column(1)], width)
            if sets:
                h, c = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.record_batch([pa.array(_signed(h)), pa.array(c.astype(np.int64))], names=["h", "c"])

    found = some.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= FREQUENT).select("h")
    return np.sort(np.array([r[0] for r in found.collect()], np.int64).view(np.uint64))


def prefix(own: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set, frequent ones last, of which a linked set has one."""
    n = len(own)
    need = n - -(-percent * n // 100) + 1
    if len(frequent) and n:
        at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
        hot = frequent[at] == own
        own = np.concatenate([own[~hot], own[hot]])
    return own[:need]


def size_bounds(percent: int, upto: int) -> np.ndarray:
    """Lower ends of size classes; linked sets are in one class or in two adjacent ones."""
    out = [1]
    while out[-1] <= upto:
        out.append(max(out[-1] + 1, -(-100 * out[-1] // percent)))
    return np.array(out)


def parts(own: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of the set's parts, for its own size class and the one below.

    Linked sets, the smaller one in class ``c``, differ in at most ``d`` elements, so
    of ``d + 1`` parts one is the same in both.  Empty parts are sent only by sets
    that have one: otherwise a part that is the same is not empty.
    """
    if not len(own):
        return own
    bounds = size_bounds(percent, len(own))
    c = int(np.searchsorted(bounds, len(own), "right")) - 1
    out = []
    for k in range(max(0, c - 1), c + 1):
        d = (100 - percent) * int(bounds[k + 1] - 1) // percent
        at = ((own >> np.uint64(24)) % np.uint64(d + 1)).astype(np.int64)
        total = np.zeros(d + 1, np.uint64)
        np.add.at(total, at, mix(own))
        salt = np.uint64((k * 0x9E3779B97F4A7C15 + 1) % (1 << 64))
        out.append(mix(mix(total) + np.arange(d + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + salt))
    return np.concatenate(out)


def cells(own: np.ndarray, frequent: np.ndarray | None, percent: int) -> np.ndarray:
    return parts(own, percent) if frequent is None else prefix(own, frequent, percent)


def size_class(sizes: np.ndarray, percent: int) -> np.ndarray:
    bounds = size_bounds(percent, int(sizes.max(initial=1)))
    return np.searchsorted(bounds, sizes, "right") - 1


def fine_counts(own: np.ndarray, most_bits: int = 64) -> np.ndarray:
    """Elements in each of at least ``BUCKETS`` buckets by the first bits of their hashes, a power of two of them.

    Counts are cut off at what a byte holds; differences of counts only become smaller.
    """
    bits = min(most_bits, max(6, (len(own) // PER_BUCKET).bit_length()))
    return np.minimum(np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)


def coarse(counts: list[bytes]) -> np.ndarray:
    """The ``BUCKETS`` sums of each set's counts."""
    size = np.array([len(c) for c in counts], np.int64)
    out = np.zeros((len(counts), BUCKETS), np.int32)
    for n in np.unique(size):
        some = np.flatnonzero(size == n)
        out[some] = np.frombuffer(b"".join(counts[k] for k in some), np.uint8).reshape(len(some), BUCKETS, -1).sum(2)
    return out


class Counts:
    """Counts of many sets, for differences of many pairs at a time."""

    def __init__(self, counts: list[bytes]):
        self.size = np.array([len(c) for c in counts], np.int64)
        self.place, self.rows = np.zeros(len(counts), np.int64), {}
        for n in np.unique(self.size).tolist():
            some = np.flatnonzero(self.size == n)
            self.place[some] = np.arange(len(some))
            self.rows[n] = np.frombuffer(b"".join(counts[k] for k in some), np.uint8).reshape(len(some), n)

    def differences(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lower bounds of the symmetric differences of sets ``a`` and ``b``, pair by pair."""
        out = np.zeros(len(a), np.int64)
        kind = self.size[a] * (1 << 32) + self.size[b]
        for k in np.unique(kind).tolist():
            n, m = k >> 32, k & 0xFFFFFFFF
            few, every = min(n, m), np.flatnonzero(kind == k)
            for c in range(0, len(every), 2048):
                some = every[c : c + 2048]
                x, y = (self.rows[z][self.place[w[some]]].reshape(len(some), few, -1).sum(2, dtype=np.int32) for z, w in ((n, a), (m, b)))
                out[some] = np.abs(x - y).sum(1)
        return out


def least_difference(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound of the symmetric difference of two sets, from their counts."""
    x, y = x.astype(np.int32), y.astype(np.int32)
    few = min(len(x), len(y))
    return int(np.abs(x.reshape(few, -1).sum(1) - y.reshape(few, -1).sum(1)).sum())


def _described(rows: DataFrame, width: int, percent: int, frequent: np.ndarray | None) -> DataFrame:
    """Of each document its set's size, two fingerprints, bucket counts and the cells it is sent to."""
    kinds = "doc_id long, key long, t long, n long, c int, f long, g long, counts binary, fine binary, cells array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                some = b.slice(k, 256)
                sets = shingle_sets([r.as_py() for r in some.column("raw")], width)
                sizes = np.array([len(s) for s in sets], np.int64)
                keys = [_signed(cells(s, frequent, percent)) for s in sets]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
                f, g = ([int(_signed(x.sum(keepdims=True))[0]) if len(x) else 0 for x in y] for y in (sets, [mix(s ^ np.uint64(0x5851F42D4C957F2D)) for s in sets]))
                counts = [fine_counts(s, CELL_BITS).tobytes() for s in sets]
                own = [pa.array(sizes), pa.array(size_class(sizes, percent), pa.int32()), pa.array(f, pa.int64()), pa.array(g, pa.int64()), pa.array(counts, pa.binary()), pa.array([fine_counts(s).tobytes() for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys)))]
                yield pa.record_batch([*some.select(["doc_id", "key", "t"]).columns, *own], names=["doc_id", "key", "t", "n", "c", "f", "g", "counts", "fine", "cells"])

    return rows.mapInArrow(run, kinds)


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and bucket counts allow a link."""
    x, y = (classes.select(F.col("id").alias(i), F.col("n").alias(f"n_{i}"), F.col("fine").alias(f"fine_{i}")) for i in ("a", "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = (b.column("n_a").to_numpy().astype(np.int64) + b.column("n_b").to_numpy()).tolist()
            far = (least_difference(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) for x, y in zip(b.column("fine_a").to_pylist(), b.column("fine_b").to_pylist()))
            yield b.select(["a", "b"]).filter(pa.array([d * (100 + percent) <= (100 - percent) * n for d, n in zip(far, total)], pa.bool_()))

    near = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return pairs.join(x, "a").join(y, "b").where(near).select("a", "b", "n_a", "n_b", "fine_a", "fine_b").mapInArrow(run, "a long, b long")


_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def word_shingles(raw: bytes, width: int) -> frozenset[tuple[bytes, ...]]:
    """The set of a text, as words."""
    words = _WORDS.findall(raw.lower())  # bytes: only A-Z change
    return frozenset(zip(*(words[k:] for k in range(width)))) if len(words) > width else frozenset([tuple(words)] if words else ())


def linked(x: frozenset, y: frozenset, percent: int) -> bool:
    shared = len(x & y)
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _texts(ids: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """The text ``raw`` of each class in ``ids``, as a written table."""
    wanted = ids.distinct().join(classes.select("id", "key", "t"), "id")
    return written(rows.join(wanted, ["key", "t"]).select("id", "raw").dropDuplicates(["id"]), "jaccard-texts")


def _verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked, by the words of their texts themselves."""
    near = written(_possible(pairs, classes, percent), "jaccard-near")
    texts = _texts(near.select(F.explode(F.array("a", "b")).alias("id")), classes, rows)
    x, y = (texts.select(F.col("id").alias(i), F.col("raw").alias(r)) for i, r in (("a", "x"), ("b", "y")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pivot = None, frozenset()
        for b in batches:
            keep = []
            for a, x, y in zip(b.column("a").to_pylist(), b.column("x"), b.column("y")):
                if a != last:
                    last, pivot = a, word_shingles(x.as_py(), width)
                keep.append(linked(pivot, word_shingles(y.as_py(), width), percent))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # joined by a last, so that a pivot's pairs come one after the other
    out = written(near.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "jaccard-links")
    drop(near, texts)
    return out


def _by_cell(batches: Iterator[pa.RecordBatch]):
    """The rows of each cell; they come sorted by cell, a cell may span batches."""

    def rows():
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in range(b.num_columns)))

    yield from groupby(rows(), key=lambda r: r[0])


def _stars(shared: DataFrame) -> DataFrame:
    """Of each cell the pairs of a size class's least set with those of this class and the next."""
    pivots = shared.groupBy("cell", "c").agg(F.min("id").alias("a"))
    both = shared.select("cell", F.explode(F.array("c", F.col("c") - 1)).alias("c"), F.col("id").alias("b"))
    return both.join(pivots, ["cell", "c"]).where("a != b").select("a", "b").distinct()


def near_pairs(counts: np.ndarray, sizes: np.ndarray, labels: np.ndarray, percent: int, left: np.ndarray | None = None, right: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a region with different labels whose bucket counts allow a link.

    ``counts``: a row for each set; a pair is a set of ``left`` with a later one of
    ``right`` (ascending; all of them by default).  Cells are cut around pivots and
    joined recursively; the L1 distance of the counts bounds the symmetric
    difference.  ``labels`` may become equal on the way.
    """

    def allowed(n):  # most elements that two linked sets may differ in, one having n
        return (100 - percent) * (100 * n // percent) // 100

    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.abs(counts[a][:, None, :] - counts[b][None, :, :]).sum(2)

    def leaf(left: np.ndarray, right: np.ndarray):
        for k in range(0, len(left), 64):
            a = left[k : k + 64]
            # Blocks of differences that stay in a processor's cache.
            for r in range(int(np.searchsorted(right, a[0], "right")), len(right), 512):
                b = right[r : r + 512]
                total = sizes[a][:, None] + sizes[b][None, :]
                # |x - y| <= (1 - t) |x + y| / (1 + t) for linked sets; each pair comes from its first set
                near = (labels[a][:, None] != labels[b][None, :]) & (b[None, :] > a[:, None])
                near &= distances(a, b) * (100 + percent) <= (100 - percent) * total
                i, j = np.nonzero(near)
                yield a[i], b[j]

    def join(left: np.ndarray, right: np.ndarray):
        """Pairs of the sets in ``left`` with later ones in ``right``."""
        if min(len(left), len(right)) <= CELL:
            yield from leaf(left, right)
            return
        limit = int(allowed(max(sizes[left].max(), sizes[right].max())))
        pivots = left[np.linspace(0, len(left) - 1, 8).astype(int)]
        far, other = (np.concatenate([distances(x[k : k + 4096], pivots) for k in range(0, len(x), 4096)]) for x in (left, right))
        home, close = far.argmin(1), other.min(1) + 2 * limit
        cut = []
        for p in range(len(pivots)):
            own = home == p
            if own.any():
                reach = far[own, p].max() + limit
                cut.append((left[own], right[(other[:, p] <= close) & (other[:, p] <= reach)]))
        # Home cells are disjoint, so cutting never costs more than comparing all; where it saves little it ends.
        ends = sum(len(x) * len(y) for x, y in cut) > 0.8 * len(left) * len(right)
        for x, y in cut:
            yield from (leaf if ends else join)(x, y)

    everything = np.arange(len(sizes))
    left, right = (everything if x is None else x for x in (left, right))
    if len(left) and len(right):
        yield from join(left, right)


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], list[tuple]]]:
    """The homes of each cell with none of its visitors, then with some of them at a time.

    Rows (cell, visits, n, id, label, counts and, it may be, a text) come sorted by
    cell, homes before visitors.  A task holds the homes of one cell, at most about
    ``CROWD``, and some of its visitors.
    """
    for _, rows in _by_cell(batches):
        homes: list[tuple] = []
        visitors: list[tuple] = []
        met, size = False, 0
        for r in rows:
            if not r[1]:
                homes.append(r)
                continue
            if not met:
                yield homes, []
                met = True
            visitors.append(r)
            size += sum(map(len, r[6:]))
            if len(visitors) == 2 * CROWD or size > TEXT_BYTES:
                yield homes, visitors
                visitors, size = [], 0
        if not met:
            yield homes, []
        if visitors and homes:
            yield homes, visitors


def _may_link(rows: list[tuple], labels: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the sets, a home and any other, whose ``labels`` differ and whose counts allow a link; ``rows`` by size and id."""
    n, counts, home = np.array([r[2] for r in rows]), [r[5] for r in rows], np.array([not r[1] for r in rows], bool)
    fine = Counts(counts)
    right = None if home.all() else np.flatnonzero(~home)
    for a, b in near_pairs(coarse(counts), n, labels, percent, np.flatnonzero(home), right):
        near = fine.differences(a, b) * (100 + percent) <= (100 - percent) * (n[a] + n[b])
        yield a[near], b[near]


def _in_order(homes: list[tuple], others: list[tuple]) -> tuple[list[tuple], np.ndarray]:
    rows = sorted([*homes, *others], key=lambda r: (r[2], r[3]))
    return rows, np.array([r[4] for r in rows], np.int64)


def _batch(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
    flat = sorted(pairs)
    return pa.record_batch([pa.array([p[c] for p in flat], pa.int64()) for c in (0, 1)], names=["a", "b"])


def _touching(percent: int):
    """Pairs of labels that connect, in each cell, whatever sets with different labels may be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: set[tuple[int, int]] = set()
        for homes, visitors in _meetings(batches):
            rows, labels = _in_order(homes, visitors)
            own = labels.copy()
            for a, b in _may_link(rows, labels, percent):
                apart = labels[a] != labels[b]
                while apart.any():
                    a, b = a[apart], b[apart]
                    out.add((int(own[a[0]]), int(own[b[0]])))
                    labels[labels == labels[b[0]]] = labels[a[0]]  # near_pairs leaves out what is connected by now
                    apart = labels[a] != labels[b]
            if len(out) > 100_000:
                yield _batch(out)
                out.clear()
        if out:
            yield _batch(out)

    return run


def _residual(percent: int, width: int | None = None):
    """Of each cell the pairs of sets that are not connected yet and may be linked.

    With ``width`` the rows have their texts, and of the pairs those come out that
    are linked, by their words, and connect what the ones before left apart: fewer
    than there are sets.
    """

    def linking(rows: list[tuple], labels: np.ndarray) -> Iterator[tuple[int, int]]:
        sets, last, own = shingle_sets([r[6] for r in rows], width), None, frozenset()
        for a, b in _may_link(rows, labels, percent):
            for i in np.unique(a).tolist():
                other = b[a == i]
                for k in range(0, len(other), SOME):
                    some = other[k : k + SOME]
                    some = some[labels[some] != labels[i]]
                    if not len(some):
                        continue
                    every = np.concatenate([sets[j] for j in some])
                    at = np.minimum(np.searchsorted(sets[i], every), len(sets[i]) - 1)
                    ends = np.cumsum([len(sets[j]) for j in some])
                    shared = np.diff(np.concatenate([[0], np.cumsum(sets[i][at] == every)[ends - 1]]))
                    both = len(sets[i]) + np.diff(ends, prepend=0) - shared
                    for j in some[100 * shared >= percent * both].tolist():
                        if labels[i] == labels[j]:
                            continue
                        if last != i:
                            last, own = i, word_shingles(rows[i][6], width)
                        if linked(own, word_shingles(rows[j][6], width), percent):
                            labels[labels == labels[j]] = labels[i]
                            yield i, j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: set[tuple[int, int]] = set()
        for homes, visitors in _meetings(batches):
            rows, labels = _in_order(homes, visitors)
            ids = [r[3] for r in rows]
            found = linking(rows, labels) if width else (p for a, b in _may_link(rows, labels, percent) for p in zip(a.tolist(), b.tolist()))
            for i, j in found:
                out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
                if len(out) > 100_000:
                    yield _batch(out)
                    out.clear()
        if out:
            yield _batch(out)

    return run


def spread(rows: DataFrame, percent: int, crowd: int = CROWD, rounds: int = ROUNDS, scratch: list[DataFrame] | None = None) -> DataFrame:
    """Rows (cell, visits, n, id, label, counts) with crowded cells cut into Voronoi cells around pivots.

    Two sets of a cell whose counts allow a link share a new cell that is the home
    of one of them.  A cell that is still crowded after some rounds is dealt out in
    blocks of homes, each visited by all sets of the cell; no set is left out.  Written
    tables that the result reads are added to ``scratch``.
    """
    kinds = "cell long, visits boolean, n int, id long, label long, counts binary"
    done, scratch = None, [] if scratch is None else scratch

    def add(part: DataFrame):
        nonlocal done
        done = part if done is None else done.union(part)

    for turn in range(rounds + 1):
        homes = rows.groupBy("cell").agg(F.count(F.when(~F.col("visits"), 1)).alias("homes"), F.max("n").alias("most")).where(F.col("homes") > crowd)
        crowded = written(homes, "jaccard-crowded")
        scratch.append(crowded)
        if crowded.isEmpty():
            add(rows)
            break
        add(rows.join(crowded, "cell", "left_anti"))
        inside = rows.join(crowded, "cell")
        if turn == rounds:
            blocks = F.ceil(F.col("homes") / crowd).cast("int")
            own = F.pmod(F.xxhash64("id"), blocks).cast("int")
            at = F.explode(F.sequence(F.lit(0), blocks - 1))
            dealt = inside.select("*", own.alias("own"), at.alias("at"))
            dealt = dealt.select(F.xxhash64("cell", "at", F.lit(turn)).alias("cell"), (F.col("visits") | (F.col("own") != F.col("at"))).alias("visits"), "n", "id", "label", "counts")
            add(dealt)
            break
        # of the homes, the one of least hash in each of some parts is a pivot
        mark = F.xxhash64("id", F.lit(turn))
        chosen = inside.where(~F.col("visits")).groupBy("cell", F.pmod(mark, F.lit(PIVOTS)).alias("p")).agg(F.min(F.struct(mark.alias("m"), "counts"))["counts"].alias("pivot"))
        pivots = chosen.groupBy("cell").agg(F.collect_list("pivot").alias("pivots"))  # at most PIVOTS of a cell

        def cut(batches: Iterator[pa.RecordBatch], turn: int = turn) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = coarse(b.column("counts").to_pylist())
                pick, cells_, visits = [], [], []
                cell, most, away = (b.column(x).to_numpy(zero_copy_only=False) for x in ("cell", "most", "visits"))
                around = b.column("pivots").to_pylist()
                for k in range(b.num_rows):
                    far = np.abs(coarse(around[k]) - own[k]).sum(1)
                    limit = (100 - percent) * (100 * int(most[k]) // percent) // 100
                    home = int(far.argmin())
                    for p in np.flatnonzero(far <= far[home] + 2 * limit).tolist():
                        pick.append(k)
                        cells_.append((int(cell[k]), turn, p))
                        visits.append(bool(away[k]) or p != home)
                new = np.array([hash(x) for x in cells_], np.int64)
                yield pa.record_batch([pa.array(new), pa.array(visits, pa.bool_()), *(b.column(x).take(pa.array(pick, pa.int64())) for x in ("n", "id", "label", "counts"))], names=["cell", "visits", "n", "id", "label", "counts"])

        rows = written(inside.join(pivots, "cell").select("cell", "visits", "n", "id", "label", "counts", "most", "pivots").mapInArrow(cut, kinds), "jaccard-cut")
        scratch.append(rows)
    return done


def _classes(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows (``doc_id``, ``n``, ``f``, ``g``), and of each class of equal sets ``n``, ``f``, ``g``, its
    least id ``rep``, its first row (``null_id``, ``key``, ``t``) and the ``root`` of its component.

    Both are written tables; what was written on the way is deleted.
    """
    rows = _raw(docs, id_col, text_col)
    frequent = None if percent >= 85 else frequent_shingles(rows, width)
    described = written(_described(rows, width, percent, frequent), "jaccard-sets")
    members = written(described.select("doc_id", "key", "t", "n", "f", "g"), "jaccard-rows")
    one = described.where("n > 0").groupBy("n", "f", "g").agg(F.min(F.struct("key", "t", "c", "counts", "fine", "cells")).alias("own"))
    found = written(one.select(F.col("f").alias("id"), F.col("n").cast("int").alias("n"), "own.*"), "jaccard-classes")
    drop(described)
    classes = found.drop("cells")
    sent = found.select(F.explode("cells").alias("cell"), "c", "n", "id")
    # Only cells with two sets or more go on; they are counted where the rows lie.
    several = written(sent.groupBy("cell").count().where("count > 1").select("cell"), "jaccard-several")
    shared = written(sent.join(several, "cell"), "jaccard-cells")
    drop(several)
    stars = written(_stars(shared), "jaccard-stars")
    links = _verified(stars, classes, rows, width, percent)
    label = components(links)
    tables = [found, shared, stars, links, label]
    met = lambda x: x.repartition("cell").sortWithinPartitions("cell", "visits", "n", "id")
    labelled = shared.join(label, "id", "left").select("cell", "n", "id", F.coalesce("root", "id").alias("label"))
    open_cells = labelled.groupBy("cell").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where(F.col("lo") != F.col("hi")).select("cell")
    left = labelled.join(open_cells, "cell").join(classes.select("id", "counts"), "id")
    left = written(left.select("cell", F.lit(False).alias("visits"), "n", "id", "label", "counts"), "jaccard-open")
    touching = written(met(spread(left, percent, scratch=tables)).mapInArrow(_touching(percent), "a long, b long").distinct(), "jaccard-touching")
    # what such pairs connect is a region, with every set once; what was open nowhere has no link to find
    region = components(touching)
    again = left.dropDuplicates(["id"]).join(region.select(F.col("id").alias("label"), F.col("root").alias("region")), "label")
    again = written(again.select(F.col("region").alias("cell"), "visits", "n", "id", "label", "counts"), "jaccard-regions")
    drop(left, touching, region)
    texts = _texts(again.select("id"), classes, rows)
    apart = spread(again, percent, scratch=tables).join(texts, "id").select(*again.columns, "raw")
    more = written(met(apart).mapInArrow(_residual(percent, width), "a long, b long").distinct(), "jaccard-more")
    # what is connected is a star by now: new links change few of them
    roots = components(label.select(F.col("id").alias("a"), F.col("root").alias("b")).union(more))
    tables += [again, texts, more]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "key", "t")).alias("first")
    reps = members.where("n > 0").groupBy("n", "f", "g").agg(F.min("doc_id").alias("rep"), first)
    reps = reps.join(roots.select(F.col("id").alias("f"), "root"), "f", "left").withColumn("root", F.coalesce("root", "f"))
    reps = written(reps, "jaccard-roots")
    drop(roots, *tables)
    return members, reps


def jaccard_join(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of the documents whose shingle sets have a similarity of ``percent`` %.

    Columns: ``doc_id``, ``n_shingles`` long (size of the set) and
    ``component_id`` (the least id that links reach, its own included).
    """
    members, reps = _classes(docs, width, percent, id_col, text_col)
    least = reps.groupBy("root").agg(F.min("rep").alias("component_id"))
    found = reps.join(least, "root").select("n", "f", "g", "component_id")
    linked = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return members.join(found, ["n", "f", "g"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(linked, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component with all its columns, and every row without words.

    It is the row of the least id, null ids last, and of the rows that share it the
    one with the least hash of its text; which of the rows with the same id and the
    same text is not defined.
    """
    _, reps = _classes(docs, width, percent, id_col, text_col)
    kept = reps.groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    words = F.coalesce(F.col(text_col).cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # Repeated rows go before the rows are dealt out, so that they do not meet in one task.
    rows = docs.where(words).select(*_row_key(id_col, text_col), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = rows.dropDuplicates(["null_id", "key", "t"]).join(kept, ["null_id", "key", "t"]).select("row.*")
    return docs.where(~words).union(found)
