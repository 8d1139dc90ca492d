"""Lloyd's clustering of whole-number vectors, with Elkan's bounds.

Each vector keeps an upper bound of the distance to its centroid and a lower
bound of the distance to every centroid.  When centroids move, the bounds move
by as much; a centroid is left out where the upper bound lies strictly below
its lower bound, or below half the distance between the two centroids, and only
what is left is computed.  Bounds are rounded away from the truth and pruning
is strict, so no nearest centroid and no tie is ever left out.  Distances that
decide are exact integers.

A round is one pass: blocks of vectors with their bounds are read from the table
of the round before and written to the next one, and beside them the exact sums
for each centroid.  Nothing is shuffled but these sums.

Defined results: vectors that are null, have another length or hold null or
non-finite components take no part; a null id is kept, but starts a centroid only
where other ids are too few; rows that repeat an id are vectors of their own;
fewer vectors than centroids make as many centroids as there are vectors; equal
distances go to the smaller number; components of any size are exact, and a
distance or sum that a long can't hold is null; an empty table gives an empty
one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exact import SUMS, Sums, as_long, finite_rows, fits, floors, peeked, squared, totals, whole
from .storage import drop, written

#: Vectors of a block.
BLOCK = 4096
#: More than what two roundings of a root can cost.
_WIDER, _NARROWER = 1 + 2.0**-50, 1 - 2.0**-50
_MOST32 = float(np.finfo(np.float32).max)
#: The dimensions under which counts and distances are summed.
COUNT, INERTIA = -1, -2


def root(d2) -> float:
    """About the square root of a whole number of any size; infinite beyond doubles."""
    try:
        return math.sqrt(d2)
    except OverflowError:
        return math.inf


def roots(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) if d2.dtype != object else np.array([root(v) for v in d2], np.float64)


def below(r: np.ndarray) -> np.ndarray:
    """Not above the number whose rounded root this is."""
    return np.where(np.isfinite(r), r * _NARROWER, np.finfo(np.float64).max)


class Centroids:
    """Whole-number centroids, with lower bounds of half the distances between them."""

    def __init__(self, rows: list[list[int]]):
        self.rows = rows
        k = len(rows)
        self.half = np.full((k, k), np.inf)
        for i in range(k):
            for j in range(i):
                d = root(sum((a - b) ** 2 for a, b in zip(rows[i], rows[j])))
                self.half[i, j] = self.half[j, i] = 0.5 * float(below(np.array([d]))[0])
        self.least = self.half.min(1) if k else np.zeros(0)

    def moved(self, before: Centroids) -> np.ndarray:
        """Upper bounds of how far each has come."""
        return np.array([root(sum((x - y) ** 2 for x, y in zip(a, b))) * _WIDER for a, b in zip(self.rows, before.rows)])


class Block:
    """Vectors (int64, or Python integers) with their centroids and bounds."""

    def __init__(self, x: np.ndarray, cluster=None, upper=None, lower=None, k: int = 0):
        n = len(x)
        self.x = x
        self.cluster = np.zeros(n, np.int64) if cluster is None else cluster
        self.upper = np.full(n, np.inf) if upper is None else upper
        self.lower = np.zeros((n, k)) if lower is None else lower

    def move(self, by: np.ndarray) -> None:
        """The centroids have moved by at most so much."""
        self.upper = (self.upper + by[self.cluster]) * _WIDER
        self.lower = np.maximum((self.lower - by) * _NARROWER, 0)

    def assign(self, c: Centroids) -> int:
        """Give each vector its nearest centroid; the number of distances computed."""
        computed = 0
        live = np.flatnonzero(~(self.upper < c.least[self.cluster]))
        if len(live):
            # bounds that rule all others out need no exact distance
            u = self.upper[live][:, None]
            open_ = ~(u < self.lower[live]) & ~(u < c.half[self.cluster[live]])
            open_[np.arange(len(live)), self.cluster[live]] = False
            live = live[open_.any(1)]
        best = np.zeros(len(self.x), self.x.dtype if self.x.dtype == object or all(map(fits, c.rows)) else object)
        for j in np.unique(self.cluster[live]):
            own = live[self.cluster[live] == j]
            best[own] = d2 = squared(self.x[own], c.rows[j])
            r = roots(d2)
            self.upper[own], self.lower[own, j] = r * _WIDER, below(r)
            computed += len(own)
        given = self.cluster[live].copy()
        for j in range(len(c.rows)):
            at = self.cluster[live]
            u = self.upper[live]
            some = live[(given != j) & ~(u < self.lower[live, j]) & ~(u < c.half[at, j])]
            if not len(some):
                continue
            d2 = squared(self.x[some], c.rows[j])
            computed += len(some)
            r = roots(d2)
            self.lower[some, j] = below(r)
            nearer = ((d2 < best[some]) | ((d2 == best[some]) & (j < self.cluster[some]))).astype(bool)
            won = some[nearer]
            best[won], self.cluster[won], self.upper[won] = d2[nearer], j, r[nearer] * _WIDER
        return computed


def _state(ids: list, block: Block, id_type: pa.DataType) -> pa.RecordBatch:
    wide = block.x.dtype == object
    vectors = ";".join(",".join(map(str, v)) for v in block.x).encode() if wide else block.x.astype(np.int32).tobytes()
    upper = np.nextafter(block.upper.astype(np.float32), np.float32(np.inf))
    lower = np.maximum(np.nextafter(np.minimum(block.lower, _MOST32).astype(np.float32), np.float32(-np.inf)), 0)
    return pa.record_batch([pa.array([ids], pa.list_(id_type)), pa.array([wide]), *(pa.array([v], pa.binary()) for v in (vectors, block.cluster.astype(np.int32).tobytes(), upper.tobytes(), lower.astype(np.float32).tobytes())), pa.array([None], _SUM_LIST)], names=[*_NAMES, "sums"])


_NAMES = ["ids", "wide", "vectors", "cluster", "upper", "lower"]
_SUM_LIST = pa.list_(pa.struct([("g", pa.int32()), ("entry", pa.int32()), ("dim", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())]))


def _first_blocks(batches: Iterator[pa.RecordBatch], dim: int, factor: int, k: int) -> Iterator[tuple[list, Block]]:
    for b in batches:
        for rows, x in finite_rows(b.column(1)):
            if x.shape[1] != dim:
                continue
            whole_x, narrow = floors(x, factor)
            ids = b.column(0).take(pa.array(rows)).to_pylist()
            for part, kind in ((np.flatnonzero(narrow), np.int64), (np.flatnonzero(~narrow), object)):
                for s in range(0, len(part), BLOCK):
                    some = part[s : s + BLOCK]
                    if kind is object:
                        y = np.array([[whole(v, factor) for v in x[r]] for r in some], object)
                    else:
                        y = whole_x[some].astype(np.int64)
                    yield [ids[r] for r in some], Block(y, k=k)


def _kept_blocks(batches: Iterator[pa.RecordBatch], dim: int, k: int) -> Iterator[tuple[list, Block]]:
    for b in batches:
        for ids, wide, vectors, cluster, upper, lower in zip(*(b.column(n).to_pylist() for n in _NAMES)):
            if not ids:
                continue
            n = len(ids)
            x = np.array([[int(v) for v in r.split(",")] for r in vectors.decode().split(";")], object) if wide else np.frombuffer(vectors, np.int32).reshape(n, dim).astype(np.int64)
            yield ids, Block(x, np.frombuffer(cluster, np.int32).astype(np.int64), np.frombuffer(upper, np.float32).astype(np.float64), np.frombuffer(lower, np.float32).astype(np.float64).reshape(n, k))


def _id_type(head: pa.RecordBatch | None) -> pa.DataType:
    kind = pa.null() if head is None else head.schema.field(0).type
    return kind.value_type if pa.types.is_list(kind) else kind


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, factor: int, k: int, by: np.ndarray | None) -> Iterator[tuple[list, Block]]:
    """Blocks of the given vectors, or (``by``: how far centroids have moved) of the round before."""
    if by is None:
        yield from _first_blocks(batches, dim, factor, k)
    else:
        for ids, block in _kept_blocks(batches, dim, k):
            block.move(by)
            yield ids, block


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, factor: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The cluster of every vector of ``dim`` components, each taken as ``floor(factor * x)``.

    The first centroids are the ``k`` vectors with the least SHA-256 of
    ``<seed>:<id>``.  Columns: ``vec_id``, ``cluster`` int, ``distance`` long
    (squared), ``cluster_inertia``, ``inertia`` long, ``centroid_sha256`` string.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("vec_id"), v.alias("v"))
    finite = (F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.where(F.col("v").isNotNull() & finite).orderBy(digest.asc_nulls_last(), "v").limit(k).select("v").collect()
    id_type = rows.schema["vec_id"].dataType.simpleString()
    if not first:
        return rows.limit(0).selectExpr("vec_id", "0 as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256")
    now = Centroids([[whole(x, factor) for x in r["v"]] for r in first])
    k = len(now.rows)
    state, by = rows, None

    def step(c: Centroids, by: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = Sums()
            head, batches = peeked(batches)
            kind = _id_type(head)
            for ids, block in _blocks(batches, dim, factor, k, by):
                block.assign(c)
                for j in np.unique(block.cluster):
                    own = block.x[block.cluster == j]
                    sums.add(0, int(j), COUNT, len(own))
                    for d, s in enumerate(own.sum(0).tolist()):
                        sums.add(0, int(j), d, s)
                yield _state(ids, block, kind)
            if sums.held:
                yield pa.record_batch([pa.array([None], pa.list_(kind)), pa.array([None], pa.bool_()), *[pa.array([None], pa.binary())] * 4, pa.array([sums.rows()], _SUM_LIST)], names=[*_NAMES, "sums"])

        return run

    kept = f"ids array<{id_type}>, wide boolean, vectors binary, cluster binary, upper binary, lower binary, sums array<struct<{SUMS.replace(' ', ':').replace(',:', ',')}>>"
    for _ in range(rounds):
        before, state = state, written(state.mapInArrow(step(now, by), kept), "clusters")
        drop(before)
        found = totals(state.where("sums is not null").select(F.inline("sums")))
        moved = Centroids([[found[0, j, d] // found[0, j, COUNT] for d in range(dim)] if found.get((0, j, COUNT)) else now.rows[j] for j in range(k)])
        now, by = moved, moved.moved(now)

    def finish(c: Centroids, by: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = Sums()
            head, batches = peeked(batches)
            kind = _id_type(head)
            for ids, block in _blocks(batches, dim, factor, k, by):
                block.assign(c)
                distance = [0] * len(ids)
                for j in np.unique(block.cluster):
                    own = np.flatnonzero(block.cluster == j)
                    d2 = squared(block.x[own], c.rows[j]).tolist()
                    sums.add(0, int(j), INERTIA, sum(d2))
                    for r, s in zip(own.tolist(), d2):
                        distance[r] = as_long(s)
                yield pa.record_batch([pa.array(ids, kind), pa.array(block.cluster.astype(np.int32)), pa.array(distance, pa.int64()), pa.nulls(len(ids), _SUM_LIST)], names=["vec_id", "cluster", "distance", "sums"])
            if sums.held:
                yield pa.record_batch([pa.nulls(1, kind), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.array([sums.rows()], _SUM_LIST)], names=["vec_id", "cluster", "distance", "sums"])

        return run

    kept = f"vec_id {id_type}, cluster int, distance long, sums array<struct<{SUMS.replace(' ', ':').replace(',:', ',')}>>"
    out = written(state.mapInArrow(finish(now, by), kept), "clustered")
    drop(state)
    found = totals(out.where("sums is not null").select(F.inline("sums")))
    inertia = {j: found.get((0, j, INERTIA), 0) for j in range(k)}
    told = [(j, as_long(inertia[j]), hashlib.sha256(",".join(map(str, now.rows[j])).encode()).hexdigest()) for j in range(k)]
    # k rows
    of_cluster = out.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, centroid_sha256 string")
    placed = out.where("cluster is not null").drop("sums").join(F.broadcast(of_cluster), "cluster")
    return placed.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(as_long(sum(inertia.values()))).cast("long").alias("inertia"), "centroid_sha256")
