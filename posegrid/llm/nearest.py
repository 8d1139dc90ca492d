"""Exact nearest neighbours of a stated query set, by a block matrix join.

Vectors are held as int8 with one scale each, in blocks.  A tile, some queries
against one block of candidates, is a single int8 product; with the length of
what quantisation cut off each vector it bounds every distance of the tile from
both sides.  A pair whose lower bound lies above the k-th least upper bound of
its query cannot be among the k nearest.  The others are computed again in
double precision on the original vectors, and heaps merge the tiles.

Tiles form a grid: blocks of queries against groups of candidate blocks, so one
block of queries is spread over as many tasks as the candidates need.  What
bounds a pair is in parts of the tile's largest scale; where a distance is so
large or so small that its square leaves the range of doubles, nothing is ruled
out and the measure itself decides.

Defined results: vectors that are null, all zero, or hold null or non-finite
components take no part, neither as queries nor as candidates; vectors of
different lengths are never compared; equal distances go to the smaller id;
rows that repeat an id are candidates of their own, but one query, and none is
a candidate for its own id; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, BLOCK = 4096, 4096
#: Queries of a tile, and candidate blocks that meet a block of queries in one task.
TILE, GROUP = 512, 64
#: Distances between these are bounded; their squares are well inside the range of doubles.
LEAST, MOST = 1e-140, 1e150
_BLOCKS = "dim int, ids binary, vectors binary"
_FOUND = "query_id long, vec_id long, score double"


def clean_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id`` and ``v`` of the rows that take part."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(v, lambda x: x != 0)
    return vectors.where(v.isNotNull() & F.col(id_col).isNotNull() & finite & some).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: x.cast("double")).alias("v"))


def _packed(batches: Iterator[pa.RecordBatch], size: int, extra: bool) -> Iterator[pa.RecordBatch]:
    """Rows of up to ``size`` vectors of one length (and one block number)."""
    held: dict[tuple, list] = {}

    def block(key):
        ids, vectors = zip(*held.pop(key))
        row = [pa.array([key[0]], pa.int32())] + [pa.array([x], pa.binary()) for x in (np.array(ids, np.int64).tobytes(), np.array(vectors, np.float64).tobytes())]
        return pa.record_batch(row + ([pa.array([key[1]], pa.int32())] if extra else []), names=["dim", "ids", "vectors"] + (["qb"] if extra else []))

    for b in batches:
        ids, vectors = b.column("vec_id").to_pylist(), b.column("v").to_pylist()
        groups = b.column("qb").to_pylist() if extra else [0] * len(ids)
        for i, v, g in zip(ids, vectors, groups):
            own = held.setdefault((len(v), g), [])
            own.append((i, v))
            if len(own) == size:
                yield block((len(v), g))
    for key in [*held]:
        yield block(key)


class Block:
    """Vectors with their int8 form, its scale, and the length of the remainder."""

    def __init__(self, dim: int, ids: bytes, vectors: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.x = np.frombuffer(vectors, np.float64).reshape(-1, dim)
        top = np.abs(self.x).max(1, initial=0)
        self.scale = np.maximum(top / 127, np.finfo(np.float64).tiny)
        parts = self.x / self.scale[:, None]
        # clip: the quotient of a tiny maximum may round past 127
        self.q = np.clip(np.rint(parts), -127, 127).astype(np.int8)
        # in parts of the scale: the length of the remainder, and of what is kept
        self.off = np.sqrt(((parts - self.q) ** 2).sum(1))
        self.length = np.sqrt((self.q.astype(np.float64) ** 2).sum(1))

    def some(self, a: int, b: int) -> Block:
        out = object.__new__(Block)
        for name, value in vars(self).items():
            setattr(out, name, value[a:b])
        return out


def tile(queries: Block, rows: Block, k: int) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """Of each query its at most ``k`` nearest in this tile, as (distance, id)."""
    dim = queries.q.shape[1]
    kind = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64  # both hold the integer sums exactly
    dots = queries.q.astype(kind) @ rows.q.astype(kind).T
    unit = max(float(queries.scale.max()), float(rows.scale.max()))
    a, b = queries.scale[:, None] / unit, rows.scale[None, :] / unit
    x, y = a * queries.length[:, None], b * rows.length[None, :]
    about = np.sqrt(np.maximum(x * x + y * y - 2 * (a * b) * dots, 0))
    # the subtraction above rounds: allow for that besides the quantisation
    slack = a * queries.off[:, None] + b * rows.off[None, :] + 1e-7 * np.sqrt(x * x + y * y)
    with np.errstate(over="ignore"):
        lower, upper = np.minimum((about - slack) * unit, MOST), (about + slack) * unit
    lower[lower < LEAST] = 0
    upper[~(upper < MOST)] = np.inf
    upper = np.maximum(upper, LEAST)
    own = queries.ids[:, None] == rows.ids[None, :]
    upper[own] = np.inf
    bound = np.partition(upper, k - 1, 1)[:, k - 1] if upper.shape[1] > k else np.full(len(upper), np.inf)
    keep = (lower <= bound[:, None]) & ~own
    for n in range(len(keep)):
        some = np.flatnonzero(keep[n])
        if len(some):
            with np.errstate(over="ignore", under="ignore"):
                exact = np.sqrt(((rows.x[some] - queries.x[n]) ** 2).sum(1))
            order = np.lexsort((rows.ids[some], exact))[:k]
            yield n, [(float(exact[j]), int(rows.ids[some[j]])) for j in order]


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows of every row whose id is divisible by ``every``.

    Columns: ``query_id`` long, ``rank`` int from 1, ``vec_id`` long, ``score``
    double (Euclidean distance).  Candidate blocks are cut where the rows lie;
    what moves is a copy of them for each ``QUERY_BLOCK`` queries, and then ``k``
    rows for each query and group of candidate blocks.
    """
    rows = clean_vectors(vectors, id_col, vector_col)
    asked = rows.where(F.col("vec_id") % every == 0)
    total, wanted = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    blocks, groups = max(1, -(-wanted // QUERY_BLOCK)), max(1, -(-total // (BLOCK * GROUP)))
    by_query = asked.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    queries = by_query.repartition(blocks, "qb").mapInArrow(lambda b: _packed(b, QUERY_BLOCK, True), _BLOCKS + ", qb int").select(F.col("dim"), "qb", F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    cut = rows.mapInArrow(lambda b: _packed(b, BLOCK, False), _BLOCKS)
    cut = cut.withColumn("group", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))
    tiles = cut.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(queries, ["dim", "qb", "group"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[float, int]]] = {}

        def found():
            flat = [(q, i, s) for q, near in best.items() for s, i in near]
            best.clear()
            return pa.record_batch([pa.array([f[c] for f in flat], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

        for b in batches:
            for n in range(b.num_rows):
                dim, qi, qv, ci, cv = (b.column(c)[n].as_py() for c in ("dim", "query_ids", "query_vectors", "ids", "vectors"))
                q, rows = Block(dim, qi, qv), Block(dim, ci, cv)
                for a in range(0, len(q.ids), TILE):
                    for j, near in tile(q.some(a, a + TILE), rows, k):
                        key = int(q.ids[a + j])
                        best[key] = heapq.nsmallest(k, [*best.get(key, ()), *near])
                if len(best) > 8 * QUERY_BLOCK:
                    yield found()
        if best:
            yield found()

    near = tiles.select("dim", "query_ids", "query_vectors", "ids", "vectors").mapInArrow(run, _FOUND)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
