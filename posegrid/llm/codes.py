"""Compression of vectors into a code a part, by Lloyd's rounds over distinct parts.

A vector is cut into equal parts of whole numbers.  Equal parts of one position
are one row with a weight, so the rounds work on distinct values however often
they occur; each round is one pass whose exact weighted sums, one for each
codebook entry and component, are all that is shuffled.  At the end every
distinct part has its code and error, and the vectors' parts are joined to
them.  Parts that make up at least one in ``SHARE`` of their position, of which
a position has at most ``SHARE``, are broadcast for that; the others are joined
by a shuffle.

Defined results: vectors that are null, empty or hold null or non-finite
components take no part, nor do those whose length is not a multiple of the
number of parts; vectors of different lengths have codebooks of their own; a
null id is kept, but starts a codebook only where other ids are too few; rows
that repeat an id are vectors of their own; fewer vectors than entries make
smaller codebooks; equal distances go to the lower index; components of any size
are exact, and an error or sum that a long can't hold is null; null labels are
equal; an empty table gives an empty one; columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exact import LONG_MAX, SUMS, Sums, as_long, finite_rows, fits, floors, limit, numbers, squared, totals, whole
from .hot import join_counted
from .storage import drop, written

#: Parts of a position, or rows of a label, of which at least one in so many is the same go by broadcast.
SHARE = 1000
#: Doubles hold all whole numbers below this.
EXACT = 1 << 53
#: The component under which weights are summed.
COUNT = -1


def split_vectors(batches: Iterator[pa.RecordBatch], parts: int, factor: int) -> Iterator[pa.RecordBatch]:
    """``key``, ``vec_id``, ``label``, ``size`` and ``parts`` of the rows that are kept."""
    n = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
    for b in batches:
        for rows, x in finite_rows(b.column(2)):
            size = x.shape[1]
            if size % parts:
                continue
            d = size // parts
            whole_x, _ = floors(x, factor)
            flat = whole_x.reshape(-1, d)
            narrow = (np.abs(whole_x) <= limit(size)).reshape(-1, d).all(1)
            raw = np.zeros((len(flat), 1 + 4 * d), np.uint8)
            raw[narrow, 1:] = flat[narrow].astype("<i4").view(np.uint8)
            cells = [raw[k].tobytes() for k in range(len(raw))] if not narrow.all() else None
            if cells is None:
                offsets = np.arange(len(raw) + 1, dtype=np.int32) * raw.shape[1]
                values = pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
            else:
                for k in np.flatnonzero(~narrow):
                    cells[k] = numbers([whole(v, factor) for v in x.reshape(-1, d)[k]], True)
                values = pa.array(cells, pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * parts), values)
            at = pa.array(rows)
            yield pa.record_batch([pa.array(np.arange(n, n + len(rows))), b.column(0).take(at), b.column(1).take(at), pa.array(np.full(len(rows), size, np.int32)), lists], names=["key", "vec_id", "label", "size", "parts"])
            n += len(rows)


def read_parts(raw: list[bytes]) -> np.ndarray:
    """The parts of one position: int64, or Python integers where one is wide."""
    if any(r[:1] == b"w" for r in raw):
        return np.array([[int(v) for v in r[1:].split(b",")] if r[:1] == b"w" else np.frombuffer(r, "<i4", offset=1).tolist() for r in raw], object)
    return np.frombuffer(b"".join(r[1:] for r in raw), "<i4").reshape(len(raw), -1).astype(np.int64)


def nearest_entry(x: np.ndarray, book: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Index and exact squared distance of each row's nearest entry; ties to the lower index."""
    if x.dtype != object and all(map(fits, book)):
        c = np.array(book, np.int64)
        most = int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
        if 4 * most * most * x.shape[1] < EXACT:  # every sum of products is a whole number that doubles hold
            y, e = x.astype(np.float64), c.astype(np.float64)
            d2 = (e * e).sum(1) - 2 * (y @ e.T)
            at = d2.argmin(1)
            return at, (d2[np.arange(len(x)), at] + (y * y).sum(1)).astype(np.int64)
    best = at = None
    for j, entry in enumerate(book):
        d2 = squared(x, entry)
        if best is None:
            best, at = d2, np.zeros(len(x), np.int64)
        else:
            less = (d2 < best).astype(bool)
            best, at = np.where(less, d2, best), np.where(less, j, at)
    return at, best


def weighted_sums(x: np.ndarray, weights: np.ndarray, at: np.ndarray, entries: int) -> list[list[int]]:
    """For each entry the exact weighted sums of its rows, and its weight at the end."""
    out = [[0] * (x.shape[1] + 1) for _ in range(entries)]
    if x.dtype == object:
        for v, w, e in zip(x, weights.tolist(), at.tolist()):
            for d, one in enumerate([*v, 1]):
                out[e][d] += int(one) * w
        return out
    y, shift, w = np.concatenate([x, np.ones((len(x), 1), np.int64)], 1), 0, weights.copy()
    while len(w) and w.any():  # weights 16 bits at a time: 2^30 * 2^16 * 2^16 rows fit a long
        part = w & 0xFFFF
        for s in range(0, len(y), 1 << 16):
            sums = np.zeros((entries, y.shape[1]), np.int64)
            np.add.at(sums, at[s : s + (1 << 16)], y[s : s + (1 << 16)] * part[s : s + (1 << 16), None])
            for e in np.flatnonzero(sums.any(1)):
                for d, v in enumerate(sums[e].tolist()):
                    out[e][d] += v << shift
        shift, w = shift + 16, w >> 16
    return out


def _by_position(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(position, parts as bytes, parts as numbers, weights) of each batch of ``pos``, ``part``, ``n``."""
    for b in batches:
        pos = np.asarray(b.column(0))
        raw, n = b.column(1).to_pylist(), np.asarray(b.column(2))
        for p in np.unique(pos):
            rows = np.flatnonzero(pos == p)
            own = [raw[k] for k in rows]
            yield int(p), own, read_parts(own), n[rows]


def lloyd_round(distinct: DataFrame, books: list[list[list[int]]]) -> list[list[list[int]]]:
    """The codebooks after one round over the distinct parts ``pos``, ``part``, ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for p, _, x, n in _by_position(batches):
            at, _ = nearest_entry(x, books[p])
            for e, row in enumerate(weighted_sums(x, n, at, len(books[p]))):
                if row[-1]:
                    for d, v in zip([*range(len(row) - 1), COUNT], row):
                        sums.add(p, e, d, v)
        rows = sums.rows()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema([(c, pa.int64() if c == "value" else pa.int32()) for c in ("g", "entry", "dim", "limb", "value")]))

    found = totals(distinct.select("pos", "part", "n").mapInArrow(run, SUMS))
    return [[[found[p, e, d] // found[p, e, COUNT] for d in range(len(entry))] if found.get((p, e, COUNT)) else entry for e, entry in enumerate(book)] for p, book in enumerate(books)]


def coded_parts(distinct: DataFrame, books: list[list[list[int]]]) -> DataFrame:
    """``pos``, ``part``, ``n``, ``code`` and ``error`` (null beyond a long) of each distinct part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, raw, x, n in _by_position(batches):
            at, d2 = nearest_entry(x, books[p])
            yield pa.record_batch([pa.array(np.full(len(raw), p, np.int32)), pa.array(raw, pa.binary()), pa.array(n), pa.array(at.astype(np.int32)), pa.array([as_long(v) for v in d2.tolist()], pa.int64())], names=["pos", "part", "n", "code", "error"])

    return distinct.select("pos", "part", "n").mapInArrow(run, "pos int, part binary, n long, code int, error long")


def _one_length(kept: DataFrame, size: int, count: int, first: list, parts: int, factor: int, rounds: int) -> DataFrame:
    """``key``, ``vec_id``, ``label``, ``code``, ``error`` and the codebooks' digest of the vectors of one length."""
    d = size // parts
    books = [[[whole(v, factor) for v in row[p * d : (p + 1) * d]] for row in first] for p in range(parts)]
    exploded = kept.where(F.col("size") == size).select("key", "vec_id", "label", F.posexplode("parts").alias("pos", "part"))
    distinct = written(exploded.groupBy("pos", "part").agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions("pos"), "code-parts")
    for _ in range(rounds):
        books = lloyd_round(distinct, books)
    told = hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()
    known = written(coded_parts(distinct, books), "coded-parts")
    drop(distinct)
    # a vector's id and label travel once, with its first part
    light = exploded.select("key", "pos", "part", *(F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in ("vec_id", "label")))
    met = join_counted(light, known, ["pos", "part"], F.col("n") * SHARE >= count)
    digits = [F.max(F.when(F.col("pos") == p, F.lower(F.lpad(F.hex("code"), 2, "0")))) for p in range(parts)]
    fitting = (F.count("error") == parts) & (F.sum(F.col("error").cast("decimal(20,0)")) <= LONG_MAX)
    rows = met.groupBy("key").agg(F.max("vec_id").alias("vec_id"), F.max("label").alias("label"), F.concat(*digits).alias("code"), F.when(fitting, F.sum(F.col("error").cast("decimal(20,0)"))).cast("long").alias("error"))
    return rows.withColumn("codebooks_sha256", F.lit(told))


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, factor: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """The code of every vector, each component taken as ``floor(factor * x)``.

    A position's codebook starts as that part of the ``entries`` least ids.
    Columns: ``vec_id``, ``code`` string (two hex digits a part), ``error`` long,
    ``label_error`` long (over equal labels), ``codebooks_sha256`` string.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code of two hex digits stands for at most 256 entries")
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    types = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}

    kept = written(rows.mapInArrow(lambda b: split_vectors(b, parts, factor), f"key long, vec_id {types['vec_id']}, label {types['label']}, size int, parts array<binary>"), "code-vectors")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    by_length = []
    for r in kept.groupBy("size").count().collect():
        some = rows.where((F.size("v") == r["size"]) & finite).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
        by_length.append(_one_length(kept, r["size"], r["count"], [x["v"] for x in some], parts, factor, rounds))
    if not by_length:
        return rows.limit(0).selectExpr("vec_id", "'' as code", "0L as error", "0L as label_error", "'' as codebooks_sha256")
    coded = written(reduce(DataFrame.unionByName, by_length), "coded-vectors")
    drop(kept)
    sums = F.sum(F.col("error").cast("decimal(38,0)"))
    labels = coded.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.when((F.count("error") == F.count(F.lit(1))) & (sums <= LONG_MAX), sums).cast("long").alias("label_error"))
    total = coded.count()
    out = join_counted(coded, labels, ["label"], F.col("n") * SHARE >= total)
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")
