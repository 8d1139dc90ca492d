"""Attention over a band of time, with heads and confidences, in one shuffle; and over a whole group.

A frame attends to the frames at most ``reach`` away.  Time is cut into tiles; a
row goes to its own tile and, as a key only, to the tiles that it can be seen
from, so every query meets all its keys in one task and no row for a pair is ever
made.  There keys are taken a block at a time and what they give is merged: the
greatest score so far, and the sums of weights and of weighted values scaled to
it.  Merging is exact in any order, so blocks bound the memory and not the result.

Scores are scaled by the root of a head's length; with confidences, the logarithm
of both frames' product (plus 1e-6) is added.

Defined results: a row without a query, or with a null component in it, has a
null result; one without a key or value is no key; a null confidence counts as 0;
a row whose band has no key has a null result; rows that share a frame are keys
and queries of their own; rows without a frame are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frames of a tile, and queries and keys of a block.
TILE, BLOCK = 2048, 512


class Running:
    """Softmax sums of some queries over the keys seen so far: (queries, heads) and values."""

    def __init__(self, n: int, heads: int, size: int):
        self.top = np.full((n, heads), -np.inf)
        self.weight = np.zeros((n, heads))
        self.value = np.zeros((n, heads, size))

    def scaled(self, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights and values with ``top`` as the greatest score."""
        with np.errstate(invalid="ignore"):
            by = np.where(np.isneginf(self.top), 0.0, np.exp(self.top - top))
        return self.weight * by, self.value * by[..., None]

    def merge(self, other: Running) -> Running:
        top = np.maximum(self.top, other.top)
        (a, x), (b, y) = self.scaled(top), other.scaled(top)
        self.top, self.weight, self.value = top, a + b, x + y
        return self

    @staticmethod
    def of(scores: np.ndarray, values: np.ndarray) -> Running:
        """Scores (queries, heads, keys), -inf where a key is not seen; values (keys, heads, size)."""
        out = Running(scores.shape[0], scores.shape[1], values.shape[2])
        if scores.shape[2]:
            out.top = scores.max(2)
            with np.errstate(invalid="ignore"):
                e = np.where(np.isneginf(scores), 0.0, np.exp(scores - out.top[..., None]))
            out.weight = e.sum(2)
            out.value = np.einsum("qhk,khd->qhd", e, values)
        return out

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        """The attended values, heads side by side, and which queries have any."""
        there = (self.weight > 0).all(1)
        out = np.divide(self.value, self.weight[..., None], out=np.zeros_like(self.value), where=self.weight[..., None] > 0)
        return out.reshape(len(out), -1), there


def attend(frame: np.ndarray, q: np.ndarray, keys_at: np.ndarray, k: np.ndarray, v: np.ndarray, reach: int, heads: int, conf: tuple[np.ndarray, np.ndarray] | None, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Attention of queries (in any order) over keys in frame order."""
    n, size = len(frame), k.shape[1] // heads
    out, there = np.zeros((n, v.shape[1])), np.zeros(n, bool)
    split = lambda x: x.reshape(len(x), heads, -1)
    for s in range(0, n, block):
        own = slice(s, min(s + block, n))
        low, high = np.searchsorted(keys_at, frame[own].min() - reach), np.searchsorted(keys_at, frame[own].max() + reach, side="right")
        run = Running(own.stop - own.start, heads, v.shape[1] // heads)
        for a in range(low, high, block):
            some = slice(a, min(a + block, high))
            scores = np.einsum("qhd,khd->qhk", split(q[own]), split(k[some])) / np.sqrt(size)
            if conf is not None:
                scores = scores + np.log(conf[0][own][:, None] * conf[1][some][None] + 1e-6)[:, None]
            far = np.abs(frame[own][:, None] - keys_at[some][None]) > reach
            run.merge(Running.of(np.where(far[:, None], -np.inf, scores), split(v[some])))
        out[own], there[own] = run.result()
    return out, there


def temporal_attention(rows: DataFrame, keys: list[str], order: str, reach: int, heads: int = 1, conf: str | None = None, tile: int = TILE) -> DataFrame:
    """``keys``, ``order`` and ``out`` of every row: attention of ``q`` over ``k`` and ``v`` (arrays
    whose lengths are multiples of ``heads``) of the rows of its group within ``reach``."""
    if reach < 0 or heads < 1:
        raise ValueError("a reach is not negative, and there is a head at least")
    kinds = dict(rows.dtypes)
    own = rows.select(*keys, F.col(order).alias("_at"), *(F.col(c).cast("array<double>").alias(f"_{c}") for c in "qkv"), (F.coalesce(F.col(conf).cast("double"), F.lit(0.0)) if conf else F.lit(1.0)).alias("_conf")).where(F.col("_at").isNotNull())
    number = lambda at: F.floor(at / F.lit(tile)).cast("long")
    sent = own.withColumn("_tile", F.explode(F.sequence(number(F.col("_at") - reach), number(F.col("_at") + reach)))).withColumn("_own", F.col("_tile") == number(F.col("_at")))

    def whole(column: pa.ChunkedArray) -> np.ndarray:
        """Which arrays are there, of some length, without nulls."""
        return np.array([x is not None and len(x) > 0 and None not in x for x in column.to_pylist()], bool)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        at, mine = table["_at"].to_numpy().astype(np.int64), table["_own"].to_numpy().astype(bool)
        c = table["_conf"].to_numpy()
        ok = {n: whole(table[f"_{n}"]) for n in "qkv"}
        arrays = lambda n, some: np.array(table[f"_{n}"].take(pa.array(some)).to_pylist(), float)
        queries, seen = np.flatnonzero(mine & ok["q"]), np.flatnonzero(ok["k"] & ok["v"])
        seen = seen[np.argsort(at[seen], kind="stable")]
        queries = queries[np.argsort(at[queries], kind="stable")]
        found: dict[int, list] = {}
        if len(queries) and len(seen):
            q, k, v = arrays("q", queries), arrays("k", seen), arrays("v", seen)
            if q.shape[1] != k.shape[1] or q.shape[1] % heads or v.shape[1] % heads:
                raise ValueError(f"queries of {q.shape[1]}, keys of {k.shape[1]} and values of {v.shape[1]} components do not go into {heads} heads")
            out, there = attend(at[queries], q, at[seen], k, v, reach, heads, (c[queries], c[seen]) if conf else None)
            found = {int(r): o for r, o, t in zip(queries, out.tolist(), there) if t}
        rows_out = np.flatnonzero(mine)
        columns = [pa.array([s.as_py()] * len(rows_out), s.type) for s in key[:-1]]
        return pa.table([*columns, table["_at"].take(pa.array(rows_out)), pa.array([found.get(int(r)) for r in rows_out], pa.list_(pa.float64()))], names=[*keys, order, "out"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, order]) + ", out array<double>"
    return sent.groupBy(*keys, "_tile").applyInArrow(run, schema)


#: Queries (about) of a task of ``group_attention``.
QUERIES = 8192


def group_attention(queries: DataFrame, keys_values: DataFrame, group: list[str], most: int = QUERIES, block: int = BLOCK) -> DataFrame:
    """``group``, ``q_id`` and ``out``: attention of each ``q`` over all ``k`` and ``v`` of its group.

    A large group's queries are dealt over tasks by their id, and its keys go to each of them.
    A query or key with a null (or of another length) does not count with the other, nor does a
    key without values; a query that no key counts for has no numbers; rows that share a ``q_id``
    are one query over all their keys; groups without keys or queries are left out.
    """
    kinds = {c: queries.schema[c].dataType.simpleString() for c in [*group, "q_id"]}
    some = queries.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    parts = max(1, -(-some // most))
    array = lambda c: F.col(c).cast("array<double>")
    none = F.lit(None).cast("array<double>")
    q = queries.select(*group, "q_id", array("q").alias("q"), none.alias("v"), F.lit(True).alias("asks"), F.pmod(F.xxhash64("q_id"), F.lit(parts)).cast("int").alias("_part"))
    k = keys_values.select(*group, F.lit(None).cast(kinds["q_id"]).alias("q_id"), array("k").alias("q"), array("v").alias("v"), F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
    both = q.unionByName(k)
    for c in group:
        both = both.where(F.col(c).isNotNull())

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy().astype(bool)
        left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
        ids = table["q_id"].take(pa.array(left)).combine_chunks()
        vectors, values = (table[c].to_pylist() for c in ("q", "v"))
        right = np.array([i for i in right if values[i]], int)
        whole = lambda i: vectors[i] is not None and len(vectors[i]) > 0 and None not in vectors[i]
        size = len(values[right[0]]) if len(right) else 0
        run, compared = Running(len(left), 1, size), {}
        for n, i in enumerate(left):
            if whole(i):
                compared.setdefault(len(vectors[i]), []).append(n)
        for dim, own in compared.items():
            seen = [i for i in right if whole(i) and len(vectors[i]) == dim]
            ks = np.array([vectors[i] for i in seen], float).reshape(-1, dim)
            vs = np.array([values[i] for i in seen], float).reshape(len(seen), 1, size)
            for s in range(0, len(own), block):
                at = np.array(own[s : s + block])
                x = np.array([vectors[left[n]] for n in at], float) / np.sqrt(dim)
                part = Running(len(at), 1, size)
                for t in range(0, len(ks), block):
                    part.merge(Running.of((x @ ks[t : t + block].T)[:, None], vs[t : t + block]))
                run.top[at], run.weight[at], run.value[at] = part.top, part.weight, part.value
        # rows of one id are merged one after the other
        first: dict = {}
        turns: list[list[tuple[int, int]]] = []
        times: dict = {}
        for n, i in enumerate(ids.to_pylist()):
            to = first.setdefault(i, n)
            if to != n:
                times[to] = times.get(to, 0) + 1
                while len(turns) < times[to]:
                    turns.append([])
                turns[times[to] - 1].append((to, n))
        pick = lambda own: _rows(run, np.array(own))
        for turn in turns:
            to = np.array([a for a, _ in turn])
            got = pick(to).merge(pick([b for _, b in turn]))
            run.top[to], run.weight[to], run.value[to] = got.top, got.weight, got.value
        one = np.array(list(first.values()) if len(right) else [], int)
        out, there = _rows(run, one).result() if len(one) else (np.zeros((0, size)), np.zeros(0, bool))
        columns = [pa.array([c.as_py()] * len(one), c.type) for c in key[:-1]]
        lists = [o if t else [None] * size for o, t in zip(out.tolist(), there.tolist())]
        return pa.table([*columns, ids.take(pa.array(one)), pa.array(lists, pa.list_(pa.float64()))], names=[*group, "q_id", "out"])

    def each(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(key, pa.Table.from_batches(batches)).to_batches()

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*group, "q_id"]) + ", out array<double>"
    return both.groupBy(*group, "_part").applyInArrow(each, schema)


def _rows(run: Running, at: np.ndarray) -> Running:
    out = Running(0, 1, 0)
    out.top, out.weight, out.value = run.top[at], run.weight[at], run.value[at]
    return out
