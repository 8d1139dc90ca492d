"""Least-squares start times of any number of cameras from the offsets of some pairs.

The offsets of pairs are the differences of start times, so the starts solve a
Laplacian system of the pair graph.  A scene of few cameras is solved in one task
as a matrix of cameras by cameras.  In a larger one, and in all larger ones at the
same time, conjugate gradients work on a table with a row for each camera: a
product with the Laplacian is a join of the pairs with that table and a sum, and
the numbers of a step are sums over a scene.  A pair is never gathered with
the others, whatever their number.

Every connected part is relative to its first camera.  Defined results: pairs
with a null camera or offset, and pairs of a camera with itself, say nothing, and
cameras that only they name are left out; pairs that repeat count as often; an
empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.session import ensure_checkpoint_dir

#: Cameras of a scene that are solved in one task, as a matrix of so many squared.
SMALL = 1024
#: Steps after which the residual must have come down to ``CLOSE`` of the first one.
STEPS, CLOSE = 500, 1e-10


def _least_squares(nodes: list, pairs: list[tuple]) -> np.ndarray:
    """Starts of each camera relative to the first of its part; pairs are (i, j, number, sum of offsets)."""
    at = {c: k for k, c in enumerate(nodes)}
    lap, rhs = np.zeros((len(nodes), len(nodes))), np.zeros(len(nodes))
    up = list(range(len(nodes)))

    def find(k: int) -> int:
        while up[k] != k:
            up[k] = k = up[up[k]]
        return k

    for i, j, n, total in pairs:
        a, b = at[i], at[j]
        lap[a, a] += n
        lap[b, b] += n
        lap[a, b] -= n
        lap[b, a] -= n
        rhs[a] -= total
        rhs[b] += total
        low, high = sorted((find(a), find(b)))
        up[high] = low
    first = np.array([find(k) for k in range(len(nodes))])
    own = np.flatnonzero(first != np.arange(len(nodes)))  # firsts are fixed at 0: the rest is regular
    t = np.zeros(len(nodes))
    if len(own):
        t[own] = np.linalg.solve(lap[np.ix_(own, own)], rhs[own])
    return t


def _small(pairs: DataFrame, keys: list[str]) -> DataFrame:
    kinds = dict(pairs.dtypes)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        cams = sorted({*pdf.i, *pdf.j})
        out = pd.DataFrame({"cam": cams, "t": _least_squares(cams, [*zip(pdf.i, pdf.j, pdf.n, pdf.total)])})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "cam", "t"]]

    return pairs.groupBy(*keys).applyInPandas(solve, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", cam {kinds['i']}, t double")


def _parts(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``cam`` and ``part``, the first camera of the connected part: minima pass
    along edges, and each camera then takes its part's own part."""
    labels, changed = nodes.select(*keys, "cam", F.col("cam").alias("part")), None
    while changed != 0:
        near = edges.join(labels.withColumnsRenamed({"cam": "other"}), [*keys, "other"]).groupBy(*keys, "cam").agg(F.min("part").alias("near"))
        told = labels.join(near, [*keys, "cam"], "left").select(*keys, "cam", F.col("part").alias("before"), F.least("part", F.coalesce("near", "part")).alias("part"))
        jump = told.select(*keys, F.col("cam").alias("part"), F.col("part").alias("further"))
        now = told.join(jump, [*keys, "part"]).select(*keys, "cam", "before", F.least("part", "further").alias("part")).checkpoint()
        changed = now.where("part <> before").count()
        labels = now.drop("before")
    return labels


def _large(pairs: DataFrame, keys: list[str], steps: int, close: float) -> DataFrame:
    """Conjugate gradients with one sum over a scene for each step; residuals count in parts of
    the cameras' degrees (Jacobi).  A step is one job, whose table is the next one's."""
    edges = pairs.select(*keys, F.col("i").alias("cam"), F.col("j").alias("other"), "n", (-F.col("total")).alias("total"))
    edges = edges.union(pairs.select(*keys, "j", "i", "n", "total")).checkpoint()
    nodes = edges.groupBy(*keys, "cam").agg(F.sum("n").alias("degree"), F.sum("total").alias("r"))
    zero = {c: F.lit(0.0) for c in ("t", "p", "s", "alpha", "gamma")}
    state = nodes.withColumns(zero).checkpoint()
    weight = F.col("r") * F.col("r") / F.col("degree")
    first = {tuple(x[k] for k in keys): x["g"] for x in state.groupBy(*keys).agg(F.sum(weight).alias("g")).collect()}  # a row for each large scene
    for step in range(steps + 1):
        now = {tuple(x[k] for k in keys): x["g"] for x in state.groupBy(*keys).agg(F.sum(weight).alias("g")).collect()}
        left = [k for k, g in now.items() if g > close * close * first[k]]
        if not left:
            break
        if step == steps:
            raise ArithmeticError(f"{len(left)} scenes are not solved after {steps} steps")
        u = F.col("r") / F.col("degree")
        pull = edges.join(state.select(*keys, F.col("cam").alias("other"), u.alias("u_other")), [*keys, "other"]).groupBy(*keys, "cam").agg(F.sum(F.col("n") * F.col("u_other")).alias("pull"))
        pulled = state.join(pull, [*keys, "cam"]).withColumns({"u": u, "w": F.col("r") - F.col("pull")}).drop("pull")
        sums = pulled.groupBy(*keys).agg(F.sum(F.col("r") * F.col("u")).alias("new_gamma"), F.sum(F.col("w") * F.col("u")).alias("delta"))
        beta = F.when(F.col("gamma") > 0, F.col("new_gamma") / F.col("gamma")).otherwise(F.lit(0.0))
        below = F.col("delta") - F.when(F.col("alpha") > 0, F.col("beta") * F.col("new_gamma") / F.col("alpha")).otherwise(F.lit(0.0))
        met = pulled.join(sums, keys).withColumn("beta", beta).withColumn("below", below)
        met = met.withColumn("alpha", F.when(F.col("below") > 0, F.col("new_gamma") / F.col("below")).otherwise(F.lit(0.0)))
        met = met.withColumns({"p": F.col("u") + F.col("beta") * F.col("p"), "s": F.col("w") + F.col("beta") * F.col("s")})
        state = met.select(*keys, "cam", "degree", (F.col("r") - F.col("alpha") * F.col("s")).alias("r"), (F.col("t") + F.col("alpha") * F.col("p")).alias("t"), "p", "s", "alpha", F.col("new_gamma").alias("gamma")).checkpoint()
    parts = _parts(nodes, edges, keys)
    found = state.select(*keys, "cam", "t").join(parts, [*keys, "cam"])
    base = found.where("cam = part").select(*keys, "part", F.col("t").alias("t0"))
    return found.join(base, [*keys, "part"]).select(*keys, "cam", (F.col("t") - F.col("t0")).alias("t"))


def start_times(pairs: DataFrame, keys: list[str], i: str = "i", j: str = "j", off: str = "off", small: int = SMALL, steps: int = STEPS, close: float = CLOSE) -> DataFrame:
    """``keys``, ``cam`` and ``start``: the first camera of each connected part starts at 0, and
    all of a scene are shifted up only if the least start is negative."""
    rows = pairs.select(*keys, F.col(i).alias("i"), F.col(j).alias("j"), F.col(off).cast("double").alias("off")).dropna(subset=["i", "j", "off"]).where("i <> j")
    # a pair in either direction is one row
    flip = F.col("i") > F.col("j")
    turned = rows.select(*keys, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.when(flip, -F.col("off")).otherwise(F.col("off")).alias("off"))
    summed = turned.groupBy(*keys, "i", "j").agg(F.count(F.lit(1)).alias("n"), F.sum("off").alias("total"))
    cams = summed.select(*keys, "i").union(summed.select(*keys, "j")).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("cams"))
    large = cams.where(F.col("cams") > small).select(*keys)
    if large.isEmpty():
        found = _small(summed, keys)
    else:
        ensure_checkpoint_dir(pairs.sparkSession)
        found = _small(summed.join(large, keys, "left_anti"), keys).unionByName(_large(summed.join(large, keys, "left_semi"), keys, steps, close))
    low = found.groupBy(*keys).agg(F.least(F.min("t"), F.lit(0.0)).alias("low"))
    return found.join(low, keys).select(*keys, "cam", (F.col("t") - F.col("low")).alias("start"))
