"""Attention over whole groups in blocks, against the form with a row for each pair."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from posegrid.operators import losses as lo
from posegrid.operators.attention import group_attention


def seen(df):
    return sorted((x.g, x.q_id, tuple(None if y is None else round(y, 9) for y in x.out)) for x in df.collect())


@pytest.mark.parametrize("most,block", [(8192, 512), (3, 2), (1, 1)])
def test_blocks_are_all_pairs(spark, most, block):
    r = np.random.default_rng(1)
    vector = lambda n: r.normal(size=n).tolist()
    # q_id 3 comes three times: one query over all its keys
    q = spark.createDataFrame([(g, i % 9, vector(4)) for g in "ab" for i in range(12)] + [("a", 3, vector(4)), ("z", 1, vector(4))], "g string, q_id long, q array<double>")
    kv = spark.createDataFrame([(g, vector(4), vector(2)) for g in "ab" for _ in range(7)] + [("a", None, [1.0, 2.0]), ("b", [1.0, None, 1.0, 1.0], [5.0, 5.0]), ("a", vector(4), None), ("y", vector(4), [1.0, 1.0])], "g string, k array<double>, v array<double>")
    want = lo.vector_attention(q, kv, ["g"], F.lit(0.0))
    assert seen(group_attention(q, kv, ["g"], most, block)) == seen(want)


def test_no_pair_rows(spark):
    df = spark.range(50).selectExpr("1 AS g", "id AS q_id", "array(1.0D, 0.5D) AS q", "array(1.0D, 0.5D) AS k", "array(2.0D) AS v")
    out = lo.vector_attention(df.select("g", "q_id", "q"), df.select("g", "k", "v"), ["g"])
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert {x.out[0] for x in out.collect()} == {2.0}
