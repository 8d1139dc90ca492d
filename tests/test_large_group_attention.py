"""One large group's queries are dealt over tasks."""

from __future__ import annotations

from posegrid.operators import attention as at


def test_one_group_in_parts(spark):
    df = spark.range(400).selectExpr("1 AS g", "id AS q_id", "array(CAST(id AS DOUBLE), 1.0D) AS q", "array(1.0D, 0.0D) AS k", "array(CAST(id AS DOUBLE)) AS v")
    out = at.group_attention(df.select("g", "q_id", "q"), df.select("g", "k", "v"), ["g"], most=50)
    rows = out.collect()
    assert len({x.q_id for x in rows}) == len(rows) == 400
    assert all(abs(x.out[0] - 199.5) < 1e-9 for x in rows)
