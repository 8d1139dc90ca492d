"""The driver's tables in the engine's data model, in Spark and in DuckDB SQL.

Each view is defined twice so that a query's SQL can begin with ``WITH``
clauses over the base tables; ``ctes`` writes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_EPOCH = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_type AS video_id", f"CAST(timestampdiff(HOUR, {_EPOCH}, ts) AS INT) AS frame_idx", "user_id AS person_id", "round(value / 500, 6) AS score", "event_id AS ord"
    )


def gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("label AS scene_id", "CAST(vec_id % 4 AS INT) AS video_id", "vec_id DIV 4 AS person_id", "transform(embedding, x -> CAST(x AS DOUBLE)) AS descriptor")


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr(
        "label AS scene_id", "vec_id", "CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS rk", "transform(embedding, x -> CAST(x AS DOUBLE)) AS e"
    )


def joints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranked(spark, sf_dir).withColumn("joint", F.explode(F.sequence(F.lit(0), F.lit(20))))
    return rows.selectExpr(
        "scene_id", "CAST(rk % 2 AS INT) AS video_id", "CAST(rk DIV 2 AS INT) AS frame_idx", "CAST((rk DIV 2) % 3 AS INT) AS person_id", "joint", "e[3*joint] AS x", "e[3*joint+1] AS y", "e[3*joint+2] AS z", "abs(e[63]) AS conf"
    )


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six cameras of a scene that are paired with each other."""
    return all_cameras(spark, sf_dir).where("cam < 6")


def all_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranked(spark, sf_dir).withColumn("n", F.expr("sqrt(e[0]*e[0]+e[1]*e[1]+e[2]*e[2]+e[3]*e[3])"))
    return rows.selectExpr("scene_id", "rk AS cam", "e[0]/n AS qw", "e[1]/n AS qx", "e[2]/n AS qy", "e[3]/n AS qz", "e[4] AS tx", "e[5] AS ty", "e[6] AS tz", "e[7]*10 AS focal_raw")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS frame_idx", "CAST(l_linenumber AS INT) AS ord", "CAST(l_partkey % 16 AS INT) AS x1", "CAST(l_suppkey % 16 AS INT) AS y1",
        "CAST(least(63, l_partkey % 16 + floor(l_quantity * 1.3)) AS INT) AS x2", "CAST(least(63, l_suppkey % 16 + 1 + (l_orderkey * 7) % 63) AS INT) AS y2",
        "64 AS img_w", "64 AS img_h", "l_discount * 10 AS score",
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("event_type AS video_id", f"CAST(datediff(ts, {_EPOCH}) AS INT) AS frame_idx", "value")
    return rows.groupBy("video_id", "frame_idx").agg(F.avg("value").alias("v"))


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS video_id", "CAST(1 + c_custkey % 200 AS INT) AS num_frames", "30D AS fps")


def pair_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "nation").where("n_nationkey < 6").selectExpr("n_nationkey AS i")
    b = a.withColumnRenamed("i", "j")
    # Six cameras: the bound of the pair table is fixed.
    return a.join(F.broadcast(b), F.col("i") < F.col("j")).selectExpr("i", "j", "CAST((i*7 + j*13) % 21 - 10 AS DOUBLE) AS off")


SQL = {
    "detections": "SELECT event_type AS video_id, CAST(date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', ts) AS INT) AS frame_idx, user_id AS person_id, round(value/500, 6) AS score, event_id AS ord FROM events",
    "gallery": "SELECT label AS scene_id, CAST(vec_id % 4 AS INT) AS video_id, vec_id // 4 AS person_id, embedding::DOUBLE[] AS descriptor FROM embeddings",
    "ranked": "SELECT label AS scene_id, vec_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS rk, embedding::DOUBLE[] AS e FROM embeddings",
    "joints": "SELECT scene_id, CAST(rk % 2 AS INT) AS video_id, CAST(rk // 2 AS INT) AS frame_idx, CAST((rk // 2) % 3 AS INT) AS person_id, CAST(j AS INT) AS joint, e[3*j+1] AS x, e[3*j+2] AS y, e[3*j+3] AS z, abs(e[64]) AS conf FROM ranked, range(0, 21) t(j)",
    "cameras": "SELECT scene_id, rk AS cam, e[1]/n AS qw, e[2]/n AS qx, e[3]/n AS qy, e[4]/n AS qz, e[5] AS tx, e[6] AS ty, e[7] AS tz, e[8]*10 AS focal_raw FROM (SELECT *, sqrt(e[1]*e[1]+e[2]*e[2]+e[3]*e[3]+e[4]*e[4]) AS n FROM ranked) WHERE rk < 6",
    "all_cameras": "SELECT scene_id, rk AS cam, e[1]/n AS qw, e[2]/n AS qx, e[3]/n AS qy, e[4]/n AS qz, e[5] AS tx, e[6] AS ty, e[7] AS tz, e[8]*10 AS focal_raw FROM (SELECT *, sqrt(e[1]*e[1]+e[2]*e[2]+e[3]*e[3]+e[4]*e[4]) AS n FROM ranked)",
    "boxes": "SELECT l_orderkey AS frame_idx, CAST(l_linenumber AS INT) AS ord, CAST(l_partkey % 16 AS INT) AS x1, CAST(l_suppkey % 16 AS INT) AS y1, CAST(least(63, l_partkey % 16 + floor(l_quantity * 1.3)) AS INT) AS x2, CAST(least(63, l_suppkey % 16 + 1 + (l_orderkey * 7) % 63) AS INT) AS y2, 64 AS img_w, 64 AS img_h, l_discount * 10 AS score FROM lineitem",
    "series": "SELECT event_type AS video_id, CAST(date_diff('day', TIMESTAMP '2024-01-01 00:00:00', ts) AS INT) AS frame_idx, avg(value) AS v FROM events GROUP BY 1, 2",
    "videos": "SELECT c_custkey AS video_id, CAST(1 + c_custkey % 200 AS INT) AS num_frames, 30::DOUBLE AS fps FROM customer",
    "pair_offsets": "SELECT a.n_nationkey AS i, b.n_nationkey AS j, CAST((a.n_nationkey*7 + b.n_nationkey*13) % 21 - 10 AS DOUBLE) AS off FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey WHERE b.n_nationkey < 6",
}
_NEEDS = {"joints": ["ranked"], "cameras": ["ranked"], "all_cameras": ["ranked"]}


def ctes(*names: str, recursive: bool = False, **more: str) -> str:
    """``WITH`` clauses of the named views, then of ``more`` in the order given."""
    order: list[str] = []
    for n in names:
        order += [x for x in [*_NEEDS.get(n, []), n] if x not in order]
    parts = [f"{n} AS ({SQL[n]})" for n in order] + [f"{n} AS ({q})" for n, q in more.items()]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(parts) + " "
