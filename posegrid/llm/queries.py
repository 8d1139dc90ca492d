"""One query per operator of this subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, clusters, codes, decontaminate, jaccard, language, nearest, quality, repeats, sharding, token_counts, token_files, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows for each core up to which a table is dealt out to all cores.
FEW = 4096


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; a table of few rows, which may be one row group of one file, is
    dealt out to all cores.  Counting the rows of a Parquet table reads its footers only."""
    docs = table(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.count() <= FEW * cores else docs


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(documents(spark, sf_dir), width=3, percent=90)


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), end_id=2)


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_scores(documents(spark, sf_dir))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clusters(table(spark, sf_dir, "embeddings"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_sharding, op3_jaccard_join, op4_nearest, op5_bpe, op6_decontamination, op7_repeats, op8_toxicity, op9_quality, op10_token_files, op11_language, op12_clusters, op13_codes)}


def oracle_sql() -> dict[str, str]:
    """None: every one needs a hash, a tokenizer or a model that SQL lacks."""
    return {}
