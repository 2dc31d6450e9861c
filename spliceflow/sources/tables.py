"""The given tables in the roles the operators know: irregular events, beat vectors, regular signals. Rows of a track are numbered
from 0 in time order; a track is one partition of a window, so tracks spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, track: str, *order: str) -> DataFrame:
    return df.withColumn("i", F.row_number().over(Window.partitionBy(track).orderBy(*order)).cast("long") - 1)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track, i, t, x, label) per user; t runs from 2024 in units of 30 000 s, which puts neighbouring events about one apart."""
    e = table(spark, sf_dir, "events").withColumn("t", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6) - F.lit(1704067200.0)) / F.lit(30000.0))
    return numbered(e, "user_id", "t", "event_id").select(F.col("user_id").alias("track"), "i", "t", F.col("value").alias("x"), F.col("event_type").alias("label"))


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track, beat, feat) per label of the embeddings."""
    e = numbered(table(spark, sf_dir, "embeddings"), "label", "vec_id")
    return e.select(F.col("label").cast("long").alias("track"), F.col("i").alias("beat"), F.col("embedding").cast("array<double>").alias("feat"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track, i, x): prices in order per supplier, as a regular series."""
    s = numbered(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return s.select(F.col("l_suppkey").alias("track"), "i", (F.col("l_extendedprice").cast("double") / F.lit(1e5)).alias("x"))
