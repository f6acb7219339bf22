"""Synthetic vectors and their readers and writers. Only distributions are fixed, not the random numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _vector(dim: int, seed: int, factor=None) -> Column:
    parts = [(F.rand(seed * 1000 + i) * 2 - 1) * (factor(i) if factor else F.lit(1.0)) for i in range(dim)]
    return F.array(*parts).cast("array<float>")


def uniform(spark: SparkSession, base: int = 10_000, updates: int = 1_000, queries: int = 200, dim: int = 64, seed: int = 404) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(base, updates, queries): components in [-1, 1); a fifth of the updates has its second half 2.5 times as large."""
    rows = spark.range(base).select("id", _vector(dim, seed).alias("values"))
    drawn = spark.range(updates).withColumn("wide", F.rand(seed + 1) < 0.2)
    changed = drawn.select(F.col("id").alias("pos"), F.floor(F.rand(seed + 2) * base).cast("long").alias("id"), _vector(dim, seed + 3, lambda i: F.when(F.col("wide") & F.lit(i >= dim // 2), 2.5).otherwise(1.0)).alias("values"))
    asked = spark.range(queries).select(F.col("id").alias("qid"), _vector(dim, seed + 4).alias("values"))
    return rows, changed, asked


def anisotropic(spark: SparkSession, base: int = 25_000, queries: int = 500, dim: int = 96, seed: int = 404) -> tuple[DataFrame, DataFrame]:
    """Components scaled by 3 in the first quarter, 1.5 up to the half and 0.5 after it."""
    factor = lambda i: F.lit(3.0 if i < dim // 4 else 1.5 if i < dim // 2 else 0.5)
    return spark.range(base).select("id", _vector(dim, seed, factor).alias("values")), spark.range(queries).select(F.col("id").alias("qid"), _vector(dim, seed + 1, factor).alias("values"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def read_json(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(id, values); raises on vectors of another dimension."""
    rows = spark.read.schema("id long, values array<float>").json(path)
    if not rows.filter(F.coalesce(F.size("values"), F.lit(-1)) != dim).isEmpty():
        raise ValueError(f"vectors must have {dim} components")
    return rows
