"""Placement of partitions on endpoints by rendezvous hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The two salts of a score.
SALTS = ("a", "b")


def score(partition: Column, endpoint: Column) -> tuple[Column, Column]:
    """High and low half of a 64-bit score: CRC-32 of (salt, partition, endpoint) with two salts."""
    return tuple(F.crc32(F.concat_ws(":", F.lit(s), partition.cast("string"), endpoint).cast("binary")) for s in SALTS)


def endpoints(spark: SparkSession, names: list[str], own: str | None = None) -> DataFrame:
    """(endpoint): trimmed and distinct, without empty ones and without `own`."""
    rows = spark.createDataFrame([(n,) for n in names], "endpoint string").select(F.trim("endpoint").alias("endpoint")).filter("endpoint != ''").distinct()
    return rows if own is None else rows.filter(F.col("endpoint") != own.strip())


def place(nodes: DataFrame, partitions: int, replicas: int) -> DataFrame:
    """(partition_id, replica_rank, endpoint, is_leader): the same for any order of the endpoints."""
    spark = nodes.sparkSession
    parts = spark.range(partitions).withColumnRenamed("id", "partition_id")
    pairs = parts.crossJoin(F.broadcast(nodes))  # endpoints are the machines of a cluster
    high, low = score(F.col("partition_id"), F.col("endpoint"))
    order = Window.partitionBy("partition_id").orderBy(high.desc(), low.desc(), F.col("endpoint"))
    out = pairs.withColumn("replica_rank", F.row_number().over(order).cast("long")).filter(F.col("replica_rank") <= replicas)
    return out.select("partition_id", "replica_rank", "endpoint", (F.col("replica_rank") == 1).alias("is_leader"))


def problems(placement: DataFrame, partitions: int, replicas: int) -> DataFrame:
    """(partition_id, problem): partitions without the right replicas, with repeated endpoints or without one leader."""
    spark = placement.sparkSession
    per = placement.groupBy("partition_id").agg(F.count("*").alias("n"), F.count_distinct("endpoint").alias("d"), F.sum(F.col("is_leader").cast("int")).alias("leaders"))
    whole = spark.range(partitions).withColumnRenamed("id", "partition_id").join(per, "partition_id", "full_outer")
    problem = F.when(F.col("n").isNull(), "no replicas").when((F.col("partition_id") < 0) | (F.col("partition_id") >= partitions), "unknown partition").when(F.col("n") != replicas, "replica count").when(F.col("d") != F.col("n"), "repeated endpoint").when(F.col("leaders") != 1, "leader")
    return whole.select("partition_id", problem.alias("problem")).filter("problem is not null")


def hosted(placement: DataFrame, endpoint: str) -> DataFrame:
    return placement.filter(F.col("endpoint") == endpoint).select("partition_id", "is_leader")


def partition_of(id_column: Column, partitions: int) -> Column:
    return F.pmod(id_column, F.lit(partitions))


def stats_rollup(stats: DataFrame) -> DataFrame:
    """Sums of counters, and of log positions the bounds: (upserts, deletes, first_seq, next_seq, term)."""
    return stats.agg(F.sum("upserts").alias("upserts"), F.sum("deletes").alias("deletes"), F.min("first_seq").alias("first_seq"), F.max("next_seq").alias("next_seq"), F.max("term").alias("term"))
