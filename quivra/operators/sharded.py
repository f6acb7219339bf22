"""Search over shards by id: each shard's best, then the global best; shards that can't contribute are left out by geometry."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quivra.functions.vector import norm2, squared_l2
from quivra.operators import ivf
from quivra.operators.ivf import means, plain
from quivra.operators.knn import exact_knn, ranked


def sharded(base: DataFrame, shards: int) -> DataFrame:
    return plain(base).withColumn("shard", F.pmod("id", F.lit(shards)))


def search(base: DataFrame, queries: DataFrame, k: int, shards: int) -> DataFrame:
    """(qid, rank, id, distance): the k best of each shard merged; equal to a search without shards."""
    found = None
    for s in range(shards):
        part = exact_knn(sharded(base, shards).filter(F.col("shard") == s), queries, k).select("qid", "id", "distance")
        found = part if found is None else found.unionByName(part)
    return ranked(found, k)


def balls(base: DataFrame, shards: int) -> DataFrame:
    """(shard, centroid, radius, norm): a ball around each shard's rows, and their largest norm."""
    rows = sharded(base, shards)
    middle = means(rows.withColumnRenamed("shard", "posting_id")).select(F.col("posting_id").alias("shard"), "centroid")
    far = F.max(F.sqrt(squared_l2("values", "centroid"))).alias("radius")
    return rows.join(F.broadcast(middle), "shard").groupBy("shard").agg(F.first("centroid").alias("centroid"), far, F.max(F.sqrt(norm2("values"))).alias("norm"))


def pruned_search(base: DataFrame, queries: DataFrame, k: int, shards: int) -> DataFrame:
    """The same rows: the shard whose ball is nearest gives each query a k-th distance, and only shards whose ball comes
    nearer than that are searched further. Rows are scored where they are read; k of them a query and task are exchanged."""
    told = balls(base, shards).orderBy("shard").collect()  # a row a shard
    members = sharded(base, shards).withColumnRenamed("shard", "posting_id")
    stats = base.sparkSession.createDataFrame([(r["shard"], r["radius"], r["norm"]) for r in told], "posting_id long, max_radius double, max_l2_norm double")
    return ivf.pruned_search(members, {int(r["shard"]): np.array(r["centroid"]) for r in told}, stats, queries, k, len(told), first=1)
