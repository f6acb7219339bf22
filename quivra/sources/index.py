"""A stored index of clustered lists: built once, kept up with batches of mutations, searched from the lists that are probed.

Members lie in parts partitioned by cell = posting_id mod cells and sorted by posting, so a search opens the cells of its probes and skips row
groups by posting. A commit appends what changed: new members, and a marker where an id left a posting; the newest commit of (posting, id)
counts. Centroids with sizes and bounds are one small table a commit (at most ivf.MAX_POSTINGS rows), kept up from the rows that moved:
a centroid is a running mean, a radius grows by what its centroid moves, so bounds stay sound until maintain() works them out anew."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quivra.functions.vector import norm2, squared_l2
from quivra.operators import ivf
from quivra.operators import mutations as m
from quivra.operators.knn import DimensionError
from quivra.sources.store import Catalogs, Files

MEMBERS = "posting_id long, id long, values array<double>, gone boolean, commit long, cell long"
LISTS = "posting_id long, centroid array<double>, size long, max_radius double, max_l2_norm double"


class StoredIndex:
    def __init__(self, spark: SparkSession, root: str, dim: int | None = None, cells: int = 64, max_parts: int = 16, split_limit: int = 512, merge_limit: int = 8, scope: int = 8):
        self.spark, self.files = spark, Files(spark, root)
        self.catalogs, self.max_parts = Catalogs(self.files), max_parts
        self.split_limit, self.merge_limit, self.scope = split_limit, merge_limit, scope
        self.catalog = self.catalogs.latest()
        if self.catalog is None:
            if dim is None:
                raise FileNotFoundError(root)
            self.catalog = {"dim": dim, "cells": cells, "generation": -1, "parts": [], "lists": None, "applied": {}}
        elif dim is not None and dim != self.catalog["dim"]:
            raise DimensionError(f"the index has {self.catalog['dim']} components")

    # ---- stored rows

    def _write(self, rows: DataFrame) -> str:
        """Rows (posting_id, id, values, gone) as a part."""
        name = f"part-{uuid.uuid4().hex}"
        out = rows.select("posting_id", "id", "values", "gone").withColumns({"commit": F.lit(self.catalog["generation"] + 1).cast("long"), "cell": F.pmod("posting_id", F.lit(self.catalog["cells"])).cast("long")})
        out.repartition("cell", "posting_id").sortWithinPartitions("cell", "posting_id", "id").write.partitionBy("cell").parquet(f"{self.files.root}/{name}")
        return name

    def _write_lists(self, lists: DataFrame) -> str:
        name = f"part-{uuid.uuid4().hex}"
        lists.select("posting_id", "centroid", "size", "max_radius", "max_l2_norm").write.parquet(f"{self.files.root}/{name}")
        return name

    def _commit(self, members: list[str], lists: str, **more) -> None:
        new = {**self.catalog, **more, "members": members, "lists": lists, "parts": [*members, lists], "generation": self.catalog["generation"] + 1}
        self.catalogs.commit(new)
        self.catalog = new

    def lists(self) -> DataFrame:
        """(posting_id, centroid, size, max_radius, max_l2_norm)."""
        return self.spark.read.schema(LISTS).parquet(f"{self.files.root}/{self.catalog['lists']}")

    def centroids(self) -> dict[int, np.ndarray]:
        rows = self.lists().select("posting_id", "centroid").orderBy("posting_id").toLocalIterator()
        return {int(r["posting_id"]): np.array(r["centroid"]) for r in rows}

    def members(self, postings: list[int] | None = None) -> DataFrame:
        """Live members (posting_id, id, values) of some postings, of all by default; cells and row groups of others are not read."""
        rows = None
        for part in self.catalog["members"]:
            one = self.spark.read.schema(MEMBERS).parquet(f"{self.files.root}/{part}")
            rows = one if rows is None else rows.unionByName(one)
        if postings is not None:
            cells = sorted({p % self.catalog["cells"] for p in postings})
            rows = rows.filter(F.col("cell").isin(cells) & F.col("posting_id").isin(list(postings)))
        if len(self.catalog["members"]) > 1:
            rows = rows.groupBy("posting_id", "id").agg(F.max_by(F.struct("values", "gone"), "commit").alias("r")).select("posting_id", "id", "r.values", "r.gone")
        return rows.filter(~F.col("gone")).select("posting_id", "id", "values")

    # ---- building

    def build(self, base: DataFrame, postings: int, iterations: int = 2) -> None:
        """k-means over base(id, values), its members and lists as the first parts."""
        if not base.filter(F.col("values").isNull() | (F.size("values") != self.catalog["dim"])).isEmpty():
            raise DimensionError(f"rows must have {self.catalog['dim']} components")
        members, centroids = ivf.build(base, postings, iterations)
        self._replace(members, centroids)

    def _replace(self, members: DataFrame, centroids: dict[int, np.ndarray], **more) -> None:
        part = self._write(members.withColumn("gone", F.lit(False)))
        stored = self.spark.read.schema(MEMBERS).parquet(f"{self.files.root}/{part}").select("posting_id", "id", "values")
        self._commit([part], self._write_lists(self._measured(stored, centroids)), **more)

    def _measured(self, members: DataFrame, centroids: dict[int, np.ndarray]) -> DataFrame:
        """Lists with exact sizes and bounds; a posting without members has none."""
        table = self.spark.createDataFrame([(c, [float(x) for x in v]) for c, v in centroids.items()], "posting_id long, centroid array<double>")
        stats = ivf.posting_stats(members, centroids)
        return table.join(stats, "posting_id", "left").select("posting_id", "centroid", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("max_radius", F.lit(0.0)).alias("max_radius"), F.coalesce("max_l2_norm", F.lit(0.0)).alias("max_l2_norm"))

    # ---- mutations

    def apply(self, mutations: DataFrame, batch: tuple[str, int] | None = None) -> dict[str, int]:
        """One atomic commit of mutations(pos, kind, id, values): the last of an id counts; an upsert goes to its nearest posting.

        batch: (writer, number); a number not above the writer's greatest changes nothing."""
        if batch is not None and self.catalog["applied"].get(batch[0], -1) >= batch[1]:
            return {"upserts": 0, "deletes": 0}
        m.validate(mutations, self.catalog["dim"])
        last = m.last_per_id(mutations)
        centroids = self.centroids()
        placed = ivf.assign(last.filter("kind = 'upsert'"), np.array(list(centroids.values())), np.array(list(centroids))).select("posting_id", "id", "values")
        # where the ids are now: only their rows go on
        old = self.members().join(last.select("id"), "id", "left_semi")
        moved = old.join(placed.select(F.col("posting_id").alias("to"), F.col("id").alias("i")), F.col("id") == F.col("i"), "left")
        markers = moved.filter("to is null or to != posting_id").select("posting_id", "id", F.lit(None).cast("array<double>").alias("values"), F.lit(True).alias("gone"))
        n = last.agg(F.count_if(F.col("kind") == "upsert").alias("upserts")).first()["upserts"]
        gone = last.filter("kind = 'delete'").join(old.select("id"), "id", "left_semi").count()
        part = self._write(placed.withColumn("gone", F.lit(False)).unionByName(markers))
        lists = self._write_lists(self._kept_up(placed, old))
        applied = self.catalog["applied"] | ({batch[0]: batch[1]} if batch is not None else {})
        self._commit([*self.catalog["members"], part], lists, applied=applied)
        if len(self.catalog["members"]) > self.max_parts:
            self.compact()
        return {"upserts": n, "deletes": gone}

    def _kept_up(self, added: DataFrame, removed: DataFrame) -> DataFrame:
        """Lists after rows came and went: running means, and bounds that are not under the true ones."""
        both = added.withColumn("sign", F.lit(1)).unionByName(removed.withColumn("sign", F.lit(-1)))
        flat = both.select("posting_id", "sign", F.posexplode("values").alias("pos", "x")).groupBy("posting_id", "pos").agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.col("x")).alias("x"))
        change = flat.groupBy("posting_id").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("sum"))
        total = F.col("size") + F.coalesce("n", F.lit(0))
        mean = F.when((total > 0) & F.col("sum").isNotNull(), F.zip_with("centroid", "sum", lambda c, s: (c * F.col("size") + s) / total)).otherwise(F.col("centroid"))
        lists = self.lists().join(change, "posting_id", "left").select("posting_id", mean.alias("centroid"), F.greatest(total, F.lit(0)).alias("size"), (F.col("max_radius") + F.sqrt(squared_l2("centroid", mean))).alias("max_radius"), "max_l2_norm")
        far = added.join(lists.select("posting_id", "centroid"), "posting_id").groupBy("posting_id").agg(F.max(F.sqrt(squared_l2("values", "centroid"))).alias("far"), F.max(F.sqrt(norm2("values"))).alias("norm"))
        return lists.join(far, "posting_id", "left").select("posting_id", "centroid", "size", F.greatest("max_radius", F.coalesce("far", F.lit(0.0))).alias("max_radius"), F.greatest("max_l2_norm", F.coalesce("norm", F.lit(0.0))).alias("max_l2_norm"))

    # ---- maintenance

    def compact(self) -> None:
        """All live members as one part, bounds exact."""
        self._replace(self.members(), self.centroids())

    def maintain(self) -> dict[str, int]:
        """Splits postings over split_limit, reassigns rows around each split one, merges those under merge_limit; one commit if anything changed.

        Only the members of the postings concerned are read and written again."""
        size = {int(r["posting_id"]): r["size"] for r in self.lists().select("posting_id", "size").toLocalIterator()}
        large = sorted(p for p, n in size.items() if n > self.split_limit and n >= 4)
        small = [p for p, n in size.items() if n < self.merge_limit]
        if not large and not (small and len(small) < len(size)):
            return {"split": 0, "merged": 0}
        centroids = self.centroids()
        ids, points = np.array(list(centroids), np.int64), np.array(list(centroids.values()))
        near = lambda c: ids[np.argsort(((points - c) ** 2).sum(axis=1), kind="stable")][: self.scope + 1].tolist()
        touched = sorted({*large, *small, *(int(p) for x in large for p in near(centroids[x]))})
        before, held = self.members(touched).cache(), None
        try:
            rows, last = before, max(centroids)
            if large:
                # read by each of the steps below; worked out once
                halves = held = m.split(before.filter(F.col("posting_id").isin(large)), self.split_limit).cache()
                # new numbers come after all postings, whichever were split
                first = max(large)
                rows = before.filter(~F.col("posting_id").isin(large)).unionByName(halves.withColumn("posting_id", F.col("posting_id") + F.lit(last - first)))
                origin = rows.filter(F.col("posting_id") > last).join(before.select("id", F.col("posting_id").alias("was")), "id").select("posting_id", "was").distinct()
                parts: dict[int, list[int]] = {}
                for r in origin.toLocalIterator():
                    parts.setdefault(int(r["was"]), []).append(int(r["posting_id"]))
                fresh = {int(r["posting_id"]): np.array(r["centroid"]) for r in ivf.means(rows.filter(F.col("posting_id") > last)).toLocalIterator()}
                old = {p: centroids.pop(p) for p in large}
                centroids |= fresh
                inside = lambda: {p: c for p, c in centroids.items() if p in set(touched) or p > last}
                rows = m.lire_reassign_all(rows, inside(), [(old[p], tuple(sorted(parts[p]))) for p in large], self.scope)
            merged = [p for p in small if p in centroids]
            if merged and len(merged) < len(centroids):
                rest = {p: c for p, c in centroids.items() if p not in set(merged)}
                leaving = rows.filter(F.col("posting_id").isin(merged))
                moved = ivf.assign(leaving, np.array(list(rest.values())), np.array(list(rest))).select("posting_id", "id", "values")
                rows, centroids = rows.filter(~F.col("posting_id").isin(merged)).unionByName(moved), rest
            else:
                merged = []
            after = rows.select("posting_id", "id", "values")
            came = after.join(before.select("posting_id", "id"), ["posting_id", "id"], "left_anti").withColumn("gone", F.lit(False))
            went = before.join(after.select("posting_id", "id"), ["posting_id", "id"], "left_anti").select("posting_id", "id", F.lit(None).cast("array<double>").alias("values"), F.lit(True).alias("gone"))
            part = self._write(came.unionByName(went))
        finally:
            before.unpersist()
            if held is not None:
                held.unpersist()
        members = [*self.catalog["members"], part]
        # centroids and bounds are exact again where members changed
        self.catalog = {**self.catalog, "members": members}
        all_members = self.members()
        exact = {int(r["posting_id"]): np.array(r["centroid"]) for r in ivf.means(all_members).toLocalIterator()}
        self._commit(members, self._write_lists(self._measured(all_members, {p: exact.get(p, c) for p, c in centroids.items()})))
        if len(members) > self.max_parts:
            self.compact()
        return {"split": len(large), "merged": len(merged)}

    # ---- search

    def search(self, queries: DataFrame, k: int, nprobe: int) -> DataFrame:
        """(qid, rank, id, distance) within the nprobe nearest lists of each query; a block of queries reads the lists it probes."""
        return ivf.search(self._probed, self.centroids(), queries, k, nprobe)

    def search_exact(self, queries: DataFrame, k: int) -> DataFrame:
        """The k nearest of all rows: lists whose bound is over a query's k-th distance are not scored for it."""
        centroids = self.centroids()
        return ivf.pruned_search(self._probed, centroids, self.lists().filter("size > 0"), queries, k, len(centroids))

    def _probed(self, postings: list[int]) -> DataFrame:
        """Members of the lists probed; beyond a few thousand lists all cells are read anyway."""
        return self.members(postings if len(postings) <= 5000 else None)

    def distances(self, point: list[float], ids: DataFrame) -> DataFrame:
        """(id, distance) of some ids to a point, null for ids that are not there."""
        own = self.members().join(ids.select("id").distinct(), "id", "left_semi")
        return ids.select("id").distinct().join(m.reach(own, point).select("id", "distance"), "id", "left")

    def health(self) -> DataFrame:
        """(postings, members, largest, parts) from the lists."""
        return self.lists().agg(F.count("*").alias("postings"), F.sum("size").alias("members"), F.max("size").alias("largest")).withColumn("parts", F.lit(len(self.catalog["members"])))

    def clean(self, keep: int = 1) -> list[str]:
        return self.catalogs.clean(keep)
