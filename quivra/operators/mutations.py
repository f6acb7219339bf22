"""Batched upserts and deletes with last-write-wins semantics, and maintenance of postings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quivra.functions.vector import distances, matrix, squared_l2
from quivra.operators.knn import DimensionError


def validate(mutations: DataFrame, dim: int) -> DataFrame:
    """Raises if any upsert has another dimension, even one that a later mutation replaces."""
    if not mutations.filter((F.col("kind") == "upsert") & (F.coalesce(F.size("values"), F.lit(-1)) != dim)).isEmpty():
        raise DimensionError(f"upserts must have {dim} components")
    return mutations


def last_per_id(mutations: DataFrame) -> DataFrame:
    """The mutation of the greatest pos of each id, of whichever kind; aggregated before the exchange."""
    others = [c for c in mutations.columns if c != "id"]
    best = mutations.groupBy("id").agg(F.max_by(F.struct(*others), "pos").alias("m"))
    return best.select("id", *[F.col(f"m.{c}").alias(c) for c in others])


def first_ids(rows: DataFrame) -> DataFrame:
    """(id, pos): each id where it first occurs."""
    return rows.groupBy("id").agg(F.min("pos").alias("pos"))


def merge(base: DataFrame, mutations: DataFrame) -> DataFrame:
    """Live rows (id, values) after the batch: base rows that it doesn't touch, and its upserts."""
    last = last_per_id(mutations)
    untouched = base.select("id", "values").join(last.select("id"), "id", "left_anti")
    return untouched.unionByName(last.filter("kind = 'upsert'").select("id", "values"))


def counts(base: DataFrame, mutations: DataFrame) -> DataFrame:
    """(upserts, deletes): distinct ids upserted, and deleted ids that existed."""
    last = last_per_id(mutations)
    known = last.filter("kind = 'delete'").join(base.select("id"), "id", "left_semi")
    return last.filter("kind = 'upsert'").agg(F.count("*").alias("upserts")).crossJoin(known.agg(F.count("*").alias("deletes")))


def routed(mutations: DataFrame, partitions: int, allow_partial: bool = True) -> DataFrame:
    """Adds partition = id mod partitions; a batch over several is rejected unless partial commits are allowed."""
    out = mutations.withColumn("partition", F.pmod("id", F.lit(partitions)))
    if not allow_partial and out.select("partition").distinct().limit(2).count() > 1:
        raise ValueError("a batch over several partitions needs allow_partial")
    return out


def farthest_pair(points: np.ndarray) -> tuple[int, int]:
    """The first pair with the greatest distance, row by row: memory for one row of distances."""
    best, pair = -1.0, (0, min(1, len(points) - 1))
    for i in range(len(points) - 1):
        d = distances(points[i + 1 :], points[i])
        j = int(d.argmax())
        if d[j] > best:
            best, pair = float(d[j]), (i, i + 1 + j)
    return pair


#: Up to so many rows of a posting the farthest pair is searched exactly, in time that grows with their square.
EXACT_PAIR = 1024


def far_pair(points: np.ndarray) -> tuple[int, int]:
    """Two rows far apart, to begin a split: the farthest pair of up to EXACT_PAIR rows, of more the row farthest from the mean and the one farthest from that."""
    if len(points) <= EXACT_PAIR:
        return farthest_pair(points)
    i = int(distances(points, points.mean(axis=0)).argmax())
    j = int(distances(points, points[i]).argmax())
    return (i, j) if i != j else (0, 1)


def balanced_halves(points: np.ndarray, ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 for the first ceil(n / 2) rows by d(a) - d(b), ties by id, and 1 for the rest."""
    side = np.ones(len(points), np.int64)
    side[np.lexsort((ids, distances(points, a) - distances(points, b)))[: (len(points) + 1) // 2]] = 0
    return side


def _splitter(limit: int, rounds: int):
    def one(points: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Leaf numbers: halves again and again until each has at most `limit` rows."""
        if len(points) <= limit or len(points) < 4:
            return np.zeros(len(points), np.int64)
        i, j = far_pair(points)
        a, b = points[i], points[j]
        for _ in range(max(rounds, 2)):
            side = balanced_halves(points, ids, a, b)
            a, b = points[side == 0].mean(axis=0), points[side == 1].mean(axis=0)
        left, right = (one(points[side == s], ids[side == s]) for s in (0, 1))
        out = np.zeros(len(points), np.int64)
        out[side == 0], out[side == 1] = left, right + left.max() + 1
        return out

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        points = np.array([np.asarray(v, float) for v in group["values"]])
        return group.assign(leaf=one(points, group["id"].to_numpy()))[["posting_id", "id", "values", "leaf"]]

    return run


def split(members: DataFrame, split_limit: int, rounds: int = 2) -> DataFrame:
    """Members with oversized postings split in balanced halves; new postings are numbered after the old ones.

    A posting over the limit is bounded by what one micro-batch adds to it, so it fits a task."""
    size = members.groupBy("posting_id").count()
    large = size.filter((F.col("count") > split_limit) & (F.col("count") >= 4)).select("posting_id")
    halves = members.join(large, "posting_id").groupBy("posting_id").applyInPandas(_splitter(split_limit, rounds), "posting_id long, id long, values array<double>, leaf long")
    last = members.agg(F.max("posting_id").alias("last"))
    fresh = halves.select("posting_id", "leaf").distinct().withColumn("new", F.row_number().over(Window.orderBy("posting_id", "leaf")))
    moved = halves.join(fresh, ["posting_id", "leaf"]).crossJoin(last).select((F.col("last") + F.col("new")).alias("posting_id"), "id", "values")
    return members.join(large, "posting_id", "left_anti").select("posting_id", "id", "values").unionByName(moved)


def lire_reassign(members: DataFrame, centroids: dict[int, np.ndarray], old: np.ndarray, parts: tuple[int, ...], scope: int) -> DataFrame:
    """Moves after a split of a posting with centroid `old` into `parts`: only rows that may now be nearer elsewhere.

    Members of the parts move if the old centroid was no farther than any part and a posting in scope is nearer; members
    of the other postings in scope move to the nearest part if a part is no farther than the old centroid and nearer than their own.
    Ties go to the part given first and to the lowest posting id. Rows outside parts and scope are not sent to Python."""
    return lire_reassign_all(members, centroids, [(old, parts)], scope)


def lire_reassign_all(members: DataFrame, centroids: dict[int, np.ndarray], splits: list[tuple[np.ndarray, tuple[int, ...]]], scope: int) -> DataFrame:
    """lire_reassign() for several splits, one after the other, in one pass over the rows."""
    ids = np.array(list(centroids), np.int64)
    points = np.array(list(centroids.values()))
    plans = []
    for old, parts in splits:
        around = [int(x) for x in ids[np.lexsort((ids, distances(points, old)))] if int(x) not in parts][:scope]
        plans.append((old, parts, np.array(sorted(around), np.int64)))
    to = lambda rows, chosen: np.array([distances(rows, centroids[int(p)]) for p in chosen]).reshape(len(chosen), len(rows))

    def moved(own: np.ndarray, rows: np.ndarray, old: np.ndarray, parts: tuple[int, ...], beside: np.ndarray) -> np.ndarray:
        target, mine = own.copy(), np.empty(len(own))
        for p in np.unique(own):
            at = own == p
            mine[at] = distances(rows[at], centroids[int(p)])
        was, split_, near = distances(rows, old), to(rows, parts), to(rows, beside)
        inside = np.isin(own, parts)
        if len(beside):
            leave = inside & (was <= split_.min(axis=0)) & (near.min(axis=0) < mine)
            target[leave] = beside[near.argmin(axis=0)[leave]]
        join = ~inside & (split_.min(axis=0) <= was) & (split_.min(axis=0) < mine)
        target[join] = np.array(parts, np.int64)[split_.argmin(axis=0)[join]]
        return target

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own, rows = batch.column(0).to_numpy().copy(), matrix(batch.column(2))
            for old, parts, beside in plans:
                at = np.flatnonzero(np.isin(own, [*parts, *beside]))
                if len(at):
                    own[at] = moved(own[at], rows[at], old, parts, beside)
            yield pa.RecordBatch.from_arrays([pa.array(own), batch.column(1), batch.column(2)], names=["posting_id", "id", "values"])

    rows = members.select("posting_id", "id", "values")
    reached = F.col("posting_id").isin(sorted({int(p) for _, parts, beside in plans for p in [*parts, *beside]}))
    return rows.filter(reached).mapInArrow(move, "posting_id long, id long, values array<double>").unionByName(rows.filter(~reached))


def merge_small(members: DataFrame, centroids: dict[int, np.ndarray], merge_limit: int) -> DataFrame:
    """Members of postings under the limit go to the nearest of the other postings; one posting is left alone."""
    from quivra.operators.ivf import assign

    size = members.groupBy("posting_id").count()
    small = {int(r["posting_id"]) for r in size.filter(F.col("count") < merge_limit).toLocalIterator()}
    rest = {p: c for p, c in centroids.items() if p not in small}
    if not small or not rest:
        return members.select("posting_id", "id", "values")
    moved = assign(members.filter(F.col("posting_id").isin(list(small))), np.array(list(rest.values())), np.array(list(rest)))
    return members.filter(~F.col("posting_id").isin(list(small))).select("posting_id", "id", "values").unionByName(moved.select("posting_id", "id", "values"))


def replay_members(events: DataFrame) -> DataFrame:
    """(posting_id, id) after events(seq, posting_id, id, tombstone): the last event of a pair decides."""
    last = events.groupBy("posting_id", "id").agg(F.max_by("tombstone", "seq").alias("gone"))
    return last.filter("not gone").select("posting_id", "id")


def reach(members: DataFrame, point: list[float]) -> DataFrame:
    """(posting_id, id, distance) to one point."""
    return members.select("posting_id", "id", squared_l2("values", F.array(*[F.lit(float(x)) for x in point])).alias("distance"))
