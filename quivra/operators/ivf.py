"""Clustered inverted lists: k-means, assignment, posting statistics, bounds, probing and search.

Centroids are bounded by `MAX_POSTINGS` and live on the driver; rows never do. k-means starts from the k rows of the lowest ids,
breaks ties to the lowest centroid and leaves empty clusters where they are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quivra.functions.vector import distances, matrix, norm2, squared_l2
from quivra.operators.knn import ranked

MAX_POSTINGS = 200_000


def _nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    best, which = np.full(len(rows), np.inf), np.zeros(len(rows), np.int64)
    for c, point in enumerate(centroids):
        d = distances(rows, point)
        closer = d < best
        best[closer], which[closer] = d[closer], c
    return which, best


def _assigner(centroids: np.ndarray, ids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, d = _nearest(matrix(batch.column(1)), centroids) if batch.num_rows else (np.zeros(0, np.int64), np.zeros(0))
            yield pa.RecordBatch.from_arrays([pa.array(ids[which]), batch.column(0), batch.column(1), pa.array(d)], names=["posting_id", "id", "values", "distance"])

    return run


def plain(base: DataFrame) -> DataFrame:
    return base.select(F.col("id").cast("long").alias("id"), F.col("values").cast("array<double>").alias("values"))


def assign(base: DataFrame, centroids: np.ndarray, ids: np.ndarray | None = None) -> DataFrame:
    """(posting_id, id, values, distance): each row with its nearest centroid, the first of equal ones."""
    ids = np.arange(len(centroids)) if ids is None else np.asarray(ids, np.int64)
    return plain(base).mapInArrow(_assigner(np.asarray(centroids, float), ids), "posting_id long, id long, values array<double>, distance double")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, list] = {}
    for batch in batches:
        if batch.num_rows:
            cid, rows = batch.column(0).to_numpy(), matrix(batch.column(1))
            for c in np.unique(cid):
                part = rows[cid == c]
                have = total.setdefault(int(c), [0, np.zeros(rows.shape[1])])
                have[0] += len(part)
                have[1] += part.sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v[0] for v in total.values()], pa.int64()), pa.array([v[1].tolist() for v in total.values()], pa.list_(pa.float64()))], names=["posting_id", "n", "sums"])


def means(members: DataFrame) -> DataFrame:
    """(posting_id, n, centroid) of members(posting_id, values): sums in each task, then one row a task and posting is exchanged."""
    parts = members.select("posting_id", "values").mapInArrow(_sums, "posting_id long, n long, sums array<double>")
    flat = parts.select("posting_id", "n", F.posexplode("sums").alias("pos", "x")).groupBy("posting_id", "pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    whole = flat.groupBy("posting_id").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("c"))
    return whole.select("posting_id", "n", F.transform("c", lambda e: e["x"] / F.col("n")).alias("centroid"))


def kmeans_seeds(base: DataFrame, k: int) -> np.ndarray:
    """The vectors of the k lowest ids."""
    rows = plain(base).orderBy("id").limit(k).toPandas()["values"]
    return np.array([np.asarray(x, float) for x in rows]) if len(rows) else np.zeros((0, 0))


def kmeans(base: DataFrame, k: int, iterations: int) -> np.ndarray:
    """Lloyd's algorithm; fewer rows than k repeat the first seed."""
    if k > MAX_POSTINGS:
        raise ValueError("too many centroids")
    centroids = kmeans_seeds(base, k)
    if not len(centroids):
        return centroids
    if len(centroids) < k:
        centroids = np.concatenate((centroids, np.repeat(centroids[:1], k - len(centroids), axis=0)))
    for _ in range(max(iterations, 1)):
        for row in means(assign(base, centroids)).toLocalIterator():
            centroids[row["posting_id"]] = row["centroid"]
    return centroids


def build(base: DataFrame, postings: int, iterations: int, keep_empty: bool = False) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """(members, posting -> centroid): k-means, assignment, centroids recomputed; empty postings go unless kept."""
    first = kmeans(base, postings, iterations)
    members = assign(base, first).drop("distance")
    found = {int(r["posting_id"]): np.array(r["centroid"]) for r in means(members).toLocalIterator()}
    if keep_empty:
        found = {c: found.get(c, first[c]) for c in range(len(first))}
    return members, dict(sorted(found.items()))


def probes_append_only(nprobe: int, k: int, postings: int) -> int:
    return min(nprobe, postings)


def probes_resident(nprobe: int, k: int, postings: int) -> int:
    return min(max(nprobe, k) * 8, postings)


def probes_diskmeta(nprobe: int, k: int, postings: int, multiplier: int = 1, cap: int | None = None) -> int:
    n = min(max(nprobe, k), postings) * multiplier
    return min(n, postings, n if cap is None else cap)


def _prober(ids: np.ndarray, centroids: np.ndarray, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points = matrix(batch.column(1))
            chosen, dist = [], []
            for point in points:
                d = distances(centroids, point)
                order = np.lexsort((ids, d))[:n]
                chosen.append(ids[order])
                dist.append(d[order])
            repeat = np.repeat(np.arange(len(points)), [len(c) for c in chosen])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(repeat)), batch.column(1).take(pa.array(repeat)), pa.array(np.concatenate(chosen)), pa.array(np.concatenate(dist))], names=["qid", "point", "posting_id", "centroid_distance"])

    return run


def probe_list(queries: DataFrame, centroids: dict[int, np.ndarray], n: int) -> DataFrame:
    """(qid, point, posting_id, centroid_distance): the n nearest postings of each query, ties by posting id."""
    ids, points = np.array(list(centroids), np.int64), np.array(list(centroids.values()))
    asked = queries.select(F.col("qid").cast("long"), F.col("values").cast("array<double>"))
    return asked.mapInArrow(_prober(ids, points, n), "qid long, point array<double>, posting_id long, centroid_distance double")


def _scorer(probes: dict[int, np.ndarray], qids: np.ndarray, points: np.ndarray, k: int):
    """For rows (posting_id, id, values): the k best of this task for each query that probes the row's posting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            postings, ids, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2), points.shape[1])
            for p in np.unique(postings).tolist():
                if p not in probes:
                    continue
                at = np.flatnonzero(postings == p)
                part, own = rows[at], ids[at]
                for q in probes[p].tolist():
                    d, i = distances(part, points[q]), own
                    if q in best:
                        d, i = np.concatenate((best[q][0], d)), np.concatenate((best[q][1], i))
                    if len(d) > k:
                        near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])  # with all ties at the end
                        d, i = d[near], i[near]
                    keep = np.lexsort((i, d))[:k]
                    best[q] = d[keep], i[keep]
        for q, (d, i) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), qids[q])), pa.array(i), pa.array(d)], names=["qid", "id", "distance"])

    return run


def _score(members: DataFrame | Callable[[list[int]], DataFrame], probes: dict[int, np.ndarray], qids: np.ndarray, points: np.ndarray, k: int) -> DataFrame:
    """(qid, id, distance): the lists are read where they lie; only k rows a query and task are exchanged afterwards.

    members may be a function that reads the given postings, as a stored index has."""
    rows = (members(list(probes)) if callable(members) else members).select("posting_id", "id", "values")
    if len(probes) <= 1000:
        rows = rows.filter(F.col("posting_id").isin(list(probes)))  # reaches the scan of a stored index
    return rows.mapInArrow(_scorer(probes, qids, points, k), "qid long, id long, distance double")


def _bounds(points: np.ndarray, middle: np.ndarray, radius: float, norm: float) -> np.ndarray:
    """Squared distance to each point that no member of a posting can be under."""
    return np.maximum(np.maximum(np.sqrt(distances(points, middle)) - radius, 0.0), np.maximum(np.sqrt(np.einsum("ij,ij->i", points, points)) - norm, 0.0)) ** 2


def _bound_scorer(lists: dict[int, tuple[np.ndarray, float, float]], qids: np.ndarray, points: np.ndarray, limit: np.ndarray, done: np.ndarray, k: int):
    """As _scorer, for all postings whose bound is not over a query's limit, but those in done (a row a query).

    Which query meets which posting is worked out for the postings of a batch, so a task holds lists and queries but never all their pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, worst = {}, limit.copy()
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, rows = batch.column(1).to_numpy(), matrix(batch.column(2), points.shape[1])
            own, where = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            meets = np.array([_bounds(points, *lists[p]) * (1 - 1e-6) <= worst if p in lists else np.zeros(len(points), bool) for p in own.tolist()])
            for row, p in zip(meets, own):
                row &= (done != p).all(axis=1)
            for q in np.flatnonzero(meets.any(axis=0)).tolist():
                at = slice(None) if meets[:, q].all() else np.flatnonzero(meets[where, q])
                d, i = distances(rows[at], points[q]), ids[at]
                near = np.flatnonzero(d <= worst[q])
                d, i = d[near], i[near]
                if q in best:
                    d, i = np.concatenate((best[q][0], d)), np.concatenate((best[q][1], i))
                if len(d) > k:
                    near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])  # with all ties at the end
                    d, i = d[near], i[near]
                keep = np.lexsort((i, d))[:k]
                best[q] = d[keep], i[keep]
                if len(keep) == k:
                    worst[q] = min(worst[q], d[keep[-1]])
        if best:
            n = [len(d) for d, _ in best.values()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids[list(best)], n)), pa.array(np.concatenate([i for _, i in best.values()])), pa.array(np.concatenate([d for d, _ in best.values()]))], names=["qid", "id", "distance"])

    return run


def _blocks(queries: DataFrame, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(qids, points) of at most `block` queries at a time."""
    asked, low = queries.select(F.col("qid").cast("long"), F.col("values").cast("array<double>")), None
    while True:
        part = (asked if low is None else asked.filter(F.col("qid") > low)).orderBy("qid").limit(block).toPandas()
        if len(part):
            yield part["qid"].to_numpy(), np.array([np.asarray(x, float) for x in part["values"]])
            low = int(part["qid"].max())
        if len(part) < block:
            return


def _nearest_lists(centroids: dict[int, np.ndarray], points: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(posting ids, squared distances) of the n nearest postings of each point, ties by id."""
    ids, middle, out = np.array(list(centroids), np.int64), np.array(list(centroids.values())), []
    for point in points:
        d = distances(middle, point)
        order = np.lexsort((ids, d))[:n]
        out.append((ids[order], d[order]))
    return out


def _by_posting(chosen: list[np.ndarray]) -> dict[int, np.ndarray]:
    pairs = [(int(p), q) for q, ps in enumerate(chosen) for p in ps]
    out: dict[int, list[int]] = {}
    for p, q in pairs:
        out.setdefault(p, []).append(q)
    return {p: np.array(q) for p, q in out.items()}


def _union(parts: list[DataFrame], spark: SparkSession, k: int) -> DataFrame:
    out = None
    for part in parts:
        out = part if out is None else out.union(part)
    return ranked(out if out is not None else spark.createDataFrame([], "qid long, id long, distance double"), k)


def search(members: DataFrame, centroids: dict[int, np.ndarray], queries: DataFrame, k: int, n: int, block: int = 4096) -> DataFrame:
    """(qid, rank, id, distance): exact distances within the n nearest postings of each query."""
    found = []
    for qids, points in _blocks(queries, block):
        chosen = [ids for ids, _ in _nearest_lists(centroids, points, n)]
        found.append(_score(members, _by_posting(chosen), qids, points, k))
    return _union(found, queries.sparkSession, k)


def posting_stats(members: DataFrame, centroids: dict[int, np.ndarray]) -> DataFrame:
    """(posting_id, size, max_radius, max_l2_norm) of each posting."""
    spark = members.sparkSession
    table = spark.createDataFrame([(c, [float(x) for x in v]) for c, v in centroids.items()], "posting_id long, centroid array<double>")
    joined = members.join(table, "posting_id")
    return joined.groupBy("posting_id").agg(F.count("*").alias("size"), F.max(F.sqrt(squared_l2("values", "centroid"))).alias("max_radius"), F.max(F.sqrt(norm2("values"))).alias("max_l2_norm"))


def lower_bound(point_distance: Column, point_norm: Column) -> Column:
    """Squared distance that no member of a posting can be under, by its radius and by its largest norm."""
    by_radius = F.greatest(F.sqrt(point_distance) - F.col("max_radius"), F.lit(0.0))
    by_norm = F.greatest(point_norm - F.col("max_l2_norm"), F.lit(0.0))
    return F.greatest(by_radius * by_radius, by_norm * by_norm)


def bounded_probes(queries: DataFrame, centroids: dict[int, np.ndarray], stats: DataFrame, n: int) -> DataFrame:
    """The probe list with lower_bound, in the order (lower bound, centroid distance, posting id)."""
    probed = probe_list(queries, centroids, n).join(stats, "posting_id")
    probed = probed.withColumn("lower_bound", lower_bound(F.col("centroid_distance"), F.sqrt(norm2("point"))))
    order = Window.partitionBy("qid").orderBy("lower_bound", "centroid_distance", "posting_id")
    return probed.withColumn("probe", F.row_number().over(order).cast("long"))


def pruned_search(members: DataFrame, centroids: dict[int, np.ndarray], stats: DataFrame, queries: DataFrame, k: int, n: int, first: int = 2, block: int = 4096) -> DataFrame:
    """The same result as search() over n postings in two phases.

    The `first` postings in the order of their bounds give each query a k-th distance (k rows a query come to the driver, at most
    `block` queries at a time); of the others only those whose bound is under it are read."""
    spark = queries.sparkSession
    if k <= 0:
        return _union([], spark, k)
    bound_of = {int(r["posting_id"]): (r["max_radius"], r["max_l2_norm"]) for r in stats.toLocalIterator()}
    ids, middle = np.array(list(centroids), np.int64), np.array(list(centroids.values()))
    radius, norm = np.array([bound_of.get(int(p), (np.inf, np.inf)) for p in ids]).reshape(-1, 2).T
    parts = []
    for qids, points in _blocks(queries, block):
        plans = []  # of all postings a query only the first; of fewer all, as only they may be searched
        for point in points:
            d = distances(middle, point)
            chosen = slice(None) if n >= len(ids) else np.lexsort((ids, d))[:n]
            low = np.maximum(np.maximum(np.sqrt(d[chosen]) - radius[chosen], 0.0), np.maximum(np.sqrt(point @ point) - norm[chosen], 0.0)) ** 2
            order = np.lexsort((ids[chosen], d[chosen], low))[: first if n >= len(ids) else None]
            plans.append((ids[chosen][order], low[order]))
        near = ranked(_score(members, _by_posting([x[:first] for x, _ in plans]), qids, points, k), k).toPandas()
        seen = near.groupby("qid")["distance"].agg(["size", "max"]) if len(near) else None
        full = {} if seen is None else seen[seen["size"] >= k]["max"].to_dict()
        limit = np.array([full.get(q, np.inf) for q in qids.tolist()])
        parts.append(spark.createDataFrame(near[["qid", "id", "distance"]], "qid long, id long, distance double"))
        if n >= len(ids):
            lists = {int(p): (c, float(r), float(m)) for p, c, r, m in zip(ids, middle, radius, norm)}
            rows = (members(list(lists)) if callable(members) else members).select("posting_id", "id", "values")
            parts.append(rows.mapInArrow(_bound_scorer(lists, qids, points, limit, np.array([x for x, _ in plans]), k), "qid long, id long, distance double"))
        else:
            more = [x[first:][low[first:] * (1 - 1e-6) <= most] for (x, low), most in zip(plans, limit)]
            parts.append(_score(members, _by_posting(more), qids, points, k))
    return _union(parts, spark, k)


def coarse_layer(centroids: dict[int, np.ndarray], iterations: int = 2) -> tuple[np.ndarray, dict[int, int]]:
    """k-means over centroids with the whole root of their number: (coarse centroids, posting -> coarse cell)."""
    points = np.array(list(centroids.values()))
    k = max(1, int(np.sqrt(len(points))))
    cells = points[:k].copy()
    for _ in range(max(iterations, 1)):
        which, _ = _nearest(points, cells)
        for c in range(k):
            if (which == c).any():
                cells[c] = points[which == c].mean(axis=0)
    which, _ = _nearest(points, cells)
    return cells, dict(zip(centroids, which.tolist()))


def coarse_candidates(point: np.ndarray, cells: np.ndarray, cell_of: dict[int, int], n_cells: int, initial_postings: int) -> list[int]:
    """Postings of the nearest coarse cells; all of them while there are few or where the cells are empty."""
    if len(cell_of) <= initial_postings or not len(cells):
        return list(cell_of)
    near = set(np.lexsort((np.arange(len(cells)), distances(cells, point)))[:n_cells].tolist())
    return [p for p, c in cell_of.items() if c in near] or list(cell_of)
