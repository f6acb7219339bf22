"""Scalar-quantised codes with bits given to dimensions by their variance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quivra.functions.vector import matrix, norm2, permute, summed
from quivra.operators.knn import NEIGHBOR, ranked

LEAST = 1e-9


@dataclass(frozen=True)
class Segment:
    start: int
    count: int
    bits: int


@dataclass(frozen=True)
class Plan:
    order: list[int]
    segments: list[Segment]

    def bits(self) -> list[int]:
        return [s.bits for s in self.segments for _ in range(s.count)]


def dimension_variances(base: DataFrame) -> DataFrame:
    """(pos, variance): sample variance of each dimension, at least 1e-9; 1 where there is but one row."""
    flat = base.select(F.posexplode("values").alias("pos", "x"))
    var = F.when(F.count("*") <= 1, F.lit(1.0)).otherwise(F.greatest(F.var_samp("x"), F.lit(LEAST)))
    return flat.groupBy("pos").agg(var.alias("variance"))


def uniform_segments(dim: int, total_bits: int, segments: int = 1, low: int = 1, high: int = 8) -> list[Segment]:
    """Equal segments (the last takes the rest) with the same whole number of bits."""
    bits, size = max(low, min(high, total_bits // dim)), max(1, dim // max(1, segments))
    starts = list(range(0, size * max(1, dim // size), size))
    return [Segment(s, (dim - s if s == starts[-1] else size), bits) for s in starts]


def joint_segments(variances: list[float], budget: int, low: int = 1, high: int = 8, shortest: int = 2, longest: int = 16) -> list[Segment]:
    """Lengths and bits of segments that minimise sum(variance / 4^bits) within a budget of bits: a dynamic program
    over (dimensions covered, bits spent). Without a solution: one segment of the bits the budget allows."""
    n, total = len(variances), np.concatenate(([0.0], np.cumsum(variances)))
    cost = np.full((n + 1, budget + 1), np.inf)
    back = np.full((n + 1, budget + 1, 2), -1, np.int64)
    cost[0, 0] = 0.0
    for end in range(1, n + 1):
        for length in range(shortest, min(longest, end) + 1):
            weight = total[end] - total[end - length]
            for bits in range(low, high + 1):
                spent = bits * length
                if spent > budget:
                    break
                offer = cost[end - length, : budget + 1 - spent] + weight / 4.0**bits
                better = offer < cost[end, spent:]
                cost[end, spent:][better] = offer[better]
                back[end, spent:][better] = (length, bits)
    if not np.isfinite(cost[n]).any():
        return [Segment(0, n, max(low, min(high, budget // n)))]
    out, end, spent = [], n, int(cost[n].argmin())
    while end:
        length, bits = (int(x) for x in back[end, spent])
        out.append(Segment(end - length, length, bits))
        end, spent = end - length, spent - length * bits
    return out[::-1]


def train(base: DataFrame, total_bits: int, joint: bool = True, sample: int = 10_000, segments: int = 4) -> Plan:
    """Dimensions by falling variance (stable), then segments; variances of the `sample` rows of the lowest ids."""
    rows = dimension_variances(base.orderBy("id").limit(sample)).orderBy("pos").toPandas()["variance"].to_numpy()
    if not joint:
        return Plan(list(range(len(rows))), uniform_segments(len(rows), total_bits, segments))
    order = np.argsort(-rows, kind="stable")
    return Plan(order.tolist(), joint_segments(rows[order].tolist(), total_bits))


CODES = "id long, codes array<int>, v_max double, norm_sq double"


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), pa.array(rows.ravel(), kind))


def encode(base: DataFrame, plan: Plan) -> DataFrame:
    """(id, codes, v_max, norm_sq): codes in the plan's order, a batch at a time. Vectors with nulls or NaN or of another dimension go through expressions."""
    base = base.select(F.col("id").cast("long").alias("id"), F.col("values").cast("array<double>").alias("values"))
    dim, steps = len(plan.order), 2.0 ** np.array(plan.bits())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1), dim)[:, plan.order]
                top = np.maximum(np.abs(x).max(axis=1), LEAST)
                code = np.maximum(0.0, np.minimum(steps - 1, np.floor((x + top[:, None]) / (2 * top[:, None] / steps))))
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(code.astype(np.int32), pa.int32()), pa.array(top), pa.array(np.add.accumulate(x * x, axis=1)[:, -1])], names=["id", "codes", "v_max", "norm_sq"])

    whole = F.coalesce((F.size("values") == dim) & ~F.exists("values", lambda x: x.isNull() | F.isnan(x)), F.lit(False))
    return base.filter(whole).mapInArrow(run, CODES).unionByName(_encoded(base.filter(~whole), plan))


def _encoded(base: DataFrame, plan: Plan) -> DataFrame:
    """encode() of any vectors, in expressions without Python; they are worked out anew for each component."""
    steps = F.array(*[F.lit(float(2**b)) for b in plan.bits()])
    out = base.select("id", permute(F.col("values").cast("array<double>"), plan.order).alias("r"))
    out = out.withColumn("v_max", F.greatest(F.array_max(F.transform("r", lambda x: F.abs(x))), F.lit(LEAST)))
    code = lambda x, s: F.greatest(F.lit(0.0), F.least(s - 1, F.floor((x + F.col("v_max")) / (2 * F.col("v_max") / s)).cast("double"))).cast("int")
    return out.withColumn("codes", F.zip_with("r", steps, code)).select("id", "codes", "v_max", norm2("r").alias("norm_sq"))


def decode(codes: DataFrame, plan: Plan) -> DataFrame:
    """Adds decoded, in the plan's order: the middle of each cell."""
    steps = F.array(*[F.lit(float(2**b)) for b in plan.bits()])
    return codes.withColumn("decoded", F.zip_with("codes", steps, lambda c, s: 2 * F.col("v_max") / s * (c + 0.5) - F.col("v_max")))


def refine(base: DataFrame, codes: DataFrame, plan: Plan, rounds: int = 2) -> DataFrame:
    """Moves single codes up or down where that raises the cosine with the original; all rows of a batch at once, without a shuffle but the join."""
    steps = 2.0 ** np.array(plan.bits())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, c, top = matrix(batch.column(4))[:, plan.order], matrix(batch.column(1)).copy(), batch.column(2).to_numpy()[:, None]
            width = 2 * top / steps
            y = width * (c + 0.5) - top
            xy, yy = np.einsum("ij,ij->i", x, y), np.einsum("ij,ij->i", y, y)
            for _ in range(rounds):
                for i in range(c.shape[1]):
                    for move in (-1, 1):
                        new = y[:, i] + move * width[:, i]
                        axy, ayy = xy + x[:, i] * (new - y[:, i]), yy + new * new - y[:, i] * y[:, i]
                        better = (c[:, i] + move >= 0) & (c[:, i] + move < steps[i]) & (ayy > 0)
                        better &= axy / np.sqrt(np.maximum(ayy, 1e-300)) > xy / np.sqrt(np.maximum(yy, 1e-300)) + 1e-12
                        xy, yy = np.where(better, axy, xy), np.where(better, ayy, yy)
                        y[:, i], c[:, i] = np.where(better, new, y[:, i]), c[:, i] + move * better
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(c.astype(np.int32), pa.int32()), batch.column(2), batch.column(3)], names=["id", "codes", "v_max", "norm_sq"])

    joined = codes.join(base.select("id", F.col("values").cast("array<double>").alias("values")), "id")
    return joined.select("id", "codes", "v_max", "norm_sq", "values").mapInArrow(run, CODES)


def _best(qids: np.ndarray, points: np.ndarray, steps: np.ndarray, k: int, at_once: int):
    """The k best rows of a task for each query, from codes; `at_once` queries at a time."""
    qq = np.add.accumulate(points * points, axis=1)[:, -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0), np.zeros(0, np.int64))] * len(qids)
        for batch in batches:
            all_ids, codes, tops, norms = batch.column(0).to_numpy(), matrix(batch.column(1), points.shape[1]), batch.column(2).to_numpy()[:, None], batch.column(3).to_numpy()
            decoded = 2 * tops / steps * (codes + 0.5) - tops
            for at in range(0, len(all_ids), 1024):
                ids, rows, norm = all_ids[at : at + 1024], decoded[at : at + 1024], norms[at : at + 1024]
                for low in range(0, len(qids), min(at_once, 64)):
                    p = points[low : low + min(at_once, 64)]
                    near = qq[low : low + len(p), None] + norm - 2 * summed(rows, p, lambda x, y: x * y)
                    for q, d in enumerate(near, low):
                        d, i = np.concatenate((best[q][0], d)), np.concatenate((best[q][1], ids))
                        if len(d) > k:
                            kept = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])  # with all ties at the end
                            d, i = d[kept], i[kept]
                        order = np.lexsort((i, d))[:k]
                        best[q] = d[order], i[order]
        for qid, (d, i) in zip(qids, best):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), qid)), pa.array(i), pa.array(d)], names=["qid", "id", "distance"])

    return run


def search(codes: DataFrame, plan: Plan, queries: DataFrame, k: int, max_queries: int = 1000) -> DataFrame:
    """(qid, rank, id, distance) by |q|^2 + |r|^2 - 2 <q, decoded r>.

    Queries go to the tasks that read the codes, `max_queries` at a time are scored there and the k best of a task are exchanged; the codes
    are worked out once for every 50 such blocks."""
    if k <= 0:
        return codes.sparkSession.createDataFrame([], "qid long, rank long, id long, distance double")
    told = queries.select(F.col("qid").cast("long").alias("qid"), F.col("values").cast("array<double>").alias("values")).toArrow().combine_chunks()
    qids, points = told["qid"].to_numpy(), matrix(told["values"], len(plan.order)).reshape(-1, len(plan.order))[:, plan.order]
    rows, steps, out = codes.select("id", "codes", "v_max", "norm_sq").filter("codes is not null"), 2.0 ** np.array(plan.bits()), None
    for at in range(0, max(len(qids), 1), 50 * max_queries):
        part = slice(at, at + 50 * max_queries)
        found = rows.mapInArrow(_best(qids[part], points[part], steps, k, max_queries), NEIGHBOR)
        out = found if out is None else out.unionByName(found)
    return ranked(out, k)


def quantization_mse(base: DataFrame, codes: DataFrame, plan: Plan) -> DataFrame:
    """(mse): mean over rows of the mean squared error of a dimension; rows without codes count with none."""
    decoded = decode(codes, plan).select("id", "decoded")
    rows = base.select("id", permute(F.col("values").cast("array<double>"), plan.order).alias("r")).join(decoded, "id", "left")
    error = F.aggregate(F.zip_with("r", "decoded", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) / F.size("r")
    return rows.agg((F.sum(F.coalesce(error, F.lit(0.0))) / F.count("*")).alias("mse"))
