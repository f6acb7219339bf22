"""Best-fit packing by a configuration linear program over the length histogram.

Documents become pieces of at most `capacity` ids (longer documents are cut, the first piece takes the
remainder). The histogram of piece lengths has at most `capacity` entries whatever the input, so the
program is solved on the driver: multiplicative weights price each length by how far it is behind, a knapsack
dynamic program prices the best configuration, several configurations are advanced by a bounded
step, and the fractional counts are rounded down. What rounding leaves is solved again and at last put by
best fit. Pieces then take places by their rank among the pieces of their length: ranks are counted within
(length, salt), salts by the histogram, so a length with a third of all pieces is no single task.

Nulls: a null text is empty (one id, the end id), a null doc_id is kept. Repeated rows are packed one by one.
An empty table gives no rows."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quivra.llm.common import id_and_text, written
from quivra.llm.encoding import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(tokenizer: str, end_id: int, capacity: int, max_chunks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer, max_chunks), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = enc.encode(text.as_py()) + end
                total, at, piece = len(raw) // 4, 0, 0
                while at < total:
                    size = (total - at) % capacity or capacity if piece == 0 else capacity
                    rows.append((key, piece, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)])))
                    at, piece = at + size, piece + 1
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(df: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", max_chunks: int = 1_500_000) -> DataFrame:
    return id_and_text(df, id_col, text_col).mapInArrow(_cut(tokenizer, end_id, capacity, max_chunks), PIECES)


def _knapsack(lengths: np.ndarray, value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c] of filling at most c, and the index of a last item (-1: none)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := fits[c]:
            gain = best[c - lengths[:n]] + value[:n]
            k = int(gain.argmax())
            if gain[k] > best[c]:
                best[c], last[c] = gain[k], k
    return best, last


def _filled(lengths: np.ndarray, last: np.ndarray, room: int) -> list[int]:
    out = []
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            out.append(int(last[room]))
            room -= int(lengths[last[room]])
    return out


def fractional(count: np.ndarray, capacity: int, rounds: int = 600, step: float = 1.0, eta: float = 1.0, columns: int = 32) -> dict[tuple[int, ...], float]:
    """Multiplicative weights: configurations and how often each is used, covering no length more than its count.

    A length weighs exp(-eta * its covered share). Only one piece over half the capacity and two over a third
    go in a sequence, so these lengths lead: each configuration has a leading length and the best filling at
    these prices, and advances until a length in it has moved by `step` of its count."""
    lengths = np.flatnonzero(count[: capacity + 1]).astype(np.int64)
    need = count[lengths].astype(float)
    lead = np.where(2 * lengths > capacity, 2.0, np.where(3 * lengths > capacity, 1.0, 0.0))
    done, used = np.zeros(len(lengths)), {}
    for _ in range(rounds):
        open_ = done < need - 1e-9
        if not open_.any():
            break
        share = done / need
        value = np.where(open_, lengths * (1 + 0.02 * np.exp(-eta * share)), 0.0)
        live = np.flatnonzero(open_)
        _, last = _knapsack(lengths[live], value[live], capacity)
        for first in live[np.lexsort((-lengths[live], np.round(share[live] - lead[live], 3)))][:columns]:
            items = Counter([int(first), *(int(live[k]) for k in _filled(lengths[live], last, capacity - int(lengths[first])))])
            size = min(min(need[k] - done[k], max(step * need[k], 1.0)) / a for k, a in items.items())
            if size <= 1e-9:
                continue
            for k, a in items.items():
                done[k] += a * size
            config = tuple(sorted((int(lengths[k]) for k in items.elements()), reverse=True))
            used[config] = used.get(config, 0.0) + size
    return used


def bound(count: np.ndarray, capacity: int, rounds: int = 30, eta: float = 0.05) -> float:
    """A lower bound for the sequences of any packing, from the dual program: with prices y of lengths, of which no configuration is worth
    more than 1, sum(count * y) sequences are needed at least. Prices start as the lengths; those of lengths that the best
    configuration has are lowered by a factor, the others' raised, and the best bound counts."""
    lengths = np.flatnonzero(count[: capacity + 1]).astype(np.int64)
    if not len(lengths):
        return 0.0
    price, found = lengths.astype(float), 0.0
    for start in (lengths.astype(float), np.where(2 * lengths > capacity, 1.0, np.where(2 * lengths == capacity, 0.5, 1e-9))):
        price = start
        for _ in range(rounds):
            worth, last = _knapsack(lengths, price, capacity)
            found = max(found, float((count[lengths] * price).sum() / worth[capacity]))
            used = np.bincount(_filled(lengths, last, capacity), minlength=len(lengths))
            price = price * np.exp(eta * (count[lengths] / count[lengths].sum() - used / max(1, used.sum())))
    return found


def best_fit(count: Counter, capacity: int) -> Counter:
    """Best fit, longest first, for what rounding leaves (bounded by configurations, not by documents)."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    for length in sorted(count, reverse=True):
        for _ in range(count[length]):
            room = next((r for r in range(length, capacity + 1) if by_room.get(r)), None)
            k = by_room[room].pop() if room is not None else len(bins)
            if room is None:
                bins.append([])
            bins[k].append(length)
            by_room.setdefault((capacity if room is None else room) - length, []).append(k)
    return Counter(tuple(x) for x in bins)


def _rounded(count: np.ndarray, capacity: int, phases: int, **settings) -> Counter:
    rest, out = count.astype(np.int64).copy(), Counter()
    for _ in range(phases):
        if rest.sum() < 1000:
            break
        for config, times in sorted(fractional(rest, capacity, **settings).items()):
            whole = min([int(times + 1e-6), *(int(rest[k]) // a for k, a in Counter(config).items())])
            if whole > 0:
                out[config] += whole
                for k in config:
                    rest[k] -= whole
    return out + best_fit(Counter({int(k): int(rest[k]) for k in np.flatnonzero(rest)}), capacity)


def configurations(count: np.ndarray, capacity: int = 1024, phases: int = 4, settings: tuple[dict, ...] = ({"eta": 1.0}, {"eta": 4.0}, {"eta": 1.0, "columns": 8})) -> Counter:
    """How many sequences of each configuration; every piece of the histogram is placed exactly once.

    The program is solved with each of `settings` and the fewest sequences are taken."""
    rest = count.astype(np.int64).copy()
    full = Counter({(capacity,): int(rest[capacity])} if rest[capacity] else {})
    rest[capacity] = 0
    if not rest.any():
        return full
    return full + min((_rounded(rest, capacity, phases, **x) for x in settings), key=lambda s: sum(s.values()))


def places(solution: Counter, capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length, runs of ranks: (first rank, first sequence, offset)."""
    rank, runs, sequence = Counter(), {}, 0
    for config, times in sorted(solution.items(), reverse=True):
        offset = 0
        for length in config:
            runs.setdefault(length, []).append((rank[length], sequence, offset))
            rank[length] += times
            offset += length
        sequence += times
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in runs.items()}


def _placed(base: dict, runs: dict):
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, salt, rn = (batch.column(k).to_numpy() for k in (3, 5, 6))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                rank = base[int(k)][salt[at]] + rn[at] - 1
                first, seq, off = runs[int(k)]
                which = np.searchsorted(first, rank, side="right") - 1
                sequence[at], offset[at] = seq[which] + rank - first[which], off[which]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(sequence), pa.array(offset)], names=names)

    return run


def pack(df: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", rows_a_salt: int = 500_000, max_salts: int = 256, max_chunks: int = 1_500_000) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = df.sparkSession
    cut = written(pieces(df, tokenizer, end_id, capacity, id_col, text_col, max_chunks), "pieces")
    total = cut.count()
    salts = int(min(max_salts, max(16, total // rows_a_salt + 1)))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    # at most capacity * max_salts rows, whatever the input
    seen = salted.groupBy("length", "salt").count().collect()
    per = {}
    for row in seen:
        per.setdefault(int(row["length"]), np.zeros(salts, np.int64))[row["salt"]] = row["count"]
    count = np.zeros(capacity + 1, np.int64)
    for k, v in per.items():
        count[k] = v.sum()
    base = {k: np.cumsum(v) - v for k, v in per.items()}
    runs = places(configurations(count, capacity), capacity)
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("rn", F.row_number().over(order).cast("long"))
    return ranked.mapInArrow(_placed(base, runs), PIECES + ", sequence_id long, offset long")
