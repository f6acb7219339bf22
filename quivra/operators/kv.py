"""A versioned key/value layer: an operation log of rows (user_key, seqno, kind, value) and what is visible at a sequence number.

kind is 'put', 'del' or 'rdel'; a range delete has its first key in user_key and its exclusive end in value. The newest entry
of a key at or before the snapshot is visible, unless a range delete at or before the snapshot covers the key with a
sequence number that is not smaller."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Range deletes up to this many rows are broadcast; more of them meet keys by sorted boundaries.
BROADCAST_RANGES = 10_000
_NAME = re.compile(r"[A-Za-z0-9_.-]+")


def check_ops(ops: DataFrame) -> DataFrame:
    """Raises on an empty range: it hides nothing and would only hide versions of its first key by accident."""
    if not ops.filter((F.col("kind") == "rdel") & (F.col("user_key") >= F.col("value"))).isEmpty():
        raise ValueError("a range delete needs start < end")
    return ops


def batch(ops: DataFrame, base: int, position: str = "pos") -> DataFrame:
    """Sequence numbers base + 1, base + 2, ... in order of position: one batch, so one order."""
    return check_ops(ops.withColumn("seqno", (F.row_number().over(Window.orderBy(position)) + base).cast("long")))


def parse_op(text: str) -> tuple[str, str, str | None]:
    """put:key:value, del:key or rdel:start:end; a value may have colons."""
    kind, _, rest = text.partition(":")
    if kind == "put" and ":" in rest and rest.partition(":")[0]:
        key, _, value = rest.partition(":")
        return "put", key, value
    if kind == "del" and rest and ":" not in rest:
        return "del", rest, None
    if kind == "rdel":
        start, _, end = rest.partition(":")
        if start and end and start < end:
            return "rdel", start, end
    raise ValueError(f"bad operation: {text}")


def _hide(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """points without those that a range covers with seqno >= theirs."""
    r = ranges.select(F.col("user_key").alias("__start"), F.col("value").alias("__end"), F.col("seqno").alias("__t"))
    few = r.limit(BROADCAST_RANGES + 1).count() <= BROADCAST_RANGES
    if few:
        covered = (points["user_key"] >= F.col("__start")) & (points["user_key"] < F.col("__end")) & (F.col("__t") >= points["seqno"])
        return points.join(F.broadcast(r), covered, "left_anti")
    return _sweep(points, r)


def _dealt(bounds: list[bytes]):
    """Rows (start, end, t) by intervals between bounds: as (b, start, end, t) the ends of a range that lie within an interval, as (-node, t)
    the intervals that it covers whole, as nodes of a binary tree over all intervals: a range has few of either, however wide."""
    leaves = 1 << len(bounds).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for start, end, t in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = bisect_right(bounds, start), bisect_right(bounds, end)
                out.append((a, start, end, t))
                if a < b:
                    out.append((b, start, end, t))
                low, high = a + 1 + leaves, b + leaves
                while low < high:
                    if low & 1:
                        out.append((-low, b"", b"", t))
                        low += 1
                    if high & 1:
                        high -= 1
                        out.append((-high, b"", b"", t))
                    low, high = low >> 1, high >> 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 4, (pa.int64(), pa.binary(), pa.binary(), pa.int64()))], names=["b", "start", "end", "t"])

    return run


def _placed(bounds: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bisect_right(bounds, k) for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), batch.column(0)], names=["b", "start"])

    return run


def _covering(over: dict[int, int], leaves: int):
    """Of an interval's keys (end is null) and ranges, in one pass by key: the greatest t of the ranges over each key."""

    def run(group: pa.Table) -> pa.Table:
        b, wide = group["b"][0].as_py(), None
        node = b + leaves
        while node:
            wide = max((t for t in (wide, over.get(node)) if t is not None), default=None)
            node >>= 1
        rows = sorted(zip(group["start"].to_pylist(), (x is None for x in group["end"].to_pylist()), group["end"].to_pylist(), group["t"].to_pylist()), key=lambda r: r[:2])
        keys, found, open_ = [], [], []
        for start, is_key, end, t in rows:
            if not is_key:
                heappush(open_, (-t, end))
                continue
            while open_ and open_[0][1] <= start:
                heappop(open_)
            best = -open_[0][0] if open_ else None
            if best is None or (wide is not None and wide > best):
                best = wide
            if best is not None:
                keys.append(start)
                found.append(best)
        return pa.table({"__key": pa.array(keys, pa.binary()), "__over": pa.array(found, pa.int64())})

    return run


def _sweep(points: DataFrame, r: DataFrame, per_bucket: int = 2000, buckets: int = 4096) -> DataFrame:
    """Many ranges: keys and ranges fall into intervals between a bounded sample of range starts, about one for `per_bucket` ranges, and each interval
    is swept once by key. A range goes to the intervals of its ends; those it covers whole know but the greatest number over them."""
    kind = points.schema["user_key"].dataType
    ranges = r.dropna().filter("__start < __end").groupBy(F.col("__start").cast("binary").alias("start"), F.col("__end").cast("binary").alias("end")).agg(F.max("__t").cast("long").alias("t"))
    n = min(buckets, ranges.count() // per_bucket + 1)
    bounds = sorted({bytes(x[0]) for x in ranges.select("start").distinct().orderBy(F.xxhash64("start")).limit(n - 1).collect()})
    leaves = 1 << len(bounds).bit_length()
    dealt = ranges.mapInArrow(_dealt(bounds), "b long, start binary, end binary, t long")
    over = {-x["b"]: x["t"] for x in dealt.filter("b < 0").groupBy("b").agg(F.max("t").alias("t")).collect()}  # at most two an interval
    keys = points.select(F.col("user_key").cast("binary").alias("start")).dropna().distinct().mapInArrow(_placed(bounds), "b long, start binary")
    both = dealt.filter("b >= 0").unionByName(keys.select("b", "start", F.lit(None).cast("binary").alias("end"), F.lit(None).cast("long").alias("t")))
    covered = both.groupBy("b").applyInArrow(_covering(over, leaves), "__key binary, __over long").select(F.col("__key").cast(kind).alias("__key"), "__over")
    return points.join(covered, (points["user_key"] == covered["__key"]) & (covered["__over"] >= points["seqno"]), "left_anti")


def visible(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """(user_key, seqno, value) as of a sequence number; the filter on seqno reaches the scan."""
    seen = log if snapshot is None else log.filter(F.col("seqno") <= snapshot)
    newest = seen.filter(F.col("kind") != "rdel").groupBy("user_key").agg(F.max_by(F.struct("kind", "value", "seqno"), "seqno").alias("v"))
    points = newest.select("user_key", F.col("v.seqno").alias("seqno"), F.col("v.kind").alias("kind"), F.col("v.value").alias("value"))
    return _hide(points, seen.filter(F.col("kind") == "rdel")).filter("kind = 'put'").select("user_key", "seqno", "value")


def in_range(rows: DataFrame, start=None, end=None, start_included: bool = True, end_included: bool = False) -> DataFrame:
    if start is not None:
        rows = rows.filter(F.col("user_key") >= start if start_included else F.col("user_key") > start)
    if end is not None:
        rows = rows.filter(F.col("user_key") <= end if end_included else F.col("user_key") < end)
    return rows


def scan(log: DataFrame, snapshot: int | None = None, start=None, end=None, **included) -> DataFrame:
    """Visible rows of a key range. Points are limited before they are aggregated; range deletes from outside still count."""
    points = in_range(log.filter(F.col("kind") != "rdel"), start, end, **included)
    return visible(points.unionByName(log.filter(F.col("kind") == "rdel")), snapshot)


def get(log: DataFrame, key, snapshot: int | None = None) -> DataFrame:
    return scan(log, snapshot, key, key, end_included=True)


def multi_get(log: DataFrame, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
    """(pos, user_key, value) of keys(pos, user_key), null where nothing is visible; one snapshot for all."""
    wanted = keys.select("user_key").distinct()
    points = log.filter(F.col("kind") != "rdel").join(wanted, "user_key", "left_semi")
    found = visible(points.unionByName(log.filter(F.col("kind") == "rdel").select(*points.columns)), snapshot)
    return keys.join(found.select("user_key", "value"), "user_key", "left").select("pos", "user_key", "value")


def prefix_end(prefix: bytes) -> bytes:
    """The least byte string above all with this prefix."""
    cut = prefix.rstrip(b"\xff")
    if not cut:
        raise ValueError("no key is above this prefix")
    return cut[:-1] + bytes([cut[-1] + 1])


def compact(log: DataFrame, floor: int, covers_all: bool = True) -> DataFrame:
    """The rows to keep: all of seqno >= floor, and the newest entry of a key under it.

    If the inputs cover every file that overlaps them, deletes under the floor go, and range deletes under it go with the points
    they hide; what is visible at any seqno >= floor - 1 stays the same."""
    points, ranges = log.filter(F.col("kind") != "rdel"), log.filter(F.col("kind") == "rdel")
    old = points.filter(F.col("seqno") < floor)
    newest = old.withColumn("n", F.row_number().over(Window.partitionBy("user_key").orderBy(F.desc("seqno")))).filter("n = 1").drop("n")
    if covers_all:
        newest = _hide(newest, ranges.filter(F.col("seqno") < floor)).filter("kind != 'del'")
        ranges = ranges.filter(F.col("seqno") >= floor)
    columns = log.columns
    return points.filter(F.col("seqno") >= floor).unionByName(newest.select(*columns)).unionByName(ranges)


def retention_floor(latest: int, snapshots: list[int], branch_heads: list[int]) -> int:
    """The smallest sequence number that must stay readable: pinned snapshots (or the latest), and branch heads."""
    return min([min(snapshots) if snapshots else latest, *branch_heads])


class Branches:
    """Named sequence numbers on one shared timeline: a branch sees all that is at or before its head."""

    def __init__(self, head: int = 0, heads: dict[str, int] | None = None, current: str = "main"):
        self.heads = {"main": head, **(heads or {})}
        self.current = current

    def create(self, name: str, at: int | None = None) -> None:
        if not _NAME.fullmatch(name) or name in self.heads:
            raise ValueError(f"bad or used branch name: {name}")
        at = self.heads[self.current] if at is None else at
        if at > max(self.heads.values()):
            raise ValueError("a branch can't begin in the future")
        self.heads[name] = at

    def checkout(self, name: str) -> None:
        if name not in self.heads:
            raise KeyError(name)
        self.current = name

    def drop(self, name: str) -> None:
        if name == "main" or name not in self.heads:
            raise ValueError(f"can't drop {name}")
        del self.heads[name]
        if self.current == name:
            self.current = "main"

    def advance(self, seqno: int) -> None:
        """A write takes the next global sequence number and moves the current branch there."""
        self.heads[self.current] = seqno


def archive(log: DataFrame, head: int) -> DataFrame:
    """The visible rows at a branch's head, all with the head's sequence number."""
    return visible(log, head).select("user_key", F.lit(head).cast("long").alias("seqno"), F.lit("put").alias("kind"), "value")


def ingest(log: DataFrame, table: DataFrame) -> DataFrame:
    """The log with the rows of another table under their own sequence numbers; an empty table is rejected."""
    if table.isEmpty():
        raise ValueError("an empty table can't be ingested")
    return log.unionByName(check_ops(table).select(*log.columns))


def files(log: DataFrame, per_file: int = 500, level0: int = 4) -> DataFrame:
    """(file_id, level, smallest, largest, max_seqno, entries, size_bytes): runs of the log; the newest `level0` are level 0."""
    size = F.length("user_key") + F.coalesce(F.length("value"), F.lit(0)) + 9
    runs = log.groupBy(F.floor(F.col("seqno") / per_file).alias("file_id")).agg(F.min("user_key").alias("smallest"), F.max("user_key").alias("largest"), F.max("seqno").alias("max_seqno"), F.count("*").alias("entries"), F.sum(size).cast("long").alias("size_bytes"))
    newest = runs.select(F.max("file_id").alias("newest"))
    return runs.crossJoin(newest).withColumn("level", F.when(F.col("file_id") > F.col("newest") - level0, 0).otherwise(1)).drop("newest")


def _disjoint(starts: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> tuple[int, int]:
    """How many pairs of closed intervals don't meet, and the sum over them of the smaller size, in n log(n)^2 steps and the memory of some columns.

    By position, an interval's end adds its size and an interval's start asks for all ends before it. Bit by bit of the rank
    by size, what asks meets what was added with the first different bit under its own: those are the smaller ones."""
    n = len(sizes)
    rank = np.empty(n, np.int64)
    rank[np.argsort(sizes, kind="stable")] = np.arange(n)
    order = np.lexsort((np.repeat([0, 1], n), np.concatenate((starts, ends))))  # a start before an end at the same key: they meet
    adds, rank, size = order >= n, rank[order % n], sizes[order % n].astype(np.int64)
    before = np.cumsum(adds)
    pairs = int(before[~adds].sum())
    # every pair at first by the size of what asks, then corrected where what was added is smaller
    total = int((before * size)[~adds].sum())
    for bit in range(max(n - 1, 1).bit_length() - 1, -1, -1):
        group, low = rank >> (bit + 1), (rank >> bit & 1) == 0
        by = np.argsort(group, kind="stable")
        smaller, group, asks = (adds & low)[by], group[by], (~adds & ~low)[by]
        count, bytes_ = np.cumsum(smaller), np.cumsum(np.where(smaller, size[by], 0))
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        of = np.repeat(first, np.diff(np.r_[first, len(group)]))
        count, bytes_ = count - np.where(of > 0, count[of - 1], 0), bytes_ - np.where(of > 0, bytes_[of - 1], 0)
        total += int((bytes_ - count * size[by])[asks].sum())
    return pairs, total


def _overlap(group: pa.Table) -> pa.Table:
    n = group.num_rows
    keys = pa.chunked_array([*group["smallest"].chunks, *group["largest"].chunks]).combine_chunks().dictionary_encode()
    place = np.empty(len(keys.dictionary), np.int64)
    place[pc.sort_indices(keys.dictionary).to_numpy()] = np.arange(len(place))
    at, sizes = place[keys.indices.to_numpy(zero_copy_only=False)], group["size_bytes"].to_numpy()
    pairs, apart = _disjoint(at[:n], at[n:], sizes)
    if n * (n - 1) // 2 == pairs:
        return pa.table({"level": pa.array([], pa.int64()), "overlap_bytes": pa.array([], pa.int64())})
    whole = int((np.sort(sizes) * np.arange(n - 1, -1, -1)).sum())
    return pa.table({"level": pa.array([group["level"][0].as_py()], pa.int64()), "overlap_bytes": pa.array([whole - apart], pa.int64())})


def overlap_bytes(table: DataFrame) -> DataFrame:
    """(level, overlap_bytes): over pairs of files of a level with overlapping key ranges, the smaller one's bytes.

    A level's records (a row a file) meet in one task, which takes from all pairs those that lie apart; pairs are never made."""
    told = table.select(F.col("level").cast("long").alias("level"), F.col("smallest").cast("binary").alias("smallest"), F.col("largest").cast("binary").alias("largest"), F.col("size_bytes").cast("long").alias("size_bytes"))
    found = told.dropna().groupBy("level").applyInArrow(_overlap, "level long, overlap_bytes long")
    return found.select(F.col("level").cast(table.schema["level"].dataType).alias("level"), "overlap_bytes")


def level_metrics(table: DataFrame) -> DataFrame:
    """(level, files, entries, bytes, overlap_bytes) of each level."""
    totals = table.groupBy("level").agg(F.count("*").alias("files"), F.sum("entries").alias("entries"), F.sum("size_bytes").alias("bytes"))
    return totals.join(overlap_bytes(table), "level", "left").withColumn("overlap_bytes", F.coalesce("overlap_bytes", F.lit(0).cast("long")))


def compaction_scores(metrics: DataFrame, l0_files: int = 4, l0_bytes: int = 256 << 20, level_bytes: int = 1 << 20) -> DataFrame:
    """(level, score): level 0 by files or bytes, others by bytes over their target and overlap over bytes; 1 or more compacts."""
    zero = F.greatest(F.col("files") / l0_files, F.col("bytes") / l0_bytes)
    other = F.col("bytes") / level_bytes + F.col("overlap_bytes") / F.greatest("bytes", F.lit(1))
    return metrics.select("level", F.when(F.col("level") == 0, zero).otherwise(other).alias("score"))


def compaction_candidate(scores: DataFrame) -> DataFrame:
    """(level, score) of the highest score if it asks for compaction; of equal ones the lowest level."""
    best = scores.agg(F.max_by(F.struct("level", "score"), F.struct("score", -F.col("level"))).alias("x"))
    return best.select("x.level", "x.score").filter("score >= 1")


def covers_overlaps(table: DataFrame, chosen: DataFrame) -> bool:
    """Whether no file outside `chosen`(file_id) overlaps the key range of those inside."""
    inside = table.join(chosen.select("file_id"), "file_id", "left_semi")
    hull = inside.agg(F.min("smallest").alias("lo"), F.max("largest").alias("hi"))
    return table.join(chosen.select("file_id"), "file_id", "left_anti").crossJoin(hull).filter("smallest <= hi and lo <= largest").isEmpty()


def orphans(present: DataFrame, referenced: DataFrame, key: str = "file_id") -> DataFrame:
    """What is stored but not referenced."""
    return present.join(referenced.select(key), key, "left_anti")


def scrub(table: DataFrame) -> DataFrame:
    """(level, files, entries) over a full read of the file table."""
    return table.groupBy("level").agg(F.count("*").alias("files"), F.sum("entries").alias("entries"))


def audit(table: DataFrame, log: DataFrame, per_file: int = 500) -> DataFrame:
    """(file_id, problem) for catalog rows that don't agree with the rows of their file."""
    real = files(log, per_file).select("file_id", F.col("smallest").alias("s"), F.col("largest").alias("l"), F.col("max_seqno").alias("m"))
    both = table.join(real, "file_id", "full_outer")
    problem = F.when(F.col("s").isNull(), "missing file").when(F.col("smallest").isNull(), "unknown file").when((F.col("s") != F.col("smallest")) | (F.col("l") != F.col("largest")), "key range").when(F.col("m") != F.col("max_seqno"), "sequence number")
    return both.select("file_id", problem.alias("problem")).filter("problem is not null")
