"""The mutation feed: batches applied once, in order, and fenced by term."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState

from quivra.sources.store import VectorStore

REMEMBERED = 4096
FENCED = "partition long, seq long, term long, payload string, status string"


def _fence(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State: the next sequence number, the greatest term, and the payload hashes of the last REMEMBERED entries; one before them is `replayed`."""
    expected, term, known = state.get if state.exists else (1, 0, "{}")
    known = {int(k): v for k, v in (x.split("=") for x in known.strip("{}").split(";") if x)}
    rows = pd.concat(list(batches)).sort_values(["seq", "term"])
    out = []
    for r in rows.itertuples(index=False):
        digest = str(pd.util.hash_array(pd.array([r.payload], dtype=object).to_numpy())[0])
        if r.term < term:
            status = "stale term"
        elif r.seq < expected:
            status = "replayed" if r.seq not in known else "duplicate" if known[r.seq] == digest else "conflict"
        elif r.seq > expected:
            status = "gap"
        else:
            status, expected, known[r.seq] = "applied", expected + 1, digest
        if status in ("applied", "duplicate"):
            term = max(term, r.term)
        out.append((key[0], r.seq, r.term, r.payload, status))
    kept = dict(sorted(known.items())[-REMEMBERED:])
    state.update((expected, int(term), ";".join(f"{k}={v}" for k, v in kept.items())))
    yield pd.DataFrame(out, columns=["partition", "seq", "term", "payload", "status"])


def fenced(journal: DataFrame) -> DataFrame:
    """Each entry of journal(partition, seq, term, payload) with what becomes of it: applied, duplicate, conflict, gap, stale term, or
    replayed: older than what the state remembers, to be told by resolved().

    Entries of a partition are applied strictly in order. Works on a stream and on a table."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    rows = journal.select("partition", "seq", "term", "payload")
    if rows.isStreaming:
        return rows.groupBy("partition").applyInPandasWithState(_fence, FENCED, "expected long, term long, known string", "append", GroupStateTimeout.NoTimeout)

    dealt = rows.repartition("partition").sortWithinPartitions("partition", F.asc_nulls_last("seq"), "term")
    return dealt.mapInArrow(_fenced_in_order, FENCED)


def _fenced_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_fence() of a whole journal that comes ordered by partition, seq and term: as an entry under the next sequence number can only repeat the one applied
    last, that one's payload is all that has to be remembered."""
    now, expected, term, last = None, 1, 0, None
    for batch in batches:
        out = []
        for partition, seq, t, payload in zip(*(c.to_pylist() for c in batch.columns)):
            if partition != now:
                now, expected, term, last = partition, 1, 0, None
            if t is not None and t < term:
                out.append("stale term")
                continue
            if seq == expected:
                status, expected, last = "applied", expected + 1, payload
            elif seq is None or seq > expected:
                status = "gap"
            elif expected == 1 or seq != expected - 1:
                status = "replayed"
            else:
                status = "duplicate" if payload == last else "conflict"
            if status in ("applied", "duplicate") and t is not None:
                term = t
            out.append(status)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=["partition", "seq", "term", "payload", "status"])


def resolved(found: DataFrame, applied: DataFrame) -> DataFrame:
    """fenced() with each replayed entry held against the journal of applied entries (partition, seq, payload): duplicate or conflict."""
    kept = applied.select("partition", "seq", F.col("payload").alias("was"), F.lit(True).alias("there"))
    status = F.when(F.col("there") & F.col("was").eqNullSafe(F.col("payload")), "duplicate").otherwise("conflict")
    old = found.filter("status = 'replayed'").drop("status").join(kept, ["partition", "seq"], "left").withColumn("status", status)
    return found.filter("status != 'replayed'").unionByName(old.select(found.columns))


def into(store: VectorStore, mutations: DataFrame, checkpoint: str) -> DataStreamWriter:
    """A writer that applies each micro-batch of mutations(pos, kind, id, values) as one commit.

    A batch that Spark repeats after a failure has the name it had and is not applied again."""

    def apply(batch: DataFrame, number: int) -> None:
        store.apply(batch, batch=(checkpoint, number))

    return mutations.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def since(log: DataFrame, seq: int, limit: int | None = None) -> DataFrame:
    """Entries from a sequence number on, in order."""
    rows = log.filter(F.col("seq") >= seq).orderBy("seq")
    return rows if limit is None else rows.limit(limit)


def pruned(log: DataFrame, before: int) -> DataFrame:
    return log.filter(F.col("seq") >= before)


def next_seq(log: DataFrame) -> DataFrame:
    """(next_seq): one more than the last; 1 of an empty log."""
    return log.agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("next_seq"))
