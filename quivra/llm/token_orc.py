"""Token ids in ORC files: run-length coded integers, row indexes and a Bloom filter on the document id.

Documents are dealt by ranges of doc_id before they are encoded, so each file holds a range, files follow
one another, and stripes and row groups have narrow doc_id statistics. A lookup skips files and stripes by
these and row groups by the Bloom filter; a full read is split by stripes.

Nulls: a null text counts as empty (one id, the end id); a null doc_id comes first. Documents with one
doc_id lie by a hash of their text; identical rows are each kept. An empty table gives files without rows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quivra.llm.common import id_and_text, new_path, written
from quivra.llm.encoding import encoder


def _encode(path: str, end_id: int, batch_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, at = encoder(path), np.array([end_id], "<u4").tobytes(), 0
        ids: list = []
        starts: list[int] = []
        parts: list[bytes] = []
        held = 0

        def flush():
            nonlocal ids, starts, parts, held
            sizes = np.fromiter((len(x) // 4 for x in parts), np.int64, len(parts))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(np.frombuffer(b"".join(parts), "<i4")))
            out = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), lists], names=["doc_id", "file_start", "ids"])
            ids, starts, parts, held = [], [], [], 0
            return out

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                code = enc.encode(text.as_py()) + end
                ids.append(key)
                starts.append(at)
                parts.append(code)
                at += len(code) // 4
                held += len(code) // 4
                if held >= batch_tokens:
                    yield flush()
        if ids:
            yield flush()

    return run


def write_tokens(df: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", stripe_bytes: int = 64 << 20, row_index_stride: int = 1000, batch_tokens: int = 1 << 20) -> None:
    """Writes (doc_id, file_start, ids) in ascending doc_id order; file_start counts the ids before the document in its file."""
    src = id_and_text(df, id_col, text_col)
    tie = F.xxhash64("text")
    dealt = src.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    coded = dealt.mapInArrow(_encode(tokenizer, end_id, batch_tokens), "doc_id long, file_start long, ids array<int>")
    # one file a task: file_start counts on within it, whatever the session says of records a file
    (coded.write.option("maxRecordsPerFile", 0).option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.row.index.stride", str(row_index_stride)).option("orc.stripe.size", str(stripe_bytes)).option("orc.compress", "ZSTD").orc(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, file_start long, ids array<int>").orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The ids of some documents; the predicate reaches stripe statistics, row indexes and Bloom filters."""
    return read_tokens(spark, path).filter(F.col("doc_id").isin([int(x) for x in doc_ids])).select("doc_id", "ids")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        ends = lists.offsets.to_numpy()
        raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], names=["file", "doc_id", "file_start", "n_tokens", "ids_crc32"])


def document_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files.

    start is the sum of all earlier files plus file_start. The sums are one row a file."""
    rows = read_tokens(spark, path).select(F.col("_metadata.file_name").alias("file"), "doc_id", "file_start", "ids")
    rows = written(rows.mapInArrow(_digest, "file string, doc_id long, file_start long, n_tokens long, ids_crc32 long"), "token-index")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long"), F.regexp_extract("file", r"-c(\d+)", 1).cast("long")
    before = Window.orderBy(*number).rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return rows.join(files, "file").select("doc_id", (F.col("base") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32")


def encode_to_orc(df: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None, **options) -> DataFrame:
    """Writes the files and returns document_index() of them."""
    spark = df.sparkSession
    path = path or new_path(spark, "tokens")
    write_tokens(df, path, tokenizer, end_id, **options)
    return document_index(spark, path)
