"""Sharding by extendible hashing: a directory indexed by the leading bits of a hash of the document id.

A bucket whose documents exceed the byte limit splits on another bit; buckets within the limit stay as they
are. All bits come from one histogram of (prefix, bytes), pre-aggregated before its shuffle, so depths are decided
without touching texts again. Where the histogram's bits end before a bucket fits, its rows alone are
counted again with more bits; after the bits of the id's hash come those of the row's text.
Rows equal in id and text can't be told apart by any hash: they are counted, and laid out in order as pages
of the bucket, so a single key with a third of all rows meets the limit too. Only a single document over
the limit has an oversized shard, of its own. The directory has a leaf for each bucket, by its prefix and depth; a slot of the full directory
(all prefixes of the greatest depth) is the leaf that its bits begin with, which locate() finds without spelling all slots out.

Nulls: a null id is hashed as such, a null text has no bytes. Repeated rows keep their number; an empty table
has no shards. Ties don't arise: a row's bits alone decide. A very long text is one row of its size; it is hashed, not held. Clashing names:
only id and text are read; write_shards() keeps df's columns beside its own, which begin with two underscores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quivra.llm.common import quoted, written

#: Of the md5 digest of id and text each, as hexadecimal digits: 15 digits (60 bits) fit a long.
DIGITS, BITS = 15, 60


def _bits(value: Column) -> Column:
    """60 bits as a string of 0 and 1."""
    return F.lpad(F.conv(F.substring(F.md5(value), 1, DIGITS), 16, 2), BITS, "0")


def _leaves(counts: DataFrame, base: int, bits: int, limit: int) -> DataFrame:
    """counts(path, bytes, rows), path of base + bits characters: the shortest prefix of each that fits, null if none does."""
    sums = counts.select("path", F.explode(F.sequence(F.lit(base), F.lit(base + bits))).alias("depth"), "bytes").withColumn("prefix", F.expr("substring(path, 1, depth)"))
    fits = sums.groupBy("prefix", "depth").agg(F.sum("bytes").alias("shard_bytes")).filter(F.col("shard_bytes") <= limit)
    leaf = sums.select("path", "prefix", "depth").join(fits, ["prefix", "depth"]).groupBy("path").agg(F.min_by(F.struct("prefix", "shard_bytes"), "depth").alias("leaf"))
    return counts.select("path").join(leaf, "path", "left").select("path", "leaf.prefix", "leaf.shard_bytes")


def assign(df: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", chunk_bits: int = 12) -> DataFrame:
    """(doc_id, n_bytes, shard, depth, page, shard_bytes) of every row.

    shard is the prefix of hash bits, depth its length; page is 0 but where equal rows overflow a shard."""
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    key = quoted(id_col).cast("string")
    id_bits = _bits(F.coalesce(key, F.lit("null")))
    rows = df.select(quoted(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.concat(id_bits, _bits(text)).alias("bits"))
    rows = written(rows, "shard-rows")
    done, todo, base = None, rows, 0
    while base < 2 * BITS:
        bits = min(chunk_bits, 2 * BITS - base)
        path = todo.withColumn("path", F.substring("bits", 1, base + bits))
        counts = written(path.groupBy("path").agg(F.sum("n_bytes").alias("bytes")), "shard-counts")
        leaves = written(_leaves(counts, base, bits, limit), "shard-leaves")
        # at most 2^chunk_bits paths below each oversized bucket; AQE broadcasts the leaves while they are few
        joined = path.join(leaves, "path")
        placed = joined.filter(F.col("prefix").isNotNull()).select("doc_id", "n_bytes", F.col("prefix").alias("shard"), F.length("prefix").alias("depth"), F.lit(0).cast("long").alias("page"), "shard_bytes")
        done = placed if done is None else done.unionByName(placed)
        base += bits
        if leaves.filter(F.col("prefix").isNull()).isEmpty():
            return done
        todo = written(joined.filter(F.col("prefix").isNull()).select("doc_id", "n_bytes", "bits"), "shard-rest")
    return done.unionByName(_pages(todo, limit))


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Rows equal in all bits, counted first and then dealt in order to pages of at most `limit` bytes."""
    same = rows.groupBy("bits", "doc_id", "n_bytes").count()
    each = F.greatest(F.floor(F.lit(limit) / F.greatest("n_bytes", F.lit(1))), F.lit(1)).cast("long")
    pages = same.withColumn("each", each).withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("count") - 1) / F.col("each")).cast("long"))))
    held = F.least("each", F.col("count") - F.col("page") * F.col("each"))
    out = pages.withColumn("held", held).withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), F.col("held"))))
    return out.select("doc_id", "n_bytes", F.col("bits").alias("shard"), F.length("bits").alias("depth"), "page", (F.col("held") * F.col("n_bytes")).alias("shard_bytes"))


def locate(ids: DataFrame, shards: DataFrame, id_col: str = "doc_id", text_col: str | None = None) -> DataFrame:
    """(doc_id, shard) of ids, by the directory: the leading bits of an id's hash, at each depth that the directory has, name one leaf.

    A bucket that only the text's bits divide (equal ids) is found with text_col; without it such an id has no shard of its own."""
    depths = sorted(r[0] for r in shards.select("depth").distinct().collect()) or [0]  # at most 121 of them
    bits = _bits(F.coalesce(quoted(id_col).cast("string"), F.lit("null")))
    if text_col:
        bits = F.concat(bits, _bits(F.coalesce(quoted(text_col).cast("string"), F.lit(""))))
    rows = ids.select(quoted(id_col).alias("doc_id"), bits.alias("bits")).distinct()
    slots = rows.select("doc_id", F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.substring("bits", 1, d).alias("shard")) for d in depths])).alias("x")).select("doc_id", "x.*")
    return slots.join(shards.select("shard", "depth").distinct(), ["shard", "depth"]).select("doc_id", "shard").distinct()


def directory(assigned: DataFrame) -> DataFrame:
    """(shard, page, depth, rows, bytes), one row a shard."""
    return assigned.groupBy("shard", "page", "depth").agg(F.count("*").alias("rows"), F.sum("n_bytes").alias("bytes"))


def write_shards(df: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the rows of df, one folder a shard and page, and returns the directory of what was written. Ids may repeat."""
    assigned = written(assign(df, limit, id_col, text_col), "assigned")
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    bits = F.concat(_bits(F.coalesce(quoted(id_col).cast("string"), F.lit("null"))), _bits(text))
    rows = written(df.withColumns({"__bits": bits, "__bytes": F.octet_length(text).cast("long"), "__part": F.spark_partition_id()}), "shard-rows")
    leaves = assigned.groupBy(F.col("shard").alias("__leaf")).agg((F.max("page") > 0).alias("__paged"))
    depths = sorted(r[0] for r in assigned.select("depth").distinct().collect()) or [0]
    # no leaf is a prefix of another, so the different bits have one each
    prefixes = F.explode(F.array(*[F.substring("__bits", 1, d) for d in depths])).alias("__leaf")
    placed = rows.join(rows.select("__bits").distinct().select("__bits", prefixes).join(leaves, "__leaf"), "__bits")
    plain = placed.filter("not __paged").withColumn("__page", F.lit(0).cast("long"))
    # equal rows are numbered within their partitions, after the counts of those before
    paged = placed.filter("__paged")
    before = Window.partitionBy("__bits").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offset = paged.groupBy("__bits", "__part").count().select("__bits", "__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__from"))
    number = F.col("__from") + F.row_number().over(Window.partitionBy("__bits", "__part").orderBy("__leaf")) - 1
    each = F.greatest(F.floor(F.lit(limit) / F.greatest("__bytes", F.lit(1))), F.lit(1))
    paged = paged.join(offset, ["__bits", "__part"]).withColumn("__page", F.floor(number / each).cast("long")).drop("__from")
    placed = plain.unionByName(paged).withColumn("__shard", F.concat_ws("-", F.concat(F.lit("s"), "__leaf"), "__page"))
    placed.select(*[quoted(x) for x in df.columns], "__shard").repartition("__shard").write.partitionBy("__shard").parquet(path)
    return directory(placed.select(F.col("__leaf").alias("shard"), F.col("__page").alias("page"), F.length("__leaf").alias("depth"), F.col("__bytes").alias("n_bytes")))
