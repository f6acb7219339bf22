"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprint: lower-cased A-Z, words between ASCII white space, shingles of `width` words with repeats; a bit is
1 if set in over half of the shingles' XXH64 (seed 42). No words: zero.

Links, at most `radius` differing bits: each of the 64 positions has a vector m(i) of radius + 1 bits, and for
each non-zero vector v of as many bits a table keeps the positions with <m(i), v> = 1. Up to `radius` vectors
span at most `radius` dimensions, so some v is orthogonal to those of all differing positions: in that table the
pair agrees. 2^(radius+1) - 1 tables lose no pair.

Equal fingerprints are one node from the start, so copies never meet in a bucket. A bucket of at most `cap`
fingerprints is searched in its task and gives the links of a spanning forest, not all pairs. A larger bucket
is hashed again, by the same construction over the positions its table left out (about 32, then 16, then 8):
after three levels at most 8 are left, so a bucket has at most 2^8 different fingerprints. No pair is dropped.

Nulls: a null text is an empty one. Rows with a null doc_id take part and have the smallest doc_id of their
component, null if it has none. Repeated rows are returned as often as they occur; an empty table gives none. A very long text
is hashed in its task in parts, some 30 bytes a character. Clashing names: near_duplicates() reads only id and text, keep_one() keeps df's columns in one struct."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quivra.llm.common import id_and_text, quoted, written
from quivra.llm.components import components

BITS = 64


def fingerprint(text: str, width: int = 4) -> int:
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    last = ends[len(ends) - n :]
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : min(n, at + (1 << 16))].tolist(), last[at : at + (1 << 16)].tolist())], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), width) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(df: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer."""
    return id_and_text(df, id_col, text_col).mapInArrow(_fingerprints(width), "doc_id long, fp long")


def fingerprint_udf(width: int = 4):
    """The same for one column, so that a table keeps its other columns."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x or "", width) for x in texts], np.uint64).view(np.int64))

    return of


def masks(positions: list[int], radius: int) -> list[int]:
    """For each non-zero v of radius + 1 bits: the positions i, of those given, with <m(i), v> = 1."""
    half, n = 1 << radius, (1 << (radius + 1)) - 1
    # vectors with the top bit first: 2^radius of them are a Reed-Muller code, whose words have half their bits set or all
    vectors = [*range(half, n + 1), *range(1, half)]
    return [sum(1 << p for k, p in enumerate(positions) if bin(vectors[k % n] & v).count("1") % 2) for v in range(1, n + 1)]


def mask_levels(radius: int) -> list[list[int]]:
    """Masks of each level; mask t of a level has the masks t * n .. t * n + n - 1 of the next one below it."""
    levels = [masks(list(range(BITS)), radius)]
    for _ in range(2):
        levels.append([m | x for m in levels[-1] for x in masks([p for p in range(BITS) if not m >> p & 1], radius)])
    return levels


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; of signed integers numpy would count those of the absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _runs(radius: int, cap: int):
    """Rows sorted by (t, k, fp): links of each bucket, and as (fp, t, 1) the rows of buckets over cap."""

    def forest(f: np.ndarray, out: list) -> None:
        left = np.ones(len(f), bool)
        for seed in range(len(f)):
            if not left[seed]:
                continue
            left[seed] = False
            todo = [seed]
            while todo:
                at = todo.pop()
                near = np.flatnonzero(left & (_differ(f, f[at]) <= radius))
                left[near] = False
                todo += near.tolist()
                out.append((np.full(len(near), f[at]), f[near]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, k, f = (np.zeros(0, np.int64) for _ in range(3))
        over = None  # the key of a bucket over cap that may go on
        for batch in _with_end(batches):
            if batch is not None:
                new = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)]
                t, k, f = np.concatenate((t, new[0])), np.concatenate((k, new[1])), np.concatenate((f, new[2]))
            us, vs, kinds = [], [], []

            def put(u, v, kind):
                if len(u):
                    us.append(u)
                    vs.append(v)
                    kinds.append(np.full(len(u), kind, np.int32))

            if over is not None and len(t):
                same = (t == over[0]) & (k == over[1])
                n = len(t) if same.all() else int(np.argmin(same))
                put(f[:n], t[:n], 1)
                t, k, f = t[n:], k[n:], f[n:]
                if len(t):
                    over = None
            cuts = np.concatenate(([0], np.flatnonzero((np.diff(t) != 0) | (np.diff(k) != 0)) + 1, [len(t)])) if len(t) else np.array([0])
            first, size = cuts[:-1], np.diff(cuts)
            done = len(size) if batch is None else max(0, len(size) - 1)
            pairs = first[:done][size[:done] == 2]
            near = _differ(f[pairs], f[pairs + 1]) <= radius
            put(f[pairs][near], f[pairs + 1][near], 0)
            for a, n in zip(first[:done][size[:done] > 2].tolist(), size[:done][size[:done] > 2].tolist()):
                if n > cap:
                    put(f[a : a + n], t[a : a + n], 1)
                else:
                    links: list = []
                    forest(f[a : a + n], links)
                    put(np.concatenate([x for x, _ in links]), np.concatenate([y for _, y in links]), 0)
            rest = int(first[done]) if done < len(size) else len(t)
            t, k, f = t[rest:], k[rest:], f[rest:]
            if len(t) > cap:
                put(f, t, 1)
                over = (t[0], k[0])
                t, k, f = t[:0], k[:0], f[:0]
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs)), pa.array(np.concatenate(kinds))], names=["u", "v", "over"])

    return run


def _with_end(batches: Iterator[pa.RecordBatch]):
    yield from batches
    yield None


def _deeper(level: list[int], n: int):
    """Rows (fp, t of the level above) to the n masks below t."""
    table = np.array([_signed(x) for x in level], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, above = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(2))
            for at in range(0, len(f), 20_000):
                t = (above[at : at + 20_000, None] * n + np.arange(n)).ravel()
                fp = np.repeat(f[at : at + 20_000], n)
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(fp & table[t]), pa.array(fp)], names=["t", "k", "fp"])

    return run


def links(nodes: DataFrame, radius: int = 4, cap: int = 1024) -> DataFrame:
    """Links (u, v) between distinct fingerprints nodes(fp) that join all those within the radius."""
    levels = mask_levels(radius)
    n = len(levels[0])
    rows = nodes.select(F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in enumerate(levels[0])])).alias("x"), "fp").select("x.t", "x.k", "fp")
    found = None
    for depth in range(len(levels)):
        keep = cap if depth + 1 < len(levels) else 1 << BITS - min(bin(m).count("1") for m in levels[depth])
        out = written(rows.repartition("t", "k").sortWithinPartitions("t", "k", "fp").mapInArrow(_runs(radius, keep), "u long, v long, over int"), "buckets")
        new = out.filter("over = 0").select("u", "v")
        found = new if found is None else found.union(new)
        over = out.filter("over = 1")
        if depth + 1 == len(levels) or over.isEmpty():
            break
        rows = over.select(F.col("u").alias("fp"), F.col("v").alias("above")).mapInArrow(_deeper(levels[depth + 1], n), "t long, k long, fp long")
    return found


def near_duplicates(df: DataFrame, radius: int = 4, width: int = 4, cap: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest doc_id reachable over links."""
    docs = written(fingerprints(df, width, id_col, text_col), "fingerprints")
    return _components_of(docs, radius, cap)


def _components_of(docs: DataFrame, radius: int, cap: int) -> DataFrame:
    return docs.join(_labels(docs, radius, cap), "fp").select("doc_id", "fp", "component_id")


def _labels(docs: DataFrame, radius: int, cap: int) -> DataFrame:
    """(fp, root, component_id) of each fingerprint."""
    nodes = written(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), radius, cap))
    joined = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return written(joined.join(best, "root").select("fp", "root", "component_id"), "labels")


def keep_one(df: DataFrame, radius: int = 4, width: int = 4, cap: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df with one document of each component: that of the smallest doc_id, of its rows one.

    Columns are unchanged. Components of rows that all have a null doc_id keep one of them."""
    row = F.struct(*[quoted(c) for c in df.columns])
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    # numbers of written rows: what is read again has the same ones; df's own names can't clash inside the struct
    marked = written(df.select(row.alias("row"), quoted(id_col).cast("long").alias("doc_id"), fingerprint_udf(width)(text).alias("fp"), F.monotonically_increasing_id().alias("rid")), "marked")
    labels = _labels(marked, radius, cap)
    each = marked.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "rid")).alias("x"))
    # null doc_ids: several components may be without one, so they go by their root
    chosen = each.join(labels, "fp").groupBy("root").agg(F.min("x").alias("x")).select(F.col("x.rid").alias("rid"))
    kept = marked.select("row", "rid").join(chosen, "rid", "left_semi")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in df.columns])
