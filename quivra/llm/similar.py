"""SimHash near-dedup at a similarity of `similarity` or more on shingles of `width` words.

Pairs of 0.8 differ in about ten of 64 bits, too many for covering tables alone. So besides the dealt method (fingerprints that covering tables join
within `radius` bits) each text has one fingerprint for each of `parts` samples: the SimHash of the `least` shingles that come first in that part's order.
Candidates are texts joined by the tables and texts that agree in a sample's fingerprint. A pair of similarity s agrees in a part
with probability s^least: with 24 parts of 6, pairs of 0.8 are missed once in a thousand. Candidates become links only if the
similarity (Jaccard) of their whole shingle sets is high enough, so common passages link nothing.

Texts with equal words are one node. In a bucket all nodes are first compared with two of it: with the one that has the most company in all
its buckets, as the original of a family has, and with the least; sets whose sizes alone rule the similarity out are not. What these links leave
in several components is then compared whole, each with each; only pairs that links already join are left out, which changes no component.
Comparisons are dealt in units of about `unit` shingles, in which a set lies once, so a head with a third of all texts is many units. Nodes are 64-bit hashes.

Nulls, ties and repeated rows as in simhash.keep_one(): one row of each component stays, of the smallest doc_id. Empty texts are one node. A very
long text is hashed by itself and takes about 60 bytes of memory a character there. An empty table gives no rows. df's columns travel in one
struct, so none of their names can clash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quivra.llm import hashing
from quivra.llm.common import free_held, quoted, written
from quivra.llm.components import components
from quivra.llm.simhash import links

_ODD = np.random.default_rng(20).integers(1 << 62, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_UNDO = np.array([pow(int(x), -1, 1 << 64) for x in _ODD], np.uint64)
#: Values that are ordered at once.
_AT_ONCE = 1 << 20


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def hashed(words: list[bytes], width: int) -> tuple[int, np.ndarray]:
    """(the node, the hash of each shingle in order); of fewer words one shingle for all of them, of none no shingle."""
    line = np.frombuffer(b" ".join(words), np.uint8)
    sums, forth = hashing.prefix_sums(line)
    node = int(hashing.mixed((sums[-1:] * forth[-1:] if len(line) else np.zeros(1, np.uint64)) ^ np.uint64(7))[0])
    if not words:
        return node, np.zeros(0, np.uint64)
    gaps = np.flatnonzero(line == 32)
    n = max(1, len(words) - width + 1)
    starts, ends = np.concatenate(([0], gaps + 1))[:n], np.concatenate((gaps, [len(line)]))[-n:]
    return node, hashing.mixed((sums[ends] - sums[starts]) * forth[ends - 1])


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """The different hashes of all shingles, ascending."""
    return np.unique(hashed(words, width)[1])


def votes(hashes: np.ndarray) -> int:
    """SimHash: a bit is 1 if set in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<i8")[0])


def samples(hashes: np.ndarray, parts: int, least: int) -> np.ndarray:
    """One fingerprint for each part: SimHash of the `least` hashes that are lowest after multiplication by the part's number."""
    if not len(hashes):
        return np.zeros(parts, np.int64)
    m, step = min(least, len(hashes)), max(1, _AT_ONCE // len(hashes))
    chosen = [np.partition(hashes * _ODD[a : a + step, None], m - 1, axis=1)[:, :m] * _UNDO[a : a + step, None] for a in (range(0, parts, step))]
    bits = np.unpackbits(np.concatenate(chosen)[:parts].view(np.uint8).reshape(parts, m, 8), axis=2, bitorder="little").sum(axis=1, dtype=np.int64)
    return np.packbits(2 * bits > m, axis=1, bitorder="little").view("<i8").ravel()


def marks_udf(width: int, parts: int, least: int):
    """node, fp, parts and number of shingles of a text."""

    @F.arrow_udf("node long, fp long, parts array<long>, n long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        free_held()
        for texts in batches:
            nodes, prints, found, size = [], [], [np.zeros(0, np.int64)], []
            for text in texts:
                node, every = hashed(words_of(text.as_py()), width)
                one = np.unique(every)
                nodes.append(node - (1 << 64) if node >> 63 else node)
                prints.append(votes(every))
                found.append(samples(one, parts, least))
                size.append(len(one))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * parts), pa.array(np.concatenate(found)))
            yield pa.StructArray.from_arrays([pa.array(nodes, pa.int64()), pa.array(prints, pa.int64()), lists, pa.array(size, pa.int64())], names=["node", "fp", "parts", "n"])

    return of


def buckets(nodes: DataFrame, radius: int, cap: int) -> tuple[DataFrame, DataFrame]:
    """Of nodes(node, fp, parts, n): the rows (t, k, node, n) of buckets with company, and per bucket (t, k, shingles, most, low), the last two as (node, n).

    k of part t is a sample's fingerprint; of t = -1 the component of fingerprints within the radius."""
    near = components(links(nodes.select("fp").distinct(), radius, cap)).select(F.col("node").alias("fp"), "root")
    joined = nodes.select("node", "n", "fp").join(near, "fp", "left").select("node", "n", F.lit(-1).alias("t"), F.coalesce("root", "fp").alias("k"))
    rows = written(nodes.select("node", "n", F.posexplode("parts").alias("t", "k")).unionByName(joined), "samples")
    size = rows.groupBy("t", "k").agg(F.count("*").alias("size")).filter("size > 1")
    busy = written(rows.join(size, ["t", "k"]), "busy")
    company = busy.groupBy("node").agg(F.sum("size").alias("company"))
    one = F.struct("node", "n")
    heads = busy.join(company, "node").groupBy("t", "k").agg(F.sum("n").alias("shingles"), F.max_by(one, F.struct("company", "node")).alias("most"), F.min(one).alias("low"))
    return busy.select("t", "k", "node", "n"), written(heads, "heads")


def candidates(busy: DataFrame, heads: DataFrame, similarity: float, unit: int) -> DataFrame:
    """(head, blocks, block, node): what each head is compared with, in units; the head itself is in each of its units."""
    met = busy.join(heads, ["t", "k"])
    # a power of two, so a head met in several buckets has few numbers of blocks
    blocks = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("shingles") / unit, F.lit(1))))).cast("long")
    pairs = None
    for head in ("most", "low"):
        fits = (F.col("node") != F.col(f"{head}.node")) & (F.least("n", f"{head}.n") >= similarity * F.greatest("n", f"{head}.n"))
        rows = met.filter(fits).select(F.col(f"{head}.node").alias("head"), "node", blocks.alias("blocks"))
        pairs = rows if pairs is None else pairs.union(rows)
    pairs = pairs.groupBy("head", "node").agg(F.max("blocks").alias("blocks"))
    members = pairs.select("head", "blocks", F.pmod(F.xxhash64("node"), "blocks").alias("block"), "node")
    members = written(members, "candidates")
    own = members.select("head", "blocks", "block").distinct().select("head", "blocks", "block", F.col("head").alias("node"))
    return members.unionByName(own)


def _sets(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, sizes, all values) of a unit's sets, each ascending."""
    lists = table.column("hashes").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    size = np.diff(lists.offsets.to_numpy())
    return table.column("node").to_numpy(), size, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _beside_head(similarity: float):
    """Links of the nodes of a unit with its head."""

    def run(table: pa.Table) -> pa.Table:
        head = table.column("head")[0].as_py()
        node, size, values = _sets(table)
        ends = np.cumsum(size)
        own = int(np.flatnonzero(node == head)[0])
        mine = values[ends[own] - size[own] : ends[own]]
        place = np.minimum(np.searchsorted(mine, values), len(mine) - 1)
        common = np.bincount(np.repeat(np.arange(len(node)), size), mine[place] == values, len(node))
        near = (node != head) & (common >= similarity * np.maximum(1, size + len(mine) - common))
        return pa.table({"u": pa.array(np.full(near.sum(), head, np.int64)), "v": pa.array(node[near])})

    return run


def unresolved(busy: DataFrame, heads: DataFrame, roots: DataFrame) -> DataFrame:
    """(t, k, node, root, shingles) of the buckets whose nodes, but for the two that all were compared with, are in several components."""
    rest = busy.join(heads, ["t", "k"]).filter("node != most.node and node != low.node").join(roots, "node", "left").select("t", "k", "node", "n", F.coalesce("root", "node").alias("root"))
    open_ = rest.groupBy("t", "k").agg(F.sum("n").alias("shingles"), F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("t", "k", "shingles")
    return rest.drop("n").join(open_, ["t", "k"])


def _linked(similarity: float):
    """Links of one unit (two blocks of a bucket): each node is compared with all that are not yet in its component."""

    def run(table: pa.Table) -> pa.Table:
        node, size, values = _sets(table)
        label = table.column("root").to_numpy().copy()
        owner = np.repeat(np.arange(len(node)), size)
        distinct, place = np.unique(values, return_inverse=True)
        ends = np.cumsum(size)
        mark, us, vs = np.zeros(len(distinct), bool), [], []
        for i in range(len(node)):
            # an earlier node has been compared with this one
            if not (label[i + 1 :] != label[i]).any():
                continue
            mine = place[ends[i] - size[i] : ends[i]]
            mark[mine] = True
            common = np.bincount(owner[mark[place]], minlength=len(node))
            mark[mine] = False
            near = np.flatnonzero((label != label[i]) & (common >= similarity * np.maximum(1, size[i] + size - common)))
            if len(near):
                us += [node[i]] * len(near)
                vs += node[near].tolist()
                label[np.isin(label, label[near])] = label[i]
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


def compared(rest: DataFrame, sets: DataFrame, similarity: float, unit: int) -> DataFrame:
    """(u, v): links among unresolved(...) nodes; a bucket's blocks meet in twos, so a unit has at most two blocks."""
    spread = rest.withColumn("blocks", F.ceil(2 * F.col("shingles") / unit).cast("long")).withColumn("own", F.pmod(F.xxhash64("node"), F.greatest("blocks", F.lit(1))))
    spread = spread.select("t", "k", "node", "root", "own", F.explode(F.sequence(F.lit(0), F.greatest("blocks", F.lit(1)) - 1)).alias("other"))
    spread = spread.select("t", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "root")
    return spread.join(sets, "node").groupBy("t", "k", "i", "j").applyInArrow(_linked(similarity), "u long, v long")


def shingles_udf(width: int):
    @F.arrow_udf("array<long>")
    def of(texts: pa.Array) -> pa.Array:
        found = [shingles(words_of(x.as_py()), width).view(np.int64) for x in texts]
        return pa.array(found, pa.list_(pa.int64()))

    return of


def similar_nodes(marked: DataFrame, similarity: float, width: int, radius: int, cap: int, unit: int, text: F.Column) -> DataFrame:
    """(node, root) of linked nodes, of marked(node, fp, parts, n, ...); text: the column of texts."""
    nodes = written(marked.groupBy("node").agg(F.first("fp").alias("fp"), F.first("parts").alias("parts"), F.first("n").alias("n")), "nodes")
    busy, heads = buckets(nodes, radius, cap)
    units = candidates(busy, heads, similarity, unit)
    # one text a node and task goes through the shuffle, however many copies there are; the joins are the same ones at every size
    asked = busy.select("node").distinct()
    texts = marked.select("node", text.alias("text")).dropDuplicates(["node"]).join(asked.hint("merge"), "node", "left_semi")
    sets = written(texts.select("node", shingles_udf(width)("text").alias("hashes")), "shingles")
    found = units.join(sets, "node").groupBy("head", "blocks", "block").applyInArrow(_beside_head(similarity), "u long, v long")
    found = written(found, "found")
    roots = components(found)
    rest = written(unresolved(busy, heads, roots), "unresolved")
    if not rest.isEmpty():
        more = written(compared(rest, sets, similarity, unit), "more")
        roots = components(found.union(more))
    return roots


def keep_one(df: DataFrame, similarity: float = 0.8, width: int = 5, radius: int = 4, cap: int = 1024, parts: int = 24, least: int = 6, unit: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df with one document of each component, columns unchanged."""
    row = F.struct(*[quoted(c) for c in df.columns])
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    one = df.select(row.alias("row"), quoted(id_col).cast("long").alias("doc_id"), marks_udf(width, parts, least)(text).alias("m"))
    # numbers of written rows: what is read again has the same ones
    marked = written(one.select("row", "doc_id", "m.*", F.monotonically_increasing_id().alias("rid")), "marked")
    kept_text = F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit(""))
    roots = similar_nodes(marked, similarity, width, radius, cap, unit, kept_text)
    owner = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", "rid"))
    each = marked.groupBy("node").agg(owner.alias("x"))
    chosen = each.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("x").alias("x")).select(F.col("x.rid").alias("rid"))
    kept = marked.select("row", "rid").join(chosen.hint("merge"), "rid", "left_semi")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in df.columns])
