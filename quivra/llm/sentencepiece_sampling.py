"""SentencePiece segmentations, sampled without replacement by Gumbel top-k over the lattice.

The lattice of a text has an edge for each vocabulary piece at each place, and byte pieces for a character that no
piece covers. No piece crosses from a character to a following word mark, so the lattice is a chain of the
chunks' lattices. Texts are taken in batches: each different chunk of a batch is built once, its edges by walking the
vocabulary's trie one character further at all places together, its sums of all paths from the chunks' ends backwards, in logarithms.

Top-k: the best of all paths has a Gumbel value of the total mass, and its path is a sample. The other paths fall
into one set for each edge of it: those that share the edges before and leave there. A set's mass is known, its Gumbel value
is drawn below that of the path it branches from; the set of the greatest value has the next path, drawn from its mass,
and is split in turn. This best-first search gives k distinct paths in falling order of perturbed log-probability, for all texts of a batch at once.
The (k+1)-th value is the threshold of the inclusion scores 1 - exp(-exp(log p - threshold)).

Random numbers are hashes of the row's key, `seed`, the path and the place, and log-probabilities are added as integers (2^-40): equal rows
have equal samples in any batch. Nulls: a null text is empty and has one path, without pieces; a null key is a key of its own. A text with
fewer than k paths has all of them, with inclusion 1. Ties of perturbed values go to the earlier path and place. Repeated rows are sampled
alike; an empty table gives no rows. A very long text is a batch of its own and takes about 200 bytes of memory a character in its task.
Only the id and text columns are read, so others can't clash; decode() replaces a column of its name."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quivra.llm import hashing
from quivra.llm.common import held, id_and_text
from quivra.llm.hashing import stretches

MARK = "▁"
#: Code points whose chunks share a lattice, and of these those that are sampled at once.
BATCH, AT_ONCE = 1_000_000, 250_000
_FIXED = 2.0**40


class Children:
    """(trie node, character) -> node, exact: buckets by a hash, found in rounds."""

    def __init__(self, keys: np.ndarray, nodes: np.ndarray):
        self.bits = max(1, int(2 * len(keys)).bit_length())
        bucket = self._bucket(keys)
        order = np.argsort(bucket, kind="stable")
        self.keys, self.nodes = np.append(keys[order], -1), np.append(nodes[order], 0)
        self.first = np.zeros((1 << self.bits) + 1, np.int32)
        self.first[1:] = np.cumsum(np.bincount(bucket, minlength=1 << self.bits))

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """0 where there is none."""
        bucket = self._bucket(keys)
        at, end = self.first[bucket], self.first[bucket + 1]
        out = np.where((self.keys[at] == keys) & (at < end), self.nodes[at], 0)
        todo = np.flatnonzero((out == 0) & (at + 1 < end))
        at, end, keys = at[todo], end[todo], keys[todo]
        while len(todo):
            at = at + 1
            same = self.keys[at] == keys
            out[todo[same]] = self.nodes[at[same]]
            on = np.flatnonzero(~same & (at + 1 < end))
            todo, at, end, keys = todo[on], at[on], end[on], keys[on]
        return out


class Pieces:
    """The vocabulary as a trie with a log-weight for each piece."""

    def __init__(self, model: str, theta: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        scores = [sp.get_score(i) for i in range(sp.get_piece_size())]
        # the scores of a merge-ranked model are 0, -1, -2, ...: taken as ranks of a Zipf law
        ranked = min(scores) < -100
        trie: dict[tuple[int, str], int] = {}
        piece, weight = [-1], [0.0]
        for i in range(sp.get_piece_size()):
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i):
                continue
            text, node = sp.id_to_piece(i), 0
            if MARK in text[1:].lstrip(MARK):
                raise ValueError("a piece crosses a word mark")
            for c in text:
                if (following := trie.get((node, c))) is None:
                    following = trie[node, c] = len(piece)
                    piece.append(-1)
                    weight.append(0.0)
                node = following
            piece[node], weight[node] = i, theta * (-math.log(10 - scores[i]) if ranked else scores[i])
        self.fallback = -theta * math.log(10 + len(scores))
        self.piece, self.weight = np.array(piece, np.int32), np.array(weight)
        self.root = np.zeros(0x110000, np.int32)
        inner = [(n << 21 | ord(c), to) for (n, c), to in trie.items() if n]
        for (n, c), to in trie.items():
            if not n:
                self.root[ord(c)] = to
        self.children = Children(np.array([x for x, _ in inner], np.int64), np.array([x for _, x in inner], np.int32))

    def ids(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of edges and how many each has: a piece, or the bytes of code point -1 - code."""
        point = -1 - code
        n = np.where(code >= 0, 1, _utf8_size(point))
        out = np.empty(int(n.sum()), np.int32)
        at = np.cumsum(n) - n
        out[at] = code
        bare = np.flatnonzero(code < 0)
        if len(bare):
            at, n_bare, point = at[bare], n[bare], point[bare]
            lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[n_bare]
            out[at] = self.byte[lead | point >> 6 * (n_bare - 1)]
            for j in range(1, 4):
                on = n_bare > j
                out[at[on] + j] = self.byte[0x80 | point[on] >> 6 * (n_bare[on] - 1 - j) & 0x3F]
        return out, n


def _utf8_size(point: np.ndarray) -> np.ndarray:
    return 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)


@dataclass
class Lattice:
    """Edges of node v: first[v] .. first[v + 1] - 1. Node n is the end of every chunk."""

    first: np.ndarray
    end: np.ndarray
    code: np.ndarray
    cum: np.ndarray
    node: np.ndarray
    fixed: np.ndarray  # log-probabilities as integers
    other: np.ndarray  # log of what the node's other edges have

    @property
    def n(self) -> int:
        return len(self.first) - 1

    def prob(self, edge: np.ndarray) -> np.ndarray:
        return np.exp(self.fixed[edge] / _FIXED)

    @classmethod
    def of(cls, pieces: Pieces, codes: np.ndarray, left: np.ndarray) -> Lattice:
        """codes: of chunks, one behind the other; left: characters from each place to its chunk's end."""
        n = len(codes)
        node = pieces.root[codes]
        single = pieces.piece[node] >= 0
        bare = np.flatnonzero(~single)
        found = [(np.flatnonzero(single), node[single]), (bare, None)]  # edges of 1 character; then of 2, 3, ...
        at = np.flatnonzero((node > 0) & (left > 1))
        now, depth = node[at].astype(np.int64), 1
        while len(at):
            now = pieces.children.find(now << 21 | codes[at + depth]).astype(np.int64)
            depth += 1
            some = now > 0
            at, now = at[some], now[some]
            whole = pieces.piece[now] >= 0
            found.append((at[whole], now[whole]))
            on = left[at] > depth
            at, now = at[on], now[on]
        width = np.zeros(n, np.int32)
        for source, _ in found:
            width[source] += 1
        first = np.zeros(n + 1, np.int64)
        np.cumsum(width, out=first[1:])
        m = int(first[-1])
        end, code, log, filled = np.empty(m, np.int32), np.empty(m, np.int32), np.empty(m), first[1:] - 1
        for size, (source, trie_node) in zip((1, 1, *range(2, len(found))), found):
            e = filled[source]  # the longest edge comes first: it is the likeliest
            filled[source] -= 1
            end[e] = np.where(left[source] == size, n, source + size)
            if trie_node is None:
                code[e], log[e] = -1 - codes[source].astype(np.int32), pieces.fallback * _utf8_size(codes[source])
            else:
                code[e], log[e] = pieces.piece[trie_node], pieces.weight[trie_node]
        # mass[v]: log of the sum over all paths from v to its chunk's end
        mass = np.zeros(n + 1)
        order = np.argsort(left.astype(np.uint16) if n and left.max() < 1 << 16 else left, kind="stable")
        edges = stretches(first[order], width[order])
        steps = np.cumsum(np.bincount(left)) if n else np.zeros(1, np.int64)
        heads = np.cumsum(width[order]) - width[order]
        for r in range(1, len(steps)):
            a, b = steps[r - 1], steps[r]
            if a == b:
                continue
            here, low = order[a:b], heads[a]
            e = edges[low : heads[b] if b < n else m]
            value, head = log[e] + mass[end[e]], heads[a:b] - low
            top = np.maximum.reduceat(value, head)
            mass[here] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, width[here])), head))
        source = np.repeat(np.arange(n, dtype=np.int32), width)
        log += mass[end] - mass[source]
        prob = np.exp(log)
        cum, at, j = prob.copy(), np.flatnonzero(width > 1), 1
        while len(at):
            cum[first[at] + j] += cum[first[at] + j - 1]
            j += 1
            at = at[width[at] > j]
        cum[first[1:] - 1] = np.inf
        with np.errstate(divide="ignore"):
            other = np.log(np.maximum(1.0 - prob, 0.0))
        other[first[:-1][width == 1]] = -np.inf
        return cls(first, end, code, cum, source, np.round(log * _FIXED).astype(np.int64), other)

    def walk(self, node: np.ndarray, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Samples from each of `node` to its chunk's end: (edges, one walk behind the other, and their numbers)."""
        steps, count = [], np.zeros(len(node), np.int64)
        at, r = np.arange(len(node)), 0
        while len(at):
            u = uniform(stream + np.uint64(r * _ROUND & _ALL))
            e = self.first[node]
            todo = np.flatnonzero(u >= self.cum[e])
            while len(todo):
                e[todo] += 1
                todo = todo[u[todo] >= self.cum[e[todo]]]
            steps.append((at, e))
            count[at] += 1
            node = self.end[e]
            on = node < self.n
            at, node, stream, r = at[on], node[on], stream[on], r + 1
        head = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        for r, (at, e) in enumerate(steps):
            out[head[at] + r] = e
        return out, count


_ALL, _ROUND = (1 << 64) - 1, 0xA24BAED4963EE407
_PLACE, _PATH = np.uint64(0x9FB21C651E98DF25), 0xC2B2AE3D27D4EB4F


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit states."""
    return ((hashing.mixed(x) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def _stream(seeds: np.ndarray, path: int, kind: int) -> np.ndarray:
    return hashing.mixed(seeds + np.uint64((2 * path + kind) * _PATH & _ALL))


def seed_of(key, seed: int) -> int:
    return zlib.crc32(f"{seed}:{key}".encode()) << 32 | zlib.crc32(f"{key}:{seed}".encode())


class Batch:
    """Texts cut into chunks: the lattice of the different ones, the first node of each chunk, and the chunks of each text."""

    def __init__(self, pieces: Pieces, texts: list[str]):
        """A text's lattice is that of the mark and the text, spaces as marks; a chunk begins where a run of marks begins."""
        lines = [MARK + x.replace(" ", MARK) if x else "" for x in texts]
        codes, ends = hashing.code_points("".join(lines)), np.cumsum([len(x) for x in lines])
        mark = codes == ord(MARK)
        begin = mark.copy()
        begin[1:] &= ~mark[:-1]
        begin[ends[:-1][ends[:-1] < len(codes)]] = True
        start = np.flatnonzero(begin)
        size = np.diff(start, append=len(codes))
        sums, forth = hashing.prefix_sums(codes)
        stop = start + size
        key = (sums[stop] - sums[start]) * forth[stop - 1] if len(start) else np.zeros(0, np.uint64)
        _, which, same = np.unique(key, return_index=True, return_inverse=True)
        like = start[which][same]
        if (size[which][same] != size).any() or (codes[stretches(like, size)] != codes).any():
            which = same = np.arange(len(start))  # two chunks with one hash: none are put together
        chosen = size[which]
        self.lattice = Lattice.of(pieces, codes[stretches(start[which], chosen)], np.repeat(np.cumsum(chosen), chosen) - np.arange(int(chosen.sum())))
        self.node = (np.cumsum(chosen) - chosen)[same]
        self.text = np.searchsorted(ends, start, side="right")
        self.chunks = np.bincount(self.text, minlength=len(texts))
        self.first_chunk = np.cumsum(self.chunks) - self.chunks

    def part(self, a: int, b: int) -> Batch:
        """Texts a .. b - 1 alone, with the same lattice."""
        out = Batch.__new__(Batch)
        chunks = slice(self.first_chunk[a], self.first_chunk[b - 1] + self.chunks[b - 1])
        out.lattice, out.node, out.text = self.lattice, self.node[chunks], self.text[chunks] - a
        out.chunks, out.first_chunk = self.chunks[a:b], self.first_chunk[a:b] - self.first_chunk[a]
        return out


@dataclass
class Paths:
    """A path of each text: edges, their chunks, and raw values of the sets that branch from them; texts without one have no edges.

    A set's Gumbel value below the path's value v is -log(exp(-v) + exp(-raw)), raw a Gumbel value of its mass: order and choice need only raw."""

    edge: np.ndarray
    chunk: np.ndarray
    size: np.ndarray
    since: np.ndarray
    barred: np.ndarray
    raw: np.ndarray
    log: np.ndarray
    value: np.ndarray

    def __post_init__(self):
        self.at = np.cumsum(self.size) - self.size

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the greatest value and its place."""
        raw, place = np.full(len(self.size), -np.inf), np.zeros(len(self.size), np.int64)
        own = np.flatnonzero(self.size)
        if len(own):
            raw[own] = np.maximum.reduceat(self.raw, self.at[own])
            at = np.flatnonzero(self.raw == np.repeat(raw, self.size))[::-1]
            text = np.searchsorted(self.at + self.size, at, side="right")
            place[text] = at - self.at[text]  # the last assignment is the first place
        with np.errstate(over="ignore"):
            return np.where(np.isfinite(raw), -np.logaddexp(-self.value, -raw), -np.inf), place


def _paths(lattice: Lattice, edge: np.ndarray, chunk: np.ndarray, size: np.ndarray, since: np.ndarray, barred: np.ndarray, value: np.ndarray, stream: np.ndarray) -> Paths:
    """Draws the values of the sets at each edge from `since` on."""
    at = np.cumsum(size) - size
    run = np.zeros(len(edge) + 1, np.int64)
    np.cumsum(lattice.fixed[edge], out=run[1:])
    later = np.maximum(size - since, 0)
    place = stretches(at + since, later)
    mass = (run[place] - np.repeat(run[at], later)) / _FIXED + lattice.other[edge[place]]
    # where a path branched, the edges that earlier paths took there are barred as well
    own = np.flatnonzero((later > 0) & (barred[:, 0] >= 0))
    if len(own):
        taken = edge[at[own] + since[own]]
        node, bars = lattice.node[taken], barred[own]
        rest = 1.0 - lattice.prob(taken) - np.where(bars >= 0, lattice.prob(bars), 0.0).sum(axis=1)
        width = lattice.first[node + 1] - lattice.first[node] - (bars >= 0).sum(axis=1)
        free = (width > 1) & (rest > 0)
        head = (np.cumsum(later) - later)[own]
        mass[head] = np.where(free, (run[at + since] - run[at])[own] / _FIXED + np.log(np.where(free, rest, 1.0)), -np.inf)
    raw = np.full(len(edge), -np.inf)
    u = uniform(np.repeat(stream - at.astype(np.uint64) * _PLACE, later) + place.astype(np.uint64) * _PLACE)
    raw[place] = mass - np.log(-np.log(u))
    return Paths(edge, chunk, size, since, barred, raw, (run[at + size] - run[at]) / _FIXED, value)


def sample(batch: Batch, seeds: np.ndarray, k: int) -> tuple[list[Paths], np.ndarray]:
    """Up to k distinct paths of each text, and each text's threshold (-inf where all paths were found)."""
    lattice, n = batch.lattice, len(seeds)
    number = (np.arange(len(batch.node)) - batch.first_chunk[batch.text]).astype(np.uint64)
    value = -np.log(-np.log(uniform(_stream(seeds, 0, 0))))
    edge, count = lattice.walk(batch.node, hashing.mixed(_stream(seeds, 1, 0)[batch.text] + number * _PLACE))
    size = np.bincount(batch.text, count, n).astype(np.int64)
    none = np.full((n, k), -1)
    found = [_paths(lattice, edge, np.repeat(np.arange(len(count), dtype=np.int32), count), size, np.zeros(n, np.int64), none, value, _stream(seeds, 1, 1))]
    while True:
        best = [x.best() for x in found]
        values = np.array([x for x, _ in best])
        branch = values.argmax(axis=0)
        top, place = values.max(axis=0), np.array([x for _, x in best])[branch, np.arange(n)]
        if len(found) == k or not np.isfinite(top).any():
            return found, top
        on = np.flatnonzero(np.isfinite(top))
        path = len(found) + 1
        # all paths one behind the other
        low = np.cumsum([0, *(len(x.edge) for x in found[:-1])])
        edges, chunks = np.concatenate([x.edge for x in found]), np.concatenate([x.chunk for x in found])
        start = low[branch[on]] + np.array([x.at for x in found])[branch[on], on]
        at = place[on]
        for b, x in enumerate(found):
            x.raw[(x.at[on] + at)[branch[on] == b]] = -np.inf
        left, own = edges[start + at], chunks[start + at]
        before = np.array([x.barred for x in found])[branch[on], on]
        before[np.array([x.since for x in found])[branch[on], on] != at] = -1
        before[np.arange(len(on)), (before >= 0).sum(axis=1)] = left
        barred = none.copy()
        barred[on] = before
        # another edge at that node
        node = lattice.node[left]
        choice = lattice.first[node][:, None] + np.arange(int((lattice.first[node + 1] - lattice.first[node]).max()))
        there = choice < lattice.first[node + 1][:, None]
        choice = np.where(there, choice, 0)
        for bar in before.T:
            there &= choice != bar[:, None]
        weight = np.cumsum(np.where(there, lattice.prob(choice), 0.0), axis=1)
        u = uniform(_stream(seeds[on], path, 0)) * weight[:, -1]
        taken = choice[np.arange(len(on)), np.argmax((weight > u[:, None]) & there, axis=1)]
        # from there to the chunk's end, then through the text's other chunks
        after, text_end = lattice.end[taken], batch.first_chunk[on] + batch.chunks[on]
        inner = after < lattice.n
        walks = np.where(inner, own, own + 1)
        todo = stretches(walks, text_end - walks)
        owner = np.repeat(np.arange(len(on)), text_end - walks)
        nodes = batch.node[todo]
        resumed = (np.cumsum(text_end - walks) - (text_end - walks))[inner]
        nodes[resumed] = after[inner]
        more, count = lattice.walk(nodes, hashing.mixed(_stream(seeds[on], path, 0)[owner] + number[todo] * _PLACE))
        more_size = np.bincount(owner, count, len(on)).astype(np.int64)
        size = np.zeros(n, np.int64)
        size[on] = at + 1 + more_size
        head = (np.cumsum(size) - size)[on]
        edge, chunk = np.empty(int(size.sum()), np.int32), np.empty(int(size.sum()), np.int32)
        old, to = stretches(start, at), stretches(head, at)
        edge[to], chunk[to] = edges[old], chunks[old]
        edge[head + at], chunk[head + at] = taken, own
        to = stretches(head + at + 1, more_size)
        edge[to], chunk[to] = more, np.repeat(todo, count)
        since, value = np.zeros(n, np.int64), np.full(n, -np.inf)
        since[on], value[on] = at, top[on]
        found.append(_paths(lattice, edge, chunk, size, since, barred, value, _stream(seeds, path, 1)))


SCHEMA = "doc_id long, rank int, log_prob double, perturbed double, inclusion double, ids array<int>"


def parts(sizes: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Texts in a row whose sizes add up to the limit, or just over it."""
    which = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), len(sizes)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


def segmentations(pieces: Pieces, keys: list, texts: list[str], k: int, seed: int) -> Iterator[pa.RecordBatch]:
    """A batch of rows for each rank and part."""
    whole = Batch(pieces, texts)
    for a, b in parts(np.array([len(x) for x in texts]), AT_ONCE):
        batch = whole.part(a, b)
        found, threshold = sample(batch, np.array([seed_of(x, seed) for x in keys[a:b]], np.uint64), k)
        column = pa.array(keys[a:b], pa.int64())
        for rank, paths in enumerate(found, 1):
            ids, n = pieces.ids(batch.lattice.code[paths.edge])
            run = np.zeros(len(n) + 1, np.int64)
            np.cumsum(n, out=run[1:])
            offsets = np.append(run[paths.at], run[-1])
            with np.errstate(over="ignore"):
                inclusion = np.where(np.isfinite(threshold), -np.expm1(-np.exp(np.minimum(paths.log - threshold, 700.0))), 1.0)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            out = pa.RecordBatch.from_arrays([column, pa.array(np.full(b - a, rank, np.int32)), pa.array(paths.log), pa.array(paths.value), pa.array(inclusion), lists], names=["doc_id", "rank", "log_prob", "perturbed", "inclusion", "ids"])
            there = np.isfinite(paths.value)
            yield out if there.all() else out.filter(pa.array(there))


def _sampled(model: str, k: int, theta: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = held(("pieces", model, theta), lambda: Pieces(model, theta))
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for a, b in parts(sizes, BATCH):
                rows = batch.slice(a, b - a)
                yield from segmentations(pieces, rows.column(0).to_pylist(), rows.column(1).to_pylist(), k, seed)

    return run


def sample_segmentations(df: DataFrame, model: str, k: int = 3, theta: float = 0.5, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rank, log_prob, perturbed, inclusion, ids): up to k distinct segmentations of each whole text."""
    return id_and_text(df, id_col, text_col).mapInArrow(_sampled(model, k, theta, seed), SCHEMA)


def _decoded(model: str, column: int, kept: list[int], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        for batch in batches:
            texts = [sp.decode(x) if x is not None else None for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], names=names)

    return run


def decode(df: DataFrame, model: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with the text of an array of piece ids, in place of a column of that name."""
    kept = [k for k, x in enumerate(df.columns) if x != out_col]
    schema = ", ".join(f"`{df.schema[k].name}` {df.schema[k].dataType.simpleString()}" for k in kept)
    return df.mapInArrow(_decoded(model, df.columns.index(ids_col), kept, [*(df.columns[k] for k in kept), out_col]), f"{schema}{', ' if kept else ''}`{out_col}` string")


def _encoded(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        for batch in batches:
            found = sp.encode(batch.column(1).to_pylist(), num_threads=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the model's own segmentation."""
    return id_and_text(df, id_col, text_col).mapInArrow(_encoded(model), "doc_id long, ids array<int>")


def digest(samples: DataFrame) -> DataFrame:
    """The same rows with a count and a hash for the ids."""
    return samples.select("doc_id", "rank", "log_prob", "perturbed", "inclusion", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_xxhash64"))
