"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, by count vectors in an R-tree.

The tree needs documents that may match close together. They get there by partition signatures: sets of similar size whose
symmetric difference is at most t agree wholly in one of t + 1 parts of the shingles' groups, so documents are dealt by the print of each part. Below PERCENT such parts are too small to tell documents
apart; there, documents are dealt by their rarest shingles. Documents of similar size that share a part or such a shingle, directly or through others, form a cell.
Fine count vectors of all documents, made in the same scan, split the cells into those whose documents may link; only the texts of these are read again. In a cell, an R-tree over count vectors bounds the overlap and the surviving pairs are verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockframe.llm.common import LOWER, UPPER, checkpointed, hand_back, handing_back, join_dealt, may_be_in, parts_for, shuffle_partitions, table, unused
from blockframe.llm.components import components
from blockframe.llm.poly import Prints, U, mix
from blockframe.llm.recompression import word_bounds
from blockframe.llm.segments import chunks

#: Words of a shingle; documents link when PERCENT of the union is shared.
SHINGLE, PERCENT = 3, 90
#: The same for the pipeline's stage.
STAGE_SHINGLE, STAGE_PERCENT = 5, 80
#: Shingles that are known to be in more than one document, at most; what is beyond costs time, not links.
MAX_COMMON = 1 << 22
#: Coordinates of a count vector; points of an R-tree leaf or node.
GROUPS, FANOUT = 64, 16
#: Documents of a cell that meet in one task. In larger cells all are first compared with the first one, and then those that don't link with it with all, block by block.
BLOCK = 512
#: Shingles for each coordinate of a fine count vector, at most, and least coordinates; such vectors that meet in one task.
PER_COORDINATE, LEAST_COORDINATES, VECTOR_BLOCK = 4, 16, 4096
FLUSH_SHINGLES = 1 << 22
#: Buckets for each shuffle partition, and bytes of the input for each bucket.
SPREAD, BUCKET_BYTES = 2, 64 << 20
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
BASE, SAME, PARTS, PAIRS = 0, 1, 2, 3
FOUND = "kind int, a long, b long, n long, data binary"


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Prints of each text's distinct shingles, ascending, one text after the other, and where each text's begin (one more entry at the end)."""
    flat = np.frombuffer(b"\n".join(t.translate(_LOWER) for t in texts), np.uint8)
    start, end = word_bounds(flat)
    words = Prints(flat).of(start, end)
    bounds = np.concatenate([[0], np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))])
    n = np.diff(bounds)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    own = np.repeat(np.arange(len(texts)), count)
    at = bounds[own] + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    prints = Prints(words).of(at, at + np.minimum(size, n[own]))
    order = np.lexsort((prints, own))
    prints, own = prints[order], own[order]
    fresh = np.ones(len(own), bool)
    fresh[1:] = (np.diff(own) != 0) | (prints[1:] != prints[:-1])
    return prints[fresh], np.concatenate([[0], np.cumsum(np.bincount(own[fresh], minlength=len(texts)))])


def linked(common: int, a: int, b: int, percent: int = PERCENT) -> bool:
    return 100 * common >= percent * (a + b - common)


@lru_cache(8)
def bands(percent: int, most: int) -> np.ndarray:
    """Least sizes of the size bands up to most, and two more: sets that link lie in one band or in neighbouring ones."""
    out = [1]
    while len(out) < 4 or out[-3] <= most:
        out.append(max(out[-1] + 1, -(-out[-1] * 100 // percent)))
    return np.array(out)


def _parts(level: np.ndarray, edges: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts for sets of bands level and level + 1, and how many of its smallest parts a set leaves out.

    Sets a, b link only if |a| + |b| - 2 |a and b| <= (|a| + |b|) (100 - p) / (100 + p) =: t. Of t + 1 + 2 e parts at least 1 + 2 e agree; each side leaves out e.
    """
    t = 2 * (edges[level + 2] - 1) * (100 - percent) // (100 + percent)
    spare = np.minimum(4, t // 8)
    return t + 1 + 2 * spare, spare


def signatures(prints: np.ndarray, bounds: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets, and whose each is. Sets that link share one at least."""
    n = np.diff(bounds)
    edges = bands(percent, int(n.max(initial=1)))
    band = np.searchsorted(edges, np.maximum(n, 1), side="right") - 1
    sums = np.concatenate([[U(0)], np.cumsum(mix(prints))])
    out, whose = [], []
    for shift in (0, 1):
        sets = np.flatnonzero((n > 0) & (band >= shift))
        if not len(sets):
            continue
        level = band[sets] - shift
        parts, spare = _parts(level, edges, percent)
        first = np.concatenate([[0], np.cumsum(parts)])
        size = n[sets]
        own = np.repeat(np.arange(len(sets)), size)
        at = np.repeat(bounds[:-1][sets], size) + np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
        part = first[own] + ((prints[at] >> U(32)) * parts[own].astype(U) >> U(32)).astype(np.int64)
        count = np.bincount(part, minlength=first[-1])
        of = np.repeat(np.arange(len(sets)), parts)
        stop = np.cumsum(count) - np.repeat(np.cumsum(size) - size, parts) + bounds[:-1][sets][of]
        number = np.arange(first[-1]) - first[of]
        order = np.lexsort((number, count, of))  # a set's smallest parts first
        rank = np.empty(len(order), np.int64)
        rank[order] = number
        keep = rank >= spare[of]
        content = sums[stop] - sums[stop - count]
        sign = mix(content + mix((level[of] << 40 | number << 16 | np.minimum(count, 65535)).astype(U)))
        empty = keep & (count == 0) & (parts[of] > 1)
        keep &= ~empty
        out.append(sign[keep])
        whose.append(sets[of[keep]])
        # an empty part says nothing of a set: in its place come the parts of a second division, of which one at least agrees again
        for s, k in zip(of[empty].tolist(), number[empty].tolist(), strict=True):
            own, n_parts = prints[bounds[sets[s]] : bounds[sets[s] + 1]], int(parts[s])
            where = ((mix(own) >> U(32)) * U(n_parts) >> U(32)).astype(np.int64)
            total, held = np.zeros(n_parts, U), np.bincount(where, minlength=n_parts)
            np.add.at(total, where, mix(own))
            label = (int(level[s]) << 40 | k << 28 | 1 << 27) + np.arange(n_parts)
            out.append(mix(total + mix(mix(label.astype(U)) + held.astype(U))))
            whose.append(np.full(n_parts, sets[s]))
    return (np.concatenate(out), np.concatenate(whose)) if out else (np.zeros(0, U), np.zeros(0, np.int64))


def _short(prints: np.ndarray) -> np.ndarray:
    return (mix(prints) >> U(32)).astype(np.uint32)


def rarest(prints: np.ndarray, bounds: np.ndarray, percent: int, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets, and whose each is: a set's first shingles in one order of all shingles, those that common (short prints, ascending, and how often) counts least first.

    Sets of a and b that link share p max(a, b) / 100 at least, so the first shared shingle is among the first n - ceil(p n / 100) + 1 of both.
    """
    n = np.diff(bounds)
    own = np.repeat(np.arange(len(n)), n)
    known, often = common
    freq = np.zeros(len(prints), np.int64)
    if len(known):
        short = _short(prints)
        at = np.minimum(np.searchsorted(known, short), len(known) - 1)
        freq = np.where(known[at] == short, often[at], 0)
    order = np.lexsort((mix(prints), freq, own))
    rank = np.arange(len(prints)) - np.repeat(bounds[:-1], n)
    keep = rank < (n * (100 - percent) // 100 + 1)[own]
    return prints[order[keep]], own[keep]


class CountTree:
    """An R-tree over count vectors: leaves of FANOUT points packed in the order of set size and heaviest coordinate, nodes with the largest count of each coordinate and the range of sizes."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((vectors.argmax(axis=1), sizes))
        top, low, high = vectors[self.order], sizes[self.order], sizes[self.order]
        self.levels = [(top, low, high)]
        while len(top) > FANOUT:
            edge = np.arange(0, len(top), FANOUT)
            top, low, high = np.maximum.reduceat(top, edge), np.minimum.reduceat(low, edge), np.maximum.reduceat(high, edge)
            self.levels.append((top, low, high))

    def search(self, vector: np.ndarray, size: int, percent: int = PERCENT) -> np.ndarray:
        """Points whose overlap with the query, at most the sum of the smaller counts, may suffice: overlap >= p (a + b) / (100 + p)."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in reversed(range(len(self.levels))):
            top, low, high = (x[at] for x in self.levels[depth])
            bound = np.minimum(top, vector).sum(axis=1)
            fits = ((100 + percent) * bound >= percent * (size + low)) & (100 * high >= percent * size) & (percent * low <= 100 * size)
            at = at[fits]
            if depth:
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).reshape(-1)
                at = at[at < len(self.levels[depth - 1][0])]
        return self.order[at]


def count_vectors(sets: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.bincount((s >> U(58)).astype(np.int64), minlength=GROUPS) for s in sets]) if sets else np.zeros((0, GROUPS), np.int64)


def verify(docs: list[int], sets: list[np.ndarray], sides: list[bool] | None = None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect all documents that links connect; pairs known to be connected are not verified again. sides: only pairs across are looked at."""
    vectors, sizes = count_vectors(sets), np.array([len(s) for s in sets])
    tree, root, out = CountTree(vectors, sizes), list(range(len(docs))), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in sorted(tree.search(vectors[i], int(sizes[i]), percent).tolist()):
            if j >= i:
                break
            if (sides is None or sides[i] != sides[j]) and (a := find(i)) != (b := find(j)):
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if linked(common, len(sets[i]), len(sets[j]), percent):
                    root[max(a, b)] = min(a, b)
                    out.append((docs[j], docs[i]))
    return out


def stars(sign: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """Runs of a signature: documents, each standing for set sizes from low to high, in which no size is too small to link with the next. Of each run: signature, smallest document, least and largest size; and distinct pairs (that document, another of the run)."""
    order = np.lexsort((doc, low, sign))
    sign, doc, low, high = sign[order], doc[order], low[order], high[order]
    fresh = np.ones(len(sign), bool)
    if len(sign):
        fresh[1:] = sign[1:] != sign[:-1]
        base = np.cumsum(fresh) << 32
        reach = np.maximum.accumulate(high + base) - base  # largest size so far of the signature
        fresh[1:] |= 100 * reach[:-1] < percent * low[1:]
    first = np.flatnonzero(fresh)
    if not len(first):
        return sign, doc, low, high, np.zeros((0, 2), np.int64)
    least = np.minimum.reduceat(doc, first)
    star = np.repeat(least, np.diff(np.append(first, len(sign))))
    other = doc != star
    pairs = np.unique(np.stack([star[other], doc[other]], 1), axis=0) if other.any() else np.zeros((0, 2), np.int64)
    return sign[first], least, low[first], np.maximum.reduceat(high, first), pairs


def coordinates(n: np.ndarray) -> np.ndarray:
    """Coordinates of the fine vectors of sets of n, as powers of two."""
    return np.ceil(np.log2(np.maximum(-(-n // PER_COORDINATE), LEAST_COORDINATES))).astype(np.int64)


def fine_vectors(prints: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Each set's count vector, coordinates by the highest bits: of bytes, or where a count is larger of 32-bit integers."""
    n = np.diff(bounds)
    power = coordinates(n)
    edge = np.concatenate([[0], np.cumsum(1 << power)])
    own = np.repeat(np.arange(len(n)), n)
    count = np.bincount(edge[own] + (prints >> (64 - power[own]).astype(U)).astype(np.int64), minlength=edge[-1])
    small, wide = count.astype(np.uint8).tobytes(), np.maximum.reduceat(count, edge[:-1]) > 255 if len(n) else []
    return [count[a:b].astype("<u4").tobytes() if w else small[a:b] for a, b, w in zip(edge[:-1].tolist(), edge[1:].tolist(), wide, strict=True)]


def may_link(sizes: np.ndarray, vectors: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Pairs of sets that connect all that pairs connect whose overlap, at most the sum of the smaller counts, may suffice."""
    power = coordinates(sizes)
    order = np.argsort(sizes, kind="stable")
    label, out = np.arange(len(sizes)), []
    for p in np.unique(power).tolist():
        asks = order[power[order] == p]
        pool = order[(power[order] >= p) & (sizes[order] >= sizes[asks[0]]) & (percent * sizes[order] <= 100 * sizes[asks[-1]])]
        table_ = np.stack([np.frombuffer(v, np.uint8 if len(v) == 1 << w else "<u4").astype(np.int32).reshape(1 << p, -1).sum(axis=1) for v, w in ((vectors[i], power[i]) for i in pool.tolist())])
        held = sizes[pool]
        for at, i in enumerate(asks.tolist()):  # the pool begins with those that ask
            stop = int(np.searchsorted(held, 100 * sizes[i] // percent, side="right"))
            rest = np.arange(at + 1, stop)
            rest = rest[label[pool[rest]] != label[i]]
            if not len(rest):
                continue
            bound = np.minimum(table_[rest], table_[at]).sum(axis=1)
            for j in pool[rest[(100 + percent) * bound >= percent * (sizes[i] + held[rest])]].tolist():
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    out.append((i, j))
    return out


def _found(kind: int, a, b, n, data=None) -> pa.RecordBatch:
    data = pa.nulls(len(n), pa.binary()) if data is None else data
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64()), data], ["kind", "a", "b", "n", "data"])


def _pack(*arrays: np.ndarray, more: bytes = b"") -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.int64(len(arrays[0])).tobytes() + b"".join(a.tobytes() for a in arrays) + more)


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    """The arrays, and the bytes after them."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = int(np.frombuffer(raw, "<i8", 1)[0]), 8, []
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return [*out, np.frombuffer(raw, np.uint8, offset=at)]


def common_shingles(rows: DataFrame, size: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Short prints of shingles that come more than once in column text, ascending, and how often (as a power of two). Each bucket names its most frequent ones, MAX_COMMON in all at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, n = [], 0

        def flush() -> pa.RecordBatch:
            short, times = np.unique(np.concatenate(values), return_counts=True)
            where = (short.astype(np.int64) * buckets) >> 32
            edge = np.flatnonzero(np.diff(where, prepend=-1))
            out = [_pack(np.diff(short[a:b].astype("<i8"), prepend=0).astype("<u4"), times[a:b].astype("<u4")) for a, b in zip(edge, np.append(edge[1:], len(where)), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(where[edge], pa.int32()), pa.array(out, pa.binary())], ["bucket", "data"])

        for batch in batches:
            texts = [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]
            for a, b in chunks(texts):
                values.append(_short(shingle_sets(texts[a:b], size)[0]))
                n += len(values[-1])
                if n >= FLUSH_SHINGLES:
                    yield flush()
                    values, n = [], 0
        if n:
            yield flush()

    def name(group: pa.Table) -> pa.Table:
        parts = [_unpack(x, "<u4", "<u4") for x in group["data"].to_pylist()]
        short, times = np.concatenate([np.cumsum(s, dtype=np.int64) for s, _, _ in parts]), np.concatenate([t for _, t, _ in parts])
        order = np.argsort(short, kind="stable")
        short, times = short[order], times[order]
        first = np.flatnonzero(np.diff(short, prepend=-1))
        short, times = short[first], np.add.reduceat(times.astype(np.int64), first)
        top = np.flatnonzero(times > 1)
        top = top[np.argsort(-times[top], kind="stable")][: MAX_COMMON // buckets]
        hand_back()
        return pa.table([pa.array([_pack(short[top].astype("<u4"), np.log2(times[top]).astype("u1"))], pa.binary())], names=["data"])

    found = rows.select("text").mapInArrow(handing_back(count), "bucket int, data binary").groupBy("bucket").applyInArrow(name, "data binary")
    parts = [_unpack(r.data, "<u4", "u1") for r in found.collect()]
    short = np.concatenate([s for s, _, _ in parts]) if parts else np.zeros(0, np.uint32)
    order = np.argsort(short)
    return short[order], (np.concatenate([f for _, f, _ in parts])[order] + 1 if parts else np.zeros(0, np.uint8))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """One row per input row: id, n_shingles (size of its set), component_id (smallest id reachable by links, its own included).

    Texts are lower-cased (A-Z) and cut in words; the set holds the distinct runs of `size` words, or the whole sequence if it is shorter. Null and
    wordless texts have empty sets and no links. Rows that share an id are one document for linking, each with its own n_shingles; null ids
    have component_id null. Other columns are ignored. Every link between different sets is found; equal sets of one task are collapsed first.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    buckets = parts_for(rows, BUCKET_BYTES, SPREAD * shuffle_partitions(spark))
    common = None if percent >= PERCENT else spark.sparkContext.broadcast(common_shingles(rows, size, buckets))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}
        signs, whose, held_by, base, same, n = [], [], [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            out = [(int(same[0][0]) % buckets if same else 0, SAME, _pack(*np.array(same, "<i8").T.copy()))] if same else []
            for ids, null, held, vectors in base:
                length = np.array([len(v) for v in vectors], "<i4")
                out.append((int(np.abs(ids[0])) % buckets, BASE, _pack(ids.astype("<i8"), held.astype("<i8"), null.astype("u1"), length, more=b"".join(vectors))))
            if signs:
                size_ = np.concatenate(held_by)
                sign, doc, low, high, pairs = stars(np.concatenate(signs), np.concatenate(whose), size_, size_, percent)
                if len(pairs):  # this task's documents of one run of sizes of a signature: the first stands for them
                    out.append((int(np.abs(pairs[0, 0])) % buckets, PAIRS, _pack(*pairs.T.copy())))
                where = (sign % U(buckets)).astype(np.int64)
                order = np.lexsort((doc, where))
                sign, doc, low, high, where = sign[order], doc[order], low[order], high[order], where[order]
                edge = np.flatnonzero(np.diff(where, prepend=-1))
                for a, b in zip(edge, np.append(edge[1:], len(where)) if len(edge) else edge, strict=True):
                    out.append((int(where[a]), PARTS, _pack(sign[a:b].astype("<u8"), np.diff(doc[a:b], prepend=0).astype("<i8"), low[a:b].astype("<u4"), (high[a:b] - low[a:b]).astype("<u4"))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())], ["bucket", "kind", "data"])

        for batch in batches:
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for a, b in chunks(texts):
                prints, bounds = shingle_sets(texts[a:b], size)
                held = np.diff(bounds)
                sums = [np.concatenate([[U(0)], np.cumsum(mix(prints + U(salt)))]) for salt in (1, 2)]
                keys = zip(held.tolist(), *((s[bounds[1:]] - s[bounds[:-1]]).tolist() for s in sums), strict=True)
                fresh = np.zeros(b - a, bool)
                for i, (key, doc, gone) in enumerate(zip(keys, ids[a:b].tolist(), null[a:b].tolist(), strict=True)):
                    if key[0] and not gone:
                        first = seen.setdefault(key, doc)
                        if first != doc:
                            same.append((first, doc))
                        fresh[i] = first == doc
                part = np.repeat(fresh, held)
                kept = np.flatnonzero(fresh)
                edges = np.concatenate([[0], np.cumsum(held[kept])])
                vectors = [b""] * (b - a)
                for i, v in zip(kept.tolist(), fine_vectors(prints[part], edges), strict=True):
                    vectors[i] = v
                base.append((ids[a:b], null[a:b], held, vectors))
                sign, own = rarest(prints[part], edges, percent, common.value) if common else signatures(prints[part], edges, percent)
                signs.append(sign)
                whose.append(ids[a:b][kept][own])
                held_by.append(held[kept][own])
                n += len(sign)
                if n >= FLUSH_SHINGLES:
                    yield from flush()
                    signs, whose, held_by, base, same, n, seen = [], [], [], [], [], 0, {}
        if base:
            yield from flush()

    def meet(group: pa.Table) -> pa.Table:
        out, signs, docs_, lows, highs = [], [], [], [], []
        for kind, data in zip(group["kind"].to_pylist(), group["data"].to_pylist(), strict=True):
            if kind == BASE:
                ids, held, null, length, flat = _unpack(data, "<i8", "<i8", "u1", "<i4")
                edges = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                vectors = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(flat.tobytes())])
                out.append(_found(BASE, pa.array(ids, mask=null.astype(bool)), np.zeros(len(ids), np.int64), held, vectors))
            elif kind in (SAME, PAIRS):
                a, b, _ = _unpack(data, "<i8", "<i8")
                out.append(_found(SAME if kind == SAME else PARTS, a, b, np.zeros(len(a), np.int64)))
            else:
                sign, doc, low, more, _ = _unpack(data, "<u8", "<i8", "<u4", "<u4")
                signs.append(sign)
                docs_.append(np.cumsum(doc))
                lows.append(low.astype(np.int64))
                highs.append(lows[-1] + more)
        if signs:
            *_, pairs = stars(np.concatenate(signs), np.concatenate(docs_), np.concatenate(lows), np.concatenate(highs), percent)
            out.append(_found(PARTS, pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.int64)))
        hand_back()
        return pa.Table.from_batches(out)

    found = checkpointed(rows.mapInArrow(handing_back(scan), "bucket int, kind int, data binary").groupBy("bucket").applyInArrow(meet, FOUND))

    def narrow(group: pa.Table) -> pa.Table:
        """Pairs of each task's documents that may link by their fine vectors."""
        tasks, out = {}, []
        for row in zip(*(group[c].to_pylist() for c in ("component", "band", "low", "high", "node", "size", "data")), strict=True):
            tasks.setdefault(row[:4], []).append(row[4:])
        for own in tasks.values():
            ids, held, vectors = zip(*sorted(own), strict=True)
            out += [(ids[i], ids[j]) for i, j in may_link(np.array(held, np.int64), list(vectors), percent)]
        hand_back()
        return pa.table([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    def narrowed(cells: DataFrame) -> DataFrame:
        """The parts of cells (node, component, n) that fine vectors leave. Large cells are dealt by bands of set sizes, two neighbouring ones a task, and these block by block."""
        vectors = found.where((F.col("kind") == BASE) & (F.octet_length("data") > 0)).select(F.col("a").alias("node"), F.col("n").alias("size"), "data")
        members = checkpointed(vectors.join(cells.hint("merge"), "node"))
        zero, large = F.lit(0), members.where(F.col("n") > VECTOR_BLOCK)
        task = ["component", "band", "low", "high", "node", "size", "data"]
        tasks = members.where(F.col("n") <= VECTOR_BLOCK).select("component", zero.alias("band"), zero.alias("low"), zero.alias("high"), "node", "size", "data")
        if cells.where(F.col("n") > VECTOR_BLOCK).limit(1).count():
            band = F.floor(F.log("size") / np.log(100.1 / percent)).cast("int")  # a little wider than what links, for the logarithm's sake
            large = checkpointed(large.select("component", "node", "size", "data", F.explode(F.array(band, band - 1)).alias("band")))
            counts = checkpointed(large.groupBy("component", "band").agg(F.count("*").alias("n")))
            blocks = F.ceil(F.col("n") / VECTOR_BLOCK).cast("int")
            dealt = join_dealt(large, counts, ["component", "band"], large.count()).withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(zero, blocks - 1)))
            tasks = tasks.unionByName(dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).select(*task))
        dealt = tasks.withColumn("bucket", F.pmod(F.xxhash64("component", "band", "low", "high"), F.lit(2 * buckets)).cast("int"))
        return components(checkpointed(dealt.groupBy("bucket").applyInArrow(narrow, "a long, b long")))  # else each task has two Python workers, which stay

    cells = narrowed(components(found.where(F.col("kind") == PARTS).select("a", "b")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for a, b in chunks(texts):
                prints, bounds = shingle_sets(texts[a:b], size)
                data = prints.astype("<u8").tobytes()
                blobs = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((bounds * 8).astype(np.int32).tobytes()), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in (0, 2, 3)), blobs], ["doc", "component", "n", "data"])

    def check(group: pa.Table) -> pa.Table:
        """Links within each task's documents, or where they have sides, across these."""
        cell = {}
        for row in zip(*(group[c].to_pylist() for c in ("component", "low", "high", "side", "doc", "data")), strict=True):
            cell.setdefault(row[:3], []).append(row[3:])
        out = []
        for own in cell.values():
            own.sort(key=lambda x: (x[1], x[0] or False))
            out += verify([d for _, d, _ in own], [np.frombuffer(x, "<u8") for _, _, x in own], None if own[0][0] is None else [s for s, _, _ in own], percent)
        hand_back()
        return pa.table([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    def checked(tasks: DataFrame) -> DataFrame:
        """tasks: component, low, high (these three name a task), side, doc, data."""
        return tasks.withColumn("bucket", F.pmod(F.xxhash64("component", "low", "high"), F.lit(2 * buckets)).cast("int")).groupBy("bucket").applyInArrow(check, "a long, b long")

    def block(blocks: Column) -> Column:
        return F.pmod(F.xxhash64("doc"), blocks).cast("int")

    def in_blocks(n: Column) -> Column:
        return F.ceil(n / BLOCK).cast("int")

    zero, texts = F.lit(0), may_be_in(rows, "doc", cells.select("node"))[0].join(cells.hint("merge"), F.col("doc") == F.col("node")).select("doc", "text", "component", "n")
    made = checkpointed(texts.mapInArrow(handing_back(sets), "doc long, component long, n long, data binary"))
    links = checked(made.where(F.col("n") <= BLOCK).select("component", zero.alias("low"), zero.alias("high"), F.lit(None).cast("boolean").alias("side"), "doc", "data"))
    if cells.where(F.col("n") > BLOCK).limit(1).count():
        total, sizes = cells.count(), cells.where("node = component").select("component", "n")  # a cell is named by its smallest document
        large = made.where(F.col("n") > BLOCK)
        blocks = in_blocks(F.col("n"))
        first = large.where("doc = component")
        with_first = first.withColumn("low", F.explode(F.sequence(zero, blocks - 1))).withColumn("side", F.lit(True)).unionByName(large.where("doc <> component").withColumn("low", block(blocks)).withColumn("side", F.lit(False)))
        near_first = checkpointed(checked(with_first.select("component", "low", F.lit(-1).alias("high"), "side", "doc", "data")))
        open_ = checkpointed(large.where("doc <> component").join(near_first.select(F.greatest("a", "b").alias("linked")).distinct(), F.col("doc") == F.col("linked"), "left_anti"))
        left = open_.groupBy("component").agg(F.count("*").alias("m"))
        if left.limit(1).count():
            left = checkpointed(left.join(sizes, "component"))
            ours = join_dealt(open_.drop("n"), left, ["component"], total).withColumn("low", block(in_blocks(F.col("m")))).withColumn("high", F.explode(F.sequence(zero, blocks - 1))).withColumn("side", F.lit(True))
            theirs = join_dealt(large.drop("n"), left, ["component"], total).withColumn("high", block(blocks)).withColumn("low", F.explode(F.sequence(zero, in_blocks(F.col("m")) - 1))).withColumn("side", F.lit(False))
            task = ["component", "low", "high", "side", "doc", "data"]
            near_first = near_first.unionByName(checked(ours.select(*task).unionByName(theirs.select(*task))))
        links = links.unionByName(near_first)
    groups = components(checkpointed(links).unionByName(found.where(F.col("kind") == SAME).select("a", "b")))
    base = found.where(F.col("kind") == BASE).select(F.col("a").alias("id"), F.col("n").alias("n_shingles"))
    return base.join(groups, F.col("id") == F.col("node"), "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


ORACLE_SQL: dict[str, str] = {}


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """Of each group of linked documents the one with the smallest id; documents without links and rows with a null id stay. All columns kept."""
    name = unused(docs, "_lost_id")
    lost = checkpointed(near_duplicates(docs, percent=percent, size=size).where("id <> component_id").select(F.col("id").alias(name)).distinct())
    some, others = may_be_in(docs, "doc_id", lost)
    return others.unionByName(some.join(lost.hint("merge"), F.col("doc_id") == F.col(name), "left_anti"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one_of_each() of documents that share 80 percent of their runs of five words."""
    return one_of_each(spark, docs, sf_dir, STAGE_PERCENT, STAGE_SHINGLE)
