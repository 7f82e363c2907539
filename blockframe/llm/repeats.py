"""Windows of a fixed number of units (words or bytes) that also occur elsewhere, in two rounds of shuffled fingerprints.

1. A scan gives each window an anchor and a name that depend on the window's content alone. Windows in a row with one anchor make an item: name,
   fingerprint of all its content, place. Equal items of one task meet there; what is left is dealt by name.
2. Where a name has items, equal ones settle each other. Only if a name has different items do their documents
   get requests, join their text again and send more: fingerprints of single windows, or the bytes around the anchor.
3. What matched, as spans of units, is gathered by document.

Items are equal if their names and prints are (see poly: 62 bits that settle), and contexts if their bytes are. No text but that around unsettled anchors is
shuffled for matching; documents are dealt by id once, for the join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockframe.llm.common import checkpointed, parts_for, shuffle_partitions
from blockframe.llm.poly import Prints, U, mix
from blockframe.llm.segments import chunks

#: Items that a task gathers before it settles equal ones and sends the rest.
FLUSH = 1 << 20
#: Different items of a name beyond which windows are compared one by one, dealt by their own fingerprints.
WIDE = 20_000
#: Buckets for each shuffle partition, and bytes of the input for each bucket: there are as many buckets as either asks for.
SPREAD, BUCKET_BYTES = 2, 64 << 20
COLUMNS = {"name": "<u8", "print": "<u8", "doc": "<i8", "key": "<i8", "start": "<i4", "before": "<u2", "count": "<u2", "many": "<u1"}
#: Different items of a name beyond which a task no longer sends them all to the name's bucket: one goes, with a mark, and all are compared window by window.
HOT = 64
ITEMS, SPANS, CONTEXTS, REQUESTS = 0, 1, 2, 3
#: Bits of many: the item has an equal one, its name has too many different ones.
MATCHED, MARKED = 1, 2
DEALT = "bucket int, kind int, data binary"
FOUND = "kind int, doc long, key long, start int, stop int, name long, before int, done boolean, wide boolean"


def dump(items: dict[str, np.ndarray], more: bytes = b"") -> bytes:
    """Columns one after the other; doc and start as differences."""
    n = len(items["name"])
    parts = [np.int64(n).tobytes()]
    for name, kind in COLUMNS.items():
        values = items[name]
        parts.append((np.diff(values, prepend=values.dtype.type(0)) if name == "doc" else values).astype(kind).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts) + more)


def load(data: bytes) -> tuple[dict[str, np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = int(np.frombuffer(raw, "<i8", 1)[0]), 8, {}
    for name, kind in COLUMNS.items():
        out[name] = np.frombuffer(raw, kind, n, at)
        at += out[name].nbytes
    out["doc"] = np.cumsum(out["doc"])
    return out, raw[at:]


def _join(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {c: np.concatenate([p[c] for p in parts]) for c in COLUMNS} if parts else {c: np.zeros(0, k) for c, k in COLUMNS.items()}


def _take(items: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    return {c: v[at] for c, v in items.items()}


def _dealt(items: dict[str, np.ndarray], by: np.ndarray, buckets: int, kind: int) -> Iterator[pa.RecordBatch]:
    where = (by % U(buckets)).astype(np.int64)
    order = np.lexsort((items["start"], items["key"], items["doc"], where))
    items, where = _take(items, order), where[order]
    edges = np.flatnonzero(np.diff(where, prepend=-1))
    if not len(edges):
        return
    rows = [(int(where[a]), dump(_take(items, slice(a, b)))) for a, b in zip(edges, np.append(edges[1:], len(where)), strict=True)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([kind] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "kind", "data"])


def _classes(items: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """items sorted by name, then content, then place, each place once; where a class (equal content) begins, and where a name does."""
    order = np.lexsort((items["start"], items["key"], items["doc"], items["count"], items["before"], items["print"], items["name"]))
    items = _take(items, order)
    new = {c: np.diff(items[c], prepend=items[c][:1]) != 0 for c in ("name", "print", "before", "count", "doc", "key", "start")}
    name = new["name"]
    if len(name):
        name[0] = True
    cls = name | new["print"] | new["before"] | new["count"]
    once = cls | new["doc"] | new["key"] | new["start"]
    if not once.all():
        many = items["many"].copy()  # a place that comes twice may have been settled in only one of its tasks
        group = np.cumsum(once) - 1
        np.bitwise_or.at(merged := np.zeros(group[-1] + 1, many.dtype), group, many)
        items, name, cls = _take(items, once), name[once], cls[once]
        items["many"] = merged
    return items, cls, name


def settle(items: dict[str, np.ndarray], earlier: bool, size: int) -> tuple[dict[str, np.ndarray], np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """Settles equal items. Returns items that are matched, their stops, the first item of each class (in many, MATCHED: there are others), and where a name begins among these.

    earlier: an item is matched if its class has an earlier one; else if its class has any other.
    """
    items, cls, name = _classes(items)
    group = np.cumsum(cls) - 1
    n = np.bincount(group, minlength=int(cls.sum()))
    many = np.zeros(len(n), np.uint8)
    np.bitwise_or.at(many, group, items["many"])
    many[n > 1] |= MATCHED
    hit = ~cls if earlier else many[group] & MATCHED > 0
    matched = _take(items, hit)
    first = _take(items, cls)
    first["many"] = many
    return matched, matched["start"] + matched["count"].astype(np.int64) - 1 + size, first, name[cls]


def _spans(found: dict[str, np.ndarray], stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """doc, key, start, stop with overlapping and touching spans of a document joined."""
    order = np.lexsort((found["start"], found["key"], found["doc"]))
    doc, key, start, stop = (x[order] for x in (found["doc"], found["key"], found["start"].astype(np.int64), stop.astype(np.int64)))
    if not len(doc):
        return doc, key, start, stop
    other = (np.diff(doc, prepend=doc[0] - 1) != 0) | (np.diff(key, prepend=key[0]) != 0)
    group = np.cumsum(other)
    lift = np.int64(1) << 33
    reach = np.maximum.accumulate(stop + group * lift) - group * lift
    fresh = other.copy()
    fresh[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    return doc[first], key[first], start[first], reach[np.append(first[1:], len(doc)) - 1]


def _dealt_spans(matched: dict[str, np.ndarray], stop: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    if len(stop):
        doc, key, start, stop = _spans(matched, stop)
        zero = np.zeros(len(doc), np.int64)
        spans = {"name": stop.astype(np.uint64), "print": zero, "doc": doc, "key": key, "start": start, "before": zero, "count": zero, "many": zero}
        yield from _dealt(spans, doc.view(np.uint64), buckets, SPANS)


def _asked(req: dict[str, np.ndarray], size: int, wide: np.ndarray) -> pa.RecordBatch:
    return _found(ITEMS, req["doc"], req["key"], req["start"], req["start"] + req["count"].astype(np.int64) - 1 + size, req["name"], req["before"], req["many"] & MATCHED, wide)


def _found(kind: int, doc, key, start, stop, name=None, before=None, done=None, wide=None) -> pa.RecordBatch:
    n = len(doc)
    zero = np.zeros(n, np.int64)
    columns = [np.full(n, kind, np.int32), doc.astype(np.int64), key.astype(np.int64), start.astype(np.int32), stop.astype(np.int32), (zero if name is None else name.astype(np.uint64).view(np.int64)), (zero if before is None else before).astype(np.int32), (zero if done is None else done).astype(bool), (zero if wide is None else wide).astype(bool)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in FOUND.split(", ")])


class Units:
    """What a chunk of documents consists of. Subclasses set: size (units of a window), values (for fingerprints), bounds (first unit of each document, one more at the end)."""

    size: int
    values: np.ndarray
    bounds: np.ndarray
    earlier: bool

    def __init__(self, texts: list[bytes]):
        raise NotImplementedError

    def anchors(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def content(self, start: int, stop: int) -> bytes:
        raise NotImplementedError

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def items(self, ids: np.ndarray, keys: np.ndarray) -> dict[str, np.ndarray]:
        if self.bounds[-1] < self.size:
            return _join([])
        doc = self.doc
        starts = np.flatnonzero(np.arange(len(doc)) + self.size <= self.bounds[1:][doc])
        if not len(starts):
            return _join([])
        anchor, name = self.anchors(starts)
        edge = (np.diff(anchor, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1) | (np.diff(name, prepend=name[:1]) != 0)
        first = np.flatnonzero(edge)
        count = np.diff(np.append(first, len(starts)))
        start = starts[first]
        own = doc[start]
        return {
            "name": name[first], "print": Prints(self.values).of(start, start + count - 1 + self.size), "doc": ids[own], "key": keys[own], "start": start - self.bounds[own],
            "before": anchor[first] - start, "count": count, "many": np.zeros(len(first), np.uint8),
        }


def find_spans(docs: DataFrame, make: type[Units], near: Callable | None = None) -> DataFrame:
    """docs: columns doc (long), key (long; tells rows of one doc with different texts apart), text. Returns doc, key, spans (array of start, stop in units).

    Identical rows count as one document. near: settles names by the bytes around their anchors (see suffix_sort.near); without it windows are compared one by one.
    """
    spark = docs.sparkSession
    buckets = parts_for(docs, BUCKET_BYTES, SPREAD * shuffle_partitions(spark))
    docs = docs.where(F.col("doc").isNotNull() & F.col("text").isNotNull())
    size, earlier = make.size, make.earlier

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            matched, stop, first, lead = settle(_join(parts), earlier, size)
            group = np.cumsum(lead) - 1
            hot = (np.bincount(group) > HOT)[group] if len(group) else lead
            first["many"][hot & lead] |= MARKED
            rest = _take(first, hot & ~lead)
            first = _take(first, ~hot | lead)
            yield from _dealt(first, first["name"], buckets, ITEMS)
            yield from _dealt(rest, rest["doc"].view(np.uint64), buckets, REQUESTS)
            yield from _dealt_spans(matched, stop, buckets)

        for batch in batches:
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for a, b in chunks(texts):
                parts.append(make(texts[a:b]).items(ids[a:b], keys[a:b]))
                n += len(parts[-1]["name"])
                if n >= FLUSH:
                    yield from flush()
                    parts, n = [], 0
        if n:
            yield from flush()

    def names(ask: bool):
        def run(table: pa.Table) -> pa.Table:
            out, parts = [], []
            for kind, data in zip(table["kind"].to_pylist(), table["data"].to_pylist(), strict=True):
                items, _ = load(data)
                if kind == SPANS:
                    out.append(_found(SPANS, items["doc"], items["key"], items["start"], items["name"].astype(np.int64)))
                elif kind == REQUESTS:
                    out.append(_asked(items, size, np.ones(len(items["name"]), bool)))
                else:
                    parts.append(items)
            if parts:
                matched, stop, first, name = settle(_join(parts), earlier, size)
                out.append(_found(SPANS, *_spans(matched, stop)))
                if ask:
                    group = np.cumsum(name) - 1
                    classes = np.bincount(group)
                    open_ = classes > 1
                    if not earlier:
                        open_ &= np.bincount(group, first["many"] & MATCHED == 0) > 0
                    marked = np.bincount(group, first["many"] & MARKED) > 0
                    some = (open_ | marked)[group]
                    out.append(_asked(_take(first, some), size, ((classes > WIDE) | marked)[group][some] | (near is None)))
            return pa.Table.from_batches(out) if out else pa.Table.from_batches([_found(SPANS, *[np.zeros(0, np.int64)] * 4)])

        return run

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            matched, stop, first, _ = settle(_join(parts), earlier, size)
            yield from _dealt(first, first["print"], buckets, ITEMS)
            yield from _dealt_spans(matched, stop, buckets)

        for batch in batches:
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            lists = batch.column(3)
            offsets, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
            fields = {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}
            for a, b in chunks(texts):
                units = make(texts[a:b])
                low, high = offsets[a], offsets[b]
                part = {c: v[low:high] for c, v in fields.items()}
                own = np.repeat(np.arange(a, b), np.diff(offsets[a : b + 1]))
                base = units.bounds[own - a]
                if near is not None:
                    yield from contexts(units, part, ids[own], keys[own], base)
                parts.append(windows(units, part, ids[own], keys[own], base))
                n += len(parts[-1]["name"])
                if n >= FLUSH:
                    yield from flush()
                    parts, n = [], 0
        if n:
            yield from flush()

    def windows(units: Units, part: dict, ids, keys, base) -> dict[str, np.ndarray]:
        at = np.flatnonzero(part["wide"])
        if not len(at):
            return _join([])
        count = part["stop"][at] - part["start"][at] - size + 1
        of = np.repeat(at, count)
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = part["start"][of] + step
        print_ = Prints(units.values).of(base[of] + start, base[of] + start + size)
        one = np.ones(len(of), np.int64)
        return {"name": mix(part["name"][of].view(np.uint64) + (part["before"][of] - step).astype(np.uint64)), "print": print_, "doc": ids[of], "key": keys[of], "start": start, "before": (one * 0).astype("<u2"), "count": one.astype("<u2"), "many": (one * 0).astype("u1")}

    def contexts(units: Units, part: dict, ids, keys, base) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(~part["wide"])
        if not len(at):
            return
        name = part["name"][at].view(np.uint64)
        where = (name % U(buckets)).astype(np.int64)
        at, name, where = (x[np.argsort(where, kind="stable")] for x in (at, name, where))
        rows = []
        for a, b in zip(edges := np.flatnonzero(np.diff(where, prepend=-1)), np.append(edges[1:], len(where)), strict=True):
            i = at[a:b]
            start, stop = part["start"][i], part["stop"][i]
            more = b"".join(units.content(x, y) for x, y in zip((base[i] + start).tolist(), (base[i] + stop).tolist(), strict=True))
            zero = np.zeros(len(i), np.uint64)
            rows.append((int(where[a]), dump({"name": name[a:b], "print": zero, "doc": ids[i], "key": keys[i], "start": start, "before": part["before"][i], "count": stop - start - size + 1, "many": part["done"][i]}, more)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([CONTEXTS] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "kind", "data"])

    def last(table: pa.Table) -> pa.Table:
        rest = table.filter(pa.compute.not_equal(table["kind"], CONTEXTS))
        out = [names(False)(rest)]
        if near is not None and rest.num_rows < table.num_rows:
            got = [load(d) for k, d in zip(table["kind"].to_pylist(), table["data"].to_pylist(), strict=True) if k == CONTEXTS]
            items = _join([g[0] for g in got])
            matched, start, stop = near(items, b"".join(g[1] for g in got), size)
            out.append(pa.Table.from_batches([_found(SPANS, *_spans({"doc": items["doc"][matched], "key": items["key"][matched], "start": start}, stop))]))
        return pa.concat_tables(out)

    first = checkpointed(docs.mapInArrow(scan, DEALT).groupBy("bucket").applyInArrow(names(True), FOUND))
    asked = first.where(F.col("kind") == ITEMS).groupBy("doc", "key").agg(F.collect_list(F.struct("start", "stop", "name", "before", "done", "wide")).alias("asked"))
    more = docs.join(asked, ["doc", "key"]).select("doc", "key", "text", "asked").mapInArrow(again, DEALT).groupBy("bucket").applyInArrow(last, FOUND)
    spans = first.where(F.col("kind") == SPANS).select("doc", "key", "start", "stop").unionByName(more.select("doc", "key", "start", "stop"))
    return spans.groupBy("doc", "key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, key, text; key is 0 where no id comes twice, else a hash of the text."""
    twice = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").limit(1).count()
    return docs.select(F.col(id_col).cast("long").alias("doc"), (F.xxhash64(text_col) if twice else F.lit(0).cast("long")).alias("key"), F.col(text_col).alias("text"))


def removed(n: int, spans: list[dict] | None) -> np.ndarray:
    """Mask of the units that spans cover."""
    step = np.zeros(n + 1, np.int32)
    for s in spans or ():
        step[s["start"]] += 1
        step[s["stop"]] -= 1
    return np.cumsum(step[:n]) > 0
