"""Suffix-array dedup: bytes of long strings that also occur elsewhere. Sampled suffixes are ordered by deep-shallow sorting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockframe.llm.common import table
from blockframe.llm.poly import Rolling, U, mix
from blockframe.llm.repeats import Units, find_spans, keyed, removed

#: Bytes of a string that counts as repeated.
WINDOW = 400
#: Bytes that name an anchor; the sample holds the suffix with the least name of each window.
GRAM = 64
#: Depth in bytes to which multikey quicksort goes before blind tries take over.
SHALLOW = 32


# -- deep-shallow sorting ---------------------------------------------------------------------------------------


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class BlindTrie:
    """A Patricia trie over strings: a node knows only its branching depth and, by the byte there (-1: the string ends), its children; leaves are lists of equal strings' numbers."""

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None

    def _byte(self, i: int, depth: int) -> int:
        s = self.strings[i]
        return s[depth] if depth < len(s) else -1

    def insert(self, i: int) -> None:
        if self.root is None:
            self.root = [i]
            return
        node = self.root
        while isinstance(node, tuple):  # blind: only branching bytes are looked at, any leaf below will do
            depth, children = node
            node = children.get(self._byte(i, depth)) or next(iter(children.values()))
        other = node[0]
        depth = common_prefix(self.strings[i], self.strings[other])
        if depth == len(self.strings[i]) == len(self.strings[other]):
            node.append(i)
            return
        parent, step, node = None, None, self.root
        while isinstance(node, tuple) and node[0] < depth:
            parent, step = node, self._byte(i, node[0])
            node = node[1][step]
        if isinstance(node, tuple) and node[0] == depth:
            node[1][self._byte(i, depth)] = [i]
            return
        fresh = (depth, {self._byte(other, depth): node, self._byte(i, depth): [i]})
        if parent is None:
            self.root = fresh
        else:
            parent[1][step] = fresh

    def ordered(self) -> list[int]:
        out, stack = [], [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out += node
        return out


def deep_shallow_sort(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Numbers of strings in their order, equal ones by number: multikey quicksort, eight bytes at a time, down to depth shallow; groups that still agree go through a blind trie."""
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) == 1:
            out += group
        elif depth >= shallow:
            trie = BlindTrie(strings)
            for i in group:
                trie.insert(i)
            out += trie.ordered()
        else:
            keys = [strings[i][depth : depth + 8] for i in group]
            pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
            less = [i for i, k in zip(group, keys, strict=True) if k < pivot]
            same = [i for i, k in zip(group, keys, strict=True) if k == pivot]
            more = [i for i, k in zip(group, keys, strict=True) if k > pivot]
            if more:
                stack.append((more, depth))
            stack.append((same, depth + 8 if len(pivot) == 8 else max(shallow, depth)))
            if less:
                stack.append((less, depth))
    return out


def _ranks(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of strings and, for each but the first in that order, the length it shares with the one before."""
    order = deep_shallow_sort(strings)
    return np.array(order), np.array([common_prefix(strings[a], strings[b]) for a, b in zip(order[:-1], order[1:], strict=True)], np.int64)


def match_group(texts: list[bytes], before: np.ndarray, count: np.ndarray, size: int) -> list[list[tuple[int, int]]]:
    """texts[i] holds count[i] windows of size bytes, window j of which has the group's anchor at distance before[i] - j. For each text the ranges [j, k) of windows equal to a window of another text.

    Both the suffixes at the anchors and the reversed prefixes before them are sorted. Windows at distance d are equal if their prefixes share d bytes
    and their suffixes size - d; which ones do changes only at distances that the neighbours' common lengths name.
    """
    lefts = [t[:b][::-1] for t, b in zip(texts, before.tolist(), strict=True)]
    rights = [t[b:] for t, b in zip(texts, before.tolist(), strict=True)]
    (lo, ll), (ro, rl) = _ranks(lefts), _ranks(rights)
    low, high = before - count + 1, before  # distances of a text's windows
    cuts = np.unique(np.concatenate([low, high + 1, ll + 1, size - rl, [0]]))
    cuts = cuts[(cuts >= 0) & (cuts <= size)]
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    lc, rc = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for d, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        lc[lo[1:]], rc[ro[1:]] = np.cumsum(ll < d), np.cumsum(rl < size - d)
        lc[lo[0]] = rc[ro[0]] = 0
        live = np.flatnonzero((low <= d) & (d <= high))
        if len(live) < 2:
            continue
        _, which, n = np.unique(lc[live] * len(texts) + rc[live], return_inverse=True, return_counts=True)
        for i in live[n[which] > 1].tolist():
            out[i].append((int(before[i]) - end + 1, int(before[i]) - d + 1))
    return out


def near(items: dict[str, np.ndarray], data: bytes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matched spans of unsettled items: number of the item, start, stop in units of its document. Each name's suffixes, and reversed prefixes, are ordered by the deep-shallow sort."""
    length = items["count"].astype(np.int64) - 1 + size
    ends = np.cumsum(length)
    order = np.lexsort((items["start"], items["key"], items["doc"], items["name"]))
    names = items["name"][order]
    edges = np.flatnonzero(np.diff(names, prepend=names[:1]) != 0)
    edges = np.concatenate([[0], edges, [len(order)]]) if len(order) else np.zeros(1, np.int64)
    which, first, stop = [], [], []
    before, count, begin, done = items["before"].astype(np.int64), items["count"].astype(np.int64), items["start"].astype(np.int64), items["many"]
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        group = order[a:b]
        texts = [data[e - n : e] for e, n in zip(ends[group].tolist(), length[group].tolist(), strict=True)]
        ranges = match_group(texts, before[group], count[group], size)
        for i, own in zip(group.tolist(), ranges, strict=True):
            if not done[i]:
                for j, k in own:
                    which.append(i)
                    first.append(begin[i] + j)
                    stop.append(begin[i] + k - 1 + size)
    return np.array(which, np.int64), np.array(first, np.int64), np.array(stop, np.int64)


# -- the sample of suffixes -------------------------------------------------------------------------------------


class Bytes(Units):
    size, earlier = WINDOW, False

    def __init__(self, texts: list[bytes]):
        self.data = b"".join(texts)
        self.values = np.frombuffer(self.data, np.uint8)
        self.bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)

    def content(self, start: int, stop: int) -> bytes:
        return self.data[start:stop]

    def anchors(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the least GRAM-byte print in each window, the first of equals: van Herk's running minimum over blocks."""
        n = len(self.values) - GRAM + 1
        prints, reach = Rolling(self.values), self.size - GRAM + 1
        place = U(n.bit_length())
        at = np.arange(n)
        names = mix(prints.raw(at, at + GRAM))
        keys = (names >> place << place) | at.astype(U)
        padded = np.concatenate([keys, np.full(-n % reach + reach, ~U(0))]).reshape(-1, reach)
        ahead = np.minimum.accumulate(padded, axis=1).reshape(-1)
        back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        best = (np.minimum(back[starts], ahead[starts + reach - 1]) & ((U(1) << place) - U(1))).astype(np.int64)
        return best, names[best]


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, text, n_bytes, n_removed, n_spans, spans (array of start, stop in bytes), kept (binary).

    Removed is each byte covered by a string of WINDOW bytes of one document that also begins anywhere else, overlaps included; strings are judged on the
    input. Null texts count as empty. Rows with a null id lose nothing and count for no other row. Rows that share id and text count as one document and get
    the same result. Other columns are ignored.
    """
    rows = keyed(docs, id_col, text_col)
    spans = find_spans(rows, Bytes, near)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, lost, runs, kept = [], [], [], []
            for text, own in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = text or b""
                size.append(len(text))
                if own:
                    gone = removed(len(text), own)
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                    lost.append(int(gone.sum()))
                    runs.append([{"start": int(a), "stop": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
                    kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
                else:
                    lost.append(0)
                    runs.append([])
                    kept.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(lost, pa.int64()), pa.array([len(r) for r in runs], pa.int64()), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())], ["id", "text", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    joined = rows.join(spans, ["doc", "key"], "left").select(F.col("doc").alias("id"), "text", "spans")
    return joined.mapInArrow(cut, "id long, text string, n_bytes long, n_removed long, n_spans long, spans array<struct<start:bigint,stop:bigint>>, kept binary")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeated_bytes(table(spark, sf_dir, "documents"))
    return done.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL: dict[str, str] = {}
