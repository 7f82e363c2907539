"""Encoding of texts by way of their distinct segments: a tokenizer that never merges across segment borders sees each segment once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np

from blockframe.llm.poly import Rolling

#: Bytes of text handled at once (a longer single text counts as one).
CHUNK_BYTES = 1 << 20
#: Distinct segments, and tokens of theirs, that a worker remembers.
CACHE_SEGMENTS, CACHE_TOKENS = 500_000, 8_000_000


class SegmentEncoder:
    """encode: a list of segments (bytes) to a list of id sequences."""

    def __init__(self, encode: Callable[[list[bytes]], list], borders: Callable[[np.ndarray], np.ndarray], whole: tuple[bytes, ...] = (), most: int = CACHE_SEGMENTS):
        """borders: bytes to a mask of where a segment begins; entry 0 of a text is always one. A text that holds one of whole is a single segment. most: segments that are remembered."""
        self.encode, self.borders, self.whole, self.most = encode, borders, whole, most
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.tokens, self.starts, self.used = np.zeros(1 << 16, np.uint32), [0], 0
        self.met = np.zeros(1 << 16, np.uint8)

    def _make_room(self) -> None:
        """Forgets segments that were met in one call only; all, if those are too few to make room."""
        starts = np.asarray(self.starts)
        often = np.flatnonzero(self.met[: len(self.known)] > 1)
        size = starts[often + 1] - starts[often]
        if 2 * len(often) > self.most or 2 * size.sum() > CACHE_TOKENS:
            self.forget()
            return
        ends = np.cumsum(size)
        self.tokens = self.tokens[np.repeat(starts[often] - (ends - size), size) + np.arange(size.sum())]
        self.starts, self.used = [0, *ends.tolist()], int(size.sum())
        segments = list(self.known)  # in the order of their numbers
        self.known = {segments[i]: k for k, i in enumerate(often.tolist())}
        self.met = np.ones(len(often), np.uint8)

    def _learn(self, new: list[bytes]) -> None:
        got = self.encode(new)
        sizes = [len(g) for g in got]
        need = self.used + sum(sizes)
        if need > len(self.tokens):
            self.tokens = np.concatenate([self.tokens, np.zeros(max(need, len(self.tokens)), np.uint32)])
        self.tokens[self.used : need] = np.concatenate(got) if isinstance(got[0], np.ndarray) else np.fromiter(chain.from_iterable(got), np.uint32, need - self.used)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.starts += (self.used + np.cumsum(sizes)).tolist()
        self.used = need

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and each text's first place (one more entry at the end)."""
        ends = np.cumsum([len(t) for t in texts])
        flat = np.frombuffer(b"".join(texts), np.uint8)
        if not len(flat):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        begins = self.borders(flat)
        data = flat.tobytes()
        for special in self.whole:
            if special in data:
                for t, end in zip(texts, ends.tolist(), strict=True):
                    if special in t:
                        begins[end - len(t) : end] = False
        begins[0] = True
        begins[ends[:-1][ends[:-1] < len(flat)]] = True
        starts = np.flatnonzero(begins)
        stops = np.append(starts[1:], len(flat))
        _, first, which = np.unique(Rolling(flat).of(starts, stops), return_index=True, return_inverse=True)
        if not _same(flat, starts, stops, first[which]):  # two segments of one fingerprint
            number: dict[bytes, int] = {}
            which = np.array([number.setdefault(data[a:b], len(number)) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)])
            first = np.unique(which, return_index=True)[1]
        segments = [data[a:b] for a, b in zip(starts[first].tolist(), stops[first].tolist(), strict=True)]
        if len(self.known) > self.most or self.used > CACHE_TOKENS:
            self._make_room()
        if new := [s for s in segments if s not in self.known]:
            self._learn(new)
        table = np.asarray(self.starts)
        index = np.array([self.known[s] for s in segments])
        if len(self.known) > len(self.met):
            self.met = np.concatenate([self.met, np.zeros(max(len(self.known), len(self.met)), np.uint8)])
        self.met[index] = np.minimum(self.met[index], 1) + 1
        begin, count = table[index][which], (table[index + 1] - table[index])[which]
        after = np.cumsum(count)
        ids = self.tokens[np.repeat(begin - (after - count), count) + np.arange(after[-1])]
        borders = np.searchsorted(starts, np.concatenate([[0], ends]))
        return ids, np.concatenate([[0], after])[borders]


def _same(flat: np.ndarray, starts: np.ndarray, stops: np.ndarray, like: np.ndarray) -> bool:
    """Whether each segment holds the same bytes as segment like of it."""
    size = stops - starts
    if (size != size[like]).any():
        return False
    return bool((flat[np.arange(len(flat)) + np.repeat(starts[like] - starts, size)] == flat).all())


def chunks(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about `most` bytes."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)
