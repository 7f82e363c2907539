"""Matches of many blocks at once: candidates by one sort of all positions, their lengths word by word, and the walk that picks sequences."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
MIN_MATCH, MAX_DISTANCE = 5, 65_535
#: Words of eight bytes that a match is followed at once; what is longer goes on as another match, or by its neighbour's length.
WORDS = 64
#: Inside a match this long the next position is not asked for a longer one.
CERTAIN = 64


@dataclass
class Found:
    """Sequences of all blocks, in order: block, literals before, match length, distance, where the match begins in the line of all blocks; and each block's first sequence (one more entry at the end)."""

    block: np.ndarray
    literals: np.ndarray
    length: np.ndarray
    distance: np.ndarray
    at: np.ndarray
    bounds: np.ndarray


def _ordered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of values (of MIN_MATCH bytes) in the order of value and place, and which are equal to the next."""
    if len(values) > 1 << 8 * (8 - MIN_MATCH):
        places = np.argsort(values, kind="stable")
        return places, values[places[1:]] == values[places[:-1]]
    bits = U(8 * (8 - MIN_MATCH))
    keys = np.sort(values << bits | np.arange(len(values), dtype=U))
    return (keys & ((U(1) << bits) - U(1))).astype(np.int64), keys[1:] >> bits == keys[:-1] >> bits


class Line:
    """The dictionary and all blocks, one after the other. Positions match earlier ones of their own block, or of the dictionary that stands before each block."""

    def __init__(self, blocks: list[bytes], before: bytes = b""):
        sizes = np.array([len(before), *map(len, blocks)], np.int64)
        self.stops = np.cumsum(sizes)[1:]
        self.starts, self.before = self.stops - sizes[1:], len(before)
        self.data = np.frombuffer(before + b"".join(blocks) + b"\0" * 8, np.uint8)
        self.n = len(self.data) - 8
        self.own = np.repeat(np.arange(-1, len(blocks), dtype=np.int32), sizes)
        self.words = np.ndarray(self.n, "<u8", self.data, strides=(1,)).copy()  # the eight bytes from each position on
        self._links()

    def _links(self) -> None:
        """Of each position the closest one before in the same block with the same MIN_MATCH bytes, or the closest one of the dictionary; -1 if there is none. The bytes themselves are sorted, and no block's
        links depend on what else is in the line."""
        low = self.words & U((1 << 8 * MIN_MATCH) - 1)
        places, same = _ordered(low)
        same &= self.own[places[1:]] == self.own[places[:-1]]
        self.links = np.full(self.n, -1, np.int64)
        self.links[places[1:][same]] = places[:-1][same]
        if self.before >= MIN_MATCH:
            whole = self.before - MIN_MATCH + 1  # what begins later runs into the first block
            places, same = _ordered(low[:whole])
            last = places[np.append(~same, True)]
            known = low[last]
            open_ = np.flatnonzero((self.links < 0) & (self.own >= 0))
            at = np.searchsorted(known, low[open_])
            hit = known[np.minimum(at, len(known) - 1)] == low[open_]
            self.links[open_[hit]] = last[at[hit]]

    def distances(self, at: np.ndarray, candidate: np.ndarray) -> np.ndarray:
        """Distances as the format counts them: the dictionary ends where the block begins."""
        inside = self.own[candidate] >= 0
        return np.where(inside, at - candidate, at - self.starts[self.own[at]] + self.before - candidate)

    def agree(self, at: np.ndarray, candidate: np.ndarray) -> np.ndarray:
        """Bytes that positions share with their candidates, up to the end of the block (or of the dictionary)."""
        own = self.own[candidate]
        most = np.minimum(self.stops[self.own[at]] - at, np.where(own < 0, self.before, self.stops[own]) - candidate)
        got = np.zeros(len(at), np.int64)
        live = np.arange(len(at))
        for step in range(WORDS):
            a, b = at[live] + 8 * step, candidate[live] + 8 * step
            other = self.words[a] ^ self.words[b]
            got[live] = 8 * step + (np.bitwise_count((other & (~other + U(1))) - U(1)).astype(np.int64) >> 3)
            live = live[(other == 0) & (most[live] > 8 * step + 8)]
            if not len(live):
                break
        return np.minimum(got, most)

    def longest(self, tries: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each position the longest match among its `tries` closest candidates and its distance; 0 if there is none."""
        length, distance = np.zeros(self.n + 1, np.int64), np.zeros(self.n + 1, np.int64)
        at = np.flatnonzero((self.links >= 0) & (self.own >= 0))
        candidate = self.links[at]
        for _ in range(tries):
            gap = self.distances(at, candidate)
            near = (gap <= MAX_DISTANCE) & ((self.words[at] ^ self.words[candidate]) & U((1 << 8 * MIN_MATCH) - 1) == 0) & (at + MIN_MATCH <= self.stops[self.own[at]])
            near &= (self.own[candidate] >= 0) | (candidate + MIN_MATCH <= self.before)
            at, candidate, gap = at[near], candidate[near], gap[near]
            if not len(at):
                break
            # positions in a row with one distance: the last one's length tells the others'
            chained = np.zeros(len(at), bool)
            chained[:-1] = (at[1:] == at[:-1] + 1) & (candidate[1:] == candidate[:-1] + 1) & (self.own[candidate[1:]] == self.own[candidate[:-1]]) & (self.own[at[1:]] == self.own[at[:-1]])
            last = np.flatnonzero(~chained)
            got = self.agree(at[last], candidate[last])
            to = np.repeat(np.arange(len(last)), np.diff(last, prepend=-1))
            own = got[to] + last[to] - np.arange(len(at))
            better = own > length[at]
            length[at[better]], distance[at[better]] = own[better], gap[better]
            follow = self.links[candidate]
            more = follow >= 0
            at, candidate = at[more], follow[more]
            if not len(at):
                break
        return length, distance

    def greedy(self, tries: int, lazy: bool) -> Found:
        """The walk: from the first position that has a match to the end of that match, and on. lazy: a longer match one position on is preferred."""
        length, distance = self.longest(tries)
        at = np.flatnonzero(length)
        size = length[at]
        choice = np.arange(len(at))
        if lazy and len(at):
            better = (size[:-1] < CERTAIN) & (at[1:] == at[:-1] + 1) & (size[1:] > size[:-1] + 1) & (self.own[at[1:]] == self.own[at[:-1]])
            choice[:-1] += better
        ahead = np.searchsorted(at, at + size)[choice].tolist()
        first = np.searchsorted(at, np.append(self.starts, self.n)).tolist()
        picked, counts = [], []
        for k, end in zip(first[:-1], first[1:], strict=True):
            before = len(picked)
            while k < end:
                picked.append(k)
                k = ahead[k]
            counts.append(len(picked) - before)
        at = at[choice[np.array(picked, np.int64)]]
        return self.sequences(at, length[at], distance[at], np.array(counts, np.int64))

    def sequences(self, at: np.ndarray, length: np.ndarray, distance: np.ndarray, counts: np.ndarray) -> Found:
        bounds = np.concatenate([[0], np.cumsum(counts)])
        block = np.repeat(np.arange(len(counts)), counts)
        behind = np.concatenate([[0], (at + length)[:-1]]) if len(at) else at
        first = bounds[:-1][counts > 0]
        behind[first] = self.starts[counts > 0]
        return Found(block, at - behind, length, distance, at, bounds)

    def texts(self, found: Found) -> list[bytes]:
        """The literals of each block."""
        edge = np.zeros(self.n + 1, np.int8)
        edge[found.at] = 1
        edge[found.at + found.length] -= 1  # no two matches end at one place
        plain = np.cumsum(edge[:-1], dtype=np.int8) == 0
        plain[: self.before] = False
        text = self.data[: self.n][plain].tobytes()
        ends = np.concatenate([[0], np.cumsum(plain)])
        return [text[a:b] for a, b in zip(ends[self.starts].tolist(), ends[self.stops].tolist(), strict=True)]


def varints(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The variable-length integers of values (below 2^21), and where each begins (one more entry at the end)."""
    size = 1 + (values >= 1 << 7) + (values >= 1 << 14)
    at = np.concatenate([[0], np.cumsum(size)])
    out, begin = np.zeros(at[-1], np.uint8), at[:-1]
    out[begin] = np.where(size == 1, values, np.where(size == 2, 0x80 | values & 0x3F, 0xC0 | values & 0x1F))
    two, three = size >= 2, size == 3
    out[begin[two] + 1] = (np.where(three, values >> 5, values >> 6) & 0xFF)[two]
    out[begin[three] + 2] = values[three] >> 13
    return out.tobytes(), at


def extras(found: Found, cap: int) -> list[bytes]:
    """Of each block, what its sequences' literal runs and matches exceed cap by (both where they reach it), in order."""
    both = np.stack([found.literals, found.length - MIN_MATCH], 1).reshape(-1)
    over = np.flatnonzero(both >= cap)
    data, at = varints(both[over] - cap)
    ends = at[np.searchsorted(over, 2 * found.bounds)].tolist()
    return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def resolve(literals: np.ndarray, before: np.ndarray, runs: np.ndarray, lengths: np.ndarray, distances: np.ndarray) -> np.ndarray:
    """The bytes that sequences stand for, after the dictionary `before`; literals beyond the last sequence end it. Every byte of a match points to an earlier one; pointers are
    followed twice as far in each round until all end at literals or the dictionary."""
    ends = np.cumsum(runs + lengths) + len(before)
    total = (int(ends[-1]) if len(ends) else len(before)) + len(literals) - int(runs.sum())
    begin = ends - lengths
    source = np.arange(total, dtype=np.int32)
    count = lengths.astype(np.int64)
    inside = np.arange(int(count.sum()), dtype=np.int64) - np.repeat(np.cumsum(count) - count, count)
    place = np.repeat(begin, count) + inside
    near = distances < lengths
    if near.any():
        step = np.repeat(distances, count)
        inside = np.where(np.repeat(near, count), inside % step, inside)
    source[place] = np.repeat(begin - distances, count) + inside
    plain = np.ones(total, bool)
    plain[place] = False
    plain[: len(before)] = False
    out = np.zeros(total, np.uint8)
    out[: len(before)] = before
    out[plain] = literals
    plain[: len(before)] = True
    live = place
    while len(live):
        source[live] = source[source[live]]
        live = live[~plain[source[live]]]
    return out[source][len(before) :]
