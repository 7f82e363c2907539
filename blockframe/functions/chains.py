"""Sequences exactly as the format's published archives have them, levels 1 to 5: one hash table of chained positions, filled on the way. Slow; for archives that must be equal byte by byte."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from blockframe.functions.matches import MAX_DISTANCE, Found, Line, U
from blockframe.functions.wire import ArchiveError

# Fixed values of the published encoder: hash factors and shifts, then by level: candidates, length that suffices, probes of the next positions, candidates of a probe, length from which none is made, least step, and how fast steps grow.
FACTOR_FIVE, FACTOR_FOUR = 0x2545F4914F6CDD1D, 0x2D35182D
SHIFT_FIVE, SHIFT_FOUR = 49, 17
EFFORT = {1: (3, 16, 0, 0, 0, 4, 4), 2: (3, 18, 0, 0, 0, 3, 6), 3: (3, 16, 1, 4, 128, 1, 4), 4: (3, 18, 2, 4, 128, 1, 5), 5: (64, 256, 2, 16, 128, 1, 8)}
MARGIN, WINDOW = 8, 1 << 16


@dataclass
class _Chains:
    """The table over one block and the dictionary before it. Position 0 stands for none."""

    data: bytes
    hashes: list[int]
    tags: list[int]
    heads: dict[int, int] = field(default_factory=dict)
    last_tag: dict[int, int] = field(default_factory=dict)
    back: list[int] = field(default_factory=lambda: [0] * WINDOW)

    def enter(self, at: int, before: int) -> None:
        """at becomes the head of its chain, `before` the next one."""
        h = self.hashes[at]
        self.heads[h], self.last_tag[h] = at, self.tags[at]
        self.back[at % WINDOW] = at - before if before and at - before < WINDOW else 0

    def head(self, at: int) -> tuple[int, bool]:
        """The head of at's chain, and whether its tag tells that it is no match."""
        h = self.hashes[at]
        found = self.heads.get(h, 0)
        return found, found > 0 and self.last_tag[h] != self.tags[at]

    def follow(self, at: int) -> int:
        step = self.back[at % WINDOW]
        return at - step if step else 0

    def agree(self, at: int, other: int) -> int:
        """Bytes in common, up to the end of the block."""
        n, most, step = 0, len(self.data) - at, 16
        while n < most:
            step = min(step, most - n)
            a, b = self.data[at + n : at + n + step], self.data[other + n : other + n + step]
            if a != b:
                return n + next(i for i in range(step) if a[i] != b[i])
            n, step = n + step, 2 * step
        return most


def _table(data: bytes, level: int) -> _Chains:
    raw = np.frombuffer(data + bytes(8), np.uint8)
    words = np.ndarray(len(data), "<u8", raw, strides=(1,)).copy()
    low = words & U(0xFFFFFFFF)
    if level >= 3:
        hashes = (words & U(0xFFFFFFFFFF)) * U(FACTOR_FIVE) >> U(SHIFT_FIVE)
    else:
        hashes = ((words ^ words >> U(15)) & U(0xFFFFFFFF)) * U(FACTOR_FOUR) % U(1 << 32) >> U(SHIFT_FOUR)
    return _Chains(data, hashes.tolist(), ((low ^ low >> U(16)) & U(255)).tolist())


def _seed(table: _Chains, size: int) -> None:
    """Enters the dictionary: every fourth position of its first half, unchained, and all of the second."""
    upto = size - 4
    for at in range(0, upto // 2, 4):
        table.enter(at, 0)
    for at in range(max(0, upto // 2), upto):
        table.enter(at, table.head(at)[0])


def _best(table: _Chains, at: int, level: int) -> tuple[int, int]:
    """Length and place of the best match at a position, which is entered; 0 if there is none."""
    tries, enough = EFFORT[level][:2]
    place, other = table.head(at)
    if other and level <= 2:
        place, other = 0, False
    table.enter(at, place)
    if other:  # the head only costs an attempt
        place, tries = table.follow(place), tries - 1
    data, length, found = table.data, 4, -1
    four = data[at : at + 4]
    while place > 0 and tries >= 0 and at - place <= MAX_DISTANCE:
        if data[place : place + 4] == four and data[place + length] == data[at + length]:
            own = table.agree(at, place)
            if own > length:
                length, found = own, place
                if own >= enough or at + own >= len(data):
                    break
        place, tries = table.follow(place), tries - 1
    return (length, found) if found >= 0 else (0, 0)


def _probe(table: _Chains, at: int, tries: int) -> int:
    """The longest match at a position, which is not entered."""
    place, other = table.head(at)
    longest, four = 0, table.data[at : at + 4]
    while place > 0 and tries > 0 and at - place <= MAX_DISTANCE:
        if not other and table.data[place : place + 4] == four:
            longest = max(longest, table.agree(at, place))
        place, tries, other = table.follow(place), tries - 1, False
    return longest


def walk(block: bytes, before: bytes, level: int) -> list[tuple[int, int, int]]:
    """Places (in before + block), lengths and distances of the matches."""
    _, _, probes, tries, short, base, growth = EFFORT[level]
    data = before + block
    table, out, at = _table(data, level), [], len(before)
    if len(before) >= 5:
        _seed(table, len(before))
    anchor, limit = at, len(data) - MARGIN
    while at < limit:
        step = base + (at - anchor >> growth)
        length, place = _best(table, at, level)
        begin = at
        while length and begin > anchor and place > 0 and data[begin - 1] == data[place - 1]:
            begin, place, length = begin - 1, place - 1, length + 1
        if length and probes and length < short and at + 1 < limit:
            if any(at + k < limit and _probe(table, at + k, tries) > length + k for k in range(1, probes + 1)):
                length = 0
        if not length:
            at += 1 if at + step >= limit else step
            continue
        out.append((begin, length, begin - place))
        at = anchor = begin + length
        if level == 5 and anchor < len(data) - 7:
            table.enter(anchor - 2, table.head(anchor - 2)[0])
    return out


def exact(line: Line, level: int) -> Found:
    """As Line.greedy, by the published encoder's rules."""
    if level not in EFFORT:
        raise ArchiveError("BAD_LEVEL")
    before, at, size, far, counts = line.data[: line.before].tobytes(), [], [], [], []
    for start, stop in zip(line.starts.tolist(), line.stops.tolist(), strict=True):
        got = walk(line.data[start:stop].tobytes(), before, level)
        at += [start + a - len(before) for a, _, _ in got]
        size += [n for _, n, _ in got]
        far += [d for _, _, d in got]
        counts.append(len(got))
    return line.sequences(np.array(at, np.int64), np.array(size, np.int64), np.array(far, np.int64), np.array(counts, np.int64))
