"""Length-limited canonical codes and their bits grouped by tree node: each node's bits form one run, so decoding is a cascade of array merges."""

from __future__ import annotations

from collections import deque
from functools import lru_cache

import numpy as np

from blockframe.functions.wire import ArchiveError

MAX_BITS = 11


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal lengths of at most limit bits for 256 counts, by the coin collector's method: packages of two are merged with fresh coins limit times."""
    present = [(int(c), (s,)) for s, c in enumerate(counts) if c]
    out = np.zeros(256, np.uint8)
    if len(present) == 1:
        out[present[0][1][0]] = 1
        return out
    coins = sorted(present)
    row = coins
    for _ in range(limit - 1):
        packages = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(row[::2], row[1::2])]
        row = sorted(coins + packages)
    for _, symbols in row[: 2 * (len(present) - 1)]:
        for s in symbols:
            out[s] += 1
    return out


def touches(lengths: np.ndarray, counts: np.ndarray) -> int:
    """Symbols that decoding moves, over all levels of merging."""
    return sum(n for n, _ in Tree(lengths).loads(counts))


def nudged(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Lengths of a shallower code where decoding then moves at most 230/256 of the symbols and the code grows by at most 1.5 percent; else the optimal ones. Fewer than four symbols are left alone."""
    best = code_lengths(counts, limit)
    used = int((counts > 0).sum())
    if used < 4:
        return best
    bits, work = int((best * counts).sum()), touches(best, counts)
    out, least = best, 230 * work // 256
    for lower in (limit - 1, limit - 2):
        if 1 << lower < used:
            break
        other = code_lengths(counts, lower)
        if 1000 * int((other.astype(np.int64) * counts).sum()) <= 1015 * bits and (own := touches(other, counts)) <= least:
            out, least = other, own
    return out


def pack_lengths(lengths: np.ndarray) -> bytes:
    return (lengths[::2] | lengths[1::2] << 4).astype(np.uint8).tobytes()


def unpack_lengths(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8, 128)
    out = np.empty(256, np.uint8)
    out[::2], out[1::2] = raw & 15, raw >> 4
    return out


class Tree:
    """Nodes in breadth-first order: (left, right, flat depth, symbols). Children are node numbers, -1 for none; symbols of a flat node by its packed value, of a leaf its one."""

    def __init__(self, lengths: np.ndarray):
        used = [(int(n), s) for s, n in enumerate(lengths) if n]
        if not used or max(used)[0] > MAX_BITS:
            raise ArchiveError("CORRUPT_DATA")
        total = sum(1 << MAX_BITS - n for n, _ in used)
        if total != 1 << MAX_BITS and not (len(used) == 1 and used[0][0] == 1):
            raise ArchiveError("CORRUPT_DATA")
        self.codes, code, last = np.zeros(256, np.int64), 0, 0
        leaf: dict[tuple[int, int], int] = {}
        for n, s in sorted(used):
            code <<= n - last
            last = n
            self.codes[s] = code
            leaf[n, code] = s
            code += 1
        self.lengths = lengths.astype(np.int64)

        @lru_cache(None)
        def depth(n: int, prefix: int) -> int:
            """Relative depth of all leaves below, -1 if they differ or are missing."""
            if (n, prefix) in leaf:
                return 0
            if n >= MAX_BITS:
                return -1
            a, b = depth(n + 1, 2 * prefix), depth(n + 1, 2 * prefix + 1)
            return a + 1 if a == b >= 0 else -1

        self.nodes: list[tuple[int, int, int, list[int]]] = []
        self.places: list[tuple[int, int]] = []
        queue, number = deque([(0, 0)]), 1
        while queue:
            n, prefix = queue.popleft()
            self.places.append((n, prefix))
            if (n, prefix) in leaf:
                self.nodes.append((-1, -1, 0, [leaf[n, prefix]]))
            elif (d := depth(n, prefix)) >= 2:
                # bit j of a packed value is the branch j levels down
                self.nodes.append((-1, -1, d, [leaf[n + d, prefix << d | int(f"{v:0{d}b}"[::-1], 2)] for v in range(1 << d)]))
            else:
                kids = []
                for side in (0, 1):
                    if len(used) > 1 or not side:
                        queue.append((n + 1, 2 * prefix + side))
                        kids.append(number)
                        number += 1
                    else:
                        kids.append(-1)
                self.nodes.append((kids[0], kids[1], 0, []))

    def loads(self, counts: np.ndarray) -> list[tuple[int, int]]:
        """Of each node that has bits: how many symbols pass it, and the bits it spends on each."""
        held = [0] * len(self.nodes)
        out = []
        for i in reversed(range(len(self.nodes))):
            left, right, flat, symbols = self.nodes[i]
            held[i] = int(counts[symbols].sum()) if symbols else held[left] + (held[right] if right >= 0 else 0)
            if len(symbols) != 1:
                out.append((held[i], max(1, flat)))
        return out

    def size(self, counts: np.ndarray) -> int:
        """Bytes that symbols of these counts encode to, without encoding them."""
        return sum(-(-n * bits // 8) for n, bits in self.loads(counts))

    def encode(self, data: np.ndarray) -> bytes:
        """The runs of all nodes. Every symbol must have a code."""
        parts: list[bytes] = []
        routed: dict[int, np.ndarray] = {0: data}
        for i, (left, right, flat, symbols) in enumerate(self.nodes):
            own = routed.pop(i)
            if len(symbols) == 1:
                continue
            if flat:
                value = np.zeros(256, np.int64)
                value[symbols] = np.arange(len(symbols))
                bits = (value[own][:, None] >> np.arange(flat) & 1).astype(np.uint8).reshape(-1)
            else:
                n = self.places[i][0]
                bits = (self.codes[own] >> self.lengths[own] - 1 - n & 1).astype(np.uint8)
                routed[left] = own[bits == 0]
                if right >= 0:
                    routed[right] = own[bits == 1]
            parts.append(np.packbits(bits, bitorder="little").tobytes())
        return b"".join(parts)

    def decode(self, data: bytes, n: int) -> np.ndarray:
        """n symbols. Counts go down the tree with the runs' bit sums, symbols come back up by merging."""
        counts, runs, at = {0: n}, {}, 0
        for i, (left, right, flat, symbols) in enumerate(self.nodes):
            count = counts[i]
            if len(symbols) == 1:
                continue
            size = -(-count * max(1, flat) // 8)
            if at + size > len(data):
                raise ArchiveError("CORRUPT_DATA")
            bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=count * max(1, flat), bitorder="little")
            at += size
            runs[i] = bits
            if not flat:
                ones = int(bits.sum())
                if ones and right < 0:
                    raise ArchiveError("CORRUPT_DATA")
                counts[left] = count - ones
                if right >= 0:
                    counts[right] = ones
        made: dict[int, np.ndarray] = {}
        for i in reversed(range(len(self.nodes))):
            left, right, flat, symbols = self.nodes[i]
            if len(symbols) == 1:
                made[i] = np.full(counts[i], symbols[0], np.uint8)
            elif flat:
                made[i] = np.array(symbols, np.uint8)[(runs[i].reshape(-1, flat).astype(np.int64) << np.arange(flat)).sum(axis=1)]
            else:
                out = np.empty(counts[i], np.uint8)
                out[runs[i] == 0] = made.pop(left)
                if right >= 0:
                    out[runs[i] == 1] = made.pop(right)
                made[i] = out
        return made[0]
